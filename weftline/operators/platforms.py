"""Platform fingerprints: signals as data, one weighted sum a platform."""

from __future__ import annotations

from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import ascii_edges

HIGH, MEDIUM, LOW, UNIT = 70, 40, 15, 18

# Platform, category, signals (kind, pattern, weight). Kinds: generator, html (regular expressions; the first
# group of a generator or html pattern is the version), script, link, image (substrings of their URLs), header (name),
# header= (name, regular expression), body (part of a class).
PLATFORMS = [
    ("wordpress", "cms", [("generator", r"(?i)WordPress(?:\s+(\d+\.\d+(?:\.\d+)?))?", 5), ("script", "/wp-includes/", 5), ("script", "/wp-content/", 4), ("link", "/wp-content/", 3), ("link", "/wp-json/", 4), ("html", "wp-block-[a-z]", 2), ("header", "x-pingback", 3), ("header=", "link:(?i)wp-json", 4)]),
    ("drupal", "cms", [("generator", r"(?i)Drupal(?:\s+(\d+))?", 5), ("header=", "x-generator:(?i)drupal", 5), ("header", "x-drupal-cache", 4), ("header", "x-drupal-dynamic-cache", 4), ("html", r"(?i)sites/(?:default|all)/", 3)]),
    ("joomla", "cms", [("generator", r"(?i)Joomla(?:!\s*-?\s*(\d+\.\d+))?", 5), ("html", "(?i)/media/jui/", 3), ("html", "(?i)/components/com_", 3)]),
    ("ghost", "cms", [("generator", r"(?i)Ghost(?:\s+(\d+\.\d+))?", 5), ("link", "/ghost/", 3), ("script", "ghost.io", 3)]),
    ("hubspot", "cms", [("generator", "(?i)HubSpot", 5), ("script", "js.hs-scripts.com", 2), ("script", "js.hsforms.net", 1), ("script", "hs-banner.com", 1), ("script", "hs-analytics.net", 1)]),
    ("craft-cms", "cms", [("header=", r"x-powered-by:(?i)Craft\s*CMS", 5), ("script", "cdn.craft.cm", 3)]),
    ("sanity", "cms", [("image", "cdn.sanity.io", 4), ("html", r"(?i)cdn\.sanity\.io", 3)]),
    ("contentful", "cms", [("image", "images.ctfassets.net", 4), ("image", "assets.ctfassets.net", 4), ("html", r"(?i)(?:images|assets|videos)\.ctfassets\.net", 3)]),
    ("notion", "cms", [("html", r"(?i)notion\.site", 3), ("generator", "(?i)Notion", 5), ("html", "__NOTION", 3)]),
    ("wix", "site-builder", [("generator", r"(?i)Wix(?:\.com)?", 5), ("script", "static.wixstatic.com", 5), ("html", "(?i)wix-warmup-data", 4), ("html", r"(?i)parastorage\.com", 3)]),
    ("squarespace", "site-builder", [("generator", "(?i)Squarespace", 5), ("script", "static1.squarespace.com", 5), ("html", r"Static\.SQUARESPACE_CONTEXT", 5), ("header=", "x-served-by:(?i)squarespace", 4)]),
    ("webflow", "site-builder", [("generator", "(?i)Webflow", 5), ("html", "(?i)<html[^>]*\\sdata-wf-page=", 5), ("html", "(?i)<html[^>]*\\sdata-wf-site=", 5), ("script", "webflow.js", 4), ("script", "webflow.com", 3), ("image", "uploads-ssl.webflow.com", 4), ("image", "cdn.prod.website-files.com", 4)]),
    ("framer", "site-builder", [("generator", "(?i)Framer", 5), ("html", r"(?i)framerusercontent\.com", 4), ("html", r"(?i)framer\.com", 2)]),
    ("carrd", "site-builder", [("generator", "(?i)Carrd", 5), ("html", r"(?i)carrd\.co", 3)]),
    ("bubble", "site-builder", [("generator", "(?i)Bubble", 4), ("script", "bubble.io", 4), ("html", "(?i)bubble-app", 3)]),
    ("shopify", "ecommerce", [("header", "x-shopid", 5), ("header", "x-shopify-stage", 5), ("script", "cdn.shopify.com", 5), ("html", r"Shopify\.theme\b", 5), ("html", r"Shopify\.shop\b", 4), ("header=", "powered-by:(?i)Shopify", 4)]),
    ("woocommerce", "ecommerce", [("body", "woocommerce", 4), ("html", "(?i)wp-content/plugins/woocommerce", 5), ("generator", r"(?i)WooCommerce(?:\s+(\d+\.\d+))?", 5)]),
    ("bigcommerce", "ecommerce", [("script", "cdn11.bigcommerce.com", 5), ("header=", "x-bc-apigw-client-id:.", 5), ("html", r"(?i)bigcommerce\.com", 3)]),
    ("magento", "ecommerce", [("html", r"Mage\.Cookies", 5), ("html", "(?i)/skin/frontend/", 4), ("html", r"(?i)/static/version\d+/", 4), ("header=", "x-magento-cache-debug:.", 5)]),
    ("prestashop", "ecommerce", [("generator", "(?i)PrestaShop", 5), ("header=", "powered-by:(?i)PrestaShop", 5)]),
    ("nextjs", "framework", [("html", "<script[^>]*\\sid=\"?__NEXT_DATA__", 5), ("script", "/_next/static/", 5), ("html", "(?i)next-route-announcer", 3), ("header", "x-nextjs-cache", 4), ("header", "x-nextjs-prerender", 4)]),
    ("nuxt", "framework", [("html", r"window\.__NUXT__", 5), ("script", "/_nuxt/", 5), ("html", "<div[^>]*\\sid=\"?__nuxt[\"\\s>]", 4)]),
    ("gatsby", "framework", [("html", "<div[^>]*\\sid=\"?___gatsby", 5), ("html", r"(?i)window\.___gatsby", 4), ("script", "/page-data/", 3)]),
    ("remix", "framework", [("html", r"window\.__remixContext\b", 5), ("html", r"window\.__remixManifest\b", 5), ("script", "/build/manifest-", 3)]),
    ("astro", "framework", [("generator", r"(?i)Astro(?:\s+v?(\d+\.\d+(?:\.\d+)?))?", 5), ("html", "(?i)<astro-island[^>]*\\suid=", 4), ("html", "(?i)data-astro-cid-", 3)]),
    ("sveltekit", "framework", [("html", "(?i)__sveltekit_", 5), ("html", "(?i)<[^>]*\\sdata-sveltekit-preload-data", 4), ("script", "/_app/immutable/", 4)]),
    ("angular", "framework", [("html", "(?i)<[^>]*\\sng-version", 5), ("html", r'ng-version="(\d+\.\d+\.\d+)"', 5)]),
    ("vue", "framework", [("html", "(?i)<[^>]*\\sdata-v-app", 4), ("html", "(?i)__VUE_", 3)]),
    ("react", "framework", [("html", "(?i)<[^>]*\\sdata-reactroot", 3), ("html", "__REACT_DEVTOOLS_GLOBAL_HOOK__", 2)]),
    ("ember", "framework", [("html", r"window\.EmberENV", 4), ("html", "(?i)<[^>]*\\sdata-ember-extension", 3)]),
    ("qwik", "framework", [("html", "(?i)<[^>]*\\sq:container", 5), ("html", "(?i)q:render", 3)]),
    ("hugo", "ssg", [("generator", r"(?i)Hugo(?:\s+(\d+\.\d+(?:\.\d+)?))?", 5)]),
    ("jekyll", "ssg", [("generator", r"(?i)Jekyll(?:\s+v?(\d+\.\d+(?:\.\d+)?))?", 5)]),
    ("eleventy", "ssg", [("generator", r"(?i)Eleventy(?:\s+v?(\d+\.\d+(?:\.\d+)?))?", 5)]),
    ("hexo", "ssg", [("generator", r"(?i)Hexo(?:\s+(\d+\.\d+))?", 5)]),
    ("docusaurus", "ssg", [("generator", r"(?i)Docusaurus(?:\s+v?(\d+\.\d+(?:\.\d+)?))?", 5), ("html", "(?i)__docusaurus", 4)]),
    ("mkdocs", "ssg", [("generator", "(?i)MkDocs", 5)]),
    ("vercel", "hosting", [("header=", "server:(?i)Vercel", 5), ("header", "x-vercel-id", 5), ("header", "x-vercel-cache", 4)]),
    ("netlify", "hosting", [("header=", "server:(?i)Netlify", 5), ("header", "x-nf-request-id", 5)]),
    ("cloudflare", "hosting", [("header=", "server:(?i)^cloudflare$", 4), ("header", "cf-ray", 4), ("header", "cf-cache-status", 3)]),
    ("github-pages", "hosting", [("header=", r"server:(?i)GitHub\.com", 5), ("header=", "x-github-request-id:.", 5)]),
    ("fastly", "hosting", [("header=", "via:(?i)varnish.*fastly", 4), ("header=", "server:(?i)fastly", 4), ("header", "x-served-by", 1)]),
    ("cloudfront", "hosting", [("header=", "via:(?i)CloudFront", 5), ("header", "x-amz-cf-id", 5)]),
]


def literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a regular expression holds; "" for none."""
    best, run = "", ""
    for op, value in _parser.parse(pattern):
        run = run + chr(value) if op is _constants.LITERAL else ""
        best = max(best, run, key=len)
    return best


def _hit(kind: str, pattern: str, html: Column, page: Column, headers: Column) -> Column:
    if kind == "generator":
        return page["generator"].rlike(pattern)
    if kind == "html":  # most pages lack the plain part, and looking for that is cheap
        part = literal(pattern)
        return F.contains(F.col("_low"), F.lit(part.lower())) & html.rlike(ascii_edges(pattern)) if part else html.rlike(ascii_edges(pattern))
    if kind == "script":
        return F.exists(page["scripts"], lambda s: F.contains(s, F.lit(pattern)))
    if kind == "link":
        return F.exists(page["links"], lambda x: F.contains(x["href"], F.lit(pattern)))
    if kind == "image":
        return F.exists(page["images"], lambda x: F.contains(x["src"], F.lit(pattern)))
    if kind == "body":
        return F.contains(page["body_class"], F.lit(pattern))
    name, _, value = pattern.partition(":")
    held = F.try_element_at(headers, F.lit(name))
    return held.rlike(value) if value else F.length(held) > 0


def detect(pages: DataFrame, least: int = LOW) -> DataFrame:
    """pages (page_id, html, headers, page) -> page_id, platforms: array<struct<score, ord, platform, category, confidence, version, signals>> by score, is_custom: no cms, site builder or shop. The sums are one expression a platform; no shuffle."""
    low = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    rows = []
    for i, (name, category, signals) in enumerate(PLATFORMS):
        hits = [F.coalesce(_hit(k, p, F.col("html"), F.col("page"), F.col("_headers")), F.lit(False)) for k, p, _ in signals]
        weight = sum((F.when(h, w).otherwise(0) for h, (_, _, w) in zip(hits, signals, strict=True)), F.lit(0))
        told = F.array_compact(F.array(*[F.when(h, f"{k} {p}") for h, (k, p, _) in zip(hits, signals, strict=True)]))
        versions = [F.when(hits[j], F.nullif(F.regexp_extract(F.col("page.generator") if k == "generator" else F.col("html"), p, 1), F.lit(""))) for j, (k, p, _) in enumerate(signals) if k in ("generator", "html") and "(" in p.replace("(?", "")]
        version = F.coalesce(*versions) if versions else F.lit(None).cast("string")
        score = F.least(F.lit(100), UNIT * weight)
        level = F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")
        rows.append(F.struct(score.alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("platform"), F.lit(category).alias("category"), level.alias("confidence"), version.alias("version"), told.alias("signals")))
    found = F.sort_array(F.filter(F.array(*rows), lambda r: r["score"] >= least), asc=False)
    out = pages.withColumns({"_headers": low, "_low": F.lower("html")}).select("page_id", found.alias("platforms"))
    return out.withColumn("is_custom", ~F.exists("platforms", lambda r: r["category"].isin("cms", "site-builder", "ecommerce")))
