"""Sources of a site: pages, files, sitemaps, lists, reports, and what captured responses mean."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import xml_unescaped
from weftline.functions.urls import host, scheme_host

PRIORITY = 0.5
#: Kinds of auxiliary files and their paths.
AUX_FILES = {"llmsTxt": "/llms.txt", "llmsFullTxt": "/llms-full.txt", "robotsTxt": "/robots.txt", "sitemapXml": "/sitemap.xml"}


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """docs (sitemap_url, body) -> sitemap_url, ord, loc, priority (null if none): page entries, entities decoded. Malformed XML around them doesn't matter."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<url(?:\s[^>]*)?>(.*?)</url>"), F.lit(1))
    rows = docs.select("sitemap_url", F.posexplode(blocks).alias("ord", "b"))
    priority = F.expr(r"try_cast(nullif(regexp_extract(b, '(?is)<priority[^>]*>\\s*([0-9.]+)\\s*</priority>', 1), '') as double)")
    return rows.select("sitemap_url", "ord", xml_unescaped(_loc("b")).alias("loc"), priority.alias("priority")).where("loc <> ''")


def child_sitemaps(docs: DataFrame) -> DataFrame:
    """docs (sitemap_url, body) -> sitemap_url, ord, loc of a sitemap index's members."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<sitemap(?:\s[^>]*)?>(.*?)</sitemap>"), F.lit(1))
    rows = docs.select("sitemap_url", F.posexplode(blocks).alias("ord", "b"))
    return rows.select("sitemap_url", "ord", xml_unescaped(_loc("b")).alias("loc")).where("loc <> ''")


def _loc(block: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(block, r"(?is)<loc[^>]*>\s*(.*?)\s*</loc>", 1), r"(?s)^<!\[CDATA\[(.*?)\]\]>$", "$1"))


def resolved_sitemap(docs: DataFrame, root: str) -> DataFrame:
    """The page entries of a sitemap, and of the members of an index, one level deep; first of a loc wins."""
    members = child_sitemaps(docs.where(F.col("sitemap_url") == root)).select(F.col("loc").alias("sitemap_url"), (F.col("ord") + 1).alias("member"))
    own = sitemap_entries(docs.where(F.col("sitemap_url") == root)).withColumn("member", F.lit(0))
    rest = sitemap_entries(docs).join(members, "sitemap_url")
    both = own.unionByName(rest.select(own.columns))
    return both.groupBy("loc").agg(F.min_by(F.struct("sitemap_url", "member", "ord", "priority"), F.struct("member", "ord")).alias("x")).select("loc", "x.*")


def aux_state(status: Column, content_type: Column, body: Column, error: Column) -> Column:
    """ok, missing, timeout, unreachable or not-html for a captured auxiliary file. A page of HTML in its place is missing (a soft 404)."""
    opening = F.lower(F.substring(body, 1, 4096))
    soft = opening.rlike(r"^(\uFEFF|\s|<!--.*?-->)*(<!doctype html|<html)")
    textual = content_type.isNull() | F.lower(content_type).rlike("text/|xml|json|markdown|octet-stream") & ~body.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    return (
        F.when(status.isNull() & (F.upper(error) == "TIMEOUT"), "timeout").when(status.isNull(), "unreachable").when(status.isin(404, 410), "missing")
        .when(~status.between(200, 299), "unreachable").when(soft, "missing").when(~textual, "not-html").otherwise("ok")
    )


def is_html(content_type: Column, body: Column) -> Column:
    """An HTML content type, or an unclear one with HTML's marks near the top."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    unclear = (kind == "") | kind.rlike("^(text/plain|application/octet-stream)")
    return kind.rlike("text/html|application/xhtml") | unclear & F.lower(F.substring(body, 1, 512)).rlike("<!doctype html|<html|<head|<body")


def looks_like_sitemap(body: Column) -> Column:
    return F.lower(F.substring(body, 1, 4096)).rlike("<urlset|<sitemapindex")


def static_pages(spark: SparkSession, folder: str, base_url: str) -> DataFrame:
    """HTML files under a folder as pages: page_id is a hash of the path; index.html stands for its folder, others lose their ending. Hidden folders and node_modules are left out."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm}").load(folder)
    here = folder.rstrip("/").split("://")[-1]
    path = F.expr(f"substring(url_decode(regexp_replace(_metadata.file_path, '^[a-z]+:/*', '/')), {len(here) + 1})")
    rows = files.select(path.alias("path"), F.col("value").alias("html")).where(~F.col("path").rlike(r"/\.|/node_modules/"))
    route = F.regexp_replace(F.regexp_replace("path", r"(?i)/index\.html?$", "/"), r"(?i)\.html?$", "")
    return rows.select(F.xxhash64("path").alias("page_id"), "path", F.concat(F.lit(base_url.rstrip("/")), route).alias("url"), "html")


def disk_files(spark: SparkSession, folder: str, base_url: str) -> DataFrame:
    """The auxiliary files at the top of a folder: host, kind, state (ok or missing), url, body; a row for each kind."""
    here = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [(kind, path) for kind, path in AUX_FILES.items() if store.exists(spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + path))]
    kinds = spark.createDataFrame([(k, base_url.rstrip("/") + p) for k, p in AUX_FILES.items()], "kind string, url string")
    found = spark.createDataFrame([], "kind string, body string")
    for kind, path in there:
        found = found.unionByName(spark.read.text(folder.rstrip("/") + path, wholetext=True).select(F.lit(kind).alias("kind"), F.col("value").alias("body")))
    state = F.when(F.col("body").isNull(), "missing").otherwise("ok")
    return kinds.join(found, "kind", "left").select(host(F.lit(base_url)).alias("host"), "kind", state.alias("state"), "url", F.coalesce("body", F.lit("")).alias("body"))


def directive_sitemaps(files: DataFrame) -> DataFrame:
    """robots files (site, body) -> site, sitemap_url: the sitemaps they name on their own origin; relative ones are the site's."""
    rows = files.select("site", F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*([^#\s]+)"), F.lit(1))).alias("named"))
    whole = F.when(F.startswith("named", F.lit("/")), F.concat("site", "named")).otherwise(F.col("named"))
    return rows.select("site", whole.alias("sitemap_url")).where(scheme_host(F.col("sitemap_url")) == F.lower("site")).distinct()


def static_target(argument: str, exists: bool = False) -> bool:
    """Whether an argument is a path rather than a URL: never with a web scheme; a leading . / or ~, or a path that exists."""
    return not re.match("https?://", argument, re.IGNORECASE) and (argument[:1] in (".", "/", "~") or exists)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file, one or several (by commas) on a line, without comments."""
    rows = spark.read.text(path).select(F.explode(F.split(F.regexp_replace("value", "#.*$", ""), ",")).alias("url"))
    return rows.select(F.trim("url").alias("url")).where("url <> ''")


def reports(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def entity_registry(text: str) -> list[dict]:
    """A registry's entities from JSON; errors name the entry."""
    data = json.loads(text)
    entries = data.get("entities") if isinstance(data, dict) else None
    if not isinstance(entries, list):
        raise ValueError("a registry needs a list `entities`")
    for i, e in enumerate(entries):
        if not isinstance(e, dict) or not isinstance(e.get("key"), str) or not e["key"]:
            raise ValueError(f"entity {i} has no key")
        if not isinstance(e.get("names"), list) or not all(isinstance(n, str) for n in e["names"]):
            raise ValueError(f"entity {e['key']} has no list of names")
    return entries


def changed_routes(files: DataFrame) -> DataFrame:
    """files (path) -> path, route: pages that a changed source file makes, for usual layouts of routes; others give none."""
    p = F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), r"^\./", "")
    app = F.regexp_extract(p, r"^(?:src/)?app(?:/(.*))?/page\.(?:tsx|ts|jsx|js|mdx|md)$", 1)
    kit = F.regexp_extract(p, r"^src/routes(?:/(.*))?/\+page(?:\.server)?\.(?:svelte|ts|js|md)$", 1)
    pages = F.regexp_extract(p, r"^(?:src/)?pages/(.*)\.(?:tsx|ts|jsx|js|mdx|md|astro|vue)$", 1)
    content = F.regexp_extract(p, r"^(?:src/)?content/(.*)\.(?:mdx|md)$", 1)
    raw = F.when(p.rlike(r"^(?:src/)?app(/.*)?/page\.(tsx|ts|jsx|js|mdx|md)$"), app).when(p.rlike(r"^src/routes(/.*)?/\+page(\.server)?\.(svelte|ts|js|md)$"), kit).when((pages != "") & ~pages.rlike("^(api/|_)"), pages).when(content != "", content)
    parts = F.filter(F.split(F.regexp_replace(raw, r"(^|/)index$", ""), "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    whole = ~F.exists(parts, lambda s: s.rlike(r"^\[|^@|^_"))
    return files.select("path", F.when(whole, F.concat(F.lit("/"), F.array_join(parts, "/"))).alias("route")).where("route is not null")
