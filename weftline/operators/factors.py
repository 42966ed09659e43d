"""The page factors: weighted scores as columns over parsed features.

A factor is a list of parts. Each part is a ladder of (condition, points, finding type, finding code); its first true
rung gives its points and its finding. Scores are sums of points, clamped to 0..100. All of it is column expressions, so
a page's factors cost no shuffle and unused ones are pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.operators import robots

# Factors, names and weights.
WEIGHTS = {
    "structured-data": ("Structured Data (JSON-LD)", 12),
    "content-depth": ("Content Depth", 10),
    "ai-access-files": ("AI Access Files (llms.txt, sitemap)", 5),
    "eeat-signals": ("E-E-A-T Signals", 8),
    "faq-content": ("FAQ Content", 8),
    "citations": ("Citations & Authority Signals", 8),
    "schema-completeness": ("Schema Completeness", 8),
    "schema-validity": ("Schema Validity", 5),
    "entity-consistency": ("Entity Consistency", 7),
    "content-freshness": ("Content Freshness", 7),
    "content-extractability": ("Content Extractability", 6),
    "definition-blocks": ("Definition Blocks", 6),
    "ai-crawler-access": ("AI Crawler Access", 4),
    "named-entities": ("Named Entities", 6),
    "technical-seo": ("Technical SEO", 5),
    "snippet-eligibility": ("Snippet Eligibility", 6),
}
OPTIONAL = {
    "geographic-signals": ("Geographic Signals", 7),
    "agent-skill-exposure": ("Agent Skill Exposure", 6),
    "lighthouse": ("Lighthouse (Performance/A11y/Best Practices)", 8),
}
PAGE_SPECIFIC = ("faq-content", "definition-blocks")
PRESENT = 30
#: What a finding of these types asks for, by the last word of its code.
ADVICE = {
    "missing": "Add what the finding names.", "low": "Extend what the finding names.", "moderate": "Extend what the finding names further.",
    "short": "Make it longer if context is missing.", "long": "Shorten it.", "multiple": "Keep one.", "none": "Add some where they help readers.",
    "present": "Remove the restriction if it isn't meant.", "invalid": "Repair it.", "empty": "Fill or remove it.", "duplicate": "Keep one.",
}

FINDING = "struct<type:string,code:string,message:string>"
Rung = tuple[Column | bool, float, str, str]


@dataclass
class Env:
    """What factors read besides the page: columns, so that joins decide where they come from."""

    page: Callable[[str], Column] = field(default=lambda name: F.col(f"page.{name}"))
    url: Column = field(default_factory=lambda: F.col("url"))
    headers: Column = field(default_factory=lambda: F.lit(None).cast("map<string,string>"))
    aux: Column = field(default_factory=lambda: F.lit(None).cast(AUX))
    targets: Column = field(default_factory=lambda: F.lit(None).cast(TARGETS))
    psi: Column = field(default_factory=lambda: F.lit(None).cast("array<double>"))
    #: Whether the page names an entity that doesn't own it.
    names_another: Column = field(default_factory=lambda: F.lit(None).cast("boolean"))
    #: match, mismatch or unknown: identity.with_identity's status.
    identity: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    #: Whether the site's files were offered in other formats on request.
    negotiates: Column = field(default_factory=lambda: F.lit(None).cast("boolean"))
    #: The day of the audit; the run's own where it is None.
    as_of: datetime | None = None
    #: Where a dict, costly values are put there by name and read from columns of that name, so that each is computed once a page.
    kept: dict[str, Column] | None = None

    def keep(self, name: str, value: Column) -> Column:
        if self.kept is None:
            return value
        self.kept[f"_{name}"] = value
        return F.col(f"_{name}")

    def robots_access(self) -> Column:
        body = F.coalesce(F.try_element_at(self.aux, F.lit("robotsTxt"))["body"], F.lit(""))
        return robots.audit_access_of(body, list(CRAWLERS), U.path(self.url))

    def robots_directives(self) -> Column:
        return robots.directives(self.page("robots"), self.header("x-robots-tag"))

    def header(self, name: str) -> Column:
        return F.try_element_at(F.transform_keys(self.headers, lambda k, _: F.lower(k)), F.lit(name))


#: Files of a site by kind: llmsTxt, llmsFullTxt, robotsTxt, sitemapXml.
AUX = "map<string,struct<state:string,url:string,body:string>>"
TARGETS = "map<string,struct<state:string,status:int,hops:int>>"


def has(types: Column, *names: str) -> Column:
    return F.arrays_overlap(F.coalesce(types, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]))


PART = f"struct<p:double,f:array<{FINDING}>>"


def _said(points: float, kind: str, code: str) -> Column:
    """A constant part: its points, and its finding if it has a code. One expression, as hundreds of them make a page's plan."""
    about, _, how = code.replace("-", " ").rpartition(".")
    found = f"named_struct('type', '{kind}', 'code', '{code}', 'message', '{about.replace('.', ': ')} is {how}')" if code else ""
    return F.expr(f"named_struct('p', {float(points)}D, 'f', " + (f"array({found})" if code else f"cast(array() as array<{FINDING}>)") + ")")


def ladder(*rungs: Rung) -> Column:
    """PART: points and findings of the first rung that holds; a rung without a code adds no finding, nor does none."""
    chain, last = None, _said(0, "", "")
    for cond, points, kind, code in rungs:
        own = _said(points, kind, code)
        if cond is True:
            last = own
            break
        chain = F.when(cond, own) if chain is None else chain.when(cond, own)
    return last if chain is None else chain.otherwise(last)


def several(findings: Column, points: Column | None = None) -> Column:
    """A PART with an array of findings."""
    return F.struct((F.lit(0.0) if points is None else points).alias("p"), findings.alias("f"))


def _finding(kind: Column, code: Column) -> Column:
    """A finding whose message is said by its code."""
    about, how = F.replace(F.replace(F.regexp_extract(code, r"^(.*)\.[^.]*$", 1), F.lit("."), F.lit(": ")), F.lit("-"), F.lit(" ")), F.replace(F.substring_index(code, ".", -1), F.lit("-"), F.lit(" "))
    return F.struct(kind.alias("type"), code.alias("code"), F.concat(about, F.lit(" is "), how).alias("message"))


def advice(findings: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    wanted = F.filter(findings, lambda f: (f["type"] != "found") & F.array_contains(F.map_keys(pairs), F.substring_index(f["code"], ".", -1)))
    return F.array_distinct(F.transform(wanted, lambda f: F.concat(f["code"], F.lit(": "), F.element_at(pairs, F.substring_index(f["code"], ".", -1)))))


@dataclass
class Factor:
    parts: list[Column]
    applicable: Column | None = None
    score: Column | None = None

    def row(self, key: str, place: int, name: str, weight: int) -> Column:
        """What of a factor is its own: constants, parts, whether it applies, and its score where that isn't the parts' sum."""
        fixed = F.expr(f"named_struct('factor_id', '{key}', 'ord', {place}, 'name', '{name}', 'weight', {weight})")
        applies, own = (F.expr(f"cast(null as {kind})") if x is None else x.cast(kind) for x, kind in ((self.applicable, "boolean"), (self.score, "double")))
        return F.struct(fixed.alias("fixed"), F.array(*self.parts).alias("parts"), applies.alias("applicable"), own.alias("own"), F.lit(self.score is not None).alias("scored"))


#: Canonical targets whose state is looked at.
MAX_TARGETS = 5
# Types of the canonical findings that aren't "missing".
CANONICAL_TYPES = {"present": "found", "duplicate": "info", "target-limit": "info", "redirected": "info", "timeout": "timeout", "unreachable": "unreachable", "reachable": "found", "ignored-location": "info", "ignored-attributes": "info"}


def canonical(e: Env, prefix: str = "entity-consistency") -> tuple[Column, Column]:
    """The canonical sub-score 0..20, lowered by what is known of the first targets, and its findings: those of the links, then of each target."""
    c = e.page("canonical")
    known = F.filter(F.transform(F.slice(c["urls"], 1, MAX_TARGETS), lambda u: F.try_element_at(e.targets, u)), lambda t: t.isNotNull())
    known = F.coalesce(known, F.array().cast("array<struct<state:string,status:int,hops:int>>"))
    score = F.when(F.exists(known, lambda t: t["state"] == "unreachable"), 0).when(F.exists(known, lambda t: (t["hops"] > 0) | (t["state"] == "timeout")), F.least(c["score"], F.lit(10))).otherwise(c["score"])
    state = lambda t: F.when(t["state"].isin("timeout", "unreachable"), t["state"]).otherwise("reachable")
    targets = F.flatten(F.transform(known, lambda t: F.concat(F.when(t["hops"] > 0, F.array(F.lit("redirected"))).otherwise(F.array().cast("array<string>")), F.array(state(t)))))
    limit = F.when(F.size(c["urls"]) > MAX_TARGETS, F.array(F.lit("target-limit"))).otherwise(F.array().cast("array<string>"))
    links = F.transform(F.coalesce(c["codes"], F.array().cast("array<string>")), lambda x: F.substring_index(x, ".", -1))
    kinds = F.create_map(*[F.lit(x) for kv in CANONICAL_TYPES.items() for x in kv])
    found = F.transform(F.concat(links, limit, targets), lambda x: _finding(F.coalesce(F.try_element_at(kinds, x), F.lit("missing")), F.concat(F.lit(f"{prefix}.canonical."), x)))
    return score.cast("double"), found


def structured_data(e: Env) -> Factor:
    p = e.page
    n, types = p("n_nodes"), p("types")
    mean = p("n_props") / F.when(n > 0, n)
    c = "structured-data"
    kinds = [ladder((has(types, k) | (F.size(p("business_types")) > 0 if k == "LocalBusiness" else F.lit(False)), 12, "found", f"{c}.schema.found"), (True, 0, "missing", f"{c}.schema.missing")) for k in ("LocalBusiness", "FAQPage", "Service", "HowTo")]
    return Factor([
        ladder((True, 0, "info", f"{c}.site-category.detected")),
        ladder((n > 0, 30, "found", f"{c}.json-ld.found"), (True, 0, "missing", f"{c}.json-ld.missing")), *kinds,
        ladder((mean >= 8, 22, "found", f"{c}.schema-depth.strong"), (mean >= 4, 12, "info", f"{c}.schema-depth.moderate"), (n > 0, 0, "info", f"{c}.schema-depth.low")),
    ])


def _h(e: Env, *levels: int) -> Column:
    return F.size(F.filter(e.page("headings"), lambda h: h["level"].isin(*levels)))


def content_depth(e: Env) -> Factor:
    c, w, h1, h2, h3, n_p = "content-depth", e.page("n_words"), _h(e, 1), _h(e, 2), _h(e, 3), F.size(e.page("paragraph_words"))
    return Factor([
        ladder((w >= 1200, 35, "found", f"{c}.word-count.strong"), (w >= 500, 22, "info", f"{c}.word-count.moderate"), (True, 8, "missing", f"{c}.word-count.low")),
        ladder((h1 == 1, 15, "found", f"{c}.h1.single"), (h1 > 1, 6, "info", f"{c}.h1.multiple"), (True, 0, "missing", f"{c}.h1.missing")),
        ladder(((h2 >= 3) & (h3 >= 2), 22, "found", f"{c}.headings.strong"), (h2 >= 2, 14, "info", f"{c}.headings.moderate"), (True, 4, "missing", f"{c}.headings.low")),
        ladder((n_p >= 8, 16, "found", f"{c}.paragraphs.strong"), (n_p >= 4, 10, "info", f"{c}.paragraphs.moderate"), (True, 0, "missing", f"{c}.paragraphs.low")),
        ladder((e.page("n_lists") > 0, 12, "found", f"{c}.lists.present"), (True, 0, "info", f"{c}.lists.none")),
    ])


def ai_access_files(e: Env) -> Factor:
    c = "ai-access-files"
    state = lambda k: F.coalesce(F.try_element_at(e.aux, F.lit(k))["state"], F.lit("missing"))
    body = lambda k: F.coalesce(F.try_element_at(e.aux, F.lit(k))["body"], F.lit(""))
    parts = []
    for kind, code, least, more in (("llmsTxt", "llms-txt", 100, 8), ("llmsFullTxt", "llms-full-txt", 200, 10)):
        s = state(kind)
        parts.append(ladder((s == "missing", 0, "missing", f"{c}.aux-resource.missing"), (s == "timeout", 8, "timeout", f"{c}.aux-resource.timeout"), (s == "unreachable", 8, "unreachable", f"{c}.aux-resource.unreachable"), (s == "not-html", 10, "info", f"{c}.aux-resource.not-html"), (True, 24, "found", f"{c}.aux-resource.found")))
        parts.append(ladder((s != "ok", 0, "", ""), (X.count_words(body(kind)) >= least, more, "found", f"{c}.{code}.strong"), (True, 0, "info", f"{c}.{code}.short")))
    for kind, code in (("robotsTxt", "robots-txt"), ("sitemapXml", "sitemap")):
        s = state(kind)
        parts.append(ladder((s == "ok", 16, "found", f"{c}.{code}.found"), (s.isin("timeout", "unreachable"), 6, "unreachable", f"{c}.{code}.unreachable"), (True, 0, "missing", f"{c}.{code}.missing")))
    parts.append(ladder((e.negotiates, 0, "found", f"{c}.content-negotiation.found")))
    links = e.page("links")
    parts.append(ladder((F.exists(links, lambda x: F.contains(x["href"], F.lit("llms.txt"))), 10, "found", f"{c}.llms-txt-link.found"), (True, 0, "info", f"{c}.llms-txt-link.missing")))
    markdown = F.exists(links, lambda x: F.contains(x["type"], F.lit("markdown"))) | F.coalesce(e.header("link").rlike(r'(?i)type="?text/markdown"?'), F.lit(False))
    parts.append(ladder((markdown, 10, "found", f"{c}.markdown-endpoint.found"), (True, 0, "info", f"{c}.markdown-endpoint.missing")))
    return Factor(parts)


def eeat_signals(e: Env) -> Factor:
    c, p = "eeat-signals", e.page
    trust = e.keep("trust", F.size(F.filter(p("anchors"), lambda a: F.lower(a["href"]).rlike("/privacy|/terms|/about"))))
    return Factor([
        ladder((F.exists(p("persons"), lambda x: x), 25, "found", f"{c}.author.credentialed"), (F.size(p("persons")) > 0, 12, "info", f"{c}.author.no-credentials"), (True, 0, "missing", f"{c}.author.missing")),
        ladder((p("author") != "", 15, "found", f"{c}.author-meta.found"), (True, 0, "missing", f"{c}.author-meta.missing")),
        ladder((has(p("types"), "Review", "AggregateRating"), 20, "found", f"{c}.review.found"), (True, 0, "info", f"{c}.review.missing")),
        ladder((trust >= 2, 15, "found", f"{c}.trust-links.strong"), (trust == 1, 8, "info", f"{c}.trust-links.partial"), (True, 0, "missing", f"{c}.trust-links.missing")),
        ladder((F.exists(p("orgs"), lambda x: x), 25, "found", f"{c}.organization.with-people"), (F.size(p("orgs")) > 0, 10, "info", f"{c}.organization.no-people"), (True, 0, "missing", f"{c}.organization.missing")),
    ])


def faq_content(e: Env) -> Factor:
    c, p = "faq-content", e.page
    n, asked = p("n_summary"), p("n_summary_question")
    pairs = F.least(p("n_details"), n)
    faq = has(p("types"), "FAQPage")
    applies = faq | e.url.rlike(r"(?i)^[^:]+:/*[^/]*.*/(faqs?|frequently-asked[a-z-]*|questions|help|support)(/|$)") | p("title").rlike(X.ascii_edges(r"(?i)\bfaqs?\b|frequently asked")) | (asked >= 3) | (pairs >= 3)
    return Factor([
        ladder((faq, 34, "found", f"{c}.faqpage.present"), (True, 0, "missing", f"{c}.faqpage.missing")),
        ladder((n >= 3, 24, "found", f"{c}.details.multiple"), (n > 0, 14, "info", f"{c}.details.single"), (True, 0, "info", f"{c}.details.none")),
        ladder((asked >= 3, 24, "found", f"{c}.headings.multiple"), (asked > 0, 12, "info", f"{c}.headings.low"), (True, 0, "missing", f"{c}.headings.missing")),
        ladder((pairs >= 3, 18, "found", f"{c}.qa-pairs.multiple"), (pairs > 0, 10, "info", f"{c}.qa-pairs.low"), (True, 0, "info", f"{c}.qa-pairs.none")),
    ], F.coalesce(applies, F.lit(False)))


def citations(e: Env) -> Factor:
    c, p = "citations", e.page
    own = U.host(e.url)
    out = F.filter(p("anchors"), lambda a: a["host"].isNotNull() & (a["host"] != own))
    n, same = e.keep("outside", F.size(out)), p("same_as")
    gov = F.exists(out, lambda a: a["host"].endswith(".gov") | a["host"].endswith(".edu") | F.contains(a["host"], F.lit("wikipedia.org")))
    named = F.filter(out, lambda a: a["text"] != "")
    words = lambda a: F.size(F.split(a["text"], " "))
    worth = lambda a: F.when(words(a) >= 3, 1.0).when(words(a) == 2, 0.6).otherwise(0.2)
    quality = e.keep("quality", F.coalesce(F.aggregate(named, F.lit(0.0), lambda acc, a: acc + worth(a)) / F.when(F.size(named) > 0, F.size(named)), F.lit(0.0)))
    return Factor([
        ladder((n >= 8, 30, "found", f"{c}.external-links.strong"), (n >= 3, 18, "info", f"{c}.external-links.moderate"), (True, 6, "missing", f"{c}.external-links.low")),
        ladder((gov, 24, "found", f"{c}.authoritative-domains.found"), (True, 8, "info", f"{c}.authoritative-domains.none")),
        ladder((same >= 3, 24, "found", f"{c}.sameas.strong"), (same > 0, 14, "info", f"{c}.sameas.moderate"), (True, 4, "missing", f"{c}.sameas.missing")),
        ladder((quality >= 0.75, 22, "found", f"{c}.anchor-text.strong"), (quality >= 0.45, 12, "info", f"{c}.anchor-text.moderate"), (True, 6, "info", f"{c}.anchor-text.low")),
    ])


def schema_completeness(e: Env) -> Factor:
    p = e.page
    told = lambda x, i: F.element_at(F.split(x, " "), i)
    found = F.transform(F.coalesce(p("completeness_found"), F.array().cast("array<string>")), lambda x: _finding(told(x, 1), F.concat(F.lit("schema-completeness."), told(x, 2))))
    return Factor([several(found)], score=F.coalesce(p("completeness"), F.lit(0.0)))


# Types that a page should declare once.
SINGLETONS = ("FAQPage", "HowTo", "Article", "BlogPosting", "NewsArticle", "BreadcrumbList", "Product", "Recipe")


def schema_validity(e: Env, singletons: tuple[str, ...] = SINGLETONS) -> Factor:
    c, blocks = "schema-validity", e.page("blocks")
    empty, broken = F.size(F.filter(blocks, lambda b: b["empty"])), F.size(F.filter(blocks, lambda b: b["error"].isNotNull()))
    types = F.flatten(F.transform(blocks, lambda b: b["types"]))
    twice = e.keep("twice", sum((F.when(F.size(F.array_compact(F.transform(types, _is(s)))) > 1, 1).otherwise(0) for s in singletons), F.lit(0)))
    raw = F.lit(100.0) - 5 * empty - 15 * broken - 25 * twice
    score = F.when((broken > 0) | (twice > 0), F.least(raw, F.lit(69.0))).otherwise(raw)
    return Factor([
        ladder((F.size(blocks) == 0, 0, "info", f"{c}.json-ld.none"), ((empty == 0) & (broken == 0) & (twice == 0), 0, "found", f"{c}.block.valid")),
        ladder((empty > 0, 0, "missing", f"{c}.block.empty")), ladder((broken > 0, 0, "missing", f"{c}.block.invalid")), ladder((twice > 0, 0, "missing", f"{c}.singleton.duplicate")),
    ], score=F.when(F.size(blocks) == 0, 100.0).otherwise(score))


def _is(value: str) -> Callable[[Column], Column]:
    return lambda t: F.when(t == value, t)


def entity_consistency(e: Env) -> Factor:
    c, p = "entity-consistency", e.page
    first = lambda s: F.element_at(F.split(s, r"[|\-–—]"), 1)
    names = F.concat(F.slice(p("names"), 1, 2), F.array(first(X.normalize_text(p("title"))), first(X.normalize_text(p("og_title")))))
    n = e.keep("names", F.size(F.array_distinct(F.filter(F.transform(names, X.normalize_entity_name), lambda x: x != ""))))
    title = F.length(p("title"))
    score, found = canonical(e)
    low = lambda xs: F.transform(xs, lambda x: F.lower(x))
    emails = F.arrays_overlap(low(p("emails")), low(X.emails(p("text"))))
    phones = F.arrays_overlap(F.transform(p("phones"), X.normalize_text), F.transform(X.phones(p("text")), X.normalize_text))
    return Factor([
        ladder((n == 0, 0, "missing", f"{c}.name.missing"), (n == 1, 40, "found", f"{c}.name.single"), (n == 2, 24, "info", f"{c}.name.moderate"), (True, 12, "missing", f"{c}.name.multiple")),
        ladder((e.identity == "mismatch", 0, "missing", f"{c}.schema-identity.mismatch"), (e.identity == "match", 0, "found", f"{c}.schema-identity.ok")),
        ladder((title == 0, 0, "", ""), (title < 15, 10, "info", f"{c}.title.short"), (title <= 70, 10, "found", f"{c}.title.ok"), (True, 0, "info", f"{c}.title.long")),
        several(found, score),
        ladder((e.keep("contact", emails | phones), 40, "found", f"{c}.contact.ok"), ((F.size(p("emails")) > 0) | (F.size(p("phones")) > 0), 16, "info", f"{c}.contact.partial"), (True, 0, "missing", f"{c}.contact.missing")),
    ])


def content_freshness(e: Env) -> Factor:
    c, p = "content-freshness", e.page
    as_of = e.as_of or datetime.now(UTC).replace(tzinfo=None)
    now = F.lit(as_of).cast("timestamp")
    newest = e.keep("newest", F.array_max(F.transform(p("modified"), X.parse_date)))
    header = e.keep("modified", X.parse_date(e.header("last-modified")))
    sitemap = F.try_element_at(e.aux, F.lit("sitemapXml"))
    state, listed = F.coalesce(sitemap["state"], F.lit("missing")), e.keep("listed", X.parse_date(X.sitemap_lastmod(F.coalesce(sitemap["body"], F.lit("")), e.url)))
    m, mh, ml = (X.months_ago(x, now) for x in (newest, header, listed))
    year = e.keep("year", F.coalesce(X.copyright_year(p("footer")), X.copyright_year(p("text"))))
    return Factor([
        ladder((newest.isNull(), 0, "missing", f"{c}.date-modified.missing"), (m <= 3, 35, "found", f"{c}.date-modified.recent"), (m <= 12, 22, "info", f"{c}.date-modified.moderate"), (True, 10, "info", f"{c}.date-modified.stale")),
        ladder((header.isNull(), 0, "info", f"{c}.last-modified.missing"), (mh <= 3, 20, "found", f"{c}.last-modified.recent"), (True, 12, "info", f"{c}.last-modified.older")),
        ladder((state == "timeout", 8, "timeout", f"{c}.sitemap.timeout"), (state == "unreachable", 8, "unreachable", f"{c}.sitemap.unreachable"), (state != "ok", 0, "missing", f"{c}.sitemap.missing"), (listed.isNull(), 4, "info", f"{c}.sitemap.no-match"), (ml <= 3, 22, "found", f"{c}.sitemap.recent"), (True, 12, "info", f"{c}.sitemap.stale")),
        ladder((year.isNull(), 6, "info", f"{c}.copyright.missing"), (year >= as_of.year - 1, 23, "found", f"{c}.copyright.recent"), (True, 12, "info", f"{c}.copyright.older")),
    ])


def content_extractability(e: Env) -> Factor:
    c, p = "content-extractability", e.page
    ratio = p("text_chars") / F.when(p("html_chars") > 0, p("html_chars"))
    citable = F.size(F.filter(p("paragraph_words"), lambda w: w.between(40, 200)))
    ads, direct = p("n_ads"), p("direct_answers")
    return Factor([
        ladder((p("html_chars") == 0, 0, "", ""), (ratio > 0.3, 25, "found", f"{c}.content-ratio.strong"), (ratio > 0.15, 15, "info", f"{c}.content-ratio.moderate"), (True, 5, "missing", f"{c}.content-ratio.low")),
        ladder((citable >= 5, 25, "found", f"{c}.citable-blocks.strong"), (citable >= 2, 15, "info", f"{c}.citable-blocks.moderate"), (True, 5, "missing", f"{c}.citable-blocks.missing")),
        ladder((p("gate_text") | (p("n_gates") > 0), -20, "missing", f"{c}.paywall.found"), (True, 10, "found", f"{c}.paywall.none")),
        ladder((ads >= 5, -15, "missing", f"{c}.ad-density.high"), (ads > 0, 5, "info", f"{c}.ad-density.low"), (True, 10, "found", f"{c}.ad-density.none")),
        ladder((direct >= 3, 15, "found", f"{c}.direct-answer.strong"), (direct >= 1, 8, "info", f"{c}.direct-answer.moderate"), (True, 0, "info", f"{c}.direct-answer.none")),
    ])


def definition_blocks(e: Env) -> Factor:
    c, p = "definition-blocks", e.page
    n = F.size(F.filter(p("headings"), lambda h: F.lower(h["text"]).rlike("^(what is|how to|why)")))
    steps = F.exists(p("ol_items"), lambda x: x >= 3)
    guide = has(p("types"), "HowTo")
    applies = guide | e.url.rlike(r"(?i)/(guides?|docs?|documentation|glossary|how-to|howto|learn|resources|tutorials?|blog|support)(/|$)") | (n > 0) | (p("n_dl") > 0)
    return Factor([
        ladder((n >= 2, 30, "found", f"{c}.headings.multiple"), (n == 1, 18, "info", f"{c}.headings.single"), (True, 0, "missing", f"{c}.headings.missing")),
        ladder((steps, 24, "found", f"{c}.lists.found"), (True, 0, "info", f"{c}.lists.none")),
        ladder((guide, 26, "found", f"{c}.schema.found"), (True, 0, "missing", f"{c}.schema.missing")),
        ladder((p("n_dl") > 0, 20, "found", f"{c}.dl.found"), (True, 0, "info", f"{c}.dl.none")),
    ], F.coalesce(applies, F.lit(False)))


# Crawlers and their points.
CRAWLERS = {"GPTBot": 18, "ClaudeBot": 18, "PerplexityBot": 18, "OAI-SearchBot": 14, "Google-Extended": 14}


def ai_crawler_access(e: Env) -> Factor:
    c, file = "ai-crawler-access", F.try_element_at(e.aux, F.lit("robotsTxt"))
    state, body = F.coalesce(file["state"], F.lit("none")), F.coalesce(file["body"], F.lit(""))
    read = state == "ok"
    access = e.keep("access", e.robots_access())
    bots = [ladder((~read, 0, "", ""), (access["allowed"][i], points, "found", f"{c}.crawler.allowed"), (True, 0, "missing", f"{c}.crawler.blocked")) for i, points in enumerate(CRAWLERS.values())]
    declared = read & body.rlike(r"(?im)^\s*content-signal\s*:")
    signal = lambda name, value: declared & F.coalesce(F.try_element_at(access["signals"], F.lit(name)) == value, F.lit(False))
    return Factor([
        ladder((read, 0, "", ""), (state == "missing", 80, "info", f"{c}.robots-txt.missing"), (state == "timeout", 30, "timeout", f"{c}.robots-txt.unreachable"), (True, 30, "unreachable", f"{c}.robots-txt.unreachable")), *bots,
        ladder((read & F.contains(F.lower(body), F.lit("sitemap:")), 18, "found", f"{c}.sitemap.found")),
        ladder((declared, 0, "found", f"{c}.content-signal.found")),
        ladder((signal("ai-input", "yes"), 6, "found", f"{c}.content-signal.ai-input-allowed"), (signal("ai-input", "no"), -12, "missing", f"{c}.content-signal.ai-input-blocked")),
        ladder((signal("search", "yes"), 2, "found", f"{c}.content-signal.search-allowed"), (signal("search", "no"), -6, "missing", f"{c}.content-signal.search-blocked")),
        ladder((signal("ai-train", "no"), 0, "info", f"{c}.content-signal.ai-train-blocked")),
    ])


def named_entities(e: Env) -> Factor:
    c, p = "named-entities", e.page
    name = F.coalesce(F.get(p("names"), F.lit(0)), F.trim(F.element_at(F.split(p("title"), r"[|\-–—]"), 1)))
    n = e.keep("brand", F.when(name != "", X.occurrences(p("text"), name)))
    density = e.keep("density", X.proper_noun_density(p("text")))
    return Factor([
        ladder((n.isNull(), 0, "missing", f"{c}.entity-name.missing"), (n >= 3, 36, "found", f"{c}.brand-name.strong"), (n > 0, 20, "info", f"{c}.brand-name.low"), (True, 6, "missing", f"{c}.brand-name.missing")),
        ladder(((p("knows_about") > 0) | (p("founders") > 0), 34, "found", f"{c}.knows-about.present"), (True, 10, "info", f"{c}.knows-about.missing")),
        ladder((density >= 0.08, 30, "found", f"{c}.proper-noun-density.strong"), (density >= 0.04, 18, "info", f"{c}.proper-noun-density.moderate"), (True, 8, "info", f"{c}.proper-noun-density.low")),
    ])


def technical_seo(e: Env) -> Factor:
    c, p, h1 = "technical-seo", e.page, _h(e, 1)
    images = p("images")
    bad = F.filter(images, lambda i: i["alt"].isNull() | (F.trim(i["alt"]) == ""))
    covered = F.floor((F.size(images) - F.size(bad)) / F.when(F.size(images) > 0, F.size(images)) * 30 + 0.5)
    alt = ladder((F.size(images) == 0, 30, "info", f"{c}.alt-text.none"), (F.size(bad) == 0, 30, "found", f"{c}.alt-text.ok"), (F.exists(images, lambda i: i["alt"].isNull()), 0, "missing", f"{c}.alt-text.missing"), (True, 0, "info", f"{c}.alt-text.empty"))
    size = F.length(F.coalesce(p("meta_description"), F.lit("")))
    score, found = canonical(e, c)
    return Factor([
        ladder((h1 == 1, 40, "found", f"{c}.h1.single"), (h1 == 0, 0, "missing", f"{c}.h1.missing"), (True, 20, "info", f"{c}.h1.multiple")),
        several(alt["f"], F.when(F.size(bad) > 0, covered.cast("double")).otherwise(alt["p"])),
        ladder((size == 0, 0, "missing", f"{c}.meta-description.missing"), (size < 120, 8, "info", f"{c}.meta-description.short"), (size > 160, 12, "info", f"{c}.meta-description.long"), (True, 20, "found", f"{c}.meta-description.present")),
        several(found, score / 2),
    ])


def snippet_eligibility(e: Env) -> Factor:
    c = "snippet-eligibility"
    d = e.keep("directives", e.robots_directives())
    some, cap = ~d["none"], d["max_snippet"]
    blocked = d["noindex"] | d["nosnippet"] | (cap == 0)
    tight = cap.between(1, 49)
    asked = [(d["noindex"], "missing", "noindex.present"), (d["nosnippet"], "missing", "nosnippet.present"), (cap == 0, "missing", "max-snippet.zero"), (tight, "info", "max-snippet.low"), (d["noarchive"], "info", "noarchive.present"), (d["noimageindex"], "info", "noimageindex.present")]
    parts = [ladder((some & cond, 0, kind, f"{c}.{code}")) for cond, kind, code in asked]
    free = ~sum((F.coalesce(cond, F.lit(False)).cast("int") for cond, _, _ in asked), F.lit(0)).cast("boolean")
    parts.append(ladder((d["none"], 0, "found", f"{c}.directives.none"), (free, 0, "found", f"{c}.directives.not-restrictive")))
    return Factor(parts, score=F.when(F.coalesce(blocked, F.lit(False)), 0.0).when(F.coalesce(tight, F.lit(False)), 60.0).otherwise(100.0))


def geographic_signals(e: Env) -> Factor:
    c, p = "geographic-signals", e.page
    address = p("text").rlike(X.ascii_edges(r"(?i)\b\d{1,5}\s+[A-Za-z0-9.'\-\s]+,?\s+[A-Za-z.'\-\s]+,?\s+[A-Z]{2}\b"))
    asks = [(has(p("types"), "LocalBusiness") | (F.size(p("business_types")) > 0), 32, "localbusiness-schema"), (p("has_geo"), 22, "geo-coordinates"), (p("has_address"), 18, "postal-address"), (p("has_area"), 14, "area-served"), (p("n_geo_meta") > 0, 8, "geo-meta"), (address, 12, "visible-location")]
    return Factor([ladder((cond, points, "found", f"{c}.{name}.found"), (True, 0, "missing", f"{c}.{name}.missing")) for cond, points, name in asks])


def agent_skill_exposure(e: Env) -> Factor:
    c, p = "agent-skill-exposure", e.page
    names = lambda x: F.split(F.lower(F.coalesce(x["rel"], F.lit(""))), r"\s+")
    rel = lambda *rels: F.exists(p("links"), lambda x: F.arrays_overlap(names(x), F.array(*[F.lit(n) for n in rels])))
    meta = lambda *keys: F.arrays_overlap(p("meta_names"), F.array(*[F.lit(k) for k in keys]))
    told = lambda pattern: F.coalesce(e.header("link").rlike(f'(?i)rel="?({pattern})"?'), F.lit(False))
    href = lambda part: F.exists(p("links"), lambda x: F.contains(x["href"], F.lit(part)))
    described = F.exists(p("links"), lambda x: F.contains(x["type"], F.lit("openapi"))) | rel("service-desc")
    forms = F.filter(p("forms"), lambda f: f["fields"] > 0)
    part = lambda f, k, w: f[k] / f["fields"] * w
    one = lambda f: F.floor(part(f, "labelled", 35.0) + part(f, "autocomplete", 25.0) + part(f, "typed", 15.0) + part(f, "named", 10.0) + F.when(f["has_name"], 10).otherwise(0) + F.when(f["has_submit"], 5).otherwise(0) + 0.5)
    mean = F.aggregate(forms, F.lit(0.0), lambda acc, f: acc + one(f)) / F.when(F.size(forms) > 0, F.size(forms))
    told_forms = ladder((mean >= 80, 0, "found", f"{c}.forms.strong"), (mean >= 40, 0, "info", f"{c}.forms.partial"), (mean >= 0, 0, "missing", f"{c}.forms.weak"), (True, 0, "info", f"{c}.forms.none"))
    return Factor([
        ladder((p("actions_ready") > 0, 35, "found", f"{c}.schema-action.well-formed"), (p("actions") > 0, 18, "info", f"{c}.schema-action.partial"), (True, 0, "missing", f"{c}.schema-action.missing")),
        ladder((rel("mcp", "webmcp", "ai-plugin") | meta("mcp-server", "mcp-server-url", "ai-plugin") | told("mcp|webmcp|ai-plugin"), 20, "found", f"{c}.mcp-discovery.found"), (True, 0, "info", f"{c}.mcp-discovery.missing")),
        ladder((rel("agent-card", "a2a") | href("/.well-known/agent.json") | href("agent-card.json") | meta("agent-card", "a2a-agent-card") | told("agent-card|a2a"), 12, "found", f"{c}.a2a-agent-card.found"), (True, 0, "info", f"{c}.a2a-agent-card.missing")),
        ladder((described, 10, "found", f"{c}.openapi.found"), (True, 0, "info", f"{c}.openapi.missing")),
        ladder(((p("n_itemprop") >= 3) | (p("n_itemtype") >= 1), 10, "found", f"{c}.microdata.found"), (True, 0, "info", f"{c}.microdata.missing")),
        several(told_forms["f"], F.coalesce(F.floor(mean / 100 * 25 + 0.5), F.lit(0)).cast("double")),
    ])


def lighthouse(e: Env) -> Factor:
    """The mean of captured category scores (0 to 1, null where a category has none); psi null: nothing was captured."""
    c = "lighthouse"
    scored = F.filter(e.psi, lambda x: x.isNotNull())
    percent = lambda x: F.floor(100 * x + 0.5)
    mean = F.aggregate(scored, F.lit(0.0), lambda acc, x: acc + percent(x)) / F.when(F.size(scored) > 0, F.size(scored))
    kind = lambda x: F.when(x >= 90, "found").when(x >= 50, "info").otherwise("missing")
    each = F.transform(e.psi, lambda x: F.when(x.isNull(), _finding(F.lit("info"), F.lit(f"{c}.category.missing"))).otherwise(_finding(kind(percent(x)), F.lit(f"{c}.category.score"))))
    return Factor([
        ladder((e.psi.isNull(), 0, "unreachable", f"{c}.psi.unreachable"), (F.size(scored) == 0, 0, "unreachable", f"{c}.category.none")),
        several(F.coalesce(each, F.array().cast(f"array<{FINDING}>"))),
    ], score=F.coalesce(mean, F.lit(0.0)))


BUILDERS: dict[str, Callable[[Env], Factor]] = {k: globals()[k.replace("-", "_")] for k in (*WEIGHTS, *OPTIONAL)}


def chosen(only: list[str] | None = None, optional: tuple[str, ...] = ()) -> dict[str, tuple[str, int]]:
    """Factors in order: the core ones and the optional ones asked for, or just those named. An unknown name is an error."""
    known = WEIGHTS | OPTIONAL
    if unknown := [f for f in only or [] if f not in known]:
        raise ValueError(f"unknown factors {unknown}; there are {list(known)}")
    return {k: v for k, v in known.items() if (k in only if only else k in WEIGHTS or k in optional)}


def factor_array(env: Env, only: list[str] | None = None, optional: tuple[str, ...] = ()) -> Column:
    """array<struct<factor_id, ord, name, weight, score, applicable, findings>> of a page."""
    rows = F.array(*[BUILDERS[key](env).row(key, i, name, weight) for i, (key, (name, weight)) in enumerate(chosen(only, optional).items())])

    def scored(r: Column) -> Column:
        total = F.when(r["scored"], r["own"]).otherwise(F.aggregate(r["parts"], F.lit(0.0), lambda acc, x: acc + x["p"]))
        fixed = [r["fixed"][k].alias(k) for k in ("factor_id", "ord", "name", "weight")]
        return F.struct(*fixed, X.clamp_score(total).alias("score"), r["applicable"].alias("applicable"), F.flatten(F.transform(r["parts"], lambda x: x["f"])).alias("findings"))

    return F.transform(rows, scored)
