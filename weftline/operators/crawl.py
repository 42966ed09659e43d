"""A crawl over captured responses: one superstep a level, results independent of the order of answers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.functions.page import parsed
from weftline.functions.tables import cut
from weftline.operators import robots
from weftline.operators.graph import version_copy, version_pattern
from weftline.sources.site import child_sitemaps, looks_like_sitemap, sitemap_entries

# Floors of the bounds that follow from the number of pages, and ceilings of all.
FLOORS = {"edges": 100_000, "fetches": 5_000, "seconds": 120.0, "bytes": 100 * 1024 * 1024}
MOST_SECONDS = 2_147_483.647
MOST = 2**53 - 1
MOST_WAIT_MS = 10_000
#: Stops that end all fetching; any other only keeps further URLs out.
HARD = ("max-fetches", "max-duration", "max-bytes")


@dataclass(frozen=True)
class Limits:
    """Bounds of a crawl; what isn't given follows from the number of pages."""

    pages: float = 1000
    depth: float = 10
    links_per_page: float = 1000
    query_variants: float = 10
    page_bytes: float = 5 * 1024 * 1024
    sitemap_fanout: float = 1000
    sitemap_urls: float = 50_000
    retries: float = 2
    delay_s: float = 0.0
    fetches: float | None = None
    edges: float | None = None
    seconds: float | None = None
    bytes: float | None = None
    #: Copies after which a pattern of query URLs is left out, unless one of its pages was a page of its own; 0: never.
    skip_versions_after: int = 0

    def resolved(self) -> dict[str, float]:
        """All bounds as they apply: whole numbers of at least one (depth, retries and delay: nought) and within the ceilings; those not given are two fetches a page and try, fifty edges, a second besides the delay, 1.5 MB, and the floors at least."""

        def whole(value: float, standard: float, least: int = 1) -> int:
            return min(MOST, max(least, math.floor(value))) if math.isfinite(value) else int(standard)

        pages, tries = whole(self.pages, 1000), 1 + whole(self.retries, 2, 0)
        delay = max(0.0, self.delay_s) if math.isfinite(self.delay_s) else 0.0
        derived = {"edges": pages * 50, "fetches": pages * 2 * tries, "seconds": pages * (1 + delay), "bytes": pages * 1_500_000}
        out: dict[str, float] = {"pages": pages, "retries": tries - 1}
        for name, value in derived.items():
            told = getattr(self, name)
            ceiling = MOST_SECONDS if name == "seconds" else MOST
            out[name] = min(ceiling, max(1, math.floor(told))) if told is not None and math.isfinite(told) else min(ceiling, max(FLOORS[name], value))
        standard = Limits
        return out | {
            "depth": whole(self.depth, standard.depth, 0), "links_per_page": whole(self.links_per_page, standard.links_per_page), "query_variants": whole(self.query_variants, standard.query_variants),
            "page_bytes": whole(self.page_bytes, standard.page_bytes), "sitemap_fanout": whole(self.sitemap_fanout, standard.sitemap_fanout), "sitemap_urls": whole(self.sitemap_urls, standard.sitemap_urls),
        }


@dataclass
class Crawl:
    pages: DataFrame
    edges: DataFrame
    levels: list[int] = field(default_factory=list)
    used: dict[str, float] = field(default_factory=lambda: {"fetches": 0, "bytes": 0, "seconds": 0.0, "edges": 0})
    #: URLs left out as versions of other pages, with their pattern.
    skipped: DataFrame | None = None
    hard: str | None = None
    soft: str | None = None

    @property
    def stopped(self) -> str | None:
        """Why the crawl ended early: the first hard stop, else the first soft one."""
        return self.hard or self.soft

    def stop(self, reason: str) -> None:
        if reason in HARD:
            self.hard = self.hard or reason
        else:
            self.soft = self.soft or reason


PAGE = "url string, depth int, state string, status int, location string, canonical string, meta_robots array<string>, x_robots array<string>, error_code string"
EDGE = "`from` string, `to` string, type string, ord int, text string, nofollow boolean, placement string, internal boolean"


def retry_after(header: Column, standard_ms: Column) -> Column:
    """Milliseconds to wait before another try: what a Retry-After header says in seconds, MOST_WAIT_MS at most; a date, or none, is the standard."""
    seconds = F.try_to_number(F.trim(header), F.lit("999999999")).cast("double")
    return F.when(F.trim(header).rlike(r"^[0-9]{1,9}$"), F.least(seconds * 1000, F.lit(float(MOST_WAIT_MS)))).otherwise(standard_ms.cast("double"))


def transient(error_code: Column) -> Column:
    """Whether a failure says nothing about the URL, so that another try may succeed."""
    return F.coalesce(F.upper(error_code).isin("TIMEOUT", "UNREACHABLE"), F.lit(False))


def sitemap_seeds(docs: DataFrame, starts: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, str | None]:  # noqa: B008
    """docs (sitemap_url, body), starts (sitemap_url) -> (url, sitemap_url) of all entries of the sitemaps reached from starts through indexes, and the stop that cut them short.

    A round joins the queue with the documents; an index's members by its order, sitemap_fanout at most, are the next
    queue but for those handled before. No more than sitemap_urls different URLs count, by sitemap and then URL.
    """
    most, stopped = limits.resolved(), None
    docs = docs.where(looks_like_sitemap(F.col("body")))
    queue = cut(starts.select("sitemap_url").distinct())
    handled = queue
    while queue.head(1):
        members = child_sitemaps(docs.join(queue, "sitemap_url", "left_semi"))
        if members.where(F.col("ord") >= most["sitemap_fanout"]).head(1):
            stopped = stopped or "max-sitemap-fanout"
        named = members.where(F.col("ord") < most["sitemap_fanout"]).select(F.col("loc").alias("sitemap_url")).distinct()
        queue = cut(named.join(handled, "sitemap_url", "left_anti"))
        handled = cut(handled.union(queue))
    rows = sitemap_entries(docs.join(handled, "sitemap_url", "left_semi")).select(U.crawl_key_of(F.col("loc")).alias("url"), "sitemap_url").where("url is not null").distinct()
    first = cut(rows.groupBy("url").agg(F.min("sitemap_url").alias("sitemap_url")))
    if first.count() > most["sitemap_urls"]:
        stopped = stopped or "max-sitemap-urls"
        rows = rows.join(first.orderBy("sitemap_url", "url").limit(int(most["sitemap_urls"])).select("url"), "url", "left_semi")
    return rows, stopped


def _within(got: DataFrame, out: Crawl, most: dict[str, float]) -> DataFrame:
    """The rows of a level that the budgets of fetches, bytes and seconds allow, by URL; the others become `discovered`, and the stop is noted."""
    costs = {"fetches": "_tries", "bytes": "_bytes", "seconds": "_seconds"}
    total = got.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in costs.items()]).first().asDict()
    if all(out.used[k] + total[k] <= most[k] for k in costs):
        for k in costs:
            out.used[k] += total[k]
        return got.withColumn("_over", F.lit(False))
    # Only now is the order of a level's rows needed, and only of their costs: no more rows than the limit of pages.
    order = Window.orderBy("url")
    sums = got.select("url", *[F.sum(c).over(order).alias(k) for k, c in costs.items()])
    beyond = {k: F.col(k) > most[k] - out.used[k] for k in costs}
    first = sums.where(beyond["fetches"] | beyond["bytes"] | beyond["seconds"]).orderBy("url").limit(1)
    at = first.select("url", *[v.alias(k) for k, v in beyond.items()]).first()
    held = got.where(F.col("url") < at.url).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in costs.items()]).first().asDict()
    for k in costs:
        out.used[k] += held[k]
    out.stop("max-duration" if at.seconds else "max-fetches" if at.fetches else "max-bytes")
    return got.withColumn("_over", F.col("url") >= at.url)


def crawl(responses: DataFrame, roots: DataFrame, files: DataFrame | None = None, agent: str = "weftline", limits: Limits = Limits(), seeds: DataFrame | None = None, local: tuple[str, ...] = ()) -> Crawl:  # noqa: B008
    """responses (url, status, location, content_type, headers, body, error_code[, attempts, seconds]), url a crawl key; roots (url); robots files (site, body), site scheme and host; seeds (url): pages that sitemaps list.

    Each level joins the frontier with the responses, classifies them, and admits the links that weren't seen, in order of
    URL, until a limit: a barrier a level, so nothing depends on which answer came first. Links out of the roots' hosts are
    edges only; roots at local or private addresses are errors unless their host is in `local`. States: html, non-html, redirect, error, robots-blocked, and discovered for pages that no budget was left for
    or that lie too deep. Patterns of query URLs whose pages are all copies of others are learned between levels, and
    unlearned, with what they left out admitted again, once one of their pages is a page of its own.
    """
    spark, most = responses.sparkSession, limits.resolved()
    told = cut(roots.select(U.crawl_key_of(F.col("url")).alias("url")).where("url is not null").distinct().withColumn("blocked", U.blocked_target(F.col("url"), local)))
    start = told.where("not blocked").select("url")
    hosts = cut(start.select(U.scheme_host(F.col("url")).alias("site")).distinct())
    first = start.withColumn("seed", F.lit(0))
    listed = None
    if seeds is not None:
        listed = cut(seeds.select(U.crawl_key_of(F.col("url")).alias("url")).where("url is not null").distinct())
        own = listed.withColumn("site", U.scheme_host(F.col("url"))).join(hosts, "site", "left_semi").select("url").join(start, "url", "left_anti")
        first = first.unionByName(own.withColumn("seed", F.lit(1)))
    refused = told.where("blocked").select("url", F.lit(0).alias("depth"), F.lit("error").alias("state"), *[F.lit(None).cast(t).alias(c) for c, t in (("status", "int"), ("location", "string"), ("canonical", "string"), ("meta_robots", "array<string>"), ("x_robots", "array<string>"))], F.lit("BLOCKED_HOST").alias("error_code"))
    told = cut(first)
    out = Crawl(spark.createDataFrame([], PAGE).unionByName(refused), spark.createDataFrame([], EDGE))
    if told.count() > most["pages"]:
        out.stop("max-pages")
    frontier = cut(told.orderBy("seed", "url").limit(int(most["pages"])).select("url", F.lit(0).alias("depth")))
    never = cut(told.select("url"))  # roots and listed pages are never left out as versions
    seen, rules = frontier.select("url"), cut(robots.crawl_rules(files, agent)) if files is not None else None
    patterns = skipped = None
    count, depth, admitted = frontier.count(), 0, 0
    has = set(responses.columns)
    while count:
        out.levels.append(count)
        admitted += count
        allowed = F.lit(True)
        got = frontier.join(responses, "url", "left")
        if rules is not None:
            target = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
            access = robots.crawl_access(frontier.select("url", U.scheme_host(F.col("url")).alias("site"), target.alias("target")), rules)
            got, allowed = got.join(access, "url"), F.col("allowed")
        cost = lambda c: F.when(allowed, c).otherwise(0)  # noqa: B023, E731
        got = got.withColumns({"_tries": cost(F.coalesce("attempts", F.lit(1)) if "attempts" in has else F.lit(1)), "_bytes": cost(F.coalesce(F.octet_length("body"), F.lit(0))), "_seconds": cost(F.coalesce("seconds", F.lit(0.0)) if "seconds" in has else F.lit(0.0))})
        got = _within(got, out, most)
        moved = F.col("status").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull()
        markup = F.lower(F.coalesce("content_type", F.lit(""))).rlike("html")
        large = F.col("_bytes") > most["page_bytes"]
        state = F.when(~allowed, "robots-blocked").when(F.col("_over"), "discovered").when(F.col("status").isNull() | (F.col("status") >= 400) | large, "error").when(moved, "redirect").when(markup, "html").otherwise("non-html")
        got = got.withColumn("state", state).withColumn("html", F.when(F.col("state") == "html", F.col("body")))
        got = got.withColumn("error_code", F.when(large, "BODY_TOO_LARGE").otherwise(F.col("error_code"))).withColumn("status", F.when(large | (F.col("state") == "discovered"), F.lit(None).cast("int")).otherwise(F.col("status")))
        read = parsed(got.select("url", "depth", "state", "status", "location", "headers", "error_code", "html"))
        header = F.try_element_at(F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)), F.lit("x-robots-tag"))
        meta, other = robots.tokens_of(F.get("page.robots", F.lit(0))), robots.tokens_of(header)
        accepted = F.when(F.size("page.canonical.urls") == 1, F.get("page.canonical.urls", F.lit(0)))
        canonical = F.coalesce(accepted, F.col("page.first_canonical"))
        rows = cut(read.select("url", "depth", "state", "status", "location", canonical.alias("canonical"), accepted.alias("_accepted"), meta.alias("meta_robots"), other.alias("x_robots"), "error_code", F.slice("page.anchors", 1, int(most["links_per_page"])).alias("anchors"), (F.size("page.anchors") > most["links_per_page"]).alias("_more")))
        if rows.where("_more").head(1):
            out.stop("max-links-per-page")
        off = F.arrays_overlap(F.concat("meta_robots", "x_robots"), F.array(F.lit("nofollow"), F.lit("none")))
        links = rows.where("state = 'html'").select("url", off.alias("off"), F.explode("anchors").alias("a")).where("a.key is not null")
        anchors = links.select(F.col("url").alias("from"), F.col("a.key").alias("to"), F.lit("anchor").alias("type"), "a.ord", "a.text", (F.col("a.nofollow") | F.col("off")).alias("nofollow"), "a.placement", "a.internal")
        hops = rows.where("state = 'redirect'").select(F.col("url").alias("from"), U.crawl_key_of(F.col("location")).alias("to"), F.lit("redirect").alias("type"), F.lit(0).alias("ord"), F.lit("").alias("text"), F.lit(False).alias("nofollow"), F.lit("unknown").alias("placement"), (U.scheme_host(F.col("location")) == U.scheme_host(F.col("url"))).alias("internal"))
        fresh = cut(anchors.unionByName(hops.where("to is not null")))
        n, left = fresh.count(), int(most["edges"] - out.used["edges"])
        if n > left:
            out.stop("max-edges")
            fresh = cut(fresh.orderBy("from", "type", "ord").limit(left))
        out.used["edges"] += min(n, left)
        out.pages, out.edges = out.pages.unionByName(rows.select(out.pages.columns)), out.edges.unionByName(fresh)
        if out.hard:
            break
        depth += 1
        new = fresh.where("not nofollow").select(F.col("to").alias("url"), U.scheme_host(F.col("to")).alias("site")).join(hosts, "site", "left_semi").select("url").distinct().join(seen, "url", "left_anti")
        if limits.skip_versions_after:
            own = rows.where("state = 'html'").select(version_pattern(F.col("url")).alias("pattern"), F.coalesce(version_copy(F.col("url"), U.crawl_key_of(F.col("_accepted"))), F.lit(False)).alias("copy")).where("pattern is not null")
            level = own.groupBy("pattern").agg(F.count_if("copy").alias("copies"), F.count_if(~F.col("copy")).alias("other"))
            patterns = cut((level if patterns is None else patterns.unionByName(level)).groupBy("pattern").agg(F.sum("copies").alias("copies"), F.sum("other").alias("other")))
            out_now = patterns.where((F.col("other") == 0) & (F.col("copies") >= limits.skip_versions_after)).select("pattern")
            new = new.withColumn("pattern", version_pattern(F.col("url")))
            new = cut(new if skipped is None else new.unionByName(skipped).distinct())
            held = new.join(out_now, "pattern", "left_semi").join(never, "url", "left_anti")
            skipped = cut(held.select("url", "pattern"))
            new = new.select("url").join(skipped.select("url"), "url", "left_anti")
        new = _variants(new, seen, out, most)
        if depth > most["depth"]:
            deep = cut(new)
            if deep.head(1):
                out.stop("max-depth")
                empty = F.array().cast("array<string>")
                nulls = [F.lit(None).cast(t).alias(c) for c, t in (("status", "int"), ("location", "string"), ("canonical", "string"))]
                out.pages = out.pages.unionByName(deep.select("url", F.lit(depth).alias("depth"), F.lit("discovered").alias("state"), *nulls, empty.alias("meta_robots"), empty.alias("x_robots"), F.lit(None).cast("string").alias("error_code")))
            break
        room = int(most["pages"]) - admitted
        new = cut(new)
        if new.count() > room:
            out.stop("max-pages")
        if room <= 0:
            break
        frontier = cut(new.orderBy("url").limit(room).withColumn("depth", F.lit(depth)))
        seen, count = cut(seen.union(frontier.select("url"))), frontier.count()
    out.skipped = skipped
    return out


def _variants(new: DataFrame, seen: DataFrame, out: Crawl, most: dict[str, float]) -> DataFrame:
    """The new URLs without those that would give a path more queries than query_variants, the first by URL staying."""
    base = F.substring_index("url", "?", 1)
    known = seen.select(base.alias("base")).groupBy("base").agg(F.count(F.lit(1)).alias("known"))
    rows = cut(new.select("url", base.alias("base")).join(known, "base", "left").withColumn("known", F.coalesce("known", F.lit(0))))
    wide = rows.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known")).where(F.col("n") + F.col("known") > most["query_variants"])
    if not wide.head(1):
        return rows.select("url")
    out.stop("max-query-variants")
    place = F.row_number().over(Window.partitionBy("base").orderBy("url"))
    return rows.withColumn("place", place).where(F.col("place") + F.col("known") <= most["query_variants"]).select("url")


def provenance(pages: DataFrame, edges: DataFrame, sitemaps: DataFrame | None = None) -> DataFrame:
    """url, kind (link or sitemap), source: a row for each URL a page was discovered from and each sitemap that lists it."""
    out = edges.select(F.col("to").alias("url"), F.lit("link").alias("kind"), F.col("from").alias("source"))
    if sitemaps is not None:
        out = out.unionByName(sitemaps.select(U.crawl_key_of(F.col("loc")).alias("url"), F.lit("sitemap").alias("kind"), F.col("sitemap_url").alias("source")))
    return out.distinct().join(pages.select("url").distinct(), "url", "left_semi")


def factor_means(factors: DataFrame) -> DataFrame:
    """factors (factor_id, score) of a crawl's audits -> factor_id, pages, mean score with two decimals."""
    return factors.groupBy("factor_id").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("score"), 2).alias("avg_score"))


def metadata_pages(pages: DataFrame) -> DataFrame:
    """pages (state, meta_robots, x_robots, url, canonical, ...): the HTML pages that may be indexed, whose titles and descriptions count in comparisons."""
    ok = robots.indexability(F.col("state"), F.col("meta_robots"), F.col("x_robots"), F.col("url"), F.col("canonical"))
    return pages.where(ok["state"] == "indexable")
