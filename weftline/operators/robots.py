"""robots.txt: rules, the two ways to match them, and robots directives of pages.

Groups are read with window functions over a file's lines, so any number of files is one plan; page factors that hold
the file in a column use the same steps as array expressions. The audit's matcher takes the group that names the agent,
else *, and plain prefixes; the crawl's matcher takes agents contained in the crawler's name, * and $. The longest rule
wins, allow on a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_signal


def lines_of(files: DataFrame) -> DataFrame:
    """files (site, body) -> (site, ord, key, value) of the lines with a colon, without comments."""
    rows = files.select("site", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("ord", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    return rows.where(F.contains(line, F.lit(":"))).select("site", "ord", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("key"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value"))


def groups_of(lines: DataFrame, closers: tuple[str, ...]) -> DataFrame:
    """Adds `grp`: a user-agent line that doesn't follow one directly (closers between) begins a group; lines before any have none."""
    told = lines.where(F.col("key").isin("user-agent", *closers))
    order = Window.partitionBy("site").orderBy("ord")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    return told.withColumn("grp", F.sum(begins.cast("int")).over(order)).where("grp > 0")


def audit_rules(files: DataFrame) -> DataFrame:
    """(site, agent, allow, path, grp): the rules of each agent's first group."""
    told = groups_of(lines_of(files), ("allow", "disallow", "content-signal"))
    agents = told.where("key = 'user-agent'").groupBy("site", F.lower("value").alias("agent")).agg(F.min("grp").alias("grp"))
    rules = told.where("key in ('allow', 'disallow')").select("site", "grp", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules.where("allow or path <> ''"), ["site", "grp"], "left")


def audit_access(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """pages (page_id, site, path) -> page_id, allowed: a prefix join of paths with the rules of the agent's group, then the longest."""
    own = rules.where(F.col("agent") == agent.lower())
    named = own.select("site").distinct()
    rest = rules.where("agent = '*'").join(named, "site", "left_anti")
    chosen = own.unionByName(rest).select("site", "allow", F.col("path").alias("rule")).where("rule is not null")
    hit = pages.join(chosen, "site").where(F.startswith("path", "rule"))
    best = hit.groupBy("page_id").agg(F.max_by("allow", F.struct(F.length("rule"), F.col("allow").cast("int"))).alias("allowed"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", F.coalesce("allowed", F.lit(True)).alias("allowed"))


def crawl_rules(files: DataFrame, agent: str) -> DataFrame:
    """(site, allow, value, pattern): rules of all groups that name a part of the agent's name, else of those for *; pattern is a regular expression."""
    told = groups_of(lines_of(files).where("not (key in ('allow', 'disallow') and value = '')"), ("allow", "disallow", "crawl-delay"))
    agents = told.where("key = 'user-agent'").select("site", "grp", F.lower("value").alias("agent")).distinct()
    own = agents.where((F.col("agent") != "") & (F.col("agent") != "*") & F.contains(F.lit(agent.lower()), F.col("agent"))).select("site", "grp").distinct()
    star = agents.where("agent = '*'").select("site", "grp").distinct().join(own.select("site").distinct(), "site", "left_anti")
    rules = told.where("key in ('allow', 'disallow')").join(own.union(star), ["site", "grp"])
    end = F.endswith("value", F.lit("$"))
    plain = F.when(end, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    pattern = F.concat(F.lit(r"^\Q"), F.replace(plain, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"), F.when(end, "$").otherwise(""))
    return rules.select("site", (F.col("key") == "allow").alias("allow"), "value", pattern.alias("pattern"))


def crawl_access(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, site, target), target being path and query -> url, allowed."""
    hit = urls.join(rules, "site").where(F.expr("rlike(target, pattern)"))
    best = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("value"), F.col("allow").cast("int"))).alias("allowed"))
    return urls.select("url").join(best, "url", "left").select("url", F.coalesce("allowed", F.lit(True)).alias("allowed"))


def _parsed(body: Column) -> Column:
    """A file's lines as array<struct<k, v, g>>, g counting groups as groups_of does."""
    line = lambda s: F.trim(F.regexp_replace(s, "#.*$", ""))
    split = F.filter(F.split(body, r"\r?\n"), lambda s: F.contains(line(s), F.lit(":")))
    pairs = F.transform(split, lambda s: F.struct(F.lower(F.trim(F.substring_index(line(s), ":", 1))).alias("k"), F.trim(F.regexp_replace(line(s), "^[^:]*:", "")).alias("v")))
    told = F.filter(pairs, lambda p: p["k"].isin("user-agent", "allow", "disallow", "content-signal"))
    kind = "array<struct<k:string,v:string,g:int>>"

    def step(acc: Column, p: Column) -> Column:
        g = acc["g"] + F.when((p["k"] == "user-agent") & (acc["last"] != "user-agent"), 1).otherwise(0)
        return F.struct(F.concat(acc["out"], F.array(F.struct(p["k"].alias("k"), p["v"].alias("v"), g.alias("g")))).alias("out"), g.alias("g"), p["k"].alias("last"))

    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("g"), F.lit("").alias("last"))
    return F.filter(F.aggregate(told, start, step, lambda acc: acc["out"]), lambda p: p["g"] > 0)


def audit_access_of(body: Column, agents: list[str], at: Column) -> Column:
    """struct<allowed: array<boolean> by agent, signals: map>: the audit's matcher for path `at` over a file held in a column, and the Content-Signal map in force: of the first group for * that declares any, else of the first group that does. The file is parsed once."""

    def decide(rows: Column) -> Column:
        names = F.filter(rows, lambda p: p["k"] == "user-agent")
        rules = F.filter(rows, lambda p: (p["k"] == "allow") | (p["k"] == "disallow") & (p["v"] != ""))
        hits = F.transform(F.filter(rules, lambda p: F.startswith(at, p["v"])), lambda p: F.struct(p["g"].alias("g"), F.length(p["v"]).alias("n"), (p["k"] == "allow").alias("allow")))
        own = F.filter(rows, lambda p: (p["k"] == "content-signal") & (F.size(content_signal(p["v"])) > 0))
        return F.struct(names.alias("names"), hits.alias("hits"), own.alias("signals"))

    def first(told: Column, name: Column) -> Column:
        return F.array_min(F.transform(F.filter(told["names"], lambda p: F.lower(p["v"]) == name), lambda p: p["g"]))

    def answer(told: Column) -> Column:
        star = first(told, F.lit("*"))

        def allowed(name: Column) -> Column:
            best = F.array_max(F.transform(F.filter(told["hits"], lambda h: h["g"] == F.coalesce(first(told, name), star)), lambda h: F.struct(h["n"], h["allow"])))
            return F.coalesce(best["allow"], F.lit(True))

        groups = F.transform(told["signals"], lambda p: p["g"])
        stars = F.transform(F.filter(told["names"], lambda p: p["v"] == "*"), lambda p: p["g"])
        group = F.coalesce(F.array_min(F.array_intersect(groups, stars)), F.array_min(groups))
        text = F.array_join(F.transform(F.filter(told["signals"], lambda p: p["g"] == group), lambda p: p["v"]), ",")
        return F.struct(F.transform(F.array(*[F.lit(a.lower()) for a in agents]), allowed).alias("allowed"), content_signal(text).alias("signals"))

    return F.transform(F.transform(F.array(_parsed(body)), decide), answer)[0]


def directives(metas: Column, header: Column) -> Column:
    """Merged robots directives of meta elements and the X-Robots-Tag header (its lines for Google's bots or for all)."""
    lines = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), r"\r?\n"), lambda t: F.trim(t)), lambda s: s != "")
    agent = r"^([a-zA-Z][a-zA-Z0-9-]*)\s*:\s*(.+)$"
    named = lambda s: F.lower(F.regexp_extract(s, agent, 1))
    ours = F.filter(lines, lambda s: (named(s) == "") | (named(s) == "googlebot") | F.startswith(named(s), F.lit("googlebot-")))
    values = F.transform(ours, lambda s: F.when(named(s) == "", s).otherwise(F.regexp_extract(s, agent, 2)))
    sources = F.concat(F.coalesce(metas, F.array().cast("array<string>")), values)
    tokens = F.flatten(F.transform(sources, lambda s: F.transform(F.split(F.lower(s), ","), lambda t: F.trim(t))))
    caps = F.transform(F.filter(tokens, lambda t: t.rlike(r"^max-snippet:\s*[+-]?\d")), lambda t: F.regexp_extract(t, r"^max-snippet:\s*([+-]?\d+)", 1).cast("int"))
    cap = F.coalesce(F.array_min(F.filter(caps, lambda x: x != -1)), F.array_min(caps))
    has = lambda *names: F.arrays_overlap(tokens, F.array(*[F.lit(n) for n in names]))
    return F.struct((F.size(sources) == 0).alias("none"), has("noindex", "none").alias("noindex"), has("nosnippet").alias("nosnippet"), has("noarchive").alias("noarchive"), has("noimageindex").alias("noimageindex"), cap.alias("max_snippet"))


def tokens_of(value: Column) -> Column:
    """Sorted directive tokens of a robots value."""
    return F.array_sort(F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), r"[,\s]+"), lambda t: t != ""))


def indexability(state: Column, meta: Column, header: Column, url: Column, canonical: Column) -> Column:
    """struct<state, reasons>: blocked, redirect, noindex, another canonical, html, in this order."""
    off = lambda t: F.arrays_overlap(t, F.array(F.lit("noindex"), F.lit("none")))
    row = lambda s, *r: F.struct(F.lit(s).alias("state"), F.array(*[F.lit(x) for x in r]).cast("array<string>").alias("reasons"))
    reasons = F.array_compact(F.array(F.when(off(meta), "meta-robots-noindex"), F.when(off(header), "x-robots-noindex")))
    return (
        F.when(state == "robots-blocked", row("blocked", "robots-disallow"))
        .when(state == "redirect", row("unknown", "redirect-terminal"))
        .when(off(meta) | off(header), F.struct(F.lit("noindex").alias("state"), reasons.alias("reasons")))
        .when((state == "html") & (canonical != url), row("unknown", "canonical-to-other"))
        .when(state == "html", row("indexable"))
        .otherwise(row("unknown", "not-html-or-unavailable"))
    )
