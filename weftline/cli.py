"""Command line: audits of a folder or a table of pages, crawls over captured responses, platform detection, and comparison of two runs."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import sinks
from weftline.functions import urls as U
from weftline.functions.page import parsed
from weftline.functions.tables import cut
from weftline.operators import compare, crawl, entities, identity, platforms, rollup, scoring, templates
from weftline.operators.factors import Env
from weftline.plans.audit import factor_results, page_audits, with_files, with_targets
from weftline.sources import site


def wanted_paths(args: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    """The paths asked for, by name, by changed source files, and the critical ones with those; None: all."""
    named = [(p,) for p in (args.include or "").split(",") if p.strip()]
    if args.changed:
        routes = site.changed_routes(spark.read.text(args.changed).select(F.col("value").alias("path"))).select(F.col("route").alias("wanted"))
        named += [(p,) for p in (args.critical or "").split(",") if p.strip()]
        rows = routes.unionByName(spark.createDataFrame(named, "wanted string"))
    elif named:
        rows = spark.createDataFrame(named, "wanted string")
    else:
        return None
    return rows.select(U.route_path(F.col("wanted")).alias("wanted")).distinct()


def _pages(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """page_id, url, html, and headers, priority and psi where the table has them."""
    if args.base_url:
        pages = site.static_pages(spark, args.input, args.base_url)
    else:
        pages = spark.read.parquet(args.input)
        pages = pages.select("page_id", "url", "html", *[c for c in ("headers", "priority", "psi") if c in pages.columns])
    if args.url:
        pages = pages.where(U.page_key(F.col("url")) == U.page_key(F.lit(args.url)))
    wanted = wanted_paths(args, spark)
    if wanted is not None:
        pages = pages.withColumn("wanted", U.route_path(F.col("url"))).join(wanted, "wanted", "left_semi").drop("wanted")
    if args.sitemap:
        entries = site.resolved_sitemap(spark.read.parquet(args.sitemap_docs), args.sitemap)
        listed = entries.groupBy(U.page_key(F.col("loc")).alias("_key")).agg(F.min_by(F.struct("priority"), F.struct("member", "ord")).alias("x")).select("_key", "x.priority")
        pages = pages.drop("priority").withColumn("_key", U.page_key(F.col("url"))).join(listed, "_key").drop("_key").where(~U.skipped(F.col("url")))
    if args.skip_files:
        pages = pages.where(~U.skipped(F.col("url")))
    if args.limit:
        shaped = templates.shapes(pages.select(F.col("page_id").alias("ord"), "url", *["priority"] * ("priority" in pages.columns)))
        rank = (-F.coalesce("priority", F.lit(site.PRIORITY)),) if "priority" in pages.columns else ()
        chosen = templates.sample(shaped, args.limit, rank=rank)
        pages = pages.join(chosen.select(F.col("ord").alias("page_id")), "page_id", "left_semi")
    return pages


def inputs(spark: SparkSession, args: argparse.Namespace, pages: DataFrame) -> tuple[DataFrame, Env]:
    """Parsed pages, joined with the files, targets, scores and mentions that were given, and an Env that reads them."""
    env = Env(as_of=datetime.fromisoformat(args.as_of) if args.as_of else None)
    pages = identity.with_identity(pages)
    env = replace(env, identity=F.col("identity.status"))
    if "headers" in pages.columns:
        env = replace(env, headers=F.col("headers"))
    if "psi" in pages.columns:
        env = replace(env, psi=F.col("psi"))
    if args.files or args.base_url:
        files = spark.read.parquet(args.files) if args.files else site.disk_files(spark, args.input, args.base_url)
        pages, env = with_files(pages, files, env)
    got = cut(parsed(pages))
    if args.targets:
        got, env = with_targets(got, spark.read.parquet(args.targets), env)
    if args.entities:
        names, matchers = entities.registry(spark, site.entity_registry(Path(args.entities).read_text()))
        owners = entities.owners(got.select("page_id", "url"), matchers)
        found = entities.mentions(entities.scanned(got).join(owners, "page_id"), names).select("page_id", F.lit(True).alias("names_another")).distinct()
        got, env = got.join(found, "page_id", "left"), replace(env, names_another=F.coalesce("names_another", F.lit(False)))
    return got, env


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        pages = _pages(spark, args)
        got, env = inputs(spark, args, pages)
    except Exception as e:
        return sinks.failed("BAD_INPUT", str(e))
    optional = tuple(n for n, on in (("geographic-signals", args.geo), ("agent-skill-exposure", args.agent_skills), ("lighthouse", args.lighthouse)) if on)
    audits = cut(page_audits(got, env, only=args.factors.split(",") if args.factors else None, optional=optional, already_parsed=True).drop("page"))
    return report(spark, args, audits, pages.select("url", "priority") if "priority" in pages.columns else None)


def report(spark: SparkSession, args: argparse.Namespace, audits: DataFrame, priorities: DataFrame | None = None) -> int:
    if args.out:
        sinks.to_json(audits, args.out)
    score = scoring.site_score(audits).first()[0]
    rows = factor_results(audits)
    issues, bad = rollup.cross_cutting(rows), rollup.defect_pages(audits, priorities)
    defects = rollup.defect_groups(bad)
    counts = audits.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "success").alias("failed")).first()
    units = templates.shapes(audits.select("url").distinct()).select("url", "template")
    fixes = rollup.fixes(issues, rollup.recommendations(rows), defects, bad, units, counts.n).orderBy("priority")
    collected = [[r.asDict() for r in df.collect()] for df in (fixes, issues.orderBy("rank"), defects.orderBy("rank"))]  # a row for each factor or kind of defect
    print(sinks.site_report(score, {"pages_audited": counts.n, "pages_failed": counts.failed, "pages_discovered": counts.n, "confidence": "full"}, *collected, style=args.format))
    if args.outputs:
        sinks.ci_outputs(args.outputs, {"score": score, "passed": sinks.passes(score), "pages": counts.n, "failed": counts.failed})
    if args.require_meta:
        lacking = rows.where((F.col("factor_id") == "technical-seo") & F.exists("findings", lambda f: f["code"] == "technical-seo.meta-description.missing"))
        if n := lacking.count():
            print(f"{n} pages have no meta description, among them {', '.join(r.url for r in lacking.orderBy('url').limit(3).collect())}", file=sys.stderr)
            return 1
    return sinks.exit_code(score)


def follow(spark: SparkSession, args: argparse.Namespace) -> int:
    """Crawls captured responses from the roots and audits the HTML pages that may be indexed."""
    responses = spark.read.parquet(args.input)
    roots = spark.createDataFrame([(u,) for u in args.roots.split(",")], "url string")
    files = spark.read.parquet(args.robots) if args.robots else None
    limits = crawl.Limits(pages=args.pages, depth=args.depth, skip_versions_after=args.skip_versions_after)
    seeds, cut_short = None, None
    if args.sitemaps:
        docs = spark.read.parquet(args.sitemaps)
        starts = roots.select(U.scheme_host(F.col("url")).alias("site")).select(F.explode(F.array(F.concat("site", F.lit("/sitemap.xml")), F.concat("site", F.lit("/sitemap-index.xml")))).alias("sitemap_url"))
        if files is not None:
            starts = starts.unionByName(site.directive_sitemaps(files).select("sitemap_url"))
        seeds, cut_short = crawl.sitemap_seeds(docs, starts, limits)
    got = crawl.crawl(responses, roots, files, limits=limits, seeds=seeds)
    chosen = crawl.metadata_pages(got.pages.where("state = 'html'")).select("url")
    pages = responses.join(chosen, "url", "left_semi").select(F.xxhash64("url").alias("page_id"), "url", F.col("body").alias("html"), "headers")
    env = Env(headers=F.col("headers"), as_of=datetime.fromisoformat(args.as_of) if args.as_of else None)
    audits = cut(page_audits(pages, env).drop("page"))
    states = {r.state: r["count"] for r in got.pages.groupBy("state").count().collect()}
    print(json.dumps({"stopped": got.stopped or cut_short, "levels": got.levels, "states": states, "used": got.used}, sort_keys=True))
    return report(spark, args, audits)


def detect(spark: SparkSession, args: argparse.Namespace) -> int:
    pages = _pages(spark, args)
    read = parsed(pages, drop_html=False)
    read = read if "headers" in read.columns else read.withColumn("headers", F.lit(None).cast("map<string,string>"))
    least = {"low": platforms.LOW, "medium": platforms.MEDIUM, "high": platforms.HIGH}[args.min_confidence]
    found = cut(platforms.detect(read, least).join(read.select("page_id", F.col("page.error").alias("error")), "page_id"))
    for r in found.toLocalIterator():
        print(r.page_id, f"error: {r.error}" if r.error else "custom" if r.is_custom else "", *[f"{p.platform}:{p.score}" for p in r.platforms])
    total = found.agg(F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
    print(f"{total.success} pages read, {total.failed} failed")
    return 0


def diff(spark: SparkSession, args: argparse.Namespace) -> int:
    policy = compare.Policy(args.overall_tolerance, args.page_tolerance, args.factor_tolerance, report_only=args.report_only)
    try:
        before, after = (spark.read.json(p) for p in (args.baseline, args.current))
        one = lambda df: df.where("status = 'success'").select("url", F.explode("factors").alias("f")).select("url", "f.factor_id", "f.score")
        bad = lambda df: df.select("url", F.explode("defects").alias("d")).select("url", "d.id", "d.severity")
        results = [df.select("url", "overall_score", "status", F.lit(None).cast("string").alias("error")) for df in (before, after)]
        changes = compare.pages(*results, policy)
        scores = tuple(scoring.site_score(df).first()[0] for df in results)
        same = compare.same_factors(one(before), one(after)).first().comparable
        held = before.where("status = 'success'").select("url")
        report = compare.report(changes, compare.factors(one(before), one(after), policy), compare.defects(bad(before), bad(after), held), scores, same, policy).first().asDict()
    except Exception as e:
        return sinks.failed("COMPARE_MISCONFIG", str(e))
    if args.outputs:
        sinks.ci_outputs(args.outputs, report)
    print(sinks.compare_report(report, [r.asDict() for r in changes.where("change in ('regressed', 'dropped', 'removed')").collect()]))
    return sinks.exit_code(verdict=report["verdict"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("audit", "score pages and rank fixes"), ("detect", "find platforms"), ("crawl", "follow captured responses and score the pages")):
        s = sub.add_parser(name, help=help_)
        s.add_argument("input", help="a table of pages (page_id, url, html[, headers, priority, psi]), a folder with --base-url, or a table of responses to crawl")
        s.add_argument("--as-of", help="the day of the audit; today if not given")
        s.add_argument("--format", choices=["json", "markdown", "text", "agent"], default="text")
        s.add_argument("--out", help="folder for one JSON record a page")
        s.add_argument("--outputs", help="file that key=value lines are added to, for a build's next steps")
        s.add_argument("--require-meta", action="store_true", help="fail if a page has no meta description")
        if name == "crawl":
            s.add_argument("--roots", required=True, help="URLs to begin with, by commas")
            s.add_argument("--robots", help="table of robots files (site, body)")
            s.add_argument("--sitemaps", help="table of sitemap documents (sitemap_url, body)")
            s.add_argument("--pages", type=float, default=1000)
            s.add_argument("--depth", type=float, default=10)
            s.add_argument("--skip-versions-after", type=int, default=0)
            continue
        s.add_argument("--base-url")
        s.add_argument("--url", help="one page alone")
        s.add_argument("--include", help="only these paths, by commas")
        s.add_argument("--changed", help="a list of changed source files: only the pages that they make")
        s.add_argument("--critical", help="paths, by commas, that --changed always takes along")
        s.add_argument("--sitemap", help="only pages that this sitemap lists, or a member of its index, with their priorities")
        s.add_argument("--sitemap-docs", help="table of sitemap documents (sitemap_url, body)")
        s.add_argument("--skip-files", action="store_true", help="leave out URLs that end like files")
        s.add_argument("--limit", type=int, help="a stratified sample of so many pages")
        s.add_argument("--files", help="table of auxiliary files (host, kind, state, url, body); a folder's own are read")
        s.add_argument("--targets", help="table of canonical targets (url, state, status, hops)")
        s.add_argument("--entities", help="JSON registry of entities")
        s.add_argument("--factors")
        s.add_argument("--geo", action="store_true")
        s.add_argument("--agent-skills", action="store_true")
        s.add_argument("--lighthouse", action="store_true")
        s.add_argument("--min-confidence", choices=["low", "medium", "high"], default="low")
    s = sub.add_parser("compare", help="compare the JSON records of two audits")
    s.add_argument("baseline")
    s.add_argument("current")
    s.add_argument("--outputs")
    for name in ("overall", "page", "factor"):
        s.add_argument(f"--{name}-tolerance", type=int, default=0)
    s.add_argument("--report-only", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"audit": audit, "detect": detect, "compare": diff, "crawl": follow}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
