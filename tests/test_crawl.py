import json
import random

import pytest
from pyspark.sql import functions as F

from weftline import sinks
from weftline.operators.crawl import Limits, crawl, provenance
from weftline.streaming import checkpoints as C

RESPONSE = "url string, status int, location string, content_type string, headers map<string,string>, body string, error_code string"


def page(*links, head=""):
    return f"<html><head>{head}</head><body><nav>" + "".join(f'<a href="{x}">{x}</a>' for x in links) + "</nav></body></html>"


def site():
    html = lambda url, body, headers=None: (url, 200, None, "text/html", headers, body, None)
    return [
        html("https://s.test/", page("/a?utm_source=x", "/b", "/old", "/private/x", "https://o.test/", "/nf")), html("https://s.test/a", page("/", "/c", "/b")),
        html("https://s.test/b", page("/deep", head='<meta name="robots" content="nofollow">')), ("https://s.test/old", 301, "https://s.test/c", None, None, None, None),
        html("https://s.test/c", page("/a")), ("https://s.test/nf", 404, None, "text/html", None, "", None), html("https://s.test/private/x", page("/y")), html("https://s.test/deep", page()),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_crawl_is_independent_of_order(spark, seed):
    rows = site()
    random.Random(seed).shuffle(rows)
    files = spark.createDataFrame([("https://s.test", "User-agent: *\nDisallow: /private/$x\nDisallow: /private/\n")], "site string, body string")
    got = crawl(spark.createDataFrame(rows, RESPONSE), spark.createDataFrame([("https://s.test",)], "url string"), files)
    pages = {r.url: (r.state, r.depth) for r in got.pages.collect()}
    assert pages == {"https://s.test/": ("html", 0), "https://s.test/a": ("html", 1), "https://s.test/b": ("html", 1), "https://s.test/old": ("redirect", 1), "https://s.test/private/x": ("robots-blocked", 1), "https://s.test/nf": ("error", 1), "https://s.test/c": ("html", 2)}
    assert got.stopped is None and got.levels == [1, 5, 1]
    edges = {(r["from"], r["to"]): r for r in got.edges.collect()}
    assert edges["https://s.test/b", "https://s.test/deep"].nofollow and not edges["https://s.test/", "https://o.test/"].internal and edges["https://s.test/old", "https://s.test/c"].type == "redirect"
    known = {(r.url, r.kind, r.source) for r in provenance(got.pages, got.edges).collect()}
    assert {s for u, _, s in known if u == "https://s.test/b"} == {"https://s.test/", "https://s.test/a"}


def test_crawl_limits(spark):
    df, roots = spark.createDataFrame(site(), RESPONSE), spark.createDataFrame([("https://s.test/",)], "url string")
    few = crawl(df, roots, limits=Limits(pages=3))
    assert few.stopped == "max-pages" and {r.url for r in few.pages.collect()} == {"https://s.test/", "https://s.test/a", "https://s.test/b"}
    assert crawl(df, roots, limits=Limits(depth=0)).stopped == "max-depth"
    few = Limits(pages=10, retries=1, delay_s=0.5).resolved()
    assert (few["fetches"], few["edges"], few["seconds"], few["bytes"], few["depth"]) == (5_000, 100_000, 120.0, 100 * 1024 * 1024, 10)
    many = Limits(pages=10_000, retries=2, delay_s=1.0).resolved()
    assert (many["fetches"], many["edges"], many["seconds"], many["bytes"]) == (60_000, 500_000, 20_000, 15_000_000_000)
    odd = Limits(pages=float("inf"), fetches=0, bytes=1e300, depth=-1, seconds=float("nan")).resolved()
    assert (odd["pages"], odd["fetches"], odd["bytes"], odd["depth"], odd["seconds"]) == (1000, 1, 2**53 - 1, 0, 1000.0)


@pytest.mark.parametrize(("limits", "stop"), [({"fetches": 3}, "max-fetches"), ({"bytes": 300}, "max-bytes"), ({"seconds": 2}, "max-duration"), ({"edges": 2}, "max-edges"), ({"links_per_page": 1}, "max-links-per-page")])
def test_budgets_stop_the_crawl(spark, limits, stop):
    df = spark.createDataFrame(site(), RESPONSE).withColumn("seconds", F.lit(0.6))
    got = crawl(df, spark.createDataFrame([("https://s.test/",)], "url string"), limits=Limits(**limits))
    states = [r.state for r in got.pages.collect()]
    assert got.stopped == stop and ("discovered" in states) == (stop in ("max-fetches", "max-bytes", "max-duration"))
    most = Limits(**limits).resolved()
    assert all(got.used[k] <= most[k] for k in ("fetches", "bytes", "seconds", "edges"))
    assert crawl(df, spark.createDataFrame([("https://s.test/",)], "url string"), limits=Limits(page_bytes=50)).pages.first().error_code == "BODY_TOO_LARGE"


def test_hard_stops_override_soft_ones():
    from weftline.operators.crawl import Crawl

    got = Crawl(None, None)
    for reason in ("max-query-variants", "max-pages", "max-bytes", "max-fetches"):
        got.stop(reason)
    assert got.stopped == "max-bytes" and got.soft == "max-query-variants"


def versions(copies, own=()):
    """A root that links pages, each linking its own ?print=1 copy; `own` copies are pages of their own."""
    html = lambda url, body: (url, 200, None, "text/html", None, body, None)
    clean = lambda i: f"https://s.test/u/{i:02}"
    rows = [html("https://s.test/", page(*[clean(i) for i in range(copies)]))]
    for i in range(copies):
        rows.append(html(clean(i), page(f"{clean(i)}?print=1", clean(i + 1))))
        rows.append(html(f"{clean(i)}?print=1", page(head="" if i in own else f'<link rel="canonical" href="{clean(i)}">')))
    return rows


def test_versions_are_learned_and_unlearned(spark):
    chain = [r if not r[0].endswith("/") else (*r[:5], page("https://s.test/u/00"), r[6]) for r in versions(8)]
    roots = spark.createDataFrame([("https://s.test/",)], "url string")
    got = crawl(spark.createDataFrame(chain, RESPONSE), roots, limits=Limits(skip_versions_after=3, depth=30))
    fetched = {r.url for r in got.pages.collect() if "print" in r.url}
    left_out = {r.url for r in got.skipped.collect()}
    assert len(fetched) + len(left_out) == 8 and 3 <= len(fetched) < 8 and not fetched & left_out
    late = [(*r[:5], page(head=""), r[6]) if "/u/04?" in r[0] else r for r in chain]
    got = crawl(spark.createDataFrame(late, RESPONSE), roots, limits=Limits(skip_versions_after=3, depth=30), seeds=spark.createDataFrame([("https://s.test/u/04?print=1",)], "url string"))
    assert got.skipped.count() == 0 and sum("print" in r.url for r in got.pages.collect()) == 8
    assert crawl(spark.createDataFrame(chain, RESPONSE), roots, limits=Limits(depth=30)).skipped is None


def test_query_variants_are_bounded(spark):
    rows = [("https://s.test/", 200, None, "text/html", None, page(*[f"/a?x={i}" for i in range(9)]), None)]
    got = crawl(spark.createDataFrame(rows, RESPONSE), spark.createDataFrame([("https://s.test/",)], "url string"), limits=Limits(query_variants=4))
    assert got.stopped == "max-query-variants" and sorted(r.url for r in got.pages.where("depth = 1").collect()) == [f"https://s.test/a?x={i}" for i in range(4)]


def test_sitemap_seeds(spark):
    from weftline.operators.crawl import sitemap_seeds

    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    pages = lambda *urls: "<urlset>" + "".join(f"<url><loc>https://s.test{u}</loc></url>" for u in urls) + "</urlset>"
    docs = spark.createDataFrame([("a", index("b", "c")), ("b", index("a", "d")), ("c", pages("/1", "/2")), ("d", pages("/2", "/3")), ("e", pages("/9"))], "sitemap_url string, body string")
    starts = spark.createDataFrame([("a",), ("none",)], "sitemap_url string")
    got, stop = sitemap_seeds(docs, starts)
    assert {(r.url, r.sitemap_url) for r in got.collect()} == {("https://s.test/1", "c"), ("https://s.test/2", "c"), ("https://s.test/2", "d"), ("https://s.test/3", "d")} and stop is None
    few, stop = sitemap_seeds(docs, starts, Limits(sitemap_urls=2))
    assert {r.url for r in few.collect()} == {"https://s.test/1", "https://s.test/2"} and stop == "max-sitemap-urls"
    assert sitemap_seeds(docs, starts, Limits(sitemap_fanout=1))[1] == "max-sitemap-fanout"


def test_replays_change_nothing(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"key": f"page:{i}", "score": i, "fetched_at": "now"}) for i in range(600)))
    schema = "key string, score int, fetched_at string"
    C.follow(spark, str(source), schema, sink, str(tmp_path / "s1")).awaitTermination()
    first = spark.read.parquet(sink).count()
    C.follow(spark, str(source), schema, sink, str(tmp_path / "s2")).awaitTermination()  # from the start again
    assert first == 600 == spark.read.parquet(sink).count()
    assert spark.read.parquet(sink).groupBy("batch_id").count().agg(F.max("count")).first()[0] <= C.BATCH_ROWS
    (source / "2.json").write_text(json.dumps({"key": "page:5", "score": 77, "fetched_at": "later"}))
    C.follow(spark, str(source), schema, sink, str(tmp_path / "s1")).awaitTermination()
    last = {r.key: r.score for r in C.current(spark.read.parquet(sink)).collect()}
    assert len(last) == 600 and last["page:5"] == 77 and last["page:6"] == 6


def test_reports():
    fixes = [{"title": "Missing <h1> | `x`", "kind": "critical-defect"}]
    text = sinks.site_report(65, {"pages_audited": 1, "pages_discovered": 2, "confidence": "full"}, fixes, [], [{"id": "a", "severity": "critical"}])
    assert r"Missing \<h1\> \| \`x\`" in text and json.loads(sinks.site_report(65, {}, fixes, [], [{"severity": "critical"}], "agent")) == {"score": 65, "pass": False, "top_fixes": ["Missing <h1> | `x`"], "critical_defects": 1}
    assert sinks.safe("a‮b\nc") == "a b c" and [sinks.exit_code(70), sinks.exit_code(69), sinks.exit_code(verdict="fail"), sinks.exit_code(error=True)] == [0, 1, 1, 2]


def test_local_addresses_are_refused(spark):
    rows = [(u, 200, None, "text/html", None, page(), None) for u in ("http://localhost/", "http://10.0.0.1/", "https://s.test/")]
    df, roots = spark.createDataFrame(rows, RESPONSE), spark.createDataFrame([(r[0],) for r in rows], "url string")
    assert {r.url: (r.state, r.error_code) for r in crawl(df, roots).pages.collect()} == {"http://localhost/": ("error", "BLOCKED_HOST"), "http://10.0.0.1/": ("error", "BLOCKED_HOST"), "https://s.test/": ("html", None)}
    assert {r.state for r in crawl(df, roots, local=("localhost", "10.0.0.1")).pages.collect()} == {"html"}
