import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import compare, entities, graph, platforms, robots, rollup, scoring, templates
from weftline.operators.factors import WEIGHTS, Env, chosen
from weftline.plans.audit import factor_results, page_audits, with_files
from weftline.sources import site

from test_page import STRONG


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    lit = F.lit
    got = one(spark, X.clamp_score(lit(-0.5)), X.clamp_score(lit(99.5)), X.clamp_score(lit(float("nan"))), X.normalize_text(lit(" a  b ")), X.normalize_entity_name(lit('The "Acme" Co. Ltd')), X.count_words(lit(" a  b c ")), X.copyright_year(lit("© 2018–2026 x; founded 1999")), X.copyright_year(lit("copyrighted 2020")), X.occurrences(lit("A+b a+B"), lit("a+b")))
    assert list(got) == [0, 100, 0, "a b", "the acme", 3, 2026, None, 2]
    dates = one(spark, *[F.unix_seconds(X.parse_date(lit(s))) for s in ("2024-01-02", "2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 03:04:05 GMT", "nonsense")])
    assert list(dates) == [1704153600, 1704164645, 1704164645, None]
    xml = "<urlset><url><loc>https://a.test/x</loc><lastmod>2024-01-01</lastmod></url></urlset>"
    assert one(spark, X.sitemap_lastmod(lit(xml), lit("https://a.test/x")))[0] == "2024-01-01" and one(spark, X.sitemap_lastmod(lit(xml), lit("https://a.test/y")))[0] is None
    assert one(spark, X.site_category(lit("add to cart checkout free shipping")))[0].category == "ecommerce"
    assert one(spark, X.neutralised(lit("a\u0007​b  c")))[0] == "a b c"


def audit(spark, html, url="https://acme.test/bread/", files=(), env=None, optional=()):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    if files:
        pages, env = with_files(pages, spark.createDataFrame([("acme.test", *f) for f in files], "host string, kind string, state string, url string, body string"))
    row = page_audits(pages, env, optional=optional).first()
    return row, {f.factor_id: f for f in row.factors}


def test_factors_of_a_rich_and_an_empty_page(spark):
    row, f = audit(spark, STRONG, optional=("geographic-signals", "agent-skill-exposure", "lighthouse"))
    assert f["definition-blocks"].score == 18 + 24 and f["definition-blocks"].applicable
    assert f["faq-content"].score == 34 + 14 + 12 + 10 and f["faq-content"].applicable
    assert f["content-depth"].score == 8 + 15 + 4 + 12
    assert f["schema-validity"].score == 69 and f["snippet-eligibility"].score == 100
    assert f["geographic-signals"].score == 32 + 22 + 18 + 8
    assert f["structured-data"].score == 30 + 24 + 12
    assert row.status == "success" and 0 < row.overall_score < 100 and row.summary.startswith("Overall score ")
    empty, g = audit(spark, None, url=None)
    assert empty.status == "success" and {d.id for d in empty.defects} == {"missing-h1", "missing-title", "missing-meta-description"}
    assert g["structured-data"].score == 0 and not g["faq-content"].applicable


def test_words_end_at_ascii_letters(spark):
    """As in JavaScript and SQL: a letter with a mark is no part of a word, so an address may stand next to one."""
    for text, score in (("call +1 (782) 555-7259 que esuemente rrllco ar\u00ed, \u00d1ado", 12), ("so \u00fc12 Main Road, Town ABC", 0), ("\u00fc12 Main Road, Town, CA\u00fc", 12), ("x12 main road", 0), ("12 Main Road, Town, CA", 12)):
        assert audit(spark, f"<body><p>{text}</p></body>", optional=("geographic-signals",))[1]["geographic-signals"].score == score
    for title, own in (("\u00fcFAQ", True), ("faqs\u00e9", True), ("xfaq", False), ("all faqs here", True)):
        assert audit(spark, f"<title>{title}</title>")[1]["faq-content"].applicable == own


def test_files_decide_access_factors(spark):
    words = " ".join(["word"] * 260)
    robots_txt = "User-agent: GPTBot\nDisallow: /bread\nAllow: /bread/\n\nUser-agent: *\nDisallow: /\nContent-Signal: ai-input=yes, search=no\nSitemap: https://acme.test/s.xml"
    files = [("llmsTxt", "ok", "https://acme.test/llms.txt", words), ("llmsFullTxt", "timeout", None, ""), ("robotsTxt", "ok", None, robots_txt), ("sitemapXml", "missing", None, "")]
    _, f = audit(spark, STRONG, files=files)
    assert f["ai-access-files"].score == 24 + 8 + 8 + 16 + 10
    assert f["ai-crawler-access"].score == 18 + 18 + 6 - 6
    assert audit(spark, STRONG, files=[("robotsTxt", "missing", None, "")])[1]["ai-crawler-access"].score == 80
    assert audit(spark, STRONG, files=[("robotsTxt", "timeout", None, "")])[1]["ai-crawler-access"].score == 30


@pytest.mark.parametrize(("metas", "header", "score"), [(["noindex"], None, 0), (["max-snippet:20"], None, 60), (["max-snippet:-1"], "googlebot: max-snippet:0", 0), ([], "bingbot: noindex", 100), (["index, follow"], None, 100), ([], "none", 0)])
def test_directives(spark, metas, header, score):
    got = one(spark, robots.directives(F.array(*[F.lit(m) for m in metas]).cast("array<string>"), F.lit(header)))[0]
    blocked = got.noindex or got.nosnippet or got.max_snippet == 0
    assert (0 if blocked else 60 if got.max_snippet and 0 < got.max_snippet < 50 else 100) == score


def test_shares_sum_to_a_hundred(spark):
    draw = random.Random(1)
    rows = [(p, [(k, w, draw.randrange(101), draw.choice([None, True, False])) for k, (_, w) in WEIGHTS.items() if draw.random() < 0.7]) for p in range(40)]
    df = spark.createDataFrame(rows, "page_id int, factors array<struct<factor_id:string,weight:int,score:int,applicable:boolean>>")
    out = df.select("page_id", F.explode(scoring.with_shares(F.col("factors"))).alias("f")).select("page_id", "f.*").collect()
    totals = {}
    for r in out:
        totals[r.page_id] = totals.get(r.page_id, 0) + r.share_pct
        assert r.applies or r.share_pct == 0 or not any(x.applies for x in out if x.page_id == r.page_id)
    assert {float(t) for t in totals.values()} == {100.0}
    with pytest.raises(ValueError):
        chosen(["nope"])


def brute_sample(items, limit, pin):
    chosen_, groups = [i for i in items if pin(i)][:limit], {}
    for i in items:
        if not pin(i):
            groups.setdefault(i[1], []).append(i)
    dealt = {}
    for k, own in groups.items():
        by = {}
        for i in own:
            by.setdefault(i[2], []).append(i)
        order = sorted(by.items(), key=lambda kv: (-len(kv[1]), kv[0]))
        dealt[k] = [b[r] for r in range(max(map(len, by.values()))) for _, b in order if r < len(b)]
    order = sorted(dealt.items(), key=lambda kv: (-len(kv[1]), kv[0]))
    r = 0
    while len(chosen_) < min(limit, len(items)):
        for _, own in order:
            if r < len(own) and len(chosen_) < limit:
                chosen_.append(own[r])
        r += 1
    return sorted(i[0] for i in chosen_)


def test_sample_equals_round_robin(spark):
    draw = random.Random(2)
    for _ in range(6):
        items = [(i, draw.choice("abc"), draw.choice("xyz")) for i in range(draw.randrange(1, 40))]
        limit = draw.randrange(1, 30)
        df = spark.createDataFrame(items, "ord int, template string, sub string")
        got = templates.sample(df, limit, spread="sub", pin=F.col("ord") % 7 == 3)
        assert [r.ord for r in got.collect()] == brute_sample(items, limit, lambda i: i[0] % 7 == 3)


def test_template_groups_compare_with_the_head(spark):
    rows = [(f"https://a.test/p/{i}", "/p/*", 50, [("a", 10 + i // 2), ("b", 5)]) for i in range(12)] + [("https://a.test/q", "/q", 50, [("a", 1)])]
    found, members = templates.groups(spark.createDataFrame(rows, "url string, template string, overall_score int, scores array<struct<factor_id:string,score:int>>"))
    got = found.collect()
    assert sorted(r.page_count for r in got) == [6, 6] and all(r.template == "/p/*" for r in got)
    assert sorted(r["count"] for r in members.groupBy("cluster").count().collect()) == [6, 6]


def test_url_shapes(spark):
    urls = [f"https://a.test/City{c}/p-{n}" for c in range(3) for n in range(10)] + ["https://a.test/", "https://a.test/about"]
    got = {r.url: r.template for r in templates.shapes(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got["https://a.test/City1/p-3"] == "/city1/*" and got["https://a.test/"] == "/" and got["https://a.test/about"] == "/about"


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("a", "d", 1), ("x", "a", 1)], "`from` string, `to` string, total int")
    assert {r.url: r.depth for r in graph.depths(edges, spark.createDataFrame([("a",)], "url string")).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    nodes = spark.createDataFrame([(u,) for u in "abcdx"], "url string")
    small = {r.url: r.rank for r in graph.pagerank(nodes, edges).collect()}
    limit, graph.ONE_TASK = graph.ONE_TASK, 0
    try:
        large = {r.url: r.rank for r in graph.pagerank(nodes, edges, iterations=5).collect()}
    finally:
        graph.ONE_TASK = limit
    five = {r.url: r.rank for r in graph.pagerank(nodes, edges, iterations=5).collect()}
    assert abs(sum(small.values()) - 1) < 1e-9 and all(abs(large[u] - five[u]) < 1e-9 for u in five)


def test_pagerank_of_large_graphs(spark):
    """Links in blocks, and joins: a target of many links, ends, loops, repeated links and links that leave the graph; ranks aren't rounded."""
    pairs = [(i, i * 7 % 90) for i in range(100)] + [(i, 3) for i in range(0, 90, 2)] + [(5, 5), (5, 5), (4, 200), (300, 4)]
    edges = spark.createDataFrame([(f"u{a}", f"u{b}") for a, b in pairs if a not in (11, 12)], "`from` string, `to` string")
    nodes = spark.createDataFrame([(f"u{i}",) for i in range(120)], "url string")
    n, links = 120, {(a, b) for a, b in pairs if a < 120 and b < 120 and a not in (11, 12)}
    outs = [sum(a == i for a, _ in links) for i in range(n)]

    def ranked(iterations):
        rank = [1 / n] * n
        for _ in range(iterations):
            given = [0.0] * n
            for a, b in links:
                given[b] += rank[a] / outs[a]
            lost = sum(r for r, k in zip(rank, outs, strict=True) if not k)
            rank = [0.15 / n + 0.85 * (g + lost / n) for g in given]
        return rank

    limits = graph.ONE_TASK, graph.DRIVER, graph.BLOCK, graph.NUMBERED
    try:
        for one, driver, iterations in ((limits[0], 0, 50), (0, limits[1], 50), (0, 0, 4)):
            graph.ONE_TASK, graph.DRIVER, graph.BLOCK, graph.NUMBERED = one, driver, 20, 50
            got = {r.url: r for r in graph.pagerank(nodes, edges, iterations=iterations).collect()}
            want = ranked(iterations)
            assert len(got) == n and all(abs(got[f"u{i}"].rank - want[i]) < 1e-15 for i in range(n))
            assert all(abs(got[f"u{i}"].score - want[i] / max(want) * 100) < 0.0051 for i in range(n))
    finally:
        graph.ONE_TASK, graph.DRIVER, graph.BLOCK, graph.NUMBERED = limits


def chase(hops, url):
    """The page at which a chain ends, or the URL where it closes into a loop."""
    seen = [url]
    while (to := hops.get(seen[-1])) is not None and to != seen[-1]:
        if to in seen:
            return to
        seen.append(to)
    return seen[-1]


def test_redirects_end_or_close(spark):
    draw = random.Random(5)
    for n in (6, 200):
        hops = {"r1": "r2", "r2": "r3", "l1": "l2", "l2": "l1", "l0": "l1", "s": "s", "t": "s"} | {f"u{i}": f"u{draw.randrange(n + n // 4)}" for i in range(n)} | {f"c{i}": f"c{i + 1}" for i in range(40)}
        got = {r.url: r.terminal for r in graph.terminals(spark.createDataFrame(list(hops.items()), "url string, `to` string")).collect()}
        assert got == {u: chase(hops, u) for u in hops}
    assert graph.terminals(spark.createDataFrame([], "url string, `to` string")).count() == 0


def test_dead_links_judge_by_status_alone(spark):
    pages = [("ok", "html", 200, None), ("gone", "error", 404, None), ("bad", "error", 503, None), ("slow", "error", 429, None), ("time", "error", None, "TIMEOUT"), ("many", "error", None, "REDIRECT_LIMIT"), ("odd", "error", None, None), ("blocked", "robots-blocked", None, None), ("l1", "redirect", 301, None), ("l2", "redirect", 301, None), ("r", "redirect", 302, None)]
    edges = [("p", u, "anchor", True) for u, *_ in pages] + [("p", "never", "anchor", True), ("p", "gone", "anchor", False), ("p", "gone", "redirect", True)]
    hops = spark.createDataFrame([("l1", "l2"), ("l2", "l1"), ("r", "gone")], "url string, `to` string")
    got = graph.dead_links(spark.createDataFrame(edges, "`from` string, `to` string, type string, internal boolean"), spark.createDataFrame(pages, "url string, state string, status int, error_code string"), hops)
    assert {r.to: (r.verdict, r.reason) for r in got.collect()} == {
        "gone": ("dead", "http-error"), "bad": ("dead", "http-error"), "r": ("dead", "http-error"), "slow": ("unverified", "throttled"), "time": ("unverified", "unreachable"), "many": ("unverified", "redirect-limit"), "odd": ("unverified", "unknown"),
    }


def test_edges_keep_the_first_five_texts(spark):
    rows = [("a", "b", i, f"t{i % 7}", i % 3 == 0, "content", True) for i in range(14)]
    got = graph.edges(spark.createDataFrame(rows, "`from` string, `to` string, ord int, text string, nofollow boolean, placement string, internal boolean")).first()
    assert (got.total, got.nofollow, got.content) == (14, 5, 14) and [a.text for a in got.anchors] == ["t0", "t1", "t2", "t3", "t4"]


def test_rollup(spark):
    rows = [("https://a.test/", "faq-content", "FAQ Content", 34, True, ["r1"]), ("https://a.test/x", "faq-content", "FAQ Content", 0, False, ["r1", "r2"]), ("https://a.test/", "citations", "Citations", 90, True, []), ("https://a.test/x", "citations", "Citations", 50, True, ["r3"])]
    df = spark.createDataFrame(rows, "url string, factor_id string, name string, score int, applies boolean, recommendations array<string>")
    got = rollup.cross_cutting(df).orderBy("rank").collect()
    assert [(r.factor_id, r.status, r.avg_score, r.affected_pages, r.applicable_avg_score) for r in got] == [("citations", "sitewide", 70, 1, 70), ("faq-content", "limited", 17, 2, 34)]
    pages = spark.createDataFrame([(f"https://a.test/{i}", " T " if i < 2 else f"t{i}", None) for i in range(5)] + [("https://a.test/", None, None)], "url string, title string, description string")
    assert sorted((r.value, r.url, r.n_urls) for r in rollup.duplicates(pages).collect()) == [("T", "https://a.test/0", 2), ("T", "https://a.test/1", 2)]
    links = spark.createDataFrame([("https://a.test/0?x",), ("https://a.test/1/",)], "to string")
    assert {r.url for r in rollup.orphans(pages, links, "https://a.test/x").collect()} == {f"https://a.test/{i}" for i in (2, 3, 4)}
    assert "https://a.test/" in {r.url for r in rollup.orphans(pages, links, "https://b.test/").collect()}
    assert rollup.orphans(pages.limit(3), links, "https://a.test/").count() == 0


def test_compare(spark):
    b = spark.createDataFrame([("a", 50, "success", None), ("b", 50, "success", None), ("c", 50, "success", None), ("d", 0, "error", "x")], "url string, overall_score int, status string, error string")
    c = spark.createDataFrame([("a", 40, "success", None), ("b", 0, "error", "boom"), ("d", 9, "success", None), ("e", 60, "success", None)], b.schema)
    pages = compare.pages(b, c)
    assert {r.url: r.change for r in pages.collect()} == {"a": "regressed", "b": "dropped", "c": "removed", "d": "absent", "e": "added"}
    none = spark.createDataFrame([], "url string, factor_id string, score int")
    bad = spark.createDataFrame([], "url string, id string, severity string")
    got = compare.report(pages, compare.factors(none, none), compare.defects(bad, bad, b), (50, 45)).first()
    assert (got.result, got.verdict, got.regression_count) == ("regression", "fail", 3)
    assert compare.report(pages, compare.factors(none, none), compare.defects(bad, bad, b), None).first().result == "no-baseline"
    assert [compare.drift(*x) for x in (("1.2", "2.0"), ("1.2", "1.3"), ("1.2.1", "1.2.9"), (None, "1"))] == ["major", "minor", "none", "unknown"]


def test_entities(spark):
    registry = [{"key": "north", "names": ["North Harbour Hotel", "North Harbour"], "urlMatchers": [{"host": "www.Hotels.test", "pathPrefix": "/north"}]}, {"key": "south", "names": ["South Harbour Hotel"], "urlMatchers": [{"host": "hotels.test", "pathPrefix": "/"}]}]
    names, matchers = entities.registry(spark, registry)
    pages = spark.createDataFrame([(1, "https://hotels.test/north/rooms"), (2, "https://www.hotels.test/x"), (3, "https://o.test/")], "page_id int, url string")
    assert {r.page_id: r.owner for r in entities.owners(pages, matchers).collect()} == {1: "north", 2: "south", 3: None}
    texts = spark.createDataFrame([(1, "north", "title", "Visit the South Harbour Hotel’s bar or North Harbour Hotel"), (3, None, "title", "South Harbour Hotel")], "page_id int, owner string, field string, text string")
    assert [(r.page_id, r.entity, r.start) for r in entities.mentions(texts, names).collect()] == [(1, "south", 10)]


def test_platforms(spark):
    from weftline.functions.page import parsed

    html = '<html><head><meta name="generator" content="WordPress 6.4.2"><script src="/wp-includes/x.js"></script></head><body class="woocommerce-page"></body></html>'
    df = spark.createDataFrame([(1, "https://a.test/", html, {"CF-Ray": "1", "Server": "cloudflare"}), (2, "https://a.test/2", "<p>x", None)], "page_id int, url string, html string, headers map<string,string>")
    got = {r.page_id: r for r in platforms.detect(parsed(df, drop_html=False)).collect()}
    assert [(p.platform, p.score, p.version) for p in got[1].platforms] == [("wordpress", 100, "6.4.2"), ("cloudflare", 100, None), ("woocommerce", 72, None)]
    assert not got[1].is_custom and got[2].is_custom and got[2].platforms == []


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc> https://x.test/?a=1&amp;b=2 </loc><priority>0.8</priority></url><url><loc><![CDATA[https://x.test/c]]></loc></url></urlset>")], "sitemap_url string, body string")
    assert {(r.loc, r.priority) for r in site.resolved_sitemap(docs, "i").collect()} == {("https://x.test/?a=1&b=2", 0.8), ("https://x.test/c", None)}
    odd = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc><![CDATA[https://x.test/s&#46;xml]]></loc></sitemap></sitemapindex>")], "sitemap_url string, body string")
    assert [r.loc for r in site.child_sitemaps(odd).collect()] == ["https://x.test/s.xml"]
    cases = {"a&#47;b&#x2F;c": "a/b/c", "&amp;lt;&lt;": "&lt;<", "&#0128512;&#x1F600;": "😀😀", "&#1114112;&#xD800;&#;": "&#1114112;&#xD800;&#;", "&#38;#47;": "&#47;", "plain": "plain", "&#65;": "A"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.x for r in df.select("s", X.xml_unescaped(F.col("s")).alias("x")).collect()} == cases
    (tmp_path / "blog").mkdir()
    (tmp_path / "index.html").write_text("<h1>a</h1>")
    (tmp_path / "blog" / "post one.html").write_text("<h1>b</h1>")
    (tmp_path / "x.css").write_text("")
    assert {r.url for r in site.static_pages(spark, str(tmp_path), "https://s.test/").collect()} == {"https://s.test/", "https://s.test/blog/post one"}
    files = spark.createDataFrame([("app/(shop)/cart/page.tsx",), ("src/pages/blog/index.mdx",), ("src/routes/x/+page.svelte",), ("content/a/b.md",), ("app/[id]/page.tsx",), ("lib/x.ts",)], "path string")
    assert {r.route for r in site.changed_routes(files).collect()} == {"/cart", "/blog", "/x", "/a/b"}
    with pytest.raises(ValueError):
        site.entity_registry('{"entities": [{"names": []}]}')


def test_freshness_uses_the_given_day(spark):
    html = '<html><head><script type="application/ld+json">{"@type":"Article","dateModified":"2024-05-20"}</script></head><body><footer>© 2024</footer></body></html>'
    env = Env(as_of=datetime(2024, 6, 1), headers=F.create_map(F.lit("Last-Modified"), F.lit("Sat, 01 Jun 2019 00:00:00 GMT")))
    _, f = audit(spark, html, env=env)
    assert f["content-freshness"].score == 35 + 12 + 0 + 23


def test_shares_of_results(spark):
    pages = spark.createDataFrame([(1, "https://a.test/", STRONG)], "page_id long, url string, html string")
    assert abs(sum(float(r.share_pct) for r in factor_results(page_audits(pages)).collect()) - 100) < 1e-9


def test_keys_order_equal_names_by_value():
    from weftline.functions.urls import crawl_key

    assert crawl_key("https://a.test/?b=2&a=2&a=1&B=0&utm_source=x") == "https://a.test/?a=1&a=2&b=2&B=0"
    assert crawl_key("https://a.test/?a-b=1&a_b=2&ab=3&é=4&e=5&f=6") == "https://a.test/?a_b=2&a-b=1&ab=3&e=5&%C3%A9=4&f=6"


def test_references_may_name_their_type():
    from weftline.functions import jsonld

    blocks = jsonld.load_blocks(['[{"@type":"FAQPage","mainEntity":[{"@type":"Question","@id":"#q"}]},{"@id":"#q","@type":"Question","name":"x"}]'])
    nodes = jsonld.Nodes(blocks, "https://a.test/")
    assert nodes.resolve({"@type": "Question", "@id": "#q"})["name"] == "x"
    assert not jsonld.is_reference({"@id": "#q", "name": "x"}) and not jsonld.is_reference({"@type": "Question"})


#: How many finding codes the registry has for factors whose codes all stand in their source.
REGISTERED = {"content-depth": 14, "eeat-signals": 13, "faq-content": 11, "citations": 11, "schema-validity": 5, "content-freshness": 16, "content-extractability": 14, "definition-blocks": 9, "ai-crawler-access": 11, "named-entities": 9}


def test_codes_are_as_many_as_registered(spark):
    import inspect
    import re

    from weftline.operators import factors

    assert {k: len(set(re.findall(r'f"\{c\}\.([a-z0-9.-]+)"', inspect.getsource(factors.BUILDERS[k])))) for k in REGISTERED} == REGISTERED
    odd = "<html><head><link rel=canonical href='/a'><link rel=canonical href='/b' media=x></head><body><link rel=canonical href='/c'><h1>a</h1></body></html>"
    rows = [(1, "https://a.test/", STRONG, [0.5, None]), (2, "https://a.test/2", odd, None), (3, "https://a.test/3", "", [None])]
    env = Env(psi=F.col("psi"), identity=F.when(F.col("page_id") == 1, "mismatch").otherwise("match"), negotiates=F.lit(True))
    audits = page_audits(spark.createDataFrame(rows, "page_id long, url string, html string, psi array<double>"), env, optional=("geographic-signals", "agent-skill-exposure", "lighthouse"))
    got = {r.code for r in audits.select(F.explode("factors").alias("f")).select(F.explode("f.findings.code").alias("code")).collect()}
    assert {
        "lighthouse.category.score", "lighthouse.category.missing", "lighthouse.category.none", "lighthouse.psi.unreachable", "entity-consistency.schema-identity.mismatch", "technical-seo.canonical.ignored-location", "technical-seo.canonical.ignored-attributes",
        "ai-access-files.content-negotiation.found", "citations.sameas.missing", "eeat-signals.author.missing", "schema-completeness.schema.none", "structured-data.site-category.detected", "geographic-signals.visible-location.missing", "agent-skill-exposure.mcp-discovery.missing",
    } <= got


@pytest.mark.parametrize(("directives", "codes"), [("noindex, nosnippet, noarchive", ["noindex.present", "nosnippet.present", "noarchive.present"]), ("max-snippet:20, noimageindex", ["max-snippet.low", "noimageindex.present"]), ("max-snippet:0", ["max-snippet.zero"]), ("index", ["directives.not-restrictive"]), ("", ["directives.none"])])
def test_every_directive_gives_a_finding(spark, directives, codes):
    _, f = audit(spark, f'<html><head><meta name="robots" content="{directives}"></head></html>')
    assert [x.code for x in f["snippet-eligibility"].findings] == [f"snippet-eligibility.{c}" for c in codes]


def test_canonical_targets_lower_the_score(spark):
    from weftline.functions.page import parsed
    from weftline.plans.audit import with_targets

    page = lambda i: (i, f"https://a.test/{i}", f'<html><head><title>x</title><link rel="canonical" href="https://a.test/t{i}"></head><body></body></html>')
    got = parsed(spark.createDataFrame([page(i) for i in range(5)], "page_id long, url string, html string"))
    targets = spark.createDataFrame([("https://a.test/t1", "ok", 200, 0), ("https://a.test/t2", "ok", 200, 1), ("https://a.test/t3", "timeout", None, 0), ("https://a.test/t4", "unreachable", 404, 0)], "url string, state string, status int, hops int")
    rows, env = with_targets(got, targets)
    out = page_audits(rows, env, only=["technical-seo"], already_parsed=True).select("page_id", F.col("factors")[0].alias("f")).collect()
    assert {r.page_id: r.f.score for r in out} == {0: 40, 1: 40, 2: 35, 3: 35, 4: 30}
    codes = {r.page_id: [f.code.split(".", 2)[-1] for f in r.f.findings if ".canonical." in f.code] for r in out}
    assert codes == {0: ["present"], 1: ["present", "reachable"], 2: ["present", "redirected", "reachable"], 3: ["present", "timeout"], 4: ["present", "unreachable"]}


def test_evidence_is_capped_but_counted(spark):
    rows = [(1, "a", "title", i, None, "b", "B C", 0, 3, "x") for i in range(40)] + [(1, "a", "title", 0, None, "b", "B C", 9, 12, "x")]
    got = entities.evidence(spark.createDataFrame(rows, "page_id int, owner string, field string, ord int, question string, entity string, name string, start int, end int, snippet string"), ("page_id", "ord")).collect()
    assert len(got) == 40
    rows = [(1, "a", "title", i, None, f"e{i}", "B C", 0, 3, "x") for i in range(40)]
    got = entities.evidence(spark.createDataFrame(rows, "page_id int, owner string, field string, ord int, question string, entity string, name string, start int, end int, snippet string")).collect()
    assert len(got) == 40 and sum(r.listed for r in got) == entities.MAX_EVIDENCE


def test_static_files_and_paths(spark, tmp_path):
    (tmp_path / "llms.txt").write_text("word " * 5)
    got = {r.kind: (r.state, r.host) for r in site.disk_files(spark, str(tmp_path), "https://s.test/").collect()}
    assert got == {"llmsTxt": ("ok", "s.test"), "llmsFullTxt": ("missing", "s.test"), "robotsTxt": ("missing", "s.test"), "sitemapXml": ("missing", "s.test")}
    robots_files = spark.createDataFrame([("https://s.test", "Sitemap: /a.xml\nSITEMAP: https://o.test/b.xml\nsitemap: https://s.test/c.xml # x")], "site string, body string")
    assert {r.sitemap_url for r in site.directive_sitemaps(robots_files).collect()} == {"https://s.test/a.xml", "https://s.test/c.xml"}
    assert [site.static_target(x) for x in ("https://a.test", "./x", "/x", "~/x", "a.test", "dir")] == [False, True, True, True, False, False] and site.static_target("dir", exists=True)
    from weftline.functions.urls import route_path

    df = spark.createDataFrame([(x,) for x in ("https://a.test/x/?q", "x", "/x//", "", "/", "https://a.test")], "p string")
    assert [r.r for r in df.select(route_path(F.col("p")).alias("r")).collect()] == ["/x", "/x", "/x", "/", "/", "/"]


def test_advice_cites_rules_and_names_schemas(spark):
    from weftline.operators import advice

    row, f = audit(spark, "<p>x")
    assert any(r.startswith("See https://") for r in f["ai-access-files"].recommendations) and not any("See https" in r for r in f["citations"].recommendations)
    phrase = lambda category, specific: one(spark, advice.schema_phrase(F.struct(F.lit(category).alias("category"), F.lit(specific).alias("specific"))))[0]
    assert phrase("ecommerce", True) == "Organization, Product, and AggregateRating schema" and phrase("ecommerce", False).startswith("Organization schema, plus")
    audits = [("a", 0.5, "numeric"), ("b", 0.1, "binary"), ("c", 0.95, "numeric"), ("d", None, "numeric"), (None, 0.0, "numeric"), ("e", 0.0, "manual"), *[(f"f{i}", 0.6, "numeric") for i in range(6)]]
    df = spark.createDataFrame([(audits,)], "a array<struct<title:string,score:double,mode:string>>")
    assert df.select(advice.worst_audits(F.col("a"))).first()[0] == ["b (score 10/100)", "a (score 50/100)", "f0 (score 60/100)", "f1 (score 60/100)", "f2 (score 60/100)"]


def test_retry_after(spark):
    from weftline.operators.crawl import retry_after, transient

    df = spark.createDataFrame([("3",), (" 7 ",), ("99999",), ("Wed, 21 Oct 2015 07:28:00 GMT",), ("-1",), (None,)], "h string")
    assert [r[0] for r in df.select(retry_after(F.col("h"), F.lit(500))).collect()] == [3000.0, 7000.0, 10000.0, 500.0, 500.0, 500.0]
    assert list(one(spark, *[transient(F.lit(c)) for c in ("TIMEOUT", "unreachable", "BLOCKED_HOST", None)])) == [True, True, False, False]
