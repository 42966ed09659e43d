import json

from weftline import cli
from weftline.operators.identity import country_names, identities


def page(name, address="", title="Casa Verde Hotel", extra="", words=60):
    data = {"@type": "Hotel", "name": name} | ({"address": address} if address else {})
    return f'<html><head><title>{title}</title>{extra}<script type="application/ld+json">{json.dumps(data)}</script></head><body><h1>{title}</h1><p>{"lorem " * words}</p></body></html>'


def test_identity(spark):
    german = {"@type": "PostalAddress", "addressLocality": "Köln", "addressCountry": "Alemania"}
    rows = [
        (1, page("Hotel Casa Verde")), (2, page("Hotel Monte Azul")), (3, page("Hotel Monte Azul", words=5)), (4, page("The Hotel & Spa")), (5, None), (6, "<p>x"),
        (7, page("Casa Verde", german, extra='<meta name="geo.region" content="US-CA">')), (8, page("Casa Verde", german, title="Casa Verde Köln", extra='<meta name="geo.region" content="US-CA">')),
        (9, page("Acme Rooms", extra='<meta property="og:site_name" content="Acme Rooms">')),
    ]
    got = {r.page_id: r.status for r in identities(spark.createDataFrame([(i, "https://x.test/", h) for i, h in rows], "page_id int, url string, html string")).collect()}
    assert got == {1: "match", 2: "mismatch", 3: "unknown", 4: "unknown", 5: "unknown", 6: "unknown", 7: "mismatch", 8: "match", 9: "unknown"}
    assert {"germany", "deutschland", "alemania", "duitsland"} <= set(country_names(spark)["DE"])


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "site").mkdir()
    for i in range(3):
        (tmp_path / "site" / f"p{i}.html").write_text(f"<title>Page {i}</title><h1>Page {i}</h1><p>{'word ' * 600}</p>")
    run = lambda out, *more: cli.main(["audit", str(tmp_path / "site"), "--base-url", "https://s.test", "--out", str(tmp_path / out), "--format", "json", *more])
    assert run("a") == 1
    report = json.loads(capsys.readouterr().out)
    assert 0 < report["aggregate_score"] < 70 and report["defects"][0]["id"] == "missing-meta-description"
    (tmp_path / "site" / "p0.html").write_text("<p>gone bad")
    assert run("b") == 1
    capsys.readouterr()
    assert cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "b")]) == 1 and "regression: fail" in capsys.readouterr().out
    assert cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "a")]) == 0 and cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "none")]) == 2


def test_audit_reads_its_inputs(spark, tmp_path, capsys):
    """Headers, files, targets, entities and sitemaps given on the command line reach the factors."""
    rows = [(i, f"https://s.test/p{i}", f'<html><head><title>North Harbour Hotel</title><link rel="canonical" href="https://s.test/t"></head><body><h1>x</h1>{"word " * 50}</body></html>', {"Last-Modified": "Fri, 15 May 2026 00:00:00 GMT"}) for i in range(4)]
    spark.createDataFrame(rows, "page_id long, url string, html string, headers map<string,string>").write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("s.test", "robotsTxt", "ok", "", "User-agent: *\nDisallow: /"), ("s.test", "llmsTxt", "ok", "", "word " * 200)], "host string, kind string, state string, url string, body string").write.parquet(str(tmp_path / "files"))
    spark.createDataFrame([("https://s.test/t", "unreachable", 404, 0)], "url string, state string, status int, hops int").write.parquet(str(tmp_path / "targets"))
    spark.createDataFrame([("m", "<urlset><url><loc>https://s.test/p1</loc><priority>0.9</priority></url><url><loc>https://s.test/p2/</loc></url></urlset>")], "sitemap_url string, body string").write.parquet(str(tmp_path / "maps"))
    (tmp_path / "entities.json").write_text(json.dumps({"entities": [{"key": "south", "names": ["South Harbour Hotel"], "urlMatchers": [{"host": "s.test", "pathPrefix": "/"}]}, {"key": "north", "names": ["North Harbour Hotel"]}]}))
    out = str(tmp_path / "out")
    args = ["audit", str(tmp_path / "pages"), "--files", str(tmp_path / "files"), "--targets", str(tmp_path / "targets"), "--entities", str(tmp_path / "entities.json"), "--as-of", "2026-06-01", "--sitemap", "m", "--sitemap-docs", str(tmp_path / "maps"), "--out", out, "--outputs", str(tmp_path / "ci"), "--require-meta", "--format", "agent"]
    assert cli.main(args) == 1
    text = capsys.readouterr()
    assert "2 pages have no meta description" in text.err and json.loads(text.out)["critical_defects"] == 1 and "pages=2" in (tmp_path / "ci").read_text()
    got = spark.read.json(out)
    assert {r.url for r in got.collect()} == {"https://s.test/p1", "https://s.test/p2"}
    row = got.where("url like '%p1'").first()
    f = {x.factor_id: x for x in row.factors}
    assert "names-another-entity" in {d.id for d in row.defects} and f["content-freshness"].score >= 20 and f["ai-access-files"].score == 24 + 8 + 16
    assert "ai-crawler-access.crawler.blocked" in {x.code for x in f["ai-crawler-access"].findings} and "technical-seo.canonical.unreachable" in {x.code for x in f["technical-seo"].findings}
    assert cli.main(["audit", str(tmp_path / "none")]) == 2 and "BAD_INPUT" in capsys.readouterr().err


def test_crawl_command(spark, tmp_path, capsys):
    page_ = lambda *links: "<html><head><title>t</title></head><body><h1>t</h1>" + "".join(f'<a href="{x}">{x}</a>' for x in links) + "</body></html>"
    rows = [("https://s.test/", page_("/a", "/b")), ("https://s.test/a", page_("/")), ("https://s.test/b", page_("/a")), ("https://s.test/m", page_())]
    spark.createDataFrame([(u, 200, None, "text/html", None, h, None) for u, h in rows], "url string, status int, location string, content_type string, headers map<string,string>, body string, error_code string").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([("https://s.test/sitemap.xml", "<urlset><url><loc>https://s.test/m</loc></url></urlset>")], "sitemap_url string, body string").write.parquet(str(tmp_path / "maps"))
    assert cli.main(["crawl", str(tmp_path / "r"), "--roots", "https://s.test/", "--sitemaps", str(tmp_path / "maps"), "--format", "agent"]) == 1
    first, second = capsys.readouterr().out.strip().splitlines()
    assert json.loads(first)["states"] == {"html": 4} and json.loads(second)["pass"] is False
