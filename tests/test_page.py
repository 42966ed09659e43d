from weftline.functions.html import parse
from weftline.functions.page import read_page
from weftline.functions.urls import blocked_host, crawl_key, fold, parse_url

STRONG = """<!doctype html><html><head><title>Acme Bakery | Bread</title><meta name="description" content="Fresh bread every day"><meta property="og:title" content="Acme Bakery">
<meta name="geo.region" content="US"><link rel="canonical" href="/bread"><link rel="alternate" type="text/markdown" href="/bread.md">
<script type="application/ld+json">{"@context":"https://schema.org","@type":["Bakery","Organization"],"@id":"#us","name":"Acme Bakery","email":"a@acme.test","founder":{"@type":"Person","name":"A","jobTitle":"Baker"},"address":{"@type":"PostalAddress"},"geo":{"latitude":1}}</script>
<script type="application/ld+json">{"@type":"FAQPage","mainEntity":{"@type":"Question","name":"Why?","acceptedAnswer":{"text":"Because."}}}</script>
<script type="application/ld+json">{bad</script></head>
<body class="home"><nav><a href="/about">About us</a></nav><main><h1>Bread</h1><p>One<p>Two <b>bold<h2>What is bread?</h2><p>Bread is baked dough that people eat.</p>
<ol><li>a<li>b<li>c</ol><a href="https://en.wikipedia.org/wiki/Bread" rel="nofollow noopener">All about bread</a><article><header><a href="#x">in</a></header></article></main>
<details><summary>Why?</summary>x</details><footer>&copy; 2019-2023 Acme <a href="?q=1">q</a></footer><script>var t="</p><h1>no</h1>"</script></body></html>"""


def test_features_of_a_rich_page():
    f = read_page(STRONG, "https://acme.test/bread/")
    assert f["title"] == "Acme Bakery | Bread" and f["meta_description"] == "Fresh bread every day" and f["n_geo_meta"] == 1
    assert [h["text"] for h in f["headings"]] == ["Bread", "What is bread?"] and len(f["paragraph_words"]) == 3 and f["ol_items"] == [3]
    assert f["direct_answers"] == 1 and f["n_summary"] == 1 and f["n_summary_question"] == 2
    assert f["business_types"] == ["Bakery"] and "FAQPage" in f["types"] and f["persons"] == [] and f["orgs"] == [True]
    assert [b["error"] is not None for b in f["blocks"]] == [False, False, True]
    assert f["canonical"]["urls"] == ["https://acme.test/bread"] and f["canonical"]["score"] == 20
    assert f["footer"].startswith("© 2019-2023 Acme") and "no" not in f["text"].split()


def test_placements_follow_the_nearest_landmark():
    f = read_page(STRONG, "https://acme.test/bread/")
    assert [a["placement"] for a in f["anchors"]] == ["navigation", "content", "content", "navigation"]
    assert [a["nofollow"] for a in f["anchors"]] == [False, True, False, False]
    aside = '<body><section><footer><a href="/x">x</a></footer></section><div role="navigation"><a href="/y">y</a></div><nav role="presentation"><a href="/z">z</a></nav></body>'
    assert [a["placement"] for a in read_page(aside, "https://a.test/")["anchors"]] == ["unknown", "navigation", "unknown"]


def test_implied_tags():
    root = parse("<p>a<div>b</div></p><ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>x<td>y<tr><td>z</table><select><option>1<option>2</select>")
    tags = [n.tag for n in root.walk()]
    assert tags.count("p") == 2 and tags.count("li") == 3 and tags.count("tr") == 2 and tags.count("td") == 3 and tags.count("option") == 2
    assert parse("<title>a<b>c</title>").text().strip() == "a<b>c"


def test_empty_and_odd_pages():
    for html in ("", "<", "<!--", "\x00", "<a href>", "text only", "<html><head></head></html>", "</p>", "<svg/><img>"):
        f = read_page(html, "")
        assert f["error"] is None
    assert read_page("plain words here", "")["n_words"] == 3


def test_urls():
    base = parse_url("https://Example.com:443/a/b?x=1#f")
    assert base.text() == "https://example.com/a/b?x=1#f"
    for href, want in {"../c": "https://example.com/c", "//o.test/x": "https://o.test/x", "?q": "https://example.com/a/b?q", "./d/../e": "https://example.com/a/e", "http://é.test/ü": "http://xn--9ca.test/%C3%BC", "\\x": "https://example.com/x"}.items():
        assert parse_url(href, base).text() == want
    assert parse_url("http://", None) is None and parse_url("mailto:a@b.c", base).scheme == "mailto"
    assert crawl_key("https://a.test/p/?utm_source=x&b=2&a=1&gclid=3#f") == "https://a.test/p/?a=1&b=2"
    assert fold("Crème  Brûlée—Nº 5") == "creme brulee no 5"
    assert blocked_host("127.0.0.1") and blocked_host("x.local") and blocked_host("[::1]") and not blocked_host("example.com") and not blocked_host("8.8.8.8")
