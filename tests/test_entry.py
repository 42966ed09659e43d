import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline import catalog
from weftline.functions.page import read_page

ROOT = Path(__file__).resolve().parent.parent


def test_contract():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "page_scores" in e.queries()


def test_works_without_the_corpus_operators(tmp_path):
    """The package imports and lists its queries where weftline/llm and corpus_pipeline.py are gone."""
    import shutil

    shutil.copytree(ROOT / "weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
    n, ops, pipeline = out.stdout.split()
    assert int(n) > 30 and pipeline == "False", out.stderr


def test_nothing_outside_imports_the_corpus_operators():
    for f in (ROOT / "weftline").rglob("*.py"):
        assert "llm" in f.parts or "weftline.llm" not in f.read_text(), f


@pytest.mark.parametrize("name", ["page_counts", "duplicate_titles", "page_scores"])
def test_unclosed_references_as_in_sql(spark, tmp_path, name):
    """Titles and headings cut inside a reference, some where a few characters decide a score: queries give their SQL's rows."""
    rows = []
    for i in range(12):
        title = ["Ores &amp;&amp", "Ores &amp;&am", "Ores &amp", "Ores &amp; &quot", "Ores &copy b &amp;", "Ores &"][i % 6] + f"{i // 6 if i % 6 > 3 else ''}"
        body = f"<html><head><title>{title}</title><style>p{{margin:0}}</style></head><body><!-- &amp --><h1>{title}</h1><p><b>{title}</b> {'plain words ' * 9}</p></body></html>"
        rows.append((i, f"http://a.test/{i}", body))
    view = "with " + catalog.PAGES_SQL + " select page_id, url, html, length(text) as chars from w"
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    near = [(i, u, h + "<!--" + "x" * max(0, int((chars - 1) / 0.3) - len(h) - 7) + "-->") for i, u, h, chars in con.execute(view).fetchall()]
    con.execute("delete from pages")
    con.executemany("insert into pages values (?, ?, ?)", near)
    con.execute(f"copy pages to '{tmp_path}/pages.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())


def test_references_as_in_html():
    page = '<title>a &amp;&amp</title><script type="x">a &amp b</script><body title="&amp">1 &lt 2 &copy; &am</body>'
    assert (read_page(page, "http://a.test/")["title"], read_page(page, "http://a.test/")["text"]) == ("a &&", "1 < 2 \u00a9 &am")
    assert (read_page(page, "http://a.test/", unclosed=False)["title"], read_page(page, "http://a.test/", unclosed=False)["text"]) == ("a &&amp", "1 &lt 2 \u00a9 &am")


def test_duplicate_titles_as_in_sql(spark, tmp_path):
    """Pairs of titles with other references, marks, line ends and blanks; null URLs, HTML and repeats; descriptions; a section of unknown name."""
    titles = ["a &lt; b", "a < b", "it&#39;s", "it's", "&eacute;t&nbsp;", "ét", "a &AMP; b", "a &ampx; b", "a <b &am", "if a<b then", "a <!-- x --> b", "\tHome\n", "Home", " Home　", "", " ", "\n", "&quot;&middot;&copy;&amp;lt;"]
    page = lambda t, more="": f'<html><head><title>{t}</title><meta name="description" content="one for all"></head><body>{more}<p>{t} words</p></body></html>'
    pages = [(f"http://a.test/{i}/{k}", page(t)) for i, t in enumerate(titles) for k in range(2)]
    pages += [("http://a.test/0/0", page(titles[0])), ("http://b.test/1", page("Once")), ("http://b.test/1", page("Once")), ("http://b.test/2", page("Section", "<![x[ y ]]>")), ("http://b.test/3", page("Section"))]
    pages += [(None, page("Home")), (None, page("Nowhere")), (None, page("Nowhere")), ("http://b.test/4", page("Nowhere")), ("http://b.test/5", None), ("http://b.test/6", "")]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [(i, *p) for i, p in enumerate(pages)])
    con.execute(f"copy pages to '{tmp_path}/pages.parquet'")
    want = con.execute(entry.oracle_sql()["duplicate_titles"])
    got = entry.queries()["duplicate_titles"](spark, str(tmp_path)).select(*[c[0] for c in want.description])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_titles_hold_no_elements():
    for t, text in (("if a<b &lt; c", "if a<b < c"), ("a <!-- x --> <i>b</i>", "a <!-- x --> <i>b</i>")):
        f = read_page(f"<title>{t}</title><textarea>{t}</textarea><p>more", "http://a.test/")
        assert (f["title"], f["text"]) == (text, text + "more")
    assert read_page("<p>x</p><title>a &amp; <p>b", "http://a.test/")["title"] == "a & <p>b"
    assert read_page("<title>t</title><![x[ y ]]><p>z</p>", "http://a.test/")["text"] == "z"
