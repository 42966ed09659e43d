"""The pipeline of five operators, stage by stage and as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

VOCAB = {"en": "the and with from there which about would this that have people".split(), "de": "der die und nicht mit einer werden auch über schön zwischen können".split()}


def rows():
    draw = random.Random(3)
    out = []
    for i in range(120):
        lang = draw.choice(list(VOCAB))
        words = [w + draw.choice(["", "", "er", "ing"]) for w in draw.choices(VOCAB[lang], k=draw.randrange(20, 80))]
        out.append((i, " ".join(words), lang if i % 10 else None, f"s{i % 4}" if i % 9 else None))
    out += [(1000 + i, out[i][1], "en", "s0") for i in range(10)]  # copies
    out += [(2000, None, "en", "s0"), (2001, "", "de", "s1"), (2002, "12 -- 34", None, "s1"), (2003, " ".join([*VOCAB["en"], 'password = "hunter2hunter2"', "and some more of that here"]), "en", "s2"), (3, out[3][1], "en", "s3"), (None, " ".join(VOCAB["de"]), "de", "s2")]
    return out


@pytest.fixture
def folder(docs, tmp_path):
    def make(data, extra=True):
        df = docs(data, extra=extra).withColumn("n_chars", F.length("text").cast("long"))
        df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


def test_stages_keep_what_they_should(spark, folder):
    sf_dir = folder(rows())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    steps = {}
    for name, stage in P.STAGES[:-1]:
        kept = P.stored(stage(spark, kept, sf_dir), name)
        assert kept.columns == columns, name
        steps[name] = kept.collect()
    ids = {name: [r.doc_id for r in got] for name, got in steps.items()}
    first = set(ids["language_id"])
    assert not first & {2000, 2001, 2002} and first >= {*range(120), *range(1000, 1010), 2003, None} and all(r.lang for r in steps["language_id"])
    assert sorted(x for x in ids["ngram_jaccard_join"] if x is not None) == [*range(120), 2003] and None in ids["ngram_jaccard_join"]
    secret = next(r for r in steps["secret_scan"] if r.doc_id == 2003)
    assert "[SECRET]" in secret.text and "hunter2" not in secret.text and secret.n_chars == len(secret.text)
    assert {r.doc_id: r.text for r in steps["secret_scan"] if r.doc_id != 2003} == {r.doc_id: r.text for r in steps["ngram_jaccard_join"] if r.doc_id != 2003}
    used = {x: ids["mixing"].count(x) for x in set(ids["mixing"])}
    assert set(used) <= set(ids["secret_scan"]) and max(used.values()) <= 3
    out = P.run(spark, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(map(str, ids["mixing"]))
    import tiktoken  # noqa: F401

    texts = {r.doc_id: r.text for r in steps["mixing"]}
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() and r.n_tokens > 0 for r in out)


def test_no_documents(spark, folder):
    assert P.run(spark, folder([])).count() == 0
