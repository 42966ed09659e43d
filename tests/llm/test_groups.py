"""Near duplicates, joins, searches, archives, mixing and the pipeline."""

import hashlib
import io
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import curriculum, jaccard, paragraphs, permutations, vectors, warc
from weftline.llm.common import local_roots
from weftline.llm.components import connected_components


def roots(n, links):
    links = np.array(sorted(links)).reshape(-1, 2)
    return local_roots(n, links[:, 0], links[:, 1])


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(200, [x for x in links if None not in x])
    assert got == {i: want[i] for a, b in links if a is not None and a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- Jaccard ------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_rows(seed):
    """Copies with edits, shared passages, short texts and exact copies."""
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = draw.choices(vocab, k=60)
    texts = []
    for _ in range(25):
        base = draw.choices(vocab, k=draw.randrange(1, 120))
        for _ in range(draw.randrange(1, 9)):
            copy = list(base)
            for _ in range(draw.randrange(0, 5)):
                copy[draw.randrange(len(copy))] = draw.choice(vocab)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + draw.choices(vocab, k=draw.randrange(0, 25))) for _ in range(90)] + ["a b", "A  b", "a b c d e f", "a b c d e f g", "one", "ONE", "one"]
    return list(enumerate(texts, 10))


@pytest.mark.parametrize(("seed", "frequent", "tile"), [(1, 64, 2048), (2, 4, 2048), (3, 3, 8)])
def test_join_equals_brute_force(docs, monkeypatch, seed, frequent, tile):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "PAIRS", tile // 2)
    rows = near_rows(seed)
    odd = [(1, None), (2, " \t"), (3, "z" * 9000), (4, "q r s t u " * 4000), (None, "one"), (10, rows[0][1])]
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(len(rows), links)
    got = jaccard.jaccard_components(docs([*rows, *odd])).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert {i: (by[i].n_shingles, by[i].component_id) for i, _ in rows} == {i: (len(s), rows[want[k]][0]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}
    assert [(by[i].n_shingles, by[i].component_id) for i in (1, 2, 3)] == [(0, 1), (0, 2), (1, 3)] and by[4].n_shingles == 5 and by[None].component_id is None
    kept = jaccard.one_of_each(docs(rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if by[i].component_id == i} and kept.columns == docs(rows).columns


def test_join_of_nothing(docs):
    assert jaccard.jaccard_components(docs([])).count() == 0 and jaccard.jaccard_components(docs([(1, None)])).count() == 1


def test_signatures_of_any_two_links_meet():
    draw = np.random.default_rng(5)
    for _ in range(300):
        n = int(draw.integers(3, 90))
        pool = np.unique(draw.integers(0, 2**61, n + 40, dtype=np.uint64) | (draw.choice([0, 7], n + 40, p=[0.2, 0.8]).astype(np.uint64) << np.uint64(61)))
        x = pool[draw.permutation(len(pool))[:n]]
        y = np.concatenate([x[: n - int(draw.integers(0, n // 5 + 1))], pool[draw.permutation(len(pool))[: int(draw.integers(0, n // 8 + 1))]]])
        x, y = np.unique(x), np.unique(y)
        common = len(np.intersect1d(x, y))
        if len(y) >= 3 and 100 * common >= 75 * (len(x) + len(y) - common):
            assert len(np.intersect1d(jaccard.signatures(len(x), x), jaccard.signatures(len(y), y)))


# --- paragraphs ---------------------------------------------------------------------------------------------------------


def passages_by_brute_force(rows, least):
    """(doc_id, first word, words) -> cluster's first (doc_id, first word), comparing all pairs of paragraphs by their shingles as text."""
    units = []
    for i, t in rows:
        if t and i is not None:
            p = paragraphs.Paragraphs(pa.array([t]))
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            for first, n in zip(p.first.tolist(), p.words.tolist(), strict=True):
                held = {tuple(w[k : k + 5]) for k in range(first, min(first + n, len(w) - 4))} or {tuple(w)}
                units.append((i, first, n, held))
            assert sum(p.words) == len(w)
    links = [(a, b) for a in range(len(units)) for b in range(a) if 100 * len(units[a][3] & units[b][3]) >= 75 * len(units[a][3] | units[b][3])]
    root = roots(len(units), links) if links else np.arange(len(units))
    groups = {}
    for k, u in enumerate(units):
        groups.setdefault(root[k], []).append(u)
    found = {u[:3]: min(g)[:2] for g in ([x[:3] for x in g] for g in groups.values()) if len({u[0] for u in g}) > 1 for u in g}
    out = {}
    for i in {u[0] for u in found}:
        end, run = -1, []
        for u in [*sorted(x for x in found if x[0] == i), (i, 1 << 40, 0)]:
            if u[1] > end:
                if run and end - run[0][1] >= least:
                    out |= {x: found[x] for x in run}
                run = []
            run.append(u)
            end = max(end, u[1] + u[2])
    return out


def test_paragraphs_equal_brute_force(docs):
    draw = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    said = lambda n: draw.choices(vocab, k=n)
    passages = [said(n) for n in (51, 60, 80, 200, 30)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(draw.randrange(1, 4)):
            words += said(draw.randrange(0, 80)) + (draw.choice(passages) if draw.random() < 0.5 else [])
        if draw.random() < 0.3 and words:
            words[draw.randrange(len(words))] = "changed"
        wrap = draw.choice([7, 12, 1000])
        rows.append((i, "\n".join(" ".join(words[k : k + wrap]) for k in range(0, len(words), wrap))))
    rows += [(i + 100, t) for i, t in draw.choices(rows, k=25)] + [(200, None), (201, ""), (None, rows[0][1]), (202, "same " * 500), (203, "Same  " * 400), (204, "a b"), (205, "a b"), (3, rows[3][1])]
    want = passages_by_brute_force(rows[:-1], paragraphs.LEAST)
    got = paragraphs.repeated_paragraphs(docs(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.cluster, []).append((r.doc_id, r.first_word, r.n_words, r.removed))
    assert {x[:3] for g in by.values() for x in g} == set(want) and len(want) > 100
    assert all((x[:2] != want[x[:3]]) == x[3] for g in by.values() for x in g)
    cut = paragraphs.without_repeats(docs(rows))
    assert cut.columns == docs(rows).columns and cut.count() == len(rows)
    assert paragraphs.repeated_paragraphs(docs([])).count() == 0


def test_every_passage_of_51_words_is_found_wherever_it_stands(docs):
    draw = random.Random(9)
    rows = []
    for k in range(150):
        vocab = [f"v{draw.randrange(10**6)}" for _ in range(400)]
        passage = draw.sample(vocab, 51)
        for side in range(2):
            words = draw.sample(vocab, draw.randrange(0, 90)) + passage + draw.sample(vocab, draw.randrange(0, 90))
            wrap = (1000, 11)[side]
            rows.append((10 * k + side, "\n".join(" ".join(words[j : j + wrap]) for j in range(0, len(words), wrap))))
        rows.append((10 * k + 5, " ".join(draw.choices(vocab, k=120)) + " All rights reserved under the terms of the license that comes with it."))
    for i in range(6):  # one word over and over, and two by turns, among others
        words = [f"x{draw.randrange(10**6)}" for _ in range(80)]
        rows.append((100_000 + 10 * i, " ".join([*words[: 9 * i], *["la"] * (51 + 40 * i), *words[9 * i :]])))
        rows.append((200_000 + 10 * i, " ".join([*words[9 * i :], *["do", "re"] * (30 + 20 * i), *words[: 9 * i]])))
    found = {r.doc_id for r in paragraphs.repeated_paragraphs(docs(rows)).collect()}
    assert found == {i for i, _ in rows if i % 10 < 2}


@pytest.mark.parametrize("pairs", [2, 64])
def test_near_pairs_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    draw = random.Random(pairs)
    bases = [draw.sample(range(40), draw.randrange(1, 12)) for _ in range(60)]
    sets = [{t for t in draw.choice(bases) if draw.random() < 0.9} | {draw.randrange(40) for _ in range(draw.randrange(2))} for _ in range(400)]
    group = np.sort(np.array([draw.randrange(12) for _ in sets]))
    extra = np.array([draw.choice([0, 0, 1]) for _ in sets])  # tokens that no other set has
    sizes = np.array([len(s) for s in sets]) + extra
    rows = [(i, t) for i, s in enumerate(sets) for t in sorted(s)]
    left, right = jaccard.near_pairs(group, sizes, (np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64)))
    got = {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist(), strict=True)}
    want = {(a, b) for b in range(400) for a in range(b) if group[a] == group[b] and (c := len(sets[a] & sets[b])) and 100 * c >= 75 * (sizes[a] + sizes[b] - c)}
    assert got == want and len(want) > 20


def test_bands_and_cuts():
    assert paragraphs.bands_for(0.75, 1, 1e-3) == 5 and (1 - 0.75) ** paragraphs.bands_for(0.75) <= paragraphs.MISS
    for text, n in (("", 0), ("a", 1), ("a b c d e", 1), (" ".join(map(str, range(17))), 1)):
        assert len(paragraphs.Paragraphs(pa.array([text])).keys) == n
    p = paragraphs.Paragraphs(pa.array([" ".join(map(str, range(5000)))]))
    assert p.sizes.max() <= paragraphs.WINDOW and 6 < p.sizes.mean() < 11


# --- vectors ------------------------------------------------------------------------------------------------------------


def vector_rows(n=500, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.standard_normal(dim)
        out.append(v)
        for _ in range(int(rng.integers(0, 4))):
            out.append(v + 0.1 * rng.standard_normal(dim))
    hot = rng.standard_normal(dim)
    out += [hot + 0.05 * rng.standard_normal(dim) for _ in range(120)] + [hot] * 5
    return [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if i < len(out) - 125 else 1) for i, v in enumerate(out)]


ODD_VECTORS = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, [1.0] * 16, None), (9006, [float("inf")] * 16, 1), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1)]


@pytest.mark.parametrize("tile", [1024, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in [*rows, *ODD_VECTORS]], "vec_id long, embedding array<float>, label int, component string, copies int")
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = roots(len(rows), list(zip(*np.nonzero(near), strict=True)))
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(ODD_VECTORS)
    assert [(got[i].n_links, got[i].component_id) for i in range(len(rows))] == list(zip(near.sum(1).tolist(), root.tolist(), strict=True))
    assert [(got[i].n_links, got[i].kept) for i in range(9001, 9007)] == [(0, True)] * 6 and got[9008].component_id == 9007
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [8192, 300])
def test_dense_labels_lose_no_links(spark, monkeypatch, bucket):
    """One label whose vectors are all alike, but below the threshold; lone pairs just above it among them; labels are texts."""
    monkeypatch.setattr(vectors, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    center = unit(rng.standard_normal(64))
    x = unit(center + 0.23 * unit(rng.standard_normal((2500, 64))))
    near = unit(x[:120] + 0.15 * unit(rng.standard_normal((120, 64))))
    x = np.concatenate([x, near])
    cosines = x @ x.T
    assert 0.9 < np.median(cosines) < 0.97 and 100 <= (np.triu(cosines, 1) >= 0.98).sum()
    df = spark.createDataFrame([(i, v.tolist(), "dense") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    near = cosines >= 0.98
    np.fill_diagonal(near, False)
    want = roots(len(x), list(zip(*np.nonzero(near), strict=True)))
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist() and [got[i].component_id for i in range(len(x))] == want.tolist()


def test_search_recall_and_odd_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(32)]) for i in range(3000)]
    odd = [(100_000, None), (100_100, [0.0] * 32), (100_200, [float("nan")] * 32), (100_300, [None] * 32), (100_400, [1.0, 0.0]), (7, rows[7][1])]
    got = permutations.search(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")).collect()
    x, found = np.array([r[1] for r in rows]), {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(range(0, 3000, 100))
    hits = 0
    for q, own in found.items():
        own.sort(key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(r.score == d[r.vec_id] and r.vec_id != q for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        d[q] = np.inf
        hits += len({r.vec_id for r in own} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 300
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in permutations.search(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert permutations.search(few.limit(0)).count() == 0


def test_search_by_blocks_is_exact_and_cheap():
    """All that a block compares is found as by brute force, whatever the scales, at a fraction of its time."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4096, 64))
    x[:64] *= 10.0 ** rng.integers(-200, 140, (64, 1))
    x[64:96] = x[96:128]
    q, pivots = np.concatenate([x[:16], x[64:304]]), x[1000:1256]
    block = permutations.Block(np.arange(4096), x, pivots)
    own = np.concatenate([np.arange(16), np.arange(64, 304)])
    asked = permutations.weights(permutations.nearest_pivots(q, pivots, 64), 256)
    for i, (ids, d) in enumerate(block.nearest(own, q, asked, 4096, 10, np.full(256, np.inf))):
        every = permutations.distances(q[i], x)
        every[own[i]] = np.inf
        want = np.lexsort((np.arange(4096), every))[:10]
        assert ids.tolist() == want.tolist() and d.tolist() == every[want].tolist()
    block = permutations.Block(np.arange(4096), x[64:].repeat(2, 0)[:4096], pivots)
    began = time.thread_time()
    block.nearest(own, q, asked, 820, 10, np.full(256, np.inf))
    took, began = time.thread_time() - began, time.thread_time()
    for v in q:
        permutations.distances(v, x)
    assert took < (time.thread_time() - began) / 2


# --- archives -----------------------------------------------------------------------------------------------------------


def test_arc_versions_round_trip():
    payloads = [b"", b"x\n\nfiledesc://y 1\r\n\r\n", "é".encode() * 1000, b"\x00\xff" * 10]
    for version in (1, 2):
        data = warc.arc_version_block(version, "a.arc.gz") + b"".join(warc.arc_record(version, f"http://a.test/{i} b", str(i), p, "a.arc.gz", 7) for i, p in enumerate(payloads))
        records = list(warc.read_arc(io.BytesIO(data)))
        assert [b.partition(b"\r\n\r\n")[2] for _, b in records] == payloads and [" ".join(f) for f, _ in records] == [warc.FIELDS[version]] * 4
        ids = [warc.record_id("x/a.arc.gz", i) for i in range(4)]
        out = b"".join(warc.warc_record(f, b, ids[i], None if i else ("3", ids[3])) for i, (f, b) in enumerate(records))
        back = list(warc.read_warc(io.BytesIO(out)))
        assert [f["WARC-Type"] for f, _ in back] == ["revisit", "response", "response", "response"] and back[0][0]["WARC-Refers-To"] == ids[3]
        assert [f["WARC-Record-ID"] for f, _ in back] == ids and len(set(ids)) == 4 and back[1][1] == records[1][1]
        assert all(re.sub(r"\D", "", f["WARC-Date"]) == g["Archive-date"] for (f, _), (g, _) in zip(back, records, strict=True)) and len({f["WARC-Date"] for f, _ in back}) == 4


def test_archive_dates():
    assert [warc.warc_date(d) for d in ("20050214093011", "200502140930", "200502", "2005", "20051399", "x", "")] == [
        "2005-02-14T09:30:11Z", "2005-02-14T09:30:00Z", "2005-02-01T00:00:00Z", "2005-01-01T00:00:00Z", *["1996-10-20T00:00:00Z"] * 3
    ]


def test_faulty_records_are_passed_over():
    good = [warc.arc_record(1, f"http://a.test/{i}", str(i), b"p", "a", 0) for i in range(3)]
    data = warc.arc_version_block(1, "a") + good[0] + b"no header\nnor this one\n\n" + good[1] + b"http://a 0.0.0.0 1999 text/html x\n" + good[2] + b"http://a 0.0.0.0 20240101000000 text/html 99\nshort"
    got = list(warc.read_arc(io.BytesIO(data)))
    assert [isinstance(r, warc.Faulty) for r in got] == [False, True, False, True, False, True] and [f["URL"] for f, _ in (r for r in got if not isinstance(r, warc.Faulty))] == [f"http://a.test/{i}" for i in range(3)]
    odd = warc.arc_version_block(1, "a").replace(b"IP-address", b"Something")
    assert [isinstance(r, warc.Faulty) for r in warc.read_arc(io.BytesIO(odd + good[0]))] == [True, False]
    whole = [warc.warc_record(f, b, f"<id{i}>", None) for i, (f, b) in enumerate(r for r in got if not isinstance(r, warc.Faulty))]
    back = list(warc.read_warc(io.BytesIO(whole[0] + b"junk\nmore junk\n" + whole[1] + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: no\r\n\r\n" + whole[2][:-20])))
    assert [isinstance(r, warc.Faulty) for r in back] == [False, True, False, True, True]


def test_pages_through_archives(spark):
    big = "é" * 600
    rows = [(1, "http://a.test/", big), (2, None, big), (3, "u", big + "x"), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "\r\n\r\nWARC/1.0\r\n" * 100), (2, "again", big), (9, "u", "y" * 200_000)]
    got = warc.archive(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id < 3} == {(1, "revisit", 2), (2, "response", None)}
    assert all(r.record_type == "response" for r in got if r.page_id > 2)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------------


def test_mix_equals_sql_and_keeps_its_bounds(spark, docs, monkeypatch):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 16)
    draw = random.Random(12)
    rows = [(i, " ".join("w" * draw.randrange(0, 40)) or None, None, draw.choices(["a", "b", "É", "z", None], [60, 5, 20, 10, 5])[0]) for i in range(400)]
    df = docs(rows)
    got = curriculum.mix(df).collect()
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(curriculum.OP8_SQL).fetchall()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken, r.copies) for r in got) == sorted(w[:6] for w in want)
    first = {w[0]: w[6] for w in want}
    assert all((r.positions and abs(r.positions[0] - first[r.doc_id]) < 1e-8) or (not r.positions and first[r.doc_id] is None) for r in got)
    assert all(r.taken <= 3 * r.size and len(r.positions) == r.copies for r in got)
    total = sum(r.size for r in got)
    assert abs(sum({r.source_size: r.target for r in got}.values()) - total) < 1e-6 and abs(sum(r.taken for r in got) - total) <= 5
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first) and all(0 <= p <= 1 for p in first)
    assert sorted(r.doc_id for r in curriculum.schedule(df).collect()) == sorted(r.doc_id for r in got for _ in range(r.copies))


def test_mix_of_odd_rows(docs):
    got = curriculum.mix(docs([(1, None, None, "a"), (2, " ", None, None), (None, "x y", None, "a"), (3, "p q", None, "a"), (3, "p q", None, "a")])).collect()
    assert sum(r.taken for r in got) == 6 and {r.taken for r in got if r.size == 0} == {0} and len(got) == 5
    assert curriculum.mix(docs([])).count() == 0 and curriculum.schedule(docs([])).count() == 0


def test_positions_invert_the_demand(spark):
    from pyspark.sql import functions as F

    for start in (1.5, 1.0, 0.5):
        t = spark.range(11).select((F.col("id") / 10).alias("t")).select("t", curriculum._position(start * F.col("t") + (1 - start) * F.col("t") * F.col("t"), F.lit(start)).alias("back"))
        assert all(abs(r.t - r.back) < 1e-12 for r in t.collect())


# --- pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_on_a_small_corpus(spark, docs):
    import corpus_pipeline as c

    draw = random.Random(2)
    vocab = "the and with from there which about would this that have people river mountain window table garden letter".split()
    rows = [(i, " ".join(draw.choices(vocab, k=40)), "en", "ab"[i % 2], 0) for i in range(60)]
    rows += [(100, rows[3][1], None, "a", 0), (101, "12 34", "en", "a", 0), (102, None, "en", "a", 0), (103, rows[5][1] + ' password="abcdefgh12345678" end', "en", "b", 0)]
    df = docs(rows, extra=False)
    stages = dict(c.STAGES)
    kept = stages["language_id"](spark, df, "")
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {101, 102} and kept.columns == df.columns
    one = stages["ngram_jaccard_join"](spark, kept, "")
    ids = {r.doc_id for r in one.collect()}
    assert 100 not in ids and 103 not in ids and set(range(60)) <= ids
    clean = stages["secret_scan"](spark, docs(rows, extra=False), "").where("doc_id = 103").first()
    assert "[SECRET]" in clean.text and clean.n_chars == len(clean.text)
    mixed = stages["mixing"](spark, one, "")
    assert mixed.columns == df.columns and mixed.count() > 40
    assert stages["byte_bpe"](spark, mixed, "").count() == mixed.count()


@pytest.mark.parametrize("name", ["op1_embedding_neardup", "op4_warc_from_arc", "op5_ngram_jaccard_join", "op8_curriculum_mix"])
def test_sql_gives_the_same_rows(spark, name, tmp_path):
    """The queries on tables of files, against the SQL that is given for them."""
    from weftline.llm.registry import QUERIES, SQL

    draw = random.Random(21)
    texts = [" ".join(draw.choices("abcdefgh", k=draw.randrange(0, 12))) for _ in range(60)] + ["x y z a b c d"] * 3
    spark.createDataFrame([(i, t if i % 9 else None, "en", draw.choice(["p", "q", None]), 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*vector_rows(60), *ODD_VECTORS], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "u", "é" * 700 if i % 3 else f"<p>{i % 5}") for i in range(30)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
