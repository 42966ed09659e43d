"""Substring dedup: passages that repeat across documents, by MinHash banding of content-defined paragraphs.

Line breaks are no guide: a passage may stand inside a longer line or be wrapped anew. A text's words are cut where the
hash of a three-word run is the least of WINDOW in a row, so equal passages are cut at equal places whatever surrounds them.
In a passage of 51 words the first window chooses one of the first 16 places, and the last whose shingles end inside one from
the 32nd to the 47th: 16 words apart at least. Between these, every cut and so every paragraph is the same in all texts that
hold the passage. A paragraph is the set of the 5-word shingles that begin between two cuts; a stretch of one word over and
over is one of its own, alike however long.

Bands of MinHash values are dealt to buckets together with the paragraph's key, so that copies of a paragraph meet once.
Another exchange finds the keys that two documents hold. Paragraphs that collide in a band but differ are read again from
one document that holds each, compared by exact Jaccard, and united; clusters are the connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import SHINGLE_WORDS, WORD, distinct, input_bytes, mix64, set_keys, shingled, stored, table, three_word_runs, tidy, word_hashes
from weftline.llm.jaccard import PERCENT, SLICE, linked_classes
from weftline.llm.streams import consecutive

#: Runs of three words among which the least one is a cut.
WINDOW = 16
#: Shingles of a passage, at least: the stretch that is surely found of one with 51 words.
LEAST = 16
#: Rows in a band; and the probability at most with which a pair at the threshold collides in none.
ROWS = 1
MISS = 1e-3
SEED = 11
#: Bytes of text for each bucket of the exchange.
BUCKET_BYTES = 8 << 20


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair of that similarity is missed with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


_SEEDS = mix64(np.arange(1, 1 + bands_for(PERCENT / 100) * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))


def cuts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the words where a paragraph begins: the least three-word run (the first of equal ones) of each WINDOW inside a
    text, but not one that equals the run before it, nor a place in a text's last words, where no shingle begins."""
    if len(words) < WINDOW + 2:
        return np.zeros(0, np.int64)
    runs = three_word_runs(words)
    place, step = np.arange(len(runs)), 1
    while step < WINDOW:
        a, b = place[:-step], place[step:]
        place = np.where(runs[b] < runs[a], b, a)
        step *= 2
    end = np.repeat(at[1:], np.diff(at))
    inside = np.flatnonzero(np.arange(len(place)) + WINDOW + 2 <= end[: len(place)])
    found = np.unique(place[inside])
    again = (found > 0) & (runs[found] == runs[found - 1])
    return found[~again & (found + SHINGLE_WORDS <= end[found])]


def stretches(text: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Of shingles in order, those where a stretch of equal ones begins or has ended."""
    if len(tokens) < 2:
        return np.zeros(0, np.int64)
    same = np.concatenate([[False], (tokens[1:] == tokens[:-1]) & (text[1:] == text[:-1])])  # as the one before
    begin = ~same & np.concatenate([same[1:], [False]])
    ended = ~same & np.concatenate([[False], same[:-1]]) & np.concatenate([[False], text[1:] == text[:-1]])
    return np.flatnonzero(begin | ended)


class Paragraphs:
    """The paragraphs of a slice of texts: for each its text, first word and number of words, size and key; and all distinct (paragraph, shingle), in order."""

    def __init__(self, texts: pa.Array):
        words, at = word_hashes(texts)
        begins = np.zeros(len(words), bool)
        begins[at[:-1][np.diff(at) > 0]] = True
        begins[cuts(words, at)] = True
        start, text, tokens, _ = shingled(words, at)
        begins[start[stretches(text, tokens)]] = True
        first = np.flatnonzero(begins)
        self.text = np.searchsorted(at, first, "right") - 1
        self.first = first - at[self.text]
        self.words = np.diff(np.concatenate([first, [len(words)]]))
        own = (np.cumsum(begins) - 1)[start] if len(start) else start
        some = distinct(own, tokens)
        self.own, self.tokens = own[some], tokens[some]
        self.sizes, self.keys = set_keys(self.own, self.tokens, len(first))


def band_hashes(p: Paragraphs, some: np.ndarray) -> np.ndarray:
    """(band, paragraph): hashes of the bands of the paragraphs in `some` (true or false for each)."""
    tokens, heads = p.tokens[some[p.own]], np.cumsum(p.sizes[some]) - p.sizes[some]
    out = []
    with np.errstate(over="ignore"):
        for band in range(len(_SEEDS) // ROWS):
            h = np.full(int(some.sum()), band + 1, np.uint64)
            for k in range(ROWS):
                h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(mix64(tokens ^ _SEEDS[band * ROWS + k]), heads))
            out.append(h)
    return np.array(out)


_BLOB = ["part", "kind", "hashes", "keys", "ids", "places"]
_BLOB_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_BLOB_DDL = "part int, kind int, hashes binary, keys binary, ids binary, places binary"
#: Kinds of blob: bands; places of paragraphs; places of those that a task has seen in two documents, which needn't meet others.
BANDS, PLACES, KNOWN = range(3)
#: Keys that a task remembers; beyond it the memory starts anew, and copies that are sent again meet as equal keys.
MEMORY = 500_000
#: Bits of the filter that every task gets, at most: 16 MB.
FILTER_BITS = 1 << 27


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_BLOB), _BLOB_KINDS, strict=True)], _BLOB)


def paragraph_blobs(documents: DataFrame, buckets: int) -> DataFrame:
    """documents (doc_id, text) -> blobs dealt by key (places), by band hash (bands; a key that a task has met before adds none again) and by document (places of keys that many documents hold). A blob names a document by a number of 16 bits in its own list of ids."""

    def dealt(kind: int, by: np.ndarray, keys: np.ndarray, ids: np.ndarray | None = None, *places: np.ndarray) -> list[tuple]:
        """Blobs of keys, and of places: text, first word and words of each."""
        to = (by % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, keys, places = to[order], keys[order], [x[order] for x in places]
        hashes = by[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:] if kind == BANDS else np.zeros((len(to), 0), np.uint8)
        groups = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else [0]
        rows = []
        for a, b in zip(groups[:-1], groups[1:], strict=True):
            held, numbers = b"", []
            if kind != BANDS:
                texts, number = np.unique(places[0][a:b], return_inverse=True)
                held, numbers = ids[texts].tobytes(), [number.astype(np.uint16), *[x[a:b].astype(np.uint32) for x in places[1:]]]
            rows.append((int(to[a]), kind, hashes[a:b].tobytes(), keys[a:b].tobytes(), held, b"".join(x.tobytes() for x in numbers)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        wide: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                p, ids = Paragraphs(batch.column(1)), np.asarray(batch.column(0), np.int64)
                if not len(p.keys):
                    continue
                each, where, number, many = np.unique(p.keys, return_index=True, return_inverse=True, return_counts=True)
                known = np.array([k in wide for k in each.tolist()])[number]
                new = np.zeros(len(p.keys), bool)
                new[[i for i, k in zip(where.tolist(), each.tolist(), strict=True) if not (k in met or met.add(k))]] = True
                rows = dealt(KNOWN, mix64(ids[p.text[known]].view(np.uint64)), p.keys[known], ids, p.text[known], p.first[known], p.words[known])
                rows += dealt(PLACES, mix64(p.keys[~known].view(np.uint64)), p.keys[~known], ids, p.text[~known], p.first[~known], p.words[~known])
                if new.any():
                    h = band_hashes(p, new)
                    rows += dealt(BANDS, h.ravel(), np.tile(p.keys[new], len(h)))
                order, heads = np.argsort(number, kind="stable"), np.cumsum(many) - many
                doc = ids[p.text[order]]
                wide.update(each[np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)].tolist())
                if len(met) > MEMORY:
                    met.clear()
                if len(wide) > MEMORY:
                    wide.clear()
                yield _blobs(rows)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), _BLOB_DDL)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def met_blobs(blobs: DataFrame, buckets: int) -> DataFrame:
    """Of each bucket: for bands (BANDS, head, key): keys that share a band hash with another key, with the least of them; else (PLACES, null, key, doc_id, first, words) of keys that two documents or more hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in consecutive(batches, 2):
            kind = bucket.column(1)[0].as_py()
            keys = _joined(bucket.column(3), np.int64)
            if kind != BANDS:
                ids, first, words = [], [], []
                for own, places, n in zip(bucket.column(4).to_pylist(), bucket.column(5).to_pylist(), (len(k.as_py()) // 8 for k in bucket.column(3)), strict=True):
                    ids.append(np.frombuffer(own, np.int64)[np.frombuffer(places[: 2 * n], np.uint16)])
                    first.append(np.frombuffer(places[2 * n : 6 * n], np.uint32))
                    words.append(np.frombuffer(places[6 * n :], np.uint32))
                ids = np.concatenate(ids)
                some = np.arange(len(keys))
                if kind == PLACES:
                    order = np.argsort(keys, kind="stable")
                    k, i = keys[order], ids[order]
                    heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                    several = np.minimum.reduceat(i, heads) != np.maximum.reduceat(i, heads)
                    some = order[np.repeat(several, np.diff(np.concatenate([heads, [len(k)]])))]
                first, words = np.concatenate(first)[some].astype(np.int64), np.concatenate(words)[some].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), PLACES, np.int32)), pa.nulls(len(some), pa.int64()), *[pa.array(x) for x in (keys[some], ids[some], first, words)]], _MET)
                continue
            raw = np.zeros((len(keys), 8), np.uint8)
            raw[:, 3:] = np.frombuffer(b"".join(x.as_py() for x in bucket.column(2)), np.uint8).reshape(-1, 5)
            h = raw.view("<u8").ravel()
            order = np.argsort(h, kind="stable")
            hs = h[order]
            new = np.concatenate([[True], hs[1:] != hs[:-1]])
            order = order[~(new & np.concatenate([new[1:], [True]]))]  # a hash that occurs once is out at once
            order = order[np.lexsort((keys[order], h[order]))]
            h, k = h[order], keys[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])[: len(h)]
            h, k = h[once], k[once]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[: len(h)]
            many = np.diff(np.concatenate([heads, [len(h)]]))
            head, several = np.repeat(k[heads], many), np.repeat(many > 1, many)
            head, k = head[several], k[several]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), BANDS, np.int32)), pa.array(head), pa.array(k), *[pa.nulls(len(k), pa.int64())] * 3], _MET)

    dealt = blobs.repartitionById(buckets, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(tidy(run), "kind int, head long, key long, doc_id long, first long, words long")


_MET = ["kind", "head", "key", "doc_id", "first", "words"]


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """The two places of each key in a filter of size bits (a power of two), one after the other."""
    keys = keys.view(np.uint64)
    return np.concatenate([mix64(keys ^ np.uint64(SEED)), mix64(keys + np.uint64(SEED))]) & np.uint64(size - 1)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column key: words of 64 bits, FILTER_BITS at most however many keys there are."""
    size = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (16 * keys.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(np.asarray(batch.column(0)), size)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    words = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[np.asarray(words.column("word"), np.int64)] = np.asarray(words.column("bits"), np.int64).view(np.uint64)
    return out


def read_again(documents: DataFrame, members: DataFrame) -> DataFrame:
    """members (key) -> (key, n, tokens, doc_id, first, words): where those paragraphs stand, with their shingles in the first row of each task. The documents don't pass a shuffle: a filter of bounded size, sent to all tasks, lets nearly only members through, and more if it is full; the others go by an exact join."""
    sent = documents.sparkSession.sparkContext.broadcast(key_filter(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, met = sent.value, set()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                p = Paragraphs(batch.column(1))
                bits = _bits(p.keys, len(words) << 6)
                held = (words[bits >> np.uint64(6)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)
                some = np.flatnonzero(held[: len(p.keys)] & held[len(p.keys) :])
                if len(some):
                    if len(met) > MEMORY:
                        met.clear()
                    ends = np.cumsum(p.sizes)
                    new = [not (k in met or met.add(k)) for k in p.keys[some].tolist()]
                    tokens = [p.tokens[ends[i] - p.sizes[i] : ends[i]].tobytes() if n else None for i, n in zip(some, new, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p.keys[some]), pa.array(p.sizes[some].astype(np.int32)), pa.array(tokens, pa.binary()), batch.column(0).take(pa.array(p.text[some])), pa.array(p.first[some]), pa.array(p.words[some])],
                        ["key", "n", "tokens", "doc_id", "first", "words"],
                    )

    rows = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "key long, n int, tokens binary, doc_id long, first long, words long")
    return rows.join(members.select("key"), "key", "left_semi")


def repeated_paragraphs(documents: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """documents (doc_id, text, ...) -> a row for each paragraph in a cluster that spans two documents or more, where it is part of a passage of `least` shingles or more.

    Columns: doc_id, first_word (place in the text, from 0), n_words, cluster (the least key of its paragraphs), removed: all
    but the first paragraph of a cluster, by doc_id and place. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered, and a passage is a
    run of such paragraphs without a gap. Every passage of 51 words or more that two documents share word for word gives
    rows in both. Null and blank texts and null doc_ids give nothing, an empty table no rows. Rows that repeat a doc_id are
    one document: their paragraphs are told apart by place alone and don't repeat each other. Texts may be of any length.
    """
    docs = documents.where("doc_id is not null and text is not null")
    buckets = max(2 * documents.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(documents) // BUCKET_BYTES))
    met = stored(met_blobs(paragraph_blobs(docs, buckets), buckets), "paragraphs-met")
    posted = met.where(F.col("kind") == BANDS).select(F.col("head").alias("sig"), "key")
    again = stored(read_again(docs, stored(posted.select("key").distinct(), "paragraph-members")), "paragraph-sets")
    sets = again.where("tokens is not null").groupBy("key").agg(F.min("n").alias("n"), F.min("tokens").alias("tokens"))
    component = linked_classes(posted, sets, percent)
    held = met.where(F.col("kind") == PLACES).select("key", "doc_id", "first", "words")
    near = again.select("key", "doc_id", "first", "words").join(component.select(F.col("id").alias("key")), "key", "left_semi")
    found = held.union(near).distinct().join(component.withColumnRenamed("id", "key"), "key", "left").withColumn("cluster", F.coalesce("component", "key"))
    found = stored(found.select("doc_id", "first", "words", "cluster"), "paragraphs-found")
    first = found.groupBy("cluster").agg(F.min(F.struct("doc_id", "first")).alias("head"), F.max("doc_id").alias("last")).where("head.doc_id <> last").select("cluster", "head")
    first = stored(first, "paragraph-clusters")  # a table of its own, so that the join may split a hot cluster
    found = found.join(first, "cluster")
    order = Window.partitionBy("doc_id").orderBy("first", "words")
    gap = F.coalesce(F.col("first") > F.max(F.col("first") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    runs = found.withColumn("gap", gap.cast("int")).withColumn("passage", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "passage")
    runs = runs.withColumn("length", F.max(F.col("first") + F.col("words")).over(whole) - F.min("first").over(whole))
    return runs.where(F.col("length") >= least).select(
        "doc_id", F.col("first").alias("first_word"), F.col("words").alias("n_words"), "cluster", (F.struct("doc_id", "first") != F.col("head")).alias("removed")
    )


def without_repeats(documents: DataFrame, **options: int) -> DataFrame:
    """documents with the words of removed paragraphs, and the white space after them, cut out of their texts; all columns stay. Rows without such a paragraph, null texts and null doc_ids stay as they are."""
    gone = repeated_paragraphs(documents, **options).where("removed").groupBy("doc_id").agg(F.flatten(F.collect_set(F.sequence("first_word", F.col("first_word") + F.col("n_words") - 1))).alias("_gone"))
    gone = gone.withColumn("_gone", F.map_from_arrays(F.array_distinct("_gone"), F.array_repeat(F.lit(True), F.size(F.array_distinct("_gone")))))
    space = r"[\x20\x09-\x0D]"
    words = F.regexp_extract_all("text", F.lit(f"{WORD}{space}*"), F.lit(0))
    head = F.regexp_extract("text", f"^{space}*", 0)
    kept = F.filter(words, lambda _, i: ~F.coalesce(F.map_contains_key("_gone", i.cast("long")), F.lit(False)))
    joined = documents.join(gone, documents["doc_id"].cast("long") == gone["doc_id"], "left").select(documents["*"], gone["_gone"])
    return joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.concat(head, F.array_join(kept, "")))).select(documents.columns)


def op9_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents"))
