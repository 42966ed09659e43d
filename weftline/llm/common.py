"""Helpers shared by the corpus operators: shared storage, and words and shingles in batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/weftline-checkpoints"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that all executors share")
        told = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_uri(spark: SparkSession, name: str) -> str:
    """shared_path with the scheme of its store, for files that workers open themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, name))
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    if path := getattr(df, "_weftline_path", None):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df, from file sizes, without a job; where it has none (rows that don't come from files), the bytes of df's strings, counted."""
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if told < 1 << 50:
        return told
    texts = [F.sum(F.octet_length(f.name)) for f in df.schema if f.dataType.simpleString() == "string"]
    return int(df.agg(F.coalesce(sum(texts[1:], texts[0]), F.lit(0))).first()[0]) if texts else 0


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives free memory back now and then and at its end: Python workers live on, and the next stage uses them."""

    @wraps(batches)
    def run(rows: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        for n, batch in enumerate(batches(rows), 1):
            yield batch
            del batch
            if n % 16 == 0:
                _release()
        _release()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def string_hashes(words: pa.Array) -> np.ndarray:
    """xxh3_64 of each string, computed once for each distinct one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    enc = words.dictionary_encode()
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, enc.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(enc.dictionary))
    return one[enc.indices.to_numpy(zero_copy_only=False)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of A-Z-lowered texts (null: none): their hashes, and for each text the offset where its words begin, with a last one."""
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")  # a copy: ascii_lower misreads slices
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = pc.list_flatten(split), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split)))])
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))
    return string_hashes(flat.filter(pa.array(some))), np.concatenate([[0], np.cumsum(some)])[offsets].astype(np.int64)


_MULTIPLIERS = mix64(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of the whole sequence where it is shorter; none of no words."""
    n = len(words)
    if not n:
        return words
    k = min(n, SHINGLE_WORDS)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            h += words[i : n - k + 1 + i] * _MULTIPLIERS[i]
    return mix64(h)


def three_word_runs(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of three words."""
    with np.errstate(over="ignore"):
        return mix64(words[:-2] * _MULTIPLIERS[0] + words[1:-1] * _MULTIPLIERS[1] + words[2:] * _MULTIPLIERS[2])


def shingled(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of texts, whose words lie one after the other: place of the first word, text, hash, and anchor: the
    least hash of its three-word runs, which neighbouring shingles often share; of a text with fewer words its only hash."""
    many = np.diff(at)
    owner = np.repeat(np.arange(len(many)), many)
    start = np.flatnonzero(at[1:][owner] - np.arange(len(words)) >= SHINGLE_WORDS)
    if len(start):
        h, runs = shingles(words)[start], three_word_runs(words)
        anchor = np.minimum(np.minimum(runs[start], runs[start + 1]), runs[start + 2])
    else:
        h = anchor = words[:0]
    few = np.flatnonzero((many > 0) & (many < SHINGLE_WORDS))
    if len(few):
        one = np.array([shingles(words[at[i] : at[i + 1]])[0] for i in few], np.uint64)
        start, h, anchor = np.concatenate([start, at[few]]), np.concatenate([h, one]), np.concatenate([anchor, one])
    own = owner[start] if len(start) else np.zeros(0, np.int64)
    if len(few):
        order = np.argsort(start, kind="stable")
        start, own, h, anchor = start[order], own[order], h[order], anchor[order]
    return start, own, h, anchor


def distinct(own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the distinct (own, h), in order, the first place of each."""
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    return order[np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])])] if len(order) else order


def set_keys(own: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n sets of distinct hashes (own, h; sorted by own) the sizes, and keys: the mixed sum of mixed hashes, alike for equal sets."""
    sizes = np.bincount(own, minlength=n).astype(np.int64)
    sums = np.zeros(n, np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        with np.errstate(over="ignore"):
            sums[some] = np.add.reduceat(mix64(h ^ np.uint64(0xA0761D6478BD642F)), (np.cumsum(sizes) - sizes)[some])
            return sizes, mix64(sums + sizes.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)
    return sizes, sums.view(np.int64)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes over the given links."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
        if np.array_equal(before, root) and not len(left):
            break
    return root
