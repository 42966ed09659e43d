"""Embedding near-dedup by sorted projection passes.

In each pass a vector's key is a concatenation of random hyperplane bits. Vectors of a label are sorted by key, each is
compared with a bounded window of neighbours and, however many those are, with all that share its key's first bits; pairs
found similar are united, and several passes are united in turn. How many bits count follows from the size of the label,
and the number of passes from how often a pair at the threshold agrees in them, so that recall doesn't depend on how a
label's vectors are spread: a dense label only costs more. Inside each component, the links of every vector are then
counted exactly, tile against tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import local_roots, stored, table
from weftline.llm.components import connected_components
from weftline.llm.streams import consecutive

COSINE = 0.98
WINDOW = 64
KEY_BITS = 48
#: A pair at the threshold is missed by all passes with this probability at most.
MISS = 1e-4
#: Bits fewer by which keys are dealt out, so that neighbours by key mostly stay together; and rows of a bucket that are compared in one place.
BLOCKS = 5
BUCKET = 8192
CHUNK = 512
TILE = 1024
SEED = 7


def usable(vector: str) -> Column:
    """Not null, with no null or non-finite component, and not zero."""
    return F.expr(f"{vector} is not null and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({vector}, x -> x <> 0)")


def rows_of(column: pa.Array) -> np.ndarray:
    """A batch of equally long lists as rows of doubles."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def prefix_bits(rows: int) -> int:
    """First bits of a key that vectors have to share to be compared: of so many evenly spread ones, fewer than WINDOW do."""
    return min(KEY_BITS, max(0, math.ceil(math.log2(max(1, rows) / WINDOW)) + 1))


def passes_for(rows: int, cosine: float) -> int:
    """Passes needed so that MISS holds: a pair is compared in a pass in which it agrees on the first bits."""
    agree = 1 - math.acos(cosine) / math.pi
    return max(3, math.ceil(math.log(MISS) / math.log(1 - agree ** prefix_bits(rows)))) if prefix_bits(rows) else 1


def projection_links(vectors: DataFrame, rows: int, cosine: float = COSINE) -> DataFrame:
    """vectors (id, grp, dim, vector), rows of the largest group -> links (a, b) that connect all that windows find similar inside a group: of each chunk of the sorted stream a spanning forest, so no more rows than the chunk has, however many pairs.

    Keys are dealt out by their first bits, less BLOCKS of them, so no pair that shares those that count is parted; a
    bucket of more than BUCKET rows is cut in tiles by a hash, and each pair of tiles is sorted and compared by itself.
    """
    passes, bits = passes_for(rows, cosine), prefix_bits(rows)
    coarse = KEY_BITS - max(0, bits - BLOCKS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in set(batch.column(2).to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column(2), dim))
                x = rows_of(part.column(3))
                planes = np.random.default_rng(SEED).standard_normal((passes, dim, KEY_BITS))
                for p in range(passes):
                    key = ((x @ planes[p] > 0) @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), part.column(1), part.column(2), pa.array(key >> coarse), pa.array(key), part.column(0), part.column(3)], ["pass", "grp", "dim", "bucket", "key", "id", "vector"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in consecutive(batches, 6):
            ids, key = np.asarray(run.column(7)), np.asarray(run.column(6))
            x = rows_of(run.column(8))
            x = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
            block = key >> (KEY_BITS - bits)
            begins = np.searchsorted(block, block)
            for at in range(0, len(ids), CHUNK):
                low = int(max(0, min(at - WINDOW, begins[at])))
                some, own = x[low : at + CHUNK], x[at : at + CHUNK]
                i, j = np.nonzero(own @ some.T >= cosine)
                i += at - low
                near = (j < i) & ((i - j <= WINDOW) | (begins[low + i] <= low + j))
                root = local_roots(len(some), i[near], j[near])
                moved = np.flatnonzero(root != np.arange(len(some)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[low + moved]), pa.array(ids[low + root[moved]])], ["a", "b"])

    kind = vectors.schema["vector"].dataType.simpleString()
    at = ["pass", "grp", "dim", "bucket"]
    keyed = vectors.select("id", "grp", "dim", "vector").mapInArrow(keys, f"pass int, grp long, dim int, bucket long, key long, id long, vector {kind}")
    wide = stored(keyed.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("tiles")).where("tiles > 1"), "wide-buckets")
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    rows_ = keyed.join(wide, at, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))) if wide.head(1) else keyed.withColumn("tiles", F.lit(1))
    rows_ = rows_.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows_ = rows_.select(*at, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "key", "id", "vector")
    dealt = rows_.repartition(*at, "i", "j").sortWithinPartitions(*at, "i", "j", "key", "id")
    return dealt.mapInArrow(compared, "a long, b long")


def count_links(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """members (component, id, vector, copies) -> (id, links): copies of other vectors of the component with the cosine or more. A component of more than TILE members is cut in tiles, and each pair of tiles is a group of its own."""
    tiles = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("tiles"))
    m = members.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    m = m.select("component", "tile", other, "id", "copies", "vector")
    m = m.select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "copies", "vector")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in consecutive(batches, 3):
            x, copies, ids, tile = rows_of(run.column(6)), np.asarray(run.column(5)), np.asarray(run.column(4)), np.asarray(run.column(3))
            norm = np.linalg.norm(x, axis=1)
            first = tile == run.column(1)[0].as_py()
            if run.column(1)[0] == run.column(2)[0]:
                near = (x @ x.T / np.outer(norm, norm)) >= cosine
                np.fill_diagonal(near, False)
                links = near @ copies
            else:
                near = (x[first] @ x[~first].T / np.outer(norm[first], norm[~first])) >= cosine
                links = np.zeros(len(ids), np.int64)
                links[first], links[~first] = near @ copies[~first], near.T @ copies[first]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64))], ["id", "links"])

    dealt = m.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _group(embeddings: DataFrame) -> Column:
    """The label as a number: itself where it is whole, else a 64-bit hash of its text."""
    whole = embeddings.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "boolean")
    return F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """embeddings (vec_id, embedding, label, ...) -> vec_id, n_links, component_id, kept.

    Vectors are compared inside one label and one length only. A null label, a null or zero vector, and one with null or
    non-finite components link with nothing: n_links 0, a component of its own. Equal vectors count as links of each other
    and are compared with the rest once. Repeated rows are rows of their own with their vec_id; an empty table gives no rows.
    Links are exact inside a component; a component may fall apart only where all passes miss, see MISS.
    """
    group = _group(embeddings)
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector"), group.alias("grp"), F.size("embedding").alias("dim"))
    fit = rows.where(usable("vector") & F.col("grp").isNotNull() & F.col("vec_id").isNotNull())
    classes = fit.groupBy("grp", "dim", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "vector-classes")
    largest = classes.groupBy("grp", "dim").count().agg(F.max("count")).first()[0] or 0
    links = projection_links(classes, largest, cosine)
    parts = stored(connected_components(links), "vector-components")
    members = classes.join(parts, "id").select("component", "id", "copies", "vector")
    counted = count_links(members, cosine).join(parts, "id")
    known = classes.join(counted, "id", "left").select(
        F.col("grp").alias("g"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    whole = embeddings.select("vec_id", F.col("embedding").alias("v"), group.alias("g"))
    able = usable("v") & F.col("g").isNotNull() & F.col("vec_id").isNotNull()
    linked = whole.where(able).join(known, ["g", "v"]).select("vec_id", "n_links", "component_id")
    alone = whole.where(~F.coalesce(able, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with recursive v as (
  select vec_id, label, case when len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 then embedding::double[] end as e from embeddings),
u as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where case when len(a.e) = len(b.e) then list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98 else false end),
n as (select a, count(*) as n from l group by a),
r as (select vec_id, vec_id as seen from v union select r.vec_id, l.b from r join l on l.a = r.seen),
m as (select vec_id, min(seen) as c from r group by vec_id)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, m.c as component_id, v.vec_id = m.c as kept from v join m on v.vec_id = m.vec_id left join n on n.a = v.vec_id
"""
