"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. A block of vectors keeps for each of them a row with the weight of
every pivot: the nearest one weighs most, those beyond the prefix nothing. The product of two such rows orders vectors as
Spearman's rho between their permutations does; those that come first for a query are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import stored, table
from weftline.llm.streams import consecutive
from weftline.llm.vectors import rows_of, usable

NEIGHBOURS = 10
QUERY_EVERY = 100
#: Pivots, drawn from so many vectors by a hash of their id; and how many of them represent a vector.
PIVOTS = 256
PREFIX = 64
#: The share of a block's vectors that is compared exactly, and the least number. Vectors without structure need a large one.
RERANK = 0.2
RERANK_LEAST = 64
#: Vectors in a block of the index, and queries in a block.
BLOCK = 4096
QUERIES = 256
#: Memory of the blocks that meet the queries in one task, and the number of tasks below which blocks aren't put together.
SHELF_BYTES = 128 << 20
SHELVES = 48
#: Partitions that shelves are dealt to, at most.
TASKS = 960


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each row of x its nearest pivots in order, ties to the smaller number."""
    d = (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


def weights(order: np.ndarray, pivots: int) -> np.ndarray:
    """A row for each permutation: what is left of its prefix at each pivot's place, 0 for those beyond it. All rows are of one length, so the product of two falls as Spearman's rho rises; it is whole and exact in single precision."""
    out = np.zeros((len(order), pivots), np.float32)
    np.put_along_axis(out, order, np.arange(order.shape[1], 0, -1, dtype=np.float32)[None], 1)
    return out


def shelves_of(rows: int, dim: int) -> int:
    """Shelves for so many vectors: one for each block up to SHELVES, then as many as memory asks for."""
    blocks, full = -(-rows // BLOCK), max(1, SHELF_BYTES // (BLOCK * (12 * dim + 4 * PIVOTS)))
    return min(blocks, max(SHELVES, -(-blocks // full)))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


class Block:
    """Vectors of one block with their weights, and rough copies: scaled to at most 1 and in single precision."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        self.ids, self.x = ids, x
        self.weights = weights(nearest_pivots(x, pivots, min(PREFIX, len(pivots))), len(pivots))
        self.scale = np.abs(x).max()
        self.rough = (x / self.scale).astype(np.float32)
        self.norms = np.linalg.norm(x / self.scale, axis=1)

    def nearest(self, own: np.ndarray, q: np.ndarray, asked: np.ndarray, depth: int, k: int, bound: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (own id, vector, weights) up to k (ids, distances), nearest first, of the depth vectors that its permutation puts first; those farther than its bound may be left out.

        Candidates are compared in single precision; all that its error leaves possible are compared in doubles.
        """
        near = asked @ self.weights.T
        n = len(self.ids)
        first = np.argpartition(near, n - depth, axis=1)[:, n - depth :] if depth < n else np.tile(np.arange(n), (len(own), 1))
        with np.errstate(over="ignore", invalid="ignore"):
            rough, norms = (q / self.scale).astype(np.float32), np.linalg.norm(q / self.scale, axis=1)
        slack = (q.shape[1] + 8) * 2.0**-21
        out = []
        for i, some in enumerate(first):
            some = some[self.ids[some] != own[i]]
            with np.errstate(over="ignore", invalid="ignore"):
                size = self.norms[some] ** 2 + norms[i] ** 2
                d = size - 2.0 * (self.rough[some] @ rough[i])
                error = 2 * slack * size + 1e-30
            if np.isfinite(d).all() and np.isfinite(error).all():
                most = (bound[i] / self.scale) ** 2 * (1 + 1e-9)
                if len(d) > k:
                    most = min(most, np.partition(d + error, k - 1)[k - 1])
                some = some[d - error <= most]
            exact = distances(q[i], self.x[some])
            best = np.lexsort((self.ids[some], exact))[:k]
            out.append((self.ids[some][best], exact[best]))
        return out


def search(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = QUERY_EVERY, rerank: float = RERANK) -> DataFrame:
    """embeddings (vec_id, embedding, ...): the k nearest that are found of each query, a row whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    score is the Euclidean distance in doubles between the original vectors; ties go to the smaller vec_id. A query never
    finds rows of its own vec_id. Vectors that are null, zero or hold null or non-finite components, and rows with a null
    vec_id, take no part; lengths don't mix. Fewer candidates than k give them all; rows that repeat a vec_id count as one (the
    first by vector); no queries or an empty table give no rows. Pivots are fitted on PIVOTS vectors of each length, chosen
    by a hash of vec_id; every vector is indexed.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    rows = rows.where(usable("vector") & F.col("id").isNotNull()).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = stored(rows.withColumn("dim", F.size("vector")), "index-vectors")
    dims = [r.dim for r in rows.select("dim").distinct().collect()]
    pivots = {}
    for dim in dims:
        got = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("vector").collect()
        pivots[dim] = np.array([r.vector for r in got], np.float64)
    sent = spark.sparkContext.broadcast(pivots)
    counts = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).collect()}
    blocks = F.element_at(F.create_map(*[F.lit(x).cast("int") for d, (n, _) in counts.items() for x in (d, -(-n // BLOCK))]), F.col("dim")) if counts else F.lit(1)
    shelves = F.element_at(F.create_map(*[F.lit(x).cast("int") for d, (n, _) in counts.items() for x in (d, shelves_of(n, d))]), F.col("dim")) if counts else F.lit(1)
    parts = F.element_at(F.create_map(*[F.lit(x).cast("int") for d, (_, q) in counts.items() for x in (d, max(1, -(-q // QUERIES)))]), F.col("dim")) if counts else F.lit(1)

    tasks = min(TASKS, max(1, sum(shelves_of(n, d) for d, (n, _) in counts.items())))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a shelf's blocks, then of the queries that meet them."""
        shelf: list[Block] = []
        last = None
        for run in consecutive(batches, 4):
            dim, number, part = (run.column(i)[0].as_py() for i in range(3))
            if last != (dim, number):
                shelf, last = [], (dim, number)
            x, ids, p = rows_of(run.column(5)), np.asarray(run.column(4)), sent.value[dim]
            if part < 0:
                shelf.append(Block(ids, x, p))
                continue
            for at in range(0, len(ids) if shelf else 0, QUERIES):
                own, q = ids[at : at + QUERIES], x[at : at + QUERIES]
                asked = weights(nearest_pivots(q, p, min(PREFIX, len(p))), len(p))
                best = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
                bound = np.full(len(own), np.inf)
                for block in shelf:
                    depth = min(len(block.ids), max(RERANK_LEAST, k + 1, int(np.ceil(rerank * len(block.ids)))))
                    for i, (some, d) in enumerate(block.nearest(own, q, asked, depth, k, bound)):
                        if len(some):
                            some, d = np.concatenate([best[i][0], some]), np.concatenate([best[i][1], d])
                            first = np.lexsort((some, d))[:k]
                            best[i] = some[first], d[first]
                            bound[i] = d[first[-1]] if len(first) == k else np.inf
                of = np.repeat(own, [len(some) for some, _ in best])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate([some for some, _ in best])), pa.array(np.concatenate([d for _, d in best]))], ["query_id", "vec_id", "score"])

    block = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    dealt = rows.select("dim", F.pmod(block, shelves).alias("shelf"), F.lit(-1).alias("part"), block.alias("block"), "id", "vector")
    asked = rows.where(F.col("id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), shelves - 1)).alias("shelf"), F.pmod(F.xxhash64("id", F.lit(2)), parts).cast("int").alias("part"), F.lit(0).alias("block"), "id", "vector")
    together = dealt.unionByName(asked).repartition(tasks, "dim", "shelf").sortWithinPartitions("dim", "shelf", "part", "block", "id")
    found = together.mapInArrow(find, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # only the first k of a task's rows are sent
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
