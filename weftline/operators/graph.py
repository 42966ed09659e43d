"""The link graph: edges, degrees, depth, rank, redirects and dead links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tables import cut
from weftline.functions.urls import host, path, query

DAMPING = 0.85
ITERATIONS = 50
COMPACT_EVERY = 8
ANCHORS = 5
#: Links and nodes that one task holds, at most.
ONE_TASK = 2_000_000
#: Nodes of which the driver holds numbers, at most; links in a block; nodes that are numbered in one place.
DRIVER = 8_000_000
BLOCK = 500_000
NUMBERED = 200_000


def edges(anchors: DataFrame) -> DataFrame:
    """anchors (from, to, ord, text, nofollow, placement, internal) -> one row a pair with counts, placements and the first ANCHORS different texts, sorted."""
    spot = lambda p: F.count_if(F.col("placement") == p).alias(p)
    pair = ["from", "to"]
    total = anchors.groupBy(*pair).agg(F.bool_or("internal").alias("internal"), F.count(F.lit(1)).alias("total"), F.count_if(~F.col("nofollow")).alias("followable"), F.count_if("nofollow").alias("nofollow"), spot("navigation"), spot("content"), spot("unknown"))
    texts = anchors.where("text <> ''").groupBy(*pair, "text").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("occurrences"))
    texts = texts.withColumn("place", F.row_number().over(Window.partitionBy(*pair).orderBy("first"))).where(F.col("place") <= ANCHORS)
    texts = texts.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("text", "occurrences"))).alias("anchors"))
    return total.join(texts, pair, "left")


def degrees(edges: DataFrame) -> DataFrame:
    """edges (from, to, total) -> url, in/out degree, by occurrence and by different URL."""
    out = edges.groupBy(F.col("from").alias("url")).agg(F.sum("total").alias("out_degree"), F.count(F.lit(1)).alias("unique_out"))
    into = edges.groupBy(F.col("to").alias("url")).agg(F.sum("total").alias("in_degree"), F.count(F.lit(1)).alias("unique_in"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "unique_in", "out_degree", "unique_out")]
    return out.join(into, "url", "full_outer").select("url", *filled)


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges (from, to), roots (url) -> url, depth: fewest steps from a root; unreachable nodes are left out. One join and one table a level; every COMPACT_EVERY levels those tables become one."""
    known = cut(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier, links = known, cut(edges.select(F.col("from").alias("url"), "to").distinct())
    level = 0
    while True:
        level += 1
        new = links.join(frontier.select("url"), "url").select(F.col("to").alias("url")).distinct().join(known, "url", "left_anti").withColumn("depth", F.lit(level))
        frontier = cut(new)
        if not frontier.head(1):
            return known
        known = known.union(frontier)
        if level % COMPACT_EVERY == 0:
            known = cut(known)


def _rank(parts: Iterator[pd.DataFrame], iterations: int, damping: float) -> Iterator[pd.DataFrame]:
    """The whole graph in one place: rows (from, to), to being null for each node."""
    rows = pd.concat(list(parts), ignore_index=True)
    urls = np.sort(rows["from"][rows["to"].isna()].unique())
    rows = rows[rows["to"].notna()]
    n, a, b = len(urls), np.searchsorted(urls, rows["from"]), np.searchsorted(urls, rows["to"])
    outs = np.bincount(a, minlength=n)
    rank = np.full(n, 1 / max(1, n))
    for _ in range(iterations):
        given = np.bincount(b, rank[a] / outs[a], minlength=n)
        rank = (1 - damping) / n + damping * (given + rank[outs == 0].sum() / n)
    yield pd.DataFrame({"url": urls, "rank": rank, "score": (rank / rank.max() * 100).round(2) if n else rank})


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """nodes (url), edges (from, to) -> url, rank, score: a fixed number of iterations; a node without out-links spreads its rank over all; score is rank with the largest as 100, two decimals.

    Links count once and only between nodes; loops stay. A graph of up to ONE_TASK links and nodes, counted first, goes
    through one task. Of up to DRIVER nodes, the driver holds a number each, and tasks hold the links, see _rank_blocks().
    Beyond that each iteration joins the links with the ranks, sums by target and writes the ranks.
    """
    spark = nodes.sparkSession
    nodes, edges = cut(nodes.select("url").distinct()), cut(edges.select("from", "to"))
    n = nodes.count()
    if not n:
        return nodes.select("url", F.lit(0.0).alias("rank"), F.lit(0.0).alias("score"))
    if n + edges.count() <= ONE_TASK:
        links = edges.distinct().join(nodes.withColumnRenamed("url", "from"), "from", "left_semi").join(nodes.withColumnRenamed("url", "to"), "to", "left_semi")
        rows = links.select("from", "to").union(nodes.select("url", F.lit(None).cast("string")))
        return rows.coalesce(1).mapInPandas(lambda parts: _rank(parts, iterations, damping), "url string, rank double, score double")
    nodes = _numbered(nodes, n)
    a, b = (nodes.select(F.col("url").alias(c), F.col("number").alias(k)) for c, k in (("from", "a"), ("to", "b")))
    links = edges.where("`from` is not null and `to` is not null").join(a, "from").join(b, "to").select("a", "b").distinct()
    if n <= DRIVER:
        rank = spark.sparkContext.broadcast(_rank_blocks(links, n, iterations, damping))
        most = float(rank.value.max())

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = rank.value[np.asarray(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array((own / most * 100).round(2))], ["url", "rank", "score"])

        return nodes.select("url", "number").mapInArrow(named, "url string, rank double, score double")
    links = cut(links)
    links = cut(links.join(links.groupBy("a").agg(F.count(F.lit(1)).alias("outs")), "a"))
    dangling = cut(nodes.select(F.col("number").alias("a")).join(links.select("a").distinct(), "a", "left_anti"))
    ranks = nodes.select(F.col("number").alias("a"), F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        lost = ranks.join(dangling, "a", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = links.join(ranks, "a").groupBy(F.col("b").alias("a")).agg(F.sum(F.col("rank") / F.col("outs")).alias("given"))
        ranks = cut(nodes.select(F.col("number").alias("a")).join(given, "a", "left").select("a", (F.lit((1 - damping) / n) + damping * (F.coalesce("given", F.lit(0.0)) + lost / n)).alias("rank")))
    most = ranks.agg(F.max("rank")).first()[0]
    return nodes.join(ranks.withColumnRenamed("a", "number"), "number").select("url", "rank", F.round(F.col("rank") / most * 100, 2).alias("score"))


def _numbered(nodes: DataFrame, n: int) -> DataFrame:
    """nodes (url, each once) with a number from 0 to n - 1: by parts of a hash, and inside a part by URL."""
    spark, parts = nodes.sparkSession, -(-n // NUMBERED)
    nodes = nodes.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int"))
    sizes = np.zeros(parts, np.int64)
    for r in nodes.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    first = spark.createDataFrame(list(enumerate((np.cumsum(sizes) - sizes).tolist())), "part int, first long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("url")) - 1
    return cut(nodes.withColumn("place", place).join(F.broadcast(first), "part").select("url", (F.col("first") + F.col("place")).alias("number")))


def _rank_blocks(links: DataFrame, n: int, iterations: int, damping: float) -> np.ndarray:
    """links (a, b), each once -> the rank of each of n nodes.

    Links are sorted by target and kept in blocks, in a table. An iteration reads the blocks and returns a sum for each target
    in one; the links themselves never move again. A target with many links may stand in several blocks.
    """
    spark = links.sparkSession

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of BLOCK links: their sources, the different targets, and where each target's sources begin."""
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if sum(x.num_rows for x in held) < (BLOCK if batch is not None else 1):
                continue
            a, b = (np.concatenate([np.asarray(x.column(i)) for x in held]) for i in (0, 1))
            targets, begins = np.unique(b, return_index=True)
            held = []
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (a, targets, begins)], ["sources", "targets", "begins"])

    links = cut(links)
    blocks = cut(links.repartitionByRange("b", "a").sortWithinPartitions("b", "a").mapInArrow(packed, "sources binary, targets binary, begins binary").withColumn("id", F.monotonically_increasing_id()))
    outs = np.zeros(n)
    told = links.groupBy("a").count().toArrow()
    outs[np.asarray(told.column(0))] = np.asarray(told.column(1))
    ends = {r.id: np.frombuffer(r.targets, np.int64) for r in blocks.select("id", "targets").toLocalIterator()}
    dangling = outs == 0
    rank = np.full(n, 1 / n)
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast(rank / np.maximum(outs, 1))

        def summed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = [np.add.reduceat(sent.value[np.frombuffer(a, np.int64)], np.frombuffer(at, np.int64)).tobytes() for a, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.binary())], ["id", "sums"])

        given = np.zeros(n)
        for r in blocks.select("id", "sources", "begins").mapInArrow(summed, "id long, sums binary").collect():
            given[ends[r.id]] += np.frombuffer(r.sums)
        sent.destroy()
        rank = (1 - damping) / n + damping * (given + rank[dangling].sum() / n)
    return rank


def terminals(redirects: DataFrame) -> DataFrame:
    """redirects (url, to) -> url, terminal: the end of each chain; of a chain into a loop, the URL where the loop closes.

    Pointers double each round, so a chain of n takes log n joins. Only rows that haven't ended are carried on. A round in
    which none ends leaves nothing but ways into loops: where a chain has a distance to its end, a URL with each smaller
    distance stands on it. Those rows double on until they surely stand inside a loop; what they name are the loops' URLs,
    and the ways that lead there are chains that end at them. A URL that redirects to itself is its own end.
    """
    hops = cut(redirects.groupBy("url").agg(F.min("to").alias("terminal")))
    return _chased(hops)


def _chased(hops: DataFrame) -> DataFrame:
    ended = [hops.where("url = terminal")]
    now = cut(hops.where("url <> terminal"))
    left, rounds = now.count(), 0
    moving = True
    while left and moving:
        known = now.select("url", "terminal", F.lit(False).alias("over"))
        for df in ended:
            known = known.unionByName(df.select("url", "terminal", F.lit(True).alias("over")))
        known = known.select(F.col("url").alias("terminal"), F.col("terminal").alias("next"), "over")
        step = cut(now.join(known, "terminal", "left").select("url", F.coalesce("next", "terminal").alias("terminal"), F.coalesce("over", F.lit(True)).alias("over")))
        ended.append(step.where("over").select("url", "terminal"))
        now, before, rounds = step.where("not over").select("url", "terminal"), left, rounds + 1
        left = now.count()
        moving = left < before
    out = ended[0]
    for df in ended[1:]:
        out = out.unionByName(df)
    if not left:
        return out
    while 2**rounds < left:
        now = cut(now.join(now.select(F.col("url").alias("terminal"), F.col("terminal").alias("next")), "terminal").select("url", F.col("next").alias("terminal")))
        rounds += 1
    loops = cut(now.select(F.col("terminal").alias("url")).distinct())
    ways = hops.join(now.select("url"), "url", "left_semi").join(loops, "url", "left_anti")
    return out.unionByName(loops.select("url", F.col("url").alias("terminal"))).unionByName(_chased(ways))


#: Answers that came from no server, by error code; others are unknown.
UNVERIFIED = {"REDIRECT_LIMIT": "redirect-limit", "BODY_TOO_LARGE": "body-too-large", "TIMEOUT": "unreachable", "UNREACHABLE": "unreachable"}


def dead_links(edges: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """edges (from, to[, type, internal]), pages (url, state, status, error_code), redirects (url, to) -> from, to, terminal, verdict, reason, status for links whose target isn't a working page.

    Only internal anchors count, where edges tell. A link is judged by the page at the end of its redirects; one that was
    never visited says nothing and gives no row. 429 says nothing about the link either, nor does a failure without a
    status: those are unverified. Any other status of 400 or more is dead. The end of a loop is a redirect like any other.
    """
    if "type" in edges.columns:
        edges = edges.where("type = 'anchor'")
    if "internal" in edges.columns:
        edges = edges.where("internal")
    end = edges.select("from", "to").join(terminals(redirects).withColumnRenamed("url", "to"), "to", "left").withColumn("terminal", F.coalesce("terminal", "to"))
    got = end.join(pages.select(F.col("url").alias("terminal"), "state", "status", "error_code"), "terminal")
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in UNVERIFIED.items() for x in kv]), F.upper("error_code")), F.lit("unknown"))
    reason = F.when(F.col("status") == 429, "throttled").when(F.col("state").isin("error", "fetch-error") & F.col("status").isNull(), named).when(F.col("status") >= 400, "http-error")
    verdict = F.when(reason == "http-error", "dead").otherwise("unverified")
    return got.withColumn("reason", reason).where("reason is not null").select("from", "to", "terminal", verdict.alias("verdict"), "reason", "status")


def _site(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def version_copy(url: Column, canonical: Column) -> Column:
    """Whether a query URL's canonical (a crawl key) says it is a copy: the same host (without www.) and path with another query, or none. Null without a canonical."""
    return (query(url) != "") & (_site(url) == _site(canonical)) & (path(url) == path(canonical)) & (query(url) != query(canonical))


def version_pattern(url: Column) -> Column:
    """struct<host, section, params> of a query URL, null of others: the first segment of its path and the sorted names of its parameters, their values left out."""
    params = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query(url), "&"), lambda p: F.substring_index(p, "=", 1)))), ",")
    section = F.concat(F.lit("/"), F.substring_index(F.regexp_replace(path(url), "^/", ""), "/", 1))
    return F.when(query(url) != "", F.struct(host(url).alias("host"), section.alias("section"), params.alias("params")))


def url_versions(urls: DataFrame) -> DataFrame:
    """urls (url, canonical) -> host, section, params, copies, distinct_pages, example: patterns of query URLs, how many of their pages are copies (see version_copy), and the least copy's URL."""
    copy = F.coalesce(version_copy(F.col("url"), F.col("canonical")), F.lit(False))
    rows = urls.select("url", version_pattern(F.col("url")).alias("p"), copy.alias("copy")).where("p is not null").select("url", "p.*", "copy")
    return rows.groupBy("host", "section", "params").agg(F.count_if("copy").alias("copies"), F.count_if(~F.col("copy")).alias("distinct_pages"), F.min(F.when(F.col("copy"), F.col("url"))).alias("example"))
