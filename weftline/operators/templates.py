"""URL templates: shapes of paths, stratified samples, coverage, and groups of pages that score alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tables import cut
from weftline.functions.text import half_up
from weftline.functions.urls import homepage, route_key, segments

#: A position of a path with more different values than this holds identifiers.
MAX_VALUES = 8
TOLERANCE = 2
LEAST_PAGES = 3


def shapes(urls: DataFrame) -> DataFrame:
    """urls (url, ...) plus template and identifiers: positions that hold identifiers, among paths of the same depth, become *."""
    rows = urls.withColumn("_s", segments(F.col("url"))).withColumn("_d", F.size("_s"))
    values = rows.select("_d", F.posexplode("_s").alias("_p", "_v")).groupBy("_d", "_p").agg(F.count_distinct("_v").alias("n")).where(F.col("n") > MAX_VALUES)
    free = values.groupBy("_d").agg(F.collect_set("_p").alias("_free"))
    rows = rows.join(F.broadcast(free), "_d", "left").withColumn("_free", F.coalesce("_free", F.array().cast("array<int>")))
    star = F.transform("_s", lambda s, i: F.when(F.array_contains("_free", i), "*").otherwise(s))
    held = F.filter("_s", lambda _, i: F.array_contains("_free", i))
    return rows.withColumn("template", F.concat(F.lit("/"), F.array_join(star, "/"))).withColumn("identifiers", held).drop("_s", "_d", "_free")


def sample(items: DataFrame, limit: int, key: str = "template", spread: str | None = None, pin: Column | None = None, rank: tuple[Column, ...] = ()) -> DataFrame:
    """items (ord, key, ...): pinned ones, then one of each key in turn, the largest group first, up to limit; in the order of ord.

    Inside a group items go by rank, then ord; with spread (not null) they are dealt in turn over its values, the most frequent first.
    Round-robin is a sort by (place in the group, place of the group), so no loop runs.
    """
    if limit <= 0:
        return items.limit(0)
    held = items.withColumn("_pin", F.coalesce(pin, F.lit(False)) if pin is not None else F.lit(False))
    inside = [*rank, F.col("ord")]
    rest = held.where(~F.col("_pin"))
    sizes = rest.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    # Only the first `limit` of a group can be taken, and those are picked out before rows are exchanged; counts are taken apart.
    if spread:
        counts = rest.groupBy(key, spread).agg(F.count(F.lit(1)).alias("_n"))
        rest = rest.withColumn("_round", F.row_number().over(Window.partitionBy(key, spread).orderBy(*inside))).where(F.col("_round") <= limit).join(counts, [key, spread])
        inside = [F.col("_round"), F.desc("_n"), F.col(spread)]
    rest = rest.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*inside))).where(F.col("_place") <= limit)
    ranked = rest.join(sizes, key).select("ord", "_place", "_size", key)
    pinned = held.where("_pin").select("ord", F.lit(0).alias("_place"), F.lit(0).cast("long").alias("_size"), F.lit("").alias(key))
    chosen = pinned.unionByName(ranked).orderBy("_place", F.when(F.col("_place") > 0, -F.col("_size")).otherwise(0), F.when(F.col("_place") > 0, F.col(key)).otherwise(""), "ord").limit(limit)
    return items.join(chosen.select("ord"), "ord", "left_semi").orderBy("ord")


def coverage(discovered: DataFrame, audited: DataFrame) -> DataFrame:
    """discovered (url[, ord]), audited (url) -> one row: pages and templates discovered and represented by the audited URLs, and how far the result speaks for the site. Of the URLs of one route the first by ord, or else by URL, names its template."""
    order = F.col("ord") if "ord" in discovered.columns else F.col("url")
    known = shapes(discovered).groupBy(route_key(F.col("url")).alias("route")).agg(F.min_by("template", F.struct(order, F.col("url"))).alias("template"))
    seen = audited.select(route_key(F.col("url")).alias("route")).join(known, "route").agg(F.count_distinct("template").alias("templates_represented"))
    counts = discovered.agg(F.count(F.lit(1)).alias("pages_discovered")).crossJoin(audited.agg(F.count(F.lit(1)).alias("pages_audited")))
    one = counts.crossJoin(known.agg(F.count_distinct("template").alias("templates_discovered"))).crossJoin(seen)  # single rows
    partial = F.col("pages_audited") < F.col("pages_discovered")
    return one.select(
        "pages_audited", "pages_discovered", F.when(F.col("pages_discovered") > 0, half_up(F.col("pages_audited") / F.col("pages_discovered") * 100)).otherwise(0).cast("int").alias("coverage_pct"),
        partial.alias("sampled"), F.when(partial, "stratified").otherwise("all").alias("selection"), "templates_discovered", "templates_represented",
        F.when(~partial, "full").when(F.col("templates_represented") >= F.col("templates_discovered"), "representative").otherwise("indicative").alias("confidence"),
    )


def vectors(pages: DataFrame) -> DataFrame:
    """pages (url, template, overall_score, scores: array of (factor_id, score)) with signature, the factors that were scored, and vector, their scores."""
    return pages.withColumn("signature", F.array_join(F.transform(F.array_sort("scores"), lambda s: s["factor_id"]), ",")).withColumn("vector", F.transform(F.array_sort("scores"), lambda s: s["score"])).where("size(vector) > 0")


def groups(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (url, template, overall_score, scores) -> groups (template, cluster, representative_url, page_count, avg_score, score_range) and their members (template, cluster, url).

    Inside a template and set of factors, pages sorted by scores are walked: one that differs from the first of the running
    cluster by more than TOLERANCE anywhere begins the next. Clusters of LEAST_PAGES or more are groups. Pages of equal
    scores are one row of the walk, so a template that holds most of a site sends its different scores to a task, not its pages.
    """
    rows = vectors(pages)
    key = ["template", "signature", "vector"]
    first = F.min(F.struct((~homepage(F.col("url"))).alias("h"), (-F.col("overall_score")).alias("s"), "url"))
    like = rows.groupBy(*key).agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.sum("overall_score").alias("total"), F.min("overall_score").alias("low"), F.max("overall_score").alias("high"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, head, number = None, None, 0
        for batch in batches:
            out = []
            for group, v in zip(zip(batch["template"], batch["signature"], strict=True), batch["vector"], strict=True):
                if group != at or max((abs(a - b) for a, b in zip(v, head, strict=True)), default=0) > TOLERANCE:
                    number = 0 if group != at else number + 1
                    at, head = group, v
                out.append(number)
            yield batch.assign(cluster=out)

    dealt = like.select(*key).repartition("template", "signature").sortWithinPartitions(*key)
    walked = cut(dealt.mapInPandas(walk, "template string, signature string, vector array<int>, cluster int"))
    out = like.join(walked, key).groupBy("template", "signature", "cluster").agg(
        F.min("first")["url"].alias("representative_url"), F.sum("n").alias("page_count"), half_up(F.sum("total") / F.sum("n")).cast("int").alias("avg_score"), (F.max("high") - F.min("low")).alias("score_range")
    ).where(F.col("page_count") >= LEAST_PAGES)
    named = F.concat_ws("#", "signature", F.col("cluster").cast("string")).alias("cluster")
    members = rows.join(walked, key).join(out.select("template", "signature", "cluster"), ["template", "signature", "cluster"], "left_semi")
    return out.select("template", named, "representative_url", "page_count", "avg_score", "score_range"), members.select("template", named, "url")
