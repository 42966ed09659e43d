"""Connected components of links between integer ids, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import dropped, stored


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long): one row (id, component) for each id in a link, component being the smallest id reachable.

    Alternates large-star and small-star steps; each step is a grouped minimum and a join, so no group is gathered
    in one place, and each round is a stored table. Self-links and repeated links add nothing; rows with a null end
    are left out; no links give no rows.
    """
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    now = stored(edges, "links")
    while True:
        # Each larger neighbour of a node is linked to the smallest in the node's surroundings.
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Each smaller neighbour of a node, and the node, are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = stored(small, "links")
        nodes, rows = after.select(F.count_distinct("u"), F.count(F.lit(1))).first()
        stars = nodes == rows and not after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").head(1)
        dropped(now)
        now = after
        if stars:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
