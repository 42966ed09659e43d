"""Two runs side by side: what got worse, what is gone, and a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    overall_tolerance: int = 0
    page_tolerance: int = 0
    factor_tolerance: int = 0
    gate_new_pages: bool = False
    gate_warnings: bool = False
    gate_removed: bool = False
    report_only: bool = False
    missing_baseline_fails: bool = False


def drift(a: str | None, b: str | None) -> str:
    """How far two versions are apart: major, minor, none; unknown without both."""
    if not a or not b:
        return "unknown"
    x, y = a.split("."), b.split(".")
    return "major" if x[0] != y[0] else "minor" if x[1:2] != y[1:2] else "none"


def pages(baseline: DataFrame, current: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Two page_results (url, overall_score, status, error) -> url, baseline, current, delta, change: regressed, improved, same, dropped (now an error), removed, added or absent. One full join on the URL."""
    b = baseline.select("url", F.col("overall_score").alias("baseline"), F.col("status").alias("b"))
    c = current.select("url", F.col("overall_score").alias("current"), F.col("status").alias("c"), "error")
    both = b.join(c, "url", "full_outer")
    was, now = F.col("b") == "success", F.col("c") == "success"
    delta = F.when(was & now, F.col("current") - F.col("baseline"))
    change = (
        F.when(delta < -policy.page_tolerance, "regressed").when(delta > 0, "improved").when(delta.isNotNull(), "same")
        .when(was & F.col("c").isNotNull(), "dropped").when(was, "removed").when(F.col("b").isNull() & now, "added").otherwise("absent")
    )
    return both.select("url", "baseline", "current", delta.alias("delta"), change.alias("change"), "error")


def factors(baseline: DataFrame, current: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Two factor_results (url, factor_id, score) of successful pages -> url, factor_id, baseline, current, delta, regressed, for those in both."""
    b = baseline.select("url", "factor_id", F.col("score").alias("baseline"))
    c = current.select("url", "factor_id", F.col("score").alias("current"))
    delta = F.col("current") - F.col("baseline")
    return b.join(c, ["url", "factor_id"]).select("url", "factor_id", "baseline", "current", delta.alias("delta"), (delta < -policy.factor_tolerance).alias("regressed"))


def defects(baseline: DataFrame, current: DataFrame, before: DataFrame) -> DataFrame:
    """Two page_defects (url, id, severity) and the successful pages of the baseline (url) -> url, id, severity, kind: new-type, page-regression or new-page."""
    new = current.join(baseline.select("id", "url").distinct(), ["id", "url"], "left_anti")
    types = baseline.select("id").distinct().withColumn("known", F.lit(True))
    held = before.select("url").distinct().withColumn("held", F.lit(True))
    kind = F.when(F.col("known").isNull(), "new-type").when(F.col("held"), "page-regression").otherwise("new-page")
    return new.join(types, "id", "left").join(held, "url", "left").select("url", "id", "severity", kind.alias("kind"))


def gates(kind: Column, severity: Column, policy: Policy) -> Column:
    return ((severity == "critical") | F.lit(policy.gate_warnings)) & ((kind != "new-page") | F.lit(policy.gate_new_pages))


def same_factors(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row, comparable: whether both runs have the same set of factors."""
    sets = [F.array_sort(F.collect_set("factor_id")).alias(n) for n in "bc"]
    return baseline.agg(sets[0]).crossJoin(current.agg(sets[1])).select((F.col("b") == F.col("c")).alias("comparable"))  # single rows


def report(page_changes: DataFrame, factor_changes: DataFrame, defect_changes: DataFrame, overall: tuple[int, int] | None, comparable: bool = True, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """One row: counts by dimension, how many dimensions tripped, result and verdict. overall: (baseline, current), None without a baseline."""
    spark = page_changes.sparkSession
    if overall is None:
        fail = policy.missing_baseline_fails and not policy.report_only
        return spark.createDataFrame([("no-baseline", "fail" if fail else "pass", 0)], "result string, verdict string, regression_count int")
    ok = F.lit(comparable)
    one = page_changes.agg(F.count_if((F.col("change") == "regressed") & ok).alias("pages"), F.count_if(F.col("change") == "improved").alias("improved_pages"), F.count_if(F.col("change") == "dropped").alias("dropped"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change") == "added").alias("added"))
    one = one.crossJoin(factor_changes.agg(F.count_if(F.col("regressed") & ok).alias("factors"), F.count_if(F.col("delta") > 0).alias("improved_factors")))
    one = one.crossJoin(defect_changes.agg(F.count_if(gates(F.col("kind"), F.col("severity"), policy)).alias("defects")))  # single rows
    worse = comparable and overall[1] - overall[0] < -policy.overall_tolerance
    tripped = F.lit(int(worse)) + sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ("pages", "factors", "dropped", "defects")), F.lit(0)) + (F.when(F.col("removed") > 0, 1).otherwise(0) if policy.gate_removed else F.lit(0))
    bad = F.col("regression_count") > 0
    result = F.when(bad, "regression").when(F.lit(overall[1] > overall[0]), "improvement").otherwise("pass")
    return one.withColumn("regression_count", tripped).withColumn("result", result).withColumn("verdict", F.when(bad & F.lit(not policy.report_only), "fail").otherwise("pass"))
