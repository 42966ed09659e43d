"""From page audits to a site: issues across pages, defect groups, ranked fixes, duplicates and orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import half_up
from weftline.functions.urls import homepage, on_origin, page_key
from weftline.operators.factors import PAGE_SPECIFIC

AFFECTED = 70
LEAST_FOR_ORPHANS = 5
# Titles and severities of defects.
DEFECTS = {"missing-h1": ("Missing H1", "critical"), "multiple-h1": ("Multiple H1 tags", "critical"), "missing-title": ("Missing title", "critical"), "names-another-entity": ("Names another entity", "critical"), "missing-meta-description": ("Missing meta description", "warning")}


def _pct(n: Column, of: Column) -> Column:
    return F.when(of > 0, half_up(n / of * 100)).otherwise(0).cast("int")


def recommendations(factors: DataFrame) -> DataFrame:
    """factors (url, factor_id, recommendations) -> a row for each factor_id, recommendation and url, in long form: a site's pages never meet in one row."""
    return factors.select("factor_id", F.explode("recommendations").alias("recommendation"), "url").distinct()


def recommendation_counts(advice: DataFrame) -> DataFrame:
    """recommendations() -> factor_id, recommendation, n_urls."""
    return advice.groupBy("factor_id", "recommendation").agg(F.count(F.lit(1)).alias("n_urls"))


def cross_cutting(factors: DataFrame) -> DataFrame:
    """factors (url, factor_id, name, score, applies, recommendations) -> a ranked row for each factor that falls short or advises.

    avg_score is over all pages, applicable_avg over those the factor applies to. Factors for all pages come first, by
    pages affected and then the lower mean; page-specific ones after them, present before absent, by best score.
    """
    bad = (F.col("score") < AFFECTED).cast("int")
    own = F.col("applies").cast("int")
    best = F.struct("score", homepage(F.col("url")).cast("int").alias("home"))
    top = factors.groupBy("factor_id", "name").agg(
        F.avg("score").alias("mean"), F.sum(bad).alias("affected_pages"), F.count(F.lit(1)).alias("total_pages"), F.sum(own).alias("applicable_pages"),
        F.sum(own * F.col("score")).alias("own_score"), F.sum(own * bad).alias("applicable_affected_pages"), F.max(best).alias("best"), F.sum(F.size("recommendations")).alias("advice"),
    ).where("affected_pages > 0 or advice > 0")
    first = factors.select("factor_id", "url", best.alias("best")).groupBy("factor_id", "best").agg(F.min("url").alias("best_page_url"))
    specific = F.col("factor_id").isin(*PAGE_SPECIFIC)
    status = F.when(~specific, "sitewide").when(F.col("applicable_pages") > 0, "limited").otherwise("opportunity")
    out = top.join(first, ["factor_id", "best"]).select(
        "factor_id", "name", half_up(F.col("mean")).cast("int").alias("avg_score"), "affected_pages", "total_pages", "applicable_pages",
        F.when(F.col("applicable_pages") > 0, half_up(F.col("own_score") / F.col("applicable_pages"))).otherwise(0).cast("int").alias("applicable_avg_score"),
        "applicable_affected_pages", specific.alias("page_specific"), status.alias("status"), F.col("best.score").alias("best_score"), "best_page_url",
    )
    general = Window.orderBy("page_specific", F.when(F.col("page_specific"), (F.col("status") != "limited").cast("int")).otherwise(-F.col("affected_pages")), F.when(F.col("page_specific"), -F.col("best_score")).otherwise(F.col("avg_score")), "name")
    return out.withColumn("rank", F.row_number().over(general))


def defect_pages(audits: DataFrame, priorities: DataFrame | None = None) -> DataFrame:
    """audits (url, defects) [and priorities (url, priority)] -> id, severity, url, home, priority (0.5 if none): a row for each defect of a page. A report shows them by home, then priority, both descending, then URL."""
    rows = audits.where("status = 'success'").select("url", F.explode("defects").alias("d")).select("url", "d.id", "d.severity")
    rows = rows.join(priorities, "url", "left") if priorities is not None else rows.withColumn("priority", F.lit(None).cast("double"))
    return rows.withColumn("priority", F.coalesce("priority", F.lit(0.5))).withColumn("home", homepage(F.col("url")).cast("int"))


def defect_groups(rows: DataFrame) -> DataFrame:
    """defect_pages() -> a ranked row for each defect, with the first of its pages."""
    page = F.struct((-F.col("home")).alias("h"), (-F.col("priority")).alias("p"), "url")
    out = rows.groupBy("id", "severity").agg(F.count(F.lit(1)).alias("n_pages"), F.max("home").alias("homepage"), F.max("priority").alias("max_priority"), F.min(page)["url"].alias("first_url"))
    titles = F.create_map(*[F.lit(x) for k, (t, _) in DEFECTS.items() for x in (k, t)])
    order = Window.orderBy((F.col("severity") != "critical").cast("int"), F.desc("homepage"), F.desc("max_priority"), F.desc("n_pages"), "title")
    return out.withColumn("title", F.element_at(titles, F.col("id"))).withColumn("rank", F.row_number().over(order))


def fixes(issues: DataFrame, advice: DataFrame, defects: DataFrame, pages: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """The ranked list of what to repair: critical defects first, then every cross-cutting issue, none cut off.

    advice: recommendations(); defects: defect_groups() of pages: defect_pages(); groups (template, url): pages of
    templates. A page outside them is a unit of its own.
    """
    ranked = defects.where("severity = 'critical'").select("id", "severity", "rank", "title")
    critical = pages.select("id", "severity", "url").join(F.broadcast(ranked), ["id", "severity"]).select(F.lit(0).alias("part"), "rank", F.lit("critical-defect").alias("kind"), "id", "title", "url")  # a row for each kind of defect
    wide = issues.where("status = 'sitewide'").join(advice.select("factor_id", "url").distinct(), "factor_id", "left")
    wide = wide.select(F.lit(1).alias("part"), "rank", F.lit("cross-cutting").alias("kind"), F.col("factor_id").alias("id"), F.col("name").alias("title"), "url")
    rest = issues.where("status <> 'sitewide'").select(F.lit(1).alias("part"), "rank", F.lit("cross-cutting").alias("kind"), F.col("factor_id").alias("id"), F.col("name").alias("title"), F.lit(None).cast("string").alias("url"))
    rows = critical.unionByName(wide).unionByName(rest).join(groups, "url", "left").withColumn("unit", F.coalesce("template", "url"))
    out = rows.groupBy("part", "rank", "kind", "id", "title").agg(F.count("url").alias("affected_pages"), F.count_distinct("unit").alias("template_count"), F.coalesce(F.bool_or(homepage(F.col("url"))), F.lit(False)).alias("affects_homepage"))
    place = F.row_number().over(Window.orderBy("part", "rank"))
    return out.select(place.alias("priority"), "kind", "id", "title", "affected_pages", _pct(F.col("affected_pages"), F.lit(total)).alias("prevalence_pct"), "template_count", "affects_homepage")


def duplicates(pages: DataFrame) -> DataFrame:
    """pages (url, title, description) -> code, value, url, n_urls: each page with a trimmed text that two different URLs or more share word for word; a null URL counts as none."""
    both = F.explode(F.array(F.struct(F.lit("site.duplicate-title").alias("code"), F.trim("title").alias("value")), F.struct(F.lit("site.duplicate-meta-description").alias("code"), F.trim("description").alias("value"))))
    rows = pages.select("url", both.alias("x")).select("url", "x.*").where("value <> ''")
    rows = rows.distinct()
    several = rows.groupBy("code", "value").agg(F.count("url").alias("n_urls")).where("n_urls >= 2")
    return rows.join(several, ["code", "value"]).select("code", "value", "url", "n_urls")


def orphans(pages: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """pages (url), links (to) -> pages that nothing links to, but for the homepage of root, the run's first page, whatever query it has; none unless there are LEAST_FOR_ORPHANS pages. Only for complete runs."""
    keyed = pages.select("url", page_key(F.col("url")).alias("key"))
    inbound = links.select(page_key(F.col("to")).alias("key")).distinct()
    out = keyed.join(inbound, "key", "left_anti").where(F.col("key") != on_origin(F.lit(""), F.lit(root)))
    return out.where(F.lit(pages.limit(LEAST_FOR_ORPHANS).count() >= LEAST_FOR_ORPHANS)).select("url")
