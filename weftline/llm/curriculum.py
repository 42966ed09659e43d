"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear from `start` to 2 - start, whose integral is the
source's target. The words a source has to give by time t are its cumulative demand. Its documents stand one after the
other, over and over; a copy that begins after so many words is used when the demand reaches that number, at the inverse
of the integral, and not at all if training ends before. What a copy gives is the demand from its position on, its own
size at most; what a document gives, `taken`, is the sum over its copies. Documents are range-sorted by position.

Running sums inside a source are taken over buckets of a hash of doc_id, so a source that holds a third of all rows
is spread over many tasks. All DataFrame functions, no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD, stored, table

#: Rows in a bucket of running sums.
BUCKET_ROWS = 2048
#: A document is used so many times at most.
MAX_REPEATS = 3
#: Schedule start by weight: light sources come early, heavy ones late.
STARTS = {1: 1.5, 2: 1.0, 3: 0.5}


def _position(u: Column, start: Column) -> Column:
    """The time t at which start*t + (1-start)*t*t is u."""
    bend = F.lit(1.0) - start
    return F.when(bend == 0, u).otherwise((F.sqrt(start * start + 4.0 * bend * u) - start) / (2.0 * F.when(bend == 0, 1.0).otherwise(bend)))


def source_targets(sizes: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) -> a row for each source: source_size, weight 1, 2, 3 in turn by code point (null last), target.

    A target above repeats * source_size stops there and the rest is shared by weight anew: the common level is the
    largest (total - caps so far) / weight left, sources ordered by cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.lit(1) + (F.row_number().over(every) - 1) % 3).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    per = per.withColumn("caps", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.partitionBy()
    per = per.withColumn("level", F.max((F.sum("source_size").over(whole) - F.col("caps")).cast("double") / F.col("left")).over(whole))
    return per.select("source", "source_size", "source_rows", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _sized(documents: DataFrame, *columns: Column | str) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return documents.select("doc_id", "source", words.alias("size"), draw.alias("draw"), *columns)


def mix(documents: DataFrame, repeats: int = MAX_REPEATS, whole: bool = False) -> DataFrame:
    """documents (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken, copies, positions; by position.

    size counts words `[^\\x20\\x09-\\x0D]+` (null or blank text: 0, never taken). Inside a source, documents are
    ordered by the md5 of doc_id (a null one as ''), then doc_id and size; rows alike in all are alike in the result's
    multiset. A source's whole demand is its target, rounded to words, so its taken words differ from that by half a
    word; the last copy used may be used in part. positions holds the time of each copy, the earliest first; documents
    not taken come last. An empty table gives no rows; a null source is a source like any other. whole: a column
    `document` holds the input row.
    """
    sizes = _sized(documents)
    sizes = stored(sizes, "sizes")
    targets = source_targets(sizes, repeats)
    largest = targets.agg(F.max("source_rows")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, largest / BUCKET_ROWS))))
    if whole:
        sizes = _sized(documents, F.struct(*documents.columns).alias("document"))
    sizes = sizes.withColumn("bucket", F.shiftright("draw", 60 - bits)).withColumn("named", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    targets = targets.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("named"), "source_size", "target", "weight",
        F.floor(F.col("target") + 0.5).alias("quota"),
        F.expr("if(source_size > 0, floor(target + 0.5) div source_size, 0L)").alias("rounds"),
    )
    before = Window.partitionBy("named").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy("named", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("named", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier")).join(targets, "named")
    inside = Window.partitionBy("named", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["named", "bucket"])
    out = out.withColumn("ahead", F.col("ahead") + F.col("earlier"))
    begins = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rounds")), lambda k: k * F.col("source_size") + F.col("ahead"))
    out = out.withColumn("begins", F.when(F.col("size") > 0, F.filter(begins, lambda b: b < F.col("quota"))).otherwise(F.array().cast("array<long>")))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in STARTS.items() for x in kv]), F.col("weight"))
    out = out.withColumn("positions", F.transform("begins", lambda b: _position(b / F.col("quota"), start)))
    taken = F.aggregate("begins", F.lit(0).cast("long"), lambda acc, b: acc + F.least(F.col("size"), F.col("quota") - b))
    out = out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("begins").alias("copies"), "positions", *["document"] * whole)
    return out if whole else out.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")


def schedule(documents: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of documents in training order, each as often as mix() uses it (the last of a source, used in part, whole); all columns stay. Texts without words, null ones among them, are never used; an empty table gives no rows; ties go by doc_id."""
    used = mix(documents, repeats, whole=True).where("copies > 0").select(F.explode("positions").alias("at"), "document")
    return used.orderBy("at", "document.doc_id").select("document.*")


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of copies and the position of the first, to nine decimals."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round(F.try_element_at("positions", F.lit(1)), 9).alias("first_position"))


OP8_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || left(md5(coalesce(doc_id::varchar, '')), 15))::bigint as draw
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source),
w as (select *, 1 + (place - 1) % 3 as weight, 3 * source_size as cap from s),
l as (
  select *,
    coalesce(sum(cap) over (order by cap::double / weight, place rows between unbounded preceding and 1 preceding), 0) as caps,
    sum(weight) over (order by cap::double / weight, place rows between current row and unbounded following) as rest
  from w),
t as (
  select source, source_size, weight, least(cap::double, weight * max(((select sum(source_size) from s) - caps)::double / rest) over ()) as target
  from l),
q as (
  select d.*, t.source_size, t.target, case t.weight when 1 then 1.5 when 2 then 1.0 else 0.5 end::double as start, floor(t.target + 0.5)::bigint as quota,
    case when t.source_size > 0 then floor(t.target + 0.5)::bigint // t.source_size else 0 end as rounds,
    coalesce(sum(size) over (partition by d.source order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
  from d join t on d.source is not distinct from t.source),
u as (
  select *, greatest(0, least(size, quota - rounds * source_size - ahead)) as part,
    case when size > 0 then ahead::double / quota end as u
  from q)
select doc_id, size, source_size, target, (rounds * size + part)::bigint as taken,
  case when size > 0 then rounds + (part > 0)::int else 0 end::int as copies,
  case when size > 0 and rounds + (part > 0)::int > 0 then round(case when start = 1 then u else (sqrt(start * start + 4 * (1 - start) * u) - start) / (2 * (1 - start)) end, 9) + 0.0 end as first_position
from u
"""
