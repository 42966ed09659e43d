"""Crawl results as a stream of checkpoints: batches with stable identities, written once however often they are replayed, and the last version of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rows of a checkpoint batch, at most.
BATCH_ROWS = 250
#: Values that differ between replays of the same run.
CLOCKS = ("fetched_at", "fetch_time_ms", "audited_at")


def key(prefix: str, *parts: Column) -> Column:
    """prefix:24 hex digits of the parts' SHA-256."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 24))


def checksum(rows: DataFrame) -> Column:
    """SHA-256 of a row as JSON, columns by name, without clocks."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c not in CLOCKS))), 256)


def batches(rows: DataFrame, kind: str, order: str = "key") -> DataFrame:
    """rows (key, ...) plus batch_id: rows sorted by key, BATCH_ROWS a batch, named by their content, so that a replay gives the same names."""
    # Keys are hashes: ranges of their first digits are even, so no global order is needed.
    sized = rows.withColumn("_check", checksum(rows))
    lots = max(1, -(-rows.count() // BATCH_ROWS))
    lot = F.floor(F.conv(F.substring(F.sha2(F.col(order), 256), 1, 8), 16, 10).cast("long") * lots / (1 << 32))
    sized = sized.withColumn("_lot", lot)
    place = Window.partitionBy("_lot").orderBy(order)
    sized = sized.withColumn("_part", F.floor((F.row_number().over(place) - 1) / BATCH_ROWS))
    names = sized.groupBy("_lot", "_part").agg(F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("_check")), ","), 256), 1, 24)).alias("batch_id"))
    return sized.join(names, ["_lot", "_part"]).drop("_lot", "_part", "_check")


def current(log: DataFrame) -> DataFrame:
    """The last version of each key of a log (key, sequence, batch_id, ...): a batch that was written twice counts once, a later sequence wins, then the later batch name."""
    last = log.groupBy("key").agg(F.max(F.struct("sequence", "batch_id")).alias("_last"))
    return log.join(last, "key").where((F.col("sequence") == F.col("_last.sequence")) & (F.col("batch_id") == F.col("_last.batch_id"))).drop("_last").dropDuplicates(["key"])


def append_once(rows: DataFrame, path: str) -> None:
    """Appends the batches of rows (batch_id, ...) that the log at path doesn't hold yet."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select("batch_id").distinct(), "batch_id", "left_anti")
    rows.write.mode("append").partitionBy("sequence").parquet(path)


def follow(spark: SparkSession, source: str, schema: str, sink: str, state: str, kind: str = "pages") -> StreamingQuery:
    """Follows a folder of result files (key, ...): each micro-batch becomes checkpoint batches in the log at `sink`. A micro-batch that Spark runs again after a failure changes nothing."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).json(source)

    def write(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("sequence", F.lit(number).cast("long"))
        if rows.head(1):
            append_once(batches(rows, kind), sink)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
