"""The event feed as a stream: identity deduplication within a watermark, windowed counts, batch merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundwork.operators.merge import dedup_insert


def deduplicated(events: DataFrame, keys: Sequence[str], at: str, late: str = "7 days") -> DataFrame:
    """Each identity once, as long as its repeats come within ``late``; state older than that is dropped."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, at: str, by: Sequence[str], width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and the sum of their values in each window and group."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    if dict(events.dtypes)[at] != "timestamp":  # a watermark needs an instant
        events = events.withColumn(at, F.col(at).cast("timestamp"))
    out = events.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


#: A batch of more days than this reads the whole table.
MOST_DAYS = 1_000


def merge_into(events: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str, day: str | None = None) -> StreamingQuery:
    """Append each batch's new identities to a Parquet table. Running a batch again adds nothing: its keys are stored by then.

    With ``day``, one of the keys, the table is partitioned by it, and a batch reads the days that it
    has events of and no others.
    """
    if day is not None and day not in keys:
        raise ValueError("the day has to be one of the keys: repeats of an identity lie in one partition")

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = batch.limit(0)
        if table_exists(spark, path):
            stored = spark.read.schema(batch.schema).parquet(path)
            days = [r[0] for r in batch.select(day).distinct().limit(MOST_DAYS + 1).collect()] if day else []
            if 0 < len(days) <= MOST_DAYS:
                known = F.col(day).isin([d for d in days if d is not None])
                stored = stored.filter(known | F.col(day).isNull() if None in days else known)
        fresh = dedup_insert(stored, batch, keys, [F.col(order)]).write.mode("append")
        (fresh.partitionBy(day) if day else fresh).parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_exists(spark: SparkSession, path: str) -> bool:
    """Is there a folder at the path, in whatever store it lies?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
