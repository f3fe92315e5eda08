"""Session settings that the engine's results and plans rely on, and the table loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UTC so that dates do not depend on the machine; ANSI so that a bad cast is an error
#: unless ``try_`` is asked for; adaptive execution for skewed joins and small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "groundwork", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
