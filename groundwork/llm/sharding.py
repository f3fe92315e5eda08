"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key inside their source, so row r of the n of a source
has the fractional rank (r + 1/2) / n. In the order of fractional ranks every stretch
holds the sources in their overall proportions; equal cuts of it are the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import cut, hex_digits, join_hot, ranked, shuffle_key

def interleave(docs: DataFrame, shards: int = 40, seed: int = 29, slice_rows: int = 20_000) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    Law ``rows``: the shards' counts are at most one apart, and every shard holds each
    source in its share of the whole, within a few rows. A null source is a source of
    its own; a null text has size 16 and the checksum of no bytes. Rows that agree in
    source, id, size and checksum are interchangeable. An empty table gives an empty result.
    A source of any size is ranked in slices, and rows alike are ranked as one row with a
    count, so neither lands in one task.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size, crc = (F.octet_length(text) + 16).cast("long"), F.crc32(text)
    rows = cut(docs.select("doc_id", "source", size.alias("size"), crc.alias("text_crc32"), shuffle_key(seed, F.col("doc_id"), size, crc).alias("__key")))
    total = rows.count()
    digits = hex_digits(total, slice_rows)
    rows = cut(ranked(rows, ["source"], "__key", digits, "__rank"))
    rows = rows.withColumn("__source", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")))
    sizes = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("n")).withColumn("__of", F.col("n"))
    rows = join_hot(rows, sizes, "__source", "__key", total).drop("__source")
    rows = rows.withColumn("__at", (2 * F.col("__rank") + 1) / (2 * F.col("__of")))
    slices = max(1, -(-total // slice_rows))
    # positions over all: rows are alike in nothing here, as no two of a source have one rank
    rows = rows.withColumn("__cell", F.floor(F.col("__at") * slices))
    before = Window.orderBy("__n_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("__cell", "__n_cell")
    offsets = offsets.select("__n_cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__cell").orderBy("__at", F.col("source").asc_nulls_first()))
    rows = rows.withColumn("__in", inner).join(offsets, F.col("__cell") == F.col("__n_cell")).withColumn("__pos", F.col("__before") + F.col("__in") - 1)
    # whole-number division; the first position of shard k is ceil(k * total / shards)
    rows = rows.withColumn("shard", F.expr(f"cast((__pos * {shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return rows.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("__pos") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
