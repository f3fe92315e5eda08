"""Helpers shared by the training-data operators: tables, lineage cuts and a distributed rank."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; words are the runs between.
WS = " \t\n\x0b\f\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with an eager checkpoint in the shared folder.

    The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, one machine
    (a local master) takes a temporary one; a cluster fails.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


#: Rows and bytes of a batch that goes to a Python worker, which holds a batch whole: texts may be long.
BATCH_ROWS, BATCH_BYTES = 2_000, 8_388_608


def in_bytes(setting: str) -> int:
    """Bytes of a size setting: a number with or without a unit, b to p, as ``16m`` or ``8 MB``; no unit means bytes."""
    number, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches. The queries call this; the operators leave a caller's session as it is."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < in_bytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, f"{most}b" if "Bytes" in name else str(most))


def map_texts(df: DataFrame, fn: Callable[[list], list[pa.Array]], schema: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns plus the arrays that ``fn`` makes of a batch of texts (null: None)."""
    names = [*carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], names=[*names, *made_names])

    kept = df.select(*names, F.col(text).cast("string").alias("__text"))
    made_names = [part.split()[0] for part in schema.split(",")]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{head}, {schema}")


#: A column that holds all columns of a row, so that no name of theirs can clash.
ROW = "__row"


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WS_RUN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def shuffle_key(seed: int, *cols: Column) -> Column:
    """A seeded random order: hex digits that depend on the seed and the key only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))


#: Rows alike are spread over tasks in pieces of this size.
ALIKE = 4_096


def ranked(df: DataFrame, group: list[str], key: str, digits: int, out: str) -> DataFrame:
    """Gapless rank from 0 of each row in its group by (key, then all other columns), without a task that sees a whole group.

    ``key`` is a random order in hex digits; its first ``digits`` cut each group into
    slices. Rows that are alike in every column are one row with a count until the end, so neither a
    large group nor many copies of one row land in one task. Ranks inside a slice are
    sums of counts; the slices' counts, a small table, give each slice its offset.
    """
    names = df.columns
    kinds = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__m")).withColumn("__cell", F.substring(key, 1, digits))
    slices = kinds.groupBy(*group, "__cell").agg(F.sum("__m").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*[F.col(c).alias(f"__o_{c}") for c in [*group, "__cell"]], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy(*group, "__cell").orderBy(key, *[F.col(c).asc_nulls_first() for c in names if c not in (key, *group)]).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("__in", F.coalesce(F.sum("__m").over(order), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in [*group, "__cell"]]
    kinds = kinds.join(slices, on, "inner").withColumn("__first", F.col("__before") + F.col("__in")).select(*names, "__m", "__first")
    few, many = kinds.filter(F.col("__m") <= ALIKE), kinds.filter(F.col("__m") > ALIKE)
    pieces = many.withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__m") - 1) / ALIKE))))
    pieces = pieces.select(*names, F.least(F.lit(ALIKE), F.col("__m") - F.col("__p") * ALIKE).cast("long").alias("__m"), (F.col("__first") + F.col("__p") * ALIKE).alias("__first")).repartition("__first", *names)
    both = few.unionByName(pieces)
    return both.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1))).select(*names, (F.col("__first") + F.col("__k")).alias(out))


def join_hot(rows: DataFrame, table: DataFrame, key: str, by: str, total: int, how: str = "inner", keep_n: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, unique by ``key``, whose column n is the number of rows that ask for a key.

    A key that over 1 / 500 of the ``total`` rows ask for (so there are 500 at most, and
    their list is broadcast) is cut into slices by a hash of the column ``by``.
    """
    limit = max(64, total // 500)
    slices = F.ceil(F.col("n") / limit)
    hot = table.filter(F.col("n") > limit).select(F.col(key).alias("__hot"), slices.alias("__slices"))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    left = left.withColumn("__slice", F.coalesce(F.pmod(F.xxhash64(by), F.col("__slices")), F.lit(0).cast("long"))).drop("__hot", "__slices")
    right = table.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > limit, slices - 1).otherwise(F.lit(0).cast("long")))))
    return left.join(right if keep_n else right.drop("n"), [key, "__slice"], how).drop("__slice")


def hex_digits(rows: int, slice_rows: int) -> int:
    """So many leading hex digits of a random key split ``rows`` into slices of about ``slice_rows``."""
    k = 0
    while rows > slice_rows * 16**k:
        k += 1
    return k
