"""Several tables changed together or not at all, with the rows they replace kept, and counters that must add up.

A commit writes new versions of its tables beside the old ones and then one small manifest that
names the versions that count. Until the manifest is there readers see the old tables; a run
that dies, or loses executors for good, leaves unused folders and nothing else. A run that is in a
manifest is not run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def manifests(spark: SparkSession, root: str) -> list[tuple[int, dict]]:
    """(number, manifest) of the commits so far, in order; one that was not written to its end is no commit."""
    fs, folder, jvm = _files(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return []
    out = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if not name.endswith(".json"):
            continue
        stream = fs.open(status.getPath())
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            out.append((int(name[:-5]), json.loads(text)))
        except ValueError:
            out.append((int(name[:-5]), {}))
    return sorted(out, key=lambda m: m[0])


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """Folder of the version that counts, of each table."""
    whole = [m for _, m in manifests(spark, root) if m]
    return whole[-1]["tables"] if whole else {}


def stored(spark: SparkSession, root: str, name: str, like: DataFrame) -> DataFrame:
    """The table's rows, or none with the columns of ``like`` if it was never committed."""
    folder = current(spark, root).get(name)
    return like.limit(0) if folder is None else spark.read.schema(like.schema).parquet(f"{root}/{folder}")


def commit(spark: SparkSession, root: str, run: str, tables: Mapping[str, DataFrame]) -> bool:
    """Write the tables and make them count together; False if the run has been committed before.

    Two commits at once: the second finds the number of its manifest taken, fails, and has changed nothing.
    """
    before = manifests(spark, root)
    if any(m.get("run") == run for _, m in before):
        return False
    tag = uuid.uuid4().hex
    folders = {name: f"data/{name}/{tag}" for name in tables}
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{folders[name]}")
    number = before[-1][0] + 1 if before else 1
    text = json.dumps({"run": run, "tables": {**current(spark, root), **folders}})
    fs, at, _ = _files(spark, f"{root}/manifests/{number:08}.json")
    out = fs.create(at, False)  # fails if it is there
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True



def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows after, old rows that change): new values win where they are not null; ``new`` has one row for each key."""
    values = [c for c in old.columns if c not in keys]
    on = reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    both = old.alias("o").join(new.alias("n"), on, "full")
    after = both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in values]).select(*old.columns)
    hit = old.alias("o").join(new.alias("n"), on)
    given = reduce(lambda x, y: x | y, [F.col(f"n.{c}").isNotNull() & ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in values], F.lit(False))
    return after, hit.filter(given).select(*[F.col(f"o.{c}").alias(c) for c in old.columns])


def promote(spark: SparkSession, root: str, run: str, at: Column, parcels: DataFrame, owners: DataFrame, keys: Sequence[str] = ("county", "parcel_id")) -> bool:
    """Parcels, then owners whose parcel is there after that; owners without one are held back; what changes is kept in backups.

    The tables parcels, owners, held_back, parcels_backup and owners_backup count from the same commit on.
    """
    if any(m.get("run") == run for _, m in manifests(spark, root)):
        return False
    old_parcels, old_owners = stored(spark, root, "parcels", parcels), stored(spark, root, "owners", owners)
    all_parcels, changed_parcels = merged(old_parcels, parcels, keys)
    there = all_parcels.select(*keys)
    fit, unfit = owners.join(there, list(keys), "left_semi").select(*owners.columns), owners.join(there, list(keys), "left_anti").select(*owners.columns)
    all_owners, changed_owners = merged(old_owners, fit, keys)
    mark = lambda rows: rows.withColumns({"run": F.lit(run), "captured_at": at})
    backup = lambda name, changed: stored(spark, root, name, mark(changed)).unionByName(mark(changed))
    tables = {"parcels": all_parcels, "owners": all_owners, "held_back": stored(spark, root, "held_back", mark(unfit)).unionByName(mark(unfit)), "parcels_backup": backup("parcels_backup", changed_parcels), "owners_backup": backup("owners_backup", changed_owners)}
    return commit(spark, root, run, tables)


class Tally:
    """Counts what is due and what became of it in one and the same run, and fails if the two differ.

    ``due`` marks the rows before they are worked on, ``ended`` marks them afterwards with one of
    ``outcomes``. Both are metrics of the plan, so nothing is scanned twice.
    """

    def __init__(self, outcomes: Sequence[str]):
        self.outcomes = list(outcomes)
        self._due, self._ended = Observation(), Observation()

    def due(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self._due, F.count(F.lit(1)).alias("due"))

    def ended(self, rows: DataFrame, outcome: str) -> DataFrame:
        return rows.observe(self._ended, *[F.count_if(F.col(outcome) == o).alias(o) for o in self.outcomes])

    def counts(self) -> dict[str, int]:
        """Counters of the run that has ended; an error if they do not add up to what was due."""
        out = {**self._due.get, **self._ended.get}
        if out["due"] != sum(out[o] for o in self.outcomes):
            raise ValueError(f"of {out['due']} rows {sum(out[o] for o in self.outcomes)} have an outcome: {out}")
        return out
