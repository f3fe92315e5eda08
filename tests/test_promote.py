import os

import pytest
from pyspark.sql import functions as F

from groundwork.operators import promote

P, O = "county string, parcel_id string, value int, use string", "county string, parcel_id string, owner string"


def frames(spark, parcels, owners):
    return spark.createDataFrame(parcels, P), spark.createDataFrame(owners, O)


def rows(spark, root, name, like):
    return sorted((tuple(r) for r in promote.stored(spark, root, name, like).collect()), key=repr)


def test_promotion_is_all_or_nothing(spark, tmp_path, monkeypatch):
    root, day = str(tmp_path), F.lit("2026-08-15")
    p, o = frames(spark, [("a", "1", 10, "x"), ("a", "2", 20, None)], [("a", "1", "Ann"), ("b", "1", "Bo")])
    assert promote.promote(spark, root, "r1", day, p, o)
    assert rows(spark, root, "owners", o) == [("a", "1", "Ann")]  # the other's county has no such parcel
    first = promote.current(spark, root)

    # a run that dies between two tables
    p2, o2 = frames(spark, [("a", "1", 11, None), ("b", "1", 5, "y")], [("b", "1", "Bo"), ("a", "1", "Cy")])
    broken = o2.withColumn("owner", F.when(F.col("owner") == "Cy", F.raise_error("an executor is gone")).otherwise(F.col("owner")))
    with pytest.raises(Exception, match="an executor is gone"):
        promote.promote(spark, root, "r2", day, p2, broken)
    assert promote.current(spark, root) == first and rows(spark, root, "parcels", p) == [("a", "1", 10, "x"), ("a", "2", 20, None)]

    # a manifest that was not written to its end
    os.makedirs(f"{root}/manifests", exist_ok=True)
    with open(f"{root}/manifests/00000002.json", "w") as f:
        f.write('{"run": "r2", "tab')
    assert promote.current(spark, root) == first

    assert promote.promote(spark, root, "r2", day, p2, o2)
    assert rows(spark, root, "parcels", p) == [("a", "1", 11, "x"), ("a", "2", 20, None), ("b", "1", 5, "y")]
    assert rows(spark, root, "owners", o) == [("a", "1", "Cy"), ("b", "1", "Bo")]
    backup = p.withColumns({"run": F.lit(""), "captured_at": day})
    assert rows(spark, root, "parcels_backup", backup) == [("a", "1", 10, "x", "r2", "2026-08-15")]

    # the same run again changes nothing
    second, files = promote.current(spark, root), sum(len(f) for _, _, f in os.walk(root))
    assert not promote.promote(spark, root, "r2", day, p2, o2)
    assert promote.current(spark, root) == second and sum(len(f) for _, _, f in os.walk(root)) == files

    # rows that are there already are no change
    assert promote.promote(spark, root, "r3", day, p2, o2)
    assert len(rows(spark, root, "parcels_backup", backup)) == 1


def test_a_second_writer_fails_and_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    one = spark.range(3)
    assert promote.commit(spark, root, "a", {"t": one})
    seen = promote.manifests(spark, root)
    assert promote.commit(spark, root, "b", {"t": spark.range(5)})
    monkeypatch.setattr(promote, "manifests", lambda *_: seen)  # it looked before the other was done
    with pytest.raises(Exception, match="exist"):
        promote.commit(spark, root, "c", {"t": spark.range(7)})
    monkeypatch.undo()
    assert promote.stored(spark, root, "t", one).count() == 5


def test_counters_add_up(spark):
    work = spark.range(100).withColumn("k", F.col("id") % 4)
    tally = promote.Tally(["sent", "empty", "failed"])
    known = spark.createDataFrame([(0, "sent"), (1, "empty"), (2, "failed"), (3, "sent")], "k bigint, outcome string")
    tally.ended(tally.due(work).join(known, "k"), "outcome").write.format("noop").mode("overwrite").save()
    assert tally.counts() == {"due": 100, "sent": 50, "empty": 25, "failed": 25}


@pytest.mark.parametrize("known", [[(0, "sent"), (1, "sent"), (2, "sent")], [(0, "sent"), (1, "odd"), (2, "sent"), (3, "sent")], [(k, "sent") for k in (0, 1, 2, 3, 3)]])
def test_a_lost_row_fails_the_run(spark, known):
    tally = promote.Tally(["sent"])
    work = tally.due(spark.range(100).withColumn("k", F.col("id") % 4))
    tally.ended(work.join(spark.createDataFrame(known, "k bigint, outcome string"), "k"), "outcome").write.format("noop").mode("overwrite").save()
    with pytest.raises(ValueError, match="of 100 rows"):
        tally.counts()
