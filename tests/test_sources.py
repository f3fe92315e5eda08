import json
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from groundwork.sources import readers
from groundwork.streaming import feed


def test_json_features(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"attributes": {"pin": "1"}, "geometry": {"x": 1.0, "y": 2.0}}) + "\n{broken\n")
    rows = readers.json_features(spark, str(tmp_path), "pin string").collect()
    assert sorted((r["pin"] or "", r["_corrupt_record"] is not None) for r in rows) == [("", True), ("1", False)]


def test_csv_zip_filter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("zip,n\n55401,1\n10001,2\n56001,x\n")
    rows = readers.csv_rows(spark, str(tmp_path), "zip string, n int", zips=["55", "56"]).collect()
    assert sorted((r["zip"], r["n"]) for r in rows) == [("55401", 1), ("56001", None)]


def test_xml_and_archives(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.xml").write_text("<r><sale><id>1</id></sale><sale><id>2</id></sale></r>")
    assert readers.xml_rows(spark, str(tmp_path / "x"), "sale", "id int").count() == 2
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.xml", "caf\xe9".encode("cp1252"))
        z.writestr("in.txt", "no")
    assert [(r["member"], r["text"]) for r in readers.zip_members(spark, str(tmp_path / "a.zip")).collect()] == [("in.xml", "caf\xe9")]


def test_open_tables():
    html = "<table><tr><th>A<th>B<tr><td>1<br>2<td><table><tr><td>in</table>"
    assert [r[:3] for r in readers.table_rows(html)] == [(0, 0, ["A", "B"]), (1, 0, ["in"]), (0, 1, ["1 2", ""])]
    assert readers.table_rows(None) == []


def test_pages_in_pieces(monkeypatch):
    """A batch of pages is parsed in runs of bounded texts; every page comes once, in order."""
    texts = ["a" * 5, None, "b" * 9, "", "c" * 40, "d", "e", "f", "g"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["k", "html"])
    monkeypatch.setattr(readers, "PIECE_SIGNS", 12)
    monkeypatch.setattr(readers, "PIECE_PAGES", 3)
    got = [p.column(1).to_pylist() for p in readers.pieces(batch, 1)]
    assert got == [["a" * 5, None], ["b" * 9, ""], ["c" * 40], ["d", "e", "f"], ["g"]]
    assert [p.num_rows for p in readers.pieces(batch.slice(0, 0), 1)] == [0]


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    readers.write_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "county string, n int"), path, ["county"])
    readers.write_partitions(spark.createDataFrame([("a", 9)], "county string, n int"), path, ["county"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("county", "n").collect()) == [("a", 9), ("b", 2)]


def test_stream_merge_is_idempotent(spark, data, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{data}/events.parquet")
    events.limit(200).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for run in range(2):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        feed.merge_into(stream, out, str(tmp_path / f"c{run}"), ["event_type", "user_id"], "event_id").awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("event_type", "user_id").distinct().count() == events.limit(200).select("event_type", "user_id").distinct().count()


def test_stream_merge_reads_the_days_of_a_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("day", F.when(F.col("event_id") % 9 != 0, F.to_date("ts"))).select("event_type", "user_id", "event_id", "day")
    keys, out = ["event_type", "user_id", "day"], str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    for run, part in enumerate((events.filter("event_id < 300"), events.filter("event_id between 200 and 500"))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        feed.merge_into(stream, out, str(tmp_path / f"c{run}"), keys, "event_id", day="day").awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select(*keys).distinct().count() == events.filter("event_id <= 500").select(*keys).distinct().count()
    assert stored.filter("day is null").count() > 0


def test_stream_deduplication(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    (tmp_path / "in").mkdir()
    for _ in range(2):
        events.write.mode("append").parquet(str(tmp_path / "in"))
    out = feed.deduplicated(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), ["event_id"], "ts", "60 days")
    q = out.writeStream.format("memory").queryName("d").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("d").count() == events.count()


def test_windowed_counts(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{data}/events.parquet*")
    counts = feed.windowed_counts(stream, "ts", ["event_type"], "1 day")
    q = counts.writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("w").collect()}
    want = {(r["w"]["start"], r["event_type"]): r["n"] for r in events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
