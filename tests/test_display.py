"""Every column of every source against a plain reading of the same paths."""

import json
import random

import pytest
from pyspark.sql import functions as F

from groundwork.sources import display

ROW = {"event_type": "sheriff_sale", "event_date": "2026-02-03", "event_value": "17.50", "parcel_id": "P1", "title": "t"}
DRAWN = ["x", "Ann & Co", "", "0", "12.5", None, "false", "7", "Ünï"]


def put(tree, path, value):
    *way, last = path[2:].split(".")
    for name in way:
        tree = tree.setdefault(name, {})
        if not isinstance(tree, dict):
            return
    tree[last] = value


def read(tree, path):
    for name in path[2:].split("."):
        tree = tree.get(name) if isinstance(tree, dict) else None
    return tree if isinstance(tree, str) else None


def plain(value, tree):
    found = None
    for k, v in enumerate(value):
        found = read(tree, v) if v[0] == "$" else ROW[v[1:]] if v[0] == "@" else v[1:]
        if k == len(value) - 1 or found not in (None, "", "0", "0.0", "false", "[]", "{}"):
            return found
    return found


def number(text):
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


@pytest.mark.parametrize("seed", [1, 2])
def test_all_columns(spark, seed):
    r = random.Random(seed)
    sources = [*display.DISPLAY, "a source of no list", None]
    rows, trees = [], {}
    for k, source in enumerate(sources * 6):
        listed = display.DISPLAY.get(source, display.OTHER)
        tree = {}
        for value in listed.values():
            for v in value:
                if isinstance(v, str) and v[0] == "$" and "[" not in v and r.random() < 0.8:
                    put(tree, v, r.choice(DRAWN))
        trees[k] = tree
        rows.append((k, source, json.dumps(tree), *ROW.values()))
    df = spark.createDataFrame(rows, "k int, source string, raw string, event_type string, event_date string, event_value string, parcel_id string, title string").withColumn("event_date", F.to_date("event_date")).withColumn("event_value", F.col("event_value").cast("decimal(18,2)"))
    checked = set()
    for got in display.display(df).collect():
        listed = display.DISPLAY.get(got["source"], display.OTHER)
        for c in display.COLUMNS:
            value = listed.get(c)
            if value is None:
                assert got[c] is None, (got["source"], c)
            elif all(isinstance(v, str) and "[" not in v for v in value):
                want = plain(value, trees[got["k"]])
                assert got[c] == (number(want) if c in display.NUMBERS else want), (got["source"], c, trees[got["k"]])
                checked.add((got["source"], c))
    assert len({c for _, c in checked}) >= 33 and len(checked) > 150


def test_rows_without_a_record(spark):
    df = spark.createDataFrame([(s, raw) for s in [*display.DISPLAY, None] for raw in (None, "no json", "[]", "{}")], "source string, raw string")
    row = {k: F.lit(v) for k, v in ROW.items()} | {"event_date": F.lit(None).cast("date"), "event_value": F.lit(None).cast("decimal(18,2)")}
    shown = display.display(df.withColumns(row))
    assert shown.count() == df.count() and shown.filter("address is not null").count() == 0
