"""Landed feeds as DataFrames, split into valid rows and rejects. Fetching over a network is not part of the engine."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_features(spark: SparkSession, path: str, attributes: str, lines: bool = True) -> DataFrame:
    """Features of landed pages, one object a line: the attributes by name, the geometry, and lines that can't be read."""
    schema = f"attributes struct<{attributes}>, geometry struct<x: double, y: double, rings: array<array<array<double>>>>, _corrupt_record string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", str(not lines).lower()).json(path)
    return raw.select("attributes.*", "geometry", "_corrupt_record")


def csv_rows(spark: SparkSession, path: str, schema: str | StructType, zips: Sequence[str] = (), zip_column: str = "zip") -> DataFrame:
    """Rows with a header line; with ``zips`` only those whose postal code starts with one of them."""
    rows = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path)
    if not zips:
        return rows
    return rows.filter(F.greatest(F.lit(False), *[F.col(zip_column).startswith(z) for z in zips]))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def zip_members(spark: SparkSession, path: str, suffix: str = ".xml", encoding: str = "utf-8", fallback: str = "cp1252") -> DataFrame:
    """path, member, text of the members of landed archives; text that is not in ``encoding`` is read as ``fallback``.

    An archive is the unit of work, and one archive has to fit in a task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if member.lower().endswith(suffix):
                            raw = archive.read(member)
                            try:
                                text = raw.decode(encoding)
                            except UnicodeDecodeError:
                                text = raw.decode(fallback, "replace")
                            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (name, member, text)], names=["path", "member", "text"])

    return files.mapInArrow(unpack, "path string, member string, text string")


class _Tables(HTMLParser):
    """Rows of text cells of every table, in order; a nested table's rows come under its own number.

    A table belongs to the last of the headings that was written before it, in a cell or outside.
    """

    def __init__(self, headings: Sequence[str] = ()) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str], str | None]] = []
        self.open: list[list] = []  # [table, next row, cells or None, parts or None, section]
        self.tables = 0
        self.headings, self.section = headings, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append([self.tables, 0, None, None, self.section])
            self.tables += 1
        elif self.open:
            top = self.open[-1]
            if tag == "tr":
                self.end_row(top)
                top[2] = []
            elif tag in ("td", "th") and top[2] is not None:
                self.end_cell(top)
                top[3] = []
            elif tag == "br" and top[3] is not None:
                top[3].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        if tag == "table":
            self.end_row(self.open.pop())
        elif tag == "tr":
            self.end_row(self.open[-1])
        elif tag in ("td", "th"):
            self.end_cell(self.open[-1])

    def handle_data(self, data: str) -> None:
        self.section = next((h for h in self.headings if h in data), self.section)
        if self.open and self.open[-1][3] is not None:
            self.open[-1][3].append(data)

    @staticmethod
    def end_cell(top: list) -> None:
        if top[3] is not None:
            top[2].append(" ".join("".join(top[3]).split()))
            top[3] = None

    def end_row(self, top: list) -> None:
        if top[2] is not None:
            self.end_cell(top)
            self.rows.append((top[0], top[1], top[2], top[4]))
            top[1] += 1
            top[2] = None


def table_rows(html: str | None, headings: Sequence[str] = ()) -> list[tuple[int, int, list[str], str | None]]:
    parser = _Tables(headings)
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser.end_row(parser.open.pop())
    return parser.rows


ROWS = pa.list_(pa.struct([("table_no", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("section", pa.string())]))
#: Signs of pages that a Python worker holds parsed at once, and pages, should they be short.
PIECE_SIGNS, PIECE_PAGES = 1 << 20, 256


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in ``column`` have ``PIECE_SIGNS`` together; a longer text is a run of its own."""
    begin = total = 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()):
        if i > begin and (total + size > PIECE_SIGNS or i - begin >= PIECE_PAGES):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    yield batch.slice(begin)


def page_tables(pages: DataFrame, html: str, carry: Sequence[str], headings: Sequence[str] = ()) -> DataFrame:
    """``carry`` and rows, an array of (table_no, row_no, cells, section) of all table rows of a page, one row a page.

    A batch of pages is parsed and given back in pieces, so a worker's memory does not grow with the rows of a batch.
    """
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, width):
                made = [[dict(zip(("table_no", "row_no", "cells", "section"), row)) for row in table_rows(text, headings)] for text in piece.column(width).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in range(width)), pa.array(made, ROWS)], names=[*carry, "rows"])

    picked = pages.select(*carry, F.col(html).cast("string"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{head}, rows array<struct<table_no: int, row_no: int, cells: array<string>, section: string>>")


def html_tables(pages: DataFrame, html: str, carry: Sequence[str], headings: Sequence[str] = ()) -> DataFrame:
    """``carry``, table_no, row_no, cells, section and head, the cells of the table's first row, of every table row in the pages; pages without a table have no row."""
    parsed = page_tables(pages, html, carry, headings)
    heads = F.map_from_entries(F.transform(F.filter("rows", lambda r: r.row_no == 0), lambda r: F.struct(r.table_no, r.cells)))
    return parsed.select(*carry, heads.alias("__heads"), F.explode("rows").alias("__r")).select(*carry, "__r.*", F.try_element_at("__heads", F.col("__r.table_no")).alias("head"))


def listing_rows(rows: DataFrame, columns: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Named columns of the tables whose first row has them all: name -> text in the header cell, in any case."""
    place = lambda want: F.array_position(F.transform("head", lambda c: F.lower(c).contains(want.lower())), F.lit(True))
    body = rows.filter("row_no > 0").filter(F.least(*[place(want) for want in columns.values()], F.lit(1 << 30)) > 0)
    return body.select(*keys, "table_no", "row_no", *[F.get("cells", place(want).cast("int") - 1).alias(name) for name, want in columns.items()])


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): a reject carries the sorted names of the rules it breaks; a rule that is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in sorted(rules.items())]), lambda x: x.isNotNull())
    marked = rows.withColumn("errors", broken)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def write_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions that the rows touch; a partition of any size is spread over files."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def not_staged(incoming: DataFrame, staged: DataFrame, url: str = "source_url") -> DataFrame:
    """Incoming rows whose address is not staged yet, one of each."""
    return incoming.join(staged.select(url), url, "left_anti").dropDuplicates([url])


Extractor = Callable[[DataFrame], DataFrame]
#: Extension point: feed name -> function from its landed rows to typed rows.
EXTRACTORS: dict[str, Extractor] = {}


def extractor(feed: str) -> Callable[[Extractor], Extractor]:
    def add(fn: Extractor) -> Extractor:
        EXTRACTORS[feed] = fn
        return fn

    return add
