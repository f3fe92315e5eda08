"""Published documents of many notices, cut into pieces that each hold a bounded number of parcels."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cut:
    """How documents are cut.

    ``seam`` begins a notice; what is shorter than ``least`` signs is no notice. A notice of more
    than ``most`` signs or ``parcels`` parcel numbers is cut in front of every ``parcels``-th
    number, at the start of its record: the lines of owners that stand right above it. ``closing``
    words begin the text that goes with every piece, ``tail`` signs of it; so do its first ``head`` signs.
    """

    # The heading of a notice, parcel numbers, lines of owners, closing words and sizes.
    seam: str = r"NOTICE\s+OF\s+EXPIRATION\s+OF\s+REDEMPTION"
    parcel: str = r"(?<![\d$(.,\-A-Za-z])(?:[A-Za-z]{2}[ \t]+)?\d[\d.\-]{5,}\d(?![\d.\-])"
    digits: int = 8
    owner: str = r"[A-Z][A-Z0-9 .,'&+/-]{3,}"
    closing: tuple[str, ...] = ("FAILURE TO REDEEM", "The amounts listed above must be paid", "The time for redemption of the parcels")
    least: int = 400
    most: int = 7_000
    parcels: int = 15
    head: int = 1_400
    tail: int = 2_600


def parcel_starts(text: str, how: Cut) -> list[int]:
    return [m.start() for m in re.finditer(how.parcel, text) if sum(c.isdigit() for c in m[0]) >= how.digits]


def record_starts(text: str, starts: Sequence[int], how: Cut) -> list[int]:
    """Where the record of each parcel number begins: up over owner lines, to a blank line, another kind of line or one with a parcel number."""
    lines = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
    numbered, at, upper = set(), [], 0
    for s in starts:
        while lines[upper + 1] <= s:
            upper += 1
        at.append(upper)
        numbered.add(upper)
    out, owner = [], re.compile(how.owner)
    for line in at:
        first = line
        while first > 0 and first - 1 not in numbered and owner.fullmatch(text[lines[first - 1] : lines[first] - 1].strip()):
            first -= 1
        out.append(lines[first])
    return out


def bodies(text: str, how: Cut) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one notice; together they hold every parcel number once."""
    starts = parcel_starts(text, how)
    if len(starts) <= 1 or len(text) <= how.most and len(starts) <= how.parcels:
        return [(0, len(text))]
    cuts = sorted(set(record_starts(text, starts[:: how.parcels], how)))
    return list(zip(cuts, [*cuts[1:], len(text)]))


def notices_of(text: str, how: Cut) -> list[tuple[int, int]]:
    """(start, end) of the notices of a document; a document without a heading is one."""
    seams = [m.start() for m in re.finditer(how.seam, text, re.IGNORECASE)]
    parts = [(a, b) for a, b in zip([0, *seams], [*seams, len(text)]) if len(text[a:b].strip()) >= how.least]
    return parts or ([(0, len(text))] if text.strip() else [])


def pieces(text: str | None, how: Cut) -> list[tuple[int, int, int, int, str]]:
    """(notice, piece, start, end, context) of a document; context is empty where a notice is one piece."""
    out = []
    for n, (a, b) in enumerate(notices_of(text or "", how)):
        notice = text[a:b]
        parts = bodies(notice, how)
        context = ""
        if len(parts) > 1 or parts[0] != (0, len(notice)):
            found = [i for i in map(notice.find, how.closing) if i >= 0]
            closing = notice[min(found) :][: how.tail].strip() if found else ""
            context = notice[: how.head].strip() + (f"\n...\n{closing}" if closing else "")
        out += [(n, k, a + s, a + e, context) for k, (s, e) in enumerate(parts)]
    return out


PIECES = "notice int, piece int, start_at int, end_at int, context string, body string, parcels int"


def split_documents(documents: DataFrame, text: str, carry: Sequence[str], how: Cut = Cut()) -> DataFrame:
    """``carry``, notice, piece, start_at, end_at, context, body, parcels: a row for each piece of each document.

    A document without text has no row. A document is cut where it lies; nothing is shuffled.
    """
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, t in enumerate(batch.column(width).to_pylist()):
                for notice, piece, start, end, context in pieces(t, how):
                    at.append(i)
                    body = t[start:end].strip()
                    made.append((notice, piece, start, end, context, body, len(parcel_starts(body, how))))
            kinds = [pa.int32()] * 4 + [pa.string()] * 2 + [pa.int32()]
            columns = [pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * 7, kinds)]
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(width)), *columns], names=[*carry, "notice", "piece", "start_at", "end_at", "context", "body", "parcels"])

    picked = documents.select(*carry, F.col(text).cast("string"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{head}, {PIECES}")
