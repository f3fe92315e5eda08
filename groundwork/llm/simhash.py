"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints of 64 or more bits are dealt into tiles by the population counts
of their two halves. Two fingerprints within the radius have halves whose counts differ by no more
than the radius in sum, so only such tile pairs are compared, each as a numpy
exclusive-or with bit counts. A task reports a spanning forest of the links it finds,
never all pairs; components of those links give the groups.

At the radius that near copies of 0.8 in Jaccard similarity need (a fifth of the bits)
population counts tell nothing apart. There ``deduplicate`` first deals the fingerprints
into cells by keys of their shingle sets (minima of hash functions, which two such sets
share with all but certainty), compares by exclusive-or inside a cell, skipping sets whose
sizes differ too much, and verifies what is left on the sets themselves. What cells and
fingerprints may have missed is looked for between the groups found so far, by the leading shingles
of the sets, of which two such sets always share one (``rest_roots``); so no link is lost.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import ROW, cut, join_hot, map_texts, whole_row

SEED = 42
_ONES = np.uint64(0x0101010101010101)
#: Compare at most so many pairs in one numpy block.
BLOCK = 500_000
#: Beyond this radius the counts tell few fingerprints apart, so tiles are not cut finer.
WIDE = 7
#: Candidates for a Jaccard similarity of 0.8 in 256 bits: each bit differs with a chance of 0.19 at most (four shingles
#: and one more), so over CANDIDATE in all, or over HALF in the first 128, comes less than once in a million such pairs.
CANDIDATE, HALF = 80, 50
#: Cells of a shingle set: BANDS keys of BAND_ROWS minima each. Sets of 0.8 share no key in (1 - 0.8^4)^28 = 4e-7 of the cases.
BANDS, BAND_ROWS = 28, 4
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that SEEN or more of about SAMPLE texts hold come last in the order of leading shingles, MOST_LATE of them
#: at most. The order decides how much is compared, never what is found.
SAMPLE, SEEN, MOST_LATE = 4_096, 4, 65_536
#: Rows of a shingle that meet in one slice, and tables of so many rows at most that are broadcast by hint.
SLICE, FEW = 1_024, 50_000
#: Runs of a cell longer than this are compared as blocks, shorter ones together by offset.
LONG_RUN = 32


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; of all words if there are fewer; empty if there are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the hashes of each row, as 8 big-endian bytes a row."""
    rows, n = hashes.shape
    if not n:
        return np.zeros((rows, 8), np.uint8)
    blocks = np.zeros((rows, -(-n // 255) * 255), np.uint64)
    blocks[:, :n] = hashes
    blocks = blocks.reshape(rows, -1, 255)
    bits = np.empty((8, rows, 8), np.int64)  # [k, row, byte]: count of bit k of each byte, lowest byte first
    for k in range(8):
        sums = ((blocks >> np.uint64(k)) & _ONES).sum(axis=2, dtype=np.uint64)  # eight counters of up to 255 in one word
        bits[k] = sums.astype("<u8").view(np.uint8).reshape(rows, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits((2 * bits > n)[::-1, :, ::-1].transpose(1, 2, 0).reshape(rows, 64), axis=1)


def remix(hashes: np.ndarray) -> np.ndarray:
    """Another 64 bits of each hash."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, width: int, bits: int = 64, repeats: bool = True) -> bytes:
    """Without ``repeats`` each shingle of the text counts once."""
    hashes = shingle_hashes(text, width)
    return print_of(hashes if repeats else np.unique(hashes), bits)


def print_of(hashes: np.ndarray, bits: int) -> bytes:
    words = [hashes]
    while 64 * len(words) < bits:
        words.append(remix(words[-1]))
    return majority(np.stack(words)).tobytes()


#: Hashes of the words a Python worker has seen; emptied when there are more than MOST_WORDS.
_WORDS: dict[bytes, int] = {}
MOST_WORDS = 100_000
_PLACES = np.random.default_rng(SEED + 1).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``width`` words, made of the words' hashes; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_WORDS) > MOST_WORDS:
        _WORDS.clear()
    _WORDS.update((w, xxhash.xxh64_intdigest(w, seed=SEED)) for w in set(words).difference(_WORDS))
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(ids))
    if not width:
        return ids
    mixed = sum((ids[k : len(ids) - width + 1 + k] * _PLACES[k % 64] for k in range(1, width)), ids[: len(ids) - width + 1] * _PLACES[0])
    return np.unique(remix(mixed + np.uint64(width)))


def set_node(hashes: np.ndarray, bits: int) -> bytes:
    """The fingerprint of a set of shingles, a hash of the set and its size: texts of equal sets are one node."""
    return print_of(hashes, bits) + np.array([xxhash.xxh64_intdigest(hashes.tobytes(), seed=SEED), len(hashes)], np.uint64).tobytes()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed 64-bit cells of a set of shingle hashes; sets share a cell of a band if the band's minima agree."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1_024):
        np.minimum(low, (_FACTORS[:, None] * hashes[None, at : at + 1_024]).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        key = remix(key ^ column)
    return key.view(np.int64)


def fingerprints(docs: DataFrame, width: int = 3, bits: int = 64, repeats: bool = True, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and fp (binary) with the bit counts of its halves, lo and hi: null and blank texts have fingerprint 0.

    """

    def run(texts: list) -> list[pa.Array]:
        made = [fingerprint(t, width, bits, repeats) for t in texts]
        halves = np.bitwise_count(np.frombuffer(b"".join(made), np.uint8).reshape(len(made), 2, bits // 16)).sum(axis=2)
        return [pa.array(made, pa.binary()), *(pa.array(halves[:, k], pa.int32()) for k in (0, 1))]

    return map_texts(docs, run, "fp binary, lo int, hi int", carry=carry)


def least_shared(n: int, similar: float) -> int:
    """The least size of a set that is ``similar`` to one of n; not a rounding error more."""
    return math.ceil(similar * n - 1e-9)


def leading(hashes: np.ndarray, similar: float, late: np.ndarray) -> np.ndarray:
    """The leading shingles of a set (sorted, distinct), as signed numbers: two sets of ``similar`` or more have one in common.

    All sets share one order: by hash, those of ``late`` behind all others, in the order they
    have there. A set has least_shared(n) shingles in common with the other at least, so the first of these is
    among as many as the rest and one more; the smaller of both last ones bounds it in both.
    """
    order = np.argsort(late)
    at = np.searchsorted(late[order], hashes)
    known = np.isin(hashes, late)
    rank = order[at[known]] if known.any() else np.zeros(0, np.int64)
    first = np.concatenate([hashes[~known], hashes[known][np.argsort(rank)]])
    return first[: len(hashes) - least_shared(len(hashes), similar) + 1].view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether a set has an odd number of shingles in each of 128 bins, as two signed numbers: a shingle that one of two sets holds alone changes one bit."""
    return np.packbits(np.bincount((hashes & np.uint64(127)).astype(np.int64), minlength=128) & 1).view(np.int64)


def set_nodes(docs: DataFrame, width: int, bits: int, similar: float, late: np.ndarray, carry: tuple[str, ...]) -> DataFrame:
    """``carry``, fp (the ``set_node``, which begins with the fingerprint), bands, the cells of the set, its leading shingles, parities and size."""

    def run(texts: list) -> list[pa.Array]:
        sets = [shingle_set(t, width) for t in texts]
        bands, lead = (pa.array([make(s) for s in sets], pa.list_(pa.int64())) for make in (band_keys, lambda s: leading(s, similar, late)))
        odd = np.stack([parities(s) for s in sets]) if sets else np.zeros((0, 2), np.int64)
        return [pa.array([set_node(s, bits) for s in sets], pa.binary()), bands, lead, *(pa.array(odd[:, k]) for k in (0, 1)), pa.array([len(s) for s in sets], pa.int32())]

    return map_texts(docs, run, "fp binary, bands array<bigint>, lead array<bigint>, odd_0 bigint, odd_1 bigint, size int", carry=carry)


def late_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that many texts of a sample hold, the rarest first."""
    parts = max(1, docs.count() // SAMPLE)
    some = docs.select(_text_key().alias("hash"), F.coalesce("text", F.lit("")).alias("text")).filter(F.pmod("hash", F.lit(parts)) == 0).distinct()
    held = map_texts(some, lambda texts: [pa.array([shingle_set(t, width).view(np.int64) for t in texts], pa.list_(pa.int64()))], "held array<bigint>", carry=("hash",))
    often = held.select(F.explode("held").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN)
    return often.orderBy(F.desc("n"), "shingle").limit(MOST_LATE).toArrow().column("shingle").to_numpy()[::-1].view(np.uint64)


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view("<u2")).reshape(len(x), 4, -1).sum(axis=2).astype(np.int16)


def _close(a: np.ndarray, b: np.ndarray, radius: int, half: int | None = None):
    """Index pairs of rows (of 64-bit words) within the radius, in blocks; with ``half``, the first half of the words within that."""
    half = radius if half is None else half
    step = max(1, BLOCK // max(1, len(b)))
    words, first = a.shape[1], (a.shape[1] + 1) // 2
    columns = [np.ascontiguousarray(b[:, k]) for k in range(words)]
    for at in range(0, len(a), step):
        apart = np.bitwise_count(a[at : at + step, None, 0] ^ columns[0])
        for k in range(1, first):
            apart += np.bitwise_count(a[at : at + step, None, k] ^ columns[k])
        i, j = np.nonzero(apart <= half)
        if words > first and len(i):  # the rest of the words for the pairs that half of them leave
            rest = apart[i, j].astype(np.int64)
            for k in range(first, words):
                rest += np.bitwise_count(a[at + i, k] ^ columns[k][j])
            i, j = i[rest <= radius], j[rest <= radius]
        yield i + at, j


def _links(a: np.ndarray, b: np.ndarray, radius: int, half: int | None = None):
    """As _close; for a small radius, large tiles are cut again by the counts of their quarters."""
    if len(a) * len(b) <= BLOCK or radius > WIDE:
        yield from _close(a, b, radius, half)
        return
    parts = []
    for x in (a, b):
        kinds, inverse = np.unique(_quarters(x), axis=0, return_inverse=True)
        order = np.argsort(inverse.reshape(-1), kind="stable")
        parts.append((kinds, np.split(order, np.cumsum(np.bincount(inverse.reshape(-1)))[:-1])))
    (kinds_a, at_a), (kinds_b, at_b) = parts
    for k, rows in zip(kinds_a, at_a):
        for j in np.nonzero(np.abs(kinds_b - k).sum(axis=1) <= radius)[0]:
            for i, m in _close(a[rows], b[at_b[j]], radius):
                yield rows[i], at_b[j][m]


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the sets of i and j; a root is the smallest index of its set."""
    while len(i):
        i, j = parent[i], parent[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def _sized(x: np.ndarray, y: np.ndarray, similar: float) -> np.ndarray:
    """Whether sets of the nodes' sizes can be so similar."""
    x, y = x[:, -1].astype(float), y[:, -1].astype(float)
    return np.minimum(x, y) >= similar * np.maximum(x, y)


def _forest(ids: np.ndarray, pairs) -> pa.Table:
    """u, v: a spanning forest of the ids of rows under the index pairs; v is the first row of its tree."""
    parent = np.arange(len(ids))
    for i, j in pairs:
        parent = _join(parent, i, j)
    child = np.nonzero(parent != np.arange(len(ids)))[0]
    return pa.table({"u": pa.array(ids[child], pa.int64()), "v": pa.array(ids[parent[child]], pa.int64())})


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)


def _compare(radius: int):
    """Links within the radius between the two sides of a tile pair."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        side, fp, ids = rows.column("side").to_numpy(), _matrix(rows.column("fp")), rows.column("id").to_numpy()
        order = np.argsort(side, kind="stable")
        fp, ids, n = fp[order], ids[order], int((side == 0).sum())
        if key[0].as_py() == key[1].as_py():
            return _forest(ids, _links(fp, fp, radius))
        return _forest(ids, ((i, j + n) for i, j in _links(fp[:n], fp[n:], radius)))

    return run


def _sweep(rows: np.ndarray, x: np.ndarray, similar: float):
    """Index pairs that join the components of all pairs of ``rows`` that may be so similar, by size and fingerprint.

    Rows that are reached leave those that are looked for, so a group of near copies
    costs little more than one comparison with each; only rows apart are all compared.
    """
    words, half = x.shape[1] - 2, (x.shape[1] - 2) // 2
    columns, size = [np.ascontiguousarray(x[rows, k]) for k in range(words)], x[rows, -1].astype(float)
    left, ahead = np.arange(1, len(rows)), [np.array([0])]
    while len(left):
        if not ahead:
            ahead, left = [left[:1]], left[1:]
            continue
        front = ahead.pop()
        step = max(1, BLOCK // len(left))
        front, rest = front[:step], front[step:]
        if len(rest):
            ahead.append(rest)
        apart = sum((np.bitwise_count(c[front, None] ^ c[left]).astype(np.uint16) for c in columns[:half]), np.zeros((len(front), len(left)), np.uint16))
        i, j = np.nonzero(apart <= HALF)
        far = apart[i, j].astype(np.int64) + sum(np.bitwise_count(c[front[i]] ^ c[left[j]]).astype(np.int64) for c in columns[half:])
        p, q = size[front[i]], size[left[j]]
        fit = (far <= CANDIDATE) & (np.minimum(p, q) >= similar * np.maximum(p, q))
        j, first = np.unique(j[fit], return_index=True)
        if len(j):
            yield rows[front[i[fit][first]]], rows[left[j]]
            ahead.append(left[j])
            left = np.delete(left, j)


def _cell_pairs(cell: np.ndarray, x: np.ndarray, side: np.ndarray | None, similar: float):
    """Index pairs that join what may be so similar by size and fingerprint within each cell (``side``: of two tiles of one cell)."""

    def near(i: np.ndarray, j: np.ndarray):
        fit = _sized(x[i], x[j], similar)
        i, j = i[fit], j[fit]
        apart = np.bitwise_count(x[i, :-2] ^ x[j, :-2]).astype(np.int64)
        fit = (apart[:, : apart.shape[1] // 2].sum(axis=1) <= HALF) & (apart.sum(axis=1) <= CANDIDATE)
        return i[fit], j[fit]

    if side is not None:
        yield from _sweep(np.arange(len(x)), x, similar)
        return
    order = np.argsort(cell, kind="stable")
    new = np.concatenate([[True], np.diff(cell[order]) != 0])
    starts = np.nonzero(new)[0]
    size = np.diff(np.append(starts, len(order)))
    for at, n in zip(starts[size > LONG_RUN], size[size > LONG_RUN]):
        yield from _sweep(order[at : at + n], x, similar)
    left = (np.repeat(starts + size, size) - np.arange(len(order))) * (np.repeat(size, size) <= LONG_RUN)  # rows from here to the end of a short run
    for gap in range(1, LONG_RUN):
        first = np.nonzero(left > gap)[0]
        if not len(first):
            return
        yield near(order[first], order[first + gap])


def _compare_cells(similar: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("fp"))
        two = key[1].as_py() != key[2].as_py()
        return _forest(rows.column("id").to_numpy(), _cell_pairs(rows.column("cell").to_numpy(), x, rows.column("side").to_numpy() if two else None, similar))

    return run


def cell_links(kinds: DataFrame, similar: float, tile_rows: int, bucket_rows: int) -> DataFrame:
    """u, v: links between the ids of set nodes (id, fp, bands) whose components are those of all pairs in one cell that may be so similar.

    Many cells share a bucket of about ``bucket_rows`` rows. A cell of over ``tile_rows``
    and a thousandth of all rows is cut into tiles, compared pair by pair; there are
    a thousand such cells at most, so their list can be broadcast.
    """
    total = kinds.count() * BANDS
    limit = max(tile_rows, total // 1000)
    dealt = kinds.select("id", "fp", F.explode("bands").alias("cell"))
    large = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("cell", F.ceil(F.col("n") / tile_rows).alias("tiles"))
    rows = dealt.join(F.broadcast(large), "cell", "left")
    own = F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-total // bucket_rows))))).otherwise(F.pmod(F.xxhash64("id"), F.col("tiles")))
    other = F.when(F.col("tiles").isNull(), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    rows = rows.withColumn("own", own).withColumn("at", F.when(F.col("tiles").isNotNull(), F.col("cell"))).withColumn("other", F.explode(other))
    rows = rows.select("at", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cell", "id", "fp")
    return rows.groupBy("at", "a", "b").applyInArrow(_compare_cells(similar), "u bigint, v bigint")


def tile_links(fps: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """u, v: links between the ids of distinct fingerprints (id, fp, lo, hi) whose components are those of all links within the radius.

    A cell holds the fingerprints whose halves' bit counts lie in the same steps; cells
    whose counts differ beyond the radius are never compared. A large cell is several tiles.
    """
    spark = fps.sparkSession
    step = 1 if radius <= WIDE else radius + 1
    half = fps.select("id", "fp", F.expr(f"lo div {step}").cast("int").alias("lo"), F.expr(f"hi div {step}").cast("int").alias("hi"))
    cells = {(r.lo, r.hi): -(-r.n // tile_rows) for r in half.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n")).collect()}  # 33 x 33 at most
    apart = lambda x, y: max(0, (abs(x - y) - 1) * step + 1) if x != y else 0  # noqa: E731  the least difference of counts in steps x and y
    cell = lambda lo, hi: (lo * 64 + hi) << 20
    near = [(lo, hi, cell(lo, hi), n, [[cell(x, y), m] for (x, y), m in cells.items() if apart(x, lo) + apart(y, hi) <= radius]) for (lo, hi), n in cells.items()]
    near = F.broadcast(spark.createDataFrame(near, "lo int, hi int, cell bigint, tiles bigint, near array<array<bigint>>"))
    own = half.join(near, ["lo", "hi"]).select("id", "fp", "near", (F.col("cell") + F.pmod(F.xxhash64("id"), F.col("tiles"))).alias("own"))
    other = F.flatten(F.transform("near", lambda c: F.transform(F.sequence(F.lit(0).cast("long"), c[1] - 1), lambda k: c[0] + k)))
    dealt = own.select("id", "fp", "own", F.explode(other).alias("other")).select("id", "fp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return dealt.groupBy("a", "b").applyInArrow(_compare(radius), "u bigint, v bigint")


def components(links: DataFrame, most_rounds: int = 60, task_rows: int = 65_536) -> DataFrame:
    """node, root (the component's smallest node) of every node in ``links`` (u, v).

    Alternates large-star and small-star steps; each round ends in a checkpoint, and the
    rounds stop when every node is a root or has one link, to a root. A minimum is taken
    where a node's links meet, without a join; the links of a hub, a node of over 1 / 500 of
    the rows as last counted (so there are 500 at most), stay in slices on many tasks and get its minimum
    by broadcast. The links never become more, so from the first count on they lie in pieces
    of about ``task_rows``, and the driver keeps as few tasks as that takes.
    """
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total = 2 * edges.count()
    for _ in range(most_rounds):
        if not total:
            break
        limit = max(64, total // 500)
        pieces = max(edges.sparkSession.sparkContext.defaultParallelism, -(-total // task_rows))
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        nodes = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        seen = nodes.agg(F.sum("n"), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1)), F.collect_list(F.when(F.col("n") > limit, F.struct("u", "m", "n")))).first()
        total, open_ = seen[0], seen[1]
        if not open_:
            break
        hubs = {r["u"]: (r["m"], -(-r["n"] // limit)) for r in seen[2]}
        large = _with_least(both, hubs).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        if hubs:  # a node has no more rows here than it has links, so these are all that may have many
            large = cut(large.coalesce(pieces))
            few = edges.sparkSession.createDataFrame([(u,) for u in hubs], "u bigint")
            least = large.join(F.broadcast(few), "u").groupBy("u").agg(F.min("v").alias("m")).collect()
            hubs = {r["u"]: (r["m"], hubs[r["u"]][1]) for r in least}
        small = _with_least(large, hubs).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.distinct().coalesce(pieces))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _with_least(rows: DataFrame, hubs: dict[int, tuple[int, int]]) -> DataFrame:
    """u, v and m, the least v of each u; ``hubs``: least v and number of slices of those u whose rows stay apart."""
    known, at = F.lit(None).cast("long"), F.lit(0).cast("long")
    if hubs:
        table = rows.sparkSession.createDataFrame([(u, m, n) for u, (m, n) in hubs.items()], "u bigint, known bigint, slices bigint")
        rows = rows.join(F.broadcast(table), "u", "left")
        known, at = F.col("known"), F.coalesce(F.pmod(F.xxhash64("v"), F.col("slices")), at)
    met = Window.partitionBy("u", "at")
    return rows.withColumn("at", at).withColumn("known", known).select("u", "v", F.coalesce("known", F.min("v").over(met)).alias("m"))


def _verify(radius: int, similar: float):
    """large, u, v: each node with the first node (v) of those it is joined with by sets so similar; pairs joined already are not looked at."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        raw, sets = rows.column("id").to_pylist(), [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
        nodes, side = _matrix(rows.column("fp")), rows.column("side").to_numpy()
        alone = key[2].as_py() == key[3].as_py()
        at_a, at_b = np.nonzero(side == 0)[0], np.nonzero(side == (0 if alone else 1))[0]
        parent = list(range(len(raw)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in _close(nodes[at_a, :-2], nodes[at_b, :-2], radius, HALF):
            i, j = at_a[i], at_b[j]
            fit = _sized(nodes[i], nodes[j], similar) & ((i < j) | (not alone))
            roots = np.fromiter(map(find, range(len(raw))), np.int64)
            fit &= roots[i] != roots[j]
            for x, y in zip(i[fit].tolist(), j[fit].tolist()):
                if (p := find(x)) == (q := find(y)):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both / max(1, len(sets[x]) + len(sets[y]) - both) >= similar:
                    parent[max(p, q)] = min(p, q)
        roots = np.fromiter(map(find, range(len(raw))), np.int64)
        child, ids = np.nonzero(roots != np.arange(len(raw)))[0], np.array(raw, np.int64)
        large = pa.array(np.full(len(child), key[0].as_py()), pa.bool_())
        return pa.table({"large": large, "u": pa.array(ids[child], pa.int64()), "v": pa.array(ids[roots[child]], pa.int64())})

    return run


def verified_roots(docs: DataFrame, kinds: DataFrame, similar: float, width: int, tile_rows: int, set_rows: int) -> DataFrame:
    """node, root of the set nodes with links of ``similar`` or more in exact Jaccard similarity.

    Cells and fingerprints give candidates. Only their sets travel, to tiles of ``set_rows``
    within their component of candidates; small components share a tile, and the links
    found there are all there are of them, so only those over many tiles are joined again.
    """
    near = cut(components(cell_links(kinds, similar, tile_rows, 4 * tile_rows)))
    count = near.count()
    near = cut(join_hot(near, near.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", "node", count, keep_n=True))
    tiles, spread = F.ceil(F.col("n") / set_rows).cast("int"), max(1, -(-count // set_rows))
    asked = near.join(kinds, near.node == kinds.id).select("id", "fp", tiles.alias("tiles"), F.when(tiles > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(spread))).alias("bucket"), _name(F.col("first.doc_id")).alias("__of"), F.col("first.hash").alias("__key"))
    texts = docs.select(_name(F.col("doc_id")).alias("__of"), _text_key().alias("__key"), "text").join(asked, ["__of", "__key"]).dropDuplicates(["__of", "__key"])
    sets = map_texts(texts, lambda many: [pa.array([shingle_set(t, width).tobytes() for t in many], pa.binary())], "shingles binary", carry=("id", "fp", "tiles", "bucket"))
    own = sets.withColumn("large", F.col("tiles") > 1).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("large", "bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "fp", "shingles")
    links = cut(dealt.groupBy("large", "bucket", "a", "b").applyInArrow(_verify(CANDIDATE, similar), "large boolean, u bigint, v bigint"))
    small = links.filter("not large")
    small = small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return small.unionByName(components(links.filter("large").select("u", "v")))


def few(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= FEW else df


def apart_pairs(kinds: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """u, v: the set nodes of different roots whose sets may be so similar by sizes, parities and leading shingles.

    A shingle that leads sets of one root only is done with. Two sets differ in as many
    shingles as in parities at least. Of the shingles that two such sets share, those that lead both are
    counted; the others lie behind the leading ones of the set whose leading ones end first, so
    they are no more than that set has there.
    """
    group = kinds.join(few(roots.select(F.col("node").alias("id"), "root"), roots.count()), "id", "left").withColumn("root", F.coalesce("root", "id"))
    met = group.select(F.explode("lead").alias("shingle"), "root").groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n"))
    met = cut(met.filter("a < b").select("shingle", F.ceil(F.col("n") / SLICE).alias("slices")))
    rows = kinds.select(F.explode("lead").alias("shingle"), "id").join(few(met, met.count()), "shingle")
    rows = cut(rows.join(group.select("id", "root", "size", "odd_0", "odd_1"), "id"))
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("id", "root", "size", "odd_0", "odd_1")]
    left = rows.select("shingle", F.pmod(F.xxhash64("id"), F.col("slices")).alias("slice"), *side("u"))
    right = rows.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), *side("v"))
    less, more = F.least("u_size", "v_size"), F.greatest("u_size", "v_size")
    need = F.ceil(similar / (1 + similar) * (less + more) - 1e-9)  # of similar sets at least so many are shared
    apart = F.bit_count(F.col("u_odd_0").bitwiseXOR(F.col("v_odd_0"))) + F.bit_count(F.col("u_odd_1").bitwiseXOR(F.col("v_odd_1")))
    fit = (F.col("u_id") < F.col("v_id")) & (F.col("u_root") != F.col("v_root")) & (less >= similar * more - 1e-9) & (apart <= less + more - 2 * need)
    pairs = left.join(right, (left.shingle == right.shingle) & (left.slice == right.slice) & fit)
    pairs = pairs.groupBy(F.col("u_id").alias("u"), F.col("v_id").alias("v")).agg(F.count(F.lit(1)).alias("shared"), F.max(need).alias("need"), F.max(more).alias("more"))
    return pairs.filter(F.col("shared") + F.ceil(similar * F.col("more") - 1e-9) - 1 >= F.col("need")).select("u", "v")


def _verify_pairs(similar: float):
    """u, v: a forest of the given pairs whose sets are so similar."""

    def run(key: tuple, pairs: pa.Table, rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids)
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
        parent = list(range(len(ids)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        ends = (order[np.searchsorted(ids[order], pairs.column(c).to_numpy())].tolist() for c in ("u", "v"))
        for x, y in zip(*ends):
            if (p := find(x)) != (q := find(y)):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both / max(1, len(sets[x]) + len(sets[y]) - both) >= similar:
                    parent[max(p, q)] = min(p, q)
        tops = np.fromiter(map(find, range(len(ids))), np.int64, len(ids))
        child = np.nonzero(tops != np.arange(len(ids)))[0]
        return pa.table({"u": pa.array(ids[child], pa.int64()), "v": pa.array(ids[tops[child]], pa.int64())})

    return run


def rest_roots(docs: DataFrame, kinds: DataFrame, roots: DataFrame, similar: float, width: int, set_rows: int) -> DataFrame:
    """``roots`` (node, root) joined by every link of ``similar`` or more that is still missing between nodes of different roots.

    Pairs are dealt into tiles by both nodes; a tile gets its pairs and the sets they name,
    of about ``set_rows`` nodes a side.
    """
    pairs = cut(apart_pairs(kinds, roots, similar))
    if not pairs.count():
        return roots
    asked = cut(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct())
    count = asked.count()
    named = kinds.join(few(asked, count), "id").select("id", _name(F.col("first.doc_id")).alias("__of"), F.col("first.hash").alias("__key"))
    texts = docs.select(_name(F.col("doc_id")).alias("__of"), _text_key().alias("__key"), "text").join(few(named, count), ["__of", "__key"]).dropDuplicates(["__of", "__key"])
    sets = map_texts(texts, lambda many: [pa.array([shingle_set(t, width).tobytes() for t in many], pa.binary())], "shingles binary", carry=("id",))
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-count // set_rows))))
    dealt = pairs.select(tile("u").alias("a"), tile("v").alias("b"), "u", "v")
    wanted = dealt.select(F.col("a").alias("at_a"), F.col("b").alias("at_b"), F.explode(F.array("u", "v")).alias("id")).distinct().join(sets, "id")
    found = cut(dealt.groupBy("a", "b").cogroup(wanted.groupBy("at_a", "at_b")).applyInArrow(_verify_pairs(similar), "u bigint, v bigint"))
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found)) if found.count() else roots


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, bits: int = 64, tile_rows: int = 32_768) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per input row.

    Texts whose fingerprints differ in ``radius`` bits or fewer are linked; component_id is
    the smallest doc_id reachable. Null and blank texts share fingerprint 0 and are linked
    like any other; short texts hash whole. Exact copies fall together by fingerprint
    before any comparison. Rows without a doc_id take part, and have a component_id if any
    row they reach has an id. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, width, bits))
    kinds = cut(fps.groupBy("fp").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    roots = components(tile_links(kinds, radius, tile_rows))
    linked = cut(kinds.join(roots, kinds.id == roots.node).select("fp", "first", "n", "root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("n"))
    known = join_hot(linked.withColumnRenamed("n", "of"), least, "root", "fp", linked.count()).select("fp", "component", F.col("of").alias("n"))
    alone = kinds.filter("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("first").alias("component"), "n")
    out = join_hot(fps, known.unionByName(alone), "fp", "doc_id", fps.count(), how="left")
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))


def _name(doc_id: Column) -> Column:
    """Never null, so that join and deduplication share one exchange."""
    return F.coalesce(doc_id.cast("string"), F.lit("~"))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def deduplicate(docs: DataFrame, width: int = 5, similar: float = 0.8, bits: int = 256, tile_rows: int = 32_768, set_rows: int = 2_048) -> DataFrame:
    """The rows and columns of ``docs``, with one row of each group of near copies: that of the smallest doc_id.

    Groups are links of ``similar`` (0.8 or more) in exact Jaccard similarity of the sets of
    ``width``-word shingles. Cells and fingerprints say which pairs are looked at first; the
    links they miss are found by the leading shingles of the sets.
    Texts without a word are copies of each other. Rows without an id come last in their
    group; of rows alike in id and text one stays. Rows of equal id and different texts
    are different documents. Other columns are kept as they are, whatever their names.
    An empty table gives an empty result.
    """
    if similar < 0.8 or bits != 256:
        raise ValueError("candidates are made for a similarity of 0.8 or more in 256 bits")
    late = late_shingles(docs, width)
    nodes = cut(set_nodes(docs.select("doc_id", _text_key().alias("hash"), "text"), width, bits, similar, late, carry=("doc_id", "hash")))
    kinds = cut(nodes.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first"), *(F.first(c).alias(c) for c in ("bands", "lead", "odd_0", "odd_1", "size"))).withColumn("id", F.monotonically_increasing_id()))
    roots = cut(verified_roots(docs, kinds, similar, width, tile_rows, set_rows))
    roots = rest_roots(docs, kinds, roots, similar, width, set_rows)
    kinds = kinds.join(roots, kinds.id == roots.node, "left").select("first", "root")
    winners = kinds.filter("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first").unionByName(kinds.filter("root is null").select("first"))
    winners = winners.select(_name(F.col("first.doc_id")).alias("__of"), F.col("first.hash").alias("__key"))
    rows = docs.select(whole_row(docs), _name(F.col("doc_id")).alias("__of"), _text_key().alias("__key"))
    return rows.join(winners, ["__of", "__key"], "left_semi").dropDuplicates(["__of", "__key"]).select(f"{ROW}.*")
