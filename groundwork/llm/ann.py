"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Vectors are listed under their nearest coarse centroid; the residual's direction is
product-quantised and its length kept. A query visits the lists that promise most,
scores their codes with asymmetric distance tables of its own, and the best of all
lists are reranked exactly on the original vectors. Only codes are shuffled to tiles of
neighbouring lists, and a query goes to the tiles that hold a list it visits; a tile is
cut by the queries that ask for it. The original vectors are joined to the shortlist.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import cut


@dataclass
class Codebooks:
    centroids: np.ndarray  # lists x dimensions, neighbours in a row
    spread: np.ndarray  # root mean square residual of each list
    parts: list[np.ndarray]  # dimension indices of each subspace
    words: list[np.ndarray]  # codewords x dimensions of the subspace
    visited: int = 1  # lists that a query visits


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c.astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def in_a_row(centroids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An order of the centroids in which neighbours stand together."""
    coarse = k_means(centroids, max(1, round(len(centroids) ** 0.5)), 5, rng)
    chain = [0]
    left = set(range(1, len(coarse)))
    while left:
        at = np.array(sorted(left))
        chain.append(int(at[np.argmin(((coarse[at] - coarse[chain[-1]]) ** 2).sum(axis=1))]))
        left.remove(chain[-1])
    return np.argsort(np.argsort(chain)[nearest(centroids, coarse)], kind="stable")


def learn(sample: np.ndarray, lists: int, subspaces: int, codewords: int = 256, seed: int = 3, rows: int | None = None, k: int = 20, target: float = 0.985) -> Codebooks:
    """Codebooks of a sample of a table of ``rows`` vectors, and the number of lists that hold ``target`` of a query's nearest ``k``."""
    rng = np.random.default_rng(seed)
    sample = sample.astype(np.float32)
    centroids = k_means(sample, lists, 8, rng)
    centroids = centroids[in_a_row(centroids, rng)]
    near = nearest(sample, centroids)
    residual = sample - centroids[near]
    length = np.linalg.norm(residual, axis=1)
    n = np.maximum(np.bincount(near, minlength=len(centroids)), 1)
    spread = np.sqrt(np.bincount(near, length**2, len(centroids)) / n)
    unit = residual[length > 0] / length[length > 0, None]
    if not len(unit):
        unit = np.zeros((1, sample.shape[1]), np.float32)
    parts = [p for p in np.array_split(np.arange(sample.shape[1]), subspaces) if len(p)]
    books = Codebooks(centroids, spread, parts, [k_means(np.ascontiguousarray(unit[:, p]), codewords, 5, rng) for p in parts])
    books.visited = lists_to_visit(books, sample, near, max(1, round(k * len(sample) / (rows or len(sample)))), target, rng)
    return books


def lists_to_visit(books: Codebooks, sample: np.ndarray, near: np.ndarray, k: int, target: float, rng: np.random.Generator, queries: int = 400) -> int:
    """So many of its best lists hold ``target`` of the nearest ``k`` of the sample, over queries drawn from it.

    The nearest k of a sample stand for the nearest of the table in the sample's share; a
    smaller share than one only makes them farther off, and the number of lists larger.
    """
    at = rng.choice(len(sample), min(queries, len(sample)), replace=False)
    score = sample[at] @ sample.T
    score[np.arange(len(at)), at] = -np.inf
    k = min(k, max(1, len(sample) - 1))
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-reach(books, sample[at]), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def encode(books: Codebooks, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, residual length and codes of each vector."""
    near = nearest(x, books.centroids)
    residual = x - books.centroids[near]
    length = np.linalg.norm(residual, axis=1)
    unit = residual / np.maximum(length, 1e-30)[:, None]
    codes = np.stack([nearest(np.ascontiguousarray(unit[:, p]), w) for p, w in zip(books.parts, books.words)], axis=1).astype(np.uint8)
    return near, length, codes


def reach(books: Codebooks, q: np.ndarray) -> np.ndarray:
    """The best inner product that a query may expect of each list."""
    return q @ books.centroids.T + 3.0 * np.linalg.norm(q, axis=1)[:, None] * books.spread / np.sqrt(q.shape[1])


def visits(books: Codebooks, q: np.ndarray) -> np.ndarray:
    """Whether each query visits each list."""
    r = reach(books, q)
    seen = np.zeros(r.shape, bool)
    np.put_along_axis(seen, np.argsort(-r, axis=1, kind="stable")[:, : books.visited], True, axis=1)
    return seen


def table_scores(tables: list[np.ndarray], centre: np.ndarray, near: np.ndarray, length: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products of queries and coded vectors by the queries' tables: residual codewords (by subspace) and centroids."""
    score = np.zeros((len(centre), len(near)), np.float32)
    for table, code in zip(tables, codes):
        score += table.take(code, axis=1)
    score *= length
    score += centre.take(near, axis=1)
    return score


def best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row: the largest score first, ties to the smaller id."""
    order = np.lexsort((ids, -score, rows))
    first = np.concatenate([[True], np.diff(rows[order]) != 0]) if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def search(vectors: DataFrame, k: int = 20, every: int = 20, target: float = 0.985, depth: int = 64, sample_rows: int = 16_384, vector_tile: int = 65_536, query_tile: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` its nearest other vectors.

    Vectors (vec_id, embedding) that are null, zero, hold null or non-finite components,
    have no id or another length than most take no part. Scores are inner products in
    double precision on the original vectors; ties go to the smaller vec_id. Fewer than k
    candidates give fewer rows; an empty table gives an empty result. An id names one
    vector: of rows that repeat it the smallest vector counts. The codebooks are
    fitted on about ``sample_rows`` vectors, and with them the number of lists a query
    visits (``target`` of the nearest in the sample lie there); every vector is indexed.
    There are two lists for each unit of the square root of the count, so far as the
    sample has 16 rows for each: with the default sample 1,024 lists at most, so above 262,144
    vectors lists grow with the table. A larger ``sample_rows`` gives more lists. ``depth`` candidates of a query are reranked (k at least).
    """
    depth = max(depth, k)
    good = F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(good)
    size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, n = size["d"], size["n"]
    rows = rows.filter(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = cut(rows)  # of copies of an id one is left, and later steps read the vectors from here
    share = min(1.0, sample_rows / n)  # of all hash values, so it is exact for any count
    draw = F.xxhash64(F.lit(11), "vec_id") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)).cast("long")
    sample = rows.filter(draw).limit(2 * sample_rows).orderBy("vec_id").select("embedding").toPandas()["embedding"]
    if not len(sample):  # a few rows, none of them drawn
        sample = rows.limit(sample_rows).toPandas()["embedding"]
    sample = np.stack(sample.to_numpy()).astype(np.float64)
    books = learn(sample, max(1, min(2 * round(n**0.5), len(sample) // 16)), max(1, d // 2), rows=n, k=k, target=target)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def index(batches):
        for batch in batches:
            near, length, codes = encode(books, matrix(batch.column(1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), pa.array(length, pa.float32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "id", "length", "codes"])

    listed = cut(rows.mapInArrow(index, "list int, id bigint, length float, codes binary"))
    # the lists' sizes are a small table of one row for each list: tiles are runs of whole lists, or parts of a long one
    counts = np.zeros(len(books.centroids), np.int64)
    for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["list"]] = r["n"]
    wanted = max(-(-n // vector_tile), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 1024), 1)
    tile_of = np.minimum((np.cumsum(counts) - counts) * wanted // max(1, counts.sum()), wanted - 1)  # by the place of a list's first row
    parts = np.maximum(1, -(-counts // min(vector_tile, -(-n // wanted))))  # a list longer than a tile is cut by a hash of ids
    queries = rows.filter(F.col("vec_id") % every == 0)

    def ask(batches):
        firsts = np.concatenate([[0], np.nonzero(np.diff(tile_of))[0] + 1])
        for batch in batches:
            x = matrix(batch.column(1)).astype(np.float32)
            at, tile = np.nonzero(np.logical_or.reduceat(visits(books, x), firsts, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(tile_of[firsts][tile], pa.int32()), batch.column(0).take(pa.array(at)), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["tile", "id", "vec"])

    asked = cut(queries.mapInArrow(ask, "tile int, id bigint, vec binary"))
    blocks = {r["tile"]: -(-r["n"] // query_tile) for r in asked.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {int(t): int(parts[tile_of == t].max()) for t in np.unique(tile_of)}
    number = lambda m: F.create_map(*[x for key, value in sorted(m.items()) for x in (F.lit(int(key)), F.lit(int(value)))])
    if not blocks:
        return vectors.sparkSession.createDataFrame([], schema)
    left = listed.withColumn("tile", F.element_at(F.array(*map(F.lit, tile_of.tolist())), F.col("list") + 1).cast("int")).withColumn("qs", F.element_at(number(blocks), F.col("tile"))).filter("qs is not null")
    part = F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("list") + 1)).cast("int")
    left = left.select("tile", part.alias("v"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.lit(False).alias("asks"), "id", "list", "length", F.col("codes").alias("data"))
    right = asked.select("tile", F.explode(F.sequence(F.lit(0), F.element_at(number(most), F.col("tile")) - 1)).alias("v"), F.pmod(F.xxhash64("id"), F.element_at(number(blocks), F.col("tile"))).cast("int").alias("q"), F.lit(True).alias("asks"), "id", F.lit(None).cast("int").alias("list"), F.lit(None).cast("float").alias("length"), F.col("vec").alias("data"))

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        asks, ids = t.column("asks").to_numpy(), t.column("id").to_numpy()
        vs, qs = np.nonzero(~asks)[0], np.nonzero(asks)[0]
        found = []
        if len(vs) and len(qs):
            vs = vs[np.argsort(t.column("list").combine_chunks().take(pa.array(vs)).to_numpy(), kind="stable")]
            data = t.column("data").combine_chunks()
            q = np.frombuffer(b"".join(data.take(pa.array(qs)).to_pylist()), np.float32).reshape(-1, d)
            codes = np.ascontiguousarray(np.frombuffer(b"".join(data.take(pa.array(vs)).to_pylist()), np.uint8).reshape(len(vs), -1).T)
            near, length = t.column("list").combine_chunks().take(pa.array(vs)).to_numpy(), t.column("length").combine_chunks().take(pa.array(vs)).to_numpy()
            own, mine = ids[vs], ids[qs]
            ends = np.append(np.nonzero(np.diff(near))[0] + 1, len(near))  # of the lists; runs of whole lists are scored together
            ends = ends[np.append(np.diff(ends // 2_048) != 0, True)]
            step = max(1, min(1_024, (1 << 24) // len(vs)))
            for i in range(0, len(q), step):
                some = q[i : i + step]
                seen, centre = visits(books, some), some @ books.centroids.T
                tables = [some[:, p] @ w.T for p, w in zip(books.parts, books.words)]
                score = np.full((len(some), len(vs)), -np.inf, np.float32)
                for a, b in zip([0, *ends[:-1]], ends):
                    r = np.nonzero(seen[:, near[a] : near[b - 1] + 1].any(axis=1))[0]  # those that visit a list of the run
                    if len(r):
                        found_here = table_scores([t[r] for t in tables], centre[r], near[a:b], length[a:b], codes[:, a:b])
                        score[r, a:b] = np.where(seen[r][:, near[a:b]], found_here, -np.inf)
                score[mine[i : i + step, None] == own] = -np.inf  # a query is no candidate of its own
                if depth < score.shape[1]:
                    least = np.partition(score, score.shape[1] - depth, axis=1)[:, score.shape[1] - depth]
                    r, c = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                else:
                    r, c = np.nonzero(score > -np.inf)
                keep = best(r, score[r, c], own[c], depth)
                found.append((mine[i + r[keep]], own[c[keep]], score[r[keep], c[keep]]))
        a, b, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "near": pa.array(s, pa.float32())})

    def first(df: DataFrame, by: str, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id"))
        return df.withColumn("rank", rank).filter(F.col("rank") <= most)

    near = left.unionByName(right).groupBy("tile", "v", "q").applyInArrow(tile, "query_id bigint, vec_id bigint, near float")
    short = first(near, "near", depth).select("query_id", "vec_id")
    both = short.join(rows, "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")), "query_id")
    products = F.zip_with("embedding", "asked", lambda x, y: x.cast("double") * y.cast("double"))
    scored = both.select("query_id", "vec_id", F.aggregate(products, F.lit(0.0), lambda a, x: a + x).alias("score"))
    return first(scored, "score", k).select("query_id", "rank", "vec_id", "score")
