"""Packing by optimal length buckets.

A dynamic programme over the global length histogram picks the bucket bounds that
minimise padding; inside each bucket, rows in a seeded shuffle form batches of at
most ``token_budget`` padded tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm import bpe_count
from groundwork.llm.common import cut, hex_digits, ranked, shuffle_key, words_of


def optimal_bounds(top: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Bounds among the distinct lengths ``top`` (ascending) with the least padding sum; ties take the earlier split.

    ``count`` rows have each length; a row in a bucket is padded to its bound. The best
    split of a longer prefix is never before that of a shorter one (the cost is Monge), so
    a layer is solved by halving: the middle splits of all open ranges at once, each
    within the splits of its neighbours. That is exact, in about g log g steps a layer.
    """
    g = len(top)
    if g == 0:
        return []
    top, count = np.asarray(top, np.int64), np.asarray(count, np.int64)
    c, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * top)])
    none = np.iinfo(np.int64).max // 4
    cost = np.concatenate([[0], np.full(g, none)])
    back = []
    for _ in range(min(buckets, g)):
        new, came = np.full(g + 1, none), np.zeros(g + 1, np.int64)
        low, high, first, last = (np.array([x]) for x in (1, g, 0, g - 1))  # prefixes low..high take splits first..last
        while len(low):
            mid = (low + high) // 2
            end = np.minimum(last, mid - 1)
            n = end - first + 1
            start = np.cumsum(n) - n
            i = np.arange(n.sum()) - np.repeat(start, n) + np.repeat(first, n)
            j = np.repeat(mid, n)
            options = cost[i] + top[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
            new[mid] = np.minimum.reduceat(options, start)
            hit = np.nonzero(options == np.repeat(new[mid], n))[0]
            came[mid] = i[hit[np.searchsorted(hit, start)]]  # the earliest
            low, high, first, last = np.concatenate([low, mid + 1]), np.concatenate([mid - 1, high]), np.concatenate([first, came[mid]]), np.concatenate([came[mid], last])
            open_ = low <= high
            low, high, first, last = low[open_], high[open_], first[open_], last[open_]
        back.append(came)
        cost = new
    bounds, j = [], g
    for came in reversed(back):
        bounds.append(int(top[j - 1]))
        j = came[j]
    return bounds[::-1]


def word_length(text: str = "text") -> Column:
    return F.size(words_of(F.col(text))).cast("long")


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, token_budget: int = 65_536, seed: int = 17, slice_rows: int = 20_000, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bound, batch, slot, padding: one row per input row.

    ``length`` is the row's token count (default: tokens of ``text`` by ``vocabulary``, as
    ``bpe_count`` counts them; null text: 0).
    A batch holds max(1, token_budget // bound) rows of one bucket, so a row longer
    than the budget is a batch of its own; nothing is cut or dropped. Empty texts
    share the bucket of their length. Repeated rows and equal ids are separate rows.
    An empty table gives an empty result. The driver sees only the histogram of distinct
    lengths, which has fewer rows than the root of twice the total of tokens.
    """
    if length is None:
        rows = bpe_count.token_counts(docs, vocabulary).select("doc_id", "n_tokens")
    else:
        rows = docs.select("doc_id", F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
    rows = cut(rows)
    cells = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toPandas()
    bounds = optimal_bounds(cells["n_tokens"].to_numpy(), cells["n"].to_numpy(), buckets)
    bucket, bound = F.lit(0), F.lit(0)
    for i in range(len(bounds) - 1, -1, -1):
        fits = F.col("n_tokens") <= bounds[i]
        bucket, bound = F.when(fits, i).otherwise(bucket), F.when(fits, F.lit(bounds[i])).otherwise(bound)
    rows = rows.select("doc_id", "n_tokens", bucket.alias("bucket"), bound.cast("long").alias("bound"), shuffle_key(seed, F.col("doc_id"), F.col("n_tokens")).alias("__key"))
    rows = ranked(rows, ["bucket"], "__key", hex_digits(int(cells["n"].sum()), slice_rows), "rank")
    fit = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bound"), F.lit(1)))).cast("long")
    return rows.select("doc_id", "n_tokens", "bucket", "bound", F.floor(F.col("rank") / fit).alias("batch"), (F.col("rank") % fit).alias("slot"), (F.col("bound") - F.col("n_tokens")).alias("padding"))
