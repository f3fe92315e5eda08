"""Source divergence audit: how far the word shares of each source of a language lie from those of the others.

Terms are counted in each task first, then by (language, source, term). A term's sparse vector of
counts by source is all that its divergences depend on, so terms with equal vectors are grouped:
every pair of sources is evaluated once for a distinct vector and multiplied by the number of
its terms. Only the ranks of single terms go back to the terms themselves.

All arithmetic is in whole numbers: a share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), a
divergence floor((p - q)^2 / (p + q)).

Null text, language and source are read as ''. Repeated rows count as often as they are there
(also as documents of a term). A language without kept terms has pairs of value 0 and no terms.
Other columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import cut

#: Terms of fewer documents of a language are not kept.
LEAST_DOCS = 10
SCALE = 1_000_000_000
#: Ranks of terms in a report.
TOP = 10
#: Terms that a task counts before it passes their counts on; vectors that are evaluated together.
HELD, TOGETHER = 400_000, 4_096
#: So many rows (groups, vectors in the first ranks) are sent to all executors; more are joined by a shuffle.
SENT = 50_000
#: Counts of a block of evaluations: vectors x sources.
BLOCK = 1 << 20

#: Bytes of UTF-8 that belong to terms, A-Z in lower case, and spaces for all others.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def terms(text: str) -> list[bytes]:
    """Runs of letters A to Z and of all that is not ASCII, in UTF-8, A-Z in lower case."""
    return text.encode().translate(_TERMS).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task by (language, source, term), passed on whenever ``HELD`` terms are held."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            names = pa.array(n, pa.binary()).cast(pa.string())
            same = [pa.array([x]).take(pa.array(np.zeros(len(n), np.int64))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, names, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text)
            n.update(found)
            docs.update(set(found))
            if sum(len(x) for x, _ in counts.values()) > HELD:
                yield from passed()
    yield from passed()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) in decimals, which hold it for any count."""
    over = (count + 2).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", over, (total + 2 * kept).cast("decimal(28,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """The same for arrays of counts (terms x sources), in two steps that stay below 2^63 for totals under 2^48."""
    top, below = counts + 2, totals + 2 * kept
    whole, rest = np.divmod(top * 32_000, below)  # 10^9 = 32,000 x 31,250
    return 1 + whole * 31_250 + rest * 31_250 // below


def pair_sums(counts: np.ndarray, times: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """Sums of divergences over vectors, each times its multiplicity, for every pair of sources: sources x sources, upper part."""
    n = counts.shape[1]
    out = np.zeros((n, n), np.int64)
    step = max(1, BLOCK // max(n, 1))
    for at in range(0, len(counts), step):
        p, m = shares(counts[at : at + step], totals, kept), times[at : at + step, None]
        for i in range(n - 1):
            own, other = p[:, i, None], p[:, i + 1 :]
            out[i, i + 1 :] += ((own - other) ** 2 // (own + other) * m).sum(axis=0)
    return out


def sent(rows: DataFrame) -> DataFrame:
    """Checkpointed rows, marked for a broadcast if they are few: a join before a window then leaves the window its cut in front of the shuffle."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


PAIRS = "lang string, one string, other string, value bigint"


def evaluate(vectors: pa.Table, sources: pa.Table) -> pa.Table:
    """Pairs of the sources of one language, summed over one part of its distinct vectors."""
    names = sources.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    column = {names[i]: k for k, i in enumerate(order)}
    made: list[list] = [[], [], [], []]
    if vectors.num_rows and names:
        totals = sources.column("total").to_numpy()[order]
        kept = sources.column("kept")[0].as_py()
        sets = vectors.column("vec").combine_chunks()
        flat = sets.flatten()
        rows = np.repeat(np.arange(len(sets)), np.diff(sets.offsets.to_numpy()))
        ids = np.array([column[s] for s in flat.field("source").to_pylist()], np.int64)
        counts = np.zeros((len(sets), len(names)), np.int64)
        counts[rows, ids] = flat.field("n").to_numpy()
        sums = pair_sums(counts, vectors.column("m").to_numpy(), totals, kept)
        one, other = np.triu_indices(len(names), 1)
        sorted_names = [names[i] for i in order]
        lang = vectors.column("lang")[0].as_py()
        made = [[lang] * len(one), [sorted_names[i] for i in one], [sorted_names[i] for i in other], sums[one, other].tolist()]
    return pa.table(made, schema=pa.schema([("lang", pa.string()), ("one", pa.string()), ("other", pa.string()), ("value", pa.int64())]))


def term_vectors(docs: DataFrame, least_docs: int) -> DataFrame:
    """Kept terms: lang, term, vec (source and count, by source), total."""
    counted = docs.mapInArrow(count_terms, COUNTED).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    return by_term.filter(F.col("docs") >= least_docs).drop("docs")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence (``pair``) and the words that a source has too many of (``term``)."""
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut(term_vectors(docs, least_docs))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("all"))
    entries = kept.select("lang", F.explode("vec").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(entries, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept", "all")]))

    distinct = cut(kept.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m"), F.min("term").alias("first"), F.first("total").alias("n_all")))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("kept") / TOGETHER))
    dealt = distinct.join(sent(groups.filter("kept > 0").select("lang", parts.alias("parts")).distinct()), "lang")
    dealt = dealt.select("lang", F.pmod(F.xxhash64("vec"), "parts").alias("part"), "vec", "m")
    params = groups.filter("kept > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "source", "total", "kept")
    sums = dealt.groupBy("lang", "part").cogroup(params.groupBy("lang", "part")).applyInArrow(evaluate, PAIRS).groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value"))
    mates = groups.select("lang", F.col("source").alias("one")).join(groups.select("lang", F.col("source").alias("other")), "lang").filter("one <> other")
    pairs = mates.join(both, ["lang", "one", "other"], "left").select("lang", F.col("one").alias("source"), F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_rank))

    # a term in the first ten of a source has a vector in the first ten, ordered by value and the vector's first term, which also names the vector
    valued = distinct.select("lang", F.col("first").alias("item"), "n_all", F.explode("vec").alias("e")).select("lang", "item", "n_all", "e.source", "e.n")
    valued = valued.join(sent(groups), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("n_all"), F.col("all"), F.col("kept"))
    valued = valued.withColumn("p", p).withColumn("q", q).filter("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    best = cut(valued.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top).select("lang", "source", "item", "value"))
    best = cut(distinct.select("lang", "vec", F.col("first").alias("item")).join(sent(best), ["lang", "item"]).drop("item"))
    words = kept.select("lang", "vec", F.col("term").alias("item")).join(sent(best), ["lang", "vec"])
    words = words.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)
    words = words.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(words)
