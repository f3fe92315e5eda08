import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundwork.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def by_brute_force(rows, least_docs=10, top=10):
    """(doc text, lang, source) to the result's rows, term by term."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        every = {t: sum(c[t] for c in own.values()) for t in kept}
        law = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: law(c) for s, c in own.items()}, law(every)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            words = [(t, far(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def made_up(seed, n=400):
    r = random.Random(seed)
    words = [*(f"w{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(50)), "Ünder", "ΣΊΣΥΦΟΣ", "\U0001f600x", "İx", "a1b", "Zz_y"]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None]), r.choice(["hot"] * 4 + ["a", "b", "c", "é", None])
        text = None if r.random() < 0.05 else " ".join(r.choices(words, k=r.randrange(12)))
        rows.append((text, lang, source))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed, monkeypatch):
    rows = made_up(seed)
    monkeypatch.setattr(divergence, "TOGETHER", 7)
    assert rows_of(divergence.audit(docs_of(spark, rows))) == by_brute_force(rows)
    assert any(r[2] == "term" for r in by_brute_force(rows))


def test_many_terms_of_one_vector(spark):
    """Hundreds of words with the same counts: ties go by the words' bytes, and each counts in the sums."""
    words = " ".join(f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    rows = [(words, "en", "a")] * 12 + [("other words", "en", "b")] * 11
    got = rows_of(divergence.audit(docs_of(spark, rows)))
    assert got == by_brute_force(rows)
    assert [r[3] for r in got if r[1:3] == ("a", "term")] == [f"xa{c}" for c in "abcdefghij"]


def test_shares_in_two_steps_and_in_decimals(spark):
    counts = np.array([[0, 5, 2**45], [7, 2**47, 1]])
    totals = np.array([1_000, 2**47 + 10, 2**46])
    got = divergence.shares(counts, totals, 12)
    want = [[1 + 10**9 * (int(c) + 2) // (int(t) + 24) for c, t in zip(row, totals)] for row in counts]
    assert got.tolist() == want
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(int(c), int(t)) for row in counts for c, t in zip(row, totals)], "c bigint, t bigint")
    assert [r[0] for r in made.select(divergence.share(F.col("c"), F.col("t"), F.lit(12).cast("long"))).collect()] == [x for row in want for x in row]


def test_counts_are_passed_on_before_they_grow(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a"] * 4), pa.array(["a b c d", "a b", "A e f g", ""])], names=["lang", "source", "text"])
    total = Counter()
    parts = list(divergence.count_terms(iter([batch])))
    for part in parts:
        total.update(dict(zip(part.column("term").to_pylist(), part.column("n").to_pylist())))
    assert len(parts) > 1 and total == Counter("a b c d a b a e f g".split())


def test_odd_rows_and_empty_tables(odd, empty):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert rows_of(divergence.audit(odd)) == by_brute_force(rows)
    got = divergence.audit(odd.union(odd).union(odd).union(odd).union(odd).union(odd).union(odd).union(odd).union(odd).union(odd))
    assert rows_of(got) == by_brute_force(rows * 10) and got.filter("part = 'term'").count()
    assert divergence.audit(empty).count() == 0


def test_ranks_are_cut_before_the_shuffle(spark, monkeypatch):
    """Groups too large for Spark's own broadcast: vectors are not shuffled by source, each task passes its first ten on."""
    rows, plans, plain = made_up(3), [], divergence.cut

    def spied(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(divergence, "cut", spied)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows_of(divergence.audit(docs_of(spark, rows))) == by_brute_force(rows)
        ranked = [p for p in plans if "WindowGroupLimit" in p]
        assert ranked and not any("SortMergeJoin" in p for p in ranked)
        assert all(p.index("Final") < p.index("Exchange hashpartitioning(lang") < p.index("Partial") for p in ranked)
        monkeypatch.setattr(divergence, "SENT", 0)  # and without any broadcast
        assert rows_of(divergence.audit(docs_of(spark, rows))) == by_brute_force(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
