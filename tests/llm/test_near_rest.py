"""Links that cells and fingerprints miss are found by the leading shingles."""

import random

import numpy as np
import pytest

from groundwork.llm import simhash
from tests.llm.test_similar import families, kept_by_brute_force


@pytest.mark.parametrize("first", [76_060, 977_424])
def test_pair_without_a_common_cell(spark, first):
    """Texts of 0.8 that share none of the 28 cells; found by trying three million such pairs."""
    words = [f"w{k}" for k in range(first, first + 9)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:8])), (3, " ".join(words[::-1]))]
    a, b = (simhash.shingle_set(t, 5) for _, t in rows[:2])
    assert not (simhash.band_keys(a) == simhash.band_keys(b)).any()
    assert {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {1, 3}


@pytest.mark.parametrize("settings", [{}, {"SLICE": 2, "FEW": 0, "SEEN": 2}, {"MOST_LATE": 5}])
def test_leading_shingles_alone_find_every_link(spark, monkeypatch, settings):
    """Without any cell the rows are those of brute force, also among texts with a common passage."""
    monkeypatch.setattr(simhash, "cell_links", lambda kinds, *_: kinds.select(kinds.id.alias("u"), kinds.id.alias("v")).limit(0))
    for name, value in settings.items():
        monkeypatch.setattr(simhash, name, value)
    r, rows = random.Random(5), families()
    for k in range(60):
        rows[len(rows)] = "one passage that very many of the texts have in common and " * (k % 2 + 1) + " ".join(f"x{r.randrange(10**6)}" for _ in range(k % 9))
    docs = spark.createDataFrame(sorted(rows.items()), "doc_id bigint, text string")
    want = kept_by_brute_force(rows)
    assert {x["doc_id"] for x in simhash.deduplicate(docs, set_rows=50).collect()} == want and 40 < len(want) < len(rows)


def test_leading_shingles_of_similar_sets_meet():
    """At the threshold of each size, with and without shingles that come last."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 4, 5, 9, 10, 35, 90, 900):
        for _ in range(40):
            pool = rng.integers(0, 2**63, 2 * n + 2, dtype=np.uint64)
            late = rng.permutation(pool)[: int(rng.integers(0, len(pool)))]
            for m in (n, round(1.25 * n)):
                same = next((c for c in range(n, 0, -1) if c < 0.8 * (n + m - c)), 0) + 1  # the fewest that make 0.8
                a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:same], pool[n : n + m - same]]))
                if same <= n and same >= 0.8 * (n + m - same):
                    x, y = simhash.leading(a, 0.8, late), simhash.leading(b, 0.8, late)
                    shared = len(np.intersect1d(x, y))
                    assert shared and shared + max(len(a) - len(x), len(b) - len(y)) >= same
        for _ in range(20):
            a, b = np.unique(pool[:n]), np.unique(pool[int(rng.integers(0, n)) :])
            assert np.bitwise_count((simhash.parities(a) ^ simhash.parities(b)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
