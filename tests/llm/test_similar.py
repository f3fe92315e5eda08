"""Near copies of the pipeline's stage: every pair of 0.8 or more in Jaccard similarity is linked, and none below."""

import random

import pytest

import corpus_pipeline
from groundwork.llm import simhash


def shingles(text, width=5):
    words = text.lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def kept_by_brute_force(rows):
    ids, sets = sorted(rows), {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if root[i] == i}


def families(seed=8):
    """Texts with copies whose last words were replaced: similarities from 0.5 to 0.95, many close to 0.8 on both sides."""
    r, rows = random.Random(seed), {}
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    for _ in range(40):
        words = [word() for _ in range(r.choice([8, 9, 40, 104, 304]))]
        n = len(words) - 4
        rows[len(rows)] = " ".join(words)
        for share in (0.5, 0.65, 0.7, 0.75, 0.79, 0.8, 0.81, 0.9, 0.95):
            same = round(2 * share / (1 + share) * n)  # of n shingles
            rows[len(rows)] = " ".join([*words[: same + 4], *(word() for _ in range(n - same))])
    return rows


@pytest.mark.parametrize("set_rows", [3, 2_048])
def test_links_are_exact(spark, set_rows):
    rows = families()
    docs = spark.createDataFrame(sorted(rows.items()), "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash.deduplicate(docs, similar=0.8, set_rows=set_rows, tile_rows=150).collect()}
    want = kept_by_brute_force(rows)
    assert kept == want and 40 < len(want) < len(rows)


def test_stage_of_the_pipeline_is_exact(spark, documents):
    docs = documents.filter("text is not null and size(split(text, ' ')) >= 5").dropDuplicates(["doc_id"])
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, None).collect()} == kept_by_brute_force(rows)


def test_odd_rows_and_empty_tables(odd, empty):
    kept = simhash.deduplicate(odd, similar=0.8)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7]
    assert simhash.deduplicate(empty, similar=0.8).count() == 0
