import random
import re
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm import variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_brute_force(rows, least=6, least_count=5, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return forms({w: n for w, n in counts.items() if n >= least_count}, times)


def forms(words, times=5):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= times * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def edited(r, word, alphabet):
    at, kind = r.randrange(len(word) + 1), r.randrange(3)
    put = r.choice(alphabet)
    return word[:at] + put + word[at:] if kind == 0 else word[:at] + (put if kind == 1 else "") + word[at + 1 :]


def family(seed, n=250, alphabet="abéz÷"):
    """Words in chains of edits, many of them near each other, with runs of equal letters."""
    r = random.Random(seed)
    words = {"".join(r.choices(alphabet, k=r.randrange(6, 14))) for _ in range(30)}
    while len(words) < n:
        word = edited(r, r.choice(sorted(words)), alphabet)
        if len(word) >= 6:
            words.add(word)
    return {w: r.choice([5, 6, 30, 30, 200, 1000]) for w in words}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [variants.BLOCK, 3])
def test_near_words_are_exact(spark, seed, block):
    """Against all pairs, also where every block has to be dealt anew down to one letter."""
    words = family(seed) | ({"common" * 3 + a + b: 7 for a in "abcdef" for b in "abcdef"} if seed == 2 else {})
    table = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    got = {r["word"]: (r["n"], r["n_near"], r["form"]) for r in variants.near_words(table, block=block, bucket=300).collect()}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    assert got == {w: (words[w], len(v), min(v, key=lambda o: (-words[o], o)) if v else None) for w, v in near.items()}
    assert sum(map(bool, near.values())) > 100


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=40), st.booleans())
def test_words_of_one_block(words, backward):
    import numpy as np

    words = sorted(words)
    found = set()
    for shorter in range(1, 8):
        ids = [i for i, w in enumerate(words) if len(w) in (shorter, shorter + 1)]
        own = [words[i] for i in ids]
        zeros = np.zeros(len(own), np.int64)
        u, v = variants.pairs_of(own, zeros, zeros + shorter, zeros, backward) if own else ([], [])
        pairs = [(own[a], own[b]) for a, b in zip(u, v)]
        assert len(pairs) == len(set(pairs))  # each once
        found |= {frozenset(p) for p in pairs}
    assert found == {frozenset((a, b)) for a in words for b in words if is_near(a, b)}


def test_word_numbers_and_minimal_states():
    words = sorted({"xtap", "xtaps", "xtop", "xtops", "ytap", "ytaps", "ytop", "ytops"})
    automaton = variants.Automaton(words)
    assert len(automaton.final) == 6  # of 21 states of a tree
    for number, word in enumerate(words):
        state, total = automaton.root, 0
        for c in word:
            arc = int(automaton.step(state, ord(c))[0])
            state, total = automaton.target[arc], total + automaton.skip[arc]
        assert automaton.final[state] and total == number


def test_documents_against_brute_force(spark):
    r = random.Random(5)
    words = [*family(3, 120), "Straße", "ÀÉÎÕü", "x×y÷z×q", "short"]
    weights = [r.choice([1, 1, 5, 40]) for _ in words]
    marks = [" ", "\n", "-", "1", "Œ", "¿", "\U0001f600", "ΣΣ"]
    rows = [(None if i == 7 else i, None if i == 9 else "".join(w.upper() * (r.random() < 0.2) or w for w in sum(zip(r.choices(words, weights, k=120), r.choices(marks, k=120)), ()))) for i in range(150)]
    rows += [(150 + i, "planter " * 10 + "Planters " * (i % 3 == 0) * 2 + "plantersy " * (i % 40 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = by_brute_force(rows)
    assert rows_of(variants.spelling_variants(docs)) == want
    assert any(w[1] and w[2] != w[1] for w in want)  # a chain of forms


def test_query_on_a_whole_table(spark, data):
    from groundwork.llm import queries

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(d["doc_id"], d["text"]) for d in docs.select("doc_id", "text").collect()]
    assert rows_of(queries.queries()["op13_variants"](spark, data)) == by_brute_force(rows)


def test_counts_are_passed_on_before_they_grow(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(variants, "HELD", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(["1", "2", None]), pa.array(["abcdef bcdefg", "abcdef cdefgh xyzxyz", "abcdef"])], names=["doc_id", "text"])
    parts, total = list(variants.count_words(iter([batch]), 6)), Counter()
    for part in parts:
        for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            total[w] += n
    assert len(parts) > 1 and total == {"abcdef": 3, "bcdefg": 1, "cdefgh": 1, "xyzxyz": 1}


def test_odd_rows_and_empty_tables(odd, empty, spark):
    many = odd.union(odd).union(odd).union(odd).union(odd).union(odd)
    rows = [(r["doc_id"], r["text"]) for r in many.collect()]
    assert rows_of(variants.spelling_variants(many)) == by_brute_force(rows)
    long = "q" * 30_000
    docs = spark.createDataFrame([(i, f"{long} {long}x {long}") for i in range(6)], "doc_id bigint, text string")
    assert [(r["word"] == long, r["n"], r["n_near"]) for r in variants.spelling_variants(docs).collect()] in ([(True, 12, 1), (False, 6, 1)], [(False, 6, 1), (True, 12, 1)])
    assert variants.spelling_variants(empty).count() == 0
