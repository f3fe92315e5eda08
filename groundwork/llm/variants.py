"""Spelling variants: words one inserted, deleted or replaced letter apart, each led to its most frequent neighbour.

Two words that differ by one letter share at least half of the shorter one, at its start or at
its end. So every word is dealt to blocks of words that share such a half: once for each of the
two lengths that the shorter word of a pair may have, and once for each end. In a task, the
words of its blocks make a minimal acyclic automaton, read forward where blocks share a start
and backward where they share an end. A word's number is its place in the sorted list: each arc
holds how many words lie before those it leads to. Every word matches its half exactly and
completes the rest with one error; all of them take each step together, in arrays.

A pair is found once: among insertions that give the same word only the last place of a run
counts, and pairs that share their first half are left to the forward blocks. A block of over
``BLOCK`` words is dealt anew by a half of what its words do not share, and again, until what is
left is one letter; a block then has at most one word for each two letters of the alphabet. So
no block grows with the table, and none is cut.

Of each task only one row a word returns: the number of its near words and the most frequent one.

Null texts have no words; a null doc_id is read as ''. Repeated rows count each. Ties in
frequency go to the smaller word in code-point order. Other columns are ignored, whatever their
names. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import cut

#: Words have so many letters and occurrences at least; a form is so many times as frequent.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One of so many (document, word) pairs is changed.
CHANGED = 199
#: Words that a task holds; rows of a task's blocks; words of a block; queries that step together.
HELD, BUCKET, BLOCK, TOGETHER = 400_000, 40_000, 20_000, 20_000

#: Latin-1 bytes that belong to words, A-Z in lower case, and spaces for all others.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Runs of letters A to Z and U+00C0 to U+00FF in Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def words_of(doc_id: object, text: str, least: int, total: Counter) -> None:
    """Add the words of a document to ``total``; one run in ``CHANGED``, chosen by a checksum, loses a letter."""
    found = [r for r in runs(text) if len(r) >= least]
    total.update(found)
    head, own = crc32(f"{'' if doc_id is None else doc_id}:".encode()), None
    for r in set(found):
        h = crc32(r if r.isascii() else r.decode("latin-1").encode(), head)
        if h % CHANGED == 0:
            own = own or Counter(found)
            at = h % len(r)
            total[r] -= own[r]
            if len(r) > least:
                total[r[:at] + r[at + 1 :]] += own[r]


def count_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task by word, passed on whenever ``HELD`` words are held."""
    total: Counter = Counter()

    def passed() -> pa.RecordBatch:
        made = [(w.decode("latin-1"), n) for w, n in total.items() if n]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words_of(doc_id, text, least, total)
            if len(total) > HELD:
                yield passed()
    yield passed()


class Automaton:
    """Minimal acyclic automaton of sorted distinct strings; the arcs lie in the order of (state, symbol)."""

    WIDTH = 1 << 24  # symbols are below

    def __init__(self, words: list[str]):
        register: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # final, arcs, of the states that the last word runs through
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                state = register.setdefault((final, tuple(arcs)), len(register))
                path[-1][1].append((ord(last[len(path) - 1]), state))

        for word in words:
            shared = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            close(shared)
            path.extend([False, []] for _ in word[shared:])
            path[-1][0] = True
            last = word
        close(0)
        self.root = register.setdefault((path[0][0], tuple(path[0][1])), len(register))
        counts: list[int] = []  # words from each state; what a state leads to was closed before it
        key, target, skip, arcs_of, self.final = [], [], [], [], np.zeros(len(register), bool)
        for state, (final, arcs) in enumerate(register):
            n = int(final)
            for symbol, to in arcs:
                key.append(state * self.WIDTH + symbol)
                target.append(to)
                skip.append(n)
                n += counts[to]
            counts.append(n)
            arcs_of.append(len(arcs))
            self.final[state] = final
        self.key, self.target, self.skip = np.array(key, np.int64), np.array(target, np.int64), np.array(skip, np.int64)
        self.n_arcs = np.array(arcs_of, np.int64)
        self.first_arc = np.concatenate([[0], np.cumsum(self.n_arcs)[:-1]])

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of the states by the symbols, and which of them there are."""
        want = state * self.WIDTH + symbol
        arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return arc, self.key[arc] == want


def one_error(automaton: Automaton, code: np.ndarray, offset: np.ndarray, length: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word number) of all words that are a query with one symbol replaced or inserted after the first ``exact`` symbols.

    ``code`` holds the queries' symbols one after another from ``offset`` on; every query is a word.
    """
    q = np.arange(len(offset))
    state, number, at = np.full(len(q), automaton.root), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    wrong = [np.zeros(0, np.int64)] * 4  # query, state, number, place: with one error so far
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(q) or len(wrong[0]):
        wq, ws, wn, wp = wrong
        done = wp == length[wq]
        hit = done & automaton.final[ws]
        found.append((wq[hit], wn[hit]))
        wq, ws, wn, wp = (x[~done] for x in (wq, ws, wn, wp))
        arc, there = automaton.step(ws, code[offset[wq] + wp])
        parts = [(wq[there], automaton.target[arc[there]], wn[there] + automaton.skip[arc[there]], wp[there] + 1)]
        if len(q):
            inner = at < length[q]
            own = np.where(inner, code[np.minimum(offset[q] + at, len(code) - 1)], -1)
            free = at >= exact[q]
            n = np.where(free, automaton.n_arcs[state], 0)
            who = np.repeat(np.arange(len(q)), n)
            arc = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + automaton.first_arc[state[who]]
            other = automaton.key[arc] % automaton.WIDTH != own[who]
            who, arc = who[other], arc[other]
            to, num = automaton.target[arc], number[who] + automaton.skip[arc]
            parts.append((q[who], to, num, at[who]))  # inserted; the same symbol as the next is inserted behind it
            put = inner[who]
            parts.append((q[who][put], to[put], num[put], at[who][put] + 1))  # replaced
            q, state, number, at, own = (x[inner] for x in (q, state, number, at, own))
            arc, _ = automaton.step(state, own)
            state, number, at = automaton.target[arc], number + automaton.skip[arc], at + 1
        wrong = [np.concatenate(x) for x in zip(*parts)]
    return tuple(np.concatenate(x) for x in zip(*found))


NEAR = "word string, n bigint, n_near bigint, form string, form_n bigint"
#: Symbols from here on stand for blocks, in front of a word.
FIRST_BLOCK = 256


def pairs_of(words: list[str], blocks: np.ndarray, shorter: np.ndarray, shared: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (word, other) of near words of the same block, where word has the shorter length: one way for insertions, both for replacements."""
    heads = [chr(FIRST_BLOCK + b + (2048 if FIRST_BLOCK + b >= 0xD800 else 0)) for b in blocks.tolist()]  # no surrogates
    strings = [h + (w[::-1] if backward else w) for h, w in zip(heads, words)]
    order = sorted(range(len(strings)), key=strings.__getitem__)
    automaton = Automaton([strings[i] for i in order])
    order = np.array(order)
    asking = np.nonzero(np.array([len(w) for w in words]) == shorter)[0]
    out = []
    for k in range(0, len(asking), TOGETHER):
        ids = asking[k : k + TOGETHER]
        texts = [strings[i] for i in ids.tolist()]
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        length = np.array([len(t) for t in texts])
        q, number = one_error(automaton, code, np.cumsum(length) - length, length, shared[ids] + 1)
        out.append((ids[q], order[number]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def near_in_blocks(rows: pa.Table) -> pa.Table:
    """Near words inside the blocks of a task: one row for each word that has some, and one for each word's own first block."""
    words = rows.column("word").to_pylist()
    n, a, i, j, x = (rows.column(c).to_numpy() for c in ("n", "a", "i", "j", "x"))
    seen: dict[tuple, int] = {}
    blocks = np.array([seen.setdefault(b, len(seen)) for b in zip(a.tolist(), i.tolist(), j.tolist(), x.tolist(), rows.column("key").to_pylist())])
    one, other = [], []
    for backward in (False, True):
        ids = np.nonzero((j > i) == backward)[0]
        if not len(ids):
            continue
        u, v = pairs_of([words[k] for k in ids.tolist()], blocks[ids], a[ids], (j if backward else i)[ids], backward)
        u, v = ids[u], ids[v]
        held = np.array([words[p][:m] != words[q][:m] for p, q, m in zip(u.tolist(), v.tolist(), x[u].tolist())], bool)
        longer = held & (np.array([len(words[q]) for q in v.tolist()], np.int64) > a[u])
        one += [u[held], v[longer]]
        other += [v[held], u[longer]]
    one, other = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (one, other))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    best = np.lexsort((rank[other], -n[other], one))
    one, other = one[best], other[best]
    first = np.concatenate([[True], one[1:] != one[:-1]]) if len(one) else np.zeros(0, bool)
    near, form = np.bincount(one, minlength=len(words)), np.full(len(words), -1)
    form[one[first]] = other[first]
    lengths = np.array([len(w) for w in words])
    keep = np.nonzero((near > 0) | (lengths == a) & (j == 0) & (x > a))[0].tolist()
    made = [(words[k], int(n[k]), int(near[k]), *((words[form[k]], int(n[form[k]])) if form[k] >= 0 else (None, None))) for k in keep]
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
    return pa.table([list(c) for c in zip(*made)] or [[]] * 5, schema=schema)


def dealt(words: DataFrame, least: int) -> DataFrame:
    """Rows of the first blocks: a, length of the shorter word of a pair; i and j, letters shared at the start and the end; x, where pairs share so many first letters, another block has them."""
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda a: a >= least)
    rows = words.select("word", "n", F.explode(lengths).alias("a"))
    half = F.floor(F.col("a") / 2).cast("int")
    ends = F.array(F.struct(half.alias("i"), F.lit(0).alias("j"), (F.col("a") + 2).alias("x")), F.struct(F.lit(0).alias("i"), half.alias("j"), half.alias("x")))
    return keyed(rows.select("word", "n", "a", F.explode(ends).alias("e")).select("word", "n", "a", "e.i", "e.j", "e.x"))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.concat(F.expr("substring(word, 1, i)"), F.lit("-"), F.expr("right(word, j)")))


BY = ["a", "i", "j", "x", "key"]


def dealt_anew(rows: DataFrame) -> DataFrame:
    """Rows of too large blocks in blocks by a half of what the words do not share, at its start or its end."""
    half = F.floor((F.col("a") - F.col("i") - F.col("j")) / 2).cast("int")
    start = F.struct((F.col("i") + half).alias("i"), F.col("j").alias("j"), F.col("x").alias("x"))
    end = F.struct(F.col("i").alias("i"), (F.col("j") + half).alias("j"), (F.col("i") + half).alias("x"))
    rows = rows.select("word", "n", "a", F.explode(F.array(start, end)).alias("e")).select("word", "n", "a", "e.i", "e.j", "e.x")
    return keyed(rows.filter("i < x"))


def near_words(words: DataFrame, least: int = LEAST_LENGTH, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """word, n, n_near, form, form_n of distinct words (word, n): number of near words and the most frequent one."""
    rows, parts = dealt(words, least), []
    buckets = max(1, -(-4 * words.count() // bucket))
    while True:
        large = cut(rows.groupBy(*BY).agg(F.count(F.lit(1)).alias("size")).filter((F.col("size") > block) & (F.col("a") - F.col("i") - F.col("j") >= 2)).select(*BY))
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(large, BY, "left_anti"))
        rows = cut(dealt_anew(rows.join(large, BY, "left_semi")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.withColumn("bucket", F.pmod(F.xxhash64(*BY), F.lit(buckets)))
    found = every.groupBy("bucket").applyInArrow(near_in_blocks, NEAR)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))


def roots(near: DataFrame) -> DataFrame:
    """``near`` with the end of each word's chain of forms; a form is more frequent than its word, so chains end, and each round doubles what is followed."""
    ends = cut(near.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = cut(ends.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ends.filter("moved").isEmpty():
            break
        ends = ends.drop("moved")
    return near.join(ends.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(lambda batches: count_words(batches, least), "word string, n bigint")
    words = cut(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))
    near, far = near_words(words, least), F.col("form_n") >= times * F.col("n")
    near = cut(near.select("word", "n", "n_near", F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")))
    return roots(near).select("word", "form", "root", "n", "n_near", "form_n")
