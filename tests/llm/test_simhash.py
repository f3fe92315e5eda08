import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from groundwork.llm import simhash
from tests.llm.conftest import by_id


def plain_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_whole_table_equals_brute_force(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = by_id(simhash.near_duplicates(documents))
    for (i, _), fp, root in zip(rows, fps, roots):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp:016x}", rows[root][0])


def made(spark, values, bits=64):
    rows = [(i, v.to_bytes(bits // 8, "big")) for i, v in enumerate(values)]  # id: the place in values
    half = lambda v, k: (v >> (bits // 2 if k else 0) & (1 << bits // 2) - 1).bit_count()
    return spark.createDataFrame([(i, fp, half(v, 0), half(v, 1)) for (i, fp), v in zip(rows, values)], "id bigint, fp binary, lo int, hi int")


def test_links_of_chains_and_small_tiles(spark):
    """A chain in steps of three bits is one component, over many tiles and with every kind of tile pair."""
    rng = np.random.default_rng(4)
    chain = [0]
    for _ in range(60):
        v = chain[-1]
        for b in rng.choice(64, 3, replace=False):
            v ^= 1 << int(b)
        chain.append(v)
    others = [int(x) for x in rng.integers(0, 2**63, 200)]
    values = list(dict.fromkeys(chain + others))
    want = plain_components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 3)
    for tile in (3, 40, 10_000):
        roots = simhash.components(simhash.tile_links(made(spark, values), 3, tile))
        got = {values[r["node"]]: values[r["root"]] for r in roots.collect()}
        groups = {}
        for v, w in zip(values, want):
            groups.setdefault(w, set()).add(v)
        found = {}
        for node, root in got.items():
            found.setdefault(root, set()).add(node)
        assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_wide_fingerprints_equal_brute_force():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, (90, 4), dtype=np.uint64)
    a[50:] = a[:40]
    for i in range(50, 90):
        for b in rng.choice(256, int(rng.integers(0, 80)), replace=False):
            a[i, b // 64] ^= np.uint64(1 << int(b % 64))
    want = {(i, j) for i in range(90) for j in range(90) if sum(int(x).bit_count() for x in a[i] ^ a[j]) <= 48}
    for block in (7, 1_000, 1_000_000):
        simhash.BLOCK, kept = block, simhash.BLOCK
        try:
            got = {(int(i), int(j)) for x, y in simhash._links(a, a, 48) for i, j in zip(x, y)}
        finally:
            simhash.BLOCK = kept
        assert got == want


def five_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def alike(a, b):
    """Of 0.8 or more; sizes first."""
    return min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and jaccard(a, b) >= 0.8


def test_deduplicate_equals_brute_force(documents):
    """Every pair of 0.8 or more is linked, and no pair below."""
    rows = {r["doc_id"]: five_words(r["text"]) for r in documents.collect()}
    ids = sorted(rows)
    roots = plain_components(len(ids), lambda i, j: alike(rows[ids[i]], rows[ids[j]]))
    kept = {r["doc_id"] for r in simhash.deduplicate(documents).collect()}
    assert kept == {ids[k] for k, r in enumerate(roots) if r == k} and len(kept) < len(ids)


def near_copies(spark, n, words=80, seed=3):
    """One text with a word or two changed in each copy, unrelated texts, and pairs just above and below 0.8."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base, rows = [word() for _ in range(words)], []
    for i in range(n):
        copy = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, 4))):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    for i in range(n, n + 40):
        own = [word() for _ in range(60)]
        rows += [(10 * i, " ".join(own)), (10 * i + 1, " ".join([*own[: 60 - i % 14], *(word() for _ in range(i % 14))]))]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


def test_large_groups_of_near_copies_equal_brute_force(spark):
    """Cells that are cut into tiles, long and short runs, components over several tiles of sets."""
    df, rows = near_copies(spark, 200)
    sets = [five_words(t) for _, t in rows]
    roots = plain_components(len(rows), lambda i, j: alike(sets[i], sets[j]))
    want = {rows[k][0] for k, r in enumerate(roots) if r == k}
    assert 1 < len(want) < len(rows)
    for tile, some in ((32_768, 2_048), (40, 30)):
        assert {r["doc_id"] for r in simhash.deduplicate(df, tile_rows=tile, set_rows=some).collect()} == want


def test_bands_find_pairs_at_the_threshold():
    """Sets of 0.8 share a cell, and pairs of 0.8 or more lie within the fingerprints' bounds."""
    rng = np.random.default_rng(8)
    for n in (5, 20, 90, 900):
        for _ in range(60):
            both = rng.integers(0, 2**63, n + 2 * max(1, n // 8), dtype=np.uint64)
            cut = max(1, n // 8) if n >= 8 else 0
            a, b = both[: n + cut], np.concatenate([both[:n], both[n + cut : n + 2 * cut]])
            assert (simhash.band_keys(a) == simhash.band_keys(b)).any()
            x, y = (np.frombuffer(simhash.print_of(np.unique(s), 256), np.uint64) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= simhash.CANDIDATE


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    named = {(r["doc_id"], r["component_id"]) for r in got}
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (5, 5), (6, 5)} <= named
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7]
    assert simhash.near_duplicates(empty).count() == simhash.deduplicate(empty).count() == 0


def test_rows_alike_and_same_id_different_text(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words stand here now"), (None, "x y z u v w"), (None, "x y z u v w"), (2, "a b c d e f g")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "x y z u v w"), (1, "a b c d e f g"), (1, "other words stand here now")]


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert simhash.components(df.limit(0)).count() == 0
    star = spark.range(1, 3_000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    assert {r["root"] for r in simhash.components(star).collect()} == {0}
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in simhash.components(path).collect()} == {0}


def test_components_take_few_tasks(spark):
    """A hub, a path and loose links at 64 shuffle partitions: the driver keeps what it knows of every task."""
    sc, r = spark.sparkContext, random.Random(3)
    ids = r.sample(range(10_000), 900)
    links = [(ids[0], x) for x in ids[1:400]] + list(zip(ids[400:430], ids[401:431])) + [(r.choice(ids[431:]), r.choice(ids[431:])) for _ in range(300)]
    links += [(ids[450], ids[5]), (ids[400], ids[700])]
    want = {x: x for x in ids}
    for _ in ids:
        before = dict(want)
        for u, v in links:
            want[u] = want[v] = min(want[u], want[v])
        if want == before:
            break
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("64", "false", "-1")):  # as of links too many for a broadcast
            spark.conf.set(k, v)
        sc.setJobGroup("few-tasks", "components")
        got = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {x: want[x] for pair in links for x in pair if pair[0] != pair[1]}
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert 0 < tasks < 3_000, tasks
