"""Quality rules, language, chat, packing and sharding."""

import hashlib
import itertools
import math
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from groundwork.llm import bpe_count, chat, language, packing, quality, queries, sharding
from tests.llm.conftest import by_id


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


def test_queries_equal_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, data), con.sql(sql)
        assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall()), name


def plain_repeats(words, n=8):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + n)})


def test_repeated_words_by_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in (0, 5, 8, 9, 20, 60)] + ["a " * 30, "x y z " * 20 + "tail", "1 2 3 4 5 6 7 8 q 1 2 3 4 5 6 7 8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = by_id(quality.judge(docs))
    for i, t in enumerate(texts):
        assert got[i]["n_repeat_words"] == plain_repeats(t.split())


def test_quality_of_labelled_documents(spark, data, documents):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.judge(documents).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in rows}
    assert share[1] > 0.95 and share.get(0, 0) < share[1]


def test_divergence_rejects_junk_and_keeps_short_texts(spark):
    prose = "the people of the town went to the market on a day that was long and it was good for all in the end " * 6
    junk = " ".join("#$%" * 5 + str(i) for i in range(80))
    shuffled = " ".join("xkcd" + chr(97 + i % 26) * 9 for i in range(80))
    docs = spark.createDataFrame([(1, junk), (2, shuffled), (3, "a few words of text that are too short to be judged by their shares at all in this rule of mine")], "doc_id bigint, text string")
    assert {i: r["kept"] for i, r in by_id(quality.judge(docs)).items()} == {1: False, 2: False, 3: True}
    m = by_id(quality.measures(docs.withColumn("text", F.lit(prose))))[1]
    assert 0 <= m["class_distance"] <= quality.CLASS_LIMIT


def test_quality_odd_rows(odd, empty):
    got = quality.judge(odd).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"]: (r["n_words"], r["kept"]) for r in got if r["doc_id"] in (1, 2, 3, 5)} == {1: (0, False), 2: (0, False), 3: (0, False), 5: (1, False)}
    assert next(r for r in got if r["doc_id"] == 4)["base_failed"]
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    assert quality.keep(empty).count() == quality.judge(empty).count() == 0


def test_held_out_accuracy(documents):
    out = language.held_out(F.col("doc_id"))
    assert {r["doc_id"] for r in documents.filter(out).collect()} == {r["doc_id"] for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    model = language.fit(documents.filter(~out))
    rows = language.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").filter(out).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and 0 < model.temperature
    assert (model.weights == 0).mean() > 0.2  # the penalty leaves weights out


def test_language_odd_rows(documents, odd, empty):
    model = language.fit(documents)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect() if r["doc_id"]}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en"
    kept = language.keep(odd, model)
    assert kept.columns == odd.columns and 4 in {r["doc_id"] for r in kept.collect()} and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}
    none = language.fit(empty)
    assert language.identify(odd, none).filter("lang_pred <> 'und' or score <> 0").count() == 0
    assert language.identify(empty, model).count() == language.keep(empty, model).count() == 0


def test_temperature_and_training():
    rng = np.random.default_rng(0)
    logits, labels = rng.normal(size=(400, 3)) * 2, None
    p = language.softmax(logits)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(language.fit_temperature(logits * 5, labels) - 5) < 1.5
    rows, y = [], []
    for i in range(200):
        at = np.array([i % 2, 2 + i % 7])
        rows.append((at, np.array([1.0, 0.1]) / math.hypot(1, 0.1)))
        y.append(i % 2)
    w, b = language.train_ftrl(rows, y, 2)
    assert all(np.argmax(x @ w[a] + b) == k for (a, x), k in zip(rows, y))


def test_fold_of_streamed_edits(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", ""),
        (1, 2, 1, "delta", None, "he"),
        (1, 3, 1, "delta", None, "llo"),
        (1, 4, 2, "message", "user", "gone"),
        (1, 5, 1, "regenerate", "assistant", "new"),
        (1, 6, 1, "delta", None, "er"),
        (1, 7, 0, "edit", "user", "hey"),
        (1, 8, 3, "message", "user", None),
        (None, 0, 0, "delta", "assistant", "x"),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string")
    got = sorted(((r["conv_id"] or 0), r["turn"], r["role"], r["text"]) for r in chat.fold(events).collect())
    assert got == [(0, 0, "assistant", "x"), (1, 0, "user", "hey"), (1, 1, "assistant", "newer"), (1, 3, "user", "")]


def test_rendering_is_reversible(spark):
    texts = ["\\### Assistant: </turn> ok", "<turn>a<loss>b</turn>\n", "\\0\\1<", "", "\n\n", "é\U0001f600", "</turn>"]
    rows = [(c, t, role, text) for c, (role, text) in enumerate(itertools.product(["user", "assistant", "<r>", None], texts)) for t in (0, 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = chat.render(turns).select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()
    got = {r["conv_id"]: [(x["role"], x["loss"], x["text"]) for x in r["t"]] for r in back}
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", role == "assistant", text))
    assert got == want


def test_chat_digests_by_hand(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, 2, "assistant", "<c"), (None, None, None, None)]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(chat.message_events(conv))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb\nassistant\nb\nassistant\n<c\n") and got[1]["n_turns"] == 4
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (4, sha("bb<c"))
    assert got[None]["turns_sha256"] == sha("\n\n") and got[None]["loss_chars"] == 0
    assert chat.digests(chat.format_chat(chat.message_events(conv.limit(0)))).count() == 0


def plain_bounds(top, n, buckets):
    """Least padding by the plain recurrence over all splits."""
    best = {0: (0, [])}
    for _ in range(min(buckets, len(top))):
        now = {}
        for j in range(1, len(top) + 1):
            options = [(best[i][0] + sum((top[j - 1] - top[m]) * n[m] for m in range(i, j)), best[i][1] + [top[j - 1]]) for i in range(j) if i in best]
            if options:
                now[j] = min(options, key=lambda o: o[0])
        best = now
    return best[len(top)]


def waste(bounds, lengths):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_bounds_have_the_least_padding():
    rng = np.random.default_rng(3)
    for size, buckets in ((7, 3), (1, 4), (4, 4), (3, 9), (40, 5), (60, 16)):
        for _ in range(5):
            top = np.sort(rng.choice(9_000, size, replace=False))
            n = rng.integers(1, 50, size)
            got = packing.optimal_bounds(top, n, buckets)
            assert waste(got, np.repeat(top, n)) == plain_bounds(top.tolist(), n.tolist(), buckets)[0] and got == sorted(set(got))
    assert packing.optimal_bounds(np.zeros(0), np.zeros(0), 4) == []


def test_bounds_of_raw_token_counts(documents):
    """The bounds of a whole table are optimal for its exact token counts, and these are the tokeniser's."""
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe_count.token_counts(documents).collect()}
    rows = packing.pack(documents, buckets=4).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == counts
    top, n = np.unique(list(counts.values()), return_counts=True)
    assert sum(r["padding"] for r in rows) == plain_bounds(top.tolist(), n.tolist(), 4)[0]


def test_batches(documents, odd, empty):
    rows = packing.pack(documents, buckets=5, token_budget=2_000).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents.collect())
    batches = {}
    for r in rows:
        assert r["n_tokens"] + r["padding"] == r["bound"] and r["padding"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for b in batches.values():
        assert sorted(r["slot"] for r in b) == list(range(len(b))) and (len(b) == 1 or len(b) * b[0]["bound"] <= 2_000)
    small = packing.pack(documents, buckets=5, token_budget=2_000, slice_rows=7).collect()  # sliced ranks are the same
    assert {tuple(r) for r in small} == {tuple(r) for r in rows}
    assert packing.pack(odd).count() == odd.count() and packing.pack(empty).count() == 0


def test_shards(documents, odd, empty):
    rows = sharding.interleave(documents, shards=7).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    shards = {}
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(7)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    per = {s: sum(r["source"] == s for r in rows) / 7 for s in {r["source"] for r in rows}}
    for rs in shards.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert all(abs(sum(r["source"] == s for r in rs) - n) <= 2 for s, n in per.items())
    small = sharding.interleave(documents, shards=7, slice_rows=9).collect()
    assert {tuple(r) for r in small} == {tuple(r) for r in rows}
    got = sharding.interleave(odd, shards=3).collect()
    assert len(got) == odd.count() and sorted(r["size"] for r in got)[:2] == [16, 16]
    assert sharding.interleave(empty).count() == 0


def plain_interleave(rows, shards, seed=29):
    """(doc_id, source, size, crc, shard, slot) of (doc_id, source, text) rows by two plain sorts."""
    made = []
    for i, source, text in rows:
        raw = (text or "").encode()
        size, crc = len(raw) + 16, zlib.crc32(raw)
        made.append((source, hashlib.md5(f"{seed}:{'~' if i is None else i}:{size}:{crc}".encode()).hexdigest(), i, size, crc))
    made.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1], -1 if r[2] is None else r[2], *r[3:]))
    placed = []
    for _, group in itertools.groupby(made, key=lambda r: r[0]):
        group = list(group)
        placed += [((2 * k + 1) / (2 * len(group)), r[0] is not None, r[0] or "", r) for k, r in enumerate(group)]
    placed.sort(key=lambda p: p[:3])
    out, n = [], len(placed)
    for pos, (*_, (source, _, i, size, crc)) in enumerate(placed):
        shard = pos * shards // n
        out.append((i, source, size, crc, shard, pos - -(-shard * n // shards)))
    return sorted(out, key=repr)


def test_interleaving_equals_plain_sorts(spark, documents, odd):
    names = ["doc_id", "source", "size", "text_crc32", "shard", "slot"]
    hot = spark.createDataFrame([(7, "a", "x")] * 9_000 + [(None, None, None)] * 5_000 + [(i, "b", "y" * (i % 5)) for i in range(2_000)], "doc_id bigint, source string, text string")
    for df, shards in ((documents, 7), (odd, 3), (hot, 40)):
        want = plain_interleave([(r["doc_id"], r["source"], r["text"]) for r in df.collect()], shards)
        for some in (20_000, 50):
            got = sharding.interleave(df, shards=shards, slice_rows=some).select(*names).collect()
            assert sorted(map(tuple, got), key=repr) == want


def test_many_rows_alike_are_packed(spark):
    hot = spark.createDataFrame([(7, "a b")] * 9_500 + [(None, None)] * 4_000 + [(i, "y " * (i % 5)) for i in range(500)], "doc_id bigint, text string")
    rows = packing.pack(hot, buckets=3, token_budget=64, slice_rows=100).collect()
    assert len(rows) == 14_000
    slots = {}
    for r in rows:
        slots.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_ftrl(rows, labels, k, alpha=2.0, beta=1.0, l1=0.02, l2=0.05, epochs=3, seed=5):
    """Coordinate by coordinate, as the method is written down."""
    z, n = {}, {}

    def weight(at):
        v = z.get(at, 0.0)
        return 0.0 if abs(v) <= l1 else ((l1 if v > 0 else -l1) - v) / ((beta + math.sqrt(n.get(at, 0.0))) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist()), (language.BUCKETS, 1.0)]
            w = {(i, c): weight((i, c)) for i, _ in x for c in range(k)}
            logit = [sum(v * w[i, c] for i, v in x) for c in range(k)]
            e = [math.exp(v - max(logit)) for v in logit]
            for i, v in x:
                for c in range(k):
                    g = (e[c] / sum(e) - (c == labels[r])) * v
                    old = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, c]
                    n[i, c] = old + g * g
    return {at: weight(at) for at in z}


def test_training_equals_plain_ftrl():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6)) for _ in range(40)]
    labels = [int(rows[i][0][0] % 3) for i in range(40)]
    w, b = language.train_ftrl(rows, labels, 3)
    want = plain_ftrl(rows, labels, 3)
    got = {(i, c): (b[c] if i == language.BUCKETS else w[i, c]) for i, c in want}
    assert all(abs(got[at] - v) < 1e-9 for at, v in want.items()) and any(v == 0 for v in want.values())


def test_calibration_of_held_out_documents(documents):
    """The temperature never was fitted on these rows, and it does not worsen their log loss."""
    out = language.held_out(F.col("doc_id"))
    model = language.fit(documents.filter(~out))
    rows = [r for r in documents.filter(out).collect() if language.gram_counts(r["text"]) is not None]
    x = model.vectors(np.stack([language.gram_counts(r["text"]) for r in rows]))
    logits, y = x @ model.weights + model.bias, np.array([model.languages.index(r["lang"]) for r in rows])
    loss = lambda t: float(-np.log(np.maximum(language.softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean())
    assert loss(model.temperature) <= loss(1.0) + 0.01 and loss(model.temperature) < 0.2


def test_unlabelled_rows_pass(documents):
    bare = documents.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep(bare, language.fit(bare)).count() == documents.count()


def test_one_language_for_both_distances(spark):
    """Letters like one language and words like another are near none."""
    from itertools import cycle, islice

    german = " ".join(islice(cycle("der die und in den von zu das mit sich des auf straße häuser schön können müssen".split()), 300))
    mixed = " ".join(islice(cycle("de la que el en y los se las del un por strengths mßchtschwrt bchschprlng krßftstrnk schlchtwrts".split()), 300))
    got = by_id(quality.measures(spark.createDataFrame([(1, german), (2, mixed)], "doc_id bigint, text string")))
    for i, text in ((1, german), (2, mixed)):
        words, n = text.split(), len(text)
        classes = [sum(c in "aeiou" for c in text), sum("a" <= c <= "z" and c not in "aeiou" for c in text), 0, 0, text.count(" "), 0]
        p = [v / n for v in [*classes, n - sum(classes)]]
        js = lambda p, q: math.sqrt(max(0.0, sum(sum(a * math.log2(2 * a / (a + b)) for a, b in ((x, y), (y, x)) if a > 0) for x, y in zip(p, q)) / 2))
        pairs = []
        for lang, q in quality.CLASS_SHARES.items():
            common = quality.WORD_SHARES[lang]
            w = [words.count(c) / len(words) for c in common]
            pairs.append((js(p, q), js([*w, 1 - sum(w)], [*common.values(), 1 - sum(common.values())])))
        want = min(pairs, key=lambda d: max(d[0] / quality.CLASS_LIMIT, (d[0] + d[1]) / quality.SUM_LIMIT))
        assert abs(got[i]["class_distance"] - want[0]) < 1e-9 and abs(got[i]["word_distance"] - want[1]) < 1e-9


def test_reference_shares_are_those_in_use(documents, data, spark):
    good = documents.join(spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1"), "doc_id")
    for r in quality.reference_shares(good).collect():
        assert all(abs(a - b) < 0.03 for a, b in zip(r["classes"], quality.CLASS_SHARES[r["lang"]]))
        found = {w["word"]: w["share"] for w in r["words"]}
        assert len(set(found) & set(quality.WORD_SHARES[r["lang"]])) >= 9


def plain_fold(log):
    """Event by event: a dictionary of turns."""
    turns = {}
    for seq, turn, kind, role, text in log:
        if kind == "regenerate":
            for later in [t for t in turns if t > turn]:
                del turns[later]
        old = turns.get(turn, [None, ""])
        turns[turn] = [role if role is not None else old[0], old[1] + (text or "") if kind == "delta" else text or ""]
    return {t: tuple(v) for t, v in turns.items()}


def test_random_logs_equal_a_plain_fold(spark):
    rng = np.random.default_rng(9)
    logs, rows = {}, []
    for c in range(60):
        logs[c] = []
        for seq in range(int(rng.integers(1, 40))):
            kind = str(rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]))
            role = None if kind == "delta" and rng.random() < 0.7 else str(rng.choice(["user", "assistant"]))
            text = None if rng.random() < 0.1 else str(rng.choice(["a", "bc", "<", "\\", "", "é"]))
            logs[c].append((seq, int(rng.integers(0, 5)), kind, role, text))
        rows += [(c, *e) for e in logs[c]]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = {}
    for r in chat.fold(spark.createDataFrame(rows, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string")).collect():
        got.setdefault(r["conv_id"], {})[r["turn"]] = (r["role"], r["text"])
    for c, log in logs.items():
        assert got[c] == plain_fold(log), (c, log)
