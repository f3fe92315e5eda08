"""The pipeline against plain versions of its stages, each judged on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundwork.llm import language, packing, quality, secrets
from tests.llm.test_simhash import alike, five_words, plain_components


@pytest.fixture(scope="module")
def stages(spark, documents, tmp_path_factory):
    out, docs = [documents], documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("p") / str(k))
        stage(spark, docs, None).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_order_and_columns(stages, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "secret scans", "packing"]
    assert all(s.columns == documents.columns for s in stages[:-1])


def test_rules_take_effect(stages):
    want = {r["doc_id"] for r in quality.judge(stages[0]).filter("kept").collect()}
    assert as_rows(stages[1]) == as_rows(stages[0].filter(F.col("doc_id").isin(*want)))


def test_language_takes_effect(stages):
    docs = stages[1]
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    rows = docs.collect()
    names, scores = model.predict([r["text"] for r in rows])
    want = sorted((tuple(r) for r, n, s in zip(rows, names, scores) if n != "und" and s >= 0.5), key=repr)
    assert as_rows(stages[2]) == want and len(want) >= 0.98 * len(rows)


def test_near_copies_go(stages):
    rows = sorted(tuple(r) for r in stages[2].collect())
    sets = [five_words(r[1]) for r in rows]
    roots = plain_components(len(rows), lambda i, j: alike(sets[i], sets[j]))
    assert as_rows(stages[3]) == sorted((r for k, r in enumerate(rows) if roots[k] == k), key=repr)


def test_secrets_go(stages):
    tagger = secrets.train()
    before = {r["doc_id"]: r for r in stages[3].collect()}
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert set(before) == set(after)
    changed = 0
    for i, r in after.items():
        assert r["text"] == secrets.redacted(before[i]["text"], tagger.all_spans([before[i]["text"]])[0]) and r["n_chars"] == len(r["text"])
        assert not secrets.base_spans(r["text"])
        changed += r["text"] != before[i]["text"]
    assert changed > 0


def test_every_kept_row_is_packed(stages):
    assert sorted(r["doc_id"] for r in stages[5].collect()) == sorted(r["doc_id"] for r in stages[4].collect())


def test_run_equals_the_stages(spark, data, stages):
    assert as_rows(corpus_pipeline.run(spark, data)) == as_rows(stages[-1])


def test_odd_tables_pass_through(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, None).columns == docs.columns
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
    assert docs.count() == 0 and docs.columns == packing.pack(empty).columns
