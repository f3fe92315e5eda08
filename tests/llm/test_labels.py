from pyspark.sql import functions as F

from groundwork.llm import language


def test_the_most_frequent_labels_are_learned(documents):
    """Hundreds of junk labels: the most frequent count, ties by name, and the sample stays in its bound."""
    junk = documents.withColumn("lang", F.concat(F.lit("junk"), F.col("doc_id").cast("string")))
    both = documents.unionByName(junk)
    model = language.fit(both, most_languages=6, most_rows=120)
    known = {r["lang"] for r in documents.select("lang").distinct().collect() if r["lang"]}
    assert known <= set(model.languages) and len(model.languages) == 6
    ids = sorted(f"junk{r['doc_id']}" for r in documents.filter("text is not null").select("doc_id").collect())
    assert sorted(set(model.languages) - known) == ids[: 6 - len(known)]
    assert model.weights.shape[1] == 6


def test_few_labels_are_all_learned(documents):
    assert language.fit(documents).languages == sorted({r["lang"] for r in documents.filter("text is not null").select("lang").distinct().collect() if r["lang"]})
