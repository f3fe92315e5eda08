"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (proximal, elastic net) on a bounded sample of
labelled texts; document frequencies cover all labelled texts; a temperature fitted on
sample texts kept out of training calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import map_texts

#: Hashed n-gram buckets.
BUCKETS = 1 << 14
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code of the lower-case letter for each code point below 65,536, a space for all that is no letter."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else _SPACE for c in range(1 << 16)], np.uint64)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed one-, two- and three-grams of a text's letters; None if it has none."""
    if not text:
        return None
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    x = _letters()[np.minimum(code, 65_535)]
    for at in np.nonzero(code > 65_535)[0]:
        x[at] = code[at] if chr(code[at]).isalpha() else _SPACE
    x = np.concatenate([[_SPACE], x, [_SPACE]]).astype(np.uint64)
    x = x[np.concatenate([[True], (x[1:] != _SPACE) | (x[:-1] != _SPACE)])]
    if len(x) < 3:
        return None
    two = x[:-1] * np.uint64(0x9E3779B1) + x[1:]
    three = two[:-1] * np.uint64(0x85EBCA77) + x[2:]
    grams = np.concatenate([x[1:-1], two + np.uint64(1 << 40), three + np.uint64(1 << 41)])
    grams *= np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((grams >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None  # bucket x language
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = counts.astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for start in range(0, len(texts), 32):  # so many dense rows at a time
            found = [(i, c) for i in range(start, min(start + 32, len(texts))) if (c := gram_counts(texts[i])) is not None]
            if not found:
                continue
            p = softmax((self.vectors(np.stack([c for _, c in found])) @ self.weights + self.bias) / self.temperature)
            for (i, _), row in zip(found, p):
                best = int(np.argmax(row))
                names[i], scores[i] = self.languages[best], float(min(row[best], 1.0))
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], k: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on sparse rows (buckets, values); the last bucket is the bias."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x = rows[r]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[labels[r]] -= 1.0
            g = x[:, None] * p
            ns2 = ns + g * g
            z[at] = zs + g - (np.sqrt(ns2) - np.sqrt(ns)) / alpha * w
            n[at] = ns2
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of the least log loss, by golden section on its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: a quarter, by the id's checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(train: DataFrame, rows_per_language: int = 800, seed: int = 5, most_languages: int = 128, most_rows: int = 12_800) -> LanguageModel:
    """Model of labelled documents (doc_id, text, lang; rows without a text or lang are left out).

    The classifier sees a sample of about ``rows_per_language`` documents of each language, about ``most_rows`` in
    all, at most twice that (the rows with the smallest keys); document frequencies come from every document. A fifth of the
    sample fits the temperature only. Of more than ``most_languages`` labels the most frequent are learned
    (ties by name): a driver row, and a column of the weights, is held for each of these only.
    Without documents the model knows no language.
    """
    train = train.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return LanguageModel()
    languages = sorted(sizes)
    rows_per_language = min(rows_per_language, max(1, most_rows // len(languages)))

    def frequencies(batches):
        seen, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (c := gram_counts(text)) is not None:
                    seen += c > 0
                    docs += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], docs), pa.int64())], names=["bucket", "n"])

    found = train.select("text").mapInArrow(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1)
    for r in found:
        df[r["bucket"]] = r["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def sparse(batches):
        for batch in batches:
            counts = [gram_counts(t) for t in batch.column(1).to_pylist()]
            at = [(np.nonzero(c)[0] if c is not None else np.zeros(0)).astype("<i4").tobytes() for c in counts]
            n = [(c[c > 0] if c is not None else np.zeros(0)).astype("<i4").tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "key", "at", "n"])

    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, rows_per_language / sizes[name])))])
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    drawn = train.filter(F.pmod(key, F.lit(1_000_000)) / 1e6 < F.try_element_at(share, F.col("lang"))).select("lang", "text", key.alias("key"))
    # the bound: the smallest keys, merged from bounded heaps of the partitions
    sample = drawn.mapInArrow(sparse, "lang string, key bigint, at binary, n binary").orderBy("key", "lang").limit(2 * rows_per_language * len(languages)).collect()
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    rows, labels = [], []
    for r in sorted(sample, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"]))):
        if r["at"]:
            at = np.frombuffer(r["at"], "<i4")
            x = np.frombuffer(r["n"], "<i4") * idf[at]
            rows.append((at, x / np.linalg.norm(x)))
            labels.append(languages.index(r["lang"]))
    order = np.random.default_rng(seed).permutation(len(rows))
    kept, apart = order[len(rows) // 5 :], order[: len(rows) // 5]
    w, b = train_ftrl([rows[i] for i in kept], [labels[i] for i in kept], len(languages))
    model.temperature = fit_temperature(np.array([rows[i][1] @ w[rows[i][0]] + b for i in apart]), np.array([labels[i] for i in apart], int))
    model.weights, model.bias = w.astype(np.float32), b.astype(np.float32)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score: one row per input row, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0. Equal texts have equal
    predictions. Whole texts count. An empty table gives an empty result.
    """

    def run(texts: list) -> list[pa.Array]:
        names, scores = model.predict(texts)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return map_texts(docs, run, "lang_pred string, score double")


def keep(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows and columns of ``docs`` whose text has a known language with a score of ``least`` or more.

    Null texts and texts without a letter go; other columns may have any names. A model
    that knows no language (nothing was labelled) judges nothing: every row stays.
    """
    if not model.languages:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            names, scores = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
