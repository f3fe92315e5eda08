"""Queries of the training-data operators over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import ann, bpe_count, chat, divergence, language, packing, pieces, private, quality, secrets, sharding, simhash, variants
from groundwork.llm.common import bound_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), limit=2048)


#: Two turns that hold every control string and the escape sign itself.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string"))
    return chat.digests(chat.format_chat(chat.message_events(rows)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), buckets=16, token_budget=65_536)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=40)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~out))
    return language.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.scan(table(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def bounded(query: Query) -> Query:
    """The query in a session whose Arrow batches are bounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    named = {
        "op1_secrets": op1_secrets,
        "op2_nearest": op2_nearest,
        "op3_token_counts": op3_token_counts,
        "op4_chat_format": op4_chat_format,
        "op5_packing": op5_packing,
        "op6_sharding": op6_sharding,
        "op7_quality": op7_quality,
        "op8_simhash": op8_simhash,
        "op9_language": op9_language,
        "op10_pieces": op10_pieces,
        "op11_divergence": op11_divergence,
        "op12_private": op12_private,
        "op13_variants": op13_variants,
    }
    return {name: bounded(query) for name, query in named.items()}


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(replace(replace(coalesce(role, ''), '\', '\0'), '<', '\1')) + length(replace(replace(text, '\', '\0'), '<', '\1'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _js(p: str, q: str) -> str:
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    pi, qi = f"{p}[i]", f"{q}[i]"
    return f"sqrt(greatest(list_sum([{part.format(pi, qi)} + {part.format(qi, pi)} FOR i IN range(1, len({q}) + 1)]) / 2, 0))"


def op7_sql() -> str:
    ws = r"[\x20\x09-\x0D]"
    classes, words, langs = [], [], list(quality.CLASS_SHARES)
    for name in langs:
        common = quality.WORD_SHARES[name]
        classes.append(_js("p", str(list(map(float, quality.CLASS_SHARES[name])))))
        shares = [*common.values(), 1 - sum(common.values())]
        words.append(_js(f"c_{name}", str(shares)))
    counts = ",\n".join(f"[len(list_filter(lw, lambda x: x = w)) / greatest(n_words, 1) FOR w IN {list(quality.WORD_SHARES[n])}] AS c0_{n}" for n in langs)
    ended = ", ".join(f"list_append(c0_{n}, 1 - list_sum(c0_{n})) AS c_{n}" for n in langs)
    left = lambda r: f"length(text) - length(regexp_replace(text, '{r}', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (
  SELECT doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {left("[#*$%&|<>]")} AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, list_transform(w, lambda x: lower(x)) AS lw,
    [{left("[aeiou]")}, {left("[b-df-hj-np-tv-z]")}, {left("[A-Z]")}, {left("[0-9]")}, length(text) - length(array_to_string(w, '')), {left(r"[!-/:-@\[-`{-~]")}] AS k
  FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM b WHERE n_words >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM r) GROUP BY doc_id),
h AS (SELECT *, list_transform(list_append(k, length(text) - list_sum(k)), lambda x: x / greatest(length(text), 1)) AS p, {counts} FROM b),
e AS (SELECT *, {ended} FROM h),
m AS (
  SELECT e.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(text) AS n_chars,
    list_min([{", ".join(f"greatest({c} / {quality.CLASS_LIMIT}, ({c} + {w}) / {quality.SUM_LIMIT})" for c, w in zip(classes, words))}]) AS far
  FROM e LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_chars < {quality.LEAST_CHARS} OR n_words < {quality.LEAST_WORDS} OR far <= 1) AS kept
FROM f
"""


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
t AS (SELECT lang, source, row, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM u
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op7_quality": op7_sql(), "op11_divergence": OP11_SQL}
