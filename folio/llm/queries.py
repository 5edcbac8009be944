"""The queries over the training tables and the SQL that gives the same rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embedding_dedup, langid, quality, secret_scan, simhash, source_mix, suffix_dedup, toxicity
from ._shared import fold, materialize, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.group(table(spark, sf_dir, "embeddings"))


def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix aims at, before any document is chosen."""
    return op2_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base patterns' counts alone."""
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.array("source").alias("sources"), source_mix.words(F.col("text")).alias("size"))
    docs = materialize(docs, "sizes")
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    quotas = source_mix.targets(sizes)
    order = source_mix.by_code_point(sizes)
    known = pa.table({"of": pa.array(order, pa.string()), "source_size": pa.array([sizes[s] for s in order], pa.int64()), "target": pa.array([quotas[s] for s in order], pa.float64())})
    mixed = source_mix.mix(docs, quotas).apply(docs, F.col("size"), F.col("sources"))
    return mixed.join(spark.createDataFrame(known), F.col("of").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return quality.verdict(toxicity.score(docs, model), 0.5, 5, 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.verdict(quality.score(docs, net), 0.3, 5, 0)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("first_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return chat.digest(chat.format_chats(chat.text_turns(rows)))


#: Links by cosine over all pairs, then each vector's smallest reachable one.
OP1_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT l.a, r.root FROM reach r JOIN links l ON l.b = r.vec_id WHERE r.root < l.a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY 1) LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY 1) ON a = vec_id
"""

#: Sources in the order of their caps: the first ones stop at three times their size, the others share what is left by weight.
TARGETS_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM sized GROUP BY source),
ranked AS (SELECT *, 3 * n / w AS cap, row_number() OVER (ORDER BY 3 * n / w, source NULLS LAST) AS k FROM s),
upto AS (SELECT *, (SELECT sum(n) FROM s) - 3 * (sum(n) OVER (ORDER BY k) - n) AS words, (SELECT sum(w) FROM s) - (sum(w) OVER (ORDER BY k) - w) AS weights FROM ranked),
first AS (SELECT min(k) AS k FROM upto WHERE words * w / weights <= 3 * n),
t AS (SELECT u.source, CAST(u.n AS BIGINT) AS source_size, CASE WHEN f.k IS NULL OR u.k < f.k THEN CAST(3 * u.n AS DOUBLE) ELSE CAST(o.words AS DOUBLE) * u.w / o.weights END AS target FROM upto u CROSS JOIN first f LEFT JOIN upto o ON o.k = f.k)
SELECT doc_id, size, source_size, target FROM sized JOIN t ON t.source IS NOT DISTINCT FROM sized.source
"""

SECRETS_SQL = r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn:|>') + length(role) + CASE WHEN role = 'assistant' THEN length('</s>') ELSE length('[INST]  [/INST]') END
         + length(regexp_replace(text, '([\[<])(\\*)(INST\]|/INST\]|s>|/s>|\|)', '\1\2\\\3', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def queries() -> dict:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_source_mix": op2_source_mix,
        "op3_simhash": op3_simhash,
        "op4_secret_scan": op4_secret_scan,
        "op5_toxicity": op5_toxicity,
        "op6_quality": op6_quality,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_decontaminate": op8_decontaminate,
        "op9_language_id": op9_language_id,
        "op10_chat_format": op10_chat_format,
        "source_targets": source_targets,
        "secret_counts": secret_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op10_chat_format": OP10_SQL, "source_targets": TARGETS_SQL, "secret_counts": SECRETS_SQL}
