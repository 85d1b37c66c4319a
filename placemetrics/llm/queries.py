"""The dealt operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm.token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm.codec import encode_digests
    return encode_digests(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm.packing import pack
    return pack(spark, table(spark, sf_dir, "documents"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm.jaccard_join import jaccard_components
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm import toxicity
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm import langid
    from placemetrics.llm.quality import held_out
    docs = table(spark, sf_dir, "documents")
    out = held_out(4, 2)
    predicted = langid.predict(docs, langid.train(docs.where(F.col("doc_id").isNotNull() & ~out)))
    return predicted.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm.nn_descent import near_duplicates_and_recall
    rows, recall = near_duplicates_and_recall(spark, table(spark, sf_dir, "embeddings"))
    return rows.withColumn("audited_recall", F.lit(float(recall)))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm.merkle import compare_with_edits
    return compare_with_edits(spark, table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm import quality
    docs = table(spark, sf_dir, "documents")
    out = quality.held_out(5, 0)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~out))
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm import secret_scan
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm.whitening import whiten
    return whiten(spark, table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm import chat
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"SELECT * FROM VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    added = added.select(*(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    return chat.digests(chat.format_windows(rows.unionByName(added)))


def repeated_tail(doc_id: object, text: str) -> list[str]:
    """Words of a text; of every tenth document a tail repeats, by the checksum of its id. Without an id the words as they are."""
    from placemetrics.llm.runs import WORD
    words = WORD.findall(text)
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placemetrics.llm import runs
    return runs.digests(runs.find_runs(table(spark, sf_dir, "documents"), words_of=repeated_tail))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_toxicity, op3_token_counts, op4_language, op5_near_vectors, op6_fingerprints, op7_quality, op8_secrets, op9_codec, op10_packing, op11_whitening, op12_chat_format, op13_periodic_runs)}
#: Windows are told by sums over the turns; the escaping of texts is undone nowhere, as it is never done to what is digested.
OP12 = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, CAST(floor(turn / 256.0) AS BIGINT) AS block, regexp_replace(role, '([\[<])(\\*)(/?INST\]|/s>)', '\1\\\2\3', 'g') AS e_role,
         regexp_replace(text, '([\[<])(\\*)(/?INST\]|/s>)', '\1\\\2\3', 'g') AS e_text FROM given),
sized AS (
  SELECT *, length(e_role) + length(e_text) + 17 AS chars,
         len(regexp_extract_all(e_role, '[\p{L}\p{N}]{1,6}|[^\x20\x09-\x0D\p{L}\p{N}]')) + len(regexp_extract_all(e_text, '[\p{L}\p{N}]{1,6}|[^\x20\x09-\x0D\p{L}\p{N}]')) + 3 AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, e_role, e_text) AS place FROM escaped),
headed AS (
  SELECT *, place = 1 AND role = 'system' AS is_system,
         coalesce(max(CASE WHEN place = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS s_tokens,
         coalesce(max(CASE WHEN place = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id), 0) AS s_chars FROM sized),
summed AS (
  SELECT *, greatest(1024 - s_tokens - 256, 1) AS room, CASE WHEN is_system THEN 0 ELSE tokens END AS own,
         sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id, block) AS total FROM headed),
split AS (SELECT *, NOT is_system AND total > room AND 2 * tokens > room AS large FROM summed),
small AS (SELECT *, CASE WHEN large THEN 0 ELSE own END AS small, max(CASE WHEN large THEN 0 ELSE own END) OVER (PARTITION BY conv_id, block) AS most FROM split),
grouped AS (
  SELECT *, sum(small) OVER w - small AS before, sum(CASE WHEN large THEN 1 ELSE 0 END) OVER w AS larges, CASE WHEN total <= room THEN room + 1 ELSE room - most END AS span
  FROM small WINDOW w AS (PARTITION BY conv_id, block ORDER BY place)),
marked AS (SELECT *, CASE WHEN is_system THEN NULL ELSE (larges, large, before // span) END AS g FROM grouped),
opened AS (
  SELECT *, lag(block) OVER w IS DISTINCT FROM block OR (lag(g) OVER w IS NOT NULL AND lag(g) OVER w IS DISTINCT FROM g) AS opens,
         lag(block, 1) OVER w AS b1, lag(block, 2) OVER w AS b2, lag(is_system, 1) OVER w AS y1, lag(is_system, 2) OVER w AS y2,
         lag(tokens, 1) OVER w AS t1, lag(tokens, 2) OVER w AS t2, lag(chars, 1) OVER w AS c1, lag(chars, 2) OVER w AS c2
  FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
shown AS (
  SELECT *, CASE WHEN place = 1 OR NOT opens THEN 0
                 ELSE s_chars + CASE WHEN NOT y1 AND t1 <= 256 THEN c1 ELSE 0 END
                      + CASE WHEN NOT y1 AND NOT y2 AND t1 + t2 <= 256 AND (b1 = block OR b2 = b1) THEN c2 ELSE 0 END END AS again FROM opened)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + coalesce(again, 0)) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
ORACLE: dict[str, str] = {"op12_chat_format": OP12}
