"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, language, licenses, media, ngram_join, packing, quality, secrets, sentencepiece_codec, toxicity
from .common import held_out, materialize, table


def tokenizer(name: str) -> str:
    folder = os.environ.get("LEXIWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"), ~held_out(5, 1))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_texts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), encode_special_tokens=False)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    scored = toxicity.score(docs.withColumn("held_out", held_out(5, 0)), model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.profiles(docs.where(~held_out(4, 2)).select("text", "lang"))
    held = docs.select(F.col("doc_id").cast("long"), held_out(4, 2).alias("held_out"), "text")
    return language.identify(held, model, ("doc_id", "held_out"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string").alias("lang"))
    measured = materialize(quality.measures(docs, ("doc_id", "lang")))
    cutoffs = quality.calibrate(measured, table(spark, sf_dir, "labels"), "lang", F.lit(True))
    judged = quality.judge(measured, cutoffs, "lang")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"), "guarantee")


def base_of_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can say."""
    return op3_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "n_samples", "n_keyframes", F.round("duration_s", 6).alias("duration_s"))


def base_of_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can say."""
    return op7_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_of_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents op9 gives a language."""
    return op9_language_id(spark, sf_dir).select("doc_id", (F.col("lang_pred") == "und").alias("und"))


def base_of_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can say."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    f.__name__: f
    for f in (op1_context_tree_weighting, op2_sentencepiece, op3_media_columns, op4_packing, op5_ngram_jaccard_join, op6_toxicity, op7_secret_scans, op8_license_scans, op9_language_id, op10_quality_rules, base_of_op3, base_of_op7, base_of_op9, base_of_op10)
}
#: op5 by pairs of documents that share a shingle, as strings; components by reachability.
NGRAM_JACCARD = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edge AS MATERIALIZED (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node
)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(reach.root), w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.node = w.doc_id
GROUP BY w.doc_id
"""
#: The payload: UTF-8 bytes and as many 255s as fill whole frames of 576.
MEDIA = r"""
WITH raw AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, greatest(1, (strlen(coalesce(text, '')) + 575) // 576) AS frames FROM documents
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, (frames * 576)::BIGINT AS payload_bytes,
       sha256(unhex(hex(b) || repeat('FF', (frames * 576 - octet_length(b))::INT))) AS payload_sha256,
       frames::BIGINT AS n_samples, ((frames + 11) // 12)::BIGINT AS n_keyframes, round(frames / 25.0, 6)::DOUBLE AS duration_s
FROM raw
"""
#: Spans of each kind from the lengths of the matches and of the text between them.
SECRETS = r"""
WITH cut AS MATERIALIZED (
  SELECT doc_id, 0 AS k, 'assign' AS kind, 6 AS least, regexp_extract_all(coalesce(text, ''), '@ASSIGN@', 0) AS m, regexp_extract_all(coalesce(text, ''), '@ASSIGN@', 1) AS body, regexp_split_to_array(coalesce(text, ''), '@ASSIGN@') AS gap FROM documents
  UNION ALL
  SELECT doc_id, 1, 'access', 20, regexp_extract_all(coalesce(text, ''), '(AKIA[A-Z0-9]+)', 0), regexp_extract_all(coalesce(text, ''), '(AKIA[A-Z0-9]+)', 1), regexp_split_to_array(coalesce(text, ''), '(AKIA[A-Z0-9]+)') FROM documents
  UNION ALL
  SELECT doc_id, 2, 'hex', 24, regexp_extract_all(coalesce(text, ''), '([0-9a-f]{24,})', 0), regexp_extract_all(coalesce(text, ''), '([0-9a-f]{24,})', 1), regexp_split_to_array(coalesce(text, ''), '([0-9a-f]{24,})') FROM documents
), one AS (
  SELECT doc_id, k, kind, least, i, m[i] AS m, body[i] AS body, gap[i] AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut)
), placed AS (
  SELECT doc_id, k, kind, least, body, length(m) AS n, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM one
), span AS (
  SELECT doc_id, k, kind, (e - n)::BIGINT AS s, e::BIGINT AS e FROM placed WHERE length(body) >= least
)
SELECT d.doc_id, count(*) FILTER (k = 0)::BIGINT AS n_assign, count(*) FILTER (k = 1)::BIGINT AS n_access, count(*) FILTER (k = 2)::BIGINT AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '')) AS base_sha256
FROM documents d LEFT JOIN span ON span.doc_id = d.doc_id GROUP BY d.doc_id
""".replace("@ASSIGN@", r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")
LANGUAGE = "SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '\\p{L}') AS und FROM documents"
QUALITY = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g
), cover AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM twice, range(3) x(o) WHERE c > 1 GROUP BY doc_id
), line AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w
), dup AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""
ORACLES: dict[str, str] = {"op5_ngram_jaccard_join": NGRAM_JACCARD, "base_of_op3": MEDIA, "base_of_op7": SECRETS, "base_of_op9": LANGUAGE, "base_of_op10": QUALITY}
