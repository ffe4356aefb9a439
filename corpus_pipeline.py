"""The training-data pipeline over `documents`: reject toxic texts and texts of no known
language, keep one document of each group of near copies, mask secrets, pack the rest.

Each stage is written as Parquet and read again as the next one's documents, so a lost
executor costs at most one stage. Stages judge all rows that their predecessor kept and
carry all its columns, whatever their names.

A null or empty text is not toxic, has no language and goes in the second stage, as does a
text without a letter. Rows that repeat an id are judged each; of rows with equal or
near texts one stays, that of the smallest id (a null id counts as the largest). Ties go by
id. Texts of any length are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import language, ngram_join, packing, secrets, toxicity
from lexiweave.llm.common import held_out, materialize, numbered, table
from lexiweave.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents predicted toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return toxicity.judged(docs, model).where("predicted = 0").select("kept.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, so of no language, go; `lang` becomes the prediction."""
    model = language.profiles(docs.where(~held_out(4, 2)).select("text", "lang"))
    found = language.predicted(docs, model).where("lang_pred != 'und'")
    return found.select(*(F.col("lang_pred" if c == "lang" else f"kept.`{c}`").alias(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents one row, of the smallest doc_id, stays."""
    rows = numbered(docs)
    stay = ngram_join.representatives(rows.select("row", "kept.doc_id", "kept.text"))
    return rows.join(stay, "row", "left_semi").select("kept.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span is masked; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), encode_special_tokens=False)


STAGES = [("toxicity", drop_toxic), ("language ID", known_language), ("n-gram Jaccard join", one_of_near_copies), ("secret scans", mask_secrets), ("packing", pack)]
#: The learned stages and the packing are not SQL; tests hold the other stages, and run() by its invariants, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
