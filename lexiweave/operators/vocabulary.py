"""Vocabularies and word-keyed joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import standardize


def word_count(tokens: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, word, n) of tokens(by, word)."""
    return tokens.groupBy(*by, "word").agg(F.count("*").alias("n"))


def scan_vocabulary(tokens: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    rows = tokens if dictionary is None else tokens.join(dictionary.select("word").distinct(), "word", "left_semi")
    return word_count(rows)


def trimmed(counts: DataFrame, min_count: int, without: DataFrame | None = None) -> DataFrame:
    kept = counts.where(F.col("n") >= min_count)
    return kept if without is None else kept.join(without.select("word").distinct(), "word", "left_anti")


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(k)


def with_ids(counts: DataFrame) -> DataFrame:
    """word_id from 0 by falling count; a vocabulary is far smaller than its corpus, and is numbered in one task."""
    return counts.withColumn("word_id", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).cast("long"))


def standardize_words(df: DataFrame, lower: bool = True) -> DataFrame:
    """One row a standardised word: the row that was in that form already, else the first by word."""
    form = standardize("word", lower)
    w = Window.partitionBy("form").orderBy(F.desc(F.col("word") == F.col("form")), "word")
    rows = df.withColumn("form", form).where("form != ''").withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.withColumn("word", F.col("form")).drop("form", "r")


def transform_words(df: DataFrame, f) -> DataFrame:
    """As standardize_words, by any Column function of the word."""
    w = Window.partitionBy("form").orderBy(F.desc(F.col("word") == F.col("form")), "word")
    return df.withColumn("form", f(F.col("word"))).withColumn("r", F.row_number().over(w)).where("r = 1").withColumn("word", F.col("form")).drop("form", "r")


def index_table(part: DataFrame, full: DataFrame) -> DataFrame:
    """(word, word_id) of part's words in full(word, word_id)."""
    return part.select("word").join(full.select("word", "word_id"), "word")


def membership(full: DataFrame, part: DataFrame) -> DataFrame:
    return full.join(part.select("word", F.lit(True).alias("member")).distinct(), "word", "left").withColumn("member", F.coalesce("member", F.lit(False)))


def union_counts(models: DataFrame) -> DataFrame:
    """(word, n_models) of models(model_id, word)."""
    return models.groupBy("word").agg(F.count_distinct("model_id").alias("n_models"))


def intersection(models: DataFrame, parts: int) -> DataFrame:
    return union_counts(models).where(F.col("n_models") == parts).select("word")


def common(source: DataFrame, target: DataFrame) -> DataFrame:
    """(word, source, target): the vectors of the words both have."""
    return source.select("word", F.col("vector").alias("source")).join(target.select("word", F.col("vector").alias("target")), "word")


def concat(source: DataFrame, target: DataFrame) -> DataFrame:
    return common(source, target).select("word", F.concat("source", "target").alias("vector"))


def join_all(models: DataFrame, parts: int) -> DataFrame:
    """Vectors side by side, in order of model_id, of the words that all `parts` models have."""
    rows = models.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("model_id", "vector"))).alias("m")).where(F.size("m") == parts)
    return rows.select("word", F.flatten(F.transform("m", lambda x: x["vector"])).alias("vector"))


def only_in(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.join(target.select("word"), "word", "left_anti")


def restrict(df: DataFrame, words: DataFrame) -> DataFrame:
    return df.join(words.select("word").distinct(), "word", "left_semi")


def lookup(words: DataFrame, embedding: DataFrame, default: Column) -> DataFrame:
    """words with `vector`, or the default where the embedding lacks the word."""
    return words.join(embedding.select("word", "vector"), "word", "left").withColumn("vector", F.coalesce("vector", default))


def upsert(embedding: DataFrame, rows: DataFrame) -> DataFrame:
    return embedding.join(rows.select("word"), "word", "left_anti").unionByName(rows)


def remove(embedding: DataFrame, words: DataFrame) -> DataFrame:
    """embedding without words(word)."""
    return embedding.join(words.select("word").distinct(), "word", "left_anti")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two embeddings with no word in common; a shared word is an error."""
    shared = a.join(b.select("word"), "word", "left_semi").select("word").first()
    if shared:
        raise ValueError(f"both have the word {shared[0]!r}")
    return a.unionByName(b)


def demanded(questions: DataFrame, columns: list[str], words: DataFrame) -> DataFrame:
    """The questions whose words are all in words(word)."""
    known = words.select(F.col("word").alias("__w")).distinct()
    return reduce(lambda q, c: q.join(known, q[c] == known["__w"], "left_semi"), columns, questions)


def recall(vocabularies: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(model_id, dataset, recall), 3 decimals cut off: the share of a benchmark's words that a model has."""
    words = benchmarks.select("dataset", "word").distinct()
    sizes = words.groupBy("dataset").agg(F.count("*").alias("size"))
    met = words.join(vocabularies.select("model_id", "word").distinct(), "word").groupBy("model_id", "dataset").agg(F.count("*").alias("n"))
    grid = vocabularies.select("model_id").distinct().join(F.broadcast(sizes))  # models x benchmarks, both few
    out = grid.join(met, ["model_id", "dataset"], "left")
    return out.select("model_id", "dataset", (F.floor(F.coalesce("n", F.lit(0)) * 1000 / F.col("size")) / 1000).alias("recall"))


def extrinsic_split(source: DataFrame, target: DataFrame) -> DataFrame:
    """(word, role, source, target): train where both have the word, validation where only source has."""
    rows = source.select("word", F.col("vector").alias("source")).join(target.select("word", F.col("vector").alias("target")), "word", "left")
    zero = F.transform("source", lambda x: F.lit(0.0))
    return rows.select("word", F.when(F.col("target").isNull(), "validation").otherwise("train").alias("role"), "source", F.coalesce("target", zero).alias("target"))


def intrinsic_split(source: DataFrame, target: DataFrame, train: float = 0.6, test: float = 0.4) -> DataFrame:
    """The common words in order of word: the first share trains, the next tests, what is left validates."""
    rows = common(source, target)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    r = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("word"))
    role = F.when(F.col("r") <= F.round(F.col("n") * train), "train").when(F.col("r") <= F.round(F.col("n") * train) + F.round(F.col("n") * test), "test").otherwise("validation")
    return rows.withColumn("n", n).withColumn("r", r).select("word", role.alias("role"), "source", "target")


def half_mask(benchmark: DataFrame, counts: DataFrame) -> DataFrame:
    """The more frequent floor(n/2) of a benchmark's words, by corpus count."""
    rows = benchmark.select("word").distinct().join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("r", F.row_number().over(w.orderBy("n", "word"))).withColumn("all", F.count("*").over(w))
    return rows.where(F.col("r") > F.col("all") - F.floor(F.col("all") / 2)).select("word", "n")


def fill_zero(source: DataFrame, target: DataFrame) -> DataFrame:
    """target plus zero vectors for the words that only source has."""
    return target.select("word", "vector").unionByName(only_in(source, target).select("word", F.transform("vector", lambda x: F.lit(0.0)).alias("vector")))


def reciprocal_rank(ranked: DataFrame, pairs: DataFrame, n: int, absent: float = 0.0) -> DataFrame:
    """pairs(x, y) with 1 / rank of y among ranked(x, y, rank) up to n, or `absent`."""
    return pairs.join(ranked.where(F.col("rank") <= n), ["x", "y"], "left").select("x", "y", F.coalesce(1 / F.col("rank"), F.lit(absent)).alias("score"))
