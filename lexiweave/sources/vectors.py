"""Embedding readers and writers. An embedding is a DataFrame (word, vector array<double>), several with model_id."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalize


def _numbers(parts: Column) -> Column:
    return F.transform(parts, lambda x: x.try_cast("double"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), "value")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """`word, v1, v2`: the word ends at the first comma; a 3-digit mapper id before a tab is dropped."""
    p = F.split("value", ",", 2)
    return _lines(spark, path).select("file", F.regexp_replace(F.trim(p[0]), r"^[0-9]{3}\t", "").alias("word"), _numbers(F.split(F.get(p, F.lit(1)), ",")).alias("vector"))


def read_hadoop(spark: SparkSession, path: str) -> DataFrame:
    """`'word':v1,v2`: the word ends at the last colon; quotes around it are dropped."""
    return _lines(spark, path).select("file", F.regexp_replace(F.regexp_extract("value", "^(.*):", 1), "^'|'$", "").alias("word"), _numbers(F.split(F.regexp_extract("value", ":([^:]*)$", 1), ",")).alias("vector"))


def read_word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    """A header `V D` in the file, or in one file of its folder, then words (with one space at most) and D numbers; other lines are skipped.

    A folder without a header, or with more words than it states, is an error.
    """
    rows = _lines(spark, path).withColumn("p", F.split(F.trim("value"), " ")).withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
    header = rows.where((F.size("p") == 2) & F.col("p")[0].rlike("^[0-9]+$") & F.col("p")[1].rlike("^[0-9]+$"))
    heads = header.groupBy("folder", "file").agg(F.max(F.col("p")[0].cast("long")).alias("v"), F.max(F.col("p")[1].cast("int")).alias("d"))
    body = rows.where(F.size("p") > 2).join(F.broadcast(heads.select("file", "d")), "file", "left")  # a row a file
    shared = heads.groupBy("folder").agg(F.max("d").alias("folder_d"))
    body = body.join(F.broadcast(shared), "folder", "left").withColumn("d", F.coalesce("d", "folder_d"))
    extra = F.size("p") - F.col("d")
    words = body.where(extra.isNull() | extra.isin(1, 2)).select("folder", "file", "d", F.array_join(F.slice("p", 1, extra), " ").alias("word"), _numbers(F.slice("p", extra + 1, F.col("d"))).alias("vector"))
    words = words.where(F.col("d").isNull() | F.forall("vector", lambda x: x.isNotNull()))
    stated = heads.groupBy("folder").agg(F.sum("v").alias("v"))
    wrong = words.groupBy("folder").agg(F.count("*").alias("n")).join(F.broadcast(stated), "folder", "left").where("v is null or n > v").first()
    if wrong:
        raise ValueError(f"{wrong['folder']}: " + ("no header" if wrong["v"] is None else f"{wrong['n']} words, {wrong['v']} in the header"))
    return words.select("file", "word", "vector")


def read_word2vec_binary(spark: SparkSession, path: str) -> DataFrame:
    """A header `V D`, then each word, a space, and D little-endian float32."""

    def parse(it):
        import numpy as np

        for pdf in it:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                head, at = data.split(b"\n", 1)[0], data.index(b"\n") + 1
                n, d = map(int, head.split())
                words, vectors = [], []
                for _ in range(n):
                    end = data.index(b" ", at)
                    words.append(data[at:end].lstrip(b"\n").decode("utf-8", "replace"))
                    vectors.append(np.frombuffer(data, "<f4", d, end + 1).astype(float))
                    at = end + 1 + 4 * d
                yield pd.DataFrame({"file": name, "word": words, "vector": vectors})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, word string, vector array<double>")


def read_glove(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """The word is all before the last `dim` fields."""
    rows = _lines(spark, path).withColumn("p", F.split("value", " ")).where(F.size("p") > dim)
    return rows.select("file", F.array_join(F.slice("p", F.lit(1), F.size("p") - dim), " ").alias("word"), _numbers(F.slice("p", F.size("p") - dim + 1, F.lit(dim))).alias("vector"))


def from_dict(spark: SparkSession, vectors: dict) -> DataFrame:
    return spark.createDataFrame([(w, [float(x) for x in v]) for w, v in vectors.items()], "word string, vector array<double>")


def from_counts(spark: SparkSession, counts: DataFrame, vectors: DataFrame, standardize: bool = True) -> DataFrame:
    """A model's vocabulary counts(word, n) with its vectors: by falling count the first row of each (standardised) word."""
    from ..functions.text import standardize as form

    rows = vectors.join(counts, "word").withColumn("form", form("word", False) if standardize else F.col("word"))
    w = Window.partitionBy("form").orderBy(F.desc("n"), "word")
    first = rows.where("form != ''").withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.select(F.col("form").alias("word"), "vector", "n")


def read_pickle(spark: SparkSession, path: str) -> DataFrame:
    """A pickled dict of vectors, or a pair (vocabulary, vectors): one local file of the user's own, as pickles run code."""
    import pickle

    with open(path, "rb") as f:
        stored = pickle.load(f)
    if not isinstance(stored, dict):
        words, vectors = stored
        stored = dict(zip(words, vectors, strict=True))
    return from_dict(spark, stored)


READERS = {
    "csv": read_csv, "hadoop": read_hadoop, "word2vec": read_word2vec_text, "word2vec_bin": read_word2vec_binary, "glove": read_glove,
    "parquet": lambda spark, path: spark.read.parquet(path), "dict": from_dict, "pickle": read_pickle,
}


def load(spark: SparkSession, path, form: str, norm: bool = False, standardize: bool = False, lower: bool = True, **kwargs) -> DataFrame:
    """An embedding in any of READERS' formats, normalised and standardised if asked."""
    from ..operators.vocabulary import standardize_words

    if form not in READERS:
        raise ValueError(f"no reader for {form!r}; there are {', '.join(sorted(READERS))}")
    df = READERS[form](spark, path, **kwargs)
    if standardize:
        df = standardize_words(df, lower)
    return df.withColumn("vector", normalize("vector")) if norm else df


def with_counts(df: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """df, a word at most once, with the counts of vocabulary(word, count) where there is one."""
    rows = checked_unique(df)
    return rows if vocabulary is None else rows.join(vocabulary.select("word", "count"), "word", "left")


def checked_unique(df: DataFrame) -> DataFrame:
    """df, or an error that names a word it has twice."""
    twice = df.groupBy("word").count().where("count > 1").select("word").first()
    if twice:
        raise ValueError(f"the word {twice[0]!r} occurs twice")
    return df


def slices(wide: DataFrame, dim_sub: int) -> DataFrame:
    """Joined wide vectors cut into (model_id, word, vector) of dim_sub numbers each."""
    n = F.floor(F.size("vector") / dim_sub).cast("int")
    return wide.select("word", "vector", F.explode(F.sequence(F.lit(0), n - 1)).alias("model_id")).select("model_id", "word", F.slice("vector", F.col("model_id") * dim_sub + 1, F.lit(dim_sub)).alias("vector"))


def intact(models: DataFrame, dim: int) -> DataFrame:
    """Per model: words, words with a bad number, words of another length."""
    bad = F.exists("vector", lambda x: x.isNull())
    return models.groupBy("model_id").agg(F.count("*").alias("n_words"), F.sum(bad.cast("long")).alias("n_bad"), F.sum((F.size("vector") != dim).cast("long")).alias("n_wrong_length"))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select(F.concat_ws(", ", "word", F.array_join(F.transform("vector", lambda x: x.cast("string")), ", "))).write.mode(mode).text(path)


def write_word2vec_text(df: DataFrame, path: str, mode: str = "error") -> None:
    """Part files of `word v1 v2` with 15 decimals; the folder's header line is in a part of its own."""
    d = df.select(F.size("vector")).first()
    head = df.sparkSession.createDataFrame([(f"{df.count()} {d[0] if d else 0}",)], "value string")
    body = df.select(F.concat_ws(" ", "word", F.array_join(F.transform("vector", lambda x: F.format_string("%.15f", x)), " ")).alias("value"))
    head.coalesce(1).write.mode(mode).text(path)
    body.write.mode("append").text(path)


def write_word2vec_binary(df: DataFrame, path: str) -> None:
    """One local file, row by row; rows are not gathered in memory."""
    n, d = df.count(), df.select(F.size("vector")).first()
    with open(path, "wb") as f:
        f.write(f"{n} {d[0] if d else 0}\n".encode())
        for word, vector in df.select("word", "vector").toLocalIterator():
            f.write(word.encode() + b" " + struct.pack(f"<{len(vector)}f", *vector))


def write_parts(df: DataFrame, path: str, by: str = "model_id", mode: str = "error") -> None:
    """A folder for each sub-model or sub-corpus."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_bundles(parts: DataFrame, path: str, mode: str = "error") -> None:
    """(part_id, line) as text, a folder for each part."""
    parts.select("part_id", "line").write.mode(mode).partitionBy("part_id").text(path)


def write_results(rows: DataFrame, path: str) -> None:
    """(run, benchmark, value) as one CSV row a run, appended."""
    rows.groupBy("run").pivot("benchmark").agg(F.first("value")).write.mode("append").option("header", True).csv(path)
