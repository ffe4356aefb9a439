"""Benchmark datasets from local files, in their published layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import high_level, part_of_speech, standardize


def _pairs(spark: SparkSession, path: str, sep: str, header: bool, w1: int = 0, w2: int = 1, score: int = 2) -> DataFrame:
    rows = spark.read.option("sep", sep).option("header", header).csv(path)
    c = rows.columns
    return rows.select(F.col(f"`{c[w1]}`").alias("w1"), F.col(f"`{c[w2]}`").alias("w2"), F.col(f"`{c[score]}`").try_cast("double").alias("score"))


def mturk(spark, path):
    return _pairs(spark, path, ",", False).withColumn("score", F.col("score") * 2)


def men(spark, path):
    """Words lose their 2-character part-of-speech mark; scores are of 10."""
    cut = lambda c: F.regexp_replace(c, "-[a-z]$", "")
    return _pairs(spark, path, " ", False).select(cut("w1").alias("w1"), cut("w2").alias("w2"), (F.col("score") / 5).alias("score"))


def ws353(spark, path):
    """Mean score, and the deviation over the judges' columns where there are any."""
    rows = spark.read.option("header", True).csv(path)
    c = rows.columns
    judges = F.array(*(F.col(f"`{x}`").try_cast("double") for x in c[3:])) if len(c) > 3 else None
    out = [F.col(f"`{c[0]}`").alias("w1"), F.col(f"`{c[1]}`").alias("w2"), F.col(f"`{c[2]}`").try_cast("double").alias("score")]
    return rows.select(*out, (deviation(judges) if judges is not None else F.lit(None).cast("double")).alias("sd"))


def deviation(values):
    """Population deviation of an array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n)


def rg65(spark, path):
    return _pairs(spark, path, ";", False).withColumn("score", F.col("score") * 10 / 4)


def rare_words(spark, path):
    return _pairs(spark, path, "\t", False)


def simlex999(spark, path):
    """With the pairs' part of speech, concreteness, association and deviation, as published."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    c = rows.columns
    out = [F.col(f"`{c[0]}`").alias("w1"), F.col(f"`{c[1]}`").alias("w2"), F.col(f"`{c[3]}`").try_cast("double").alias("score"), F.col(f"`{c[2]}`").alias("pos")]
    names = {4: "concreteness1", 5: "concreteness2", 6: "concreteness_quartile", 7: "association", 8: "associated", 9: "sd"}
    return rows.select(*out, *(F.col(f"`{c[i]}`").try_cast("double").alias(n) for i, n in names.items() if i < len(c)))


#: The subsets of WS353 that are published as files of their own: fixed values.
WS353_SUBSETS = ("all", "relatedness", "similarity", "set1", "set2")


def ws353_subset(spark, folder: str, which: str = "all"):
    """One of WS353_SUBSETS, from `<which>.csv` in the folder; the two halves without judges are tab-separated."""
    if which not in WS353_SUBSETS:
        raise ValueError(f"no subset {which!r}; there are {', '.join(WS353_SUBSETS)}")
    path = f"{folder}/{which}.csv"
    return _pairs(spark, path, "\t", False).withColumn("sd", F.lit(None).cast("double")) if which in ("relatedness", "similarity") else ws353(spark, path)


def multilingual_simlex(spark, path):
    rows = spark.read.option("header", True).csv(path)
    c = rows.columns
    judges = F.array(*(F.col(f"`{x}`").try_cast("double") for x in c[2:]))
    return rows.select(F.col(f"`{c[0]}`").alias("w1"), F.col(f"`{c[1]}`").alias("w2"), (F.aggregate(judges, F.lit(0.0), lambda a, x: a + x) / F.size(judges)).alias("score"), deviation(judges).alias("sd"))


def fill_categories(lines: DataFrame) -> DataFrame:
    """lines(line_id, line) of `: category` headers and four-word questions, the header carried down."""
    header = F.when(F.col("line").startswith(":"), F.trim(F.substring("line", 2, 1000)))
    filled = lines.withColumn("category", F.last(header, ignorenulls=True).over(Window.orderBy("line_id")))
    w = F.split(F.lower(F.trim("line")), r"\s+")
    return filled.where(~F.col("line").startswith(":")).select(w[0].alias("a"), w[1].alias("b"), w[2].alias("c"), w[3].alias("answer"), "category", high_level("category").alias("category_high"))


def google_analogy(spark, path):
    """One file of a few MB; its lines keep their order by place in the file."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("line_id", "line")).where(F.trim("line") != "")
    return fill_categories(lines)


def msr_analogy(spark, path):
    """Four words with a pair of tags before the last; words are standardised."""
    w = F.split(F.trim("value"), r"\s+")
    words = [standardize(w[i]).alias(n) for i, n in ((0, "a"), (1, "b"), (2, "c"), (4, "answer"))]
    return spark.read.text(path).where(F.trim("value") != "").select(*words, w[3].alias("category"), part_of_speech(w[3]).alias("category_high"))


def semeval_2012_2(spark, golden, questions):
    """(category, left, right, score) of the judged pairs and (category, left, right) of the prototypes."""
    g = spark.read.text(golden).select(F.input_file_name().alias("f"), F.split(F.trim("value"), r'[\s":]+').alias("p")).where(~F.col("p")[0].startswith("#"))
    name = F.regexp_extract("f", r"-([0-9]+[a-z])[^/]*$", 1)
    scored = g.select(name.alias("category"), F.try_element_at("p", F.lit(2)).alias("left"), F.try_element_at("p", F.lit(3)).alias("right"), F.try_element_at("p", F.lit(1)).try_cast("double").alias("score"))
    q = spark.read.text(questions).select(F.input_file_name().alias("f"), F.split(F.trim("value"), ":").alias("p")).where(F.size("p") == 2)
    return scored, q.select(name.alias("category"), F.col("p")[0].alias("left"), F.col("p")[1].alias("right"))


def wordrep(spark, path):
    rows = spark.read.option("sep", "\t").csv(path).select(F.input_file_name().alias("f"), F.col("_c0").alias("left"), F.col("_c1").alias("right"))
    return rows.select("left", "right", F.regexp_extract("f", r"([^/]+?)(?:\.[^/.]*)?$", 1).alias("category"), F.regexp_extract("f", r"/([^/]+)/[^/]+$", 1).alias("category_high"))


def categorization(spark, path):
    """(word, cluster): a file for each cluster, named after it."""
    return spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "").select(F.trim("value").alias("word"), F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1).alias("cluster"))


DATASETS = {f.__name__: f for f in (mturk, men, ws353, rg65, rare_words, simlex999, multilingual_simlex, google_analogy, msr_analogy, wordrep, categorization)}
