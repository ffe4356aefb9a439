"""Corpus scans: line sentences, documents, dumps, folders, and vocabulary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Ranges of ids, about equally full, that are numbered apart.
RANGES = 200


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of docs(doc_id, text), one row a line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(line_id, doc_id, pos, line): lines numbered from 0 by (doc_id, pos), without a global sort.

    Only ids, text hashes and line counts are ranged and numbered: quantiles of the ids cut
    them into RANGES, whose line counts are summed up (RANGES rows). The texts meet their
    first number by a join. Null ids come last; rows of one id go by the text's hash; a null
    text has no lines.
    """
    name = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("key")
    rows = docs.where(F.col("text").isNotNull())
    counts = rows.select("doc_id", name, (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n"))
    starts = counts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [i / RANGES for i in range(1, RANGES)], 0.002)))
    at = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0))
    starts = starts.withColumn("range", at.cast("int"))
    ranges = starts.groupBy("range").agg(F.sum(F.col("n") * F.col("copies")).alias("all"))
    lead = ranges.select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lead"))  # RANGES rows
    within = Window.partitionBy("range").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.join(F.broadcast(lead), "range").withColumn("start", F.col("lead") + F.coalesce(F.sum(F.col("n") * F.col("copies")).over(within), F.lit(0)))
    texts = rows.select("doc_id", "text", name)
    if not starts.where("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["key"])
    whole = texts.join(starts.select("key", "start", "n", "copies"), "key").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return whole.select("doc_id", (F.col("start") + F.col("copy") * F.col("n")).alias("start"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select((F.col("start") + F.col("pos")).alias("line_id"), "doc_id", "pos", "line")


def line_sentences(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """(line, tokens) of a text file or folder; .gz and .bz2 by extension."""
    return spark.read.text(path).select(F.col("value").alias("line"), tokens("value", lower).alias("tokens"))


def wiki_dump(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """(title, text) of the articles of an XML dump (.bz2 too), markup dropped, one line each."""
    pages = spark.read.format("xml").option("rowTag", row_tag).schema("title string, revision struct<text string>").load(path)
    body = F.col("revision.text")
    for pattern, to in ((r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), (r"(?s)\{\{[^{}]*\}\}", " "), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"[^\p{L}\p{N}']+", " ")):
        body = F.regexp_replace(body, pattern, to)
    return pages.select("title", F.lower(F.trim(body)).alias("text")).where("text != ''")


def folder(spark: SparkSession, path: str, extension: str, num_docs: int | None = None) -> DataFrame:
    """(path, text) of the files below a folder with an extension; the first num_docs by path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.orderBy("path").limit(num_docs) if num_docs is not None else files


def file_sentences(docs: DataFrame, stop: list[str], dictionary: DataFrame | None = None) -> DataFrame:
    """(doc_id, sentence, words): lower-cased sentences of docs(doc_id, text) without stop words, of dictionary(word) only."""
    from ..functions.text import sentences

    rows = docs.select("doc_id", F.posexplode(sentences("text", stop)).alias("sentence", "words"))
    if dictionary is None:
        return rows
    words = rows.select("doc_id", "sentence", F.posexplode("words").alias("pos", "word")).join(dictionary.select("word").distinct(), "word", "left_semi")
    return words.groupBy("doc_id", "sentence").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))


def csv_corpus(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    """Sentences of a (gzip) CSV file's text column: tags dropped, split on full stops."""
    from ..functions.text import strip_tags

    rows = spark.read.option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.explode(F.split(strip_tags(rows.columns[column]), "[.]")).alias("line")).where(F.trim("line") != "").select("line", tokens("line", True).alias("tokens"))


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """(word, count or null) of `word` or `word count` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("word"), F.get(parts, F.lit(1)).try_cast("long").alias("count"))


def word_set(spark: SparkSession, path: str) -> DataFrame:
    return vocabulary_file(spark, path).select("word").distinct()
