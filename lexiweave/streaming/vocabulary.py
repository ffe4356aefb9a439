"""Word counts over a stream of text files (an extension: the batch operators have no streaming counterpart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens


def stream_word_count(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(word, n), updated as files arrive; write it with output mode `complete` or `update`."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.select(F.explode(tokens("value", True)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
