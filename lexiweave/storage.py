"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; below a temporary folder only where the master is local and the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/lexiweave-checkpoints"
    return f"{path}/lexiweave-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df and read it back: later plans start here, and lost executors cost nothing before it."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, slot: str, n: int) -> DataFrame:
    """df in n partitions, the rows of each slot (0 to n - 1) in one of their own: by numbers whose hashes are n apart."""
    at = {r["at"]: r["id"] for r in df.sparkSession.range(64 + 24 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()}  # n rows
    keys = F.lit([at.get(i, i) for i in range(n)]).cast("array<bigint>")
    return df.repartition(n, F.element_at(keys, F.col(slot).cast("int") + 1))
