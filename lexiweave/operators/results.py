"""Result tables: averages, summaries and pivots of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def mean_by(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))


def box(df: DataFrame, by: str, value: str) -> DataFrame:
    """Least, quartiles and greatest value of each group."""
    q = F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    names = ("low", "q1", "median", "q3", "high")
    return df.groupBy(by).agg(q.alias("q")).select(by, *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def wide(rows: DataFrame, run: str = "run") -> DataFrame:
    return rows.groupBy(run).pivot("benchmark").agg(F.first("value"))
