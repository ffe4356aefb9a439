"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(v: str | Column) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(v: str | Column, order: float = 2) -> Column:
    c = _col(v)
    sizes = F.transform(c, F.abs)
    if order == 1:
        return total(sizes)
    if order == 2:
        return F.sqrt(total(F.transform(c, lambda x: x * x)))
    return F.array_max(sizes) if order == float("inf") else F.array_min(sizes)


def scale(v: str | Column, by) -> Column:
    return F.transform(_col(v), lambda x: x * by)


def normalize(v: str | Column, order: float = 2) -> Column:
    """A zero vector stays as it is."""
    n = norm(v, order)
    return F.when(n > 0, F.transform(_col(v), lambda x: x / n)).otherwise(_col(v))


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def subtract(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def multiply(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x * y)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return norm(subtract(a, b))


def mean_vector(df: DataFrame, vector: str = "vector", by: tuple[str, ...] = ()) -> DataFrame:
    """The mean of each position: partial sums before the shuffle, d rows a group after it."""
    parts = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select(*by, F.transform("p", lambda s: s["x"]).alias(vector))


def sum_vector(df: DataFrame, by: tuple[str, ...], vector: str = "vector") -> DataFrame:
    parts = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.sum("x").alias("x"))
    return parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select(*by, F.transform("p", lambda s: s["x"]).alias(vector))
