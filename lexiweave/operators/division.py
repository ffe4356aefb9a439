"""Dividing a corpus into parts, and reproducible samples. Random choice is by md5 of seed, part and line."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(seed: int, line: str = "line_id", part: str | Column | None = None) -> Column:
    parts = [F.lit(str(seed))] + ([F.col(part) if isinstance(part, str) else part] if part is not None else []) + [F.col(line)]
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def modulo(lines: DataFrame, parts: int) -> DataFrame:
    return lines.withColumn("part_id", F.pmod("line_id", F.lit(parts)).cast("int"))


def block(lines: DataFrame, parts: int, total: int) -> DataFrame:
    """Contiguous blocks of lines; `total` is the number of lines."""
    return lines.withColumn("part_id", F.floor(F.col("line_id") * parts / F.lit(total)).cast("int"))


def sampling(lines: DataFrame, parts: int, size: int, seed: int = 0) -> DataFrame:
    """`size` distinct lines for each part, the parts independent of each other.

    Each task keeps its `size` smallest keys a part before the shuffle (a window group
    limit); rows that cannot win are never sent.
    """
    rows = lines.withColumn("part_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("key", key(seed, "line_id", "part_id"))
    w = Window.partitionBy("part_id").orderBy("key", "line_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).drop("rank", "key")


def reservoir(lines: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """A uniform sample without replacement of `size` lines; a top-k in each task, then one merge."""
    return lines.withColumn("key", key(seed)).orderBy("key", "line_id").limit(size).drop("key")


def buckets(lines: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """A random bucket 1 to n for each line."""
    return lines.withColumn("bucket", (1 + F.pmod(F.xxhash64(F.lit(seed), "line_id"), F.lit(n))).cast("int"))


STRATEGIES = {"modulo": modulo, "block": block, "sampling": sampling}


def divide(lines: DataFrame, strategy: str, parts: int, **kwargs) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](lines, parts, **kwargs)


def subsets(ids: DataFrame, sizes: range, repeats: int, seed: int = 0) -> DataFrame:
    """(size, repeat, model_id): random subsets of ids(model_id)."""
    spark = ids.sparkSession
    grid = spark.range(repeats).select(F.col("id").alias("repeat"), F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    rows = ids.select("model_id", F.lit(1).alias("j")).join(F.broadcast(grid.withColumn("j", F.lit(1))), "j").drop("j")
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in ("size", "repeat", "model_id"))).cast("binary")))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("size", "repeat").orderBy("key", "model_id"))).where("r <= size").select("size", "repeat", "model_id")


def selections(n: int, k: int) -> list[tuple[int, ...]]:
    """All k of n in lexicographic order."""
    return list(combinations(range(n), k))
