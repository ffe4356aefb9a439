"""Vectors for words that a model has not seen, from a model that has."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_vector, subtract, total
from ..storage import materialize
from .linalg import canonical, cross, gram, least_squares, procrustes, project
from .vocabulary import common, fill_zero, only_in


def _map(source: DataFrame, target: DataFrame, method: str) -> np.ndarray:
    both = common(source, target)
    if method == "procrustes":
        return procrustes(cross(both, "source", "target")[0])
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; there are {', '.join(METHODS)}")
    first = source.select(F.size("vector")).first()
    d = first[0] if first else 0
    g = gram(both.select(F.concat("source", "target").alias("vector")))  # all three products in one pass
    ss, st, tt = g[:d, :d], g[:d, d:], g[d:, d:]
    return least_squares(ss, st) if method == "global" else canonical(ss, tt, st)


METHODS = ("global", "procrustes", "cca", "zero")


def interpolate(source: DataFrame, target: DataFrame, method: str = "global") -> DataFrame:
    """target plus predicted vectors for the words that only source has."""
    if method == "zero":
        return fill_zero(source, target)
    missing = project(only_in(source, target), _map(source, target, method))
    return target.select("word", "vector").unionByName(missing.select("word", "vector"))


def regress(source: DataFrame, target: DataFrame, method: str = "global") -> tuple[DataFrame, float]:
    """Predictions for all source words, and the Frobenius error on the common ones."""
    predicted = project(source, _map(source, target, method)).select("word", "vector")
    return predicted, frobenius(predicted, target)


def frobenius(a: DataFrame, b: DataFrame) -> float:
    d = common(a, b).select(total(F.transform(subtract("source", "target"), lambda x: x * x)).alias("e"))
    return float(np.sqrt(d.agg(F.coalesce(F.sum("e"), F.lit(0.0))).first()[0]))


def consensus(models: list[DataFrame], steps: int = 20, enough: float = 0.23, least_change: float = 1e-15, keep=materialize) -> tuple[DataFrame, list[float]]:
    """Generalised Procrustes over the union vocabulary: rotate each model onto the mean, average by membership, normalise columns.

    Stops at an error of `enough` or less, or when it stops changing. Only d x d sums reach
    the driver; keep(df) cuts lineage after each step, by a written table if not told otherwise.
    """
    mean, errors = models[0], []
    for _ in range(steps):
        turned = [project(m, _map(m, mean, "procrustes")).select("word", "vector") for m in models]
        rows = turned[0]
        for t in turned[1:]:
            rows = rows.unionByName(t)
        new = mean_vector(rows, by=("word",))
        g = np.sqrt(np.maximum(np.diag(gram(new)), 1e-300))
        new = keep(project(new, np.diag(1 / g)))
        n = max(new.count(), 1)
        errors.append(frobenius(mean, new) / np.sqrt(n))
        mean = new
        if errors[-1] <= enough and len(errors) > 1 or len(errors) > 1 and abs(errors[-1] - errors[-2]) < least_change:
            break
    return mean, errors
