"""Dense linear algebra: cross products are summed on executors, only d x d results are solved on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross(df: DataFrame, left: str, right: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(left' right, sum of left, sum of right, rows): each task sends one partial sum, merged in a tree by position."""

    def partial(it):
        total = None
        for pdf in it:
            if len(pdf):
                a, b = np.stack(pdf["a"]).astype(float), np.stack(pdf["b"]).astype(float)
                part = (a.T @ b, a.sum(0), b.sum(0), len(a))
                total = part if total is None else tuple(x + y for x, y in zip(total, part, strict=True))
        if total is not None:
            m, sa, sb, n = total
            yield pd.DataFrame({"row": range(len(m) + 3), "v": [*m, sa, sb, np.array([float(n)])]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "v": [np.stack(pdf["v"]).sum(0)]})

    # a task sends its d + 3 rows whole, and each row of the sum is one group
    rows = df.select(F.col(left).alias("a"), F.col(right).alias("b")).mapInPandas(partial, "row int, v array<double>")
    out = rows.groupBy("row").applyInPandas(added, "row int, v array<double>").orderBy("row").collect()  # d + 3 rows
    if not out:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0
    v = [np.array(r["v"]) for r in out]
    return np.stack(v[:-3]), v[-3], v[-2], int(v[-1][0])


def gram(df: DataFrame, vector: str = "vector", centred: bool = False) -> np.ndarray:
    m, s, _, n = cross(df, vector, vector)
    return m - np.outer(s, s) / n if centred and n else m


def project(df: DataFrame, basis: np.ndarray, vector: str = "vector", shift: np.ndarray | None = None, out: str | None = None) -> DataFrame:
    """Each vector times basis, less `shift` before; by Arrow batches, the basis (d x k) goes to each task."""
    bc = df.sparkSession.sparkContext.broadcast((basis, shift))

    @F.pandas_udf("array<double>")
    def times(col: pd.Series) -> pd.Series:
        if not len(col):
            return pd.Series([], dtype=object)
        b, s = bc.value
        x = np.stack(col).astype(float)
        return pd.Series(list((x - s if s is not None else x) @ b))

    return df.withColumn(out or vector, times(vector))


def procrustes(st: np.ndarray) -> np.ndarray:
    """The rotation R that brings S onto T best, from S'T."""
    u, _, v = np.linalg.svd(st)
    return u @ v


def least_squares(ss: np.ndarray, st: np.ndarray, ridge: float = 1e-13) -> np.ndarray:
    try:
        return np.linalg.solve(ss, st)
    except np.linalg.LinAlgError:
        return np.linalg.solve(ss + ridge * np.eye(len(ss)), st)


def canonical(ss: np.ndarray, tt: np.ndarray, st: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """The map A B^-1 by canonical correlation bases: whiten both sides, then rotate by the SVD."""

    def root(m: np.ndarray, power: float) -> np.ndarray:
        w, v = np.linalg.eigh(m)
        return (v * np.maximum(w, eps * w.max()) ** power) @ v.T

    u, _, v = np.linalg.svd(root(ss, -0.5) @ st @ root(tt, -0.5))
    return root(ss, -0.5) @ u @ v @ root(tt, 0.5)


def low_rank(x: np.ndarray) -> np.ndarray:
    """V (1 - s^-2) V' over the singular values above one."""
    _, s, v = np.linalg.svd(x, full_matrices=False)
    keep = s > 1
    return (v[keep].T * (1 - s[keep] ** -2.0)) @ v[keep]


#: Low-rank alignment is dense in the number of words: more are an error.
MOST_WORDS = 4000


def low_rank_align(x: np.ndarray, y: np.ndarray, correspondence: np.ndarray, d: int, mu: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Joint embedding of two models: the smallest non-trivial eigenvectors of (1 - mu) M + 2 mu L."""
    n, m = len(x), len(y)
    if n + m > 2 * MOST_WORDS:
        raise ValueError(f"low-rank alignment of {n} and {m} words; at most {MOST_WORDS} each")
    r = np.zeros((n + m, n + m))
    r[:n, :n], r[n:, n:] = low_rank(x.T), low_rank(y.T)
    k = np.eye(n + m) - r
    w = np.zeros((n + m, n + m))
    w[:n, n:], w[n:, :n] = correspondence, correspondence.T
    lap = np.diag(w.sum(0)) - w
    _, v = np.linalg.eigh((1 - mu) * (k @ k.T) + 2 * mu * lap)
    return v[:n, 1 : d + 1], v[n:, 1 : d + 1]


def low_rank_maps(g: np.ndarray, n: int, d: int, mu: float = 0.8) -> tuple[np.ndarray, np.ndarray] | None:
    """low_rank_align of x with y, row by row, as maps of their joined columns: from g = [x y]'[x y] alone, x having n of them.

    Outside the columns' span the matrix is that of two equal graphs, whose vectors tell
    nothing; within it is of the size of the columns. None where the span has too few directions.
    """
    w, e = np.linalg.eigh(g[:n, :n])
    u, f = np.linalg.eigh(g[n:, n:])
    m = np.zeros((len(g), (w > 1).sum() + (u > 1).sum()))
    first = int((w > 1).sum())
    m[:n, :first], m[n:, first:] = e[:, w > 1] / np.sqrt(w[w > 1]), f[:, u > 1] / np.sqrt(u[u > 1])
    share = 1 - 1 / np.concatenate([w[w > 1], u[u > 1]])
    values, vectors = np.linalg.eigh(m.T @ g @ m)
    keep = values > 1e-10
    basis = m @ vectors[:, keep] / np.sqrt(values[keep])
    b = basis.shape[1]
    c = basis.T @ g @ m
    k = np.eye(2 * b)
    k[:b, :b] -= (c[:, :first] * share[:first]) @ c[:, :first].T
    k[b:, b:] -= (c[:, first:] * share[first:]) @ c[:, first:].T
    lap = np.kron(np.array([[1.0, -1.0], [-1.0, 1.0]]), np.eye(b))
    values, v = np.linalg.eigh((1 - mu) * (k @ k.T) + 2 * mu * lap)
    if len(values) <= d or values[d] > (1 - mu) * (1 - 1e-9):
        return None
    v = v[:, 1 : d + 1]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(d)])
    return basis @ v[:b], basis @ v[b:]


def pca_basis(cov: np.ndarray, k: int | None = None, threshold: float | None = None, compat_rows: bool = False) -> np.ndarray:
    """Eigenvectors of the covariance as columns: the last k, or those whose root eigenvalue exceeds the threshold.

    compat_rows masks rows in place of columns, as published tables were made.
    """
    w, v = np.linalg.eigh(cov)
    if k is not None:
        return v[:, -k:]
    keep = np.sqrt(np.maximum(w, 0)) > threshold
    return v[keep].T if compat_rows else v[:, keep]
