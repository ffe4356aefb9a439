"""Merging sub-models into one embedding."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import add, normalize, sum_vector
from ..storage import materialize
from .linalg import cross, gram, low_rank_align, low_rank_maps, pca_basis, procrustes, project
from .vocabulary import common, concat, join_all


def vector_add(models: DataFrame, parts: int) -> DataFrame:
    """Sum of the vectors of the words that all models have."""
    known = models.groupBy("word").agg(F.count_distinct("model_id").alias("n")).where(F.col("n") == parts).select("word")
    return sum_vector(models.join(known, "word"), ("word",))


def pca(models: DataFrame, parts: int, threshold: float = 0.01, mean_corr: bool = True, compat_rows: bool = False) -> DataFrame:
    """Joined vectors projected on the directions whose root eigenvalue exceeds the threshold."""
    return reduce_dimensions(join_all(models, parts), threshold=threshold, mean_corr=mean_corr, compat_rows=compat_rows)


def reduce_dimensions(df: DataFrame, k: int | None = None, threshold: float | None = None, mean_corr: bool = True, compat_rows: bool = False) -> DataFrame:
    m, s, _, n = cross(df, "vector", "vector")
    if not n:
        return df
    mean = s / n if mean_corr else np.zeros(len(s))
    return project(df, pca_basis(m - n * np.outer(mean, mean), k, threshold, compat_rows), shift=mean)


def mds(df: DataFrame, k: int = 500, centre_covariance: bool = False, norm: bool = False) -> DataFrame:
    """The last k eigenvectors of X'X (centred or not) as the basis; vectors themselves are not centred."""
    if norm:
        df = df.withColumn("vector", normalize("vector"))
    c = gram(df, centred=centre_covariance)
    return project(df, pca_basis(c, min(k, len(c))))


def pca_bias(df: DataFrame, dim: int, bias: str = "ignore") -> DataFrame:
    """bias: `with` keeps the mean in, `ignore` drops it, `separate` adds its projection back."""
    m, s, _, n = cross(df, "vector", "vector")
    mean = s / n
    basis = pca_basis(m if bias == "with" else m - n * np.outer(mean, mean), dim)
    if bias == "separate":
        back = mean @ basis
        out = project(df, basis, shift=mean)
        return out.withColumn("vector", add("vector", F.array(*(F.lit(float(x)) for x in back))))
    return project(df, basis, shift=None if bias == "with" else mean)


def autoencode(df: DataFrame, dim: int, linear: bool = True, with_bias: bool = True, batch: int = 64, steps: int = 500, rate: float = 0.05, seed: int = 0, sample: int = 20_000) -> DataFrame:
    """Codes of a one-layer autoencoder, fitted by mini-batch gradients on at most `sample` rows (by hash), applied to all."""
    rows = df.orderBy(F.xxhash64("word")).limit(sample).select("vector").toPandas()
    x = np.stack(rows["vector"]).astype(float)
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], dim))
    b, c = np.zeros(dim), np.zeros(x.shape[1])
    act = (lambda z: z) if linear else np.tanh
    for _ in range(steps):
        t = x[rng.integers(0, len(x), batch)]
        h = act(t @ w + b)
        e = (h @ w.T + c - t) / batch
        back = e @ w * (1 if linear else 1 - h * h)
        w -= rate * (t.T @ back + e.T @ h)
        if with_bias:
            b -= rate * back.sum(0)
            c -= rate * e.sum(0)
    out = project(df, w)
    shifted = add("vector", F.array(*(F.lit(float(v)) for v in b)))
    return out.withColumn("vector", shifted if linear else F.transform(shifted, F.tanh))


def autoencoder_grid(df: DataFrame, dim: int, batches: list[int], steps: list[int]) -> list[tuple[int, int, float]]:
    """(batch, steps, reconstruction error per row by the codes' best linear decoder) of each cell."""
    out = []
    for b in batches:
        for s in steps:
            coded = autoencode(df, dim, batch=b, steps=s).withColumnRenamed("vector", "code").join(df, "word")
            cc, _, _, n = cross(coded, "code", "code")
            cx = cross(coded, "code", "vector")[0]
            xx = gram(df)
            out.append((b, s, float((np.trace(xx) - np.trace(cx.T @ np.linalg.pinv(cc) @ cx)) / max(n, 1))))
    return out


def linear_transform(x: DataFrame, y: DataFrame) -> DataFrame:
    """y rotated onto x, then added."""
    both = common(x, y)
    st = cross(both, "target", "source")[0]
    return project(both, procrustes(st), "target").select("word", add("source", "target").alias("vector"))


def procrustes_error(x: DataFrame, y: DataFrame) -> float:
    """trace(E'E) of x against the best rotation of y: from cross products alone."""
    both = common(x, y)
    st = cross(both, "target", "source")[0]
    return float(np.trace(gram(both, "source")) + np.trace(gram(both, "target")) - 2 * np.linalg.svd(st, compute_uv=False).sum())


def pca_pair(x: DataFrame, y: DataFrame) -> DataFrame:
    both = concat(x, y)
    d = both.select(F.size("vector")).first()
    return mds(both, d[0] // 2) if d else both


def add_pair(x: DataFrame, y: DataFrame) -> DataFrame:
    return common(x, y).select("word", add("source", "target").alias("vector"))


PAIRWISE = {"add": add_pair, "linear": linear_transform, "pca": pca_pair}


def fold(models: list[DataFrame], order: str = "sequential", strategy: str = "add", keep=materialize) -> DataFrame:
    """Merge pair by pair: sequential (left fold), binary (queue), or min_error (the closest pair first).

    keep(df) cuts lineage after each step, by a written table if not told otherwise. Errors
    of pairs are computed once.
    """
    merge = PAIRWISE[strategy]
    models, errors = list(models), {}

    def error(i: int, j: int) -> float:
        pair = id(models[i]), id(models[j])
        if pair not in errors:
            errors[pair] = procrustes_error(models[i], models[j])
        return errors[pair]

    kept = list(models)  # ids stay those of live tables
    while len(models) > 1:
        kept += models
        if order == "min_error":
            i, j = min(((i, j) for i in range(len(models)) for j in range(i + 1, len(models))), key=lambda p: error(*p))
            y, x = models.pop(j), models.pop(i)
            models.insert(0, keep(merge(x, y)))
        elif order == "binary":
            x, y, *models = models
            models.append(keep(merge(x, y)))
        else:
            x, y, *rest = models
            models = [keep(merge(x, y)), *rest]
    return models[0]


def _joined(models: list[DataFrame]) -> DataFrame:
    """(word, v0, v1, ..) of the common words."""
    joined = models[0].select("word", F.col("vector").alias("v0"))
    for i, m in enumerate(models[1:], 1):
        joined = joined.join(m.select("word", F.col("vector").alias(f"v{i}")), "word")
    return joined


def _matrices(models: list[DataFrame], limit: int) -> tuple[list[str], list[np.ndarray]]:
    """The common words and each model's rows on the driver; dense methods take a small vocabulary only."""
    rows = _joined(models).orderBy("word").limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} words in common; restrict the vocabulary first")
    return list(rows["word"]), [np.stack(rows[f"v{i}"]).astype(float) for i in range(len(models))]


def lra(models: list[DataFrame], dim: int, multiply: bool = False, limit: int = 2000) -> DataFrame:
    """Running merge by low-rank alignment: averages weighted by the models so far, or products.

    Each step is two maps of the joined vectors, found from their cross products, so any
    vocabulary will do. Where the vectors have fewer directions than dim + 1, which leaves the rest
    to chance, the dense form chooses them, for `limit` words at most.
    """
    rows = materialize(_joined(models)).withColumn("fx", F.col("v0"))
    for i in range(1, len(models)):
        size = rows.select(F.size("fx")).first()
        if not size:
            break
        both = rows.withColumn("both", F.concat("fx", f"v{i}"))
        maps = low_rank_maps(gram(both, "both"), size[0], dim)
        if maps is None:
            return _dense_lra(models, dim, multiply, limit)
        ab = project(both, np.hstack(maps), "both")
        a, b = F.slice("both", 1, dim), F.slice("both", dim + 1, dim)
        rows = ab.withColumn("fx", F.zip_with(a, b, (lambda x, y: x * y) if multiply else (lambda x, y: (x * i + y) / (i + 1)))).drop("both")
    return rows.select("word", F.col("fx").alias("vector"))


def _dense_lra(models: list[DataFrame], dim: int, multiply: bool, limit: int) -> DataFrame:
    words, xs = _matrices(models, limit)
    fx = xs[0]
    for i, y in enumerate(xs[1:]):
        a, b = low_rank_align(fx, y, np.eye(len(words)), dim)
        fx = a * b if multiply else (a * (i + 1) + b) / (i + 2)
    return models[0].sparkSession.createDataFrame(pd.DataFrame({"word": words, "vector": fx.tolist()}), "word string, vector array<double>")


def tsne(df: DataFrame, dim: int = 2, initial: int = 50, perplexity: float = 30.0, steps: int = 300, limit: int = 2000, seed: int = 0) -> DataFrame:
    """t-SNE of a small vocabulary: PCA, conditional probabilities by bisection, momentum descent."""
    words, (x,) = _matrices([df], limit)
    n = len(words)
    if n < 3:
        return df
    x = x - x.mean(0)
    x = x @ np.linalg.eigh(x.T @ x)[1][:, -min(initial, x.shape[1]) :]
    sq = (x * x).sum(1)
    dist = np.maximum(sq[:, None] + sq - 2 * x @ x.T, 0)
    p = np.zeros((n, n))
    target = np.log(min(perplexity, (n - 1) / 3))
    for i in range(n):
        row = np.delete(dist[i], i)
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            e = np.exp(-(row - row.min()) * beta)
            h = np.log(e.sum()) + beta * ((row - row.min()) * e).sum() / e.sum()
            if abs(h - target) < 1e-5:
                break
            low, high = (beta, high) if h > target else (low, beta)
            beta = beta * 2 if np.isinf(high) else (low + high) / 2
        p[i, np.arange(n) != i] = e / e.sum()
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y, v = np.random.default_rng(seed).normal(0, 1e-2, (n, dim)), np.zeros((n, dim))
    for step in range(steps):
        s = (y * y).sum(1)
        q = 1 / (1 + s[:, None] + s - 2 * y @ y.T)
        np.fill_diagonal(q, 0)
        g = ((4 if step < 100 else 1) * p - q / q.sum()) * q
        grad = 4 * (np.diag(g.sum(1)) - g) @ y
        v = (0.5 if step < 20 else 0.8) * v - min(200.0, n / 4) * grad
        y = y + v
        y -= y.mean(0)
    return df.sparkSession.createDataFrame(pd.DataFrame({"word": words, "vector": y.tolist()}), "word string, vector array<double>")


def refactor(models: list[DataFrame], counts: DataFrame, dim: int, steps: int = 300, rate: float = 0.1, tol: float = 0.1, limit: int = 1500, seed: int = 0) -> DataFrame:
    """One model fitted to all sub-models' targets: goal = -log(M^2 mean of exp(-w.c) weighted by counts), by adaptive gradients.

    Steps end when the largest error is below `tol`; a fit that does not get there warns with the error reached.
    """
    words, xs = _matrices(models, limit)
    n = {r["word"]: r["n"] for r in counts.where(F.col("word").isin(words)).collect()}
    logs = np.log(np.array([n.get(w, 1) for w in words], float))
    m = len(xs)
    inner = sum(np.exp(np.clip(-x @ x.T, -30, 30)) for x in xs)
    goal = -np.log(m * m * inner * np.exp(logs[:, None] + logs)) + logs[:, None] + logs
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 0.1, (len(words), dim)), rng.normal(0, 0.1, (len(words), dim))
    ga, gb = np.full_like(a, 1e-8), np.full_like(b, 1e-8)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    aim = sig(goal)
    for _ in range(steps):
        s = sig(a @ b.T)
        e = s - aim
        if np.abs(e).max() < tol:
            break
        d = e * s * (1 - s)
        da, db = d @ b, d.T @ a
        ga += da * da
        gb += db * db
        a -= rate * da / np.sqrt(ga)
        b -= rate * db / np.sqrt(gb)
    else:
        warnings.warn(f"not converged: the largest error is {np.abs(sig(a @ b.T) - aim).max():.3f}", stacklevel=2)
    return models[0].sparkSession.createDataFrame(pd.DataFrame({"word": words, "vector": a.tolist()}), "word string, vector array<double>")
