"""Toxicity by maximum-scoring segments over token log-odds.

A token's log-odds compare how often it occurs in documents labelled toxic, beyond what
the clean ones explain, with the clean ones. Counts are of documents; the odds have a
hierarchical Dirichlet prior: a word's prior mean is the odds of its 5-character prefix,
whose prior mean is that of 4 characters, then 3, then a constant below one. So most
tokens score below zero, as segment statistics need.

One linear scan finds all maximal scoring segments of a text. Scores of random segments
follow an extreme-value law: the expected number of segments with a score of S or more
among n tokens is K n exp(-lambda S). lambda solves the moment equation of the clean
tokens' scores, K is fitted to the clean documents' best segments. Segments expected less
than ALPHA times are toxic passages. The document's evidence is the sum of their
lambda S - ln(K n); a logistic curve fitted to the labels turns it into a score. For the fit,
segment scores are gathered per document on a grid of STEP, by number and sum.

Labels are learned from at most SAMPLE labelled rows (chosen by hash); exact copies among
them count once; a document's own counts are taken out when the curve is fitted. Null and
empty texts have no passage and get the score of no evidence. Without labels of both
kinds every score is 0. Repeated rows are scored each; ties between segments cannot
occur, as maximal segments are disjoint; tied labels of one id count as the larger. A text
of any length is one value of its column; the scan takes time in proportion to it. Other
columns are not read, and one named as an output gives way to it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, beside, bounded_labels, carried, with_kept

SAMPLE = 60_000
LEVELS = (3, 4, 5)
#: Mass of each Dirichlet prior, and the root's mean odds.
MASS, ROOT = 4.0, 0.15
FLOOR = -3.0
ALPHA = 0.01
#: Tokens whose log-odds a worker remembers before it starts anew, and their longest length.
MEMO, MEMO_CHARS = 500_000, 64
#: The fit gathers a document's segment scores on a grid of this step; the last step takes the rest.
STEP, STEPS = 1 / 16, 4096


def word(token: str) -> str:
    """A token without the marks around it."""
    return token.strip(".,;:!?\"'()[]{}<>*#$%&|-_=+/\\~^@`«»“”‘’…")


def units(w: str) -> list[str]:
    """A word's units, from the shortest prefix to the word; prefixes end with a star."""
    return [w[:k] + "*" for k in LEVELS if len(w) > k] + [w]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in time linear in the tokens.

    Each open segment keeps a link to the last earlier one with a lower sum to its left, so a
    search follows links instead of reading all open segments; where there is none, the open
    ones are final.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    done: list[tuple[int, int, float]] = []
    start, end, left, right, link = [], [], [], [], []  # of the open segments
    for i, before, after in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        a, b = i, i + 1
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= before:
                j = link[j]
            if j < 0:
                done += zip(start, end, map(float.__sub__, right, left), strict=True)
                start, end, left, right, link = [a], [b], [before], [after], [-1]
                break
            if right[j] >= after:
                start.append(a), end.append(b), left.append(before), right.append(after), link.append(j)
                break
            a, before = start[j], left[j]
            del start[j:], end[j:], left[j:], right[j:], link[j:]
    return done + list(zip(start, end, map(float.__sub__, right, left), strict=True))


class Odds:
    """Log-odds of tokens from unit counts (documents toxic, clean)."""

    def __init__(self, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> None:
        self.counts, self.n_toxic, self.n_clean = counts, n_toxic, n_clean
        self.memo: dict[str, float] = {}

    def of(self, token: str, less: tuple[int, int] = (0, 0)) -> float:
        """`less`: the counts of the document itself, to take out."""
        w = word(token)
        odds = ROOT
        scale = max(self.n_toxic - less[0], 1) / max(self.n_clean - less[1], 1)
        for u in units(w) if w else ():
            t, c = self.counts.get(u, (0, 0))
            t, c = max(t - less[0], 0), max(c - less[1], 0)
            usual = c * scale
            odds = (max(t - usual, 0.0) + MASS * odds) / (usual + MASS)
        return max(math.log(odds), FLOOR) if odds > 0 else FLOOR

    def scores(self, tokens: list[str], less: tuple[int, int] = (0, 0)) -> np.ndarray:
        if less != (0, 0):
            own = {t: self.of(t, less) for t in set(tokens)}
            return np.array([own[t] for t in tokens])
        memo = self.memo
        found = list(map(memo.get, tokens))
        if None in found:
            if len(memo) > MEMO:
                memo.clear()
            for i, x in enumerate(found):
                if x is None:
                    t = tokens[i]
                    found[i] = memo[t] if t in memo else self.of(t)
                    if len(t) <= MEMO_CHARS:
                        memo[t] = found[i]
        return np.array(found)


class Model:
    def __init__(self, odds: Odds, lam: float, k: float, curve: tuple[float, float]) -> None:
        self.odds, self.lam, self.k, self.curve = odds, lam, k, curve

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant segments (start, end, score, evidence), tokens counted from 0."""
        if not len(scores):
            return []
        base = math.log(self.k * len(scores))
        return [(a, b, s, self.lam * s - base) for a, b, s in maximal_segments(scores) if self.lam * s - base > -math.log(ALPHA)]

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-min(max(a + b * math.log1p(evidence), -30), 30)))


def _texts_of(docs: DataFrame, labels: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of the labelled sample, exact copies once (the smallest id)."""
    spark = docs.sparkSession
    known = spark.createDataFrame(pa.table({"doc_id": pa.array(list(labels), pa.int64()), "label": pa.array(list(labels.values()), pa.int32())}))  # at most SAMPLE rows
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").where(F.length("text") > 0)
    first = rows.groupBy(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").toArrow()["doc_id"].to_pylist()
    kept = spark.createDataFrame(pa.table({"doc_id": pa.array(first, pa.int64()), "label": pa.array([labels[i] for i in first], pa.int32())}))
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(kept), "doc_id").where(F.length("text") > 0)


def fit(docs: DataFrame, labels: DataFrame, train_where: Column, sample: int = SAMPLE) -> Model:
    """Learn from docs(doc_id, text) and labels(doc_id, toxic) where train_where (on doc_id) holds."""
    sc = docs.sparkSession.sparkContext
    known = bounded_labels(labels, "toxic", train_where, sample, "toxic")
    if len({bool(x) for x in known.values()}) < 2:
        return Model(Odds({}, 0, 0), 1.0, 1.0, (-30.0, 0.0))
    rows = _texts_of(docs, known)
    schema = pa.schema([("unit", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(it):
        by = (Counter(), Counter())
        docs_seen = [0, 0]

        def out():
            keys = [*(by[1].keys() | by[0].keys())]
            yield pa.RecordBatch.from_arrays([pa.array(["", *keys], pa.string()), pa.array([docs_seen[1], *(by[1][k] for k in keys)], pa.int64()), pa.array([docs_seen[0], *(by[0][k] for k in keys)], pa.int64())], schema=schema)

        for batch in it:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen = set()
                for w in {word(t) for t in text.lower().split()}:
                    if w:
                        seen.update(units(w))
                by[bool(label)].update(seen)
                docs_seen[bool(label)] += 1
            if len(by[0]) + len(by[1]) > 1_500_000:
                yield from out()
                by[0].clear(), by[1].clear()
                docs_seen[:] = [0, 0]
        yield from out()

    counted = rows.select("doc_id", "text", "label").mapInArrow(count, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    t = counted.toArrow()  # the units of at most `sample` texts
    counts = dict(zip(t["unit"].to_pylist(), zip(t["toxic"].to_pylist(), t["clean"].to_pylist(), strict=True), strict=True))
    n_toxic, n_clean = counts.pop("", (0, 0))
    bc = sc.broadcast((counts, n_toxic, n_clean))
    held = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("many", pa.list_(pa.int32())), ("total", pa.list_(pa.float64())), ("bins", pa.list_(pa.int64()))])
    edges = np.linspace(FLOOR, 9.0, 241)

    def measure(it):
        odds = Odds(*bc.value)

        def each(batch):
            cols: list[list] = [[], [], [], [], [], []]
            bins = np.zeros(len(edges) - 1, np.int64)  # of the whole batch, sent with its first row
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = odds.scores(text.lower().split(), (1, 0) if label else (0, 1))
                found = np.array([x for _, _, x in maximal_segments(s)])
                if not label:
                    bins += np.histogram(np.clip(s, edges[0], edges[-1]), edges)[0]
                _, place, many = np.unique(np.minimum(found / STEP, STEPS).astype(np.int64), return_inverse=True, return_counts=True)
                for c, v in zip(cols, (label, len(s), found.max() if len(found) else 0.0, many, np.bincount(place, found, len(many)), []), strict=True):
                    c.append(v)
            if cols[5]:
                cols[5][0] = bins.tolist()
            return dict(zip(held.names, cols, strict=True))

        yield from batches(each, held)(it)

    m = rows.select("doc_id", "text", "label").mapInArrow(measure, "label int, n long, best double, many array<int>, total array<double>, bins array<long>")
    bins = np.zeros(len(edges) - 1)
    docs_n, docs_best, docs_tops, docs_label = [], [], [], []
    for part in m.toArrow().to_batches(max_chunksize=2000):  # at most SAMPLE rows, of at most STEPS scores
        docs_label.append(part.column(0).to_numpy())
        docs_n.append(part.column(1).to_numpy().astype(float))
        docs_best.append(part.column(2).to_numpy())
        docs_tops.append((part.column(3).value_lengths().to_numpy(), part.column(3).flatten().to_numpy(), part.column(4).flatten().to_numpy()))
        values = part.column(5).flatten().to_numpy()
        bins += values.reshape(-1, len(edges) - 1).sum(0)
    label, n, best = np.concatenate(docs_label), np.concatenate(docs_n), np.concatenate(docs_best)
    lam = karlin_lambda((edges[:-1] + edges[1:]) / 2, bins)
    clean = (label == 0) & (n > 0)
    # the best segment of n random tokens has mean (ln(K n) + Euler's constant) / lambda
    k = float(np.exp(np.clip(np.mean(lam * best[clean] - np.log(n[clean])) - 0.5772156649, -12, 0))) if clean.any() else 0.1
    model = Model(Odds(counts, n_toxic, n_clean), lam, k, (0.0, 1.0))
    size, many, total = (np.concatenate(x) for x in zip(*docs_tops, strict=True))
    owner = np.repeat(np.arange(len(n)), size)
    base = np.log(k * np.maximum(n, 1))[owner]
    enough = lam * total / many - base > -math.log(ALPHA)  # all of a step count as its mean does
    x = np.log1p(np.bincount(owner[enough], (lam * total - many * base)[enough], len(n)))
    model.curve = logistic(x, label.astype(float))
    return model


def karlin_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1; scores must have a negative mean."""
    p = weights / max(weights.sum(), 1)
    if not p.sum() or (p * values).sum() >= 0 or not (p[values > 0] > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda lam: (p * np.exp(lam * values)).sum() - 1
    while f(high) < 0 and high < 20:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's fit of y ~ a + b x with a light ridge, so that separable labels have a finite curve."""
    w = np.zeros(2)
    m = np.stack((np.ones_like(x), x), 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        g = m.T @ (y - p) - ridge * w
        h = (m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def judged(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs(text) -> kept (its columns, or those named, as a struct), score, predicted, and the passages as token ranges."""
    bc = docs.sparkSession.sparkContext.broadcast((model.odds.counts, model.odds.n_toxic, model.odds.n_clean, model.lam, model.k, model.curve))
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(it):
        counts, a, b, *rest = bc.value
        own = Model(Odds(counts, a, b), *rest)
        for batch in it:
            out, spans = [], []
            for text in batch.column(1).to_pylist():
                found = own.passages(own.odds.scores((text or "").lower().split())) if counts else []
                out.append(own.probability(sum(e for *_, e in found)) if counts else 0.0)
                spans.append([{"start": i, "end": j, "score": s} for i, j, s, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32()), pa.array(spans, kinds)], ["kept", "score", "predicted", "passages"])

    rows = carried(docs, keep)
    return rows.mapInArrow(run, with_kept(rows, "score double, predicted int, passages array<struct<start:long,end:long,score:double>>"))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, and the columns `keep`) with score, predicted, and the passages as token ranges."""
    return beside(judged(docs, model, keep), keep, "score", "predicted", "passages")
