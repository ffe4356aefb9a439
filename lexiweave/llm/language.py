"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of a language's (or document's) most frequent character n-grams,
most frequent first. A document's distance to a language is the sum over its n-grams of
how far each is out of place there, with the largest distance for absent ones.

Texts are lower-cased; every run of other characters than letters is one space, and
n-grams of 1 to 3 characters do not span words (a space marks a word's start and end).
Ties in a profile rank by the n-gram's code, so results do not depend on row order.
Null texts and texts without a letter give `und` and score 0. Rows whose lang is null
teach nothing; with nothing to learn from, every prediction is `und`. Repeated rows
count as often as they occur. Languages at one distance go by name. A text of any length is
one value of its column and is profiled whole. Other columns are not read, and one named as
an output gives way to it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, beside, carried, text_slices, with_kept

#: Length of the languages' and the documents' profiles.
PROFILE, DOC_PROFILE = 600, 400


@functools.cache
def _folded() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is not a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> np.ndarray:
    """Codes of the text's n-grams, each as often as it occurs; 21 bits a character."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate(([32], _folded()[x], [32])).astype(np.int64)
    gap = x == 32
    x = x[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    gap = x == 32
    one = x[~gap]
    two = x[:-1] << 21 | x[1:]
    three = x[:-2] << 42 | x[1:-1] << 21 | x[2:]
    return np.concatenate((one, two, three[~gap[1:-1]]))


def _top(codes: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, by falling count and then by code."""
    u, c = np.unique(codes, return_counts=True)
    if len(u) > 4 * k:
        floor = np.partition(c, len(c) - k)[len(c) - k]
        u, c = u[c >= floor], c[c >= floor]
    return u[np.lexsort((u, -c))[:k]]


def profiles(train: DataFrame, k: int = PROFILE) -> dict[str, np.ndarray]:
    """lang -> its n-gram codes by rank, from all rows of train(text, lang). k n-grams a language reach the driver."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batch):
        text, lang = batch.column(0), batch.column(1).to_pylist()
        for a, b, _, _ in text_slices(text, 1 << 20):
            rows = text.slice(a, b - a).to_pylist()
            by: dict[str, list] = {}
            for t, name in zip(rows, lang[a:b], strict=True):
                if t and name is not None:
                    by.setdefault(name, []).append(t)
            for name, ts in by.items():
                u, c = np.unique(grams(" ".join(ts)), return_counts=True)
                yield {"lang": pa.array([name] * len(u), pa.string()), "gram": u, "n": c}

    counted = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(batches(count, schema), "lang string, gram long, n long")
    ranked = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    top = ranked.where(F.col("r") <= k).select("lang", "r", "gram").toArrow()
    out: dict[str, list] = {}
    for lang, _, gram in sorted(zip(*(top[c].to_pylist() for c in ("lang", "r", "gram")), strict=True)):
        out.setdefault(lang, []).append(gram)
    return {name: np.array(v, np.int64) for name, v in out.items()}


def classifier(model: dict[str, np.ndarray], k: int = PROFILE, doc_k: int = DOC_PROFILE):
    """text -> (language, score 0 to 1) by the least out-of-place distance."""
    names = sorted(model)
    codes = np.unique(np.concatenate([model[n] for n in names])) if names else np.zeros(0, np.int64)
    rank = np.full((len(codes) + 1, len(names)), k, np.int32)
    for j, n in enumerate(names):
        rank[np.searchsorted(codes, model[n]), j] = np.arange(len(model[n]))

    def predict(text: str | None) -> tuple[str, float]:
        own = grams(text) if text else np.zeros(0, np.int64)
        if not len(own) or not names:
            return "und", 0.0
        own = _top(own, doc_k)
        at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
        at[codes[at] != own] = len(codes)
        r = rank[at]
        d = np.where(r < k, np.abs(r - np.arange(len(own), dtype=np.int32)[:, None]), k).sum(0, dtype=np.int64) / (k * len(own))
        best = int(np.argmin(d))
        # a softmax of the mean distances: near 1 where the runner-up is far, 1/languages where all tie
        w = np.exp((d[best] - d) * 25.0)
        return names[best], float(w[best] / w.sum())

    return predict


def predicted(docs: DataFrame, model: dict[str, np.ndarray], keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs(text) -> kept (its columns, or those named, as a struct), lang_pred and score."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        predict = classifier(bc.value)
        for batch in it:
            found = [predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["kept", "lang_pred", "score"])

    rows = carried(docs, keep)
    return rows.mapInArrow(run, with_kept(rows, "lang_pred string, score double"))


def identify(docs: DataFrame, model: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, and the columns `keep`) with lang_pred and score."""
    return beside(predicted(docs, model, keep), keep, "lang_pred", "score")


def learn_and_identify(docs: DataFrame, train_where: Column) -> DataFrame:
    """Every row of docs(doc_id, text, lang) predicted from the rows that train_where picks."""
    model = profiles(docs.where(train_where).select("text", "lang"))
    return identify(docs, model)
