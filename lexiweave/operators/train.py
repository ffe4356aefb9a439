"""Skip-gram training with negative sampling, one model a part, in parallel."""

from __future__ import annotations

import os
import tempfile
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt, materialize
from .vocabulary import trimmed, word_count

#: Tokens whose pairs are held at a time.
CHUNK = 20_000


def sgns(sentences: list[list[str]], size: int = 50, window: int = 10, negative: int = 5, subsample: float = 1e-4, min_count: int = 5, epochs: int = 5, rate: float = 0.025, seed: int = 0, without: frozenset = frozenset(), cbow: bool = False) -> tuple[list[str], np.ndarray]:
    """Words and vectors: skip-gram or CBOW with negative sampling, by batches of pairs.

    Sentences are read CHUNK tokens at a time, in an order of its own each epoch, so no more
    pairs are held than those of a chunk. CBOW predicts a word from the mean of its context.
    """
    words, counts = np.unique([w for s in sentences for w in s if w not in without], return_counts=True)
    keep = counts >= min_count
    words, counts = list(words[keep]), counts[keep]
    ids = {w: i for i, w in enumerate(words)}
    coded = [np.array([ids[w] for w in s if w in ids], np.int64) for s in sentences]
    coded = [s for s in coded if len(s)]
    return words, _fit(counts, len(coded), coded.__getitem__, size, window, negative, subsample, epochs, rate, seed, cbow)


def _fit(counts: np.ndarray, n: int, sentence: Callable[[int], np.ndarray], size: int = 50, window: int = 10, negative: int = 5, subsample: float = 1e-4, epochs: int = 5, rate: float = 0.025, seed: int = 0, cbow: bool = False) -> np.ndarray:
    """Vectors of the words of `counts`, from n sentences of word numbers that are asked for one by one."""
    if len(counts) < 2:
        return np.zeros((len(counts), size))
    rng = np.random.default_rng(seed)
    share = counts / counts.sum()
    stay = np.minimum(1, np.sqrt(subsample / share) + subsample / share) if subsample else np.ones(len(counts))
    noise = np.cumsum(counts**0.75) / (counts**0.75).sum()
    a, b = (rng.random((len(counts), size)) - 0.5) / size, np.zeros((len(counts), size))
    for epoch in range(epochs):
        lr = rate * max(1 - epoch / epochs, 0.1)
        held: list[np.ndarray] = []
        size_held = 0
        for k in rng.permutation(n):
            s = sentence(k)
            held.append(s[rng.random(len(s)) < stay[s]])
            size_held += len(held[-1])
            if size_held >= CHUNK:
                _learn(a, b, held, window, negative, noise, lr, rng, cbow)
                held, size_held = [], 0
        _learn(a, b, held, window, negative, noise, lr, rng, cbow)
    return a


def _learn(a, b, held: list[np.ndarray], window: int, negative: int, noise: np.ndarray, lr: float, rng, cbow: bool) -> None:
    """One pass over the pairs of some sentences; a: word vectors, b: output vectors, changed in place."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -12, 12)))
    flat = np.concatenate(held) if held else np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(held)), [len(s) for s in held])
    reach = rng.integers(1, window + 1, len(flat))  # a random window, as weights by distance
    centre, context = [], []
    for k in range(1, min(window, len(flat) - 1) + 1):
        same = line[:-k] == line[k:]
        left, right = np.flatnonzero(same & (reach[:-k] >= k)), np.flatnonzero(same & (reach[k:] >= k))
        centre += [left, right + k]
        context += [left + k, right]
    if not centre:
        return
    x, y = np.concatenate(centre), np.concatenate(context)  # places in flat
    if cbow:
        o = np.argsort(x, kind="stable")
        x, y = x[o], y[o]
        places, first = np.unique(x, return_index=True)
        ends = np.append(first[1:], len(x))
        order = rng.permutation(len(places))
    else:
        order = rng.permutation(len(x))
    add = lambda m, rows, by: np.add.at(m.reshape(-1), (rows.reshape(-1, 1) * m.shape[1] + np.arange(m.shape[1])).ravel(), by.ravel())  # noqa: E731  # in the order of np.add.at(m, rows, by), by a faster path
    for i in range(0, len(order), 512):
        use = order[i : i + 512]
        if cbow:  # rows of contexts, and the centre each row belongs to
            many = ends[use] - first[use]
            rows = np.repeat(first[use] - np.cumsum(many) + many, many) + np.arange(many.sum())
            owner, words, target = np.repeat(np.arange(len(use)), many), flat[y[rows]], flat[places[use]]
            va = np.zeros((len(use), a.shape[1]))
            np.add.at(va, owner, a[words])
            va /= many[:, None]
        else:
            words, target = flat[x[use]], flat[y[use]]
            va = a[words]
        n = np.searchsorted(noise, rng.random((len(use), negative)))
        vt, vn = b[target], b[n]
        gp = 1 - sig((va * vt).sum(1))
        gn = -sig(np.einsum("id,ikd->ik", va, vn))
        da = gp[:, None] * vt + np.einsum("ik,ikd->id", gn, vn)
        add(b, target, lr * gp[:, None] * va)
        add(b, n, lr * gn[:, :, None] * va[:, None])
        add(a, words, lr * (da[owner] if cbow else da))


class _Sentences:
    """A part's sentences as word numbers, in a temporary file that has no name and goes with the task; memory holds where each begins."""

    def __init__(self):
        self.file, self.ends = tempfile.TemporaryFile(), array("q", [0])

    def add(self, numbers: np.ndarray, lengths: np.ndarray) -> None:
        self.file.write(numbers.astype(np.int32).tobytes())
        self.file.flush()  # read() goes past the buffer
        self.ends.frombytes((self.ends[-1] + np.cumsum(lengths[lengths > 0])).astype(np.int64).tobytes())

    def read(self, k: int) -> np.ndarray:
        at, end = self.ends[k], self.ends[k + 1]
        return np.frombuffer(os.pread(self.file.fileno(), 4 * (end - at), 4 * at), np.int32)


def train_parts(parts: DataFrame, without: DataFrame | None = None, min_count: int = 5, **kwargs) -> DataFrame:
    """(model_id, word, vector) of parts(part_id, line_id, tokens): each part is one task's model.

    Words are counted by all tasks. A part's task gets its vocabulary first, then its lines in
    order, batch by batch: they are numbered and put on its disk, 4 bytes a word, so that memory
    holds the model, the vocabulary of min_count and 16 bytes a line. `without`: a vocabulary to leave out.
    """
    rows = materialize(parts.select(F.col("part_id").cast("int").alias("part_id"), F.col("line_id").cast("long").alias("line_id"), "tokens"))
    words = word_count(rows.select("part_id", F.explode("tokens").alias("word")), ("part_id",))
    words = materialize(trimmed(words, min_count, without))
    ids = sorted(r[0] for r in words.select("part_id").distinct().collect())  # a row a part
    known = F.array_position(F.lit(ids).cast("array<int>"), F.col("part_id")) - 1
    told = words.select("part_id", F.lit(None).cast("long").alias("line_id"), F.array("word").alias("tokens"), "n")
    rows = told.unionByName(rows.withColumn("n", F.lit(None).cast("long"))).withColumn("slot", known).where("slot >= 0")
    rows = dealt(rows, "slot", max(len(ids), 1)).sortWithinPartitions("part_id", F.col("line_id").asc_nulls_first()).select("part_id", "line_id", "tokens", "n")

    def fitted(part: int, counts: dict[str, int], vocabulary: pa.Array, lines: _Sentences):
        n = np.array([counts[w] for w in vocabulary.to_pylist()], np.int64)
        vectors = _fit(n, len(lines.ends) - 1, lines.read, seed=part, **kwargs)
        for i in range(0, len(vocabulary), 10_000):
            v = vectors[i : i + 10_000]
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), part, np.int32)), vocabulary[i : i + len(v)], v], ["model_id", "word", "vector"])

    def fit(batches):
        part, counts, vocabulary, lines = None, {}, None, None
        for batch in batches:
            parts = batch.column("part_id").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else []
            for begin, end in zip(cuts, cuts[1:]):
                if parts[begin] != part:
                    if part is not None:
                        yield from fitted(part, counts, vocabulary if vocabulary is not None else pa.array(sorted(counts), pa.string()), lines)
                    part, counts, vocabulary, lines = int(parts[begin]), {}, None, _Sentences()
                piece = batch.slice(begin, end - begin)
                head = piece.column("line_id").null_count  # the vocabulary comes first
                if head:
                    told = piece.slice(0, head)
                    counts.update(zip(told.column("tokens").flatten().to_pylist(), told.column("n").to_pylist(), strict=True))
                piece = piece.slice(head)
                if len(piece):
                    if vocabulary is None:
                        vocabulary = pa.array(sorted(counts), pa.string())
                    tokens = piece.column("tokens")
                    number = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                    line = np.repeat(np.arange(len(piece)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
                    lines.add(number[number >= 0], np.bincount(line[number >= 0], minlength=len(piece)))
        if part is not None:
            yield from fitted(part, counts, vocabulary if vocabulary is not None else pa.array(sorted(counts), pa.string()), lines)

    return rows.mapInArrow(fit, "model_id int, word string, vector array<double>")


def shared_vocabulary(parts: DataFrame, min_count: int) -> DataFrame:
    """parts with the tokens of one vocabulary only: the words with min_count in all parts together, so that sub-models share it."""
    at = parts.select("part_id", "line_id", F.posexplode("tokens").alias("pos", "word"))
    known = at.groupBy("word").count().where(F.col("count") >= min_count).select("word")
    kept = at.join(known, "word", "left_semi").groupBy("part_id", "line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t"))
    return kept.select("part_id", "line_id", F.transform("t", lambda x: x["word"]).alias("tokens"))


def sweep(parts: DataFrame, grid: list[dict]) -> DataFrame:
    """One model for each part and cell of the grid of sgns parameters: (cell, model_id, word, vector)."""
    out = None
    for i, kwargs in enumerate(grid):
        rows = train_parts(parts, **kwargs).withColumn("cell", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def load_or_train(path: str, spark, train: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet at path, made by train() where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        train().write.parquet(path)
        return spark.read.parquet(path)
