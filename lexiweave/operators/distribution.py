"""Counts and distributions: skip-grams, divergence of parts from the whole, fits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vocabularies of up to so many words are broadcast.
SMALL = 500_000


def skipgrams(sentences: DataFrame, window: int, by: tuple[str, ...] = (), centres: DataFrame | None = None) -> DataFrame:
    """(by, word, context) of each ordered pair within +-window positions; no shuffle. centres(word): a small table of the words wanted."""
    at = sentences.select(*by, "tokens", F.posexplode("tokens").alias("i", "word"))
    if centres is not None:
        at = at.join(F.broadcast(centres), "word", "left_semi")
    left = F.slice("tokens", F.greatest(F.col("i") - window + 1, F.lit(1)), F.least(F.col("i"), F.lit(window)))
    right = F.slice("tokens", F.col("i") + 2, F.lit(window))
    return at.select(*by, "word", F.explode(F.concat(left, right)).alias("context"))


#: Pairs that are held before they are counted, and different ones that are kept before they are sent.
HELD, DISTINCT = 1_000_000, 1_000_000


def skipgram_count(sentences: DataFrame, window: int, vocabulary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of vocabulary words, counted; positions count all words.

    A vocabulary of up to SMALL words is sent to the lines, where tasks count the pairs of its
    words and send sums; beyond it pairs are summed first and then joined.
    """
    v = vocabulary.select("word").distinct()
    words = [r[0] for r in v.limit(SMALL + 1).collect()]
    if len(words) > SMALL:
        pairs = skipgrams(sentences, window, by).groupBy(*by, "word", "context").agg(F.count("*").alias("n"))
        return pairs.join(v, "word", "left_semi").join(v.withColumnRenamed("word", "context"), "context", "left_semi")
    bc = sentences.sparkSession.sparkContext.broadcast(words)
    kinds = dict(sentences.dtypes)

    def count(batches):
        known = pa.array(bc.value, pa.string())
        size, groups, held, many = len(known), {}, [], 0

        def summed():
            codes, n = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
            codes, at = np.unique(codes, return_inverse=True)
            return codes, np.bincount(at, n, len(codes)).astype(np.int64)

        def rows(codes, n):
            keys = list(groups)
            own = [keys[g] for g in (codes // (size * size)).tolist()] if by else []
            for i in range(0, len(codes), 100_000):
                part = slice(i, i + 100_000)
                columns = [pa.array([k[c] for k in own[part]], f.type) for c, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*columns, known.take(pa.array(codes[part] // size % size)), known.take(pa.array(codes[part] % size)), pa.array(n[part])], [*by, "word", "context", "n"])

        fields = []
        for batch in batches:
            fields = [batch.schema.field(c) for c in by]
            tokens = batch.column("tokens")
            word = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            line = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
            keys = zip(*(batch.column(c).to_pylist() for c in by)) if by else [()] * len(batch)
            group = np.array([groups.setdefault(k, len(groups)) for k in keys], np.int64)
            at = np.flatnonzero(word >= 0)
            word, line = word[at], line[at]
            for k in range(1, window + 1):  # the k-th next known word
                near = np.flatnonzero((at[k:] - at[:-k] <= window) & (line[k:] == line[:-k]))
                a, b, g = word[near], word[near + k], group[line[near]] * size
                held += [((g + a) * size + b, np.ones(len(near), np.int64)), ((g + b) * size + a, np.ones(len(near), np.int64))]
                many += 2 * len(near)
            if many > HELD:
                held = [summed()]
                many = len(held[0][0])
                if many > DISTINCT:
                    yield from rows(*held[0])
                    held, many = [], 0
        if held:
            yield from rows(*summed())

    types = "".join(f"`{c}` {kinds[c]}, " for c in by)
    return sentences.select(*by, "tokens").mapInArrow(count, types + "word string, context string, n long").groupBy(*by, "word", "context").agg(F.sum("n").alias("n"))


def _apart(k: int) -> Column:
    """Pairs (a, b) of `tokens` k positions apart, a the earlier."""
    n = F.greatest(F.size("tokens") - k, F.lit(0))
    return F.arrays_zip(F.slice("tokens", F.lit(1), n).alias("a"), F.slice("tokens", F.lit(k + 1), n).alias("b"))


def offset_pairs(sentences: DataFrame, k: int) -> DataFrame:
    """(a, b): words k positions apart, in both directions."""
    both = F.explode(F.array(F.struct(F.col("z.a").alias("a"), F.col("z.b").alias("b")), F.struct(F.col("z.b").alias("a"), F.col("z.a").alias("b"))))
    return sentences.select(F.explode(_apart(k)).alias("z")).select(both.alias("p")).select("p.a", "p.b")


def offset_counts(sentences: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(a, b, n): offset_pairs counted, those with n >= least. A pair and its mirror have one count, so each is summed once."""
    z = sentences.select(F.explode(_apart(k)).alias("z")).select(F.least("z.a", "z.b").alias("a"), F.greatest("z.a", "z.b").alias("b"))
    once = z.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))).where(F.col("n") >= least)
    mirror = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return once.select(F.explode(mirror).alias("p"), "n").select("p.a", "p.b", "n")


def to_distribution(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """counts with p = n / sum of n; sums are joined, so no group is one task."""
    if by:
        return counts.join(counts.groupBy(*by).agg(F.sum("n").alias("total")), list(by)).withColumn("p", F.col("n") / F.col("total")).drop("total")
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).withColumn("p", F.col("n") / F.col("total")).drop("total")  # one row


def aligned(parts: DataFrame, origin: DataFrame, keys: list[str], by: tuple[str, ...]) -> DataFrame:
    """(by, keys, p, q): part and origin distributions over the origin's terms; absent terms of a part are left out, their p is 0."""
    known = parts.join(origin.select(*keys, F.col("p").alias("q")), keys)
    return to_distribution(known.drop("p") if "p" in parts.columns else known, by)


def _met(parts: DataFrame, origin: DataFrame, keys: list[str]) -> DataFrame:
    return parts.where("n > 0").join(origin.select(*keys, F.col("p").alias("q")), keys)


def kl(parts: DataFrame, origin: DataFrame, keys: list[str], by: tuple[str, ...]) -> DataFrame:
    """KL divergence of each part's distribution from the origin's, natural log.

    With T the part's sum of n over the origin's terms it is sum n (log n - log q) / T - log T: one pass.
    """
    n = F.col("n")
    sums = _met(parts, origin, keys).groupBy(*by).agg(F.sum(n * (F.log(n) - F.log("q"))).alias("s"), F.sum("n").alias("t"))
    return sums.select(*by, (F.col("s") / F.col("t") - F.log("t")).alias("kl"))


def squared_difference(parts: DataFrame, origin: DataFrame, keys: list[str], by: tuple[str, ...]) -> DataFrame:
    """Sum of (p - q)^2 over all the origin's terms, those absent from a part too: sum p^2 - 2 sum p q of the met terms, plus sum q^2."""
    n, t = F.col("n").cast("double"), F.col("t")
    met = _met(parts, origin, keys).groupBy(*by).agg(F.sum(n * n).alias("nn"), F.sum(n * F.col("q")).alias("nq"), F.sum("n").cast("double").alias("t"))
    whole = origin.agg(F.sum(F.col("p") * F.col("p")).alias("q2"))
    return met.join(F.broadcast(whole)).select(*by, (F.col("nn") / (t * t) - 2 * F.col("nq") / t + F.col("q2")).alias("ssd"))  # one row


def smoothed(p: Column, total: Column, zeros: Column, factor: float) -> Column:
    """Zero probabilities become factor, the others give that mass up in proportion."""
    return F.when(p == 0, F.lit(factor)).otherwise(p - factor * zeros * p / total)


def accumulated(counts: DataFrame, sample: str, keys: list[str]) -> DataFrame:
    """Running counts over successive samples, for every sample from a term's first on: a count goes to its sample and all later ones, which are summed."""
    later = F.broadcast(counts.select(F.col(sample).alias("__later")).distinct())  # a row a sample
    rows = counts.where("n > 0").join(later, F.col("__later") >= F.col(sample)).select(F.col("__later").alias(sample), *keys, "n")
    return rows.groupBy(sample, *keys).agg(F.sum("n").alias("n"))


def occurrence_histogram(sentences: DataFrame, words: list[str], cap: int = 1000) -> DataFrame:
    """(word, bucket, n): in how many lines each word occurs bucket times, zero included."""
    w = sentences.select("tokens", F.explode(F.array(*map(F.lit, words))).alias("word"))
    times = F.least(F.size(F.filter("tokens", lambda x: x == F.col("word"))), F.lit(cap))
    return w.select("word", times.alias("bucket")).groupBy("word", "bucket").agg(F.count("*").alias("n"))


def exponential_fit(hist: DataFrame) -> DataFrame:
    """hist(word, bucket, n) with pdf, cdf and those of the exponential with lambda = lines / occurrences."""
    w = Window.partitionBy("word")
    lines, total = F.sum("n").over(w), F.sum(F.col("n") * F.col("bucket")).over(w)
    run = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    rows = hist.withColumn("lam", F.try_divide(lines, total)).withColumn("pdf", F.col("n") / lines).withColumn("cdf", run / lines)
    return rows.withColumn("model_pdf", F.col("lam") * F.exp(-F.col("lam") * F.col("bucket"))).withColumn("model_cdf", 1 - F.exp(-F.col("lam") * F.col("bucket")))


def lognormal_fit(hist: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """(word, mu, sigma): weighted mean and deviation of the log count, zero counted as epsilon."""
    x = F.log(F.when(F.col("bucket") == 0, epsilon).otherwise(F.col("bucket")).cast("double"))
    s = hist.withColumn("x", x).groupBy("word").agg(F.sum("n").alias("s0"), F.sum(F.col("n") * F.col("x")).alias("s1"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("s2"))
    mu = F.col("s1") / F.col("s0")
    return s.select("word", mu.alias("mu"), F.sqrt(F.greatest(F.col("s2") / F.col("s0") - mu * mu, F.lit(0.0))).alias("sigma"))


def lognormal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    z = (F.log(x) - mu) / sigma
    return F.exp(-z * z / 2) / (x * sigma * math.sqrt(2 * math.pi))


def lognormal_kl(hist: DataFrame, scales: tuple[float, ...], epsilon: float = 1e-6) -> DataFrame:
    """(word, scale, kl): the counts above zero, each bucket's lines plus one, against the fitted log-normal times each scale.

    Every bucket from 0 to a word's largest one has a line more than counted, so no probability is 0.
    """
    top = hist.groupBy("word").agg(F.max("bucket").alias("top"))  # a row a word
    every = top.select("word", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bucket")).join(hist, ["word", "bucket"], "left").select("word", "bucket", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    fit = lognormal_fit(every, epsilon).join(every.groupBy("word").agg(F.sum("n").alias("total")), "word")
    p = F.col("n") / F.col("total")
    q = lognormal_pdf(F.col("bucket").cast("double"), F.col("mu"), F.col("sigma")) * F.col("scale")
    rows = every.where("bucket > 0").join(F.broadcast(fit), "word").withColumn("scale", F.explode(F.array(*(F.lit(float(s)) for s in scales))))
    return rows.groupBy("word", "scale").agg(F.sum(p * (F.log(p) - F.log(q))).alias("kl"))


def skipgram_total(n_words: float, n_sentences: float, window: int) -> float:
    """Expected number of skip-grams: each word has 2L contexts, but for those cut off at line ends."""
    return n_words * 2 * window - (1 + window) * window * n_sentences
