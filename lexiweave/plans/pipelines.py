"""Whole runs: divide, train, merge, evaluate; missing words; sampling fidelity; grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import distribution, division, evaluate, interpolate, merge, train, vocabulary
from ..storage import materialize


def train_divided(lines: DataFrame, strategy: str, parts: int, division_args: dict | None = None, **kwargs) -> DataFrame:
    """lines(line_id, line) -> (model_id, word, vector), one model a part."""
    divided = division.divide(lines, strategy, parts, **(division_args or {})).withColumn("tokens", tokens("line", True))
    return train.train_parts(divided, **kwargs)


def merged(models: DataFrame, parts: int, method: str = "concat", keep=None, **kwargs) -> DataFrame:
    """One embedding of (model_id, word, vector): concat, add, pca, or a pairwise `order/strategy`."""
    if method == "concat":
        return vocabulary.join_all(models, parts)
    if method == "add":
        return merge.vector_add(models, parts)
    if method == "pca":
        return merge.pca(models, parts, **kwargs)
    order, strategy = method.split("/")
    return merge.fold([models.where(F.col("model_id") == i).select("word", "vector") for i in range(parts)], order, strategy, **({"keep": keep} if keep else {}))


def fidelity(lines: DataFrame, parts: int, strategy: str = "modulo", **kwargs) -> DataFrame:
    """(part_id, kl): each part's word distribution against the whole corpus."""
    divided = division.divide(lines, strategy, parts, **kwargs).select("part_id", F.explode(tokens("line", True)).alias("word"))
    counts = part_counts(divided, ("part_id",))
    return distribution.kl(counts, whole_of(counts) if strategy != "sampling" else _origin(lines), ["word"], ("part_id",))


def part_counts(words: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, word, n), written: the corpus is read and cut into words once, whatever is asked of the counts."""
    return materialize(vocabulary.word_count(words, by))


def whole_of(counts: DataFrame) -> DataFrame:
    """The word distribution of all parts together."""
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.groupBy("word").agg(F.sum("n").alias("n")).join(total).select("word", "n", (F.col("n") / F.col("total")).alias("p"))


def _origin(lines: DataFrame) -> DataFrame:
    return distribution.to_distribution(vocabulary.word_count(lines.select(F.explode(tokens("line", True)).alias("word"))))


def block_fidelity(lines: DataFrame, total: int, denominators: list[int], blocks: int = 10) -> DataFrame:
    """(d, part_id, kl): the first `blocks` blocks of a d-th of the corpus each, the partial last one included.

    Words are counted once, by the blocks of all d together that their line is in; each d's
    blocks and the whole are sums of these.
    """
    each = [F.floor(F.col("line_id") / F.floor(F.lit(total) / F.lit(d))).cast("int").alias(f"b{i}") for i, d in enumerate(denominators)]
    names = tuple(f"b{i}" for i in range(len(denominators)))
    counts = part_counts(lines.select(*each, F.explode(tokens("line", True)).alias("word")), names)
    place = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(b).alias("part_id")) for d, b in zip(denominators, names, strict=True))))
    rows = counts.select(place.alias("at"), "word", "n").select("at.d", "at.part_id", "word", "n").where(F.col("part_id") < blocks)
    return distribution.kl(rows.groupBy("d", "part_id", "word").agg(F.sum("n").alias("n")), whole_of(counts), ["word"], ("d", "part_id"))


def missing_words(source: DataFrame, target: DataFrame, pairs: DataFrame, methods: tuple[str, ...] = interpolate.METHODS) -> DataFrame:
    """(run, benchmark, value): similarity of target with its missing words predicted by each method."""
    rows = None
    for m in methods:
        got = evaluate.similarity(pairs, interpolate.interpolate(source, target, m)).select(F.lit(m).alias("run"), F.lit("similarity").alias("benchmark"), F.col("spearman").alias("value"))
        rows = got if rows is None else rows.unionByName(got)
    return rows


def intrinsic_error(source: DataFrame, target: DataFrame, method: str, share: float = 0.6) -> float:
    """Frobenius error on the test words of a map learned from the training words."""
    rows = vocabulary.intrinsic_split(source, target, share, 1 - share)
    part = lambda role, c: rows.where(F.col("role") == role).select("word", F.col(c).alias("vector"))
    seen = part("train", "target")
    every = part("train", "source").unionByName(part("test", "source"))
    predicted = interpolate.interpolate(every, seen, method)
    return interpolate.frobenius(predicted, part("test", "target"))


def subset_scores(models: DataFrame, subsets: DataFrame, pairs: DataFrame, method: str = "concat") -> DataFrame:
    """(size, repeat, value): similarity of each random subset of sub-models, merged. The grid (sizes x repeats) is a driver loop of lazy plans."""
    out = None
    for size, repeat in [(r["size"], r["repeat"]) for r in subsets.select("size", "repeat").distinct().collect()]:
        chosen = models.join(F.broadcast(subsets.where((F.col("size") == size) & (F.col("repeat") == repeat)).select("model_id")), "model_id")
        got = evaluate.similarity(pairs, merged(chosen, size, method)).select(F.lit(size).alias("size"), F.lit(repeat).alias("repeat"), F.col("spearman").alias("value"))
        out = got if out is None else out.unionByName(got)
    return out


def interpolated_merge(source: DataFrame, target: DataFrame, method: str = "global", strategy: str = "add") -> DataFrame:
    """Each model's missing words predicted from the other, then the two merged over the union vocabulary."""
    return merge.PAIRWISE[strategy](interpolate.interpolate(target, source, method), interpolate.interpolate(source, target, method))


def extrinsic_scores(source: DataFrame, target: DataFrame, pairs: DataFrame, methods: tuple[str, ...] = interpolate.METHODS, strategy: str = "add") -> DataFrame:
    """(run, benchmark, value): similarity of the two models merged after each method filled their gaps."""
    rows = None
    for m in methods:
        got = evaluate.similarity(pairs, interpolated_merge(source, target, m, strategy)).select(F.lit(m).alias("run"), F.lit("similarity").alias("benchmark"), F.col("spearman").alias("value"))
        rows = got if rows is None else rows.unionByName(got)
    return rows


def run_grid(lines: DataFrame, parts: int, pairs: DataFrame, strategies: list[str], methods: list[str], norms: list[bool], division_args: dict | None = None, **kwargs) -> DataFrame:
    """(strategy, method, norm, value): each cell of the grid divided, trained, merged and scored by similarity.

    Sub-models are trained once a strategy and written; cells are few, so they are a driver loop.
    """
    from ..functions.vectors import normalize

    out = None
    for strategy in strategies:
        models = materialize(train_divided(lines, strategy, parts, (division_args or {}).get(strategy), **kwargs))
        for cell in grid([strategy], methods, norms):
            used = models.withColumn("vector", normalize("vector")) if cell["norm"] else models
            got = evaluate.similarity(pairs, merged(used, parts, cell["method"])).select(*(F.lit(v).alias(k) for k, v in cell.items()), F.col("spearman").alias("value"))
            out = got if out is None else out.unionByName(got)
    return out


def dropout_grid(embeddings: dict[str, DataFrame], vocabularies: dict[str, DataFrame], benchmarks: evaluate.Benchmarks) -> DataFrame:
    """(model, vocabulary, benchmark, value): every benchmark restricted to each vocabulary(word), on each merged model restricted alike."""
    out = None
    for model, e in embeddings.items():
        for name, words in vocabularies.items():
            got = evaluate.evaluate_demanded(vocabulary.restrict(e, words), benchmarks, words, model).select(F.lit(model).alias("model"), F.lit(name).alias("vocabulary"), "benchmark", "value")
            out = got if out is None else out.unionByName(got)
    return out


def grid(strategies: list[str], methods: list[str], norms: list[bool]) -> list[dict]:
    """Every cell of the configuration grid."""
    return [{"strategy": s, "method": m, "norm": n} for s in strategies for m in methods for n in norms]
