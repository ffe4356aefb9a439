"""Quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff of a fixed grid. Labelled documents
that pass the base rules are split by a hash of their id:

* all bad ones and a third of the good ones order the cutoffs of all rules into one path,
  each step the tightening that catches the most bad documents for the good ones it loses,
  as long as it catches more than it loses;
* the other good ones are holdouts. The share of them that all rules together reject after
  a step is bounded above, exactly, by the Clopper-Pearson bound of the binomial. Steps are
  tested in order up to the first whose bound exceeds RISK (fixed-sequence testing, so that
  a path costs no correction); strata and the pooled path share DELTA by Bonferroni.

So with probability 1 - DELTA no stratum with cutoffs of its own loses more than RISK of its
good documents. A stratum with too few holdouts for a step takes the pooled path's cutoffs
(whose guarantee holds for all strata together), if it has LEAST good documents and these
lose no more than RISK to them; any other stratum has no cutoffs, so only the base rules
apply there. The column `guarantee` says which of these (stratum, pooled, none) holds.

Measures of a text without words are 0. Null texts have no words; a null stratum is its own.
Cutoffs come from all labelled rows; labels with a null id or value are skipped, and of
repeated ids the largest label stays. Repeated rows are judged each. Ties at a cutoff
are kept. A text of any length is one value of its column and is measured whole. Other
columns are not read, and one named as an output gives way to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, carried, with_kept

RISK, DELTA = 0.05, 0.05
#: Good documents a stratum needs to take pooled cutoffs; bad ones it needs for a path of its own.
LEAST, LEAST_BAD = 10, 20
SPACE = " \t\n\r\x0b\f"
SYMBOLS = "#*$%&|<>"
#: Rule -> direction (1: too much is bad, -1: too little) and the grid, loosest first.
RULES: dict[str, tuple[int, tuple[float, ...]]] = {
    "symbol_ratio": (1, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01, 0.005)),
    "dup_line_share": (1, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "repeat_share": (1, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "mean_word": (1, (40.0, 25.0, 18.0, 14.0, 12.0, 10.0, 9.0, 8.0, 7.5)),
    "short_word": (-1, (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)),
    "upper_share": (1, (0.95, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "letter_share": (-1, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9)),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more, each counted once."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    k = (h[:-2] * m + h[1:-1]) * m
    k ^= k >> np.uint64(31)
    k = k * m + h[2:]
    s = np.sort(k)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, k), len(twice) - 1)
    hit = twice[at] == k
    cover = np.zeros(n, bool)
    for i in range(3):
        cover[i : n - 2 + i] |= hit
    return int(cover.sum())


def measure(text: str) -> tuple:
    """The MEASURES of a text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup, lines = set(), 0, 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(SPACE):
                lines += 1
                dup += line in seen
                seen.add(line)
    repeats = repeated_words(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    wide = int((raw >= 192).sum())  # characters beyond ASCII count as letters
    letters = upper + lower + wide
    mean = chars / n if n else 0.0
    return (n, chars, symbols, dup, repeats, symbols / chars if chars else 0.0, dup / lines if lines else 0.0, repeats / n if n else 0.0, mean, mean, upper / letters if letters else 0.0, letters / chars if chars else 0.0)


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, and the columns `keep`) with the MEASURES of each text."""
    kinds = [pa.int64() if i < 5 else pa.float64() for i in range(len(MEASURES))]

    def run(it):
        for batch in it:
            cols = list(zip(*(measure(t or "") for t in batch.column(1).to_pylist()), strict=True)) or [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["kept", *MEASURES])

    rows = carried(docs, keep)
    made = rows.mapInArrow(run, with_kept(rows, ", ".join(f"{m} {'long' if i < 5 else 'double'}" for i, m in enumerate(MEASURES))))
    return beside(made, keep, *MEASURES)


def incomplete_beta(a: float, b: float, x: float, rest: float) -> float:
    """The regularised incomplete beta function at x, where rest = 1 - x, by Lentz's continued fraction."""
    if x <= 0 or rest <= 0:
        return float(rest <= 0)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, rest, x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 1000 + 20 * math.isqrt(int(a + b))):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            c, d = 1 + step / c or tiny, 1 / (1 + step * d or tiny)
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b) + a * math.log(x) + b * math.log(rest)) * value


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n still has probability delta."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:
        return incomplete_beta(n - k, k + 1, 1 - p, p)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid in (0.0, 1.0):
            break
        low, high = (mid, high) if tail(mid) > delta else (low, mid)
    return high


Step = tuple[int, int]  # a rule's number and its grid place
NAMES = list(RULES)


def path(good: list[list[int]], bad: list[list[int]]) -> list[Step]:
    """The order in which cutoffs tighten, from the documents each rejects by rule and grid place."""
    at = {i: (-1, 0, 0) for i in range(len(good))}  # rule -> grid place, good lost, bad caught
    steps: list[Step] = []
    while True:
        best: tuple[float, Step] | None = None
        for i, (place, lost, caught) in at.items():
            for j in range(place + 1, len(good[i])):
                more, less = bad[i][j] - caught, good[i][j] - lost
                if more > less and (best is None or more / (less + 1) > best[0]):
                    best = more / (less + 1), (i, j)
        if best is None:
            return steps
        i, j = best[1]
        at[i] = j, good[i][j], bad[i][j]
        steps.append((i, j))


def passed(rejected: list[int], n: int, delta: float, risk: float = RISK) -> int:
    """How many steps hold, where rejected[t] of n holdouts fall first at step t."""
    k = 0
    for t, more in enumerate(rejected):
        k += more
        if upper_bound(k, n, delta) > risk:
            return t
    return len(rejected)


def _levels() -> Column:
    """For each rule, the first grid place whose cutoff rejects; the grid's length if none does."""
    return F.array(*(sum((F.when(_bad(rule, sign, F.lit(c)), 0).otherwise(1) for c in grid), F.lit(0)) for rule, (sign, grid) in RULES.items()))


def _name(stratum: str) -> Column:
    return F.coalesce(F.col(stratum).cast("string"), F.lit(""))


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str, train_where, risk: float = RISK, delta: float = DELTA) -> dict[str, tuple[str, dict[str, float]]]:
    """stratum -> (guarantee, rule -> cutoff), from measured(doc_id, stratum, MEASURES) and labels(doc_id, quality).

    Rows a stratum, and rows a stratum and step, reach the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & train_where).groupBy("doc_id").agg((F.max("quality") != 0).alias("__good"))
    third = F.pmod(F.xxhash64("doc_id", F.lit("path")), F.lit(3)) == 0
    rows = measured.join(known, "doc_id").where(~base_failed()).select(_name(stratum).alias("s"), F.when(~F.col("__good"), "bad").when(third, "path").otherwise("test").alias("use"), _levels().alias("levels"))
    places = [(i, j) for i, (_, grid) in enumerate(RULES.values()) for j in range(len(grid))]
    sums = [F.sum((F.col("levels")[i] <= j).cast("long")).alias(f"r{i}_{j}") for i, j in places]
    got = {(r["s"], r["use"]): r for r in rows.groupBy("s", "use").agg(F.count("*").alias("n"), *sums).collect()}  # at most three rows a stratum
    strata = sorted({s for s, _ in got})

    def counts(use: str, of: list[str]) -> list[list[int]]:
        return [[sum(got[s, use][f"r{i}_{j}"] for s in of if (s, use) in got) for j in range(len(grid))] for i, (_, grid) in enumerate(RULES.values())]

    def size(use: str, of: list[str]) -> int:
        return sum(got[s, use]["n"] for s in of if (s, use) in got)

    pooled = path(counts("path", strata), counts("bad", strata))
    own = {s: path(counts("path", [s]), counts("bad", [s])) if size("bad", [s]) >= LEAST_BAD else pooled for s in strata}
    if not strata:
        return {}
    spark = measured.sparkSession
    kind = "array<struct<rule:int,place:int>>"
    plans = F.broadcast(spark.createDataFrame([(s, own[s], pooled) for s in strata], f"s string, own {kind}, pooled {kind}"))

    def first(steps: str) -> Column:  # the first step that rejects the row, from 0; the path's length if none does
        return F.coalesce(F.array_min(F.transform(steps, lambda x, t: F.when(F.col("levels")[x["rule"]] <= x["place"], t))), F.size(steps))

    fell = rows.where("use <> 'bad'").join(plans, "s").select("s", "use", first("own").alias("own"), first("pooled").alias("pooled")).groupBy("s", "use", "own", "pooled").count().collect()
    part = delta / (len(strata) + 1)

    def holds(of: set[str], which: str, steps: list[Step]) -> int:
        rejected = [0] * (len(steps) + 1)
        for r in fell:
            if r["s"] in of and r["use"] == "test":
                rejected[r[which]] += r["count"]
        return passed(rejected[:-1], sum(rejected), part, risk) if sum(rejected) else 0

    def cutoffs(steps: list[Step]) -> dict[str, float]:
        return {NAMES[i]: RULES[NAMES[i]][1][j] for i, j in steps}  # a later step of a rule is the tighter one

    shared = pooled[: holds(set(strata), "pooled", pooled)]
    out: dict[str, tuple[str, dict[str, float]]] = {}
    for s in strata:
        mine = own[s][: holds({s}, "own", own[s])]
        lost = sum(r["count"] for r in fell if r["s"] == s and r["pooled"] < len(shared))
        n = size("path", [s]) + size("test", [s])
        if mine:
            out[s] = "stratum", cutoffs(mine)
        elif shared and n >= LEAST and lost <= risk * n:
            out[s] = "pooled", cutoffs(shared)
        else:
            out[s] = "none", {}
    return out


def _bad(rule: str, sign: int, cutoff):
    return F.col(rule) > cutoff if sign > 0 else F.col(rule) < cutoff


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, cutoffs: dict[str, tuple[str, dict[str, float]]], stratum: str) -> DataFrame:
    """measured with base_failed, the rules that failed, kept, and the stratum's guarantee."""
    spark = measured.sparkSession
    rows = [(s, g, [c.get(rule) for rule in RULES]) for s, (g, c) in cutoffs.items()]
    limits = F.broadcast(spark.createDataFrame(rows, "__s string, __guarantee string, __limits array<double>"))  # a row a stratum
    joined = measured.join(limits, _name(stratum) == F.col("__s"), "left")
    failed = [F.when(_bad(rule, sign, F.col("__limits")[i]), F.lit(rule)) for i, (rule, (sign, _)) in enumerate(RULES.items())]
    return joined.select(
        *(F.col(f"`{c}`") for c in measured.columns), base_failed().alias("base_failed"), F.array_compact(F.array(*failed)).alias("failed_rules"),
        F.coalesce("__guarantee", F.lit("none")).alias("guarantee"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
