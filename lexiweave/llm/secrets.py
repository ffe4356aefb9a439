"""Secret scans: known shapes, and a randomness test battery, in SQL expressions only.

Known shapes are the assignments, access keys and hex runs of `BASE`. The battery adds
long runs of key characters that look random. For every candidate the encoding is
inferred (the first of ENCODINGS that fits) and three tests give normal scores against
uniform random symbols: chi-squared of the alphabet, runs above and below the middle
symbol, and lag-one serial correlation. Their squares add up to the candidate's distance
from randomness.

How close is close depends on encoding and length. The null is natural text, whatever the
corpus: strings joined from WORDS, dates, counters and paths as the encoding allows, made
by a fixed rule, whose log distances grow with the log of the length, around a line of each
encoding. A candidate's p-value is the normal share of natural strings of its encoding and
length that are as close to random. Benjamini-Hochberg over all distinct candidates of an
encoding holds its false discovery rate under FDR; copies of a string count once. Counts by
encoding and bucket of the normal score reach the driver: a table of fixed size. Short strings of small
alphabets (lower-case letters, digits) are rarely far enough from natural ones to be found.

Null texts are empty and have no spans. Positions count code points, ends are exclusive.
Spans of one kind never overlap; ties at one start go by kind. Repeated rows are scanned
each. A text of any length is one value of its column. An empty table gives no rows. Other
columns are kept by `redact`, not read here.
"""

from __future__ import annotations

import functools
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, group whose length counts, least length), in the order of listing: fixed values.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = [*BASE, "random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding, its form and alphabet, the first that fits.
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("hex upper", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER),
    ("base32", "^[A-Z2-7]+=*$", UPPER + DIGITS[2:8]),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base36 upper", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", ".*", UPPER + LOWER + DIGITS + "+/"),
]
#: Common words of several languages, of which natural strings are joined: fixed values.
WORDS = """the of and for with from this that user name file data main test path list item value index table query service client server request response session
message account profile image video project module version build release config default option window button header footer page content update create delete
haus zeit jahr tag mensch arbeit stadt land welt gesellschaft entwicklung verwaltung ordnung sicherheit freundlichkeit maison temps homme femme travail monde
ville jour question gouvernement tiempo persona trabajo mundo ciudad casa nombre desarrollo informacion seguridad water people number government development""".split()
FDR = 0.05
#: Length classes are powers of the square root of two from 20 on; normal scores fall in STEPS buckets a unit, BUCKETS on either side of 0.
LENGTHS, STEPS, BUCKETS = 8, 20, 600
#: Natural strings made for each encoding and length class.
NATURAL = 100
MASK = "[SECRET]"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _running(a: Column, join, first) -> Column:
    """Running joins (sums, maxima) of an array of int, in blocks of a square root of its size, so that little is copied."""
    grow = lambda acc, x: F.struct(join(acc["last"], x).alias("last"), F.concat(acc["out"], F.array(join(acc["last"], x))).alias("out"))
    none = F.struct(F.lit(first).cast("int").alias("last"), F.array().cast("array<int>").alias("out"))

    def whole(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x["a"]))).cast("int")
        cuts = F.sequence(F.lit(0), F.ceil(F.size(x["a"]) / width).cast("int") - 1)
        return F.transform(cuts, lambda b: F.aggregate(F.slice(x["a"], b * width + 1, width), none, grow))

    def placed(blocks: Column) -> Column:
        lead = F.aggregate(F.transform(blocks, lambda b: b["last"]), none, grow)["out"]
        lead = F.concat(F.array(F.lit(first).cast("int")), F.slice(lead, 1, F.size(lead) - 1))
        return F.flatten(F.zip_with(blocks, lead, lambda b, x: F.transform(b["out"], lambda y: join(x, y))))

    return F.when(F.size(a) > 0, _let(_let(F.struct(a.alias("a")), whole), placed)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """array<struct(start, end, kind, body)> of the leftmost non-overlapping matches that are long enough.

    The text between matches (split) and the matches themselves give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), bodies.alias("b"))

    def spans(x: Column) -> Column:
        ends = _running(F.transform(x, lambda y: y["g"] + F.length(y["m"])), lambda a, b: a + b, 0)
        made = F.zip_with(x, ends, lambda y, end: F.struct((end - F.length(y["m"])).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), y["b"].alias("body")))
        return F.filter(made, lambda y: F.length(y["body"]) >= least)

    return _let(parts, spans)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string,body:string>>")


def base_spans(text: Column) -> Column:
    low = F.lower(text)
    gate = {
        "assign": (F.contains(low, F.lit("pass")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))) & text.rlike(BASE["assign"][0]),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{24}"),
    }
    return F.concat(*(F.when(gate[k], _matches(text, p, k, g, n)).otherwise(_none()) for k, (p, g, n) in BASE.items()))


def encoding(s: Column) -> Column:
    """The number of the first of ENCODINGS that fits."""
    out = F.lit(len(ENCODINGS) - 1)
    for i, (_, form, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        out = F.when(s.rlike(form), F.lit(i)).otherwise(out)
    return out


def distance(s: Column, kind: Column) -> Column:
    """How far a string is from uniform random symbols of its encoding: about chi-squared with 3 degrees if random."""
    alphabet = F.array(*(F.lit(letters) for *_, letters in ENCODINGS))[kind]
    plain = F.translate(F.regexp_replace(s, "=+$", ""), "-_", "+/")

    def tests(x: Column) -> Column:
        t, letters = x["t"], x["a"]
        n, k = F.length(t).cast("double"), F.length(letters).cast("double")
        squares = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(t) - F.length(F.replace(t, c, F.lit(""))), 2))
        chi = squares * k / n - n
        df = k - 1
        z_chi = (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        values = F.transform(F.split(t, ""), lambda c: F.position(c, letters).cast("double") - 1)

        def walk(v: Column) -> Column:
            mean = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y) / n
            start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("high"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("var"), F.lit(0.0).alias("lag"), mean.alias("mean"))

            def step(acc: Column, y: Column) -> Column:
                d, up = y - acc["mean"], (y >= k / 2)
                new = acc["last"].isNull() | ((acc["last"] >= k / 2) != up)
                return F.struct(
                    y.alias("last"), (acc["high"] + up.cast("double")).alias("high"), (acc["runs"] + new.cast("double")).alias("runs"), (acc["var"] + d * d).alias("var"),
                    (acc["lag"] + F.coalesce((acc["last"] - acc["mean"]) * d, F.lit(0.0))).alias("lag"), acc["mean"].alias("mean"),
                )

            return F.aggregate(v, start, step)

        def combine(w: Column) -> Column:
            n1, n2 = w["high"], n - w["high"]
            mu = 2 * n1 * n2 / n + 1
            spread = (mu - 1) * (mu - 2) / (n - 1)
            z_runs = F.when(spread > 0, (w["runs"] - mu) / F.sqrt(spread)).otherwise(F.sqrt(n))
            z_lag = F.when(w["var"] > 0, (w["lag"] / w["var"] + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
            uneven = F.greatest(z_chi, F.lit(0.0))  # symbols more even than chance do not speak for natural text
            return uneven * uneven + z_runs * z_runs + z_lag * z_lag

        return _let(_let(values, walk), combine)

    return _let(F.struct(plain.alias("t"), alphabet.alias("a")), tests)


def natural_string(rng: random.Random, name: str, size: int) -> str:
    """A string of `size` characters as people and programs write them in the alphabet of an encoding."""
    letters = dict((n, a) for n, _, a in ENCODINGS)[name]
    counter = rng.randrange(10**6)
    style = rng.randrange(4)
    out = ""
    while len(out) < size:
        word, digits = rng.choice(WORDS), (f"{rng.randrange(1970, 2040)}{rng.randrange(1, 13):02}{rng.randrange(1, 29):02}", f"{counter:08}", str(rng.randrange(10)) * 6, str(rng.randrange(100)))[style]
        counter += 1
        if name == "decimal":
            out += digits
        elif name.startswith("hex"):
            out += rng.choice((digits, "00000000", "deadbeef", "facade", "ffffffff"))
        elif name in ("lower", "upper"):
            out += word
        elif name == "letters":
            out += word.capitalize() if style else word.upper()
        elif name in ("base32", "base36", "base36 upper"):
            out += word + digits * (rng.random() < 0.5)
        elif name == "base62":
            out += word.capitalize() + digits * (rng.random() < 0.4)
        else:
            out += word.capitalize() * (style == 1) + word * (style != 1) + rng.choice("/-_") + digits * (rng.random() < 0.2)
    out = out[:size].translate(str.maketrans("-_", "+/"))
    out = out.upper() if name in ("upper", "hex upper", "base32", "base36 upper") else out
    return "".join(c if c in letters else letters[0] for c in out)


def string_distance(t: str, letters: str) -> float:
    """`distance` of a string already in its alphabet, for making the null."""
    n, k = len(t), len(letters)
    place = np.zeros(128, np.int64)
    place[np.frombuffer(letters.encode(), np.uint8)] = np.arange(k)
    v = place[np.frombuffer(t.encode(), np.uint8)].astype(float)
    chi = (np.bincount(v.astype(int), minlength=k) ** 2).sum() * k / n - n
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    up = v >= k / 2
    n1 = float(up.sum())
    mu = 2 * n1 * (n - n1) / n + 1
    spread = (mu - 1) * (mu - 2) / (n - 1)
    runs = (1 + (up[1:] != up[:-1]).sum() - mu) / math.sqrt(spread) if spread > 0 else math.sqrt(n)
    d = v - v.mean()
    lag = ((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n) if (d * d).sum() > 0 else math.sqrt(n)
    return max(z, 0.0) ** 2 + runs**2 + lag**2


@functools.cache
def null(seed: int = 1) -> list[tuple[float, float, list[float]]]:
    """For each encoding, (a, b, deviations by length class): natural strings of n characters have log distances of about a + b ln(n)."""
    rng, out = random.Random(seed), []
    for name, _, letters in ENCODINGS:
        made = [natural_string(rng, name, math.ceil(20 * 2 ** (rng.uniform(c, c + 1) / 2))) for c in range(LENGTHS) for _ in range(NATURAL)]
        n = np.log([len(t) for t in made])
        x = np.log1p([string_distance(t, letters) for t in made])
        b, a = np.polyfit(n, x, 1)
        rest = (x - a - b * n).reshape(LENGTHS, NATURAL)
        out.append((float(a), float(b), [max(float(r.std()), 0.15) for r in rest]))
    return out


def closeness(s: Column, kind: Column) -> Column:
    """The normal score of a string's log distance among natural strings of its encoding and length; below zero is closer to random."""
    size = F.least(F.lit(LENGTHS - 1), F.floor(2 * F.log2(F.length(s) / 20.0)).cast("int"))
    fixed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.array(*map(F.lit, d)).alias("d")) for a, b, d in null()))[kind]
    return (F.log1p(distance(s, kind)) - fixed["a"] - fixed["b"] * F.log(F.length(s).cast("double"))) / fixed["d"][size]


def candidates(text: Column) -> Column:
    """array<struct(start, end, key, encoding, bucket)> of the runs the battery judges: all of CANDIDATE's form."""
    runs = F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), _matches(text, CANDIDATE, "random", 0, 20)).otherwise(_none())

    def judge(x: Column) -> Column:
        score = closeness(x["body"], x["encoding"]) * STEPS
        bucket = F.floor(F.greatest(F.lit(-BUCKETS), F.least(F.lit(BUCKETS - 1), score))).cast("int")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["body"]).alias("key"), x["encoding"].alias("encoding"), bucket.alias("bucket"))

    return F.transform(F.transform(runs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["body"].alias("body"), encoding(x["body"]).alias("encoding"))), judge)


def discoveries(docs: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Encoding -> the largest bucket that Benjamini-Hochberg accepts, from the distinct candidates of all of docs(text); encodings without one are left out."""
    each = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c")).select("c.key", "c.encoding", "c.bucket").distinct()
    out: dict[int, int] = {}
    tested: dict[int, list[tuple[int, int]]] = {}
    for r in each.groupBy("encoding", "bucket").agg(F.count("*").alias("n")).collect():  # at most 2 * BUCKETS rows an encoding
        tested.setdefault(r["encoding"], []).append((r["bucket"], r["n"]))
    for kind, counts in tested.items():
        total, below = sum(n for _, n in counts), 0
        for bucket, n in sorted(counts):
            below += n
            if 0.5 * math.erfc(-(bucket + 1) / STEPS / math.sqrt(2)) <= fdr * below / total:
                out[kind] = bucket
    return out


def spans(text: Column, accepted: dict[int, int]) -> Column:
    """All spans, by start and then kind: array<struct(start, order, end, kind)>."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    found = F.transform(base_spans(text), lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))
    if not accepted:
        return F.array_sort(found)

    limits = F.array(*(F.lit(accepted.get(i, -BUCKETS - 1)) for i in range(len(ENCODINGS))))
    close = F.transform(F.filter(candidates(text), lambda x: x["bucket"] <= limits[x["encoding"]]), lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("order"), x["end"].alias("end"), F.lit("random").alias("kind")))
    return F.array_sort(F.concat(found, close))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> counts of the known shapes, a digest of their spans, and all spans."""
    accepted = discoveries(docs)
    text = F.coalesce("text", F.lit(""))

    def columns(found: Column) -> Column:
        known = F.filter(found, lambda x: x["kind"] != "random")
        count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
        return F.struct(*(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(known).cast("binary"), 256).alias("base_sha256"), joined(found).alias("spans"))

    made = docs.select(F.col("doc_id").cast("long"), _let(spans(text, accepted), columns).alias("c"))
    return made.select("doc_id", "c.n_assign", "c.n_access", "c.n_hex", "c.base_sha256", "c.spans", "c.n_random")


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with every span of `text` replaced; overlapping spans are one. A text without spans is unchanged, null stays null."""
    accepted = discoveries(docs)
    text = F.col("text")

    def apply(found: Column) -> Column:
        before = lambda ends: F.concat(F.array(F.lit(0)), ends)  # noqa: E731  how far the text is covered before each span, and after all

        def pieces(x: Column) -> Column:
            cover = F.slice(x["cover"], 1, F.size(x["spans"]))
            # a span that starts in an earlier one gives nothing of its own
            each = F.zip_with(x["spans"], cover, lambda y, at: F.when(y["start"] >= at, F.concat(F.substring(text, at + 1, y["start"] - at), F.lit(mask))).otherwise(F.lit("")))
            return F.concat(F.array_join(each, ""), F.substring(text, F.element_at(x["cover"], -1) + 1, F.length(text)))

        return _let(F.struct(found.alias("spans"), before(_running(F.transform(found, lambda y: y["end"]), F.greatest, 0)).alias("cover")), pieces)

    return docs.withColumn("text", F.when(text.isNull(), text).otherwise(_let(spans(text, accepted), lambda s: F.when(F.size(s) == 0, text).otherwise(apply(s)))))
