"""Text expressions: tokens, word forms, predicates, small parsers. All JVM-side columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points below 256 that a word keeps when it is standardised, besides letters and digits: fixed values.
KEPT_MARKS = "\t _-"
#: A valid word starts like this (only the start is anchored): a fixed value.
VALID_WORD = r"^[a-zA-Z]+[a-zA-Z0-9'_-]*"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(line: str | Column, lower: bool = False) -> Column:
    """Words between white space (ASCII)."""
    c = _col(line)
    return F.array_remove(F.split(F.lower(c) if lower else c, r"\s+"), "")


def stem(word: str | Column) -> Column:
    return F.lower(F.trim(_col(word)))


def _deleted() -> str:
    """A character class of what standardising deletes: the non-alphanumeric among code points 0 to 255."""
    marks = [c for c in range(256) if not chr(c).isalnum() and chr(c) not in KEPT_MARKS]
    return "[" + "".join(f"\\x{{{c:x}}}" for c in marks) + "]"


def standardize(word: str | Column, lower: bool = True) -> Column:
    c = F.regexp_replace(_col(word), _deleted(), "")
    return F.lower(c) if lower else c


def strip_tags(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), "<[^>]*>", "")


def valid_word(word: str | Column) -> Column:
    return _col(word).rlike(VALID_WORD)


def sentences(text: str | Column, stop: list[str] = ()) -> Column:
    """Arrays of words of each sentence, lower-cased, without stop words; line ends are spaces."""
    parts = F.split(F.lower(F.regexp_replace(_col(text), "\n", " ")), "[.]")
    return F.transform(parts, lambda s: F.filter(F.split(s, r"\s+"), lambda w: (w != "") & ~w.isin(*stop) if stop else w != ""))


def fraction(value: str | Column) -> Column:
    """'1/10' as 0.1; other text as its number, or null."""
    c = _col(value)
    return F.when(c.contains("/"), F.try_divide(F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(c, F.lit("/"), F.lit(2)).try_cast("double"))).otherwise(c.try_cast("double"))


def elapsed_seconds(begin: str | Column, end: str | Column, form: str = "yyyy-MM-dd HH:mm:ss,SSS") -> Column:
    """Seconds between two log stamps."""
    return (F.unix_micros(F.to_timestamp(_col(end), form)) - F.unix_micros(F.to_timestamp(_col(begin), form))) / 1e6


def criteria(column: str, rule) -> Column:
    """A value, a closed interval (low, high) with None as an open end, or a list of either."""
    c = F.col(column)
    if isinstance(rule, list):
        return reduce(lambda a, b: a | b, (criteria(column, r) for r in rule), F.lit(False))
    if isinstance(rule, tuple):
        low, high = rule
        out = F.lit(True)
        if low is not None:
            out = out & (c >= low)
        return out & (c <= high) if high is not None else out
    return c == rule


def all_criteria(rules: dict, combination: str = "and") -> Column:
    """Rules by column joined by and / or; no rule at all is true for and, false for or."""
    parts = [criteria(k, r) for k, r in rules.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if combination == "and" else reduce(lambda a, b: a | b, parts, F.lit(False))


def high_level(category: str | Column) -> Column:
    """Whether an analogy category is syntactic or semantic, by its prefix."""
    return F.when(_col(category).startswith("gram"), "syntactic").otherwise("semantic")


def part_of_speech(category: str | Column) -> Column:
    """verb, noun or adjective, by the prefix of a pair of tags."""
    c = F.upper(_col(category))
    return F.when(c.startswith("VB"), "verb").when(c.startswith("NN"), "noun").otherwise("adjective")
