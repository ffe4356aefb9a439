"""Packing documents into fixed sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder each. The remainders' lengths
form a histogram of length classes, for which a linear program over packing patterns is
solved by column generation: a knapsack dynamic program prices new patterns from the
dual values. The rounded-down pattern counts, and a first-fit-decreasing plan of the few
remainders that rounding leaves, are assigned to documents ranked within their class.
Only the histogram (at most CLASSES rows) reaches the driver.

A null or empty text is one piece, its end id alone. A text of any length is one value of
its column and is encoded whole, in time nearly in proportion to it. Repeated rows are packed each.
Ties rank by id, length and checksum; rows equal in all of these are interchangeable.
An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, materialize, texts

SEQUENCE, GRID = 2048, 8
CLASSES = SEQUENCE // GRID
#: Rows of one class are ranked in hash buckets of about so many, and at least LEAST buckets, so that no length is one task.
BUCKET_ROWS, LEAST = 200_000, 16
END = 1
#: Word pieces whose ids a worker remembers before it starts anew, and their longest length.
MEMO, MEMO_CHARS = 400_000, 64
#: White space as Unicode has it: a fixed value. Longer runs of it than LONG characters are cut out before the pattern reads them.
SPACES, LONG = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 2000


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, remembered word by word.

    The file is a byte-level BPE of the `tokenizers` library. Its ids are computed by
    `tiktoken` from the same vocabulary, several times faster; tests hold them equal.
    A pre-token ends before a single space between two other characters, so a text
    with no other spaces is the concatenation of its words' ids. As in `tokenizers`, a
    text is first split at the file's added tokens, which have ids of their own; with
    `encode_special_tokens` they are ordinary text.
    """

    #: The pre-token pattern of this byte-level BPE: a fixed value.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, encode_special_tokens: bool = True) -> None:
        import json
        import re

        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        special = {t["content"]: t for t in stored["added_tokens"]}
        if any(t[k] for t in special.values() for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        own = {} if encode_special_tokens else {c: array("I", [t["id"]]).tobytes() for c, t in special.items()}
        self.special = own
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")").split if own else None
        ranks = {bytes(byte[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("byte_level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long_run = re.compile(f"[{SPACES}]{{{LONG},}}").finditer
        self.other_space = re.compile(r"[^\S \n]").search
        self.memo: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if len(text) < LONG:
            return array("I", self.bpe.encode_ordinary(text)).tobytes()
        # the pattern takes a run of white space as one piece, but for a last character with text after it;
        # it would nest as deep as the run is long
        at, out = 0, array("I")
        for run in self.long_run(text):
            end = run.end() - (run.end() < len(text))
            out.extend(self.bpe.encode_ordinary(text[at : run.start()]))
            out.extend(self.bpe._encode_single_piece(text[run.start() : end].encode()))
            at = end
        out.extend(self.bpe.encode_ordinary(text[at:]))
        return out.tobytes()

    def __call__(self, batch: list[str]) -> list[bytes]:
        if not self.special:
            return self.ordinary(batch)
        out = self.ordinary(["" if any(c in text for c in self.special) else text for text in batch])
        for i, text in enumerate(batch):
            if text and not out[i]:
                parts = self.split(text)  # ordinary text and added tokens in turn
                parts[::2] = self.ordinary(parts[::2])
                parts[1::2] = map(self.special.get, parts[1::2])
                out[i] = b"".join(parts)
        return out

    def ordinary(self, batch: list[str]) -> list[bytes]:
        out, memo, ids = [], self.memo, self.ids
        for text in batch:
            if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or self.other_space(text):
                out.append(ids(text))
                continue
            first, *words = text.split(" ")
            parts = list(map(memo.get, words))
            if None in parts:
                if len(memo) > MEMO:
                    memo.clear()
                for i, part in enumerate(parts):
                    if part is None:
                        w = words[i]
                        parts[i] = memo.get(w) or ids(" " + w)
                        if len(w) <= MEMO_CHARS:
                            memo[w] = parts[i]
            out.append(ids(first) + b"".join(parts))
        return out


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, encode_special_tokens: bool = True) -> DataFrame:
    """docs(doc_id, text) as pieces of at most `sequence` ids: full ones and a remainder."""
    end = np.array([END], "<u4").tobytes()

    def run(it):
        encode = Encoder(tokenizer_path, encode_special_tokens)

        def cut(batch):
            cols: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts(batch.column(1))), strict=True):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, sequence):
                    part = ids[4 * s : 4 * (s + sequence)]
                    for c, v in zip(cols, (doc, s, len(part) // 4, zlib.crc32(part), n), strict=True):
                        c.append(v)
            return dict(zip(PIECES.names, cols, strict=True))

        yield from batches(cut, PIECES)(it)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(dual: np.ndarray, capacity: int, most: int = 40) -> list[np.ndarray]:
    """Patterns of the largest values, best first: for each first item, the best unbounded knapsack of the rest.

    dual[s - 1] is the profit of an item of size s.
    """
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        v = dual[:w] + best[w - 1 :: -1][:w]  # size s + 1 leaves w - s - 1
        s = int(v.argmax())
        if v[s] > best[w - 1] + 1e-12:
            best[w], take[w] = v[s], s + 1
        else:
            best[w] = best[w - 1]
    values = np.where(dual > 0, dual + best[capacity - 1 :: -1], 0.0)
    patterns = []
    for s in np.argsort(-values, kind="stable")[:most]:
        if values[s] <= 0:
            break
        pattern, w = np.zeros(capacity, np.int64), capacity - int(s) - 1
        pattern[s] += 1
        while w > 0:
            if take[w]:
                pattern[take[w] - 1] += 1
                w -= take[w]
            else:
                w -= 1
        patterns.append(pattern)
    return patterns


def column_generation(demand: np.ndarray, capacity: int, rounds: int = 400, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and their LP multiplicities covering demand[s-1] items of each size s.

    A revised simplex keeps the inverse of the basis; each knapsack prices a few dozen
    columns, which enter while they improve. It stops when no pattern improves by more
    than `gap`, or all room but that share is used, so the LP value is within that share
    of the optimum.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return []
    basis = [np.eye(m, dtype=np.int64)[i] * (capacity // s) for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ demand[sizes - 1].astype(float)
    floor = float((demand[sizes - 1] * sizes).sum()) / capacity
    pool = np.array([pattern for pattern, _ in first_fit(demand, capacity)])[:, sizes - 1]  # a start near the optimum
    for _ in range(rounds):
        for _ in range(20 * m):
            values = pool @ inverse.sum(0)
            k = int(values.argmax())
            if values[k] <= 1 + gap or x.sum() <= floor * (1 + gap):
                break
            column = pool[k]
            d = inverse @ column
            ratio = np.where(d > 1e-11, x / np.where(d > 1e-11, d, 1), np.inf)
            out = int(ratio.argmin())
            theta = ratio[out]
            x -= theta * d
            x[out] = theta
            np.maximum(x, 0, out=x)
            row = inverse[out] / d[out]
            inverse -= np.outer(d, row)
            inverse[out] = row
            basis[out] = column
        full = np.zeros(capacity)
        full[sizes - 1] = np.maximum(inverse.sum(0), 0)
        new = np.array(price(full, capacity)).reshape(-1, capacity)[:, sizes - 1]
        new = new[new @ inverse.sum(0) > 1 + gap]
        if not len(new) or x.sum() <= floor * (1 + gap):
            break
        pool = np.concatenate((new, pool))[:6000]
    found = []
    for column, count in zip(basis, x, strict=True):
        pattern = np.zeros(capacity, np.int64)
        pattern[sizes - 1] = column
        found.append((pattern, float(count)))
    return found


def plan(demand: np.ndarray, capacity: int = CLASSES) -> list[tuple[np.ndarray, int]]:
    """Whole patterns with multiplicities that hold exactly the demanded items."""
    left = demand.astype(np.int64).copy()
    done = []
    for pattern, count in sorted(column_generation(demand, capacity), key=lambda p: -p[1]):
        n = int(count + 1e-6)
        if n:
            use = pattern > 0
            n = min(n, int((left[use] // pattern[use]).min()))
        if n > 0:
            done.append((pattern, n))
            left -= n * pattern
    return done + first_fit(left, capacity)


def first_fit(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that hold exactly the demanded items, each filled with falling sizes."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        room, pattern = capacity, np.zeros(capacity, np.int64)
        while room and (fits := np.flatnonzero(left[:room] > pattern[:room])).size:
            s = int(fits[-1])
            pattern[s] += min(int(left[s] - pattern[s]), room // (s + 1))
            room -= (s + 1) * int(pattern[s])
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= n * pattern
        out.append((pattern, n))
    return out


def slots(planned: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, int]:
    """Rows (class, first rank, items per sequence, first sequence, items of classes before) by class and rank; and the number of sequences."""
    rows, first, used = [], 0, np.zeros(CLASSES, np.int64)
    for pattern, n in planned:
        before = 0
        for c in np.flatnonzero(pattern):
            rows.append((c, used[c], pattern[c], first, before))
            used[c] += n * pattern[c]
            before += pattern[c]
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), first


def pack(cut: DataFrame) -> DataFrame:
    """Sequence and offset of each piece. `cut` is read several times: give a written table."""
    spark = cut.sparkSession
    kind = F.when(F.col("length") == SEQUENCE, F.lit(CLASSES)).otherwise(F.floor((F.col("length") - 1) / GRID)).cast("int")
    rows = cut.withColumn("class", kind)
    sizes = dict(rows.groupBy("class").count().collect())  # at most CLASSES + 1 rows
    split = [max(LEAST, -(-sizes.get(c, 0) // BUCKET_ROWS)) for c in range(CLASSES + 1)]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.array(*map(F.lit, split))[F.col("class")]).cast("int"))
    counts = rows.groupBy("class", "bucket").agg(F.count("*").alias("n")).toArrow()  # a row a bucket
    first = np.cumsum([0, *split])  # the place of each class's buckets in `lead`
    table = np.zeros(first[-1], np.int64)
    table[first[counts["class"].to_numpy()] + counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    before = np.cumsum(table) - table
    lead = before - np.repeat(before[first[:-1]], split)
    placed, packed = slots(plan(np.array([sizes.get(c, 0) for c in range(CLASSES)])))
    bc = spark.sparkContext.broadcast((first, lead, placed, packed))
    local = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "length", "ids_crc32")) - 1
    ranked = rows.withColumn("rank", local.cast("long"))
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("slot", pa.int64())])

    def assign(batch):
        first, lead, placed, packed = bc.value
        c, b = batch.column("class").to_numpy(), batch.column("bucket").to_numpy()
        rank = batch.column("rank").to_numpy() + lead[first[c] + b]
        seq, slot = packed + rank, np.zeros(len(rank), np.int64)
        small = c < CLASSES
        if small.any():
            key = placed[:, 0] << 44 | placed[:, 1]
            at = np.searchsorted(key, c[small].astype(np.int64) << 44 | rank[small], "right") - 1
            _, start, per, sequence, lower = placed[at].T
            seq[small] = sequence + (rank[small] - start) // per
            slot[small] = lower + (rank[small] - start) % per
        return {n: batch.column(n) for n in PIECES.names} | {"sequence_id": seq, "slot": slot}

    put = ranked.mapInArrow(batches(assign, schema), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0))).drop("slot")


def pack_documents(docs: DataFrame, tokenizer_path: str, encode_special_tokens: bool = True) -> DataFrame:
    """Pieces of docs(doc_id, text) with their sequence and gapless offset there.

    `encode_special_tokens` is the setting of that name in `tokenizers`, false there:
    whether added tokens in a text, such as <|endoftext|>, are ordinary text.
    """
    return pack(materialize(pieces(docs, tokenizer_path, encode_special_tokens=encode_special_tokens)))
