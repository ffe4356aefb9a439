"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions. A context is up to DEPTH preceding bytes; each
context holds a Krichevsky-Trofimov estimator for each of the 255 binary nodes of the
next byte. A node's weighted probability is half its own estimate's plus half the
product of its longer contexts', so all depths are mixed with weights learned from the
training bytes; a text is scored with the weights and counts frozen after training. A
context that a node was never seen in adds nothing: the deepest one it was seen in takes
the rest of the weight. A document ends with byte 255, which UTF-8 never has, and starts
after it.

All contexts of all training bytes are kept, so the tree grows with the corpus. It is
never in one place:

1. Texts are gathered to chunks of about CHUNK bytes. A chunk asks for its distinct
   windows (a context of DEPTH bytes and the next byte), as blobs by bucket. A bucket is a
   hash of the latest DEPTH - 1 bytes, under which there are at most 65,536 windows, so
   no text can make one hot.
2. Each bucket adds up its windows' training counts. The windows of one pair of latest
   bytes then meet in a task, sorted, and give their subtree's weights; only the sums of the
   two upper depths, at most 65,280 nodes, reach the driver.
3. A second pass down the subtrees gives each window's probability. A bucket answers its
   chunks, and a chunk adds up its texts.

Windows that no training text has are asked for like all others, so every byte is scored
by the same rule. A longer text than CHUNK is cut between words, with its context, and its
parts are added up; a word longer than that stays whole.

`score_texts` also gives the unigram word baseline, with exact counts of all words:
words seen in at least 1/KNOWN of the tokens (at most KNOWN of them) are held by every
task, and all other words are looked up by a join.

Null and empty texts are one end token. Without training rows every probability is
uniform and the baseline is that of no counts. Repeated rows count each time. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

DEPTH = 6
KNOWN = 1 << 20
END = 255
CHUNK = 16 << 20
#: Text bytes for each bucket, and the most buckets there are.
BUCKET_BYTES, BUCKETS = 8 << 20, 1 << 14
#: Windows of whole pairs that a task weighs at a time.
SUBTREE_ROWS = 300_000
STEP = 1 << 20
CHUNKS = "chunk long, rows array<long>, ids array<long>, train array<boolean>, last array<boolean>, sizes array<long>, body binary"


def _parts(text: bytes, limit: int) -> Iterator[tuple[int, int]]:
    """Where to cut a text: before white space, at `limit` bytes or the first chance after."""
    a = 0
    while len(text) - a > limit:
        ends = [x for x in (text.find(c, a + limit) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if x > 0]
        if not ends:
            break
        yield a, min(ends)
        a = min(ends)
    yield a, len(text)


def _squeeze(data: bytes) -> bytes:
    """The length and the compressed bytes."""
    return np.int64(len(data)).tobytes() + pa.compress(bytes(data), "zstd", asbytes=True)


def _expand(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), "zstd", asbytes=True)


def chunked(docs: DataFrame, depth: int, limit: int) -> DataFrame:
    """docs(row, doc_id, train, text) as rows of CHUNKS; a body holds each part's bytes after its context, compressed."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    schema = pa.schema(
        [("chunk", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("last", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary())]
    )

    def run(it):
        held, body = [], bytearray()

        def out():
            cols = [[x] for x in zip(*held, strict=True)]
            made = [[0], *cols, [_squeeze(body)]]
            return pa.RecordBatch.from_arrays([pa.array(v, schema.field(k).type) for k, v in zip(names, made, strict=True)], schema=schema)

        for batch in it:
            for row, doc, train, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = (text or "").encode()
                for a, b in _parts(data, limit):
                    done = b == len(data)
                    if a == 0:
                        body += bytes([END]) * depth
                    else:
                        body += data[a - depth : a].rjust(depth, b"\xff")
                    body += data[a:b]
                    if done:
                        body.append(END)
                    held.append((row, doc, train, done, b - a + done))
                    if len(body) >= limit:
                        yield out()
                        held, body = [], bytearray()
        if held:
            yield out()

    made = docs.select("row", "doc_id", "train", "text").mapInArrow(run, CHUNKS)
    return made.withColumn("chunk", F.monotonically_increasing_id())  # the table is written, so that names stay


def _keys(body: np.ndarray, sizes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, their parts) of all coded bytes, in steps: the latest byte of the context highest, the next byte lowest."""
    ends = np.cumsum(sizes + depth)
    for a in range(depth, len(body), STEP):
        b = min(a + STEP, len(body))
        met = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1)
        part = np.repeat(met, np.minimum(ends[met], b) - np.maximum(ends[met] - sizes[met] - depth, a))
        use = np.arange(a, b) >= (ends - sizes)[part]
        key = body[a - 1 : b - 1].astype(np.int64)
        for i in range(2, depth + 1):
            key <<= 8
            key |= body[a - i : b - i]
        key <<= 8
        key |= body[a:b]
        yield key[use], part[use]


def _distinct(body: np.ndarray, sizes: np.ndarray, train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows, and how often training parts have them."""
    marked, at = np.empty(int(sizes.sum()), np.int64), 0
    for k, part in _keys(body, sizes, depth):
        marked[at : at + len(k)] = k << 1 | train[part]
        at += len(k)
    marked.sort()
    first = np.flatnonzero(np.concatenate(([True], marked[1:] != marked[:-1])))
    n = np.diff(np.append(first, len(marked)))
    marked = marked[first]
    return _summed(marked >> 1, n * (marked & 1))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array with the sums of n."""
    if not len(key):
        return key, n
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def _looked_up(k: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The values of k, all of which the sorted keys have; each distinct one is looked up once."""
    order = np.argsort(k)
    k = k[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))[: len(k)]
    found = value[np.searchsorted(key, k[new])]
    each = np.empty(len(k))
    each[order] = found[np.cumsum(new) - 1]
    return each


def _by_bucket(key: np.ndarray, buckets: int, shift: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket that keeps the keys sorted in each; the buckets met, and where they start and end.

    A bucket is a hash of the key without its lowest `shift` bits.
    """
    mixed = (key >> shift).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return order, bucket[first].astype(np.int64), np.append(first, len(bucket))


def _pack(x: np.ndarray) -> bytes:
    """An array's bytes by place, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return _squeeze(planes)


def _unpack(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(_expand(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_keys(key: np.ndarray) -> bytes:
    return _pack(np.diff(key, prepend=np.int64(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.int64))


def _of_chunk(batch: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, sizes, train) of a row of chunks."""
    body = np.frombuffer(_expand(batch.column("body")[i].as_py()), np.uint8)
    return body, np.array(batch.column("sizes")[i].as_py(), np.int64), np.array(batch.column("train")[i].as_py(), np.int64)


def asked_windows(chunks: DataFrame, depth: int, buckets: int) -> DataFrame:
    """(chunk, bucket, keys, n): each chunk's distinct windows with their training counts, in blobs."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                key, n = _distinct(*_of_chunk(batch, i), depth)
                order, met, cut = _by_bucket(key, buckets)
                key, n = key[order], n[order]
                chunk = batch.column("chunk")[i].as_py()
                keys = [_pack_keys(key[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                ns = [_pack(n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(met), pa.int64()), pa.array(met), pa.array(keys, pa.binary()), pa.array(ns, pa.binary())], schema=schema)

    return chunks.select("chunk", "train", "sizes", "body").mapInArrow(run, "chunk long, bucket long, keys binary, n binary")


def _merged(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(ns)
    order = np.argsort(key, kind="stable")
    return _summed(key[order], n[order])


def _added_up(it, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, sums of n) of each value of column `name`, by which the rows with blobs of keys and n come sorted."""
    now, keys, ns, held = None, [], [], 0
    for batch in it:
        for value, k, n in zip(*(batch.column(x).to_pylist() for x in (name, "keys", "n")), strict=True):
            if value != now:
                if keys:
                    yield _merged(keys, ns)
                now, keys, ns, held = value, [], [], 0
            keys.append(_unpack_keys(k))
            ns.append(_unpack(n, np.int64))
            held += len(keys[-1])
            if held > 2_000_000 and held > 2 * len(keys[0]):
                k, n = _merged(keys, ns)
                keys, ns, held = [k], [n], len(k)
    if keys:
        yield _merged(keys, ns)


def window_counts(asked: DataFrame, depth: int, groups: int) -> DataFrame:
    """(pairs, keys, n) of all windows, added up bucket by bucket; in blobs by a hash of the two latest bytes."""
    schema = pa.schema([("pairs", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])

    def run(it):
        for key, n in _added_up(it, "bucket"):
            order, met, cut = _by_bucket(key, groups, 8 * (depth - 1))
            key, n = key[order], n[order]
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array([_pack_keys(key[a:b]) for a, b in spans], pa.binary()), pa.array([_pack(n[a:b]) for a, b in spans], pa.binary())], schema=schema)

    return asked.select("bucket", "keys", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "pairs long, keys binary, n binary")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x > 0: the recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift * y, shift)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y - np.log(shift)


_HALVES = _lgamma(np.arange(1 << 14) + 0.5)
_WHOLES = _lgamma(np.arange(1 << 14) + 1.0)


def _at(table: np.ndarray, n: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1)]
    big = np.flatnonzero(n >= len(table))
    if len(big):
        out[big] = _lgamma(n[big] + add)
    return out


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return _at(_HALVES, a, 0.5) + _at(_HALVES, b, 0.5) - _at(_WHOLES, a + b, 1.0) - math.log(math.pi)


class Nodes:
    """The binary nodes of one depth and bit: their name (context and leading bits), counts and own estimate."""

    def __init__(self, key: np.ndarray, n: np.ndarray, bit: int) -> None:
        name = key >> (8 - bit)
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        self.name = name[first]
        self.first = first
        self.of = np.cumsum(np.bincount(first, minlength=len(key))) - 1  # the node of each (context, byte)
        self.total = np.add.reduceat(n, first)
        self.ones = np.add.reduceat(n * (key >> (7 - bit) & 1), first)
        self.own = _log_kt(self.total - self.ones, self.ones)

    def weigh(self, below: np.ndarray | None) -> None:
        """The weighted probability from that of all longer contexts (none at the last depth)."""
        if below is None:
            self.weighted, self.share = self.own, np.ones(len(self.own))
        else:
            self.weighted = np.logaddexp(self.own, below) - math.log(2)
            self.share = np.exp(self.own - math.log(2) - self.weighted)

    def descend(self, lead: np.ndarray, sofar: np.ndarray) -> None:
        """Take what the path above leaves: its weight for this depth and deeper, and its share of the probability of a one."""
        one = (self.ones + 0.5) / (self.total + 1)
        self.final = sofar + lead * one
        self.lead, self.sofar = lead * (1 - self.share), sofar + lead * self.share * one


def _unseen(total: np.ndarray, lead: np.ndarray, sofar: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lead, sofar) of nodes: where there are no counts, nothing is left and the parent's estimate stands."""
    return np.where(total > 0, lead, 0.0), np.where(total > 0, sofar, final)


class Levels:
    """The contexts of depths `top` to `depth` over sorted windows, each shorter depth summed from the next."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, top: int) -> None:
        self.depth, self.top = depth, top
        self.keys, self.ns, self.up = {depth: key}, {depth: n}, {}
        for d in range(depth - 1, top - 1, -1):
            shorter = self.keys[d + 1] >> 16 << 8 | (self.keys[d + 1] & 255)
            self.keys[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            self.ns[d] = np.bincount(self.up[d + 1], self.ns[d + 1], len(self.keys[d])).astype(np.int64)

    def nodes(self, bit: int, below: np.ndarray | None = None) -> dict[int, Nodes]:
        """The weighed nodes of all depths; `below` is what lies under the last one, if anything does."""
        made = {}
        for d in range(self.depth, self.top - 1, -1):
            made[d] = node = Nodes(self.keys[d], self.ns[d], bit)
            if d < self.depth:
                child = made[d + 1]
                child.parent = node.of[self.up[d + 1][child.first]]
                below = np.bincount(child.parent, child.weighted, len(node.name))
            node.weigh(below)
        return made


def upper_sums(key: np.ndarray, n: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """For each bit and node of depth 1: the log of what its contexts of depth 2 make together; and the counts of (byte, byte)."""
    levels = Levels(key, n, depth, 1)
    bits, names, below = [], [], []
    for bit in range(8):
        made = levels.nodes(bit)
        names.append(made[1].name)
        below.append(np.bincount(made[2].parent, made[2].weighted, len(made[1].name)))
        bits.append(np.full(len(made[1].name), bit))
    for x in (levels.keys[1],):
        names.append(x)
        below.append(levels.ns[1].astype(float))
        bits.append(np.full(len(x), 8))
    return {"bit": np.concatenate(bits), "name": np.concatenate(names), "value": np.concatenate(below)}


class Upper:
    """Depths 0 and 1, from the sums of all tasks: what each node of depth 1 leaves for its longer contexts."""

    def __init__(self, bit: np.ndarray, name: np.ndarray, value: np.ndarray) -> None:
        at = bit == 8
        order = np.argsort(name[at])
        key, n = name[at][order], np.rint(value[at][order]).astype(np.int64)
        self.levels = []
        if not len(key):
            return
        both = Levels(key, n, 1, 0)
        for b in range(8):
            here = bit == b
            o = np.argsort(name[here])
            made = both.nodes(b, value[here][o])
            root, first = made[0], made[1]
            root.descend(np.ones(len(root.name)), np.zeros(len(root.name)))
            p = first.parent
            first.descend(*_unseen(first.total, root.lead[p], root.sofar[p], root.final[p]))
            self.levels.append((first.name, first.lead, first.sofar, first.final))


def window_logs(key: np.ndarray, n: np.ndarray, depth: int, upper: Upper) -> np.ndarray:
    """log10 probability of each window's next byte in its context."""
    levels = Levels(key, n, depth, 2)
    out = np.zeros(len(key))
    for bit in range(8):
        made = levels.nodes(bit)
        names, lead, sofar, final = upper.levels[bit]
        top = made[2]
        first = levels.keys[2][top.first]
        at = np.searchsorted(names, (first >> 16 << 8 | (first & 255)) >> (8 - bit))
        top.descend(*_unseen(top.total, lead[at], sofar[at], final[at]))
        for d in range(3, depth + 1):
            node, up = made[d], made[d - 1]
            p = node.parent
            node.descend(*_unseen(node.total, up.lead[p], up.sofar[p], up.final[p]))
        one = made[depth].final[made[depth].of]
        out += np.log10(np.where(key >> (7 - bit) & 1, one, 1 - one))
    return out


def _by_pairs(windows: DataFrame, depth: int, work, schema: pa.Schema, ddl: str) -> DataFrame:
    """work(keys, counts) -> columns over sorted windows, whole pairs of latest bytes at a time."""
    pair = 8 * (depth - 1)

    def run(it):
        keys, ns, held = [], [], 0

        def done(keys, ns):
            key, n = _merged(keys, ns)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] >> pair != key[:-1] >> pair)))
            at = 0
            while at < len(key):
                i = int(np.searchsorted(starts, at + SUBTREE_ROWS))
                end = int(starts[i]) if i < len(starts) else len(key)
                cols = work(key[at:end], n[at:end])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for f, x in zip(schema, cols, strict=True)], schema=schema)
                at = end

        for key, n in _added_up(it, "pairs"):
            keys.append(key)
            ns.append(n)
            held += len(key)
            if held >= SUBTREE_ROWS:
                yield from done(keys, ns)
                keys, ns, held = [], [], 0
        if keys:
            yield from done(keys, ns)

    return windows.repartition("pairs").sortWithinPartitions("pairs").mapInArrow(run, ddl)


def learn(windows: DataFrame, depth: int) -> Upper:
    """The two upper depths of the tree over windows, a written table."""
    schema = pa.schema([("bit", pa.int64()), ("name", pa.int64()), ("value", pa.float64())])
    sums = _by_pairs(windows, depth, lambda k, n: upper_sums(k, n, depth).values(), schema, "bit long, name long, value double")
    t = sums.groupBy("bit", "name").agg(F.sum("value").alias("value")).toArrow()  # at most 65,280 nodes and 65,536 counts
    return Upper(*(t[x].to_numpy() for x in ("bit", "name", "value")))


def window_scores(windows: DataFrame, depth: int, upper: Upper, buckets: int) -> DataFrame:
    """(bucket, keys, logs): log10 probabilities of all windows, in blobs."""
    schema = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("logs", pa.binary())])
    bc = windows.sparkSession.sparkContext.broadcast(upper)

    def work(key, n):
        logs = window_logs(key, n, depth, bc.value).astype(np.float32)
        order, met, cut = _by_bucket(key, buckets)
        key, logs = key[order], logs[order]
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        return met, [_pack_keys(key[a:b]) for a, b in spans], [_pack(logs[a:b]) for a, b in spans]

    return _by_pairs(windows, depth, work, schema, "bucket long, keys binary, logs binary")


def answers(asked: DataFrame, scores: DataFrame) -> DataFrame:
    """(chunk, bucket, logs): what each chunk asked for, in its order. A task holds one bucket's scores, and passes over its chunks."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("logs", pa.binary())])
    both = asked.select("bucket", "chunk", "keys", F.lit(None).cast("binary").alias("logs")).unionByName(scores.select("bucket", F.lit(None).cast("long").alias("chunk"), "keys", "logs"))

    def run(it):
        now, parts, key, logs = None, [], None, None
        for batch in it:
            made = []
            for bucket, chunk, k, given in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now:
                    now, parts, key = bucket, [], None
                if chunk is None:
                    parts.append((_unpack_keys(k), _unpack(given, np.float32)))
                    continue
                if key is None:
                    key, logs = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(key)
                    key, logs, parts = key[order], logs[order], []
                made.append((chunk, bucket, _pack(logs[np.searchsorted(key, _unpack_keys(k))])))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for f, x in zip(schema, zip(*made, strict=True), strict=True)], schema=schema)

    return both.repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first()).mapInArrow(run, "chunk long, bucket long, logs binary")


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.lower().split()


def _part_texts(batch: pa.RecordBatch | pa.Table, i: int, depth: int) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether it ends its text) of a chunk's parts."""
    body, at = _expand(batch.column("body")[i].as_py()), 0
    for size, last in zip(batch.column("sizes")[i].as_py(), batch.column("last")[i].as_py(), strict=True):
        at += depth + size
        yield body[at - size : at - last], last


def word_counts(chunks: DataFrame, depth: int) -> DataFrame:
    """(word, n) over the training parts of chunks, as binary words; the end token has the empty word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(it):
        c: Counter = Counter()
        for batch in it:
            for i in range(batch.num_rows):
                for (t, last), train in zip(_part_texts(batch, i, depth), batch.column("train")[i].as_py(), strict=True):
                    if train:
                        c.update(tokens(t))
                        c[b""] += last
                if len(c) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], schema=schema)
                    c.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], schema=schema)

    return chunks.select("train", "last", "sizes", "body").mapInArrow(run, "word binary, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, train_where, depth: int = DEPTH, known: int = KNOWN, chunk: int = CHUNK) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, token counts, word baseline and model score, in log10, and bits per byte.

    depth: bytes of the longest context, 2 to 6. chunk: bytes of text that a task scores at a time.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), train_where.alias("train"), F.col("text").cast("string").alias("text"))
    chunks = materialize(chunked(rows, depth, chunk), rows_per_file=8)
    size = chunks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    buckets = min(BUCKETS, max(16, size // BUCKET_BYTES))
    asked = materialize(asked_windows(chunks, depth, buckets))
    windows = materialize(window_counts(asked, depth, buckets))
    answered = answers(asked, window_scores(windows, depth, learn(windows, depth), buckets))

    counts = materialize(word_counts(chunks, depth))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("n") * known >= total).toArrow()  # at most `known` words
    bc = sc.broadcast(dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))])
    shift = math.log10(total + 0.5 * (distinct + 1))

    def run(left, right):
        logs = {w: math.log10(n + 0.5) for w, n in bc.value.items()}
        body, sizes, train = _of_chunk(left, 0)
        key, _ = _distinct(body, sizes, train, depth)
        order, met, cut = _by_bucket(key, buckets)
        given = dict(zip(right["bucket"].to_pylist(), right["logs"].to_pylist(), strict=True))
        value = np.empty(len(key), np.float32)
        for bucket, a, b in zip(met.tolist(), cut[:-1], cut[1:], strict=True):
            value[order[a:b]] = _unpack(given[bucket], np.float32)
        score = np.zeros(len(sizes))
        for k, part in _keys(body, sizes, depth):
            score += np.bincount(part, _looked_up(k, key, value), len(sizes))
        n_tokens, n_known, base, rare = [], [], [], []
        for t, last in _part_texts(left, 0, depth):
            words = tokens(t)
            if last:
                words.append(b"")
            found = list(map(logs.get, words))
            n_tokens.append(len(words))
            missing: Counter = Counter()
            if None in found:
                missing = Counter(w for w, x in zip(words, found, strict=True) if x is None)
                found = [x for x in found if x is not None]
            rare.append([{"word": w, "k": n} for w, n in missing.items()])
            n_known.append(len(found))
            base.append(math.fsum(found))
        cols = [left["rows"][0].as_py(), left["ids"][0].as_py(), train == 0, n_tokens, sizes, n_known, base, score, rare]
        return pa.Table.from_arrays([pa.array(x, f.type) for f, x in zip(schema, cols, strict=True)], schema=schema)

    ddl = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, score double, rare array<struct<word:binary,k:long>>"
    parts = materialize(chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, ddl))
    discard(asked, windows, chunks)
    scored = parts.groupBy("row", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_bytes", "n_known", "base", "score")))
    looked = parts.select("row", F.inline("rare")).join(counts.where(F.col("n") * known < total), "word", "left")
    none = math.log10(0.5)
    extra = looked.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.coalesce(F.log10(F.col("n") + 0.5), F.lit(none))).alias("more"))
    out = scored.join(extra, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * shift).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
