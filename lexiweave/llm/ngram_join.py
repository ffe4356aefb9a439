"""Jaccard self-join of documents' word n-gram sets, by vertical partitioning.

A document's set is its distinct 5-word shingles (64-bit hashes of the lower-cased
words; two shingles of a corpus of 10^9 collide with odds of about 3 in 100, which would
move one intersection by one). All shingles have one global order: the FREQUENT most
frequent ones, of those that a first pass saw twice or more within a task, come last, by
their counts; the rest by hash. The order is cut into FRAGMENTS ranges.

1. Documents with equal sets are one class, named by a 64-bit signature; classes that share
   one but differ in a second 64-bit signature get other names.
2. Two sets with Jaccard >= t share a shingle in the first (1 - t) |x| + 1 of each, so the
   classes meet on their prefix shingles. Up to the end of the prefix that ends first all
   common shingles are then known, and the rest of that set bounds those to come: pairs
   that cannot reach the overlap go before any set is read.
3. Overlaps are counted by fragment: each fragment of a set goes to a task of its own, which
   counts the pairs' partial overlaps there; a shuffle sums them per pair.
4. Classes on lists of more than DENSE (large groups of near copies) are joined into groups
   instead of pairs. A group's hub is compared with each member, then a hub of the members
   that are still alone with these, HUBS times. What is still apart then is compared across
   in blocks, again by fragment; a block leaves out pairs whose sizes, or whose difference in
   the fragment alone, rule a link out. So no list is expanded into all its pairs, and no
   link between components is lost.
5. Links become components by label propagation over written tables. Keys with many rows
   (copies, hubs, roots of large components) are joined by broadcast: there are at most
   HOT_KEYS of them.

Null, empty and word-less texts have an empty set and link with nothing; fewer than five
words are one shingle. Repeated rows are exact copies. Ties have no effect. An empty table
gives no rows. A text of any length is one value of its column; its set is read in
fragments. Other columns are not read, but for the one named as `row`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, discard, materialize, text_slices

WIDTH, PERCENT = 5, 80
#: Ranges of the order: half of them among the frequent shingles.
FRAGMENTS = 8
#: Lists of more classes are handled by hubs and blocks.
DENSE = 64
#: Members a side of a block, shingles of all sets a task compares at once, and rounds of hubs.
BLOCK, SHINGLES, HUBS = 512, 1_000_000, 3
#: At most so many frequent shingles are known to all tasks; those seen most often.
FREQUENT = 200_000
#: Keys with more than HOT rows, and more than a share of 1 / HOT_KEYS, are joined by broadcast.
HOT, HOT_KEYS = 1000, 2000
#: Tasks over which the list of one frequent shingle is dealt.
SALTS = 64
BITS = 1 << 25

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(1 << 63)
_WORD = np.zeros(256, bool)
_WORD[:] = True
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row one after the other, row offsets in them)."""
    rows = len(offsets) - 1
    low = _LOWER[data]
    word = _WORD[low]
    row_start = np.zeros(len(low) + 1, bool)
    row_start[offsets[:-1]] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | row_start[1:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    # a word's hash: the sum of its bytes' random values times powers of the base by place in the word
    number = np.cumsum(start) - 1
    place = (np.arange(len(low)) - at[np.maximum(number, 0)])[word]
    powers = np.ones(int(place.max()) + 2, np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers)
    values = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    terms = values[low[word]] * powers[place]
    first = np.flatnonzero(start[word])
    h = _mix(np.add.reduceat(terms, first) + _BASE)
    n_words = np.diff(np.searchsorted(at, offsets))
    row = np.repeat(np.arange(rows), n_words)
    n = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    full = np.zeros(len(h), bool)
    if len(h) >= width:
        full[: len(h) - width + 1] = row[: len(h) - width + 1] == row[width - 1 :]
    k = np.flatnonzero(full)
    s = h[k]
    for i in range(1, width):
        s = _mix(s * _BASE + h[k + i])
    owner = row[k]
    for r in np.flatnonzero((n_words > 0) & (n_words < width)):
        x = n_words[r : r + 1].astype(np.uint64)
        for y in h[row == r]:
            x = _mix(x * _BASE + y)
        s, owner = np.append(s, x), np.append(owner, r)
    o = np.lexsort((s, owner))
    s, owner = s[o], owner[o]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(rows + 1))


def _signature(sets: np.ndarray, at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, 0 for the empty one. A first name in `shared` is mixed with the second."""
    n = np.diff(at).astype(np.uint64)
    names = []
    for seed in (_BASE, _BASE >> np.uint64(1)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(sets + seed), dtype=np.uint64)))
        names.append(np.where(n > 0, _mix((total[at[1:]] - total[at[:-1]]) ^ _mix(n)) | np.uint64(1), np.uint64(0)))
    first, second = names
    if len(shared):
        both = np.isin(first, shared)
        first = np.where(both, _mix(first ^ _mix(second)) | np.uint64(1), first)
    return first.view(np.int64), second.view(np.int64)


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _ordered(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set's places in the global order, ascending: 63 bits of the hash, or the top bit and the rank of a frequent one."""
    known, rank = frequent
    keys = s >> np.uint64(1)
    if not len(known):
        return keys
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    often = known[at] == s
    return np.concatenate((keys[~often], np.sort(rank[at[often]]) | _TOP)) if often.any() else keys


def _cuts(places: np.ndarray, n_frequent: int) -> np.ndarray:
    """Where each fragment of ascending places starts, and their end."""
    half = FRAGMENTS // 2
    pivots = [np.uint64(i * ((1 << 63) // half)) for i in range(half)] + [_TOP | np.uint64(i * n_frequent // half) for i in range(half)]
    return np.append(np.searchsorted(places, np.array(pivots, np.uint64)), len(places))


def _column(batch: pa.RecordBatch, text: int = 1):
    for a, b, data, offsets in text_slices(batch.column(text)):
        yield a, b, *shingle_sets(data, offsets)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def _classes(docs: DataFrame, row: str | None, shared: np.ndarray) -> DataFrame:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("sig", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def run(batch):
        for a, b, s, at in _column(batch, 2):
            sig, other = _signature(s, at, shared)
            yield {"row": batch.column(0).slice(a, b - a), "doc_id": batch.column(1).slice(a, b - a), "sig": sig, "other": other, "n": np.diff(at)}

    rows = docs.select((F.col(row) if row else F.lit(0)).cast("long").alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches(run, schema), "row long, doc_id long, sig long, other long, n long")


def _frequent(docs: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, their ranks, the rarest 0) of prefix shingles that occur twice or more within a task's rows: at most FREQUENT, those with the largest sums."""
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64())])
    none = np.zeros(0, np.uint64)

    def run(it):
        kept, held = [], 0

        def out():
            u, c = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u[c > 1].view(np.int64)), pa.array(c[c > 1])], schema=schema)

        for batch in it:
            for _, _, s, at in _column(batch):
                parts, seen = [], set()
                for i, j, g in zip(at[:-1], at[1:], _signature(s, at, none)[0].tolist(), strict=True):
                    if j > i and g not in seen:
                        seen.add(g)
                        parts.append(s[i : i + _prefix(j - i, percent)])
                if parts:
                    kept.append(np.concatenate(parts))
                    held += len(kept[-1])
                if held > 2_000_000:
                    yield out()
                    kept, held = [], 0
        if kept:
            yield out()

    top = _documents(docs).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "hash").limit(FREQUENT).select("hash").toArrow()
    if not top.num_rows:
        return none, none
    hashes = top["hash"].to_numpy().view(np.uint64)
    o = np.argsort(hashes)
    return hashes[o], (len(hashes) - 1 - o).astype(np.uint64)


def _postings(docs: DataFrame, frequent, shared: np.ndarray, percent: int) -> DataFrame:
    """(place, sig, nl) of the prefix shingles of each class; nl: size times 2^32 plus the upper half of the prefix's last place. A frequent shingle's place is negative."""
    schema = pa.schema([("place", pa.int64()), ("sig", pa.int64()), ("nl", pa.int64())])

    def run(it):
        often, done = frequent.value, set()

        def each(batch):
            for _, _, s, at in _column(batch):
                hs, gs, ps = [], [], []
                for i, j, g in zip(at[:-1], at[1:], _signature(s, at, shared)[0].tolist(), strict=True):
                    n = int(j - i)
                    if n and g not in done:
                        done.add(g)
                        k = _prefix(n, percent)
                        prefix = _ordered(s[i:j], often)[:k]
                        hs.append(prefix)
                        gs.append(np.full(k, g))
                        ps.append(np.full(k, (n << 32) + (int(prefix[-1]) >> 32)))
                if hs:
                    yield {"place": np.concatenate(hs).view(np.int64), "sig": np.concatenate(gs), "nl": np.concatenate(ps)}

        yield from batches(each, schema)(it)

    return _documents(docs).mapInArrow(run, "place long, sig long, nl long")


def _sets(docs: DataFrame, ids: DataFrame, frequent, shared: np.ndarray) -> DataFrame:
    """(sig, places, cut) of the classes in ids(doc_id, sig), read anew from the texts; cut: where each fragment of the ascending places starts, and their end.

    A Bloom filter of BITS bits, whatever the input's size, spares most other documents.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    words = ids.select((place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {BITS}) % 64 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    if got.num_rows:
        bits[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    bc = spark.sparkContext.broadcast(bits)
    schema = pa.schema([("sig", pa.int64()), ("places", pa.list_(pa.int64())), ("cut", pa.list_(pa.int32()))])

    def run(it):
        words, often, done = bc.value, frequent.value, set()

        def each(batch):
            at = batch.column(2).to_numpy()
            may = (words[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
            if not may.any():
                return
            batch = batch.filter(pa.array(may))
            for _, _, s, off in _column(batch):
                sigs, cuts, ends, parts = [], [], [0], []
                for i, j, g in zip(off[:-1], off[1:], _signature(s, off, shared)[0].tolist(), strict=True):
                    if i == j or g in done:
                        continue
                    done.add(g)
                    places = _ordered(s[i:j], often)
                    sigs.append(g)
                    cuts.append(_cuts(places, len(often[0])))
                    ends.append(ends[-1] + len(places))
                    parts.append(places)
                if parts:
                    yield {"sig": sigs, "places": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64))), "cut": cuts}

        yield from batches(each, schema)(it)

    return _documents(docs).withColumn("at", place).mapInArrow(run, "sig long, places array<long>, cut array<int>")


def _hot(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key) of more than HOT rows and a share of 1 / HOT_KEYS: at most HOT_KEYS keys, fetched and sent on as a small table."""
    spark = rows.sparkSession
    found = rows.groupBy(key).count().where(F.col("count") > max(HOT, total // HOT_KEYS)).select(key).toArrow() if total > HOT else None
    return spark.createDataFrame(found) if found is not None and found.num_rows else spark.createDataFrame([], f"{key} long")


def _spread(rows: DataFrame, key: str, unique: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table whose `key` is unique; rows of hot keys stay where they are and meet a broadcast of their few partners."""
    if hot.isEmpty():
        return rows.join(unique, key, how)
    few = F.broadcast(hot)
    cold = rows.join(few, key, "left_anti").join(unique, key, how)
    warm = rows.join(few, key, "left_semi").join(F.broadcast(unique.join(few, key, "left_semi")), key, how)
    return cold.unionByName(warm)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach, by neighbour minima and pointer jumping over written tables."""
    both = links.select("a", "b").where("a != b")
    edges = materialize(both.union(both.select("b", "a")).distinct())
    total = edges.count()
    hubs = _hot(edges, "b", total)
    roots = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = _spread(edges, "b", roots.select(F.col("node").alias("b"), "root"), hubs).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = materialize(roots.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "m").alias("via")))
        jump = step.select(F.col("node").alias("via"), F.col("via").alias("far"))
        moved = materialize(_spread(step, "via", jump, _hot(step, "via", total), "left").select("node", "was", F.least("via", "far").alias("root")))
        changed = moved.where("was != root").limit(1).count()
        discard(step, roots)
        roots = moved.select("node", "root")
        roots.scratch = moved.scratch
        if not changed:
            discard(edges)
            return roots


def _linked(n: str | Column, m: str | Column, overlap: str | Column, percent: int) -> Column:
    n, m, overlap = (F.col(x) if isinstance(x, str) else x for x in (n, m, overlap))
    return overlap * 100 >= (n + m - overlap) * percent


PARTIAL = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("partial", pa.int64())])
_PARTIAL = "a long, b long, na long, nb long, partial long"


def _summed(partial: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose partial overlaps add up to a link."""
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap")).where(_linked("na", "nb", "overlap", percent)).select("a", "b")


def _counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, of pairs(g, a, b, na, nb): partial overlaps by fragment, summed per pair.

    Pairs of one g are counted together, so a set is sent once for all of them; a g of more
    than SHINGLES shingles is cut into blocks of pairs, and small ones share a task.
    """
    members = pairs.select("g", F.explode(F.array(F.struct(F.col("a").alias("sig"), F.col("na").alias("n")), F.struct(F.col("b").alias("sig"), F.col("nb").alias("n")))).alias("x")).select("g", "x.*").distinct()
    sizes = materialize(members.groupBy("g").agg(F.sum("n").alias("all")))
    whole = sizes.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    large = sizes.select("g", F.ceil(F.col("all") / SHINGLES).alias("k")).where("k > 1")  # a small table: at most whole / SHINGLES rows
    small = F.pmod(F.xxhash64("g"), F.lit(max(1, whole // SHINGLES)))
    cut = _spread(pairs, "g", large, _hot(pairs, "g", pairs.count()), "left")
    key = F.when(F.col("k").isNull(), F.xxhash64(small)).otherwise(F.xxhash64("g", F.pmod(F.xxhash64("a"), "k"), F.pmod(F.xxhash64("b"), "k")))
    keyed = materialize(cut.select(key.alias("task"), "a", "b", "na", "nb"))
    needs = keyed.select("task", F.explode(F.array("a", "b")).alias("sig")).distinct()
    parts = F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda f: F.slice("places", F.col("cut")[f] + 1, F.col("cut")[f + 1] - F.col("cut")[f]))
    right = needs.join(sets, "sig").select(F.col("task").alias("t2"), "sig", F.posexplode(parts).alias("f2", "part")).where(F.size("part") > 0)
    left = keyed.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(right["sig"].to_pylist(), (x.values.to_numpy().view(np.uint64) for x in right["part"]), strict=True))
        a, b = left["a"].to_pylist(), left["b"].to_pylist()
        found = np.zeros(len(a), np.int64)
        none = np.zeros(0, np.uint64)
        for i, (u, v) in enumerate(zip(a, b, strict=True)):
            x, y = held.get(u, none), held.get(v, none)
            if len(x) and len(y):
                found[i] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
        return left.select(["a", "b", "na", "nb"]).append_column("partial", pa.array(found)).filter(pa.array(found > 0)).cast(PARTIAL)

    partial = left.groupBy("task", "fragment").cogroup(right.groupBy("t2", "f2")).applyInArrow(count, _PARTIAL)
    return materialize(_summed(partial, percent))


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each group: members(g, sig, n, part_of).

    Those outside the group's largest component are compared with all of other components
    in blocks, fragment after fragment. Members are cut by size first, as sets link only with
    sets of like size. Here a block adds the partial overlaps up itself and returns a spanning
    forest: sent to a shuffle, those of near copies would be all pairs of a group.
    """
    tally = members.groupBy("g", "part_of").agg(F.count("*").alias("many"))
    tops = tally.groupBy("g").agg(F.max(F.struct("many", "part_of")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("g", F.col("top.part_of").alias("largest"))
    tops = materialize(tops)
    members = members.join(tops, "g", "left_semi") if tops.isEmpty() else _spread(members, "g", tops, _hot(members, "g", members.count()))
    # sizes in classes whose bounds grow by 100 / percent: a link spans neighbouring classes at most
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    cell = lambda d: F.xxhash64("g", F.col("size") + F.lit(d))
    if tops.isEmpty():
        return members.select(F.col("sig").alias("a"), F.col("sig").alias("b"))
    rows = members.select("g", "sig", "n", "part_of", (F.col("part_of") != F.col("largest")).alias("probe"), size.alias("size"))
    rows = materialize(rows.withColumn("cell", cell(0)))
    blocks = rows.groupBy("cell").agg(F.ceil(F.sum(F.col("probe").cast("long")) / BLOCK).alias("pn"), F.ceil(F.count("*") / (4 * BLOCK)).alias("mn"))
    blocks = materialize(blocks)
    total = rows.count()
    hot = _hot(rows, "cell", total)
    # each probe block meets the member blocks of its own size class and the two beside it
    near = lambda x: x.select("*", F.explode(F.array(*(F.struct(cell(d).alias("to"), F.lit(d).alias("d")) for d in (-1, 0, 1)))).alias("x")).select("*", "x.to", "x.d").drop("x")
    to = lambda c: blocks.select(F.col("cell").alias("to"), c)
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    probes = near(_spread(rows.where("probe"), "cell", blocks.select("cell", "pn"), hot).withColumn("p", F.pmod(F.xxhash64("sig"), "pn")))
    others = near(_spread(rows, "cell", blocks.select("cell", "mn"), hot).withColumn("m", F.pmod(F.xxhash64("sig", F.lit(1)), "mn")))
    probes = _spread(probes, "to", to("mn"), _hot(probes, "to", total)).select("*", up_to("mn").alias("m")).select(F.xxhash64("cell", "p", "to", "m").alias("task"), "sig", "n", "part_of", F.lit(True).alias("probe"))
    others = _spread(others, "to", to("pn").where("pn > 0"), _hot(others, "to", total)).select("*", up_to("pn").alias("p")).select(F.xxhash64("to", "p", "cell", "m").alias("task"), "sig", "n", "part_of", F.lit(False).alias("probe"))
    work = probes.unionByName(others).join(sets, "sig")

    def compare(table: pa.Table) -> pa.Table:
        probe = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
        # a copy or two of a row do no harm
        places, cut = (table.column(c).combine_chunks() for c in ("places", "cut"))
        values, start = places.values.to_numpy(), places.offsets.to_numpy().astype(np.int64)
        cut = cut.values.to_numpy()[cut.offsets[0].as_py() : cut.offsets[-1].as_py()].reshape(-1, FRAGMENTS + 1).astype(np.int64)
        sides = []
        for side in (probe, ~probe):
            at = np.flatnonzero(side)
            sig, first = np.unique(table.column("sig").to_numpy()[at], return_index=True)
            sides.append((sig, table.column("n").to_numpy()[at][first], table.column("part_of").to_numpy()[at][first], at[first]))
        (sig, n, own, at), (sig2, n2, own2, at2) = sides
        out_a, out_b = [], []
        if len(sig) and len(sig2):
            overlap, differ = np.zeros((len(sig), len(sig2)), np.int64), np.zeros((len(sig), len(sig2)), np.int64)
            apart = own[:, None] == own2[None, :]
            for f in range(FRAGMENTS):
                held, held2 = (cut[x, f + 1] - cut[x, f] for x in (at, at2))
                rows, rows2 = (np.concatenate([values[start[i] + cut[i, f] : start[i] + cut[i, f + 1]] for i in x]) for x in (at, at2))
                met = overlaps(rows, np.repeat(np.arange(len(at)), held), len(at), rows2, np.repeat(np.arange(len(at2)), held2), len(at2))
                overlap += met
                differ += held[:, None] + held2[None, :] - 2 * met  # at most this share of all may differ in a link
                apart |= (100 + percent) * differ > (100 - percent) * (n[:, None] + n2[None, :])
                if apart.all():
                    break
            links = ~apart & (overlap * 100 >= (n[:, None] + n2[None, :] - overlap) * percent)
            parent: dict = {}
            for i, j in zip(*np.nonzero(links), strict=True):  # a spanning forest of the components that meet
                x, y = own[i].item(), own2[j].item()
                while parent.get(x, x) != x:
                    parent[x] = parent.get(parent[x], parent[x])
                    x = parent[x]
                while parent.get(y, y) != y:
                    parent[y] = parent.get(parent[y], parent[y])
                    y = parent[y]
                if x != y:
                    parent[x] = y
                    out_a.append(sig[i])
                    out_b.append(sig2[j])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return materialize(work.groupBy("task").applyInArrow(compare, "a long, b long"))


def overlaps(x: np.ndarray, of: np.ndarray, rows: int, y: np.ndarray, of2: np.ndarray, rows2: int) -> np.ndarray:
    """How many values each row of one side shares with each of the other: x[k] belongs to row of[k].

    Values that many rows of both sides hold are counted by matrix products, the others pair by pair.
    """
    u = np.intersect1d(x, y)
    out = np.zeros((rows, rows2), np.int64)
    if not len(u):
        return out
    place = lambda v: np.minimum(np.searchsorted(u, v), len(u) - 1)
    i, j = place(x), place(y)
    i, of, j, of2 = i[u[i] == x], of[u[i] == x], j[u[j] == y], of2[u[j] == y]
    many, many2 = np.bincount(i, minlength=len(u)), np.bincount(j, minlength=len(u))
    heavy = many * many2 > 4000
    dense = np.flatnonzero(heavy)
    column = np.full(len(u), -1)
    for k in range(0, len(dense), 2048):
        part = dense[k : k + 2048]
        column[part] = np.arange(len(part))
        m, m2 = np.zeros((rows, len(part)), np.float32), np.zeros((rows2, len(part)), np.float32)
        use, use2 = column[i] >= 0, column[j] >= 0
        m[of[use], column[i[use]]] = 1
        m2[of2[use2], column[j[use2]]] = 1
        out += np.rint(m @ m2.T).astype(np.int64)
        column[part] = -1
    light, light2 = ~heavy[i], ~heavy[j]
    i, of, j, of2 = i[light], of[light], j[light2], of2[light2]
    o = np.argsort(j, kind="stable")
    j, of2 = j[o], of2[o]
    low, count = np.searchsorted(j, i), many2[i]
    ends = np.cumsum(count)
    k = 0
    while k < len(i):
        done = ends[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, done + 4_000_000, "right")))
        c = count[k:stop]
        at = np.repeat(low[k:stop] - np.cumsum(c) + c, c) + np.arange(c.sum())
        out += np.bincount(np.repeat(of[k:stop], c) * rows2 + of2[at], minlength=rows * rows2).reshape(rows, rows2)
        k = stop
    return out


def _groups(members: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of the links that join the components of groups; members(g, sig, n, shared)."""
    links, alone = [], members
    settled = None  # (sig, part_of)
    for _ in range(HUBS):
        hub = alone.groupBy("g").agg(F.max(F.struct("shared", "n", "sig")).alias("h"), F.count("*").alias("many")).where("many > 1").select("g", F.col("h.sig").alias("a"), F.col("h.n").alias("na"))
        hub = materialize(hub)  # a row a group
        total = alone.count()
        pairs = _spread(alone, "g", hub, _hot(alone, "g", total)).where("sig != a").select("g", "a", F.col("sig").alias("b"), "na", F.col("n").alias("nb"))
        found = _counted(pairs, sets, percent)
        links.append(found)
        star = found.select(F.col("b").alias("sig"), F.col("a").alias("part_of")).union(hub.select(F.col("a").alias("sig"), F.col("a").alias("part_of")))
        settled = materialize(star if settled is None else settled.union(star))
        alone = materialize(alone.join(settled.select("sig"), "sig", "left_anti"))
        if alone.isEmpty():
            break
    apart = materialize(members.join(settled, "sig", "left").select("g", "sig", "n", F.coalesce("part_of", "sig").alias("part_of")))
    return [*links, _across(apart, sets, percent)]


def grouped(docs: DataFrame, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> row (the column of that name; else 0), doc_id, n (size of the set), root (one value a component; 0 for empty sets), component_id."""
    spark = docs.sparkSession
    classes = materialize(_classes(docs, row, np.zeros(0, np.uint64)))
    names = classes.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.min("other").alias("low"), F.max("other").alias("high"))
    names = materialize(names)
    # names that two sets share: 2^-65 times the number of pairs of classes, so a few at 10^10 classes
    shared = names.where("low != high").select("sig").toArrow()["sig"].to_numpy().astype(np.int64).view(np.uint64)
    if len(shared):
        discard(classes, names)
        classes = materialize(_classes(docs, row, shared))
        names = materialize(classes.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    frequent = spark.sparkContext.broadcast(_frequent(docs, percent))
    # one shuffle for all lists: those of frequent shingles, the only hot ones, are dealt by class as well
    salt = F.when(F.col("place") < 0, F.pmod(F.xxhash64("sig"), F.lit(SALTS))).otherwise(0)
    every = _postings(docs, frequent, shared, percent).withColumn("salt", salt.cast("int")).repartition("place", "salt").dropDuplicates(["place", "salt", "sig"])
    w = Window.partitionBy("place", "salt")
    near = materialize(every.select("place", "sig", "nl", F.count("*").over(w).alias("df"), F.min("sig").over(w).alias("low")).where("df > 1 or place < 0"))
    lists = near.where("place < 0").groupBy("place").agg(F.sum(F.lit(1)).alias("df"), F.min("sig").alias("low")).where("df > 1")  # at most FREQUENT rows
    often = near.where("place < 0").drop("df", "low").join(F.broadcast(lists), "place")
    met = near.where("place >= 0").unionByName(often)
    size, last = F.shiftright("nl", 32), F.col("nl").bitwiseAND(F.lit(0xFFFFFFFF))
    flat = met.select("place", "sig", "df", "low", size.alias("n"), last.alias("last"))
    a, b = (flat.where(F.col("df") <= DENSE).select("place", *(F.col(c).alias(f"{c}{x}") for c in ("sig", "n", "last"))) for x in "ab")
    fits = (F.col("siga") < F.col("sigb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = a.join(b, "place").where(fits).groupBy("siga", "sigb", "na", "nb", "lasta", "lastb").agg(F.count("*").alias("c"))
    # a pair that shares a longer list too has more in common than c, but it is compared in that list's group
    rest_a, rest_b = (F.expr(f"({n} * {percent} + 99) div 100 - 1") for n in ("na", "nb"))
    rest = F.when(F.col("lasta") < F.col("lastb"), rest_a).when(F.col("lasta") > F.col("lastb"), rest_b).otherwise(F.greatest(rest_a, rest_b))
    pairs = materialize(pairs.where((F.col("c") + rest) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select(F.col("siga").alias("a"), F.col("sigb").alias("b"), "na", "nb"))
    long = flat.where(F.col("df") > DENSE)
    members = None
    if not long.isEmpty():
        roots = components(long.select(F.col("low").alias("a"), F.col("sig").alias("b")))
        share = flat.groupBy("sig").agg((F.count("*") / F.max("n")).alias("shared"), F.max("n").alias("n"))
        members = materialize(roots.select(F.col("root").alias("g"), F.col("node").alias("sig")).join(share, "sig"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig"))
    if members is not None:
        wanted = wanted.union(members.select("sig"))
    ids = materialize(names.join(wanted.distinct(), "sig").select("sig", "doc_id"))
    sets = materialize(_sets(docs, ids, frequent, shared))
    # candidates are counted beside those of the smallest class that one of them meets
    least = pairs.select("a", "b").union(pairs.select("b", "a")).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("g"))
    links = _counted(pairs.join(least, "a").select("g", "a", "b", "na", "nb"), sets, percent)
    if members is not None:
        for more in _groups(members, sets, percent):
            links = links.union(more)
    roots = components(links)
    named = names.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").select("sig", "doc_id", F.coalesce("root", "sig").alias("root"))
    named = materialize(named)
    total = named.count()
    first = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = materialize(_spread(named.select("sig", "root"), "root", first, _hot(named, "root", total)).select("sig", "root", "component_id"))
    out = _spread(classes, "sig", of, _hot(classes.where("n > 0"), "sig", classes.count()), "left")
    return out.select("row", "doc_id", "n", F.coalesce("root", F.lit(0)).alias("root"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    return grouped(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(row) of one row of each component, that of the smallest doc_id, and of every row without words; rows(row, doc_id, text)."""
    found = materialize(grouped(rows, percent, "row"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    first = found.where("n > 0").groupBy("root").agg(F.min(order).alias("least")).select("least.row")
    return first.union(found.where("n = 0").select("row"))
