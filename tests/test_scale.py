"""Steps that must not hold a part, all questions or all pairs in one task, against their plain forms."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
from lexiweave.llm import media
from lexiweave.operators import distribution as D
from lexiweave.operators import evaluate as E
from lexiweave.operators import linalg as L
from lexiweave.operators import merge as M
from lexiweave.operators import search
from lexiweave.operators import train as TR
from lexiweave.plans import pipelines as P
from lexiweave.sources.corpus import numbered_lines
from lexiweave.storage import dealt
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_parts_are_trained_from_a_stream(spark):
    rng = np.random.default_rng(1)
    lines = [[f"w{i}" for i in rng.integers(0, 30, rng.integers(0, 40))] for _ in range(120)]
    parts = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(lines)] + [(7, 500, ["rare"])], "part_id int, line_id long, tokens array<string>")
    got = TR.train_parts(parts, spark.createDataFrame([("w3",)], "word string"), size=4, window=3, min_count=5, epochs=2)
    assert "FlatMapGroups" not in plan(got)  # it gathers a part in memory
    have = got.toPandas()
    for p in range(3):
        words, vectors = TR.sgns(lines[p::3], size=4, window=3, min_count=5, epochs=2, seed=p, without=frozenset(["w3"]))
        mine = have[have.model_id == p]
        assert list(mine.word) == words and np.array_equal(np.stack(mine.vector), vectors)
    assert set(have.model_id) == {0, 1, 2}


def test_slots_have_partitions_of_their_own(spark):
    df = dealt(spark.range(70).withColumn("slot", (F.col("id") % 7).cast("int")), "slot", 7)
    assert df.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("slot").alias("n"), F.count("*").alias("rows")).where("n = 1 and rows = 10").count() == 7


def test_a_search_holds_one_block_of_products(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9_000, 6))
    x[5_000:7_000] = x[:2_000]  # equal vectors: the smaller word is first
    words = [f"{(i * 7919) % 9_000:05}" for i in range(9_000)]
    v = [rng.normal(size=(1_500, 6)) for _ in range(3)]
    shapes, plain = [], search.Add.coarse
    monkeypatch.setattr(search.Add, "coarse", lambda self, *a: shapes.append((out := plain(self, *a))[0].shape) or out)
    own = [[words[i], words[i + 1]] for i in range(1_500)]
    asked = pa.table({"key": np.arange(1_500), "own": own, **{f"v{i}": pa.array(list(m)) for i, m in enumerate(v)}})
    tile = search._Tile(asked, 2, "add", (), True)
    for i in range(0, 9_000, 5_000):
        tile.meet(pa.array(words[i : i + 5_000]), x[i : i + 5_000])
    got = pa.Table.from_batches(tile.rows()).to_pydict()
    assert max(a for a, _ in shapes) <= search.CHUNK and max(b for _, b in shapes) <= search.BLOCK
    for q in range(0, 1_500, 50):
        s = search._dots(x, v[1][[q] * 9_000]) - search._dots(x, v[0][[q] * 9_000]) + search._dots(x, v[2][[q] * 9_000])
        want = sorted((-s[j], words[j]) for j in range(9_000) if words[j] not in own[q])[:2]
        assert [(-a, w) for k, w, a in zip(got["key"], got["word"], got["score"]) if k == q] == want


def test_neighbours_of_equal_vectors_go_by_word_in_every_tile(spark, monkeypatch):
    monkeypatch.setattr(search, "WORDS", 20)
    monkeypatch.setattr(search, "SPREAD", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 3))
    e = spark.createDataFrame([(f"{i:03}", x[i % 30].tolist()) for i in range(90)], "word string, vector array<double>")
    got = {r["query"]: [] for r in E.neighbours(e, e, 4).orderBy("query", "rank").collect()}
    for r in E.neighbours(e, e, 4, exclude=("001",)).orderBy("query", "rank").collect():
        got[r["query"]].append(r["word"])
    assert len(got) == 90 and all(len(w) == 4 for w in got.values())
    assert got["000"][:2] == ["030", "060"] and got["030"][:2] == ["000", "060"] and got["031"][0] == "061"


def test_low_rank_alignment_of_any_vocabulary(spark):
    rng = np.random.default_rng(4)
    for r, t in ((5, 4), (3, 6)):
        x, y = rng.normal(size=(40, r)), rng.normal(size=(40, t))
        g = np.hstack([x, y]).T @ np.hstack([x, y])
        a, b = L.low_rank_align(x, y, np.eye(40), 3)
        p, q = L.low_rank_maps(g, r, 3)
        got, want = np.hstack([x, y]) @ np.vstack([p.T, q.T]).T, np.hstack([a, b])
        sign = np.sign((got * want).sum(0))[:3]
        assert np.allclose(got * np.tile(sign, 2), want, atol=1e-8)
    e = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(rng.normal(size=(2_100, 4)))], "word string, vector array<double>")
    assert M.lra([e, e.where("word != '7'")], 2).count() == 2_099  # more than 2,000 were an error


def test_clusters_without_a_matrix_of_distances(spark, monkeypatch):
    def greedy(x, k, linkage, metric):
        groups = [[i] for i in range(len(x))]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T if metric == "cosine" else np.linalg.norm(x[:, None] - x, axis=2)
        ward = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        far = {"ward": ward, "average": lambda a, b: d[np.ix_(a, b)].mean(), "complete": lambda a, b: d[np.ix_(a, b)].max()}[linkage]
        while len(groups) > k:
            i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: far(groups[p[0]], groups[p[1]]))
            groups[j] += groups.pop(i)
        return {frozenset(g) for g in groups}

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 5))
    for kept in (300, 0.001):  # all distances kept, two clusters' only
        monkeypatch.setattr(E, "KEPT_MB", kept)
        for linkage, metric in E.CLUSTERINGS:
            lab = E.agglomerative(x, 6, linkage, metric)
            assert {frozenset(np.flatnonzero(lab == i).tolist()) for i in set(lab)} == greedy(x, 6, linkage, metric)
    words = spark.createDataFrame([("d", str(i), str(i % 3)) for i in range(40)], "dataset string, word string, cluster string")
    e = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "word string, vector array<double>")
    assert [r["dataset"] for r in E.categorization(words, e).collect()] == ["d"]
    began = time.monotonic()
    E.agglomerative(rng.normal(size=(4_500, 8)), 10)
    assert time.monotonic() - began < 20


def test_wordrep_asks_every_pair_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "PAIRS", 4)
    monkeypatch.setattr(E, "FIRST", 10)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(36, 3))
    x[1::2] = x[::2] + [3, 0, 0] + 0.05 * rng.normal(size=(18, 3))  # so that some questions are answered
    e = spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x)], "word string, vector array<double>")
    pairs = spark.createDataFrame([(f"c{i % 2}", "h", f"w{2 * i}", f"w{2 * i + 1}") for i in range(17)] + [("c0", "h", "w3", "unknown")], "category string, category_high string, left string, right string")
    want = E.wordrep_summary(E.analogy_answers(E.wordrep_questions(pairs, None), e)).where("level = 'all'").select("n", "correct").first()
    got = E.wordrep_accuracy(pairs, e).first()
    assert want["n"] == 10 * 9 + 8 * 7 and want["correct"] > 10
    assert (got["n"], got["correct"]) == (want["n"], want["correct"]) and got["accuracy"] == got["correct"] / got["n"]
    assert E.evaluate_one(e, E.Benchmarks(wordrep=pairs, max_pairs=None), "wordrep").first()["value"] == got["accuracy"]


def test_corpora_are_counted_once(spark):
    docs = spark.createDataFrame([(i, "a b a\nc a" if i % 2 else "b  c\n\na b c d") for i in range(20)], "doc_id long, text string")
    lines = numbered_lines(docs)
    for f in (lambda: P.fidelity(lines, 3), lambda: P.block_fidelity(lines, 50, [2, 5])):
        assert plan(f()).count("Generate explode") == plan(f()).count("Generate explode(array") <= 2  # words come from the written counts
    got = {(r["d"], r["part_id"]): r["kl"] for r in P.block_fidelity(lines, 50, [2, 5]).collect()}
    words = {r["line_id"]: r["line"].split() for r in lines.collect()}
    count = lambda rows: np.array([sum(w == x for i in rows for w in words[i]) for x in "abcd"], float)
    q = count(words) / count(words).sum()
    for d in (2, 5):
        for part in range(d):
            p = count([i for i in words if i // (50 // d) == part])
            p /= p.sum()
            assert abs(got[d, part] - (p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()) < 1e-12
    assert len(got) == 7


def test_pairs_are_summed_in_their_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i % 3, [f"w{j}" for j in rng.integers(0, 9, rng.integers(0, 30))]) for i in range(200)]
    s = spark.createDataFrame(rows, "part_id int, tokens array<string>")
    v = spark.createDataFrame([(f"w{i}",) for i in range(6)], "word string")
    g = D.skipgram_count(s, 3, v, ("part_id",))
    assert "Generate" not in plan(g)  # a row for each pair
    want, apart = Counter(), Counter()
    for p, t in rows:
        for i, a in enumerate(t):
            for j, b in enumerate(t):
                if 0 < abs(i - j) <= 3 and a < "w6" and b < "w6":
                    want[p, a, b] += 1
                if abs(i - j) == 2:
                    apart[a, b] += 1
    assert {(r["part_id"], r["word"], r["context"]): r["n"] for r in g.collect()} == want
    assert {(r["a"], r["b"]): r["n"] for r in D.offset_counts(s, 2, 5).collect()} == {k: n for k, n in apart.items() if n >= 5}
    assert D.skipgram_count(s, 3, v).agg(F.sum("n")).first()[0] == sum(want.values())


def test_media_takes_some_texts_at_a_time():
    batch = pa.record_batch({"doc_id": [1, None, 3, 4], "text": ["a" * 900_000, None, "b" * 900_000, "c"]})
    got = list(media._rows(batch))
    assert len(got) == 2 and [x for g in got for x in g["doc_id"].to_pylist()] == [1, None, 3, 4]
    assert [x for g in got for x in g["n_bytes"]] == [900_000, 0, 900_000, 1]
    assert list(media._rows(batch.slice(0, 0))) == []
