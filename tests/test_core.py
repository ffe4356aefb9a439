"""Exact values on tiny inputs, invariants, and all queries against their SQL."""

import math

import duckdb
import numpy as np
import pytest
from lexiweave import queries as Q
from lexiweave.functions import text as T
from lexiweave.functions import vectors as V
from lexiweave.operators import distribution as D
from lexiweave.operators import division as S
from lexiweave.operators import evaluate as E
from lexiweave.operators import interpolate as I
from lexiweave.operators import linalg as L
from lexiweave.operators import merge as M
from lexiweave.operators import train as TR
from lexiweave.operators import vocabulary as W
from lexiweave.sources import benchmarks as B
from lexiweave.sources import corpus as C
from lexiweave.sources import vectors as SV
from lexiweave.streaming.vocabulary import stream_word_count
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def emb(spark, words, start=1):
    return SV.from_dict(spark, {w: [i + start, i + start + 1, i + start + 2] for i, w in enumerate(words)})


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def normal(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("NULL" if v is None or v != v else f"{float(v):.5g}" if isinstance(v, float | np.floating) or hasattr(v, "as_tuple") else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert normal(Q.QUERIES[name](spark, SF).toPandas()) == normal(con.execute(Q.ORACLE[name]).df())


def test_joins_and_splits(spark):
    a, b = emb(spark, "abcdefijwx"), emb(spark, "bdefgiklmn")
    assert [r[0] for r in rows(W.common(a, b), "word")] == list("bdefi")
    s = {r["word"]: r["role"] for r in W.intrinsic_split(a, b).collect()}
    assert s == {"b": "train", "d": "train", "e": "train", "f": "test", "i": "test"}
    s = W.extrinsic_split(a, b).collect()
    assert {r["word"] for r in s if r["role"] == "validation"} == set("acjwx") and all(r["target"] == [0.0] * 3 for r in s if r["role"] == "validation")
    full = spark.createDataFrame([(c, i) for i, c in enumerate("abcdef")], "word string, word_id long")
    assert rows(W.index_table(emb(spark, "ace"), full), "word_id") == [(0,), (2,), (4,)]
    assert [r[1] for r in rows(W.membership(spark.createDataFrame([(c,) for c in "abcdefghij"], "word string"), emb(spark, "aceghi")), "word", "member")] == [True, False, True, False, True, False, True, True, True, False]
    with pytest.raises(ValueError):
        W.append(a, b)


def test_numbered_lines(spark):
    docs = spark.createDataFrame([(5, "a\nb"), (5, "a\nb"), (-3, "x"), (10**15, "y\n"), (7, None), (None, "z")], "doc_id long, text string")
    got = rows(C.numbered_lines(docs), "line_id", "line")
    assert got == [(0, "x"), (1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "y"), (6, ""), (7, "z")]
    assert C.numbered_lines(docs.where("false")).count() == 0


def test_purity_and_standardise(spark):
    df = spark.createDataFrame(list(zip([1, 1, 2, 2, 3], [2, 2, 2, 2, 1], strict=True)), "cluster int, predicted int")
    assert abs(E.purity(df).first()[0] - 0.6) < 1e-12
    e = SV.from_dict(spark, {"Spider": [3, 4, 5], "spider": [1, 2, 3], "spideR": [3, 2, 4]})
    assert [tuple(r["vector"]) for r in W.standardize_words(e).collect()] == [(1.0, 2.0, 3.0)]
    assert spark.range(1).select(T.standardize(F.lit("It's-a_Test!"))).first()[0] == "its-a_test"


def test_readers_and_writers(spark, tmp_path):
    e = SV.from_dict(spark, {"a": [1, 2], "b": [2, 3], "c": [3, 4]})
    SV.write_word2vec_text(e, f"{tmp_path}/t")
    SV.write_word2vec_binary(e, f"{tmp_path}/b.bin")
    SV.write_csv(e, f"{tmp_path}/c")
    want = rows(e, "word", "vector")
    (tmp_path / "t1").write_text("3 2\na 1 2\nb 2 3\nc 3 4\nbad x\n")
    (tmp_path / "h").write_text("'a':1,2\n'b':2,3\n'c':3,4\n")
    (tmp_path / "g").write_text("a 1 2\nb 2 3\nc 3 4\n")
    got = [SV.load(spark, f"{tmp_path}/{p}", f, **k) for p, f, k in (("t1", "word2vec", {}), ("b.bin", "word2vec_bin", {}), ("c", "csv", {}), ("h", "hadoop", {}), ("g", "glove", {"dim": 2}))]
    for g in got:
        assert rows(g, "word", "vector") == want
    assert rows(SV.load(spark, f"{tmp_path}/t", "word2vec"), "word", "vector") == want
    for bad in ("a 1 2\nb 2 3\n", "1 2\na 1 2\nb 2 3\n"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(ValueError):
            SV.read_word2vec_text(spark, f"{tmp_path}/bad")
    (tmp_path / "msr").write_text("Good better rough JJ_JJR rougher\nsee saw eat VB_VBD ate\n")
    assert rows(B.msr_analogy(spark, f"{tmp_path}/msr"), "a", "answer", "category_high") == [("good", "rougher", "adjective"), ("see", "ate", "verb")]
    wide = SV.from_dict(spark, {"a": [1, 2, 3, 4]})
    assert rows(SV.slices(wide, 2), "model_id", "vector") == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    (tmp_path / "w.xml").write_text("<wiki><page><title>T</title><revision><text>A [[b|c]] {{x}} 'd'!</text></revision></page></wiki>")
    assert C.wiki_dump(spark, f"{tmp_path}/w.xml").first()["text"] == "a c 'd'"
    q = spark.createDataFrame([(0, ": gram1-x"), (1, "A b c d"), (2, ": capital"), (3, "e f g h")], "line_id long, line string")
    assert rows(B.fill_categories(q), "a", "answer", "category", "category_high") == [("a", "d", "gram1-x", "syntactic"), ("e", "h", "capital", "semantic")]


def test_distribution(spark):
    s = spark.createDataFrame([(["a", "b", "c"],)], "tokens array<string>")
    assert rows(D.skipgrams(s, 1), "word", "context") == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    p = D.to_distribution(spark.createDataFrame([("x", 1), ("y", 3)], "word string, n long"))
    part = spark.createDataFrame([(0, "x", 1), (0, "z", 5)], "part int, word string, n long")
    assert abs(D.kl(part, p, ["word"], ("part",)).first()["kl"] - math.log(4)) < 1e-12
    assert D.skipgram_total(10, 2, 2) == 28
    assert S.selections(3, 2) == [(0, 1), (0, 2), (1, 2)]


def test_merge_and_interpolation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    r = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    a = SV.from_dict(spark, {f"w{i:02}": v for i, v in enumerate(x)})
    b = SV.from_dict(spark, {f"w{i:02}": v @ r for i, v in enumerate(x[:30])})
    for method in ("global", "procrustes", "cca"):
        got = {k: np.array(v) for k, v in ((t["word"], t["vector"]) for t in I.interpolate(a, b, method).collect())}
        assert all(np.allclose(got[f"w{i:02}"], x[i] @ r, atol=1e-6) for i in range(40))
    assert M.procrustes_error(b, a) < 1e-6
    assert np.allclose(L.gram(a), x.T @ x)
    p = np.array([t["vector"] for t in M.reduce_dimensions(a, threshold=0.0).orderBy("word").collect()])
    c = x - x.mean(0)
    assert np.allclose(p @ p.T, c @ c.T)
    added = {t["word"]: t["vector"] for t in M.fold([a, b], "min_error", "linear").collect()}
    assert np.allclose(added["w03"], 2 * x[3], atol=1e-6)
    _, errors = I.consensus([a, b], 4)
    assert errors[-1] <= errors[0] + 1e-9
    f, g = L.low_rank_align(x[:10] * 3, x[:10] * 3, np.eye(10), 3)
    assert f.shape == (10, 3) and np.allclose(np.abs(f), np.abs(g), atol=1e-6)
    assert M.tsne(a, steps=20).count() == 40 and M.autoencode(a, 2, steps=20).count() == 40


def test_vectors_and_training(spark):
    e = SV.from_dict(spark, {"a": [3, 4]})
    r = e.select(V.norm("vector"), V.norm("vector", 1), V.norm("vector", float("inf")), V.norm("vector", float("-inf"))).first()
    assert list(r) == [5.0, 7.0, 4.0, 3.0]
    parts = spark.createDataFrame([(0, i, ["a", "b", "the", "c"] * 3) for i in range(20)], "part_id int, line_id long, tokens array<string>")
    m = TR.train_parts(parts, spark.createDataFrame([("the",)], "word string"), size=5, window=2, min_count=1)
    assert {r["word"] for r in m.collect()} == {"a", "b", "c"} and m.first()["vector"] is not None


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("A b\nb c\n")
    q = stream_word_count(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts"), "word", "n") == [("a", 1), ("b", 2), ("c", 1)]
