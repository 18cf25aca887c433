from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical as L
from tessera.operators import vector as V


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("PAY-1842 gateway timeout", "gateway OR timeout PAY-1842"),
        ("a payment b retry", "payment OR retry"),
        ("ERR_CAPTURE_42 broke v0.39.0", "broke ERR_CAPTURE_42 v0.39.0"),
        ('"exact words" OR other', '"exact words" OR other'),
        ("...", "..."),
    ],
)
def test_query_builder(question, want):
    assert L.build_query(question) == want


def test_query_budget_keeps_required_terms():
    got = L.build_query(" ".join(f"word{'x' * k}" for k in range(20)) + " A-1 B-2")
    assert got.endswith("A-1 B-2") and got.count(" OR ") == 9


def test_grammar():
    q = L.parse('a OR b REQ -no NOT never "two words" pre*')
    A = L.Atom
    assert q.groups == [[A(("a",)), A(("b",))], [A(("req",))], [A(("two", "words"))], [A(("pre",), True)]]
    assert q.without == [A(("no",)), A(("never",))]


def chunks(spark):
    rows = [("web", "p1", 0, "PAY-1842 Checkout timeout ERR_CONNECTION_RESET during capture"), ("web", "p2", 0, "other words"), ("repo", "r", 0, "checkout runbook checkout"), ("repo", "r", 1, "a a a b"), ("repo", "n", 0, None)]
    return spark.createDataFrame(rows, "kind string, path string, i int, text string")


@pytest.mark.parametrize(("query", "paths"), [("PAY-1842", ["p1"]), ("err_connection_reset", ["p1"]), ("checkout -timeout", ["r"]), ("check*", ["p1", "r"]), ('"a a"', ["r"]), ('"a b"', ["r"]), ("zzz", []), ("-only", []), ("", [])])
def test_matches(spark, query, paths):
    hits = L.matches(chunks(spark), L.parse(query))
    assert sorted({r.path for r in hits.collect()}) == paths


def test_scope_before_search_changes_statistics(spark):
    repo = L.matches(chunks(spark).where("kind = 'repo'"), L.parse("checkout")).collect()
    assert [r.path for r in repo] == ["r"]


def test_best_chunk_and_budget(spark):
    rows = [(f"d{d}", i, "word " * (i + 1) + "pad " * 5) for d in range(4) for i in range(5)]
    hits = L.matches(spark.createDataFrame(rows, "path string, i int, text string"), L.parse("word"))
    got = L.best_chunks(hits, ["path"], "i", 3).collect()
    assert [(r.path, r.i) for r in got] == [("d0", 4), ("d1", 4), ("d2", 4)]
    page, total = L.page(hits, [F.desc("score"), "path"], 2, 8, 100)
    assert total == 20 and page.count() == 8
    assert L.page(hits, ["path"], 9, 8, 100)[0].count() == 0


def test_frequent_terms(spark):
    rows = [(k, "the system handles it" + (" payment" if k % 5 == 0 else "") + f" unique{k:04d}") for k in range(200)]
    got = {r.term for r in L.frequent_terms(spark.createDataFrame(rows, "i int, text string"), ["i"]).collect()}
    assert got == {"the", "system", "handles", "it"}
    many = spark.range(5000).select(F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd x").alias("text"))
    assert {r.term: r.df for r in L.frequent_terms(many, ["i"]).collect()} == {"even": 2500} or {r.term for r in L.frequent_terms(many, ["i"]).collect()} <= {"even", "odd", "x"}
    assert L.needs_refresh(100, None) and not L.needs_refresh(110, 100) and L.needs_refresh(125, 100)


def test_stride_takes_every_kth_row(spark):
    many = spark.range(6001).select(F.col("id").alias("i"), F.concat(F.lit("t"), (F.col("id") % 3)).alias("text")).repartition(7)
    got = {r.term: r.df for r in L.frequent_terms(many, ["i"]).collect()}
    assert got == {"t0": 2001}  # a stride of 3 from row 0


def test_frequent_terms_in_an_order_that_ends_with_the_text(spark):
    rows = [(k // 2, None if k % 4 == 3 else f"t{k % 2} all") for k in range(6001)]
    many = spark.createDataFrame(rows, "i int, text string").repartition(7)
    by_number = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1]))[::3]  # rows without text come last
    want = {w: sum(r[1] is not None and w in r[1].split() for r in by_number) for w in ("t0", "t1", "all")}
    got = {r.term: r.df for r in L.frequent_terms(many, ["i", "text"]).collect()}
    assert got == {w: n for w, n in want.items() if n >= 700}


def test_matching_line(spark):
    df = spark.createDataFrame([("one\nretry here\nretry request", 10), ("none\nat all", 5), (None, 1), ("", 3)], "t string, s int")
    assert [r.x for r in df.select(L.matching_line(F.col("t"), ["retry", "request"], F.col("s")).alias("x")).collect()] == [12, 5, 1, 3]


def test_cosine_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0])], "id int, v array<float>")
    got = V.top_k(df, [1.0, 0.0], 5, ["id"], "v").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (5, 0.707107)]


def test_recency(spark):
    now = datetime(2026, 1, 1)
    rows = [("old", 0.80, datetime(2016, 1, 1)), ("new", 0.78, datetime(2025, 12, 2)), ("unknown", 0.5, None), ("future", 0.5, datetime(2030, 1, 1))]
    df = spark.createDataFrame(rows, "id string, s double, t timestamp")
    got = {r.id: r.x for r in df.select("id", V.recency(F.col("s"), F.col("t"), F.lit(now)).alias("x")).collect()}
    assert got["new"] > got["old"] >= 0.8 * 0.8 and got["unknown"] == got["future"] == 0.5


def test_overlap_suppression(spark):
    rows = [("r", "f", 1, 10, 0), ("r", "f", 5, 14, 1), ("r", "f", 8, 30, 2), ("r", "g", 5, 14, 3), ("r", "f", 11, 12, 4)]
    got = V.suppress_overlaps(spark.createDataFrame(rows, "repo string, path string, start_line int, end_line int, rank long"), 10).collect()
    assert [r.rank for r in got] == [0, 2, 3]


def test_fusion(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "d string, rank int")
    b = spark.createDataFrame([("y", 0), ("z", 1)], "d string, rank int")
    got = V.fuse({"lexical": a, "semantic": b}, ["d"]).collect()
    assert [(r.d, r.best_arm) for r in got] == [("y", "semantic"), ("x", "lexical"), ("z", "semantic")]
    assert got[0].score == pytest.approx(1 / 21 + 1 / 22, abs=1e-9)
    other = V.fuse({"lexical": b, "semantic": a}, ["d"]).collect()
    assert {r.d: r.score for r in other} == {r.d: r.score for r in got}
    heavy = V.fuse({"lexical": a, "semantic": b}, ["d"], {"semantic": 3.0}).collect()
    assert [r.d for r in heavy] == ["y", "z", "x"]


def test_depths():
    assert V.doc_depth(0, 3) == 20 and V.doc_depth(2, 3) == 12 and V.doc_depth(60, 3) == 40
    assert V.candidate_depth(None) == 12 and V.candidate_depth(99) == 40


def test_embedding_in_batches(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    got = V.embed(df, "t", V.hash_embedder(8), 8).collect()
    assert [len(r.vector) for r in got] == [8, 8]
    with pytest.raises(Exception, match="another number"):
        V.embed(df, "t", lambda x: [[1.0]], 8).collect()
