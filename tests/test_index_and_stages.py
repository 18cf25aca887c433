import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.plans import stages as S
from tessera.sources import files, web
from tests.test_graph import small


def test_index_rebuild_delta_delete(spark, tmp_path):
    schema = "id string, path string, text string, repo string"
    rows = lambda *r: spark.createDataFrame([(f"{repo}/{p}", p, t, repo) for repo, p, t in r], schema)
    ix = I.Index(spark, str(tmp_path / "ix"), schema)
    assert ix.read().count() == 0
    ix.rebuild("a/x", rows(("a/x", "keep.md", "1"), ("a/x", "old.md", "1"), ("a/x", "drop.md", "1")))
    ix.rebuild("b:y", rows(("b:y", "other.md", "1")))
    paths = spark.createDataFrame([("old.md",), ("drop.md",)], "path string")
    ix.delta("a/x", paths, rows(("a/x", "old.md", "2")))
    got = sorted((r.repo, r.path, r.text) for r in ix.read().collect())
    assert got == [("a/x", "keep.md", "1"), ("a/x", "old.md", "2"), ("b:y", "other.md", "1")]
    assert [r.path for r in I.indexed_paths(ix.read(), "b:y").collect()] == ["other.md"]
    assert I.exists(ix.read(), F.col("repo") == "b:y")
    ix.delete("a/x", paths)
    assert sorted(r.path for r in ix.read().collect()) == ["keep.md", "other.md"]
    ix.delete("b:y")
    assert [r.repo for r in ix.read().collect()] == ["a/x"]


def test_vectors_of_another_length_wipe(spark, tmp_path):
    schema = "id string, vector array<float>, repo string"
    ix = I.Index(spark, str(tmp_path / "v"), schema)
    df = lambda *r: spark.createDataFrame(list(r), schema)
    ix.upsert_vectors(df(("1", [1.0, 0.0], "a"), ("2", [0.0, 1.0], "a"), ("3", [1.0, 1.0], "b")))
    ix.upsert_vectors(df(("2", [5.0, 5.0], "a")))
    assert {r.id: r.vector[0] for r in ix.read().collect()} == {"1": 1.0, "2": 5.0, "3": 1.0}
    ix.upsert_vectors(df(("9", [1.0, 2.0, 3.0], "a")))
    assert [r.id for r in ix.read().collect()] == ["9"]
    with pytest.raises(ValueError):
        ix.upsert_vectors(df(("1", [1.0], "a"), ("2", [1.0, 2.0], "a")))


def test_kinds_symbols_and_merged_graphs(spark):
    rows = spark.createDataFrame([("web:x", ""), ("a/b", None), ("a/c", "kept")], "repo string, kind string")
    assert [r.kind for r in I.backfill_kind(rows).collect()] == ["web", "repo", "kept"]
    n, e = small(spark)
    assert {r.path: [tuple(s) for s in r.symbols] for r in I.symbols(n).collect()} == {"book.py": [(4, "Ledger"), (9, "postEntry()")], "money.py": [(1, "Currency"), (7, "roundHalf")]}
    nodes, edges = I.merged_graph({"a": (n, e), "b": (n, e)})
    assert nodes.select("id").distinct().count() == 8 and edges.count() == 8
    assert I.has_excluded(n, ["book.py"]) and not I.has_excluded(n, ["none/"])


def test_code_documents(spark, tmp_path):
    for p, b in {"a.go": b"package a\nfunc F() {\n}\n", "b.bin": b"x", "c.go": b"\x00bin", "node_modules/d.js": b"x", "e.txt": b"t"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b)
    docs = files.code_documents(spark, str(tmp_path), include_extra=["*.txt"])
    assert sorted(r.path for r in docs.collect()) == ["a.go", "e.txt"]
    syms = spark.createDataFrame([("a.go", [(2, "F")])], "path string, symbols array<struct<line int, name string>>")
    got = files.code_chunks(docs, "acme", syms).where("path = 'a.go'").collect()
    assert [(r.id, r.symbol, r.start_line) for r in got] == [("acme/a.go#0", "F", 1)]


def test_previews_and_addresses(tmp_path):
    import json

    issues = [{"key": f"P-{k}", "fields": {"labels": ["Ops"] if k % 2 else [], "updated": None}} for k in range(4)]
    (tmp_path / "0.json").write_text(json.dumps({"total": 4, "issues": issues}))
    assert web.preview("jira", {"url": f"file:{tmp_path}"}, ["ops"]) == {"scanned": 4, "selected": 2, "limit": 1000, "truncated": False}
    assert web.preview("jira", {"url": f"file:{tmp_path}"}, exclude=["ops"], limit=3) == {"scanned": 3, "selected": 2, "limit": 3, "truncated": True}
    ok = ["https://example.org/x"]
    bad = ["ftp://x", "http://u@x/", "http://localhost/", "http://127.0.0.1/", "http://10.1.2.3/", "http://[::1]/", "http://169.254.1.1/", "/x"]
    assert all(map(web.public_url, ok)) and not any(map(web.public_url, bad)) and web.public_url("http://10.1.2.3/", True)
    assert web.data_url("data:image/png;base64,aGk=") == b"hi"
    with pytest.raises(ValueError):
        web.data_url("data:text/html;base64,aGk=")


def test_stages(spark):
    assert S.closure(["docs_index"]) == ["graph", "docs", "docs_index"] and S.closure(["docs_index"], done=["docs"]) == ["docs_index"]
    assert S.runnable(["docs", "docs_index", "code_index"], [], failed=["docs"]) == ["code_index"] or S.runnable(["docs_index", "code_index"], [], ["docs"]) == ["code_index"]
    with pytest.raises(ValueError):
        S.runnable(["docs"], ["docs"])
    rows = spark.createDataFrame([("a", "running", None), ("b", "ready", None)], "id string, status string, error string")
    assert {r.id: (r.status, r.error) for r in S.reconcile(rows).collect()} == {"a": ("error", "interrupted"), "b": ("ready", None)}
    tasks = spark.createDataFrame([("a", "queued"), ("a", "running"), ("b", "queued"), ("c", "done")], "repo string, state string")
    assert {r.repo: r.state for r in S.live_state(tasks).collect()} == {"a": "running", "b": "queued"}
    steps = spark.createDataFrame([("a", "x"), ("a", "w"), ("a", "x")], "repo string, step string")
    assert S.activity(steps).first().steps == "w,x"
    assert S.schedules([], None) == ["@every 1h"] and S.schedules([], -1) == [] and S.schedules([], 60) == ["@every 60s"]
    assert S.prompt("", "cfg", "def", ["extra", " "]) == "cfg\n\nextra"
