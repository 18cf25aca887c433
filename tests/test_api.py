from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.api import SCHEMAS, Engine
from tessera.operators import docplan as P
from tessera.operators import lexical
from tessera.operators import vector as V
from tessera.operators.workspace import Workspace
from tests.test_graph import small


@pytest.fixture()
def engine(spark):
    e = Engine(spark, embedder=V.hash_embedder(32))
    e.add_repo("acme/payments", "https://h/acme/payments", "ops")
    e.add_repo("beta/web", "https://h/beta/web")
    e.add_source("jira", "jira")
    e.register_pages("jira", spark.createDataFrame([("http://h/pay-1842", "PAY-1842", ["Ops"], "h1")], "url string, title string, teams array<string>, hash string"))
    at = datetime(2025, 1, 1)
    rows = [("web:jira/pay-1842.md#0", "web:jira", "web", "pay-1842.md", "PAY-1842 Checkout timeout", "ERR_CONNECTION_RESET during capture", at), ("acme/payments/runbook.md#0", "acme/payments", "repo", "runbook.md", "Runbook", "checkout steps for payments", at), ("beta/web/x.md#0", "beta/web", "repo", "x.md", "X", "checkout page of the web", at)]
    e.tables["chunks"] = spark.createDataFrame(rows, SCHEMAS["chunks"])
    e.tables["vectors"] = V.embed(e.tables["chunks"].withColumn("_t", F.concat_ws(" ", "title", "excerpt")), "_t", V.hash_embedder(32), 32).select(*e.tables["chunks"].columns, "vector")
    code = [("c1", "acme/payments", "retry.go", "RetryRequest", 10, 12, "func RetryRequest() {\n// failed request\n}"), ("c2", "acme/payments", "worker.go", "RetryJob", 20, 21, "func RetryJob() {\n}"), ("c3", "beta/web", "client.go", "RetryFetch", 30, 31, "func RetryFetch() { retry }")]
    e.tables["code"] = spark.createDataFrame(code, SCHEMAS["code"])
    e.graphs["acme/payments"] = small(spark)
    return e


def test_search_docs(engine):
    assert [r.path for r in engine.search_docs("PAY-1842", "lexical").collect()] == ["pay-1842.md"]
    assert {r.path for r in engine.search_docs("checkout", "lexical").collect()} == {"pay-1842.md", "runbook.md", "x.md"}
    assert [r.path for r in engine.search_docs("checkout", "lexical", scope="sources").collect()] == ["pay-1842.md"]
    assert [r.path for r in engine.search_docs("checkout", "lexical", scope="repos", namespace="ops").collect()] == ["runbook.md"]
    assert [r.path for r in engine.search_docs("checkout", "lexical", key="beta/web").collect()] == ["x.md"]
    near = engine.search_docs("checkout steps for payments runbook", now=datetime(2025, 6, 1)).first()
    assert near.path == "runbook.md" and near.namespace == "ops"
    both = engine.search_docs("checkout steps for payments", "hybrid").collect()
    assert both[0].path == "runbook.md" and len(both) == 3
    for bad in ({"key": "none"}, {"scope": "x"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            engine.search_docs("checkout", **{"mode": "lexical", **bad}).collect()


def test_search_code(engine):
    rows, total = engine.search_code("retry* ", per_page=2)
    assert total == 3 and rows.count() == 2
    assert engine.search_code("retry*", repo="acme/payments")[1] == 2
    assert engine.search_code('"failed request"')[0].first().line == 11
    engine.tables["code_vectors"] = V.embed(engine.table("code"), "snippet", V.hash_embedder(32), 32)
    assert engine.search_code_semantic("func RetryJob() {", top=2).first().path == "worker.go"


def test_stored_forms_answer_alike(engine, spark, tmp_path):
    asked = [("PAY-1842", {}), ("checkout", {}), ("checkout", {"scope": "sources"}), ("checkout", {"scope": "repos", "namespace": "ops"}), ("checkout", {"key": "beta/web"}), ("nowhere", {})]
    before = [[r.asDict() for r in engine.search_docs(q, "lexical", **o).collect()] for q, o in asked]
    code = {q: (sorted(r.id for r in engine.search_code(q)[0].collect()), engine.search_code(q)[1]) for q in ("retry*", '"failed request"')}
    told, path = engine.query_graph("which ledger takes entries"), engine.shortest_path("Ledger", "Currency")
    engine.build_index("chunks", str(tmp_path / "chunks"), 4)
    engine.build_index("code", str(tmp_path / "code"), 4)
    engine.build_graph("acme/payments", str(tmp_path / "graph"), 4)
    assert [[r.asDict() for r in engine.search_docs(q, "lexical", **o).collect()] for q, o in asked] == before
    assert {q: (sorted(r.id for r in engine.search_code(q)[0].collect()), engine.search_code(q)[1]) for q in code} == code
    assert engine.search_code('"failed request"')[0].first().line == 11
    assert engine.query_graph("which ledger takes entries") == told and engine.shortest_path("Ledger", "Currency") == path
    new = engine.table("chunks").where("repo = 'beta/web'").withColumn("excerpt", F.lit("entirely new words"))
    engine.put_rows("chunks", new)
    assert [r.path for r in engine.search_docs("entirely", "lexical").collect()] == ["x.md"]
    engine.remove_repo("beta/web")
    assert engine.search_docs("entirely", "lexical").count() == 0 and engine.search_code("retry*")[1] == 2
    with pytest.raises(ValueError):
        engine.search_docs("checkout", "lexical", key="none").collect()


def test_refresh_repo(engine, spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.py").write_text("def settle(): pass\n")
    with pytest.raises(ValueError):
        engine.refresh_repo("beta/web", str(tmp_path / "files"))
    engine.workspace = Workspace(spark, str(tmp_path / "ws"), buckets=2)
    assert engine.refresh_repo("beta/web", str(tmp_path / "files")) == {"code_text": "done", "docs_text": "done"}
    assert engine.repo_status("beta/web").first().status == "ready"
    assert [r.path for r in engine.workspace.text["code"].search(lexical.parse("settle")).collect()] == ["a.py"]
    assert engine.refresh_repo("beta/web", str(tmp_path / "nowhere"))["code_text"] == "error"
    assert engine.repo_status("beta/web").first().status == "error"
    engine.remove_repo("beta/web")
    assert engine.workspace.text["code"].documents().count() == 0


def test_documentation_asks_for_what_changed(spark, tmp_path):
    prompts = []

    def model(prompt):
        prompts.append(prompt)
        if "Per-file summaries" in prompt:
            return f"text of {prompt.count('## ')} files"
        return "\n".join(f"## {line[3:]}\nabout {line[3:]}" for line in prompt.split("\n") if line.startswith("## ") and "broken" not in line)

    docs = P.Documentation(spark, str(tmp_path / "d"), model, 2)
    rows = [("a.py", "alpha"), ("b.py", "beta"), ("broken.py", "x")]
    files = lambda some: spark.createDataFrame(some, "path string, text string")
    com = spark.createDataFrame([], "source_file string, community int")
    got = docs.generate("r", files(rows), com, "Write.", overview="three nodes")
    assert got == {"reused": 0, "summarised": 2, "failed": 1, "written": 1, "markdown": "text of 2 files\n"}
    assert "three nodes" in prompts[-1] and "about a.py" in prompts[-1] and prompts[-1].startswith("Write.")
    again = docs.generate("r", files(rows), com, "Write.")
    assert again == {"reused": 2, "summarised": 0, "failed": 1, "written": 0, "markdown": "text of 2 files\n"}
    assert docs.generate("r", files(rows), com, "Write more.")["written"] == 1
    fewer = docs.generate("r", files([("a.py", "changed")]), com, "Write more.")
    assert (fewer["summarised"], fewer["reused"], fewer["markdown"]) == (1, 0, "text of 1 files\n")
    assert docs.generate("r", files([("a.py", "changed")]), com, "Write more.", force=True)["summarised"] == 1
    with pytest.raises(ValueError):
        docs.generate("empty", files([]), com, "Write.")
    long = spark.createDataFrame([("a", "é" * 3000), ("b", "short")], "path string, summary string")
    cut = P.joined_summaries(long, 1000)
    assert cut.endswith("## b\nshort") and len(cut.encode()) <= 1000 and "\ufffd" not in cut


def test_graph_questions(engine):
    assert engine.ambiguity("p").startswith("'p' may mean 4 nodes; 'p1'") and engine.ambiguity("p2") == ""
    assert "NODE Ledger" in engine.query_graph("which ledger takes entries")
    assert engine.query_graph("zzzz") == "no matching nodes"
    assert engine.get_node("postEntry").first().degree == 3
    assert engine.shortest_path("Ledger", "Currency") == ["p1", "p2", "p3"]
    assert engine.get_community(0)[1] == 2 and engine.graph_stats().first().edges == 4
    assert engine.god_nodes().count() == 4
    with pytest.raises(ValueError):
        engine.get_neighbors("Ledger", "nothing")
    engine.graphs["beta/web"] = engine.graphs["acme/payments"]
    with pytest.raises(ValueError):
        engine.query_graph("ledger")
    assert "NODE" in engine.query_graph("ledger of payments")


def test_catalog_commands(engine, spark):
    assert [r.id for r in engine.list_repos(namespace="ops")[0].collect()] == ["acme/payments"]
    engine.set_repo_namespace("beta/web", "ops")
    engine.set_namespace_description("ops", "Operations")
    engine.set_namespace_description("ops")  # None keeps what is stored
    assert [tuple(r) for r in engine.list_namespaces().collect()] == [("ops", 2, "Operations")]
    engine.delete_namespace("ops")
    assert engine.repo_status("web").first().id == "beta/web"
    assert [(r.name, r.pages) for r in engine.list_sources().collect()] == [("jira", 1)]
    assert engine.get_source("jira", team=" OPS ")[1] == 1 and engine.get_source("jira", title="nope")[1] == 0
    pages = spark.createDataFrame([("http://h/pay-1842", "P", ["Ops"], "h1"), ("http://h/new", "N", None, "h2")], "url string, title string, teams array<string>, hash string")
    assert engine.register_pages("jira", pages) == {"unchanged": 1, "added": 1}
    seen = engine.inspect_source("jira", per_page=1)
    assert (seen["total"], seen["has_more"], seen["pages"].count(), seen["source"]["type"]) == (2, True, 1, "jira") and [r.team for r in seen["teams"].collect()] == ["Ops"]
    with pytest.raises(ValueError):
        engine.inspect_source("nothing")
    engine.tables["tasks"] = spark.createDataFrame([(1, "beta/web", "docs", "running", None), (2, "beta/web", "code", "running", None), (3, "web:jira", "sync", "running", None), (4, "acme/payments", "docs", "queued", None)], SCHEMAS["tasks"])
    assert [tuple(r) for r in engine.active_repos().collect()] == [("beta/web", "code,docs", "pending"), ("web:jira", "sync", None)]
    gone = engine.refresh_source("jira", pages.where("title = 'N'"), complete=True)
    assert gone.count() == 1 and engine.get_source("jira")[1] == 1
    engine.delete_source("jira")
    assert engine.table("chunks").where("kind = 'web'").count() == 0 and engine.list_sources().count() == 0
    engine.remove_repo("beta/web")
    assert engine.table("code").count() == 2
    for call in (lambda: engine.add_repo("a:b", "u"), lambda: engine.add_repo("a", "u", "*"), lambda: engine.add_source("x", "y"), lambda: engine.set_repo_namespace("a", "*")):
        with pytest.raises(ValueError):
            call()


def test_document_planning(spark):
    files = spark.createDataFrame([(f"f{k:03d}.py", "text %d" % k) for k in range(60)], "path string, text string")
    com = spark.createDataFrame([(f"f{k:03d}.py", k % 2) for k in range(50)], "source_file string, community int")
    g = P.groups(files, com)
    sizes = {(r.group, r.community): r["count"] for r in g.groupBy("group", "community").count().collect()}
    assert sizes == {(0, 0): 24, (1, 0): 1, (2, 1): 24, (3, 1): 1, (4, -1): 10}
    many = spark.createDataFrame([(f"f{k:03d}.py", k) for k in range(60)], "source_file string, community int")
    packed = P.groups(files, many).collect()
    assert len(packed) == 60 and len({r.group for r in packed}) <= 40
    old = P.reuse(files, spark.createDataFrame([], "path string, hash string, summary string")).select("path", "hash", F.lit("old").alias("summary")).where("path < 'f058'")
    todo = P.reuse(files.withColumn("text", F.when(F.col("path") == "f000.py", "changed").otherwise(F.col("text"))), old).join(g, "path")
    assert sorted(r.path for r in todo.where("summary is null").collect()) == ["f000.py", "f058.py", "f059.py"]
    asked = P.prompts(todo, 10_000)
    assert {tuple(r.paths) for r in asked.collect()} == {("f000.py",), ("f058.py", "f059.py")}
    got = P.summarise(asked, lambda p: "## f058.py\nbody" if "f058" in p else 1 / 0).collect()
    assert {(r.path, r.summary, r.error) for r in got} == {("f058.py", "body", None), ("f059.py", None, "not in the answer"), ("f000.py", None, "division by zero")}
    assert P.stale(files, files.limit(59)).count() == 1


def test_groups_never_grow_beyond_24_files(spark):
    files = spark.createDataFrame([(f"f{k:04d}.py", "") for k in range(1200)], "path string, text string")
    one = P.groups(files, spark.createDataFrame([(f"f{k:04d}.py", k % 2) for k in range(1200)], "source_file string, community int")).collect()
    assert len(one) == 1200 and len({r.group for r in one}) == 50 and {r.community for r in one} == {0, 1}
    many = P.groups(files, spark.createDataFrame([(f"f{k:04d}.py", k % 60 if k < 600 else 100) for k in range(1200)], "source_file string, community int"))
    sizes = {r.group: (r["count"], r.c) for r in many.groupBy("group").agg(F.count("*").alias("count"), F.min("community").alias("c")).collect()}
    assert len(sizes) == 50 and {n for n, _ in sizes.values()} == {24}
    assert [sizes[g][1] for g in range(25)] == [100] * 25 and sizes[30][1] == -1  # the largest community comes first


def test_overrides(engine):
    def put(**o):
        return tuple(engine.set_repo_overrides("beta/web", **o).first())[1:]

    assert put() == (False, False)
    assert put(include=[" **/*.go ", "", "  "], docs_max_group_bytes=-5) == (True, False)
    assert put(include=["**/*.go"], docs_prompt="  ") == (False, False)
    assert put(include=["**/*.go"], graph_exclude=["gen/**"]) == (True, True)
    assert put(include=["**/*.go"], graph_exclude=["gen/**"], skip_stages=["Docs ", "docs", "nonsense"]) == (True, False)
    assert put(include=["**/*.go"], graph_exclude=["gen/**"], skip_stages=["graph", "docs"]) == (True, True)
    kept = engine.table("overrides").first()["overrides"]
    assert kept["skip_stages"] == ["docs", "graph"] and kept["exclude"] == [] and kept["docs_max_group_bytes"] == 0
    with pytest.raises(ValueError):
        engine.set_repo_overrides("no/such")
    engine.remove_repo("beta/web")
    assert engine.table("overrides").isEmpty()


def test_overview(engine):
    stats, gods, largest = engine.overview("acme/payments")
    assert stats.count() == 1 and gods.count() <= 15
    assert all(1 <= len(r.samples) <= 5 and r.nodes >= len(r.samples) for r in largest.collect())
