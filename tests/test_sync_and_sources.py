import json
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import sync as S
from tessera.sources import files, git, web
from tessera.streaming import ingest


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_prune_only_after_a_complete_sweep(spark):
    have, seen, gone = df(spark, [("a",), ("b",), ("c",)], "k string"), df(spark, [("a",)], "k string"), df(spark, [("b",), ("a",)], "k string")
    assert [r.k for r in S.prune(have, seen, gone, ["k"], False).collect()] == ["b"]
    assert sorted(r.k for r in S.prune(have, seen, gone, ["k"], True).collect()) == ["b", "c"]


def test_changes_upsert_and_repair(spark):
    new = df(spark, [(1, "x"), (2, "y"), (3, None)], "k int, t string")
    stored = S.changed(df(spark, [(1, "x"), (2, "old")], "k int, t string"), df(spark, [], "k int, hash string"), ["k"], "t").select("k", "hash")
    assert {r.k: r.change for r in S.changed(new, stored, ["k"], "t").collect()} == {1: "unchanged", 2: "updated", 3: "added"}
    assert sorted(map(tuple, S.upsert(df(spark, [(1, "a"), (9, "z")], "k int, t string"), new, ["k"]).collect()), key=str) == sorted([(9, "z"), (1, "x"), (2, "y"), (3, None)], key=str)
    ids = lambda *x: df(spark, [(i,) for i in x], "k int")
    assert sorted(r.k for r in S.missing_from_indexes(ids(1, 2, 3, 4), [ids(1, 2), ids(1, 3)], ids(4), ["k"]).collect()) == [2, 3]


def test_watermark_and_schedules(spark):
    rows = df(spark, [(datetime(2024, 1, 1, 10, 5, 40),), (datetime(2024, 1, 1, 9, 0, 0),)], "t timestamp")
    assert S.next_watermark(rows, "t").first()[0] == datetime(2024, 1, 1, 10, 4)
    assert S.next_watermark(rows.limit(0), "t").first()[0] is None
    assert S.bounded_query("project = X order by key", datetime(2024, 1, 2, 3, 4, 5)) == '(project = X) AND updated >= "2024-01-02 03:04" ORDER BY updated ASC'
    assert S.bounded_query("", None) == "ORDER BY updated ASC"
    at = datetime(2024, 1, 31, 23, 59)
    assert S.next_tick("0 2 * * *", at) == datetime(2024, 2, 1, 2, 0)
    assert S.next_tick("*/15 9-17 * * 1-5", datetime(2024, 2, 2, 17, 50)) == datetime(2024, 2, 5, 9, 0)
    assert S.next_tick("@every 1h30m", at) == datetime(2024, 2, 1, 1, 29)
    assert S.full_sweep_due(None, at, False) and S.full_sweep_due(at, at, True) and not S.full_sweep_due(at, datetime(2024, 2, 1, 1, 0), False)
    assert S.signature(["a", "b"]) != S.signature(["ab"])


def test_catalog(spark):
    repos = df(spark, [("acme/zeta", "ready", ""), ("acme/alpha", "ready", "ops"), ("beta/one", "error", ""), ("beta/two", "ready", "ops"), ("gamma/x/y", "ready", ""), ("solo", "ready", None)], "id string, status string, namespace string")
    rows, total, more = C.page(C.repos(repos, owner="acme"), ["id"], 1, 1)
    assert [r.id for r in rows.collect()] == ["acme/alpha"] and total == 2 and more
    assert C.repos(repos, owner="gamma").count() == 0 and C.repos(repos, search="A%").count() == 0
    assert C.repos(repos, namespace="default").count() == 4 and C.repos(repos, namespace="ops", status="ready").count() == 2
    assert [(r.owner, r.repos) for r in C.owner_groups(repos).collect()] == [("", 1), ("acme", 2), ("beta", 2), ("gamma/x", 1)]
    told = df(spark, [("ops", "Operations"), ("empty", "None yet")], "namespace string, description string")
    assert [tuple(r) for r in C.namespace_groups(repos, told).collect()] == [("", 4, ""), ("empty", 0, "None yet"), ("ops", 2, "Operations")]
    pages = df(spark, [("1", ["Alpha"]), ("2", ["beta"]), ("3", ["ALPHA", "Gamma"]), ("4", None), ("5", ["Beta"]), ("6", ["gamma"])], "slug string, teams array<string>")
    assert [r.team for r in C.distinct_teams(pages, "teams", "slug").collect()] == ["Alpha", "beta", "Gamma"]
    lines = df(spark, [("f", 1, "a"), ("f", 2, "a"), ("f", 4, "a"), ("f", 5, "b"), ("f", 6, None), ("f", 7, None)], "file string, line int, sha string")
    got = sorted((r.line_start, r.line_end, r.sha) for r in C.islands(lines, ["file"], "line", ["line"], "sha").collect())
    assert got == [(1, 2, "a"), (4, 4, "a"), (5, 5, "b"), (6, 7, None)]
    keys = C.scope_keys(repos, df(spark, [("wiki",)], "name string"), "all", "ops")
    assert sorted(r.id for r in keys.collect()) == ["acme/alpha", "beta/two", "web:wiki"]
    tasks = df(spark, [(1, None), (2, 5), (3, None), (4, 9)], "seq int, ended_at int")
    assert [r.seq for r in C.queue_order(tasks).collect()] == [3, 1, 4, 2]
    eta = df(spark, [(10, 20, 10.0), (2, 20, 10.0), (10, 20, 1.0)], "d int, t int, e double").select(C.eta_seconds(F.col("d"), F.col("t"), F.col("e")))
    assert [r[0] for r in eta.collect()] == [10.0, None, None]


def test_history(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (repo / "x.txt").write_text("one\ntwo\n")
    (repo / "gone.txt").write_text("g\n")
    run("add", "."), run("commit", "-qm", "first"), run("tag", "v1")
    (repo / "x.txt").write_text("one\n2\nthree\n")
    (repo / "gone.txt").unlink()
    run("add", "-A"), run("commit", "-qm", "second\n\nbody")
    web.register(spark)
    read = lambda what, **o: spark.read.format("tessera_git").option("path", str(repo)).option("what", what).options(**o).load().collect()
    log = read("log")
    assert [(r.subject, r.body, sorted(r.files)) for r in log] == [("second", "body", ["gone.txt", "x.txt"]), ("first", "", ["gone.txt", "x.txt"])]
    assert [r.subject for r in read("log", **{"from": "v1"})] == ["second"] and [r.subject for r in read("log", skip="1")] == ["first"]
    assert sorted((r.name, r.kind) for r in read("refs")) == [("main", "branch"), ("v1", "tag")]
    assert sorted((r.status, r.path) for r in read("diff", **{"from": "v1", "to": "main"})) == [("D", "gone.txt"), ("M", "x.txt")]
    assert sorted(r.path for r in read("changed", **{"from": "v1"})) == ["gone.txt", "x.txt"]
    blame = [(r.line, r.summary, r.text) for r in read("blame", file="x.txt")]
    assert blame == [(1, "first", "one"), (2, "second", "2"), (3, "second", "three")]
    assert not git.patch(str(repo), "v1")[1]
    with pytest.raises(ValueError):
        git.valid_revision("--output=x")
    assert git.revision_range("a", "b") == "a..b" and git.revision_range("a") == "a..HEAD" and git.revision_range() == "HEAD"


def issue(k, updated, **f):
    return {"key": f"P-{k}", "fields": {"summary": f"S{k}", "updated": updated, "labels": ["x"], "issuetype": {"name": "Bug"}, **f}}


def test_issue_source_batch_and_stream(spark, tmp_path):
    web.register(spark)
    (tmp_path / "0.json").write_text(json.dumps({"total": 3, "issues": [issue(1, "2024-01-01T10:00:30.000+0000", cf=[{"value": "Ops"}, "ops", {"name": "Dev"}]), issue(2, "2024-01-01T11:00:30.000+0000", description="text")]}))
    (tmp_path / "2.json").write_text(json.dumps({"total": 3, "issues": [issue(3, "2024-01-01T12:00:30.000+0000", subtasks=[{"key": "P-9", "fields": {"summary": "sub"}}])]}))
    o = {"url": f"file:{tmp_path}", "teamFields": "cf"}
    got = spark.read.format("tessera_issues").options(**o).load().orderBy("key").collect()
    assert [r.key for r in got] == ["P-1", "P-2", "P-3"] and got[0].teams == ["Ops", "Dev"]
    assert got[0].markdown.startswith("# P-1: S1\n\n- **Key:** P-1\n- **Type:** Bug\n") and "- **Teams:** Ops, Dev\n" in got[0].markdown
    assert got[1].markdown.endswith("\n## Description\n\ntext\n") and "Subtasks" not in got[2].markdown
    stream = spark.readStream.format("tessera_issues").options(**o).load()
    q = stream.writeStream.format("memory").queryName("issues_in").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(distinct key) from issues_in").first()[0] == 3
    assert web._advance(None, [tuple(r) for r in got], 6) == datetime(2024, 1, 1, 11, 59)


def test_wiki_pages_and_sitemaps(spark, tmp_path):
    web.register(spark)
    page = {"id": 7, "title": "T", "body": {"view": {"value": "<p>hi</p>"}}, "metadata": {"labels": {"results": [{"name": "l"}]}}, "version": {"when": "2024-01-01T10:00:00.000Z"}, "ancestors": [{"title": "A"}, {"title": "B"}]}
    (tmp_path / "0.json").write_text(json.dumps({"results": [page], "_links": {"next": "/x?start=0"}}))
    got = spark.read.format("tessera_wiki").option("url", f"file:{tmp_path}").load().collect()
    assert [(r.id, r.markdown, r.labels) for r in got] == [("7", "> A › B\n\nhi", ["l"])]
    (tmp_path / "a.html").write_text("<title>t</title><p>x</p>")
    rows = spark.read.format("tessera_pages").option("urls", f"file:{tmp_path}/a.html\n\nfile:{tmp_path}/none.html").load().collect()
    assert sorted((r.title, r.error is None) for r in rows if r.title) == [("t", True)] and sum(r.error is not None for r in rows) == 1
    (tmp_path / "index.xml").write_text(f"<sitemapindex xmlns='x'><sitemap><loc>file:{tmp_path}/s.xml</loc></sitemap><sitemap><loc>http://other/s.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "s.xml").write_text(f"<urlset><url><loc>file:{tmp_path}/a</loc></url><url><loc>file:{tmp_path}/a</loc></url><url><loc>http://other/b</loc></url></urlset>")
    assert web.sitemap_urls(f"file:{tmp_path}/index.xml") == [f"file:{tmp_path}/a"]


def test_file_listings(spark, tmp_path):
    for p, t in {"a.md": "# Title\nsee [x](y)", "sub/b.md": "plain", "sub/c.txt": "0123456789", ".git/config": "x", "vendor/z.md": "v"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    t = files.tree(spark, str(tmp_path))
    assert [(r.path, r.is_dir) for r in files.listing(t).collect()] == [("sub", True), ("a.md", False)]
    assert [r.path for r in files.listing(t, recursive=True).collect()] == ["a.md", "sub/b.md", "sub/c.txt"]
    r = files.ranged_read(spark, str(tmp_path), "sub/c.txt", 2, 3).first()
    assert (r.size, bytes(r.content), r.truncated) == (10, b"234", True)
    with pytest.raises(ValueError):
        files.ranged_read(spark, str(tmp_path), "../x")
    (tmp_path / "docs-index.json").write_text(json.dumps({"docs": [{"path": "sub/b.md", "title": "Known"}]}))
    docs = files.markdown_documents(spark, str(tmp_path), str(tmp_path / "docs-index.json"))
    assert {r.path: r.title for r in docs.collect()} == {"a.md": "Title", "sub/b.md": "Known", "vendor/z.md": "vendor/z.md"}
    only = files.markdown_documents(spark, str(tmp_path), only=df(spark, [("a.md",), ("gone.md",)], "path string"))
    got = files.document_chunks(only, "acme/pay", "repo").collect()
    assert [(r.id, r.excerpt) for r in got] == [("acme/pay/a.md#0", "# Title\nsee x")]


def test_stream_upsert_is_idempotent(spark, tmp_path):
    rows = [(k % 7, k, float(k)) for k in range(100)]
    src = str(tmp_path / "events.parquet")
    df(spark, rows, "user long, seq long, v double").repartition(5).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = ingest.file_stream(spark, str(tmp_path), "events.parquet", schema, max_files=1)
    got = {r.user: (r.n, r.seq, r.v) for r in ingest.latest_by_key(stream, "user", ["seq"]).collect()}
    assert got == {u: (len(range(u, 100, 7)), max(range(u, 100, 7)), float(max(range(u, 100, 7)))) for u in range(7)}
