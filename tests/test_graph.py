import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.sources import files

N = "ord long, id string, label string, norm_label string, source_file string, source_location string, file_type string, community int"
E = "ord long, source string, target string, relation string, confidence string, context string"


def small(spark):
    """A ledger of our own: two files, a function that three edges meet in, one of each confidence."""
    nodes = [
        (0, "p1", "Ledger", "ledger", "book.py", "L4", "code", 0),
        (1, "p2", "postEntry()", "postentry()", "book.py", "L9", "code", 0),
        (2, "p3", "Currency", "currency", "money.py", "L1", "code", 1),
        (3, "p4", "roundHalf", "roundhalf", "money.py", "L7", "code", 1),
    ]
    edges = [
        (0, "p1", "p2", "contains", "EXTRACTED", ""),
        (1, "p2", "p3", "uses", "INFERRED", "parameter_type"),
        (2, "p2", "p4", "calls", None, "call"),
        (3, "p4", "p3", "uses", "AMBIGUOUS", "return_type"),
    ]
    return spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)


def test_stats_and_degrees(spark):
    n, e = small(spark)
    assert tuple(G.stats(n, e).first()) == (4, 4, 2, 50, 25, 25)
    assert {r.id: r.degree for r in G.degrees(n, e).collect()} == {"p1": 1, "p2": 3, "p3": 2, "p4": 2}
    loop = spark.createDataFrame([(0, "p3", "p3", "holds", None, None)], E)
    assert {r.id: r.degree for r in G.degrees(n, loop).collect()} == {"p1": 0, "p2": 0, "p3": 2, "p4": 0}
    assert tuple(G.stats(n.limit(0), e.limit(0)).first()) == (0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize("degrees", [list(range(100)), [5] * 10, [200] * 3 + [1] * 500, []])
def test_hub_threshold(spark, degrees):
    df = spark.createDataFrame([(d,) for d in degrees], "degree long")
    want = max(50, sorted(degrees)[min(int(0.99 * len(degrees)), len(degrees) - 1)]) if degrees else 50
    assert G.hub_threshold(df).first()[0] == want


def test_scores_seeds_and_resolution(spark):
    n, _ = small(spark)
    scored = G.node_scores(n, G.query_terms("where does Ledger round Currency amounts?"))
    idf = math.log(1 + 4 / 2)  # each term is in one of four labels
    assert {r.id: r.score for r in scored.collect()} == {"p1": round(1000 * idf, 6), "p3": round(1000 * idf, 6), "p4": round(100 * idf, 6)}
    assert [r.id for r in G.seeds(scored).collect()] == ["p3", "p1"]  # p4 has less than a fifth
    assert [(r.id, r.tier) for r in G.resolve(n, " PostEntry").collect()] == [("p2", 0)]
    assert [(r.id, r.tier) for r in G.resolve(n, "round").collect()] == [("p4", 1)]
    assert [(r.id, r.tier) for r in G.resolve(n, "P").collect()] == [(f"p{k}", 1) for k in range(1, 5)]
    assert [(r.id, r.tier) for r in G.resolve(n, "e").collect()] == [("p1", 2), ("p2", 2), ("p3", 2)]
    assert G.node_scores(n, []).count() == 0


def test_terms():
    assert G.query_terms("Find the no x9 Ab of") == ["find", "the", "x9"]
    assert G.query_terms("数据库") == ["数据", "据库", "数据库"] and G.query_terms("数据") == ["数据"]
    assert G.normal_contexts(["Invocation ", "harbour", "calls", "", "TEMPLATES", "Módule"]) == ["call", "harbour", "generic_arg", "import"]
    assert G.asked_contexts("who calls it, and which fields?") == (["call", "field"], "heuristic")
    assert G.asked_contexts("who calls it", ["Decorator"]) == (["attribute"], "explicit") and G.asked_contexts("what") == ([], "")


def chain(spark, hub=60):
    nodes = [(k, f"n{k}", f"n{k}", f"n{k}", "f", "", "", 0) for k in range(6)] + [(10 + k, f"h{k}", "h", "h", "f", "", "", 0) for k in range(hub)]
    edges = [(k, f"n{k}", f"n{k + 1}", "r", "", "call" if k else "import") for k in range(5)] + [(10 + k, "n2", f"h{k}", "r", "", "call") for k in range(hub)]
    return spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)


def test_bfs_hub_and_depth(spark):
    n, e = chain(spark)
    d = G.degrees(n, e)
    start = spark.createDataFrame([("n0",)], "id string")
    assert {r.id: r.level for r in G.bfs(e, d, start, 5, 50).collect()} == {"n0": 0, "n1": 1, "n2": 2}
    free = {r.id: r.level for r in G.bfs(e, d, start, 3, 100).collect()}
    assert free["n3"] == 3 and "n4" not in free and free["h0"] == 3
    from_hub = G.bfs(e, d, spark.createDataFrame([("n2",)], "id string"), 1, 50)
    assert from_hub.count() == 62
    walked = G.bfs_edges(e, G.bfs(e, d, start, 5, 50), d, 50)
    assert sorted((r.source, r.target) for r in walked.collect()) == [("n0", "n1"), ("n1", "n2")]
    assert G.filter_contexts(e, ["import"]).count() == 1


def test_shortest_path(spark):
    n, e = chain(spark)
    assert G.shortest_path(n, e, "n5", "n0") == ["n5", "n4", "n3", "n2", "n1", "n0"]
    with pytest.raises(ValueError):
        G.shortest_path(n, e, "n0", "n5", 3)


def test_neighbors_and_contexts(spark):
    n, e = small(spark)
    assert [(r.direction, r.id) for r in G.neighbors(n, e, "p2").collect()] == [("out", "p3"), ("out", "p4"), ("in", "p1")]
    assert G.neighbors(n, e, "p2", "zzz").count() == 0
    got = sorted(tuple(r) for r in G.file_context(n, e, "book.py").collect())
    assert got == [("out", "Ledger", "contains", "postEntry()"), ("out", "postEntry()", "calls", "roundHalf"), ("out", "postEntry()", "uses", "Currency")]
    members, outside = G.community_context(n, e, 0)
    assert {r.id for r in members.collect()} == {"p1", "p2"} and outside.count() == 2
    assert {r.source_file: r.community for r in G.community_files(n).collect()} == {"book.py": 0, "money.py": 1}
    assert {r.relation for r in G.relation_vocabulary(e).collect()} == {"calls", "contains", "uses"}


def test_god_nodes_leave_out_files_and_noise(spark):
    nodes = [(0, "f", "svc.go", "svc.go", "svc.go", "", "", 0), (1, "m", ".close()", ".close()", "svc.go", "", "", 0), (2, "k", "name", "name", "p.json", "", "", 0), (3, "c", "Idea", "idea", "", "", "", 0), (4, "g", "Core", "core", "a/svc.go", "", "", 0), (5, "x", "helper()", "helper()", "svc.go", "", "", 0)]
    edges = [(k, "g", t, "r", "", "") for k, t in enumerate(["f", "m", "k", "c", "x"])]
    assert [r.id for r in G.god_nodes(spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)).collect()] == ["g"]


def test_subgraph_text(spark):
    n, e = small(spark)
    d = G.degrees(n, e)
    reached = G.bfs(e, d, spark.createDataFrame([("p1",)], "id string"), 2, 50)
    text = G.subgraph_text(n, e, reached, G.bfs_edges(e, reached, d, 50))
    assert "NODE Ledger [src=book.py loc=L4 community=0]" in text.split("\n") and "EDGE postEntry() --calls--> roundHalf" in text
    assert "left out" in G.subgraph_text(n, e, reached, G.bfs_edges(e, reached, d, 50), 20)
    assert G.ambiguous_pick([1.0, 0.95]) and not G.ambiguous_pick([1.0, 0.5]) and not G.ambiguous_pick([1.0])


@pytest.mark.parametrize(
    ("graph", "sound"),
    [
        ({}, False),
        ({"nodes": []}, False),
        ({"nodes": [{"id": ""}], "links": []}, False),
        ({"nodes": [{"id": "a"}, {"id": "a"}], "links": []}, False),
        ({"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "b"}]}, False),
        ("not json", False),
        ({"nodes": [], "links": []}, True),
        ({"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}]}, True),
    ],
)
def test_graph_files(spark, tmp_path, graph, sound):
    p = tmp_path / "g.json"
    p.write_text(graph if isinstance(graph, str) else json.dumps(graph, indent=1))
    assert (files.graph_faults(spark, str(p)) == []) == sound


def test_graph_scan(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}, {"id": ""}, {"id": "b"}], "links": [], "edges": [{"source": "a", "target": "b"}, {"source": "a", "target": "gone"}]}))
    n, e = files.graph_json(spark, str(p))
    assert [(r.ord, r.id) for r in n.orderBy("ord").collect()] == [(0, "a"), (2, "b")]
    assert [(r.source, r.target, r.confidence) for r in e.collect()] == [("a", "b", "EXTRACTED")]
    with pytest.raises(ValueError):
        files.graph_json(spark, str(tmp_path / "g.txt"))
    assert G.validate(n, e) == [] and len(G.validate(n.unionByName(n), e.withColumn("target", F.lit("x")))) == 2


def test_whole_graph_queries_against_brute_force(spark):
    from tessera.plans import catalogue, star

    folder = "/root/testdata/sf0.01"
    near = {}
    for e in star.edges(spark, folder).collect():
        near.setdefault(e.source, set()).add(e.target)
        near.setdefault(e.target, set()).add(e.source)
    want, front = {"customer:0": 0}, {"customer:0"}
    for hop in range(1, 5):
        front = {y for x in front for y in near.get(x, ())} - set(want)
        want |= dict.fromkeys(front, hop)
    got = {r.id: r.hops for r in catalogue.QUERIES["shortest_path_hops_whole"](spark, folder).collect()}
    assert got == want
    assert {x.split(":")[0] for x in got} >= {"orders", "part"}

    nodes = star.nodes(spark, folder).collect()
    terms = ["ring", "red", "nation"]
    idf = [math.log(1 + len(nodes) / (1 + sum(t in n.norm_label for n in nodes))) for t in terms]

    def score(n):
        bare = n.norm_label.rstrip("()")
        tier = lambda t: 1000 if t in (n.norm_label, bare) else 100 if n.norm_label.startswith(t) or bare.startswith(t) else 1 if t in n.norm_label else 0
        return sum(w * (tier(t) + (0.5 if t in n.source_file.lower() else 0)) for t, w in zip(terms, idf, strict=True))

    scores = {n.id: round(score(n), 4) for n in nodes if score(n) > 0}
    assert {r.id: round(r.score, 4) for r in catalogue.QUERIES["node_score_whole"](spark, folder).collect()} == scores
    best = sorted(scores.items(), key=lambda x: (x[1], x[0]), reverse=True)[:3]
    assert [r.id for r in catalogue.QUERIES["seed_pick_whole"](spark, folder).orderBy("rank").collect()] == [k for k, v in best if v >= 0.2 * best[0][1]]
    found = {n.id for n in nodes if "small ring" in n.norm_label or n.id.lower().startswith("small ring")}
    assert {r.id for r in catalogue.QUERIES["node_resolve_whole"](spark, folder).collect()} == found
