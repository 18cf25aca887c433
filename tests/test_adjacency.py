"""Traversals over stored edges against plain ones in Python, and what their plans read."""

import random

import pytest

from tessera.operators import graph as G
from tessera.operators.adjacency import FEW, Adjacency

N = "ord long, id string, label string, norm_label string, source_file string, source_location string, file_type string, community int"
E = "ord long, source string, target string, relation string, confidence string, context string"


def frames(spark, names, edges):
    nodes = [(k, x, x, x, "f", "", "", 0) for k, x in enumerate(names)]
    return spark.createDataFrame(nodes, N), spark.createDataFrame([(k, a, b, "r", "", c) for k, (a, b, c) in enumerate(edges)], E)


def made(seed, n=25, m=60):
    rnd = random.Random(seed)
    names = [f"n{k}" for k in range(n)]
    edges = [(rnd.choice(names), rnd.choice(names), rnd.choice(["call", "import"])) for _ in range(m)]
    hub = [("n3", f"h{k}", "call") for k in range(70)]  # n3 is past the threshold
    return names + [f"h{k}" for k in range(70)], edges + hub + edges[:5]


class Plain:
    """The same questions with dictionaries and a stack."""

    def __init__(self, names, edges, contexts=()):
        self.after = {x: [] for x in names}
        self.degree = dict.fromkeys(names, 0)
        for a, b, c in edges:
            self.degree[a] += 1
            self.degree[b] += 1
            if not contexts or c in contexts:
                self.after[a].append(b)
        ranked = sorted(self.degree.values())
        self.hub = max(50, ranked[min(int(0.99 * len(ranked)), len(ranked) - 1)])

    def open(self, x, start):
        return x in start or self.degree[x] < self.hub

    def bfs(self, start, depth):
        level, front = dict.fromkeys(start, 0), list(start)
        for d in range(1, depth + 1):
            front = list(dict.fromkeys(t for x in front if self.open(x, start) for t in self.after[x] if t not in level))
            level |= dict.fromkeys(front, d)
        return level

    def dfs(self, start, depth):
        stack, seen = [(x, 0) for x in reversed(start)], {}
        while stack:
            x, d = stack.pop()
            if x in seen or d > depth:
                continue
            seen[x] = d
            if self.open(x, start):
                stack += [(t, d + 1) for t in self.after[x] if t not in seen]
        return list(seen.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_plain_traversals(spark, tmp_path, seed):
    names, edges = made(seed)
    g = Adjacency(spark, str(tmp_path / "g"), 4).build(*frames(spark, names, edges))
    start = ["n0", "n7"]
    some = spark.createDataFrame([(x,) for x in start], "id string")
    for contexts, depth in ((), 4), (("call",), 3):
        plain = Plain(names, edges, contexts)
        assert g.hub == plain.hub
        assert {r.id: r.level for r in g.bfs(some, depth, list(contexts)).collect()} == plain.bfs(start, depth)
        got = sorted((r.nth, r.id, r.depth) for r in g.dfs(start, depth, list(contexts)).collect())
        assert [x[1:] for x in got] == plain.dfs(start, depth) and [x[0] for x in got] == list(range(len(got)))


def test_a_node_first_met_deep_is_not_passed_again(spark, tmp_path):
    # the stack takes a's last edge first and meets d at the limit, so e is never reached, though a -> d -> e is short
    names, edges = list("abcde"), [("a", "d", ""), ("a", "b", ""), ("b", "c", ""), ("c", "d", ""), ("d", "e", "")]
    g = Adjacency(spark, str(tmp_path / "g"), 4).build(*frames(spark, names, edges))
    assert [(r.id, r.depth) for r in g.dfs(["a"], 3).orderBy("nth").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert [(r.id, r.depth) for r in g.dfs(["a"], 4).orderBy("nth").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]
    assert g.dfs([], 3).count() == 0


def test_distances_paths_and_walked_edges(spark, tmp_path):
    names, edges = made(4)
    n, e = frames(spark, names, edges)
    g = Adjacency(spark, str(tmp_path / "g"), 4).build(n, e)
    start = spark.createDataFrame([("n1",)], "id string")
    assert {tuple(r) for r in g.distances(start, 4).collect()} == {tuple(r) for r in G.distances(e, start, 4).collect()}
    for end in ("n9", "h5"):
        assert g.shortest_path(n, "n1", end) == G.shortest_path(n, e, "n1", end)
    with pytest.raises(ValueError):
        g.shortest_path(n, "n1", "h5", 1)
    d = G.degrees(n, e)
    reached = g.bfs(start, 3)
    assert {r.ord for r in g.walked(reached).collect()} == {r.ord for r in G.bfs_edges(e, G.bfs(e, d, start, 3, g.hub), d, g.hub).collect()}


def plan_of(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_edges_are_not_dealt_out_again(spark, tmp_path):
    names, edges = made(5)
    g = Adjacency(spark, str(tmp_path / "g"), 4).build(*frames(spark, names, edges))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # or the plan does not tell of buckets
    few = plan_of(g._beyond(spark.createDataFrame([("n1",)], "id string"), "out", []))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in few  # a few ids: their buckets alone
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = spark.createDataFrame([(f"n{k}",) for k in range(FEW + 5)], "id string")
        plan = plan_of(g._beyond(front, "out", []))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plan.split("\n") if x.startswith("Arguments: hashpartitioning(")]
    assert "SortMergeJoin" in plan and len(dealt) == 1 and dealt[0].startswith("Arguments: hashpartitioning(id")  # the frontier's only


def test_a_new_session_finds_the_stored_edges(spark, tmp_path):
    names, edges = made(6)
    root = str(tmp_path / "g")
    Adjacency(spark, root, 4).build(*frames(spark, names, edges))
    for way in ("out", "in"):
        spark.sql(f"DROP TABLE {Adjacency(spark, root).name}_{way}")  # what a restart forgets; the files stay
    again = Adjacency(spark, root)
    start = spark.createDataFrame([("n0",)], "id string")
    assert {r.id: r.level for r in again.bfs(start, 3).collect()} == Plain(names, edges).bfs(["n0"], 3)


def test_buckets_follow_the_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.operators.adjacency.BUCKET_EDGES", 10)
    names, edges = made(7)
    g = Adjacency(spark, str(tmp_path / "g"), 4).build(*frames(spark, names, edges), ("out",))
    assert g.says["buckets"] == -(-len(edges) // 10) and not spark.catalog.tableExists(f"{g.name}_in")
    files = [f for f in (tmp_path / "g" / "out").iterdir() if f.name.endswith(".parquet")]
    assert len(files) <= g.says["buckets"]  # each bucket is one task's, though edges were joined on the way
    start = spark.createDataFrame([("n0",)], "id string")
    again = Adjacency(spark, str(tmp_path / "g"))
    assert {r.id: r.level for r in again.bfs(start, 3).collect()} == Plain(names, edges).bfs(["n0"], 3)


def test_empty_graph(spark, tmp_path):
    g = Adjacency(spark, str(tmp_path / "g"), 4).build(spark.createDataFrame([], N), spark.createDataFrame([], E))
    start = spark.createDataFrame([("x",)], "id string")
    assert [tuple(r) for r in g.bfs(start, 3).collect()] == [("x", 0)] and g.hub == 50
    assert g.distances(start.limit(0), 2).count() == 0
