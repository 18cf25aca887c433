"""A graph's edges stored once, bucketed by source and again by target, and traversals over them.

A level joins the frontier with a bucketed table: the edges stay where they are, only the
frontier is dealt out to their buckets, or sent to them where it is small. A frontier of a few
ids is looked up by value, which opens their buckets alone. Every level is written to shared
storage, so a lost executor costs a level, not the traversal.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.order import numbered, saved
from tessera.storage import Store

#: Ids up to which a frontier is looked up by value.
FEW = 64
#: Edges of a bucket beyond which there are more buckets, so that what a task sorts does not grow with the graph.
BUCKET_EDGES = 1 << 20


class Adjacency:
    """Stored edges ``(ord, source, target, relation, confidence, context, degree)``; ``degree`` is that of the end they are bucketed by."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.name = "tessera_edges_" + hashlib.sha256(self.root.encode()).hexdigest()[:16]
        self._says: dict | None = None

    def build(self, nodes: DataFrame, edges: DataFrame, ways: tuple[str, ...] = ("out", "in")) -> Adjacency:
        """Write the edges by source (``out``) and by target (``in``) and what traversals must know of the whole graph; under the same root again it replaces.

        Edges are computed once, and dealt out once a way: the join with the degrees takes them as they lie in their buckets.
        ``bfs``, ``dfs`` and ``walked`` read ``out`` only.
        """
        edges = saved(edges.select("ord", "source", "target", "relation", "confidence", "context"), "edges")
        self.buckets = max(self.buckets, -(-edges.count() // BUCKET_EDGES))
        degree = saved(graph.degrees(nodes, edges), "degrees")
        for way in ways:
            key = {"out": "source", "in": "target"}[way]
            dealt = edges.repartition(self.buckets, key).join(degree.select(F.col("id").alias(key), "degree").repartition(self.buckets, key), key)
            dealt = dealt.select("ord", "source", "target", "relation", "confidence", "context", "degree")
            dealt.write.mode("overwrite").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.root}/{way}").saveAsTable(f"{self.name}_{way}")
        store = Store(self.spark, self.root)
        store.delete("graph.json")
        store.write_new("graph.json", json.dumps({"buckets": self.buckets, "hub": graph.hub_threshold(degree).first()[0]}))
        self._says = None
        return self

    @property
    def says(self) -> dict:
        if self._says is None:
            self._says = json.loads(Store(self.spark, self.root).read("graph.json"))
        return self._says

    @property
    def hub(self) -> int:
        return self.says["hub"]

    def edges(self, way: str = "out") -> DataFrame:
        """The stored edges, by source (``out``) or by target (``in``); a new session finds them by their folder."""
        table, key = f"{self.name}_{way}", {"out": "source", "in": "target"}[way]
        if not self.spark.catalog.tableExists(table):
            columns = "ord BIGINT, source STRING, target STRING, relation STRING, confidence STRING, context STRING, degree BIGINT"
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING PARQUET CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.says['buckets']} BUCKETS LOCATION '{self.root}/{way}'")
        return self.spark.table(table)

    def _beyond(self, front: DataFrame, way: str, contexts: list[str]) -> DataFrame:
        """Edges at the frontier's ids, which come with its other columns."""
        key = {"out": "source", "in": "target"}[way]
        few = [r.id for r in front.select("id").limit(FEW + 1).collect()]
        edges = graph.filter_contexts(self.edges(way), contexts)
        if len(few) <= FEW:
            edges = edges.where(F.col(key).isin(*few)) if few else edges.where(F.lit(False))
        return edges.join(front, edges[key] == front["id"])

    def bfs(self, start: DataFrame, depth: int, contexts: list[str] = ()) -> DataFrame:
        """(id, level) reached over successors within ``depth``; hubs are reached but not passed, starts always are."""
        levels = [saved(start.select("id").distinct().withColumn("level", F.lit(0)), "level")]
        for level in range(1, depth + 1):
            walked = self._beyond(levels[-1].select("id"), "out", list(contexts))
            if level > 1:
                walked = walked.where(F.col("degree") < self.hub)
            if (new := self._unseen(walked.select(F.col("target").alias("id")), levels, level)) is None:
                break
            levels.append(new)
        return _all(levels)

    def distances(self, start: DataFrame, most: int) -> DataFrame:
        """(id, hops) over edges in either direction, up to ``most``."""
        levels = [saved(start.select("id").distinct().withColumn("level", F.lit(0)), "level")]
        for hop in range(1, most + 1):
            front = levels[-1].select("id")
            met = self._beyond(front, "out", []).select(F.col("target").alias("id")).unionByName(self._beyond(front, "in", []).select(F.col("source").alias("id")))
            if (new := self._unseen(met, levels, hop)) is None:
                break
            levels.append(new)
        return _all(levels).withColumnRenamed("level", "hops")

    def walked(self, reached: DataFrame, contexts: list[str] = ()) -> DataFrame:
        """Edges that ``bfs`` walked: from an expanded node to one first seen at the next level."""
        a = reached.select(F.col("id").alias("source"), F.col("level").alias("_a"))
        b = reached.select(F.col("id").alias("target"), F.col("level").alias("_b"))
        edges = graph.filter_contexts(self.edges("out"), list(contexts)).join(a, "source").where((F.col("_a") == 0) | (F.col("degree") < self.hub))
        return edges.join(b, "target").where("_b = _a + 1").select("ord", "source", "target", "relation", "confidence", "context")

    def _unseen(self, met: DataFrame, levels: list[DataFrame], level: int) -> DataFrame | None:
        new = saved(met.distinct().join(_all(levels).select("id"), "id", "left_anti").withColumn("level", F.lit(level)), "level")
        return None if new.isEmpty() else new

    def dfs(self, start: list[str], depth: int, contexts: list[str] = ()) -> DataFrame:
        """(nth, id, depth) in the order of a stack: the first start first, of a node's successors the last one first.

        A node's place is told by its label, the edges taken to it from its start. Labels are
        compared entry by entry, and a node takes the smallest label that a neighbour's own
        label leads to, within ``depth``. That is asked of all nodes at once and again until no
        label changes; then every label is what the stack gives, since a label's beginnings are
        smaller than it and settle before it. Hubs are reached but not passed.
        """
        if not start:
            return self.spark.createDataFrame([], "nth long, id string, depth int")
        first = list(dict.fromkeys(start))
        own = saved(self.spark.createDataFrame([(s, [k]) for k, s in enumerate(first)], "id string, label array<bigint>"), "labels")
        reached = self.bfs(own, depth, contexts)
        # edges between reached nodes, a pair once, in the order of a stack; written so as each round joins them as they lie
        inner = graph.filter_contexts(self.edges("out"), list(contexts)).join(reached.select(F.col("id").alias("source")), "source", "left_semi")
        inner = inner.where((F.col("degree") < self.hub) | F.col("source").isin(*first)).groupBy("source", "target").agg((-F.max("ord")).alias("turn"))
        inner, labels = saved(inner, "labelled-edges"), own
        while True:
            open_ = labels.where(F.size("label") <= depth)
            led = inner.join(open_, inner["source"] == open_["id"]).select(F.col("target").alias("id"), F.concat("label", F.array("turn")).alias("label"))
            new = saved(own.unionByName(led).groupBy("id").agg(F.min("label").alias("label")), "labels")
            old = labels.withColumnRenamed("label", "_old")
            same = new.join(old, "id", "full").where(~F.col("label").eqNullSafe(F.col("_old"))).isEmpty()
            labels = new
            if same:
                break
        return numbered(labels, ["label"]).select("nth", "id", (F.size("label") - 1).alias("depth"))

    def shortest_path(self, nodes: DataFrame, a: str, b: str, most: int = 8) -> list[str]:
        """Ids from ``a`` to ``b``, by insertion order among equals; raises if it is longer than ``most``."""
        reach = self.distances(self.spark.createDataFrame([(a,)], "id string"), most)
        end = reach.where(F.col("id") == b).first()
        if end is None:
            raise ValueError(f"no path within {most} hops")
        path = [b]
        for hop in range(end.hops - 1, -1, -1):
            at = self.spark.createDataFrame([(path[-1],)], "id string")
            met = self._beyond(at, "in", []).select(F.col("source").alias("id")).unionByName(self._beyond(at, "out", []).select(F.col("target").alias("id")))
            before = met.distinct().join(reach.where(F.col("hops") == hop), "id").join(nodes.select("id", "ord"), "id")
            path.append(before.orderBy("ord").first().id)
        return path[::-1]


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out
