"""The relational tables as a graph: nodes and edges, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.adjacency import Adjacency
from tessera.storage import shared_dir

_BUILT: dict[tuple[str, str, str], object] = {}


def built(spark: SparkSession, folder: str, kind: str, make: Callable[[str], object]):
    """What ``make`` builds in a new shared folder, the same one again in this session."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _BUILT:
        _BUILT[key] = make(shared_dir(spark, kind))
    return _BUILT[key]


def adjacency(spark: SparkSession, folder: str, whole: bool = True, ways: tuple[str, ...] = ("out", "in")) -> Adjacency:
    """The stored edges of the graph; not ``whole``: without orders and suppliers of parts. ``ways``: those that are needed."""

    def make(root: str) -> Adjacency:
        e = edges(spark, folder, whole)
        return Adjacency(spark, root).build(nodes(spark, folder, whole), e if whole else e.where("relation <> 'supplied_by'"), ways)

    kind = "edges" if whole else "few-edges"
    both = (spark.sparkContext.applicationId, folder, kind) in _BUILT
    return built(spark, folder, kind if both or len(ways) > 1 else f"{kind}-{ways[0]}", make)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _node(df: DataFrame, kind: str, nth: int, key: str, label, community) -> DataFrame:
    return df.select(
        (F.lit(nth * 10**12) + F.col(key)).cast("long").alias("ord"),
        F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"),
        label.alias("label"),
        F.lower(label).alias("norm_label"),
        F.lit(f"{kind}.parquet").alias("source_file"),
        F.lit("").alias("source_location"),
        F.lit("table").alias("file_type"),
        community.cast("int").alias("community"),
    )


def nodes(spark: SparkSession, folder: str, orders: bool = True) -> DataFrame:
    t = {n: read(spark, folder, n) for n in ("region", "nation", "customer", "supplier", "part", "orders")}
    reg = t["nation"].select(F.col("n_nationkey").alias("_n"), F.col("n_regionkey").alias("_r"))
    out = [
        _node(t["region"], "region", 0, "r_regionkey", F.col("r_name"), F.col("r_regionkey")),
        _node(t["nation"], "nation", 1, "n_nationkey", F.col("n_name"), F.col("n_regionkey")),
        _node(t["customer"].join(reg, F.col("c_nationkey") == F.col("_n"), "left"), "customer", 2, "c_custkey", F.col("c_name"), F.col("_r")),
        _node(t["supplier"].join(reg, F.col("s_nationkey") == F.col("_n"), "left"), "supplier", 3, "s_suppkey", F.col("s_name"), F.col("_r")),
        _node(t["part"], "part", 4, "p_partkey", F.col("p_name"), F.lit(None)),
    ]
    if orders:
        o = t["orders"].join(t["customer"].join(reg, F.col("c_nationkey") == F.col("_n"), "left").select("c_custkey", "_r"), F.col("o_custkey") == F.col("c_custkey"), "left")
        out.append(_node(o, "orders", 5, "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("_r")))
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df


def _edge(df: DataFrame, nth: int, key: str, a: str, b: str, b_key: str, relation: str, context: str, ord_=None, confidence=None) -> DataFrame:
    return df.select(
        (F.lit(nth * 10**15) + (ord_ if ord_ is not None else F.col(key))).cast("long").alias("ord"),
        F.concat(F.lit(f"{a}:"), F.col(key).cast("string")).alias("source"),
        F.concat(F.lit(f"{b}:"), F.col(b_key).cast("string")).alias("target"),
        F.lit(relation).alias("relation"),
        (confidence if confidence is not None else F.lit("EXTRACTED")).alias("confidence"),
        F.lit(context).alias("context"),
    )


def edges(spark: SparkSession, folder: str, orders: bool = True) -> DataFrame:
    t = {n: read(spark, folder, n) for n in ("nation", "customer", "supplier", "orders", "lineitem")}
    pairs = t["lineitem"].select("l_partkey", "l_suppkey").distinct()
    k = F.col("l_partkey") + F.col("l_suppkey")
    conf = F.when(k % 7 == 0, "AMBIGUOUS").when(k % 3 == 0, "INFERRED").otherwise("EXTRACTED")
    out = [
        _edge(t["nation"], 0, "n_nationkey", "nation", "region", "n_regionkey", "in_region", "field"),
        _edge(t["customer"], 1, "c_custkey", "customer", "nation", "c_nationkey", "lives_in", "call"),
        _edge(t["supplier"], 2, "s_suppkey", "supplier", "nation", "s_nationkey", "located_in", "call"),
        _edge(pairs, 4, "l_partkey", "part", "supplier", "l_suppkey", "supplied_by", "field", F.col("l_partkey") * 10**6 + F.col("l_suppkey"), conf),
    ]
    if orders:
        out.append(_edge(t["orders"], 3, "o_orderkey", "orders", "customer", "o_custkey", "placed_by", "import"))
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df


def nodes_sql(orders: bool = True) -> str:
    def one(kind: str, nth: int, key: str, label: str, community: str, source: str) -> str:
        return f"SELECT {nth * 10**12} + {key} AS ord, '{kind}:' || {key} AS id, {label} AS label, lower({label}) AS norm_label, '{kind}.parquet' AS source_file, CAST({community} AS INT) AS community FROM {source}"

    reg = "LEFT JOIN nation ON n_nationkey = "
    parts = [
        one("region", 0, "r_regionkey", "r_name", "r_regionkey", "region"),
        one("nation", 1, "n_nationkey", "n_name", "n_regionkey", "nation"),
        one("customer", 2, "c_custkey", "c_name", "n_regionkey", f"customer {reg}c_nationkey"),
        one("supplier", 3, "s_suppkey", "s_name", "n_regionkey", f"supplier {reg}s_nationkey"),
        one("part", 4, "p_partkey", "p_name", "NULL", "part"),
    ]
    if orders:
        parts.append(one("orders", 5, "o_orderkey", "'order ' || o_orderkey", "n_regionkey", f"orders LEFT JOIN customer ON o_custkey = c_custkey {reg}c_nationkey"))
    return " UNION ALL ".join(parts)


def edges_sql(orders: bool = True) -> str:
    def one(nth: int, ord_: str, a: str, key: str, b: str, b_key: str, relation: str, context: str, source: str, conf: str = "'EXTRACTED'") -> str:
        return f"SELECT {nth * 10**15} + {ord_} AS ord, '{a}:' || {key} AS source, '{b}:' || {b_key} AS target, '{relation}' AS relation, {conf} AS confidence, '{context}' AS context FROM {source}"

    conf = "CASE WHEN (l_partkey + l_suppkey) % 7 = 0 THEN 'AMBIGUOUS' WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 'INFERRED' ELSE 'EXTRACTED' END"
    parts = [
        one(0, "n_nationkey", "nation", "n_nationkey", "region", "n_regionkey", "in_region", "field", "nation"),
        one(1, "c_custkey", "customer", "c_custkey", "nation", "c_nationkey", "lives_in", "call", "customer"),
        one(2, "s_suppkey", "supplier", "s_suppkey", "nation", "s_nationkey", "located_in", "call", "supplier"),
        one(4, "l_partkey * 1000000 + l_suppkey", "part", "l_partkey", "supplier", "l_suppkey", "supplied_by", "field", "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)", conf),
    ]
    if orders:
        parts.append(one(3, "o_orderkey", "orders", "o_orderkey", "customer", "o_custkey", "placed_by", "import", "orders"))
    return " UNION ALL ".join(parts)
