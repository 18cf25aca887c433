"""Directed attributed graphs as two tables, and the questions asked of them.

``nodes(ord, id, label, norm_label, source_file, source_location, file_type, community)`` and
``edges(ord, source, target, relation, confidence, context)``; ``ord`` is the place in the
source, which breaks ties. Traversals join one level at a time against the edges; a frontier
is broadcast only where its size allows, which Spark decides from its statistics.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sanitize
from tessera.operators.order import saved

# Matching bonuses, edge contexts, confidences.
EXACT, PREFIX, SUBSTRING, SOURCE = 1000.0, 100.0, 1.0, 0.5
CONTEXTS = ("call", "import", "field", "parameter_type", "return_type", "generic_arg", "attribute", "export")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
HUB_LEAST, HUB_QUANTILE = 50, 0.99


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): ends at a node, a self-loop counts twice; nodes without edges 0."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, and rounded percentages of confidences (missing or other: EXTRACTED)."""
    c = F.upper(F.col("confidence"))
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"))
    known = [F.sum((c == x).cast("long")) for x in CONFIDENCES[1:]]
    e = edges.agg(F.count("*").alias("edges"), *[F.coalesce(k, F.lit(0)).alias(x.lower()) for k, x in zip(known, CONFIDENCES[1:], strict=True)])

    def share(x: Column) -> Column:
        return F.when(F.col("edges") > 0, F.round(100 * x / F.col("edges"), 0)).otherwise(0.0).cast("long")

    both = n.withColumn("_k", F.lit(1)).join(e.withColumn("_k", F.lit(1)), "_k")
    return both.select("nodes", "edges", "communities", share(F.col("edges") - F.col("inferred") - F.col("ambiguous")).alias("extracted_pct"), share(F.col("inferred")).alias("inferred_pct"), share(F.col("ambiguous")).alias("ambiguous_pct"))


def hub_threshold(degree: DataFrame) -> DataFrame:
    """max(50, the sorted degrees' entry at int(0.99 n)), from counts by degree: no list of nodes is gathered."""
    hist = degree.groupBy("degree").agg(F.count("*").alias("c"))
    w = Window.orderBy("degree")
    run = hist.select("degree", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    at = F.least(F.floor(F.col("n") * HUB_QUANTILE), F.col("n") - 1)
    return run.where(F.col("upto") > at).agg(F.greatest(F.lit(HUB_LEAST).cast("long"), F.coalesce(F.min("degree"), F.lit(0)).cast("long")).alias("threshold"))


def label_of(label: Column, id_: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), id_)


def filter_contexts(edges: DataFrame, contexts: list[str]) -> DataFrame:
    """Edges of the contexts; none given: all."""
    return edges.where(F.col("context").isin(*contexts)) if contexts else edges


# Other names of edge contexts, and words of a question that ask for one.
ALIASES = {
    "param": "parameter_type", "params": "parameter_type", "parameter": "parameter_type", "parameters": "parameter_type", "argument": "parameter_type", "arguments": "parameter_type", "arg": "parameter_type", "args": "parameter_type",
    "return": "return_type", "returns": "return_type", "returned": "return_type",
    "generic": "generic_arg", "generics": "generic_arg", "template": "generic_arg", "templates": "generic_arg",
    "annotation": "attribute", "annotations": "attribute", "decorator": "attribute", "decorators": "attribute",
    "calls": "call", "called": "call", "invoke": "call", "invocation": "call",
    "fields": "field", "property": "field", "properties": "field", "member": "field", "members": "field",
    "imports": "import", "imported": "import", "module": "import", "modules": "import",
    "exports": "export", "exported": "export",
}
HINTS = {
    "call": ("call", "calls", "called", "invoke", "invokes", "invoked"),
    "import": ("import", "imports", "imported", "module", "modules"),
    "field": ("field", "fields", "member", "members", "property", "properties"),
    "parameter_type": ("parameter", "parameters", "param", "params", "argument", "arguments"),
    "return_type": ("return", "returns", "returned"),
    "generic_arg": ("generic", "generics", "template", "templates"),
}


def _plain(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn").lower()


def normal_contexts(names: list[str]) -> list[str]:
    """Trimmed, lower-cased, aliases resolved, distinct in their order."""
    return list(dict.fromkeys(ALIASES.get(x, x) for x in (_plain(n).strip() for n in names) if x))


def asked_contexts(question: str, given: list[str] = ()) -> tuple[list[str], str]:
    """(contexts, where from): what is given counts, else what the question's words ask for."""
    if explicit := normal_contexts(list(given)):
        return explicit, "explicit"
    words = {_plain(w) for w in re.split(r"[\s?,]+", question)}
    found = [c for c, hints in HINTS.items() if not words.isdisjoint(hints)]
    return found, "heuristic" if found else ""


def query_terms(question: str) -> list[str]:
    """Words to search labels by, in lower case.

    A part with Chinese characters gives its bigrams and itself; of others, the ASCII word
    runs; runs of at most two letters a-z are left out.
    """
    out: list[str] = []
    for part in question.lower().split():
        if re.search("[一-鿿]", part):
            out += dict.fromkeys([*(part[i : i + 2] for i in range(len(part) - 1)), part])
        else:
            out += re.findall(r"\w+", part, re.ASCII)
    return [w for w in out if not re.fullmatch("[a-z]{1,2}", w)]


def node_scores(nodes: DataFrame, terms: list[str], norm: str = "norm_label") -> DataFrame:
    """Nodes with a positive ``score``: sum over terms of idf times the best kind of match.

    The terms are few and known, so each is a column; document frequencies are one aggregate.
    """
    if not terms:
        return nodes.withColumn("score", F.lit(0.0)).where(F.lit(False))
    label, bare = F.col(norm), F.regexp_replace(F.col(norm), r"[()]+$", "")
    has = [F.contains(label, F.lit(t)) for t in terms]
    row = nodes.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(h.cast("long")), F.lit(0)).alias(f"t{k}") for k, h in enumerate(has)]).first()
    parts = []
    for k, t in enumerate(terms):
        idf = math.log(1 + row["n"] / (1 + row[f"t{k}"]))
        kind = F.when((label == t) | (bare == t), EXACT).when(label.startswith(t) | bare.startswith(t), PREFIX).when(has[k], SUBSTRING).otherwise(0.0)
        parts.append(kind * idf + F.when(F.contains(F.lower(F.coalesce("source_file", F.lit(""))), F.lit(t)), SOURCE * idf).otherwise(0.0))
    return nodes.withColumn("score", F.round(reduce(lambda a, b: a + b, parts), 6)).where("score > 0")


def seeds(scored: DataFrame, most: int = 3, least: float = 0.2) -> DataFrame:
    """At most three nodes by score (ties: id descending), down to a fifth of the best."""
    top = scored.orderBy(F.desc("score"), F.desc("id")).limit(most)
    w = Window.orderBy(F.desc("score"), F.desc("id"))
    cut = top.withColumn("rank", F.row_number().over(w)).withColumn("_best", F.max("score").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return cut.where((F.col("rank") == 1) | (F.col("score") >= least * F.col("_best"))).drop("_best")


def resolve(nodes: DataFrame, text: str, norm: str = "norm_label") -> DataFrame:
    """Nodes that the text may mean with ``tier``: 0 exact label, bare label or id; 1 prefix; 2 substring of the label."""
    t = text.strip().lower()
    label, bare = F.col(norm), F.regexp_replace(F.col(norm), r"[()]+$", "")
    id_ = F.lower("id")
    tier = F.when((label == t) | (bare == t) | (id_ == t), 0).when(label.startswith(t) | id_.startswith(t), 1).when(F.contains(label, F.lit(t)), 2)
    return nodes.withColumn("tier", tier).where("tier is not null").orderBy("tier", "ord")


def bfs(edges: DataFrame, degree: DataFrame, start: DataFrame, depth: int, threshold: int) -> DataFrame:
    """(id, level) reached over successors within ``depth``; hubs are reached but not passed, starts always are.

    One join and one anti-join a level, on the frontier only.
    """
    seen = start.select("id").distinct().withColumn("level", F.lit(0))
    out, front = seen, seen.select("id")
    open_ = degree.where(F.col("degree") < threshold).select("id")
    for level in range(1, depth + 1):
        met = front.join(edges, front.id == edges.source).select(F.col("target").alias("id")).distinct()
        new = met.join(out.select("id"), "id", "left_anti").withColumn("level", F.lit(level))
        new = saved(new, "level")
        if new.isEmpty():
            break
        out = out.unionByName(new)
        front = new.select("id").join(open_, "id", "left_semi")
    return out


def bfs_edges(edges: DataFrame, reached: DataFrame, degree: DataFrame, threshold: int) -> DataFrame:
    """Edges that the traversal walked: from an expanded node to one first seen at the next level."""
    a = reached.join(degree, "id").where((F.col("level") == 0) | (F.col("degree") < threshold)).select(F.col("id").alias("source"), F.col("level").alias("_a"))
    b = reached.select(F.col("id").alias("target"), F.col("level").alias("_b"))
    return edges.join(a, "source").join(b, "target").where("_b = _a + 1").select(edges.columns)


def distances(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(id, hops) over edges in either direction, up to ``most``."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    out = start.select("id").distinct().withColumn("hops", F.lit(0))
    front = out.select("id")
    for hop in range(1, most + 1):
        met = front.join(both, front.id == both.source).select(F.col("target").alias("id")).distinct()
        new = saved(met.join(out.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)), "level")
        if new.isEmpty():
            break
        out, front = out.unionByName(new), new.select("id")
    return out


def shortest_path(nodes: DataFrame, edges: DataFrame, a: str, b: str, most: int = 8) -> list[str]:
    """Ids from ``a`` to ``b``, by insertion order among equals; raises if it is longer than ``most``.

    Distances by level from ``a``; the way back takes the smallest ``ord`` at each level.
    """
    spark = edges.sparkSession
    reach = distances(edges, spark.createDataFrame([(a,)], "id string"), most)
    end = reach.where(F.col("id") == b).first()
    if end is None:
        raise ValueError(f"no path within {most} hops")
    path, at = [b], b
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    for hop in range(end.hops - 1, -1, -1):
        prev = both.where(F.col("target") == at).select(F.col("source").alias("id")).join(reach.where(F.col("hops") == hop), "id").join(nodes.select("id", "ord"), "id")
        at = prev.orderBy("ord").first().id
        path.append(at)
    return path[::-1]


def neighbors(nodes: DataFrame, edges: DataFrame, node: str, relation: str = "") -> DataFrame:
    """Edges of a node, outgoing before incoming, in insertion order; ``relation`` filters by substring."""
    e = edges.where(F.contains(F.lower("relation"), F.lit(relation.lower()))) if relation else edges
    out = e.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("id"), "relation", "confidence", F.col("ord").alias("edge_ord"))
    inc = e.where(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("source").alias("id"), "relation", "confidence", F.col("ord").alias("edge_ord"))
    named = out.unionByName(inc).join(nodes.select("id", "label"), "id", "left")
    return named.select("direction", "id", label_of(F.col("label"), F.col("id")).alias("label"), "relation", "confidence", "edge_ord").orderBy(F.desc("direction"), "edge_ord")


def relation_vocabulary(edges: DataFrame) -> DataFrame:
    return edges.where("relation <> ''").groupBy("relation").agg(F.count("*").alias("n")).orderBy("relation")


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """Most connected nodes, without file nodes, concepts without a file, and JSON keys that say nothing."""
    d = nodes.join(degrees(nodes, edges), "id")
    label, file = F.coalesce("label", F.lit("")), F.coalesce("source_file", F.lit(""))
    base = F.element_at(F.split(file, "/"), -1)
    file_node = ((file != "") & (label == base)) | label.rlike(r"^\..*\(\)$") | (label.rlike(r"\(\)$") & (F.col("degree") <= 1))
    concept = (file == "") | ~F.contains(base, F.lit("."))
    # Keys of JSON files that name nothing of their own.
    noise = ["start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version", "dependencies", "devdependencies", "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies"]
    json_key = F.endswith(F.lower(file), F.lit(".json")) & F.lower(F.trim(label)).isin(*noise)
    kept = d.where(~file_node & ~concept & ~json_key)
    return kept.select("id", label_of(F.col("label"), F.col("id")).alias("label"), "degree", "community", "ord").orderBy(F.desc("degree"), "ord").limit(min(top, 50))


def community_files(nodes: DataFrame) -> DataFrame:
    """Each file's majority community; ties go to the lowest."""
    c = nodes.where("source_file is not null and source_file <> '' and community is not null").groupBy("source_file", "community").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_file").orderBy(F.desc("n"), "community")
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("source_file", "community", "n")


def file_context(nodes: DataFrame, edges: DataFrame, file: str, most: int = 200) -> DataFrame:
    """Distinct relations of a file's nodes: outgoing ones, and incoming from other files."""
    own = nodes.where(F.col("source_file") == file).select("id")
    name = nodes.select("id", label_of(F.col("label"), F.col("id")).alias("label"), "source_file")
    s, t = name.toDF("source", "source_label", "source_file"), name.toDF("target", "target_label", "target_file")
    out = edges.join(own.withColumnRenamed("id", "source"), "source", "left_semi").join(s, "source").join(t, "target").select(F.lit("out").alias("direction"), "source_label", "relation", "target_label")
    inc = edges.join(own.withColumnRenamed("id", "target"), "target", "left_semi").join(s, "source").join(t, "target").where(~F.col("source_file").eqNullSafe(F.lit(file))).select(F.lit("in").alias("direction"), "source_label", "relation", "target_label")
    return out.unionByName(inc).distinct().orderBy(F.desc("direction"), "source_label", "relation", "target_label").limit(most)


def community_context(nodes: DataFrame, edges: DataFrame, community: int, top: int = 15, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """A community's most connected nodes, and its distinct edges to other communities."""
    d = nodes.join(degrees(nodes, edges), "id").where(F.col("community") == community)
    members = d.orderBy(F.desc("degree"), "ord").select("id", label_of(F.col("label"), F.col("id")).alias("label"), "degree").limit(top)
    c = nodes.select("id", label_of(F.col("label"), F.col("id")).alias("label"), "community")
    s, t = c.toDF("source", "source_label", "_a"), c.toDF("target", "target_label", "_b")
    out = edges.join(s, "source").join(t, "target").where(((F.col("_a") == community) | (F.col("_b") == community)) & ~F.col("_a").eqNullSafe(F.col("_b")))
    return members, out.select("source_label", "relation", "target_label").distinct().orderBy("source_label", "relation", "target_label").limit(most)


def community_ids(nodes: DataFrame) -> DataFrame:
    """The communities of all nodes, in order; nodes without one count for none."""
    return nodes.where("community is not null").select("community").distinct().orderBy("community")


def largest_communities(nodes: DataFrame, top: int = 10, samples: int = 5) -> DataFrame:
    """The communities with most nodes (ties: the lowest), and the labels of each one's first nodes."""
    own = nodes.where("community is not null").select("community", sanitize(label_of(F.col("label"), F.col("id"))).alias("label"), "ord", "id")
    largest = own.groupBy("community").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "community").limit(top)
    w = Window.partitionBy("community").orderBy("ord", "id")
    first = own.join(F.broadcast(largest), "community").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples)  # ``largest`` has ``top`` rows
    labels = F.transform(F.array_sort(F.collect_list(F.struct("_r", "label"))), lambda x: x.label)
    return first.groupBy("community", "nodes").agg(labels.alias("samples")).orderBy(F.desc("nodes"), "community")


def overview(nodes: DataFrame, edges: DataFrame, gods: int = 15, communities: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What tells of a whole graph: its statistics, most connected nodes, largest communities."""
    return stats(nodes, edges), god_nodes(nodes, edges, gods), largest_communities(nodes, communities)


def node_summary(label: Column, location: Column, community: Column) -> Column:
    """Label, place and community in one line; what is missing is left out."""
    place = F.when(location != "", F.concat(F.lit(" "), sanitize(location)))
    return F.concat(sanitize(label), F.coalesce(place, F.lit("")), F.coalesce(F.concat(F.lit(" community="), community.cast("string")), F.lit("")))


def node_line(label: Column, file: Column, location: Column, community: Column) -> Column:
    return F.concat(F.lit("NODE "), label, F.lit(" [src="), F.coalesce(file, F.lit("")), F.lit(" loc="), F.coalesce(location, F.lit("")), F.lit(" community="), F.coalesce(community.cast("string"), F.lit("")), F.lit("]"))


def subgraph_text(nodes: DataFrame, edges: DataFrame, reached: DataFrame, walked: DataFrame, budget_tokens: int = 2000) -> str:
    """Lines of a traversal's nodes (starts first, then by degree) and edges, cut to three characters a token.

    The traversal is bounded by depth and hubs and the text by its budget; lines are taken in
    order only as far as the budget reaches.
    """
    chars = 3 * min(4000, budget_tokens)
    d = nodes.join(degrees(nodes, edges), "id").join(reached, "id")
    lines = d.select((F.col("level") > 0).alias("late"), "degree", "ord", node_line(label_of(F.col("label"), F.col("id")), F.col("source_file"), F.col("source_location"), F.col("community")).alias("line"))
    rows = lines.orderBy("late", F.desc("degree"), "ord").select("line").limit(chars // 20 + 1).collect()
    name = nodes.select("id", label_of(F.col("label"), F.col("id")).alias("label"))
    e = walked.join(name.toDF("source", "a"), "source").join(name.toDF("target", "b"), "target").orderBy("ord").select(F.concat(F.lit("EDGE "), "a", F.lit(" --"), "relation", F.lit("--> "), "b").alias("line")).limit(chars // 12 + 1).collect()
    text = "\n".join(r.line for r in [*rows, *e])
    if len(text) <= chars:
        return text
    cut = text[:chars].rpartition("\n")[0]
    left = sum(x.startswith("NODE ") for x in text[len(cut) :].split("\n"))
    return f"{cut}\n... cut at {budget_tokens} tokens, {left} nodes left out"


def ambiguous_pick(scores: list[float]) -> bool:
    """Whether the best is within a tenth of the next."""
    return len(scores) > 1 and scores[0] > 0 and (scores[0] - scores[1]) / scores[0] < 0.10


def validate(nodes: DataFrame, edges: DataFrame) -> list[str]:
    """Faults of a graph: empty or repeated ids, edges to missing nodes. An empty graph has none."""
    out = []
    if not nodes.where("id is null or id = ''").isEmpty():
        out.append("a node has no id")
    if not nodes.groupBy("id").count().where("count > 1").isEmpty():
        out.append("an id is repeated")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    if not ends.join(nodes, "id", "left_anti").isEmpty():
        out.append("an edge leads to a missing node")
    return out
