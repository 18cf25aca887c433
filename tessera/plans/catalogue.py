"""Registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import globs, markdown
from tessera.functions import text as TX
from tessera.operators import catalog, graph, lexical, sync, vector
from tessera.plans import star
from tessera.plans.star import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


# --- full-text search ---------------------------------------------------------------------

_TOK = f"regexp_extract_all(lower(coalesce(text, '')), '{TX.TOKEN}')"


def _tf_sql(a: lexical.Atom) -> str:
    w = a.words
    if len(w) == 1:
        return f"len([x for x in tok if starts_with(x, '{w[0]}')])" if a.prefix else f"len([x for x in tok if x = '{w[0]}'])"
    conds = " AND ".join(f"tok[i + {k}] = '{x}'" for k, x in enumerate(w))
    return f"len([i for i in range(1, len(tok) - {len(w)} + 2) if {conds}])"


def _hits_sql(source: str, columns: str, text: str) -> str:
    """CTEs up to ``hits``: the columns and the BM25 score of rows that satisfy the query."""
    q = lexical.parse(text)
    every = [*q.atoms, *[a for a in q.without if a not in q.atoms]]
    name = {a: f"tf{k}" for k, a in enumerate(every)}
    score = " + ".join(f"ln(1 + (n - df_{c} + 0.5) / (df_{c} + 0.5)) * {c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * dl / mean))" for c in (name[a] for a in q.atoms))
    where = " AND ".join(["(" + " OR ".join(f"{name[a]} > 0" for a in g) + ")" for g in q.groups] + [f"{name[a]} = 0" for a in q.without])
    return f"""
WITH tk AS (SELECT {columns}, {_TOK} AS tok FROM {source}),
ct AS (SELECT {columns}, len(tok) AS dl, {', '.join(f'{_tf_sql(a)} AS {c}' for a, c in name.items())} FROM tk),
st AS (SELECT count(*) AS n, avg(dl) AS mean, {', '.join(f'sum(CAST({name[a]} > 0 AS INT)) AS df_{name[a]}' for a in q.atoms)} FROM ct),
hits AS (SELECT {columns}, round({score}, 6) AS score FROM ct, st WHERE {where})
"""


_CHAT = "that OR thing with"


@query(_hits_sql("conversations", "conv_id, turn", _CHAT) + ", best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS r FROM hits) SELECT conv_id, turn, score FROM best WHERE r = 1 ORDER BY score DESC, conv_id LIMIT 10")
def lexical_top_docs(spark, folder):
    """Flagship: BM25 over conversation turns, each conversation's best turn, the ten best."""
    chunks = read(spark, folder, "conversations").select("conv_id", "turn", "text")
    return lexical.best_chunks(lexical.matches(chunks, lexical.parse(_CHAT)), ["conv_id"], "turn", 10).select("conv_id", "turn", "score")


def _documents(text: str):
    sql = _hits_sql("documents", "doc_id", text) + "SELECT doc_id, score FROM hits ORDER BY score DESC, doc_id LIMIT 25"

    def run(spark, folder):
        hits = lexical.matches(read(spark, folder, "documents").select("doc_id", "text"), lexical.parse(text))
        return hits.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)

    return sql, run


for _name, _text in {"lexical_and_required": "trash OR stupid OR idiot the", "lexical_phrase": '"of the" in', "lexical_prefix": "thing* with", "lexical_not": "that with -from NOT was"}.items():
    SQL[_name], QUERIES[_name] = _documents(_text)


@query(_hits_sql("documents", "doc_id", "that from") + "SELECT doc_id, score, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY score DESC, doc_id LIMIT 20 OFFSET 20")
def lexical_page(spark, folder):
    """Second page of twenty, with the exact total."""
    hits = lexical.matches(read(spark, folder, "documents").select("doc_id", "text"), lexical.parse("that from")).select("doc_id", F.round("score", 6).alias("score"))
    rows, total = lexical.page(hits, [F.desc("score"), "doc_id"], 2, 20, 100)
    return rows.withColumn("total", F.lit(total).cast("long"))


@query(f"""
WITH o AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn, text) - 1 AS i, count(*) OVER () AS n FROM conversations),
s AS (SELECT text, greatest(1, n // 2000) AS stride, i FROM o WHERE i % greatest(1, n // 2000) = 0),
t AS (SELECT unnest(list_distinct({_TOK})) AS term FROM s),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT term, df FROM d WHERE df >= greatest(1, CAST(floor(0.35 * (SELECT count(*) FROM s)) AS BIGINT)) ORDER BY df DESC, term LIMIT 500""")
def frequent_terms(spark, folder):
    return lexical.frequent_terms(read(spark, folder, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn", "text"])


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, len(list_intersect(list_distinct(regexp_extract_all(lower(line), '""" + TX.TOKEN + """')), ['the', 'that', 'with', 'stupid'])) AS c FROM l),
m AS (SELECT doc_id, max(c) AS top FROM c GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(min(i) FILTER (WHERE top > 0 AND c = top), 1) AS INT) AS line FROM c JOIN m USING (doc_id) GROUP BY m.doc_id""")
def matching_line(spark, folder):
    return read(spark, folder, "documents").select("doc_id", lexical.matching_line(F.col("text"), ["the", "that", "with", "stupid"]).alias("line"))


# --- vectors and fusion --------------------------------------------------------------------

#: A fixed query vector.
_QUERY = [((k * 37) % 19 - 9) / 10 for k in range(64)]
_COS = f"round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), 6)"


@query(f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, folder):
    return vector.top_k(read(spark, folder, "embeddings"), _QUERY, 20, ["vec_id"]).select("vec_id", "score")


@query(f"SELECT vec_id, label, {_COS} AS score FROM embeddings WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark, folder):
    return vector.top_k(read(spark, folder, "embeddings").where(F.col("label").isin(1, 3)), _QUERY, 20, ["vec_id"]).select("vec_id", "label", "score")


@query(f"WITH t AS (SELECT vec_id, label, {_COS} AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM t) SELECT label, vec_id, score FROM r WHERE r = 1")
def vector_group_docs(spark, folder):
    scored = read(spark, folder, "embeddings").select("label", "vec_id", F.round(vector.cosine(F.col("embedding"), _QUERY), 6).alias("score"))
    return vector.best_per_doc(scored, ["label"], ["vec_id"])


_NOW = "TIMESTAMP '2026-01-01 00:00:00'"


@query(f"""
WITH t AS (SELECT vec_id, {_COS} AS raw, ts FROM embeddings LEFT JOIN events ON event_id = vec_id),
a AS (SELECT vec_id, CASE WHEN ts IS NOT NULL AND ts < {_NOW} THEN raw * (0.8 + 0.2 * pow(2.0, -((epoch_us({_NOW}) - epoch_us(ts)) / 86400000000.0) / 730.0)) ELSE raw END AS s FROM t)
SELECT vec_id, round(s, 6) AS score FROM a ORDER BY score DESC, vec_id LIMIT 30""")
def recency_rank(spark, folder):
    scored = read(spark, folder, "embeddings").select("vec_id", F.round(vector.cosine(F.col("embedding"), _QUERY), 6).alias("raw"))
    ts = read(spark, folder, "events").select(F.col("event_id").alias("vec_id"), "ts")
    aged = scored.join(ts, "vec_id", "left").select("vec_id", F.round(vector.recency(F.col("raw"), F.col("ts"), F.expr(_NOW)), 6).alias("score"))
    return aged.orderBy(F.desc("score"), "vec_id").limit(30)


@query(_hits_sql("documents", "doc_id", "that OR with OR stupid") + f""",
lx AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM hits QUALIFY rank < 12),
sm AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) - 1 AS rank FROM embeddings WHERE label IN (0, 1) QUALIFY rank < 12),
u AS (SELECT doc_id, rank, 0 AS nth, 'lexical' AS arm, 1.0 / (20 + rank + 1) AS w FROM lx UNION ALL SELECT doc_id, rank, 1, 'semantic', 1.0 / (20 + rank + 1) FROM sm)
SELECT doc_id, round(sum(w), 9) AS score, min(rank) AS best_rank, arg_min(arm, rank * 2 + nth) AS best_arm FROM u GROUP BY doc_id""")
def hybrid_rrf(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    hits = lexical.matches(docs, lexical.parse("that OR with OR stupid")).select("doc_id", F.round("score", 6).alias("score"))
    near = read(spark, folder, "embeddings").where(F.col("label").isin(0, 1)).select(F.col("vec_id").alias("doc_id"), F.round(vector.cosine(F.col("embedding"), _QUERY), 6).alias("score"))
    order = [F.desc("score"), "doc_id"]
    return vector.fuse({"lexical": vector.ranked(hits, order, 12), "semantic": vector.ranked(near, order, 12)}, ["doc_id"])


@query("SELECT o_orderkey, c_name, n_name, r_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def enrich_hits(spark, folder):
    """Metadata of the fifty largest orders: a bounded result, three left joins."""
    top = read(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).withColumnRenamed("o_custkey", "c_custkey")
    c = read(spark, folder, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    n = read(spark, folder, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return catalog.enrich(top, (c, ["c_custkey"]), (n, ["n_nationkey"]), (read(spark, folder, "region"), ["r_regionkey"])).select("o_orderkey", "c_name", "n_name", "r_name")


@query("""
WITH RECURSIVE l AS (SELECT 'supplier' || (l_suppkey % 7) AS repo, 'f' || (l_partkey % 5) AS path, CAST(l_orderkey % 300 AS INT) AS a, CAST(l_orderkey % 300 AS INT) + CAST(l_quantity AS INT) AS b, l_extendedprice, l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS n FROM lineitem),
h AS MATERIALIZED (SELECT repo, path, a, b, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, repo, path, n) - 1 AS rank FROM l QUALIFY rank < 400),
walk AS (
  SELECT CAST(0 AS BIGINT) AS nth, list_slice([{'repo': '', 'path': '', 'a': 0, 'b': 0, 'rank': CAST(0 AS BIGINT)}], 1, 0) AS kept
  UNION ALL
  SELECT nth + 1, CASE WHEN len([x for x in kept if x.repo = h.repo AND x.path = h.path AND least(x.b, h.b) >= greatest(x.a, h.a)
      AND (least(x.b, h.b) - greatest(x.a, h.a) + 1) * 2 >= least(x.b - x.a + 1, h.b - h.a + 1)]) > 0 THEN kept
    ELSE list_append(kept, {'repo': h.repo, 'path': h.path, 'a': h.a, 'b': h.b, 'rank': h.rank}) END
  FROM walk JOIN h ON h.rank = nth),
last AS (SELECT unnest(kept) AS x FROM walk WHERE nth = (SELECT max(nth) FROM walk))
SELECT x.repo AS repo, x.path AS path, x.a AS start_line, x.b AS end_line, x.rank AS rank FROM last ORDER BY rank LIMIT 100""")
def overlap_suppression(spark, folder):
    """Line ranges of the 400 best rows of lineitem, those that a better one covers left out."""
    rows = read(spark, folder, "lineitem").select(F.concat(F.lit("supplier"), F.col("l_suppkey") % 7).alias("repo"), F.concat(F.lit("f"), F.col("l_partkey") % 5).alias("path"), (F.col("l_orderkey") % 300).cast("int").alias("start_line"), F.col("l_quantity").cast("int").alias("len"), "l_extendedprice", "l_orderkey", "l_linenumber")
    hits = vector.ranked(rows, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "repo", "path", "len"], 400).withColumn("end_line", F.col("start_line") + F.col("len"))
    return vector.suppress_overlaps(hits.select("repo", "path", "start_line", "end_line", F.col("rank").cast("long").alias("rank")), 100)


# --- graph ----------------------------------------------------------------------------------

_G = f"WITH RECURSIVE nodes AS ({star.nodes_sql()}), edges AS ({star.edges_sql()}), deg AS (SELECT id, count(x) AS degree FROM nodes LEFT JOIN (SELECT source AS x FROM edges UNION ALL SELECT target FROM edges) ON x = id GROUP BY id)"
_THRESHOLD = ", srt AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM deg), hub AS (SELECT greatest(50, min(degree)) AS threshold FROM srt WHERE i = least(CAST(floor(0.99 * n) AS BIGINT), n - 1))"


def _graph(spark, folder):
    return star.nodes(spark, folder), star.edges(spark, folder)


@query(_G + " SELECT id, degree FROM deg")
def graph_degree(spark, folder):
    return graph.degrees(*_graph(spark, folder))


@query(_G + """, e AS (SELECT count(*) AS edges, sum(CAST(confidence = 'INFERRED' AS INT)) AS i, sum(CAST(confidence = 'AMBIGUOUS' AS INT)) AS a FROM edges)
SELECT (SELECT count(*) FROM nodes) AS nodes, edges, (SELECT count(DISTINCT community) FROM nodes) AS communities,
CAST(round(100.0 * (edges - i - a) / edges) AS BIGINT) AS extracted_pct, CAST(round(100.0 * i / edges) AS BIGINT) AS inferred_pct, CAST(round(100.0 * a / edges) AS BIGINT) AS ambiguous_pct FROM e""")
def graph_stats(spark, folder):
    return graph.stats(*_graph(spark, folder))


@query(_G + _THRESHOLD + " SELECT threshold FROM hub")
def hub_threshold(spark, folder):
    return graph.hub_threshold(graph.degrees(*_graph(spark, folder)))


@query(_G + " SELECT id, label, degree, community, ord FROM nodes JOIN deg USING (id) WHERE label <> source_file ORDER BY degree DESC, ord LIMIT 10")
def god_nodes(spark, folder):
    return graph.god_nodes(*_graph(spark, folder), 10)


def _bfs_sql(starts: list[str], depth: int, where: str = "true") -> str:
    some = ", ".join(f"'{s}'" for s in starts)
    return _G + _THRESHOLD + f""", reach AS (
SELECT id, 0 AS level FROM nodes WHERE id IN ({some})
UNION
SELECT e.target, level + 1 FROM reach JOIN edges e ON e.source = reach.id JOIN deg ON deg.id = reach.id, hub WHERE level < {depth} AND (level = 0 OR degree < threshold) AND {where})
SELECT id, min(level) AS level FROM reach GROUP BY id"""


_STARTS = ["part:1", "part:7", "orders:3"]


def _bfs(spark, folder, contexts, depth):
    start = spark.createDataFrame([(s,) for s in _STARTS], "id string").join(star.nodes(spark, folder).select("id"), "id", "left_semi")
    return star.adjacency(spark, folder, ways=("out",)).bfs(start, depth, contexts)


@query(_bfs_sql(_STARTS, 4))
def graph_bfs(spark, folder):
    return _bfs(spark, folder, [], 4)


@query(_bfs_sql(_STARTS, 3, "e.context IN ('field', 'import')"))
def graph_bfs_filtered(spark, folder):
    return _bfs(spark, folder, ["field", "import"], 3)


@query(_G + _THRESHOLD + f""", kids AS MATERIALIZED (SELECT source, list(target ORDER BY ord) AS kids FROM edges WHERE source IN (SELECT id FROM deg, hub WHERE degree < threshold) OR source IN ({", ".join(f"'{s}'" for s in _STARTS[:2])}) GROUP BY source),
walk(stack, seen, depths) AS (
  SELECT [{{'id': '{_STARTS[1]}', 'd': 0}}, {{'id': '{_STARTS[0]}', 'd': 0}}], []::VARCHAR[], []::INTEGER[]
  UNION ALL
  SELECT CASE WHEN list_contains(seen, stack[-1].id) OR stack[-1].d > 3 THEN stack[:-2]
           ELSE list_concat(stack[:-2], [{{'id': k, 'd': stack[-1].d + 1}} for k in coalesce(kids, []) if NOT list_contains(seen, k)]) END,
    CASE WHEN list_contains(seen, stack[-1].id) OR stack[-1].d > 3 THEN seen ELSE list_append(seen, stack[-1].id) END,
    CASE WHEN list_contains(seen, stack[-1].id) OR stack[-1].d > 3 THEN depths ELSE list_append(depths, stack[-1].d) END
  FROM walk LEFT JOIN kids ON kids.source = stack[-1].id WHERE len(stack) > 0),
done AS (SELECT seen, depths FROM walk WHERE len(stack) = 0)
SELECT unnest(range(len(seen))) AS nth, unnest(seen) AS id, unnest(depths) AS depth FROM done""")
def graph_dfs(spark, folder):
    """Visiting order of a stack from two parts; the SQL keeps the stack as a list."""
    return star.adjacency(spark, folder, ways=("out",)).dfs(_STARTS[:2], 3)


_DIM = f"WITH RECURSIVE nodes AS ({star.nodes_sql(False)}), edges AS (SELECT * FROM ({star.edges_sql(False)}) WHERE relation <> 'supplied_by'), both_ AS (SELECT DISTINCT source, target FROM edges UNION SELECT target, source FROM edges)"


@query(_DIM + """, reach AS (SELECT 'customer:0' AS id, 0 AS hops UNION SELECT b.target, hops + 1 FROM reach JOIN both_ b ON b.source = id WHERE hops < 4)
SELECT id, min(hops) AS hops FROM reach GROUP BY id""")
def shortest_path_hops(spark, folder):
    return star.adjacency(spark, folder, False).distances(spark.createDataFrame([("customer:0",)], "id string"), 4)


@query(f"WITH RECURSIVE edges AS MATERIALIZED ({star.edges_sql()}), both_ AS MATERIALIZED (SELECT source, target FROM edges UNION SELECT target, source FROM edges)" + """, reach AS (SELECT 'customer:0' AS id, 0 AS hops UNION SELECT b.target, hops + 1 FROM reach JOIN both_ b ON b.source = id WHERE hops < 4)
SELECT id, min(hops) AS hops FROM reach GROUP BY id""")
def shortest_path_hops_whole(spark, folder):
    """Over all edges, orders and suppliers of parts too."""
    return star.adjacency(spark, folder).distances(spark.createDataFrame([("customer:0",)], "id string"), 4)


@query(_G + """ SELECT d.direction, d.id, label, relation, confidence, edge_ord FROM (
SELECT 'out' AS direction, target AS id, relation, confidence, ord AS edge_ord FROM edges WHERE source = 'nation:3'
UNION ALL SELECT 'in', source, relation, confidence, ord FROM edges WHERE target = 'nation:3') d JOIN nodes USING (id)""")
def neighbors(spark, folder):
    return graph.neighbors(*_graph(spark, folder), "nation:3")


@query(f"WITH nodes AS ({star.nodes_sql()}) SELECT id, label, ord FROM nodes WHERE community = 2 ORDER BY ord LIMIT 50 OFFSET 50")
def community_members(spark, folder):
    """Second page of a community's members in insertion order."""
    rows, _, _ = catalog.page(star.nodes(spark, folder).where("community = 2").select("id", "label", "ord"), ["ord"], 2, 50)
    return rows


@query(f"WITH nodes AS ({star.nodes_sql()}), c AS (SELECT source_file, community, count(*) AS n FROM nodes WHERE community IS NOT NULL GROUP BY 1, 2) SELECT source_file, community, n FROM c QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY n DESC, community) = 1")
def community_majority(spark, folder):
    return graph.community_files(star.nodes(spark, folder))


@query(f"WITH edges AS ({star.edges_sql()}) SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def relation_vocab(spark, folder):
    return graph.relation_vocabulary(star.edges(spark, folder))


@query(_G + """ SELECT DISTINCT * FROM (
SELECT 'out' AS direction, s.label AS source_label, relation, t.label AS target_label FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.source_file = 'nation.parquet'
UNION ALL SELECT 'in', s.label, relation, t.label FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE t.source_file = 'nation.parquet' AND s.source_file <> 'nation.parquet')
ORDER BY direction DESC, source_label, relation, target_label LIMIT 200""")
def file_context_edges(spark, folder):
    return graph.file_context(*_graph(spark, folder), "nation.parquet")


_TERMS = ["ring", "red", "nation"]


def _score_sql(orders: bool = False) -> str:
    dfs = ", ".join(f"sum(CAST(contains(norm_label, '{t}') AS INT)) AS d{k}" for k, t in enumerate(_TERMS))
    bare = "regexp_replace(norm_label, '[()]+$', '')"
    parts = " + ".join(
        f"ln(1 + n / (1.0 + d{k})) * (CASE WHEN norm_label = '{t}' OR {bare} = '{t}' THEN 1000.0 WHEN starts_with(norm_label, '{t}') OR starts_with({bare}, '{t}') THEN 100.0 WHEN contains(norm_label, '{t}') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(source_file), '{t}') THEN 0.5 ELSE 0.0 END)"
        for k, t in enumerate(_TERMS)
    )
    return f"WITH nodes AS ({star.nodes_sql(orders)}), s AS (SELECT count(*) AS n, {dfs} FROM nodes), scored AS (SELECT id, round({parts}, 6) AS score FROM nodes, s)"


@query(_score_sql() + " SELECT id, score FROM scored WHERE score > 0")
def node_score(spark, folder):
    return graph.node_scores(star.nodes(spark, folder, False), _TERMS).select("id", "score")


@query(_score_sql() + ", top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id DESC) AS rank, max(score) OVER () AS best FROM scored WHERE score > 0) SELECT id, score, CAST(rank AS INT) AS rank FROM top WHERE rank <= 3 AND (rank = 1 OR score >= 0.2 * best)")
def seed_pick(spark, folder):
    return graph.seeds(graph.node_scores(star.nodes(spark, folder, False), _TERMS)).select("id", "score", "rank")


@query(f"WITH nodes AS ({star.nodes_sql(False)}) SELECT id, ord, CASE WHEN norm_label = 'small ring' OR lower(id) = 'small ring' THEN 0 WHEN starts_with(norm_label, 'small ring') OR starts_with(lower(id), 'small ring') THEN 1 ELSE 2 END AS tier FROM nodes WHERE contains(norm_label, 'small ring') OR starts_with(lower(id), 'small ring')")
def node_resolve(spark, folder):
    return graph.resolve(star.nodes(spark, folder, False), "Small ring").select("id", "ord", "tier")


@query(_score_sql(True) + " SELECT id, score FROM scored WHERE score > 0")
def node_score_whole(spark, folder):
    """Over all nodes, orders too: they count in the inverse frequencies."""
    return graph.node_scores(star.nodes(spark, folder), _TERMS).select("id", "score")


@query(_score_sql(True) + ", top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id DESC) AS rank, max(score) OVER () AS best FROM scored WHERE score > 0) SELECT id, score, CAST(rank AS INT) AS rank FROM top WHERE rank <= 3 AND (rank = 1 OR score >= 0.2 * best)")
def seed_pick_whole(spark, folder):
    return graph.seeds(graph.node_scores(star.nodes(spark, folder), _TERMS)).select("id", "score", "rank")


@query(f"WITH nodes AS ({star.nodes_sql()}) SELECT id, ord, CASE WHEN norm_label = 'small ring' OR lower(id) = 'small ring' THEN 0 WHEN starts_with(norm_label, 'small ring') OR starts_with(lower(id), 'small ring') THEN 1 ELSE 2 END AS tier FROM nodes WHERE contains(norm_label, 'small ring') OR starts_with(lower(id), 'small ring')")
def node_resolve_whole(spark, folder):
    return graph.resolve(star.nodes(spark, folder), "Small ring").select("id", "ord", "tier")


# --- catalog and history ----------------------------------------------------------------------

@query("WITH c AS (SELECT 'team' || c_nationkey || '/' || lower(c_mktsegment) || c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 'ready' ELSE 'error' END AS status, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'odd' END AS namespace FROM customer) SELECT id, status, namespace, (SELECT count(*) FROM c WHERE id ILIKE '%build%' AND status = 'ready' AND namespace = '') AS total FROM c WHERE id ILIKE '%build%' AND status = 'ready' AND namespace = '' ORDER BY id LIMIT 20 OFFSET 20")
def catalog_filter_page(spark, folder):
    df = read(spark, folder, "customer").select(F.concat(F.lit("team"), F.col("c_nationkey"), F.lit("/"), F.lower("c_mktsegment"), F.col("c_custkey")).alias("id"), F.when(F.col("c_acctbal") > 0, "ready").otherwise("error").alias("status"), F.when(F.col("c_nationkey") % 2 == 0, "").otherwise("odd").alias("namespace"))
    rows, total, _ = catalog.page(catalog.repos(df, search="build", status="ready", namespace="default"), ["id"], 2, 20)
    return rows.withColumn("total", F.lit(total).cast("long"))


@query("SELECT 'nation' || c_nationkey || '/' || lower(c_mktsegment) AS owner, count(*) AS repos FROM customer GROUP BY 1")
def owner_groups(spark, folder):
    df = read(spark, folder, "customer").select(F.concat(F.lit("nation"), F.col("c_nationkey"), F.lit("/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_custkey")).alias("id"))
    return catalog.owner_groups(df)


@query("SELECT namespace, coalesce(c, 0) AS repos, coalesce(r_name, '') AS description FROM (SELECT lang AS namespace, count(*) AS c FROM documents GROUP BY 1) FULL JOIN (SELECT CASE r_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'zz' || r_regionkey END AS namespace, r_name FROM region) USING (namespace)")
def namespace_groups(spark, folder):
    docs = read(spark, folder, "documents").select(F.col("lang").alias("namespace"))
    told = read(spark, folder, "region").select(F.when(F.col("r_regionkey") == 0, "en").when(F.col("r_regionkey") == 1, "de").otherwise(F.concat(F.lit("zz"), F.col("r_regionkey"))).alias("namespace"), F.col("r_name").alias("description"))
    return catalog.namespace_groups(docs, told)


@query("""
WITH t AS (SELECT doc_id, unnest([source, upper(source), lang]) AS team, unnest([0, 1, 2]) AS p FROM documents)
SELECT arg_min(team, doc_id * 10 + p) AS team, lower(team) AS key FROM t GROUP BY lower(team)""")
def distinct_teams(spark, folder):
    df = read(spark, folder, "documents").select("doc_id", F.array("source", F.upper("source"), "lang").alias("teams"))
    return catalog.distinct_teams(df, "teams", "doc_id")


_LINES = "SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS nth FROM lineitem"


@query(f"""
WITH one AS (SELECT * FROM ({_LINES}) WHERE nth = 1),
m AS (SELECT *, CASE WHEN l_returnflag = lag(l_returnflag) OVER w AND l_linenumber = lag(l_linenumber) OVER w + 1 THEN 0 ELSE 1 END AS new FROM one WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM m)
SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_linenumber) AS line_start, max(l_linenumber) AS line_end, count(*) AS lines FROM r GROUP BY l_orderkey, run""")
def blame_hunks(spark, folder):
    """Neighbouring lines of an order with one flag: gaps and islands."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    one = read(spark, folder, "lineitem").withColumn("nth", F.row_number().over(w)).where("nth = 1").select("l_orderkey", "l_linenumber", "l_returnflag")
    return catalog.islands(one, ["l_orderkey"], "l_linenumber", ["l_linenumber"], "l_returnflag")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT o_orderkey, o_custkey FROM r WHERE r > 1 AND epoch_us(TIMESTAMP '2001-01-01 00:00:00') - epoch_us(o_orderdate) >= 300000000""")
def snapshot_retention(spark, folder):
    df = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    age = (F.unix_micros(F.expr("TIMESTAMP '2001-01-01 00:00:00'")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 60_000_000
    return catalog.expired_snapshots(df, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], age).select("o_orderkey", "o_custkey")


@query("WITH r AS (SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 24 AS pack FROM part) SELECT p_brand, pack, count(*) AS files, min(p_partkey) AS first, max(p_partkey) AS last FROM r GROUP BY 1, 2")
def group_packing(spark, folder):
    packed = catalog.pack(read(spark, folder, "part").select("p_partkey", "p_brand"), ["p_brand"], ["p_partkey"])
    return packed.groupBy("p_brand", "pack").agg(F.count("*").alias("files"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


# --- synchronisation ---------------------------------------------------------------------------

@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def prune_anti(spark, folder):
    """Documents that a complete sweep (the labelled ids) has not seen."""
    docs, seen = read(spark, folder, "documents").select("doc_id"), read(spark, folder, "labels").select("doc_id")
    return sync.prune(docs, seen, docs.limit(0), ["doc_id"], True)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def index_repair(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id")
    a, b = read(spark, folder, "labels").select("doc_id"), read(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return sync.missing_from_indexes(docs, [a, b], read(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id")), ["doc_id"])


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT doc_id, CAST(n_chars % 2 AS INT), 0 FROM documents WHERE lang = 'fr'")
def delta_upsert(spark, folder):
    new = read(spark, folder, "documents").where("lang = 'fr'").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return sync.upsert(read(spark, folder, "labels"), new, ["doc_id"])


@query("""
WITH s AS (SELECT doc_id, left(sha256(CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE text END), 32) AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT d.doc_id, left(sha256(text), 32) AS hash, CASE WHEN s.h IS NULL THEN 'added' WHEN s.h <> left(sha256(text), 32) THEN 'updated' ELSE 'unchanged' END AS change FROM documents d LEFT JOIN s USING (doc_id)""")
def hash_change_detect(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    stored = docs.where("doc_id % 3 <> 0").select("doc_id", TX.content_hash(F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text"))).alias("hash"))
    return sync.changed(docs, stored, ["doc_id"], "text").select("doc_id", "hash", "change")


@query("""
WITH r AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')
SELECT event_type, count(*) AS rows_read, (SELECT strftime(date_trunc('minute', max(ts) - INTERVAL 1 MINUTE), '%Y-%m-%d %H:%M') FROM r) AS watermark FROM r GROUP BY event_type""")
def incremental_watermark(spark, folder):
    rows = sync.since(read(spark, folder, "events"), "ts", F.expr("TIMESTAMP '2024-01-10 00:00:00'"))
    mark = sync.next_watermark(rows, "ts").select(F.date_format("watermark", "yyyy-MM-dd HH:mm").alias("watermark"))
    return rows.groupBy("event_type").agg(F.count("*").alias("rows_read")).withColumn("_k", F.lit(1)).join(mark.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, n, event_id, event_type, value FROM r WHERE r = 1""")
def stream_ingest(spark, folder):
    """Events as a stream into a table of each user's last event."""
    from tessera.streaming import ingest

    schema = read(spark, folder, "events").schema
    stream = ingest.file_stream(spark, folder, "events.parquet", schema)
    return ingest.latest_by_key(stream, "user_id", ["ts", "event_id"]).select("user_id", "n", "event_id", "event_type", "value")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND json_extract_string(props, '$.k') NOT IN ('1', '7', '13')")
def label_filter(spark, folder):
    labels = F.array("event_type", F.get_json_object("props", "$.k"))
    return read(spark, folder, "events").where(TX.labels_selected(labels, ["Click", "purchase "], ["1", "7", "13"])).select("event_id")


# --- scalar functions ---------------------------------------------------------------------------

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


def _slug_sql(x: str, limit: int = 80) -> str:
    cut = f"regexp_replace(left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), {limit}), '-+$', '')"
    return f"CASE WHEN {cut} = '' THEN 'page' ELSE {cut} END"


@query(f"SELECT page_id, {_slug_sql('url')} AS slug FROM pages")
def slugify(spark, folder):
    return read(spark, folder, "pages").select("page_id", TX.slugify(F.col("url")).alias("slug"))


@query(f"SELECT page_id, ({_slug_sql(_HOST + ' || ' + _PATH)}) || '-' || left(sha256(url), 16) AS identity FROM pages")
def url_identity(spark, folder):
    return read(spark, folder, "pages").select("page_id", TX.url_slug(F.col("url")).alias("identity"))


@query("SELECT page_id, left(sha256(html), 32) AS hash FROM pages")
def content_hash(spark, folder):
    return read(spark, folder, "pages").select("page_id", TX.content_hash(F.col("html")).alias("hash"))


_ORIGIN = "lower(regexp_extract({u}, '^([a-z]+://[^/?#]+)', 1))"


@query(f"WITH p AS (SELECT page_id, url, lag(url) OVER (ORDER BY page_id) AS before FROM pages) SELECT page_id, coalesce({_ORIGIN.format(u='url')} = {_ORIGIN.format(u='before')}, false) AS same FROM p")
def same_origin(spark, folder):
    p = read(spark, folder, "pages").select("page_id", "url")
    before = p.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("before"))
    return p.join(before, "page_id", "left").select("page_id", TX.same_origin(F.col("url"), F.col("before")).alias("same"))


# --- chunks, projection, pages -------------------------------------------------------------------

@query()
def md_chunks(spark, folder):
    return markdown.with_chunks(read(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "i", "chunk")


@query()
def code_chunks(spark, folder):
    return markdown.with_code_chunks(read(spark, folder, "documents").select("doc_id", F.col("text").alias("content")), "content").select("doc_id", "i", "start_line", "end_line", "text")


@query()
def md_projection(spark, folder):
    return read(spark, folder, "documents").select("doc_id", markdown.searchable_column(F.col("text")).alias("shown"))


@query()
def html_article(spark, folder):
    return read(spark, folder, "pages").select("page_id", markdown.html_column(F.col("html"), F.col("url")).alias("a")).select("page_id", "a.title", "a.markdown")


_ANCHOR = '<a href="([^"]*)">([^<]*)</a>'


@query(f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS label FROM pages)
SELECT page_id, label AS alt, CASE WHEN starts_with(href, '/') THEN {_ORIGIN.format(u='url')} || href ELSE href END AS url FROM a""")
def image_refs(spark, folder):
    """The pages' links written as images, their addresses made whole: what markdown's images are read from."""
    p = read(spark, folder, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(2)).alias("label"))
    origin = F.lower(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1))
    whole = lambda h: F.when(h.startswith("/"), F.concat(origin, h)).otherwise(h)
    md = F.array_join(F.transform(F.arrays_zip("href", "label"), lambda x: F.concat(F.lit("!["), x["label"], F.lit("](<"), whole(x["href"]), F.lit(">)"))), "\n")
    return markdown.with_images(p.select("page_id", md.alias("md")), "md").select("page_id", "image.alt", "image.url")


@query("SELECT page_id, path, (path LIKE '%.html' OR path LIKE '%/1%') AND path NOT LIKE '%/ad/%' AS chosen FROM (SELECT page_id, ltrim(" + _PATH + ", '/') AS path FROM pages)")
def path_selection(spark, folder):
    """Pages whose path an inclusion takes and no exclusion does."""
    p = read(spark, folder, "pages").select("page_id", F.regexp_replace(F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")), "^/+", "").alias("path"))
    return p.select("page_id", "path", (globs.any_glob(F.col("path"), ["**/*.html", "**/1*/**", "**/1*"]) & ~globs.any_glob(F.col("path"), ["**/ad/**"])).alias("chosen"))
