"""Queries over stored indexes, versioned tables and merged settings.

An index is built once for a session and a folder of tables, then only read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import charset
from tessera.operators import catalog, lexical, settings
from tessera.operators.embeddings import EmbeddingCache
from tessera.operators.postings import LexicalIndex
from tessera.operators.tables import KeyedTable
from tessera.plans.catalogue import _CHAT, _TOK, QUERIES, SQL, _documents, query
from tessera.plans.star import built, read

def _numbered(df: DataFrame, key: list[str]) -> DataFrame:
    """An id of the key's columns; where rows repeat a key, they get a number behind it. Texts are dealt out only then."""
    if df.groupBy(*key).count().where("count > 1").isEmpty():
        return df.withColumn("id", F.concat_ws(":", *key))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("text"))
    return df.withColumn("_n", nth).withColumn("id", F.concat_ws(":", *key, F.when(F.col("_n") > 1, F.col("_n")))).drop("_n")


def _turns(spark, folder) -> LexicalIndex:
    def make(root: str) -> LexicalIndex:
        index = LexicalIndex(spark, root, "conv_id long, turn long", ("conv_id", "turn"))
        index.rebuild(_numbered(read(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text"), ["conv_id", "turn"]))
        return index

    return built(spark, folder, "turns", make)


def _texts(spark, folder) -> LexicalIndex:
    """All documents, a part of them by an update that replaces old texts and deletes rows."""

    def make(root: str) -> LexicalIndex:
        index = LexicalIndex(spark, root, "doc_id long", ("doc_id",))
        docs = _numbered(read(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
        late, old = F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0
        index.rebuild(docs.where(~late).withColumn("text", F.when(old, "an old text of the idiot that went").otherwise(F.col("text"))).unionByName(docs.where(late).select("doc_id", F.lit("the thing that is to be deleted").alias("text"), F.concat(F.lit("gone:"), "id").alias("id"))))
        index.update(docs.where(late | old), docs.where(late).select(F.concat(F.lit("gone:"), "id").alias("id")))
        return index

    return built(spark, folder, "texts", make)


@query(SQL["lexical_top_docs"])
def stored_top_docs(spark, folder):
    """The flagship search over the stored index of all turns."""
    return lexical.best_chunks(_turns(spark, folder).search(lexical.parse(_CHAT)), ["conv_id"], "turn", 10).select("conv_id", "turn", "score")


def _stored(text: str):
    def run(spark, folder):
        hits = _texts(spark, folder).search(lexical.parse(text))
        return hits.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)

    return run


for _name, _text in {"stored_required": "trash OR stupid OR idiot the", "stored_phrase": '"of the" in', "stored_prefix": "thing* with", "stored_not": "that with -from NOT was"}.items():
    SQL[_name], QUERIES[_name] = _documents(_text)[0], _stored(_text)


@query(f"""
WITH t AS (SELECT unnest(list_distinct({_TOK})) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT term, df FROM d WHERE df >= greatest(1, CAST(floor(0.35 * (SELECT count(*) FROM documents)) AS BIGINT)) ORDER BY df DESC, term LIMIT 500""")
def stored_frequent_terms(spark, folder):
    """From the counts that the build, the update and its deletions have left; no text is read."""
    return _texts(spark, folder).frequent_terms()


# --- versioned tables -----------------------------------------------------------------------


@query(SQL["delta_upsert"])
def merged_versions(spark, folder):
    """Labels as a versioned table, after a merge of the rows of French documents."""

    def make(root: str) -> KeyedTable:
        table = KeyedTable(spark, root, "doc_id long, quality int, toxic int", ["doc_id"])
        table.replace(read(spark, folder, "labels").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int")))
        french = read(spark, folder, "documents").where("lang = 'fr'")
        table.merge(french.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")))
        return table

    return built(spark, folder, "labels", make).read()


def _letters(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can follow: the number of characters, and of three letters."""
    return [[float(len(t)), *(float(t.count(c)) for c in "aen")] for t in texts]


@query("""SELECT doc_id, left(sha256(coalesce(text, '')), 32) AS hash, CAST(length(coalesce(text, '')) AS DOUBLE) AS chars,
CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS DOUBLE) AS e FROM documents""")
def embedded_once(spark, folder):
    """Vectors of all documents from a table by content: copies are sent to the embedder once."""

    def make(root: str) -> DataFrame:
        return EmbeddingCache(spark, root, _letters, 4).embed(read(spark, folder, "documents").select("doc_id", "text"), "text")

    v = F.col("vector")
    return built(spark, folder, "embeddings", make).select("doc_id", "hash", v[0].cast("double").alias("chars"), v[2].cast("double").alias("e"))


# --- settings -------------------------------------------------------------------------------

@query("""WITH w AS (SELECT p_partkey, regexp_extract_all(p_name, '[a-z]+') AS w, regexp_extract_all(lower(p_brand || ' ' || p_type), '[a-z]+') AS t FROM part)
SELECT p_partkey, array_to_string(CASE WHEN len(t) > 2 THEN t ELSE w END, ',') AS include, array_to_string(list_concat(w, t), ',') AS include_extra, array_to_string(list_concat(t, w), ',') AS exclude FROM w""")
def filters_merge(spark, folder):
    """Filters of a part's type over those of its name; a type of two words or fewer does not include anything."""
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    w, t = words(F.col("p_name")), words(F.lower(F.concat("p_brand", F.lit(" "), "p_type")))
    base = F.struct(w.alias("include"), w.alias("include_extra"), t.alias("exclude"))
    over = F.struct(F.when(F.size(t) > 2, t).otherwise(F.array().cast("array<string>")).alias("include"), t.alias("include_extra"), w.alias("exclude"))
    m = settings.merged_filters(base, over)
    return read(spark, folder, "part").select("p_partkey", *[F.array_join(m[f], ",").alias(f) for f in ("include", "include_extra", "exclude")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) ELSE l_partkey END AS source, CASE WHEN l_discount > 0.05 AND l_suppkey > 0 THEN l_suppkey ELSE l_orderkey END AS "group", CAST(l_linenumber AS BIGINT) AS synthesis FROM lineitem""")
def limits_merge(spark, folder):
    """A line's own limits, where they are above 0, over those of its part, order and place."""
    line = read(spark, folder, "lineitem")
    base = F.struct(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("group"), F.col("l_linenumber").cast("long").alias("synthesis"))
    over = F.struct(
        F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")).otherwise(-F.col("l_quantity").cast("long")).alias("source"),
        F.when(F.col("l_discount") > 0.05, F.col("l_suppkey")).otherwise(F.lit(0).cast("long")).alias("group"), F.lit(None).cast("long").alias("synthesis"),
    )
    return line.select("l_orderkey", "l_linenumber", "l_partkey", settings.merged_limits(base, over, ("source", "group", "synthesis")).alias("m")).select("l_orderkey", "l_linenumber", "l_partkey", "m.*")


_UPDATE = "'{' || CASE event_type WHEN 'click' THEN '\"description\": \" ' || props_k || ' \"' WHEN 'view' THEN '\"description\": null, \"analyze_images\": true' WHEN 'error' THEN '\"refresh_interval\": \"' || props_k || 'm\"' ELSE '\"refresh_interval\": \"' || event_type || '\", \"description\": \"kept out\"' END || '}'"


@query("""WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, user_id FROM events)
SELECT event_id, CASE event_type WHEN 'click' THEN k WHEN 'view' THEN '' ELSE 'user ' || user_id END AS description, event_type = 'view' OR user_id > 10 AS analyze_images,
CASE WHEN event_type = 'error' THEN CAST(k AS BIGINT) * 60000000000 ELSE user_id END AS refresh_interval, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'refresh_interval' END AS error FROM e""")
def collection_update(spark, folder):
    """Envelopes of the events' users after an update that the event's type and properties write as JSON."""
    e = read(spark, folder, "events").withColumn("props_k", F.get_json_object("props", "$.k"))
    stored = F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("description"), (F.col("user_id") > 10).alias("analyze_images"), F.col("user_id").cast("long").alias("refresh_interval"), F.array(F.lit("@daily")).alias("specs"))
    m = e.select("event_id", settings.collection_update(stored, F.expr(_UPDATE)).alias("m"))
    return m.select("event_id", "m.description", "m.analyze_images", "m.refresh_interval", "m.error")


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id FROM events)
SELECT event_id, CASE WHEN k % 2 = 0 THEN 'new ' || k WHEN k % 3 = 0 THEN NULL ELSE 'user ' || user_id END AS "user", CASE WHEN k % 5 > 0 THEN 'token ' || k ELSE 'kept' END AS api_token, CASE WHEN event_type = 'click' THEN k ELSE user_id END AS max_issues FROM e""")
def provider_merge(spark, folder):
    """An issue tracker's settings after an update: absent keeps, null clears, a value replaces, a blank token keeps."""
    k, user = F.get_json_object("props", "$.k").cast("long"), F.col("user_id").cast("string")
    stored = F.concat(F.lit('{"user": "user '), user, F.lit('", "api_token": "kept", "max_issues": '), user, F.lit("}"))
    fields = F.array_compact(F.array(
        F.when(k % 2 == 0, F.concat(F.lit('"user": "new '), k.cast("string"), F.lit('"'))).when(k % 3 == 0, F.lit('"user": null')),
        F.when(k % 5 > 0, F.concat(F.lit('"api_token": "token '), k.cast("string"), F.lit('"'))).otherwise(F.lit('"api_token": ""')),
        F.when(F.col("event_type") == "click", F.concat(F.lit('"max_issues": '), k.cast("string"))),
    ))
    update = F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}"))
    return read(spark, folder, "events").select("event_id", settings.issue_config(stored, update).alias("c")).select("event_id", "c.user", "c.api_token", "c.max_issues")


# --- encodings ------------------------------------------------------------------------------


@query("SELECT page_id, left(sha256(html), 32) AS hash, length(html) AS chars FROM pages")
def page_charsets(spark, folder):
    """Pages written in an encoding that their length picks, told by a mark, by the header or by nothing, and read again."""
    p = read(spark, folder, "pages")
    k = F.length("html") % 4
    latin = F.decode(F.encode("html", "ISO-8859-1"), "ISO-8859-1") == F.col("html")  # every sign has a byte there
    told = F.when(k == 0, "text/html; charset=utf-16le").when((k == 1) & latin, "text/html; charset=latin1").when(k == 2, "text/html")
    body = F.when(k == 0, F.encode("html", "UTF-16LE")).when((k == 1) & latin, F.encode("html", "ISO-8859-1")).when(k == 3, F.encode("html", "UTF-16")).otherwise(F.encode("html", "UTF-8"))
    text = charset.page_text(body, told)
    return p.select("page_id", text.alias("html")).select("page_id", F.left(F.sha2(F.col("html").cast("binary"), 256), F.lit(32)).alias("hash"), F.length("html").cast("long").alias("chars"))


@query("""SELECT 'c' || o_custkey AS id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS running, min(CASE WHEN c_acctbal > 0 THEN 'ready' WHEN c_acctbal <= 0 THEN 'error' END) AS status
FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY o_custkey""")
def active_repos(spark, folder):
    """Customers with open orders stand for repositories with running tasks, priorities for the tasks' kinds."""
    tasks = read(spark, folder, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("repo"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("state"))
    repos = read(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "ready").otherwise("error").alias("status"))
    return catalog.active_repos(tasks, repos)
