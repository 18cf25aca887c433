"""Registered queries of selection rules and scalar functions, each with the SQL that says the same.

Paths, addresses and locations are made from what the rows of whole tables say, their first
word and their length, by one expression that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import globs
from tessera.functions import text as TX
from tessera.operators import catalog, graph, index
from tessera.plans import star
from tessera.plans.catalogue import query
from tessera.plans.star import read

_WORD = "regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0)"
_SIZE = "CAST(n_chars AS STRING)"


def _one_of(*choices: str, of: str = _WORD) -> str:
    """A choice by the text's length; ``{}`` in it is the text's first word, or what ``of`` gives."""
    arms = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(choices))
    return f"replace(CASE n_chars % {len(choices)} {arms} END, '{{}}', {of})"


PATH = _one_of(
    "src/f{}.go", "vendor/x/f{}.go", "a/b/f{}_test.go", "web/app{}.min.js", "docker-compose.yml", "deploy/Values-{}.yaml", ".github/workflows/ci{}.yml", "README.md", "lib/Dockerfile",
    "tests/test_{}.py", "src/FooTests.java", "node_modules/p{}/index.ts", "gen/docs/x{}.py", "a/gen/y{}.py", "graphify-out/g{}.go", "img/p{}.png", "Cargo.toml", "src/tool{}.spec.ts", "valuesx.yaml", "k/chart.{}.yml", "main.rs",
)
_PATHS = f"(SELECT doc_id, n_chars, text, {PATH} AS path FROM documents)"
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_DEPLOY = r"(regexp_matches(path, '(?i)(^|/)\.github/workflows/.*\.ya?ml$') OR regexp_matches(path, '(?i)(^|/)(compose|docker-compose|docker-stack|values|chart|\.gitlab-ci)([.-][^/]*)?\.ya?ml$'))"


def _listed(extensions: tuple[str, ...]) -> str:
    some = ", ".join(f"'{x}'" for x in extensions)
    names = ", ".join(f"'{x}'" for x in globs.NAMES)
    return rf"(regexp_extract(lower({_BASE}), '\.([^.]*)$', 1) IN ({some}) OR lower({_BASE}) IN ({names}) OR {_DEPLOY})"


_TEST = r"(regexp_matches(lower(path), '_test\.(go|py)$') OR regexp_matches(lower(path), '(^|/)test_[^/]*\.py$') OR regexp_matches(lower(path), '\.(test|spec)\.[jt]sx?$') OR regexp_matches(lower(path), 'tests?\.(java|kt|cs|scala)$'))"


def _in_folder(dirs: tuple[str, ...], path: str = "path") -> str:
    return f"len(list_intersect(list_slice(string_split({path}, '/'), 1, -2), [{', '.join(repr(d) for d in dirs)}])) > 0"


def _paths(spark, folder):
    return read(spark, folder, "documents").select("doc_id", "n_chars", "text", F.expr(PATH).alias("path"))


@query(f"SELECT doc_id, {_DEPLOY} AS hit FROM {_PATHS}")
def deploy_config_rule(spark, folder):
    return _paths(spark, folder).select("doc_id", globs.deploy_config(F.col("path")).alias("hit"))


@query(f"SELECT doc_id, {_listed(globs.EXTENSIONS)} AS hit FROM {_PATHS}")
def built_in_allowlist(spark, folder):
    return _paths(spark, folder).select("doc_id", globs.built_in(F.col("path")).alias("hit"))


@query(f"SELECT doc_id, {_TEST} AS hit FROM {_PATHS}")
def test_file_rule(spark, folder):
    return _paths(spark, folder).select("doc_id", globs.test_file(F.col("path")).alias("hit"))


@query(rf"""SELECT doc_id, list_contains(string_split(path, '/'), 'gen') OR regexp_matches({_BASE}, '^[^/]*\.min\.js$') OR starts_with(path, 'a/b/') AS hit FROM {_PATHS}""")
def ignore_rule(spark, folder):
    """A folder's name anywhere, a pattern of a file's name, and a leading path."""
    return _paths(spark, folder).select("doc_id", globs.ignored(F.col("path"), ["gen", "*.min.js", "a/b/"]).alias("hit"))


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE n_chars * 300 <= 524288 AND NOT {_in_folder(('.git', 'graphify-out', 'docs'))} AND NOT path LIKE 'src/%.java' AND NOT {_in_folder(('node_modules', 'vendor'))} AND ({_listed(globs.EXTENSIONS)} OR {_BASE} LIKE '%.md')")
def code_file_selection(spark, folder):
    p = F.col("path")
    return _paths(spark, folder).where(globs.selected(p, F.col("n_chars") * 300, include_extra=["*.md"], exclude=["src/*.java"], skip_dirs=["docs"])).select("doc_id", "path")


@query(f"SELECT doc_id, path FROM {_PATHS} WHERE NOT {_in_folder(('.git', 'graphify-out', 'docs'))} AND {_listed(globs.DOC_EXTENSIONS)} AND NOT {_TEST} AND NOT {_in_folder(globs.DOC_NOISE_DIRS, 'lower(path)')} AND path NOT LIKE 'gen/%'")
def doc_file_selection(spark, folder):
    return _paths(spark, folder).where(globs.selected_docs(F.col("path"), exclude=["gen/"], skip_dirs=["docs"])).select("doc_id", "path")


_LINE = f"repeat('#', CAST(n_chars % 9 AS INT)) || CASE WHEN n_chars % 4 = 3 THEN '' ELSE ' ' END || 'Part ' || {_WORD}"


_PART = f"trim('Part ' || {_WORD})"


@query(f"SELECT doc_id, CASE WHEN n_chars % 9 BETWEEN 1 AND 6 AND n_chars % 4 <> 3 THEN n_chars % 9 ELSE 0 END AS level, CASE WHEN n_chars % 5 = 0 THEN 'Given ' || {_WORD} WHEN n_chars % 9 BETWEEN 1 AND 6 AND n_chars % 4 <> 3 THEN {_PART} ELSE path END AS title FROM {_PATHS}")
def headings_and_titles(spark, folder):
    """A line's heading level; a title from the manifest, else the first heading, else the path."""
    given = F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("Given "), F.expr(_WORD))).otherwise("")
    body = F.concat(F.lit("words\n\n"), F.expr(_LINE), F.lit("\nmore"))
    return _paths(spark, folder).select("doc_id", TX.heading_level(F.expr(_LINE)).cast("long").alias("level"), TX.doc_title(given, body, F.col("path")).alias("title"))


_URL = _one_of("https://h/{}", "http://u@h/{}", "ftp://h/{}", "/x/{}", "HTTP://H:80?q={}", "https://", "https://h.x#f{}", "http://a b/{}")


@query("SELECT doc_id, n_chars % 8 IN (0, 4, 6) AS ok FROM documents")
def safe_url(spark, folder):
    return read(spark, folder, "documents").select("doc_id", TX.http_url_ok(F.expr(_URL)).alias("ok"))


_REPO = _one_of("https://host/team/r{}.git", "git@host:team/r{}.git", "ssh://git@host:22/team/r{}", "https://user:pw@host/team/r{}/", "host/team/r{}")


@query(f"SELECT doc_id, 'host/team/r' || {_WORD} AS id FROM documents")
def repo_identity(spark, folder):
    return read(spark, folder, "documents").select("doc_id", TX.repo_id(F.expr(_REPO)).alias("id"))


_PLACE = _one_of("L{}", "L{}-L99999", "line {}", "{}:5", "x{}", "", of=_SIZE)


@query("SELECT doc_id, CASE WHEN n_chars % 6 < 4 THEN CAST(n_chars AS INT) ELSE 0 END AS line FROM documents")
def location_lines(spark, folder):
    return read(spark, folder, "documents").select("doc_id", TX.location_line(F.expr(_PLACE)).alias("line"))


_WORDS = "[' Ab', 'ab ', '', lang, upper(lang), source, ' ' || source]"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct([trim(lower(x)) for x in {_WORDS} if trim(x) <> ''])), ',') AS labels,
regexp_replace(lower(source || '-' || lang || '!'), '[^a-z0-9]+', '', 'g') AS bare, '[''' || lang || ''', ''' || source || ''']' AS shown,
len([x for x in regexp_split_to_array(lower(trim(left(text, 200), ' ')), '[ \\t\\n\\x0B\\f\\r]+') if x <> '']) AS words, left(text, 40) AS head,
regexp_matches(text, '[一-鿿]') AS cjk FROM documents""")
def set_and_word_functions(spark, folder):
    d = read(spark, folder, "documents")
    some = F.array(F.lit(" Ab"), F.lit("ab "), F.lit(""), "lang", F.upper("lang"), "source", F.concat(F.lit(" "), "source"))
    return d.select(
        "doc_id",
        F.array_join(F.array_sort(TX.normal_set(some)), ",").alias("labels"),
        TX.alnum(F.concat("source", F.lit("-"), "lang", F.lit("!"))).alias("bare"),
        TX.list_repr(F.array("lang", "source")).alias("shown"),
        F.size(TX.lower_words(F.left("text", F.lit(200)))).cast("long").alias("words"),
        TX.excerpt(F.col("text"), 40).alias("head"),
        TX.has_cjk(F.col("text")).alias("cjk"),
    )


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN NULL ELSE source END AS value, CASE WHEN n_chars >= 3 AND doc_id % 50 >= 5 AND n_chars > doc_id % 50 THEN round(n_chars / (doc_id % 50) * (n_chars - doc_id % 50), 4) END AS eta FROM documents")
def updates_and_eta(spark, folder):
    """An absent field keeps the stored value, a null one clears it; time left at the rate so far."""
    k = F.col("doc_id") % 3
    done = F.col("doc_id") % 50
    return read(spark, folder, "documents").select("doc_id", TX.tri_state(k > 0, F.when(k == 2, F.col("source")), F.col("lang")).alias("value"), F.round(catalog.eta_seconds(done, F.col("n_chars"), F.col("n_chars")), 4).alias("eta"))


@query(f"SELECT id, 'NODE ' || label || ' [src=' || source_file || ' loc= community=' || coalesce(CAST(community AS VARCHAR), '') || ']' AS line FROM ({star.nodes_sql()}) n")
def node_lines(spark, folder):
    n = star.nodes(spark, folder)
    return n.select("id", graph.node_line(graph.label_of(F.col("label"), F.col("id")), F.col("source_file"), F.col("source_location"), F.col("community")).alias("line"))


@query("""SELECT source AS path, count(*) AS n, min(struct_pack(line := CAST(doc_id AS INT), name := lang)).name AS first, CAST(sum(doc_id) AS BIGINT) AS lines FROM documents WHERE doc_id > 0 AND doc_id % 2 = 0 AND lang <> source GROUP BY source""")
def symbols_of_files(spark, folder):
    """Symbols of a graph's nodes by file; nodes without a line or named as their file are none."""
    d = read(spark, folder, "documents")
    nodes = d.select(F.concat(F.lit("./"), "source").alias("source_file"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("L"), F.col("doc_id").cast("string"))).alias("source_location"), F.col("lang").alias("label"))
    s = index.symbols(nodes)
    return s.select("path", F.size("symbols").cast("long").alias("n"), F.element_at("symbols", 1)["name"].alias("first"), F.aggregate("symbols", F.lit(0).cast("long"), lambda a, x: a + x["line"]).alias("lines"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'web:' || source ELSE source END AS repo, CASE WHEN doc_id % 4 = 1 THEN 'own' WHEN doc_id % 3 = 0 THEN 'web' ELSE 'repo' END AS kind, count(*) AS n FROM documents GROUP BY ALL")
def kind_backfill(spark, folder):
    d = read(spark, folder, "documents")
    rows = d.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("web:"), "source")).otherwise(F.col("source")).alias("repo"), F.when(F.col("doc_id") % 4 == 1, "own").when(F.col("doc_id") % 4 == 2, "").alias("kind"))
    return index.backfill_kind(rows).groupBy("repo", "kind").agg(F.count("*").alias("n"))


@query("SELECT n_name AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT DISTINCT 'web:' || source FROM documents")
def scope_key_set(spark, folder):
    """Keys that a search over one namespace and all web sources may see."""
    repos = read(spark, folder, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").cast("string").alias("namespace"))
    return catalog.scope_keys(repos, read(spark, folder, "documents").select(F.col("source").alias("name")).distinct(), "all", "2")


@query(f"SELECT DISTINCT community FROM ({star.nodes_sql()}) n WHERE community IS NOT NULL")
def community_ids(spark, folder):
    return graph.community_ids(star.nodes(spark, folder))


@query(f"""WITH n AS ({star.nodes_sql()}), c AS (SELECT community, count(*) AS nodes FROM n WHERE community IS NOT NULL GROUP BY 1 ORDER BY nodes DESC, community LIMIT 3),
 r AS (SELECT community, nodes, label, row_number() OVER (PARTITION BY community ORDER BY ord) AS k FROM n JOIN c USING (community))
SELECT community, nodes, string_agg(label, ', ' ORDER BY k) AS samples FROM r WHERE k <= 5 GROUP BY 1, 2""")
def largest_communities(spark, folder):
    """The three largest communities, the feature being a top-k report."""
    return graph.largest_communities(star.nodes(spark, folder), 3).withColumn("samples", F.array_join("samples", ", "))


@query(f"SELECT id, label || CASE WHEN ord % 2 = 0 THEN ' L' || (ord % 100) ELSE '' END || coalesce(' community=' || community, '') AS line FROM ({star.nodes_sql()}) n")
def node_summaries(spark, folder):
    place = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("L"), (F.col("ord") % 100).cast("string")))
    return star.nodes(spark, folder).select("id", graph.node_summary(graph.label_of(F.col("label"), F.col("id")), place, F.col("community")).alias("line"))


_CLIP = 61


@query(f"""SELECT doc_id, CASE WHEN strlen(text) <= {_CLIP} THEN text ELSE left(text, k) || chr(10) || '…[truncated, ' || strlen(left(text, k)) || ' of ' || strlen(text) || ' bytes]' END AS clipped
FROM (SELECT doc_id, text, list_max(list_filter(range(0, {_CLIP + 1}), lambda i: strlen(left(text, i)) <= {_CLIP})) AS k FROM documents) t""")
def utf8_clip(spark, folder):
    return read(spark, folder, "documents").select("doc_id", TX.clip_utf8(F.col("text"), _CLIP).alias("clipped"))


@query(f"""SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN 'git.example/t/r' || {_WORD} WHEN 1 THEN 'web.example/t/r' || {_WORD} WHEN 2 THEN 't/r' || {_WORD} ELSE 'full-' || {_WORD} END AS repo FROM documents""")
def webhook_identity(spark, folder):
    """The address of a push event: a clone address, the web address where that is empty, a path, a name."""
    k, n = F.col("n_chars") % 4, F.expr(_WORD)
    clone = F.when(k == 0, F.concat(F.lit("git@git.example:t/r"), n, F.lit(".git"))).when(k == 1, "")
    web = F.when(k <= 1, F.concat(F.lit("https://web.example:8443/t/r"), n, F.lit("/")))
    path = F.when(k == 2, F.concat(F.lit("t/r"), n)).otherwise("")
    return read(spark, folder, "documents").select("doc_id", TX.first_repo_id([clone, web], path, F.concat(F.lit("full-"), n)).alias("repo"))


_FLAGS = "text LIKE '% a%' AS cloned, n_chars > 300 AS has_graph, CASE WHEN lang <> 'de' THEN text LIKE '%e.%' END AS managed_ignore, CASE WHEN lang <> 'fr' THEN 'v' || substring(source FROM 4) END AS graph_version"


@query(f"SELECT id FROM (SELECT doc_id AS id, {_FLAGS} FROM documents) t WHERE cloned AND has_graph AND NOT (coalesce(managed_ignore, false) AND coalesce(graph_version, '') = 'v2')")
def stale_graphs(spark, folder):
    return catalog.stale_graphs(read(spark, folder, "documents").selectExpr("doc_id AS id", *[c.strip() for c in _FLAGS.split(", ")]), "v2")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'en' UNION ALL SELECT DISTINCT 'web:' || source FROM documents")
def reindex_keys(spark, folder):
    """Rows in English stand for repositories that are ready."""
    d = read(spark, folder, "documents")
    repos = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "ready").otherwise("error").alias("status"))
    return catalog.to_reindex(repos, d.select(F.col("source").alias("name")).distinct())
