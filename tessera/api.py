"""One object over the engine's tables: the questions and commands that users know by name.

Tables are DataFrames (or versioned Parquet folders); commands return a new version of a
table rather than changing rows in place.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import excerpt, normal_set, url_slug
from tessera.operators import catalog, graph, lexical, sync, vector
from tessera.operators.adjacency import Adjacency
from tessera.operators.order import saved
from tessera.operators.postings import LexicalIndex
from tessera.operators.workspace import Workspace
from tessera.sources import files, web

# Columns of the tables.
SCHEMAS = {
    "chunks": "id string, repo string, kind string, path string, title string, excerpt string, updated_at timestamp",
    "code": "id string, repo string, path string, symbol string, start_line int, end_line int, snippet string",
    "vectors": "id string, repo string, kind string, path string, title string, excerpt string, updated_at timestamp, vector array<float>",
    "repos": "id string, url string, status string, namespace string",
    "overrides": f"repo string, overrides struct<{catalog.OVERRIDES}>",
    "namespaces": "namespace string, description string",
    "sources": "name string, type string, config string, state string",
    "pages": "collection string, slug string, url string, title string, teams array<string>, teams_norm array<string>, hash string, status string",
    "tasks": "seq long, repo string, kind string, state string, ended_at timestamp",
}


@dataclass
class Engine:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    graphs: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)
    embedder: object = None
    git_paths: dict[str, str] = field(default_factory=dict)
    #: Stored forms: text indexes of ``chunks`` and ``code``, edges of graphs, and indexes built from repositories' files.
    indexes: dict[str, LexicalIndex] = field(default_factory=dict)
    stored_graphs: dict[str, Adjacency] = field(default_factory=dict)
    workspace: Workspace | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables[name]

    # --- scope --------------------------------------------------------------------------

    def _scoped(self, rows: DataFrame, key: str, scope: str, namespace: str) -> DataFrame:
        """Rows of one key, or of a scope and namespace; the filter comes before any search."""
        if key:
            known = self.table("repos").where(F.col("id") == key).isEmpty() and self.table("sources").where(F.concat(F.lit("web:"), "name") == key).isEmpty()
            if known:
                raise ValueError(f"unknown: {key}")
            return rows.where(F.col("repo") == key)
        if "kind" in rows.columns and scope in ("repos", "sources"):
            rows = rows.where(F.col("kind") == ("repo" if scope == "repos" else "web"))
        elif scope not in ("all", "repos", "sources"):
            raise ValueError(f"unknown scope: {scope}")
        if namespace == "*" or scope == "sources":
            return rows
        keys = catalog.scope_keys(self.table("repos"), self.table("sources"), scope, namespace)
        return rows.join(keys.select(F.col("id").alias("repo")), "repo", "left_semi")

    # --- stored forms -------------------------------------------------------------------

    _TEXT = {"chunks": ("title", "excerpt"), "code": ("path", "symbol", "snippet")}

    def _indexed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("text", F.concat_ws("\n", *self._TEXT[name]))

    def build_index(self, name: str, root: str, buckets: int = 16) -> LexicalIndex:
        """A stored text index of ``chunks`` or ``code``; from then on searches read it, and removals reach it."""
        rows = self.table(name)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "id")
        scope = tuple(c for c in ("repo", "kind", "path") if c in rows.columns)
        index = LexicalIndex(self.spark, root, columns, scope, buckets=buckets)
        index.rebuild(self._indexed(name, rows))
        self.indexes[name] = index
        return index

    def put_rows(self, name: str, rows: DataFrame) -> None:
        """Insert or replace rows of ``chunks`` or ``code`` by id, in the table and in its index."""
        self.tables[name] = sync.upsert(self.table(name), rows, ["id"])
        if name in self.indexes:
            self.indexes[name].update(self._indexed(name, rows))

    def _hits(self, name: str, built: str, within, top: int | None) -> DataFrame:
        """Rows of ``chunks`` or ``code`` with their score; from the index where there is one.

        With ``top`` the best chunk of each document, and the best documents only: of those the
        index's stored rows are read.
        """
        query = lexical.parse(built)
        if name in self.indexes:
            index = self.indexes[name]
            version = index.manifests.current()
            hits = index.search(query, within, version)
            hits = hits if top is None else lexical.best_chunks(hits, ["repo", "path"], "id", top)
            return index.with_rows(hits, version).drop("text")
        rows = within(self.table(name)).withColumn("_text", F.concat_ws("\n", *self._TEXT[name]))
        hits = lexical.matches(rows, query, "_text").drop("_text")
        return hits if top is None else lexical.best_chunks(hits, ["repo", "path"], "id", top)

    def build_graph(self, repo: str, root: str, buckets: int = 16) -> Adjacency:
        """Store a graph's edges; from then on its traversals read them."""
        self.stored_graphs[repo] = Adjacency(self.spark, root, buckets).build(*self.graphs[repo])
        return self.stored_graphs[repo]

    def refresh_repo(self, repo: str, folder: str, run: str | None = None, wanted: list[str] | None = None) -> dict[str, str]:
        """Bring a repository's text indexes and vectors up to its files, stage by stage; stages it skips are left out."""
        if self.workspace is None:
            raise ValueError("no workspace")
        if self.table("repos").where(F.col("id") == repo).isEmpty():
            raise ValueError(f"unknown: {repo}")
        self.workspace.folders[repo] = folder
        out = self.workspace.refresh(repo, run, wanted)
        state = "error" if "error" in out.values() else "ready"
        self.tables["repos"] = self.table("repos").withColumn("status", F.when(F.col("id") == repo, F.lit(state)).otherwise(F.col("status")))
        return out

    # --- search -------------------------------------------------------------------------

    def search_docs(self, question: str, mode: str = "", key: str = "", scope: str = "all", namespace: str = "*", top: int = 3, now: datetime | None = None, stop: frozenset[str] = frozenset()) -> DataFrame:
        """Documents by full text, by vectors, or by both fused; best chunk of each, enriched."""
        mode = mode or ("semantic" if self.embedder else "lexical")
        top = min(20, max(1, top))
        depth = max(vector.candidate_depth(None), top) if mode == "hybrid" else top
        arms: dict[str, DataFrame] = {}
        if mode in ("lexical", "hybrid"):
            if "chunks" in self.indexes and not stop:
                stop = self.indexes["chunks"].stop_words()
            built = lexical.build_query(question, stop)
            within = lambda rows: self._scoped(rows, key, scope, namespace)
            arms["lexical"] = self._hits("chunks", built, within, depth)
            if built != question and arms["lexical"].isEmpty():
                arms["lexical"] = self._hits("chunks", lexical.build_query(question), within, depth)
        if mode in ("semantic", "hybrid"):
            if self.embedder is None:
                raise ValueError("no embedder")
            q = self.embedder([question])[0]
            near = vector.top_k(self._scoped(self.table("vectors"), key, scope, namespace), q, 3 * vector.doc_depth(0, depth), ["id"], "vector")
            aged = near.withColumn("score", F.round(vector.recency(F.col("score"), F.col("updated_at"), F.lit(now or datetime.now())), 6))
            arms["semantic"] = vector.best_per_doc(aged, ["repo", "path"], ["id"]).drop("vector").orderBy(F.desc("score"), "repo", "path").limit(depth)
        if not arms:
            raise ValueError(f"unknown mode: {mode}")
        if mode != "hybrid":
            found = next(iter(arms.values()))
        else:
            order = [F.desc("score"), "repo", "path"]
            ranked = {k: vector.ranked(v, order, depth) for k, v in arms.items()}
            fused = vector.fuse(ranked, ["repo", "path"]).limit(top)
            best = None
            for name, df in ranked.items():
                part = df.withColumn("best_arm", F.lit(name)).drop("score", "rank")
                best = part if best is None else best.unionByName(part, allowMissingColumns=True)
            found = fused.join(best, ["repo", "path", "best_arm"])
        found = found.withColumn("truncated", F.length("excerpt") > 4000).withColumn("excerpt", excerpt(F.col("excerpt")))
        pages = self.table("pages").select(F.concat(F.lit("web:"), "collection").alias("repo"), F.concat("slug", F.lit(".md")).alias("path"), "url", "teams")
        repos = self.table("repos").select(F.col("id").alias("repo"), "namespace")
        return catalog.enrich(found, (repos, ["repo"]), (pages, ["repo", "path"])).orderBy(F.desc("score"), "repo", "path").limit(top)

    def search_code(self, question: str, repo: str = "", namespace: str = "*", page: int = 1, per_page: int = 20) -> tuple[DataFrame, int]:
        """One page of code chunks and the exact total, each with its best matching line."""
        hits = self._hits("code", lexical.build_query(question), lambda rows: self._scoped(rows, repo, "all", namespace), None)
        got, total = lexical.page(hits.withColumn("score", F.round("score", 6)), [F.desc("score"), "id"], page, per_page, 100)
        line = lexical.matching_line(F.col("snippet"), lexical.words_of(question), F.col("start_line"))
        return got.withColumn("line", line).withColumn("snippet", excerpt(F.col("snippet"))), total

    def search_code_semantic(self, question: str, repo: str = "", namespace: str = "*", top: int = 10) -> DataFrame:
        """The most similar code, overlapping ranges left out; exactly ``top`` rows where there are so many."""
        top = min(100, max(1, top))
        q = self.embedder([question])[0]
        near = vector.top_k(self._scoped(self.table("code_vectors"), repo, "all", namespace), q, 3 * top, ["id"], "vector").drop("vector")
        return vector.suppress_overlaps(vector.ranked(near, [F.desc("score"), "id"], 3 * top), top)

    # --- documents, sources, files --------------------------------------------------------

    def list_docs(self, key: str) -> DataFrame:
        return self._scoped(self.table("chunks"), key, "all", "*").select("path", "title").distinct().orderBy("path")

    def get_doc(self, root: str, path: str, offset: int = 0, most: int = 32 << 10) -> DataFrame:
        return files.ranged_read(self.spark, root, path, offset, min(most, 128 << 10))

    read_file = get_doc

    def list_files(self, root: str, folder: str = "", recursive: bool = False, page: int = 1, per_page: int = 100) -> tuple[DataFrame, int, bool]:
        rows = files.listing(files.tree(self.spark, root), folder, recursive)
        return catalog.page(rows, [F.desc("is_dir"), "path"], page, per_page, 200)

    def list_sources(self) -> DataFrame:
        n = self.table("pages").groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("pages"))
        return self.table("sources").join(n, "name", "left").select("name", "type", F.coalesce("pages", F.lit(0)).alias("pages")).orderBy("name")

    def get_source(self, name: str, team: str = "", title: str = "", page: int = 1, per_page: int = 20) -> tuple[DataFrame, int, bool]:
        rows = self.table("pages").where(F.col("collection") == name)
        if team:
            rows = rows.where(F.array_contains("teams_norm", team.strip().lower()))
        if title:
            rows = rows.where(F.col("title").ilike(f"%{catalog.like_literal(title)}%"))
        return catalog.page(rows, ["slug"], page, per_page)

    def inspect_source(self, name: str, team: str = "", title: str = "", page: int = 1, per_page: int = 50) -> dict:
        """A source, one page of what it holds, how much there is, and for an issue tracker its teams."""
        source = self.table("sources").where(F.col("name") == name).first()
        if source is None:
            raise ValueError(f"unknown source: {name}")
        per_page = min(200, per_page if per_page > 0 else 50)
        rows, total, more = self.get_source(name, team, title, page, per_page)
        own = self.table("pages").where(F.col("collection") == name)
        teams = catalog.distinct_teams(own, "teams", "slug") if source.type == "jira" else None
        return {"source": source.asDict(), "pages": rows, "total": total, "has_more": more, "teams": teams}

    def active_repos(self) -> DataFrame:
        """Repositories and sources with running tasks, the kinds of these, and their status."""
        return catalog.active_repos(self.table("tasks"), self.table("repos"))

    # --- graph ------------------------------------------------------------------------------

    def _graph_name(self, repo: str, words: str = "") -> str:
        """The named graph; without a name the only one, or the one whose short name the words hold."""
        if repo or len(self.graphs) == 1:
            return repo or next(iter(self.graphs))
        plain = "".join(c for c in words.lower() if c.isalnum())
        short = {r: "".join(c for c in r.rsplit("/", 1)[-1].lower() if c.isalnum()) for r in self.graphs}
        fit = [r for r, s in short.items() if len(s) >= 4 and s in plain]
        if len(fit) != 1:
            known = sorted(self.graphs)
            more = "" if len(known) <= 20 else f" and {len(known) - 20} more, which list_repos finds"
            raise ValueError(f"which repository? There are graphs of {len(known)}: {', '.join(known[:20])}{more}")
        return fit[0]

    def _graph(self, repo: str, words: str = "") -> tuple[DataFrame, DataFrame]:
        return self.graphs[self._graph_name(repo, words)]

    def query_graph(self, question: str, repo: str = "", depth: int = 3, budget: int = 2000, contexts: list[str] = ()) -> str:
        name = self._graph_name(repo, question)
        nodes, edges = self.graphs[name]
        start = saved(graph.seeds(graph.node_scores(nodes, graph.query_terms(question))).select("id"), "seeds")
        if start.isEmpty():
            return "no matching nodes"
        depth, asked = min(6, max(1, depth)), graph.asked_contexts(question, list(contexts))[0]
        if stored := self.stored_graphs.get(name):
            reached = stored.bfs(start, depth, asked)
            return graph.subgraph_text(nodes, edges, reached, stored.walked(reached, asked), budget)
        degree = saved(graph.degrees(nodes, edges), "degrees")
        hub = graph.hub_threshold(degree).first()[0]
        some = graph.filter_contexts(edges, asked)
        reached = graph.bfs(some, degree, start, depth, hub)
        return graph.subgraph_text(nodes, edges, reached, graph.bfs_edges(some, reached, degree, hub), budget)

    def get_node(self, text: str, repo: str = "") -> DataFrame:
        nodes, edges = self._graph(repo, text)
        return graph.resolve(nodes, text).limit(1).join(graph.degrees(nodes, edges), "id")

    def ambiguity(self, text: str, repo: str = "") -> str:
        """A note if a text means several nodes: how many, and the id of the one that is taken; '' if it does not."""
        found = graph.resolve(self._graph(repo, text)[0], text)
        n = found.count()
        return f"'{text}' may mean {n} nodes; '{found.first().id}' is taken. Ask by id for another." if n > 1 else ""

    def get_neighbors(self, text: str, relation: str = "", repo: str = "") -> DataFrame:
        nodes, edges = self._graph(repo, text)
        node = graph.resolve(nodes, text).first()
        if node is None:
            raise ValueError(f"no node: {text}")
        if relation and edges.where(F.contains(F.lower("relation"), F.lit(relation.lower()))).isEmpty():
            raise ValueError(f"no such relation; there are {[r.relation for r in graph.relation_vocabulary(edges).collect()]}")
        return graph.neighbors(nodes, edges, node.id, relation)

    def get_community(self, community: int, repo: str = "", page: int = 1, per_page: int = 50) -> tuple[DataFrame, int, bool]:
        nodes, _ = self._graph(repo)
        return catalog.page(nodes.where(F.col("community") == community), ["ord"], page, per_page)

    def god_nodes(self, repo: str = "", top: int = 10) -> DataFrame:
        return graph.god_nodes(*self._graph(repo), top)

    def overview(self, repo: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
        return graph.overview(*self._graph(repo))

    def graph_stats(self, repo: str = "") -> DataFrame:
        return graph.stats(*self._graph(repo))

    def shortest_path(self, a: str, b: str, repo: str = "", most: int = 8) -> list[str]:
        name = self._graph_name(repo, f"{a} {b}")
        nodes, edges = self.graphs[name]
        ends = [graph.resolve(nodes, x).first() for x in (a, b)]
        if None in ends:
            raise ValueError("no such node")
        if stored := self.stored_graphs.get(name):
            return stored.shortest_path(nodes, ends[0].id, ends[1].id, min(12, most))
        return graph.shortest_path(nodes, edges, ends[0].id, ends[1].id, min(12, most))

    # --- history ----------------------------------------------------------------------------

    def _git(self, repo: str, what: str, **options) -> DataFrame:
        web.register(self.spark)
        return self.spark.read.format("tessera_git").option("path", self.git_paths[repo]).option("what", what).options(**{k: str(v) for k, v in options.items() if v != ""}).load()

    def list_refs(self, repo: str, kind: str = "", page: int = 1, per_page: int = 20) -> tuple[DataFrame, int, bool]:
        rows = self._git(repo, "refs")
        return catalog.page(rows.where(F.col("kind") == kind) if kind else rows, [F.desc("at"), "name"], page, per_page)

    def git_log(self, repo: str, from_: str = "", to: str = "", skip: int = 0, limit: int = 50, file: str = "") -> DataFrame:
        return self._git(repo, "log", **{"from": from_, "to": to, "skip": skip, "limit": limit, "file": file})

    def git_diff(self, repo: str, from_: str, to: str = "HEAD") -> DataFrame:
        return self._git(repo, "diff", **{"from": from_, "to": to})

    def git_blame(self, repo: str, file: str, rev: str = "HEAD") -> DataFrame:
        """Hunks: runs of neighbouring lines of one commit."""
        lines = self._git(repo, "blame", file=file, to=rev).withColumn("file", F.lit(file))
        return catalog.islands(lines, ["file"], "line", ["line"], "sha").orderBy("line_start")

    # --- catalog ------------------------------------------------------------------------------

    def list_repos(self, owner: str = "", search: str = "", status: str = "", namespace: str = "*", page: int = 1, per_page: int = 20) -> tuple[DataFrame, int, bool]:
        return catalog.page(catalog.repos(self.table("repos"), owner, search, status, namespace), ["id"], page, per_page)

    def repo_status(self, repo: str) -> DataFrame:
        """A repository by its id, or by a short name that only one has."""
        rows = self.table("repos")
        exact = rows.where(F.col("id") == repo)
        return exact if not exact.isEmpty() else rows.where(F.col("id").endswith("/" + repo))

    def list_namespaces(self) -> DataFrame:
        return catalog.namespace_groups(self.table("repos"), self.table("namespaces"))

    def queue_status(self) -> DataFrame:
        return catalog.queue_order(self.table("tasks"))

    # --- commands -------------------------------------------------------------------------------

    def _put(self, name: str, rows: list[tuple], key: list[str]) -> None:
        new = self.spark.createDataFrame(rows, SCHEMAS[name])
        self.tables[name] = sync.upsert(self.table(name), new, key)

    def _drop(self, name: str, condition) -> None:
        rows = self.table(name)
        if name in self.indexes:
            self.indexes[name].update(gone=saved(rows.where(condition).select("id"), "gone-ids"))
        self.tables[name] = rows.where(~F.coalesce(condition, F.lit(False)))

    def add_repo(self, id_: str, url: str, namespace: str = "") -> None:
        if ":" in id_ or namespace == "*":
            raise ValueError("not a repository id or namespace")
        self._put("repos", [(id_, url, "pending", "" if namespace == "default" else namespace)], ["id"])

    def remove_repo(self, id_: str) -> None:
        if self.workspace is not None:
            self.workspace.remove(id_)
        self._drop("repos", F.col("id") == id_)
        for t in ("chunks", "code", "vectors", "overrides"):
            self._drop(t, F.col("repo") == id_)

    def set_repo_overrides(self, id_: str, **overrides) -> DataFrame:
        """Replace a repository's overrides; one row: did anything change, did anything the graph is built from."""
        if self.table("repos").where(F.col("id") == id_).isEmpty():
            raise ValueError(f"no repository {id_}")
        schema = SCHEMAS["overrides"]
        new = self.spark.createDataFrame([(id_, overrides)], schema).select("repo", catalog.normal_overrides(F.col("overrides")).alias("overrides"))
        old = self.table("overrides").select("repo", F.col("overrides").alias("_old"))
        a, b = F.col("overrides"), catalog.normal_overrides(F.col("_old"))
        out = new.join(old, "repo", "left").select("repo", catalog.overrides_changed(a, b).alias("changed"), catalog.graph_overrides_changed(a, b).alias("graph_changed"))
        self.tables["overrides"] = sync.upsert(self.table("overrides"), new, ["repo"])
        return out

    def set_repo_namespace(self, id_: str, namespace: str) -> None:
        if namespace == "*":
            raise ValueError("* means all namespaces")
        own = "" if namespace == "default" else namespace
        self.tables["repos"] = self.table("repos").withColumn("namespace", F.when(F.col("id") == id_, F.lit(own)).otherwise(F.col("namespace")))

    def set_namespace_description(self, namespace: str, description: str | None = None) -> None:
        """Describe a namespace; None keeps what is stored, '' clears it."""
        stored = self.table("namespaces").where(F.col("namespace") == namespace).first()
        kept = stored.description if stored else None
        self._put("namespaces", [(namespace, kept if description is None else description)], ["namespace"])

    def delete_namespace(self, namespace: str) -> None:
        self._drop("namespaces", F.col("namespace") == namespace)

    def add_source(self, name: str, type_: str, config: str = "{}") -> None:
        if type_ not in ("pages", "confluence", "jira"):
            raise ValueError(f"unknown type: {type_}")
        self._put("sources", [(name, type_, config, "{}")], ["name"])

    def delete_source(self, name: str) -> None:
        """The source, its pages and what is indexed of them."""
        self._drop("sources", F.col("name") == name)
        self._drop("pages", F.col("collection") == name)
        for t in ("chunks", "vectors"):
            self._drop(t, F.col("repo") == f"web:{name}")

    def register_pages(self, name: str, pages: DataFrame) -> dict[str, int]:
        """Add (url, title, teams, hash) rows; counts of added, updated and unchanged ones."""
        new = pages.select(F.lit(name).alias("collection"), url_slug(F.col("url")).alias("slug"), "url", "title", "teams", normal_set(F.col("teams")).alias("teams_norm"), "hash", F.lit("ready").alias("status")).dropDuplicates(["slug"])
        old = self.table("pages").select("collection", "slug", F.col("hash").alias("_h"))
        kinds = new.join(old, ["collection", "slug"], "left").groupBy(F.when(F.col("_h").isNull(), "added").when(F.col("_h") == F.col("hash"), "unchanged").otherwise("updated").alias("k")).count().collect()
        self.tables["pages"] = sync.upsert(self.table("pages"), new, ["collection", "slug"])
        return {r.k: r["count"] for r in kinds}

    def import_sitemap(self, name: str, url: str) -> dict[str, int]:
        urls = web.sitemap_urls(url)
        return self.register_pages(name, self.spark.createDataFrame([(u, None, None, None) for u in urls], "url string, title string, teams array<string>, hash string"))

    def delete_page(self, name: str, slug: str) -> None:
        self._drop("pages", (F.col("collection") == name) & (F.col("slug") == slug))

    def refresh_source(self, name: str, swept: DataFrame, complete: bool, removed: DataFrame | None = None) -> DataFrame:
        """Take over a sweep's pages and drop what is gone; returns the deleted keys."""
        self.register_pages(name, swept)
        have = self.table("pages").where(F.col("collection") == name).select("slug")
        seen = swept.select(url_slug(F.col("url")).alias("slug"))
        gone = removed.select("slug") if removed is not None else seen.limit(0)
        dead = sync.prune(have, seen, gone, ["slug"], complete)
        marked = dead.withColumn("collection", F.lit(name))
        self.tables["pages"] = self.table("pages").join(marked, ["collection", "slug"], "left_anti").select(*self.table("pages").columns)
        return dead
