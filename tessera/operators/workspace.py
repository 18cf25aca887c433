"""Indexes of repositories kept up to date end to end: scan, change detection, chunks, postings, vectors.

A refresh of a repository is a graph of stages. What each stage has done is a row in shared
storage, written when it ends; a refresh that was stopped starts at the first stage that has
no such row for its run. A stage by itself can be run again at any time: it compares the
files' hashes with the stored ones and writes what differs, and the hashes come last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sync
from tessera.operators.embeddings import EmbeddingCache
from tessera.operators.order import saved
from tessera.operators.postings import LexicalIndex
from tessera.operators.tables import KeyedTable
from tessera.sources import files


@dataclass(frozen=True)
class Stage:
    """A step of a refresh: what must be done before it, and the step, which returns how many rows it changed."""

    name: str
    needs: tuple[str, ...]
    step: Callable[[str], int]


class StageLog:
    """What became of each stage of each repository's last run."""

    SCHEMA = "repo string, stage string, run string, state string, rows long, error string, at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.table = KeyedTable(spark, root, self.SCHEMA, ["repo", "stage"], 8)

    def put(self, repo: str, stage: str, run: str, state: str, rows: int | None = None, error: str | None = None) -> None:
        row = (repo, stage, run, state, rows, error, datetime.now(timezone.utc).replace(tzinfo=None))
        self.table.merge(self.spark.createDataFrame([row], self.SCHEMA))

    def of(self, repo: str) -> dict[str, dict]:
        """A repository's stages; a handful of rows."""
        return {r.stage: r.asDict() for r in self.table.read().where(F.col("repo") == repo).collect()}

    def reconcile(self) -> None:
        """After a crash: whatever was running has failed. Nothing else of a run is lost."""
        dead = self.table.read().where("state = 'running'")
        if not dead.isEmpty():
            self.table.merge(saved(dead.withColumn("state", F.lit("error")).withColumn("error", F.lit("interrupted")), "reconciled"))


def refresh(log: StageLog, stages: list[Stage], repo: str, run: str, wanted: list[str] | None = None, skipped: tuple[str, ...] = ()) -> dict[str, str]:
    """Run the wanted stages, and what they need, in an order that respects the needs; stage -> state.

    Stages that this run has finished are not repeated. A failure stops the stages that need
    it, no others. A stage that is skipped counts as done for those that need it.
    """
    by_name = {s.name: s for s in stages}
    need, todo = set(), list(by_name if wanted is None else wanted)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += by_name[name].needs
    known, out = log.of(repo), {}
    for s in stages:  # given in an order that runs
        if s.name not in need:
            continue
        mine = known.get(s.name, {})
        if s.name in skipped:
            out[s.name] = "skipped"
        elif mine.get("run") == run and mine.get("state") == "done":
            out[s.name] = "done"
        elif any(out.get(n) in ("error", "waiting") for n in s.needs):
            out[s.name] = "waiting"
        else:
            log.put(repo, s.name, run, "running")
            try:
                rows = s.step(repo)
            except Exception as e:
                log.put(repo, s.name, run, "error", error=str(e)[:1000] or type(e).__name__)
                out[s.name] = "error"
            else:
                log.put(repo, s.name, run, "done", rows)
                out[s.name] = "done"
    return out


class Workspace:
    """Code and documents of repositories, each with a table of file hashes, a text index and vectors."""

    KINDS = ("code", "docs")

    def __init__(self, spark: SparkSession, root: str, embedder=None, size: int = 64, buckets: int = 16):
        self.spark, self.root = spark, root.rstrip("/")
        self.folders: dict[str, str] = {}
        self.log = StageLog(spark, f"{self.root}/stages")
        own = {"code": "repo string, path string, symbol string, start_line int, end_line int", "docs": "repo string, path string, kind string, title string"}
        self.files = {k: KeyedTable(spark, f"{self.root}/{k}-files", "repo string, path string, hash string", ["repo", "path"], buckets) for k in self.KINDS}
        self.text = {k: LexicalIndex(spark, f"{self.root}/{k}-text", own[k], ("repo", "path"), buckets=buckets) for k in self.KINDS}
        self.vectors = {k: KeyedTable(spark, f"{self.root}/{k}-vectors", "id string, repo string, path string, hash string, vector array<float>", ["id"], buckets) for k in self.KINDS}
        self.cache = EmbeddingCache(spark, f"{self.root}/embeddings", embedder, size, buckets) if embedder else None

    # --- one kind of file -------------------------------------------------------------------

    def scan(self, kind: str, repo: str) -> DataFrame:
        """(path, content, and for documents the title) of a repository's files of a kind."""
        folder = self.folders[repo]
        return files.code_documents(self.spark, folder) if kind == "code" else files.markdown_documents(self.spark, folder).withColumnRenamed("text", "content")

    def chunks(self, kind: str, repo: str, rows: DataFrame) -> DataFrame:
        """Chunks of scanned files in the columns of the kind's text index."""
        if kind == "code":
            cut = files.code_chunks(rows, repo)
            return cut.withColumn("text", F.concat_ws("\n", "path", "symbol", "snippet")).select(self.text[kind].rows.columns)
        cut = files.document_chunks(rows.withColumnRenamed("content", "text"), repo, "repo")
        return cut.withColumn("text", F.concat_ws("\n", "title", "excerpt")).select(self.text[kind].rows.columns)

    def delta(self, kind: str, repo: str) -> tuple[DataFrame, DataFrame]:
        """(files that are new or changed, paths of files that are there no more), both written down."""
        now = self.scan(kind, repo)
        stored = self.files[kind].read().where(F.col("repo") == repo)
        kinds = saved(sync.changed(now, stored.select("path", "hash"), ["path"], "content"), "scanned")
        gone = stored.select("path").join(kinds.select("path"), "path", "left_anti")
        return kinds.where("change <> 'unchanged'"), saved(gone, "gone-paths")

    def _ids_of(self, kind: str, repo: str, paths: DataFrame) -> DataFrame:
        rows = self.text[kind].documents().where(F.col("repo") == repo)
        return saved(rows.join(paths, "path", "left_semi").select("id"), "gone-ids")

    def update_text(self, kind: str, repo: str) -> int:
        """Bring the text index up to the files; only changed files are cut and only their rows are written.

        Stored chunks of new files go too: a run that stopped before the hashes has left them.
        """
        changed, paths = self.delta(kind, repo)
        gone = self._ids_of(kind, repo, paths.unionByName(changed.select("path")))
        new = saved(self.chunks(kind, repo, changed.drop("hash", "change")), "chunks")
        self.text[kind].update(new, gone)
        hashes = changed.select(F.lit(repo).alias("repo"), "path", "hash")
        self.files[kind].merge(hashes, paths.select(F.lit(repo).alias("repo"), "path"))
        return new.count()

    def update_vectors(self, kind: str, repo: str) -> int:
        """Bring the vectors up to the text index; a text that was embedded before is not sent again."""
        if self.cache is None:
            raise ValueError("no embedder")
        rows = self.text[kind].documents().where(F.col("repo") == repo).select("id", "repo", "path", "text")
        done = self.cache.embed(rows, "text").where("vector is not null").select("id", "repo", "path", "hash", "vector")
        stored = self.vectors[kind].read().where(F.col("repo") == repo).select("id", F.col("hash").alias("_h"))
        both = saved(done.join(stored, "id", "full").select("id", "repo", "path", "hash", "vector", "_h"), "vectors")
        new = both.where("hash is not null and not (hash <=> _h)").select("id", "repo", "path", "hash", "vector")
        self.vectors[kind].merge(new, both.where("hash is null").select("id"))
        return new.count()

    def remove(self, repo: str) -> None:
        """Everything of a repository, its stages too."""
        for k in self.KINDS:
            mine = F.col("repo") == repo
            self.text[k].update(gone=saved(self.text[k].documents().where(mine).select("id"), "gone-ids"))
            self.vectors[k].merge(gone=saved(self.vectors[k].read().where(mine).select("id"), "gone-ids"))
            self.files[k].merge(gone=saved(self.files[k].read().where(mine).select("repo", "path"), "gone-paths"))
        self.log.table.merge(gone=saved(self.log.table.read().where(F.col("repo") == repo).select("repo", "stage"), "gone-stages"))

    # --- all of it --------------------------------------------------------------------------

    def stages(self) -> list[Stage]:
        out = []
        for k in self.KINDS:
            out.append(Stage(f"{k}_text", (), lambda repo, k=k: self.update_text(k, repo)))
            if self.cache is not None:
                out.append(Stage(f"{k}_vectors", (f"{k}_text",), lambda repo, k=k: self.update_vectors(k, repo)))
        return out

    def refresh(self, repo: str, run: str | None = None, wanted: list[str] | None = None, skipped: tuple[str, ...] = ()) -> dict[str, str]:
        """Refresh a repository; with the ``run`` of one that was stopped, what that has finished is kept."""
        if repo not in self.folders:
            raise ValueError(f"no folder for {repo}")
        return refresh(self.log, self.stages(), repo, run or uuid.uuid4().hex, wanted, skipped)
