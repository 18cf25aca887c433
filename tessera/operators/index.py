"""Maintenance of indexes kept as Parquet folders, partitioned by repository.

A rebuild or a delta writes only the partitions of the repositories it touches. The rows of a
delta are written to a staging folder first, as a partition cannot be read while it is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.globs import ignored
from tessera.functions.text import location_line
from tessera.storage import shared_dir


def exists(rows: DataFrame, condition: Column) -> bool:
    """Whether any row satisfies the condition; stops at the first."""
    return not rows.where(condition).limit(1).isEmpty()


def indexed_paths(rows: DataFrame, repo: str) -> DataFrame:
    """Distinct, non-empty paths of a repository's rows."""
    return rows.where((F.col("repo") == repo) & (F.col("path") != "")).select("path").distinct()


class Index:
    """One folder of rows with a ``repo`` column, which is its partition."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _replace(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(self.path)

    def rebuild(self, repo: str, rows: DataFrame) -> None:
        """All rows of a repository anew; no rows delete it."""
        new = rows.where(F.col("repo") == repo).select(self.spark.createDataFrame([], self.schema).columns)
        if new.isEmpty():
            self.delete(repo)
        else:
            self._replace(new)

    def delta(self, repo: str, changed: DataFrame, rows: DataFrame) -> None:
        """Rows of the changed or removed paths go, ``rows`` (of what is still there) come."""
        kept = self.read().where(F.col("repo") == repo).join(changed.select("path").distinct(), "path", "left_anti")
        staged = shared_dir(self.spark, "delta")
        kept.unionByName(rows.where(F.col("repo") == repo).select(kept.columns)).write.parquet(staged)
        self.rebuild(repo, self.spark.read.schema(kept.schema).parquet(staged))

    def delete(self, repo: str, paths: DataFrame | None = None) -> None:
        """A repository's rows, or those of some of its paths."""
        if paths is not None:
            self.delta(repo, paths, self.read().limit(0))
            return
        jvm = self.spark._jvm
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo)
        p = jvm.org.apache.hadoop.fs.Path(self.path, f"repo={escaped}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def upsert_vectors(self, rows: DataFrame, vector: str = "vector") -> None:
        """Insert or replace by id; vectors of another length than the stored ones wipe the index first."""
        sizes = [r[0] for r in rows.select(F.size(vector)).distinct().limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError("vectors of different lengths")
        old = self.read()
        first = old.select(F.size(vector)).limit(1).collect()
        staged = shared_dir(self.spark, "vectors")
        touched = rows.select("repo").distinct()
        if first and sizes and first[0][0] != sizes[0]:
            rows.select(old.columns).write.parquet(staged)
            self.spark.read.schema(old.schema).parquet(staged).write.mode("overwrite").partitionBy("repo").parquet(self.path)
            return
        kept = old.join(touched, "repo", "left_semi").join(rows.select("id").distinct(), "id", "left_anti")
        kept.select(old.columns).unionByName(rows.select(old.columns)).write.parquet(staged)
        self._replace(self.spark.read.schema(old.schema).parquet(staged))


def backfill_kind(rows: DataFrame) -> DataFrame:
    """The stored discriminator of older rows, from the key's prefix."""
    kind = F.when(F.col("repo").startswith("web:"), "web").otherwise("repo")
    return rows.withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), kind) if "kind" in rows.columns else kind)


def symbols(nodes: DataFrame) -> DataFrame:
    """(path, symbols) of a graph's nodes: those with a file, a line, and another label than the file's name."""
    path = F.regexp_replace("source_file", r"^(\./)+", "")
    line = location_line(F.col("source_location"))
    named = nodes.where("source_file <> ''").select(path.alias("path"), line.alias("line"), F.col("label").alias("name"))
    own = named.where((F.col("line") > 0) & (F.col("name") != F.element_at(F.split("path", "/"), -1)))
    return own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("symbols"))


def has_excluded(nodes: DataFrame, globs: list[str]) -> bool:
    """Whether a graph still holds nodes of files that are to be ignored."""
    return exists(nodes, ignored(F.col("source_file"), globs))


def merged_graph(graphs: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several repositories side by side; ids get the repository's name in front."""
    nodes = edges = None
    for repo, (n, e) in graphs.items():
        own = lambda c, r=repo: F.concat(F.lit(r + "::"), F.col(c))
        n = n.withColumn("id", own("id")).withColumn("repo", F.lit(repo))
        e = e.withColumn("source", own("source")).withColumn("target", own("target")).withColumn("repo", F.lit(repo))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return nodes, edges
