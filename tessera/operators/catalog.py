"""Catalog listings, groups, paging, history islands, snapshots, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.stages import STAGES


# What a repository may override, and the stages it may skip.
OVERRIDE_LISTS = ("include", "include_extra", "exclude", "graph_exclude")
OVERRIDE_TEXTS = ("docs_prompt", "docs_prompt_extra")
OVERRIDE_SIZES = ("docs_max_source_bytes", "docs_max_group_bytes", "docs_max_synthesis_bytes")
OVERRIDES = ", ".join([*(f"{x}: array<string>" for x in OVERRIDE_LISTS), *(f"{x}: string" for x in OVERRIDE_TEXTS), *(f"{x}: bigint" for x in OVERRIDE_SIZES), "skip_stages: array<string>"])


def normal_overrides(o: Column) -> Column:
    """Blank entries dropped, texts trimmed, sizes not below 0, known stages once and in order; missing fields are empty."""
    none = F.array().cast("array<string>")

    def trimmed(x: Column) -> Column:
        return F.coalesce(F.filter(F.transform(x, lambda g: F.trim(g)), lambda g: g != ""), none)

    known = F.filter(F.transform(o["skip_stages"], lambda s: F.lower(F.trim(s))), lambda s: s.isin(*STAGES))
    return F.struct(
        *[trimmed(o[x]).alias(x) for x in OVERRIDE_LISTS],
        *[F.coalesce(F.trim(o[x]), F.lit("")).alias(x) for x in OVERRIDE_TEXTS],
        *[F.greatest(F.coalesce(o[x], F.lit(0)), F.lit(0)).cast("long").alias(x) for x in OVERRIDE_SIZES],
        F.coalesce(F.array_sort(F.array_distinct(known)), none).alias("skip_stages"),
    )


def overrides_changed(a: Column, b: Column) -> Column:
    """Whether two normal sets of overrides differ in anything."""
    return ~a.eqNullSafe(b)


def graph_overrides_changed(a: Column, b: Column) -> Column:
    """Whether they differ in what the graph is built from: its exclusions, or whether it is built."""
    skips = [F.array_contains(o["skip_stages"], "graph") for o in (a, b)]
    return ~a["graph_exclude"].eqNullSafe(b["graph_exclude"]) | ~skips[0].eqNullSafe(skips[1])


def stale_graphs(repos_: DataFrame, version: str) -> DataFrame:
    """Cloned repositories whose graph lacks the managed ignore file or was built by another version."""
    current = F.col("managed_ignore") & F.col("graph_version").eqNullSafe(F.lit(version))
    return repos_.where(F.col("cloned") & F.col("has_graph") & ~F.coalesce(current, F.lit(False))).select("id")


def to_reindex(repos_: DataFrame, sources: DataFrame) -> DataFrame:
    """Keys to index anew: repositories that are ready, and every web source."""
    return repos_.where(F.col("status") == "ready").select("id").unionByName(sources.select(F.concat(F.lit("web:"), "name").alias("id")))


def like_literal(x: str) -> str:
    """A text as a LIKE pattern for itself."""
    return x.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def namespace_is(col: Column, asked: str) -> Column:
    """'*' is all, an empty or 'default' name is the bucket without one, else equality."""
    if asked == "*":
        return F.lit(True)
    own = F.coalesce(col, F.lit(""))
    return own == "" if asked in ("", "default") else own == asked


def repos(df: DataFrame, owner: str = "", search: str = "", status: str = "", namespace: str = "*", id_: str = "id") -> DataFrame:
    """Rows of an owner (ids ``owner/x``, not deeper), a search text, a status and a namespace."""
    out = df
    if owner:
        p = like_literal(owner)
        out = out.where(F.col(id_).ilike(f"{p}/%") & ~F.col(id_).ilike(f"{p}/%/%"))
    if search:
        out = out.where(F.col(id_).ilike(f"%{like_literal(search)}%"))
    if status:
        out = out.where(F.col("status") == status)
    return out.where(namespace_is(F.col("namespace"), namespace)) if namespace != "*" else out


def owner_groups(df: DataFrame, id_: str = "id") -> DataFrame:
    """Repositories by what stands before the last '/' of their ids."""
    owner = F.regexp_replace(F.col(id_), r"/?[^/]*$", "")
    return df.groupBy(owner.alias("owner")).agg(F.count("*").alias("repos")).orderBy("owner")


def namespace_groups(df: DataFrame, described: DataFrame) -> DataFrame:
    """Counts by namespace, and descriptions; either may lack the other."""
    counts = df.groupBy(F.coalesce("namespace", F.lit("")).alias("namespace")).agg(F.count("*").alias("repos"))
    both = counts.join(described.select("namespace", "description"), "namespace", "full")
    return both.select("namespace", F.coalesce("repos", F.lit(0)).alias("repos"), F.coalesce("description", F.lit("")).alias("description")).orderBy("namespace")


def distinct_teams(df: DataFrame, teams: str, order: str) -> DataFrame:
    """Values whatever their case, in their first casing by ``order``, sorted without case."""
    each = df.select(F.col(order).alias("_o"), F.posexplode(teams).alias("_p", "team")).withColumn("team", F.trim("team")).where("team <> ''")
    first = each.groupBy(F.lower("team").alias("key")).agg(F.min(F.struct("_o", "_p", "team")).alias("m"))
    return first.select(F.col("m.team").alias("team"), "key").orderBy("key")


def page(df: DataFrame, order: list, number: int = 1, size: int = 20, most: int = 200) -> tuple[DataFrame, int, bool]:
    """(rows, exact total, whether more follow) of a page."""
    number, size = max(1, number), min(size if size > 0 else 20, most)
    total = df.count()
    return df.orderBy(*order).offset((number - 1) * size).limit(size), total, number * size < total


def islands(rows: DataFrame, partition: list[str], line: str, order: list, same: str) -> DataFrame:
    """Runs of neighbouring lines with one value of ``same``: first and last line, and size.

    A run ends where the value changes or a line is missing.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)) & (F.col(line) == F.lag(line).over(w) + 1), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*partition, "_run").agg(F.min(same).alias(same), F.min(line).alias("line_start"), F.max(line).alias("line_end"), F.count("*").alias("lines")).drop("_run")


def expired_snapshots(df: DataFrame, group: list[str], newest: list, age_minutes: Column, grace: int = 5) -> DataFrame:
    """Snapshots that may go: not the newest of their group, and older than the grace."""
    w = Window.partitionBy(*group).orderBy(*newest)
    return df.withColumn("_r", F.row_number().over(w)).where((F.col("_r") > 1) & (age_minutes >= grace)).drop("_r")


def pack(df: DataFrame, group: list[str], order: list, size: int = 24) -> DataFrame:
    """Members of each group dealt into packs of ``size`` in their order; adds ``pack`` from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("pack", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def queue_order(df: DataFrame) -> DataFrame:
    """Live tasks first, newest first; then ended ones by their end."""
    ended = F.col("ended_at").isNotNull()
    return df.orderBy(ended.cast("int"), F.desc("ended_at"), F.desc("seq"))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left at the rate so far; null before three seconds or five items."""
    return F.when((elapsed >= 3) & (done >= 5) & (total > done), elapsed / done * (total - done))


def enrich(hits: DataFrame, *lookups: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left joins of small result sets with metadata; Spark broadcasts a side whose size allows it."""
    out = hits
    for df, keys in lookups:
        out = out.join(df, keys, "left")
    return out


def scope_keys(repos_: DataFrame, sources: DataFrame, scope: str, namespace: str) -> DataFrame:
    """Keys that a search may see: of the namespace's repositories, and every web source with scope 'all'."""
    out = repos_.where(namespace_is(F.col("namespace"), namespace)).select("id")
    return out.unionByName(sources.select(F.concat(F.lit("web:"), "name").alias("id"))) if scope == "all" else out


def active_repos(tasks: DataFrame, repos_: DataFrame) -> DataFrame:
    """(id, running, status) of what has running tasks: their kinds in order, each once, and the repository's status if it is one."""
    running = tasks.where("state = 'running'").groupBy(F.col("repo").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("running"))
    return running.join(repos_.select("id", "status"), "id", "left").select("id", "running", "status").orderBy("id")
