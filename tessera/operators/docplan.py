"""Planning of written documentation: groups of files, prompt budgets, reuse of earlier summaries.

The model itself is a function given by the caller; everything up to the prompt and after the
answer is DataFrame work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.batches import small_batches
from tessera.functions.markdown import SUMMARY_LEAST, SUMMARY_RULE, summary_sections
from tessera.functions.text import content_hash
from tessera.operators.catalog import pack
from tessera.operators.order import saved
from tessera.operators.tables import KeyedTable

MOST_GROUPS, GROUP_FILES = 40, 24
FILE_BUDGET_LEAST = 2000


def groups(files: DataFrame, communities: DataFrame) -> DataFrame:
    """(path, group, community): files by their community, 24 a group at most.

    With up to 40 communities (files without one are one more, -1, and come last) a group holds
    files of one; groups are filled in order of community, then path. With more, communities
    share groups, the largest first, and a mixed group has -1. No file is left out: a group
    never grows beyond 24, so there may be more than 40.
    """
    known = files.join(communities.select(F.col("source_file").alias("path"), "community"), "path", "left")
    known = known.select("path", F.coalesce("community", F.lit(-1)).alias("community"))
    sizes = known.groupBy("community").agg(F.count("*").alias("n"))
    kinds, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if kinds <= MOST_GROUPS:
        packed = pack(known, ["community"], ["path"], GROUP_FILES)
        order = packed.select("community", "pack").distinct().withColumn("group", F.row_number().over(Window.orderBy(F.col("community") == -1, "community", "pack")) - 1)
        return packed.join(order, ["community", "pack"]).select("path", "group", "community")
    size = min(GROUP_FILES, -(-total // MOST_GROUPS))
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("n"), F.col("community") == -1, "community").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("community").orderBy("path")) - 1
    dealt = known.withColumn("_i", at).join(starts.select("community", "before"), "community").withColumn("group", F.floor((F.col("_i") + F.col("before")) / size).cast("int"))
    mixed = dealt.groupBy("group").agg(F.min("community").alias("lo"), F.max("community").alias("hi"))
    return dealt.join(mixed, "group").select("path", "group", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("community"))


def reuse(files: DataFrame, earlier: DataFrame) -> DataFrame:
    """Files with their content hash and the earlier summary where the hash is the same."""
    own = files.withColumn("hash", content_hash(F.coalesce("text", F.lit(""))))
    old = earlier.select("path", F.col("hash").alias("_h"), "summary")
    return own.join(old, "path", "left").select(*files.columns, "hash", F.when(F.col("_h") == F.col("hash"), F.col("summary")).alias("summary"))


def prompts(files: DataFrame, group_budget: int) -> DataFrame:
    """A prompt for each group that has files to summarise: contents cut to an equal share of the budget, 2000 bytes at least."""
    todo = files.where("summary is null")
    n = todo.groupBy("group").agg(F.count("*").alias("_n"))
    share = F.greatest(F.lit(FILE_BUDGET_LEAST), F.floor(F.lit(group_budget) / F.col("_n")))
    body = F.concat(F.lit("## "), F.col("path"), F.lit("\n"), F.substr(F.coalesce("text", F.lit("")), F.lit(1), share.cast("int")))
    cut = todo.join(n, "group").select("group", "path", body.alias("body"))
    return cut.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("path", "body"))).alias("f")).select("group", F.transform("f", lambda x: x.path).alias("paths"), F.array_join(F.transform("f", lambda x: x.body), "\n\n").alias("prompt"))


def summarise(prompted: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(path, summary) from the model's answers, cut at the headings that name the files; a group that fails has its error."""
    small_batches(prompted.sparkSession)

    @F.pandas_udf("array<struct<path string, summary string, error string>>")
    def ask(prompt: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for p, names in zip(prompt, paths, strict=True):
            try:
                got = summary_sections(model(p), list(names))
                out.append([{"path": k, "summary": got.get(k), "error": None if k in got else "not in the answer"} for k in names])
            except Exception as e:
                out.append([{"path": k, "summary": None, "error": str(e)} for k in names])
        return pd.Series(out)

    return prompted.select(F.explode(ask("prompt", "paths")).alias("s")).select("s.*")


def joined_summaries(summaries: DataFrame, budget: int) -> str:
    """Summaries in order of their paths, joined by rules; over the budget, all cut to an equal share of at least 400 bytes.

    They are cut where they lie: what comes to the driver is the prompt.
    """
    part = F.concat(F.lit("## "), "path", F.lit("\n"), "summary")
    each = summaries.where("summary is not null").select("path", part.alias("part"))
    n, size = each.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("part")), F.lit(0))).first()
    if size + max(0, n - 1) * len(SUMMARY_RULE) > budget:
        share = max(SUMMARY_LEAST, budget // n)
        # a character that the cut splits goes
        cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.col("part").cast("binary"), 1, share).cast("string")), "\ufffd+$", "")
        each = each.select("path", F.when(F.octet_length("part") <= share, F.col("part")).otherwise(cut).alias("part"))
    return SUMMARY_RULE.join(r.part for r in each.orderBy("path").collect())


class Documentation:
    """Written documentation of repositories: summaries of files by content, and a text made of them.

    Summaries are kept by path and hash, the text with the hash of its instructions. A run asks
    the model for files that changed, and for the text only if a summary or the instructions did.
    """

    def __init__(self, spark, root: str, model: Callable[[str], str], buckets: int = 8):
        self.model = model
        self.summaries = KeyedTable(spark, f"{root}/summaries", "repo string, path string, hash string, summary string", ["repo", "path"], buckets)
        self.texts = KeyedTable(spark, f"{root}/texts", "repo string, instructions string, markdown string, files long", ["repo"], buckets)

    def generate(self, repo: str, files: DataFrame, communities: DataFrame, instructions: str, overview: str = "", group_budget: int = 200_000, budget: int = 200_000, force: bool = False) -> dict[str, int | str]:
        """Bring a repository's documentation up to its files (path, text).

        Returns the text and how many files were reused, summarised and failed, and whether the
        text is new. A failed file has no summary and is asked for again in the next run.
        """
        mine = self.summaries.read().where(F.col("repo") == repo)
        earlier = mine.limit(0) if force else mine
        grouped = files.join(groups(files.select("path"), communities).select("path", "group"), "path")
        todo = saved(reuse(grouped, earlier), "reuse")
        told = saved(summarise(prompts(todo, group_budget), self.model), "summaries")
        fresh = told.where("summary is not null").join(todo.select("path", "hash"), "path").select(F.lit(repo).alias("repo"), "path", "hash", "summary")
        gone = saved(mine.select("repo", "path").join(todo.select("path"), "path", "left_anti").select("repo", "path"), "gone-summaries")
        changed, lost = fresh.count(), gone.count()
        if changed or lost:
            self.summaries.merge(fresh, gone)
        known = self.summaries.read().where(F.col("repo") == repo)
        counts = {"reused": todo.where("summary is not null").count(), "summarised": changed, "failed": told.where("summary is null").count(), "written": 0}
        n = known.count()
        if not n:
            raise ValueError("no source files to document")
        said = instructions_hash(instructions)
        old = self.texts.read().where(F.col("repo") == repo).first()
        if old is not None and not force and not changed and old.instructions == said and old.files == n:
            return counts | {"markdown": old.markdown}
        asked = [instructions, f"Repository: {repo}", f"Knowledge-graph overview:\n{overview}" if overview else "", "Per-file summaries:\n\n" + joined_summaries(known, budget)]
        markdown = self.model("\n\n".join(x for x in asked if x)).strip() + "\n"
        self.texts.merge(self.texts.spark.createDataFrame([(repo, said, markdown, n)], self.texts.schema))
        return counts | {"markdown": markdown, "written": 1}


def instructions_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def stale(existing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Written documents that the manifest no longer has."""
    return existing.join(manifest.select("path").distinct(), "path", "left_anti")


def enrich_images(pages: DataFrame, images: DataFrame, known: DataFrame, describe: Callable[[bytes], str] | None, engine: str) -> DataFrame:
    """(hash, description) of images, from the cache of this engine where it is known; the rest by the model, if there is one."""
    each = images.join(pages.select("slug"), "slug", "left_semi").select("hash", "content").dropDuplicates(["hash"])
    cached = known.where(F.col("engine") == engine).select("hash", "description")
    out = each.join(cached, "hash", "left")
    if describe is None:
        return out.select("hash", "description")
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def ask(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else describe(bytes(b)))

    return out.select("hash", F.coalesce("description", ask(F.when(F.col("description").isNull(), F.col("content")))).alias("description"))
