"""Which stages of a refresh run, in what order, and what is left after a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stages and what each needs.
STAGES = ("graph", "docs", "docs_index", "code_index")
NEEDS = {"graph": (), "docs": ("graph",), "docs_index": ("docs",), "code_index": ("graph",)}
REPO_POLL, FULL_RESYNC = "@every 1h", "0 2 * * *"


def closure(wanted: list[str], done: list[str] = ()) -> list[str]:
    """The wanted stages and what they need that is not done, in an order that runs."""
    need: set[str] = set()
    todo = [s for s in wanted if s in STAGES]
    while todo:
        s = todo.pop()
        if s not in need:
            need.add(s)
            todo += [x for x in NEEDS[s] if x not in done]
    return [s for s in STAGES if s in need]


def runnable(wanted: list[str], skipped: list[str], failed: list[str] = ()) -> list[str]:
    """Wanted stages whose needs have not failed; asking for a skipped one is an error."""
    clash = [s for s in wanted if s in skipped]
    if clash:
        raise ValueError(f"skipped for this repository: {', '.join(clash)}")
    dead = set(failed)
    for s in STAGES:
        if any(x in dead for x in NEEDS[s]):
            dead.add(s)
    return [s for s in STAGES if s in wanted and s not in dead]


def reconcile(stages: DataFrame) -> DataFrame:
    """After a crash: whatever was running has failed."""
    running = F.col("status").isin("running", "fetching")
    return stages.withColumn("error", F.when(running, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(running, "error").otherwise(F.col("status")))


def live_state(tasks: DataFrame) -> DataFrame:
    """Each repository's state from its tasks: running before queued."""
    rank = F.when(F.col("state") == "running", 0).when(F.col("state") == "queued", 1)
    return tasks.where(rank.isNotNull()).groupBy("repo").agg(F.min_by("state", rank).alias("state"))


def activity(steps: DataFrame) -> DataFrame:
    """Each repository's steps, sorted, in one text."""
    return steps.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("step")), ",").alias("steps")).orderBy("repo")


def schedules(explicit: list[str], interval_seconds: int | None) -> list[str]:
    """Explicit schedules, else polling: an hour by default, none if negative."""
    if explicit:
        return explicit
    if interval_seconds is None or interval_seconds == 0:
        return [REPO_POLL]
    return [] if interval_seconds < 0 else [f"@every {interval_seconds}s"]


def prompt(repo: str = "", config: str = "", default: str = "", extras: list[str] = ()) -> str:
    """The repository's prompt before the configured and the default one, extras at the end."""
    return "\n\n".join([repo or config or default, *[x for x in extras if x.strip()]])
