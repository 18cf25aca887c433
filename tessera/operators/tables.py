"""Versioned tables in shared storage: whole versions to readers, and merges that follow the batch.

A version is one small manifest file that names the folders of Parquet it is made of. It is
published by a move to the next free number, which never replaces a file: a reader that has
opened a version keeps reading the same folders while others are published, after a restart
the highest number is the current version, and a writer that lost the race is told so.

``KeyedTable`` deals rows out to buckets by a hash of their key. A merge reads and writes the
buckets that its keys fall into and takes all others over by name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import Store

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Version:
    """One published state: its number and what it says."""

    number: int
    says: dict = field(default_factory=dict)


class Manifests:
    """Numbered manifests under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.store.names("manifests") if n.endswith(".json")]

    def current(self) -> Version:
        """The last published version; 0, which says nothing, before the first."""
        n = max(self.numbers(), default=0)
        return self.at(n) if n else Version(0)

    def at(self, number: int) -> Version:
        return Version(number, json.loads(self.store.read(f"manifests/{number:012d}.json")))

    def publish(self, before: Version, says: dict) -> Version:
        """The version after ``before``; ``Conflict`` if another was published since."""
        number = before.number + 1
        if not self.store.write_new(f"manifests/{number:012d}.json", json.dumps(says, sort_keys=True)):
            raise Conflict(f"version {number} of {self.root} is there already")
        return Version(number, says)

    def update(self, change: Callable[[Version], dict | None], tries: int = 5) -> Version:
        """Publish what ``change`` makes of the current version, again from the newer one after a conflict; None leaves it."""
        for k in range(tries):
            before = self.current()
            says = change(before)
            if says is None:
                return before
            try:
                return self.publish(before, says)
            except Conflict:
                if k == tries - 1:
                    raise
        raise ValueError("no tries")

    def expire(self, keep: int, folders: Callable[[dict], set[str]]) -> list[int]:
        """Drop all but the last ``keep`` versions, and the data folders that only they name."""
        numbers = sorted(self.numbers())
        old, kept = numbers[: -max(1, keep)], numbers[-max(1, keep) :]
        held = set().union(*(folders(self.at(n).says) for n in kept)) if kept else set()
        gone = set().union(*(folders(self.at(n).says) for n in old)) - held if old else set()
        for n in old:
            self.store.delete(f"manifests/{n:012d}.json")
        for f in sorted(gone):
            self.store.delete(f)
        return old


class KeyedTable:
    """Rows with a unique key, in ``buckets`` folders by the key's hash.

    ``buckets`` is fixed with the first version: about the table's size over 128 MB.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.empty = spark.createDataFrame([], schema)
        self.manifests = Manifests(spark, root)

    @property
    def schema(self):
        return self.empty.schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def version(self, number: int | None = None) -> Version:
        return self.manifests.current() if number is None else self.manifests.at(number)

    def read(self, version: Version | int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Rows of one version, the current one unless it is given; of some buckets only if they are."""
        v = version if isinstance(version, Version) else self.version(version)
        parts = v.says.get("parts", {})
        paths = [f"{self.root}/{p}" for b, p in sorted(parts.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.empty

    def lookup(self, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        keys = keys.select(*self.key).distinct()
        touched = {r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most ``buckets``
        return self.read(version or self.version(), touched).join(keys, self.key, "left_semi")

    def _write(self, rows: DataFrame, name: str) -> dict[str, str]:
        """Write rows by bucket to a new folder; bucket -> folder."""
        folder = f"data/{name}"
        rows.withColumn(BUCKET, self.bucket()).repartition(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        found = [n for n in self.manifests.store.names(folder) if n.startswith(f"{BUCKET}=")]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found}

    def replace(self, rows: DataFrame, tag: str = "") -> Version:
        """All rows anew."""
        parts = self._write(rows.select(self.empty.columns), uuid.uuid4().hex)
        return self.manifests.update(lambda _: {"parts": parts, "tag": tag})

    def merge(self, rows: DataFrame | None = None, gone: DataFrame | None = None, tag: str = "", fold: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Version:
        """Insert or replace ``rows`` by key, delete the keys of ``gone``; a key in both is inserted.

        ``fold(stored, new)`` makes the new rows from the stored ones of the touched buckets
        instead, for tables that add up. The batch is read more than once: give a table, not a
        feed. With a ``tag`` that the current version carries the merge is done already, so a
        batch that runs again changes nothing.
        """
        rows = (self.empty if rows is None else rows).select(self.empty.columns)
        keys = rows.select(*self.key) if gone is None else rows.select(*self.key).unionByName(gone.select(*self.key))
        touched = {r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()}

        def change(before: Version) -> dict | None:
            if tag and before.says.get("tag") == tag:
                return None
            if not touched:
                return None if not tag else {"parts": before.says.get("parts", {}), "tag": tag}
            stored = self.read(before, touched)
            if fold is not None:
                merged = fold(stored, rows)
                if gone is not None:
                    merged = merged.join(gone.select(*self.key).distinct(), self.key, "left_anti")
            else:
                merged = stored.join(keys.distinct(), self.key, "left_anti").unionByName(rows)
            parts = {b: p for b, p in before.says.get("parts", {}).items() if int(b) not in touched}
            return {"parts": parts | self._write(merged.select(self.empty.columns), uuid.uuid4().hex), "tag": tag}

        return self.manifests.update(change)

    def expire(self, keep: int = 2) -> list[int]:
        """Drop versions before the last ``keep``; readers that are pinned to them must be done."""
        return self.manifests.expire(keep, lambda says: set(says.get("parts", {}).values()))
