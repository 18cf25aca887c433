"""A stored inverted index: postings by term, in segments that only ever get added.

A segment holds the rows of one update: postings in folders by a hash of the term and sorted
by it, the rows themselves in folders by a hash of the id, and a line of statistics. Postings
come in blocks, a term's rows of one batch as arrays side by side ``(ids, dl, tf, start, pos)``,
so words that many rows share cost a few bytes a row, and only phrases read positions. Replaced or deleted rows get a tombstone; it counts for older segments
only. Term counts are kept as changes: a segment adds its own, a tombstone takes away those of
the rows it covers. So a search reads the folders of its words and nothing else, and statistics
never read the corpus. A reader is pinned to the version that it opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.batches import small_batches
from tessera.functions.text import tokens
from tessera.operators.lexical import FREQUENT_CAP, FREQUENT_RATIO, K1, B, Atom, Query
from tessera.operators.tables import BUCKET, Manifests, Version

#: Parts that the postings of one folder are dealt to by row, so that a common word is not one task's.
SALTS = 4
#: Segments beyond which an update puts all of them together.
MOST_SEGMENTS = 8
#: What a search is bounded to: a condition on the scope columns, or a function that keeps rows by them (a semi-join, say).
Scope = Column | Callable[[DataFrame], DataFrame] | None


def _bounded(df: DataFrame, scope: Scope) -> DataFrame:
    if scope is None:
        return df
    return df.where(scope) if isinstance(scope, Column) else scope(df)


class LexicalIndex:
    """Rows with an ``id``, a ``text`` and other ``columns``; those of ``scope`` can be filtered by in a search."""

    def __init__(self, spark: SparkSession, root: str, columns: str = "", scope: tuple[str, ...] = (), id_type: str = "string", buckets: int = 16):
        self.spark, self.root, self.scope, self.buckets = spark, root.rstrip("/"), tuple(scope), buckets
        self.rows = spark.createDataFrame([], f"id {id_type}, text string" + (f", {columns}" if columns else ""))
        self.manifests = Manifests(spark, root)
        kept = [f"{f.name} array<{f.dataType.simpleString()}>" for f in self.rows.schema if f.name in self.scope]
        self._blocks = ", ".join(["term string", f"ids array<{id_type}>", "dl array<int>", "tf array<int>", "start array<int>", "pos array<int>", *kept])
        self._postings = f"{self._blocks}, {BUCKET} int"
        self._docs = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in self.rows.schema), "dl int", f"{BUCKET} int"])

    # --- building ---------------------------------------------------------------------------

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _segment(self, rows: DataFrame) -> dict:
        """Write the rows' postings, the rows and their term counts; the segment's line of the manifest."""
        name = f"segments/{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        docs = rows.select(self.rows.columns).withColumn("dl", F.size(tokens(F.col("text"))))
        docs.withColumn(BUCKET, self._bucket("id")).repartition(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{at}/docs")
        read = self._read_docs(name).select("id", "dl", *self.scope, tokens(F.col("text")).alias("tok"))
        salt = F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(SALTS))
        small_batches(self.spark)
        post = read.mapInArrow(_inverted(self.scope), self._blocks).withColumn(BUCKET, self._bucket("term")).repartition(self.buckets * SALTS, BUCKET, salt)
        post.sortWithinPartitions(BUCKET, "term").write.partitionBy(BUCKET).parquet(f"{at}/postings")
        self._read_postings(name).groupBy("term").agg(F.sum(F.size("tf")).alias("df")).write.parquet(f"{at}/terms")
        total = self._read_docs(name).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return {"name": name, "docs": total.n, "length": total.length}

    def rebuild(self, rows: DataFrame) -> Version:
        """The index of these rows and no others."""
        seg = self._segment(rows)

        def change(before: Version) -> dict:
            return {"segments": [seg | {"seq": before.number + 1}], "tombs": []}

        return self.manifests.update(change)

    def update(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> Version:
        """Insert or replace rows by id, and delete the ids of ``gone``; reads only folders that hold those ids."""
        rows = self.rows if rows is None else rows
        ids = rows.select("id") if gone is None else rows.select("id").unionByName(gone.select("id"))
        seg = None if rows.isEmpty() else self._segment(rows)

        def change(before: Version) -> dict | None:
            seq, says = before.number + 1, before.says or {"segments": [], "tombs": []}
            dead = self._tombs(before, ids)
            if dead is None and seg is None:
                return None
            return {
                "segments": says["segments"] + ([seg | {"seq": seq}] if seg else []),
                "tombs": says["tombs"] + ([dead | {"seq": seq}] if dead else []),
            }

        version = self.manifests.update(change)
        return self.compact() if len(version.says.get("segments", [])) > MOST_SEGMENTS else version

    def _tombs(self, version: Version, ids: DataFrame) -> dict | None:
        """Tombstones of those of the ids that are there, with the term counts to take away."""
        if not version.says.get("segments"):
            return None
        ids = ids.distinct()
        touched = [r[0] for r in ids.select(self._bucket("id")).distinct().collect()]  # at most ``buckets``
        found = self.documents(version, F.col(BUCKET).isin(touched)).join(ids, "id", "left_semi")
        name = f"tombs/{uuid.uuid4().hex}"
        found.select("id", "dl").write.parquet(f"{self.root}/{name}/ids")
        old = self.spark.read.parquet(f"{self.root}/{name}/ids")
        total = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        if not total.n:
            return None
        less = found.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        less.write.parquet(f"{self.root}/{name}/terms")
        return {"name": name, "docs": total.n, "length": total.length}

    def compact(self) -> Version:
        """All segments as one, without what tombstones cover."""

        def change(before: Version) -> dict | None:
            if len(before.says.get("segments", [])) < 2 and not before.says.get("tombs"):
                return None
            seg = self._segment(self.documents(before))
            return {"segments": [seg | {"seq": before.number + 1}], "tombs": []}

        return self.manifests.update(change)

    def expire(self, keep: int = 2) -> list[int]:
        """Drop versions before the last ``keep``, and the segments that only they name."""
        return self.manifests.expire(keep, lambda says: {x["name"] for k in ("segments", "tombs") for x in says.get(k, [])})

    # --- reading ----------------------------------------------------------------------------

    def _read_postings(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._postings).parquet(f"{self.root}/{name}/postings")

    def _read_docs(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._docs).parquet(f"{self.root}/{name}/docs")

    def _alive(self, version: Version, read) -> DataFrame | None:
        """Rows of all segments, each without the ids of later tombstones; None without segments."""
        parts = []
        for s in version.says.get("segments", []):
            df = read(s["name"])
            later = [f"{self.root}/{t['name']}/ids" for t in version.says["tombs"] if t["seq"] > s["seq"]]
            parts.append(df.join(self.spark.read.parquet(*later).select("id"), "id", "left_anti") if later else df)
        return reduce(DataFrame.unionByName, parts) if parts else None

    def documents(self, version: Version | None = None, where: Scope = None) -> DataFrame:
        """The stored rows, with their number of tokens ``dl``."""

        def read(name: str) -> DataFrame:
            return _bounded(self._read_docs(name), where)

        df = self._alive(version or self.manifests.current(), read)
        return self.spark.createDataFrame([], self._docs).drop(BUCKET) if df is None else df.drop(BUCKET)

    def totals(self, version: Version | None = None, scope: Scope = None) -> tuple[int, int]:
        """(rows, tokens), from the manifest alone; of a scope from the rows' lengths."""
        v = version or self.manifests.current()
        if scope is not None:
            r = self.documents(v, scope).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("l")).first()
            return r.n, r.l
        sums = [sum(x[k] for x in v.says.get("segments", [])) - sum(x[k] for x in v.says.get("tombs", [])) for k in ("docs", "length")]
        return sums[0], sums[1]

    def term_counts(self, version: Version | None = None, words: list[str] | None = None) -> DataFrame:
        """(term, df) of the rows that are there, from the kept changes."""
        v = version or self.manifests.current()
        paths = [f"{self.root}/{x['name']}/terms" for k in ("segments", "tombs") for x in v.says.get(k, [])]
        if not paths:
            return self.spark.createDataFrame([], "term string, df long")
        df = self.spark.read.schema("term string, df long").parquet(*paths)
        df = df if words is None else df.where(F.col("term").isin(*words))
        return df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def frequent_terms(self, version: Version | None = None, ratio: float = FREQUENT_RATIO, cap: int = FREQUENT_CAP) -> DataFrame:
        """Terms in at least ``ratio`` of all rows, by frequency; the counts are exact."""
        v = version or self.manifests.current()
        need = max(1, int(ratio * self.totals(v)[0]))
        return self.term_counts(v).where(F.col("df") >= need).orderBy(F.desc("df"), "term").limit(cap)

    def stop_words(self, always: frozenset[str] = frozenset(), version: Version | None = None) -> frozenset[str]:
        """Words that a question's prose is searched without: the given ones and the corpus's frequent ones."""
        return always | {r.term for r in self.frequent_terms(version).collect()}

    # --- searching --------------------------------------------------------------------------

    def _matching(self, version: Version, words: list[str], prefixes: list[str], scope: Scope, places: bool = False) -> DataFrame | None:
        """Postings of words (their folders only) and of prefixes (their ranges of each folder), a row each; with ``pos`` on demand."""
        folders = sorted({r.b for r in self.spark.createDataFrame([(w,) for w in words], "term string").select(self._bucket("term").alias("b")).collect()}) if words else []

        def read(name: str) -> DataFrame:
            post = self._read_postings(name)
            some = [post.where(F.col(BUCKET).isin(*folders) & F.col("term").isin(*words))] if words else []
            for k, p in enumerate(prefixes):
                more = post.where(F.startswith("term", F.lit(p)))
                for q in prefixes[:k]:
                    more = more.where(~F.startswith("term", F.lit(q)))
                some.append(more.where(~F.col("term").isin(*words)) if words else more)
            side = F.arrays_zip("ids", "dl", "tf", "start", *self.scope)
            if places:  # cut before rows are made of the block: none carries the places of all
                side = F.transform(side, lambda p: F.struct(*[p[c].alias(c) for c in ("ids", "dl", "tf", *self.scope)], F.slice("pos", p["start"] + 1, p["tf"]).alias("pos")))
            each = reduce(DataFrame.unionByName, some).select("term", F.explode(side).alias("p"))
            return _bounded(each.select("term", F.col("p.ids").alias("id"), "p.dl", "p.tf", *[f"p.{c}" for c in self.scope], *(["p.pos"] if places else [])), scope)

        return self._alive(version, read)

    def search(self, query: Query, scope: Scope = None, version: Version | None = None) -> DataFrame:
        """(id, scope columns, score) of rows that satisfy the query, by BM25 over the rows of the scope.

        The same scores as ``lexical.matches`` over the stored rows. Nothing indexed, or no
        positive clause: no rows.
        """
        v = version or self.manifests.current()
        every = list(dict.fromkeys([*query.atoms, *query.without]))
        words = sorted({w for a in every for w in (a.words[:-1] if a.prefix else a.words)})
        prefixes = sorted({a.words[-1] for a in every if a.prefix})
        post = self._matching(v, words, prefixes, scope, any(len(a.words) > 1 for a in every)) if query.atoms else None
        if post is None:
            return self.rows.select("id", *self.scope).withColumn("score", F.lit(0.0))
        name = {a: f"_tf{k}" for k, a in enumerate(every)}
        rows = post.groupBy("id", "dl", *self.scope).agg(*[_frequency(a).alias(c) for a, c in name.items()])
        n, length = self.totals(v, scope)
        if scope is None and all(len(a.words) == 1 and not a.prefix for a in query.atoms):
            df = {r.term: r.df for r in self.term_counts(v, [a.words[0] for a in query.atoms]).collect()}
            found = {a: df.get(a.words[0], 0) for a in query.atoms}
        else:
            got = rows.agg(*[F.coalesce(F.sum((F.col(name[a]) > 0).cast("long")), F.lit(0)).alias(name[a]) for a in query.atoms]).first()
            found = {a: got[name[a]] for a in query.atoms}
        mean = length / n if length else 1.0
        score, ok = F.lit(0.0), F.lit(True)
        for a in query.atoms:
            x, idf = F.col(name[a]), F.log(F.lit(1 + (n - found[a] + 0.5) / (found[a] + 0.5)))
            score = score + idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("dl") / mean))
        for group in query.groups:
            ok = ok & reduce(lambda a, b: a | b, [F.col(name[a]) > 0 for a in group])
        for a in query.without:
            ok = ok & (F.col(name[a]) == 0)
        return rows.where(ok).select("id", *self.scope, score.alias("score"))

    def with_rows(self, hits: DataFrame, version: Version | None = None) -> DataFrame:
        """The stored rows of a few hits, read from the folders of their ids."""
        v = version or self.manifests.current()
        touched = [r[0] for r in hits.select(self._bucket("id")).distinct().collect()]  # at most ``buckets``
        return hits.join(self.documents(v, F.col(BUCKET).isin(touched)).drop("dl", *self.scope), "id")


def _inverted(scope: tuple[str, ...]):
    """Batches of rows with their tokens as blocks of postings: tokens sorted by term, then row, then place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tok")
            size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            flat = lists.flatten()
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            row = np.repeat(np.arange(len(batch)), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            code = np.asarray(coded.indices)
            order = np.argsort(code, kind="stable")
            code, row, place = code[order], row[order], place[order].astype(np.int32)
            first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))  # of each posting
            tf = np.diff(first, append=len(code)).astype(np.int32)
            head = np.flatnonzero(np.diff(code[first], prepend=-1))  # of each term, among postings
            many = np.diff(head, append=len(first))
            start = (first - np.repeat(first[head], many)).astype(np.int32)
            lines = pa.array(np.append(head, len(first)), pa.int32())
            at = pa.array(row[first])

            def block(values: pa.Array, offsets: pa.Array = lines) -> pa.Array:
                return pa.ListArray.from_arrays(offsets, values)

            pos = block(pa.array(place), pa.array(np.append(first[head], len(code)), pa.int32()))
            cols = [coded.dictionary.take(pa.array(code[first][head])), block(batch.column("id").take(at)), block(batch.column("dl").take(at)), block(pa.array(tf)), block(pa.array(start)), pos]
            cols += [block(batch.column(c).take(at)) for c in scope]
            yield pa.RecordBatch.from_arrays(cols, names=["term", "ids", "dl", "tf", "start", "pos", *scope])

    return run


def _frequency(a: Atom) -> Column:
    """How often the atom stands in a row, from the row's postings."""
    last = F.startswith("term", F.lit(a.words[-1])) if a.prefix else F.col("term") == a.words[-1]
    if len(a.words) == 1:
        return F.coalesce(F.sum(F.when(last, F.col("tf"))), F.lit(0))
    at = [F.max(F.when(F.col("term") == w, F.col("pos"))) for w in a.words[:-1]]
    at.append(F.flatten(F.collect_list(F.when(last, F.col("pos")))))
    return F.size(reduce(F.array_intersect, [_shifted(p, k) for k, p in enumerate(at)]))


def _shifted(positions: Column, by: int) -> Column:
    """Where a phrase begins whose word number ``by`` stands at the positions; null: nowhere."""
    return F.transform(F.coalesce(positions, F.array().cast("array<int>")), lambda x: x - by)
