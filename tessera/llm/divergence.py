"""How sources differ within a language: smoothed term shares, compared pair by pair and term by term.

Terms that have the same counts in every source have the same shares everywhere, so each pair of
sources is evaluated once for a distinct sparse count vector and multiplied by the number of its
terms. What terms absent from both sources give is known from the totals alone, so a vector is
only evaluated for the pairs that hold one of its sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .common import arrow_map, saved

#: Bytes of a term: A-Z, a-z and all of 0x80 and above.
INSIDE = np.zeros(256, bool)
INSIDE[ord("A") : ord("Z") + 1] = INSIDE[ord("a") : ord("z") + 1] = True
INSIDE[0x80:] = True
#: Rows of counts that a task adds up before it passes them on, and passes on at once.
HELD, SENT = 800_000, 20_000
#: Sources in a band, and numbers in a task's sums.
BAND, CELLS = 256, 8_000_000
#: Parts that a language's table of sources is copied to, so that one language is not one join key.
SALTS = 32


def _row_terms(column: pa.Array, block: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, count) of every distinct term of every row."""
    rows, terms, counts = [np.zeros(0, np.int64)], [pa.array([], pa.large_binary())], [np.zeros(0, np.int64)]
    for row, start, end, raw in T.runs(column, INSIDE, block):
        if not len(row):
            continue
        offsets = np.zeros(len(row) + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        held = T.LOWER[raw[INSIDE[raw]]]
        coded = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        key, n = np.unique(row * len(coded.dictionary) + np.asarray(coded.indices), return_counts=True)
        rows.append(key // len(coded.dictionary))
        terms.append(coded.dictionary.take(pa.array(key % len(coded.dictionary))))
        counts.append(n)
    row, term, count = np.concatenate(rows), pa.concat_arrays(terms), np.concatenate(counts)
    if len(rows) > 2:  # a row in several blocks has its terms once in each
        coded = term.dictionary_encode()
        key, at = np.unique(row * max(1, len(coded.dictionary)) + np.asarray(coded.indices), return_inverse=True)
        count = np.bincount(at, count, len(key)).astype(np.int64)
        row, term = key // max(1, len(coded.dictionary)), coded.dictionary.take(pa.array(key % max(1, len(coded.dictionary))))
    return row, term, count


class _Held:
    """Counts of a task by (group, term): the groups are numbered as they come, terms are compared when parts are put together."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch, row: np.ndarray, term: pa.Array, n: np.ndarray) -> None:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        of_row = np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], np.int64)
        self.parts.append(self._summed([(of_row[row], term, n, np.ones(len(n), np.int64))]))

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    @staticmethod
    def _summed(parts: list) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        group, n, docs = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
        coded = pa.concat_arrays([p[1] for p in parts]).dictionary_encode()
        many = max(1, len(coded.dictionary))
        key = group * many + np.asarray(coded.indices)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(first):
            return group, pa.array([], pa.large_binary()), n, docs
        return key[first] // many, coded.dictionary.take(pa.array(key[first] % many)), np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [self._summed(self.parts)]

    def sent(self) -> Iterator[pa.RecordBatch]:
        """What is held, as batches; then nothing is."""
        self.merge()
        names = [pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1)]
        for group, term, n, docs in self.parts:
            for k in range(0, len(group), SENT):
                some = slice(k, k + SENT)
                at = pa.array(group[some])
                text = term[some].cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names[0].take(at), names[1].take(at), text, pa.array(n[some]), pa.array(docs[some])], names=["lang", "source", "term", "n", "docs"])
        self.parts = []


def _count(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            held.add(batch, *_row_terms(batch.column("text"), block))
            if len(held) > HELD:
                held.merge()
                if len(held) > HELD // 2:
                    yield from held.sent()
        yield from held.sent()

    return run


def term_counts(df: DataFrame, block: int = 4 * T.BLOCK) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    out = arrow_map(df.select("lang", "source", "text"), _count(block), "lang string, source string, term string, n long, docs long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(10**9 (count + 5) / (total + 5 terms)) in whole numbers of 64 bits, three digits at a time."""
    below = f"greatest({total} + 5 * {terms}, 1L)"  # 1 only where there are no terms, and then nothing is summed
    q, r = "0L", f"({count} + 5L)"
    for _ in range(3):
        q, r = f"({q} * 1000 + ({r} * 1000) div {below})", f"(({r} * 1000) % {below})"
    return f"(1 + {q})"


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over vectors of (|p_a - p_b| - the same for absent terms), for pairs that hold one of the vector's sources.

    A band of sources a is summed against all b. The pair (b, a) gets what a's rows give, and
    (a, b) too unless the vector holds b as well: then b's own row gives it.
    """
    sums: dict[tuple[str, int], list] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, band), (_, mine, both) in sums.items():
            for k in range(len(mine)):
                for value, swap in ((mine[k] - both[k], False), (mine[k], True)):
                    b = np.flatnonzero(value)
                    if len(b):
                        pair = [np.full(len(b), band * BAND + k), b]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), *(pa.array(x.astype(np.int32)) for x in (pair[::-1] if swap else pair)), pa.array(value[b])], names=["lang", "a", "b", "value"])
        sums.clear()

    for batch in batches:
        langs, bands = batch.column("lang").to_pylist(), batch.column("band").to_pylist()
        mult = batch.column("mult").to_numpy()
        for i, key in enumerate(zip(langs, bands, strict=True)):
            if key not in sums:
                base = np.asarray(batch.column("base")[i].values, np.int64)
                if sum(x[1].size for x in sums.values()) + BAND * len(base) > CELLS:
                    yield from sent()
                tall = min(BAND, len(base) - key[1] * BAND)
                sums[key] = [base, np.zeros((tall, len(base)), np.int64), np.zeros((tall, len(base)), np.int64)]
            base, mine, both = sums[key]
            at = np.asarray(batch.column("codes")[i].values, np.int64)
            p = base.copy()
            p[at] = np.asarray(batch.column("shares")[i].values, np.int64)
            for a in at[at // BAND == key[1]]:
                value = (np.abs(p[a] - p) - np.abs(base[a] - base)) * mult[i]
                mine[a - key[1] * BAND] += value
                both[a - key[1] * BAND, at] += value[at]
    yield from sent()


def audit(df: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """Every pair of sources of a language by the distance of their term shares, and each source's own terms.

    Null text, lang or source reads as ''. Repeated rows are documents of their own. A group
    without terms has shares of absent terms; a language without kept terms has distances of 0.
    Ties go by item. Extra columns are not carried. Empty table: no rows. A language's pairs are
    rows of the result, so its number of sources bounds a vector; texts, terms and vectors are
    only ever counted where they lie and added up by shuffles.

    Returns lang, source, part (`pair` or `term`), item, value, rank.
    """
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    vector = F.sort_array(F.collect_list(F.struct("source", "n")))  # an element for each source at most
    kept = saved(term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), vector.alias("vec")).where(F.col("docs") >= least_docs).select("lang", "term", "all", "vec"), "divergence")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    counts = kept.select("lang", "term", "all", F.explode("vec").alias("e")).select("lang", "term", "all", "e.*")
    of_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = saved(groups.withColumn("code", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "divergence-groups")

    # Each distinct vector meets its language's table of totals, in one of SALTS copies.
    tables = groups.where("terms > 0").groupBy("lang").agg(F.max("terms").alias("terms"), F.sort_array(F.collect_list(F.struct("code", "source", "total"))).alias("g"))
    tables = tables.select("lang", "terms", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    tables = tables.withColumn("base", F.expr(f"transform(totals, t -> {share('0L', 't', 'terms')})"))
    vectors = kept.groupBy("lang", "vec").agg(F.count("*").alias("mult")).withColumn("salt", F.pmod(F.xxhash64("vec"), F.lit(SALTS)).cast("int"))
    place = "array_position(sources, e.source)"
    vectors = vectors.join(tables, ["lang", "salt"]).select(
        "lang", "mult", "base", F.expr(f"transform(vec, e -> cast({place} - 1 as int))").alias("codes"), F.expr(f"transform(vec, e -> {share('e.n', f'element_at(totals, cast({place} as int))', 'terms')})").alias("shares")
    )
    vectors = vectors.withColumn("band", F.explode(F.array_distinct(F.expr(f"transform(codes, c -> cast(c div {BAND} as int))"))))
    sums = arrow_map(vectors, _differences, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))

    base = groups.withColumn("base", F.expr(share("0L", "total", "terms")))
    one = base.select("lang", "source", "terms", F.col("code").alias("a"), F.col("base").alias("p"))
    other = base.select("lang", F.col("source").alias("item"), F.col("code").alias("b"), F.col("base").alias("q"))
    pairs = one.join(other, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("terms") * F.abs(F.col("p") - F.col("q")) + F.coalesce("more", F.lit(0))).alias("value"))

    own = counts.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.expr(share("n", "total", "terms")) - F.expr(share("all", "lang_total", "terms"))).alias("value")).where("value > 0")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", ranked).unionByName(own.withColumn("rank", ranked).where(F.col("rank") <= top))
