"""Vector retrieval: exact cosine, document grouping, recency, overlap suppression, fusion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.batches import small_batches

RECENCY_FLOOR, HALF_LIFE_DAYS = 0.80, 730.0
FUSION_K, FUSION_DEPTH, FUSION_MOST = 20, 12, 40


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine in double precision; null for null, zero or other-sized vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    x = F.transform(v, lambda a: a.cast("double"))
    dot = F.aggregate(F.zip_with(x, q, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))
    size = sum(float(a) ** 2 for a in query) ** 0.5
    ok = (F.size(v) == len(query)) & (norm > 0) & F.lit(size > 0)
    return F.when(ok, dot / (norm * size))


def top_k(rows: DataFrame, query: list[float], k: int, tie: list[str], vector: str = "embedding") -> DataFrame:
    """The ``k`` most similar rows, with ``score``; filters belong before."""
    scored = rows.withColumn("score", F.round(cosine(F.col(vector), query), 6)).where("score is not null")
    return scored.orderBy(F.desc("score"), *tie).limit(k)


def doc_depth(configured: int, top_docs: int) -> int:
    """Chunks fetched for ``top_docs`` documents."""
    k = configured or 20
    return min(40, k if k >= top_docs else 4 * top_docs)


def candidate_depth(asked: int | None) -> int:
    return FUSION_DEPTH if not asked or asked <= 0 else min(FUSION_MOST, asked)


def recency(score: Column, updated: Column, now: Column) -> Column:
    """An unknown or future age leaves the score alone; else it falls towards 0.8 of it, half-way every 730 days."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / F.lit(86_400_000_000.0)
    aged = score * (RECENCY_FLOOR + (1 - RECENCY_FLOOR) * F.pow(F.lit(2.0), -days / HALF_LIFE_DAYS))
    return F.when(updated.isNotNull() & (days > 0), aged).otherwise(score)


def best_per_doc(hits: DataFrame, doc: list[str], tie: list[str]) -> DataFrame:
    """The best chunk of each document; ``score`` and columns of that chunk."""
    w = Window.partitionBy(*doc).orderBy(F.desc("score"), *tie)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def suppress_overlaps(hits: DataFrame, top: int, file: list[str] = ("repo", "path")) -> DataFrame:
    """Drops a hit whose line range covers half of the smaller range of a better hit kept in its file.

    Rows have rank, start_line, end_line (inclusive). Greedy within a file, in rank order, so
    it runs a file at a time; only hits come here, not the corpus.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        flags = []
        pdf = pdf.sort_values("rank", kind="stable")
        for s, e in zip(pdf.start_line, pdf.end_line, strict=True):
            clash = any((min(e, b) - max(s, a) + 1) * 2 >= min(e - s + 1, b - a + 1) for a, b in kept if min(e, b) >= max(s, a))
            flags.append(not clash)
            if not clash:
                kept.append((s, e))
        return pdf[flags]

    return hits.groupBy(*file).applyInPandas(keep, hits.schema).orderBy("rank").limit(top)


def fuse(arms: dict[str, DataFrame], doc: list[str], weights: dict[str, float] | None = None, k: int = FUSION_K) -> DataFrame:
    """Weighted reciprocal ranks of several rank lists (``rank`` from 0); ties by document.

    Adds ``score``, ``best_rank`` and ``best_arm`` (the better rank, on equal ranks the arm
    named first).
    """
    k = k if k > 0 else FUSION_K
    parts = []
    for nth, (name, df) in enumerate(arms.items()):
        w = (weights or {}).get(name, 1.0)
        w = w if w > 0 else 1.0
        parts.append(df.select(*doc, F.col("rank").cast("long").alias("rank"), F.lit(nth).alias("_nth"), F.lit(name).alias("_arm"), (F.lit(w) / (F.lit(k) + F.col("rank") + 1)).alias("_w")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = F.min(F.struct("rank", "_nth", "_arm")).alias("_b")
    out = rows.groupBy(*doc).agg(F.round(F.sum("_w"), 9).alias("score"), best)
    return out.select(*doc, "score", F.col("_b.rank").alias("best_rank"), F.col("_b._arm").alias("best_arm")).orderBy(F.desc("score"), *doc)


def ranked(df: DataFrame, order: list, depth: int) -> DataFrame:
    """The first ``depth`` rows with their ``rank`` from 0 (a bounded list, numbered in one task)."""
    top = df.orderBy(*order).limit(depth)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def embed(df: DataFrame, text: str, fn, size: int, out: str = "vector") -> DataFrame:
    """Vectors of texts by ``fn(list of texts) -> list of lists``, in Arrow batches; counts must agree."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got = fn(s.fillna("").tolist())
            if len(got) != len(s) or any(len(v) != size for v in got):
                raise ValueError("the embedder returned another number or size of vectors")
            yield pd.Series([[float(x) for x in v] for v in got])

    return df.withColumn(out, run(F.col(text)))


def hash_embedder(size: int = 64):
    """A deterministic embedder for tests: signed hashes of words."""

    def fn(texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return fn
