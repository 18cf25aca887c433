"""Vectors by content: a text that was embedded once is never sent to the embedder again.

Vectors are kept in a keyed table by the hash of their text. A build asks only for hashes that
the table lacks, in batches; a batch that the embedder refuses is tried again row by row, and
a text that fails by itself is a row with its error, which the next build tries anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.batches import small_batches
from tessera.functions.text import content_hash
from tessera.operators.order import saved
from tessera.operators.tables import KeyedTable

#: Texts sent to the embedder together.
BATCH = 64


class EmbeddingCache:
    """hash -> vector of ``size`` numbers, for one embedder."""

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[list[str]], list[list[float]]], size: int, buckets: int = 16, batch: int = BATCH):
        self.embedder, self.size, self.batch = embedder, size, batch
        self.table = KeyedTable(spark, root, "hash string, vector array<float>", ["hash"], buckets)

    def embed(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with ``hash``, ``vector`` and ``error``; null text is an empty one.

        Rows of one text share a hash and are sent once. Vectors of another length than
        ``size``, or another number of them than texts, count as a failure.
        """
        keyed = saved(rows.withColumn("hash", content_hash(F.coalesce(F.col(text), F.lit("")))), "to-embed")
        wanted = keyed.groupBy("hash").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"))
        known = self.table.lookup(keyed.select("hash")) if self.table.version().number else self.table.empty
        fresh = saved(_sent(wanted.join(known.select("hash"), "hash", "left_anti"), self.embedder, self.size, self.batch), "embedded")
        good = fresh.where("error is null").select("hash", "vector")
        if not good.isEmpty():
            self.table.merge(good)
        found = self.table.lookup(keyed.select("hash")).select("hash", "vector")
        return keyed.join(found, "hash", "left").join(fresh.where("error is not null").select("hash", "error"), "hash", "left").select(*keyed.columns, "vector", "error")

    def forget(self, kept: DataFrame) -> None:
        """Drop vectors of hashes that ``kept`` does not hold."""
        self.table.replace(self.table.read().join(kept.select("hash").distinct(), "hash", "left_semi"))


def _sent(texts: DataFrame, embedder, size: int, batch: int) -> DataFrame:
    def checked(some: list[str]) -> list[list[float]]:
        got = embedder(some)
        if len(got) != len(some) or any(len(v) != size for v in got):
            raise ValueError("the embedder returned another number or size of vectors")
        return [[float(x) for x in v] for v in got]

    def one(x: str) -> tuple[list[float] | None, str | None]:
        try:
            return checked([x])[0], None
        except Exception as e:  # this text alone is lost, its batch is not
            return None, str(e) or type(e).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[list[float] | None, str | None]] = []
            every = frame["text"].tolist()
            for k in range(0, len(every), batch):
                some = every[k : k + batch]
                try:
                    out += [(v, None) for v in checked(some)]
                except Exception:
                    out += map(one, some)
            yield pd.DataFrame({"hash": frame["hash"], "vector": [v for v, _ in out], "error": [e for _, e in out]})

    small_batches(texts.sparkSession)
    return texts.select("hash", "text").mapInPandas(run, "hash string, vector array<float>, error string")
