"""Importance resampling towards a target: hashed word and word-pair features by a byte automaton.

A lookup table puts every byte of an Arrow UTF-8 buffer into a class, words begin and end where
the class changes, and CRC-32 registers of all words (then of all pairs) advance together, one
byte a step through the CRC's table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import text as T
from .common import arrow_map, saved

#: Bytes of a word: 0-9, A-Z, a-z and all of 0x80 and above.
INSIDE = np.zeros(256, bool)
INSIDE[ord("0") : ord("9") + 1] = INSIDE[ord("A") : ord("Z") + 1] = INSIDE[ord("a") : ord("z") + 1] = True
INSIDE[0x80:] = True
#: Words longer than this many bytes go on through zlib, one at a time.
LONG = 64
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    reg = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        reg = np.where(reg & 1, (reg >> np.uint32(1)) ^ np.uint32(0xEDB88320), reg >> np.uint32(1))
    return reg


CRC = _crc_table()


def advance(reg: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers after ``data[start : start + size]`` of each, all at once, byte by byte."""
    order = np.argsort(-size, kind="stable")
    out, at, n = reg[order], start[order], size[order]
    most = min(int(n[0]), LONG) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(1, most + 1), side="right")  # how many have a byte left
    for k, m in enumerate(live.tolist()):
        r = out[:m]
        out[:m] = CRC[(r ^ data[at[:m] + k]) & np.uint32(255)] ^ (r >> np.uint32(8))
    for i in range(int(np.searchsorted(-n, -LONG, side="left"))):
        rest = data[at[i] + LONG : at[i] + n[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i] ^ _ONES)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(column: pa.Array, buckets: int, block: int = T.BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (rows of words, rows of features, buckets of features).

    A row's last word is carried into its next block, so pairs across a block's end count too.
    """
    held_row, held = -1, b""
    for row, start, end, raw in T.runs(column, INSIDE, block):
        if not len(row):
            continue
        new = np.ones(len(row), bool)
        data = T.LOWER[raw]
        if row[0] == held_row:
            data = np.concatenate([np.frombuffer(held + b" ", np.uint8), data])
            start, end = (np.append(first, x + len(held) + 1) for first, x in ((0, start), (len(held), end)))
            row, new = np.append(held_row, row), np.append(False, new)
        size = end - start
        one = advance(np.full(len(row), _ONES), data, start, size)
        pair = np.flatnonzero(row[1:] == row[:-1])
        reg = one[pair]
        reg = CRC[(reg ^ np.uint32(0x20)) & np.uint32(255)] ^ (reg >> np.uint32(8))
        two = advance(reg, data, start[pair + 1], size[pair + 1])
        codes = np.concatenate([one[new], two]) ^ _ONES
        yield row[new], np.concatenate([row[new], row[pair]]), (codes % np.uint32(buckets)).astype(np.int64)
        held_row, held = int(row[-1]), data[start[-1] : end[-1]].tobytes()


def bucket_counts(df: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all features of all texts; a task sends its counts once, when it is done."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, code in features(batch.column(0), buckets):
                total += np.bincount(code, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return arrow_map(df.select(F.col("text").cast("string")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket; ``buckets`` numbers in all."""
    s, t = (bucket_counts(df, buckets).withColumnRenamed("n", name) for df, name in ((source, "s"), (target, "t")))
    n = s.join(t, "bucket", "full").na.fill(0, ["s", "t"]).collect()  # at most ``buckets`` rows
    of_s, of_t = np.zeros(buckets), np.zeros(buckets)
    for r in n:
        of_s[r.bucket], of_t[r.bucket] = r.s, r.t
    all_s, all_t = of_s.sum() + buckets, of_t.sum() + buckets
    return np.floor(1000 * np.log((of_t + 1) * all_s / ((of_s + 1) * all_t))).astype(np.int64)


def weights(df: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean of its features' gains; 0 without any)."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            words, many, total = (np.zeros(n, np.int64) for _ in range(3))
            for w, row, code in features(batch.column("text"), len(gain)):
                lo = int(w[0]) if len(w) else 0
                for out, at, by in ((words, w, None), (many, row, None), (total, row, gain[code])):
                    part = np.bincount(at - lo, by).astype(np.int64)
                    out[lo : lo + len(part)] += part
            mean = np.floor_divide(total, np.maximum(many, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, many, mean))], names=["doc_id", "n_words", "n_features", "weight"])

    return arrow_map(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Draw ``percent`` of the documents of ``least_words`` words or more, likelier the closer to ``target``.

    Gumbel noise from a hash of the seed and doc_id makes the highest scores a draw without
    replacement. Ranks are places within sorted ranges plus the sizes of the ranges before, so
    no task sees all rows. Null text: no words, weight 0, never drawn. Null doc_id: hashed as ''
    and last among ties. Repeated rows: each is a document; equal rows share out their ranks in
    any order. Extra columns are not carried. Empty table: no rows; empty target: all counts 0.

    Returns doc_id, n_features, weight, score, rank (null if not drawn).
    """
    spark = df.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = saved(weights(df, gains(df, target, buckets)).withColumn("score", F.col("weight") + noise), "importance")
    fit = F.col("n_words") >= least_words
    draw = scored.where(fit).count() * percent // 100
    order = (fit.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ordered = saved(scored.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("at", 33).cast("int")
    sizes = sorted(map(tuple, ordered.groupBy(part.alias("part")).count().collect()))  # a row for each sorted range
    before = np.cumsum([0, *(n for _, n in sizes)])
    schema = ST.StructType([ST.StructField("part", ST.IntegerType()), ST.StructField("before", ST.LongType())])
    offsets = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before, strict=False)], schema)
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ordered.withColumn("part", part).join(F.broadcast(offsets), "part").select("doc_id", "n_features", "weight", "score", F.when(fit & (rank <= draw), rank).alias("rank"))
