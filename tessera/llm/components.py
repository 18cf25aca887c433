"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dropped, saved

#: Edges (16 bytes each) that one task takes; more are contracted by shuffles.
LOCAL_EDGES = 1 << 20


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` rows the smallest row reached over the pairs (and over equal ``label``, itself a row)."""
    lab = np.arange(n) if label is None else label.copy()
    while True:
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, lab[i], m)
        np.minimum.at(new, lab[j], m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if ends:
        u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
        node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        lab = smallest_reached(len(node), at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(node[lab], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b long).

    Up to ``local_edges`` edges are joined in one task, whose memory that bounds. Of more, each
    round hangs larger neighbours, then smaller ones, on the smallest neighbour, until nothing
    changes any more; nothing is collected, and every round is written to shared storage. A
    node's smallest neighbour is an aggregate, summed up before the shuffle, so a hub is not one
    task's; joins with it are plain equi-joins that adaptive execution splits. Null ends are
    ignored; equal edges count once. Empty table: no rows.
    """
    e = saved(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "cc")
    if e.count() <= local_edges:
        out = saved(arrow_map(e.coalesce(1), _in_one_task, "node long, component long"), "components")
        dropped(e)
        return out

    def mark(df: DataFrame) -> tuple:
        return df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()

    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = saved(small.where("u <> v").distinct(), "cc")
        now = mark(new)
        dropped(e)
        e = new
        if now == seen:
            break
        seen = now
    flat = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    out = saved(flat.unionByName(flat.select(F.col("component").alias("node"), "component").distinct()), "components")
    dropped(e)
    return out
