"""Row numbers in a total order without a single task: places within sorted ranges, plus the rows of the ranges before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import shared_dir


def saved(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to shared storage and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "nth") -> DataFrame:
    """``df`` with a column that counts from 0 in ``order``; equal rows share out their numbers in any order."""
    ranged = saved(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted(map(tuple, ranged.groupBy(part.alias("_part")).count().collect()))  # a row for each sorted range
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _before long"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_part", part).join(offsets, "_part").withColumn(name, place).drop("_at", "_part", "_before")
