"""Small helpers shared by the operators: tables, Arrow batches, shared storage, label folds."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.batches import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded rows and bytes.

    Spark reads both when it plans the query, so they are left as they are set here.
    """
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder in the storage that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-checkpoint-")  # unset: a single machine, as in tests
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, f"{kind}-{uuid.uuid4().hex}")


def saved(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to shared storage and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a ``saved`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(posixpath.dirname(f))
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones at every run: those whose hashed key is smallest.

    A count comes first, so that about twice ``rows`` are sorted, not ``rows`` of every partition.
    """
    n = df.count()
    h = F.xxhash64(F.col(key), F.lit(17))
    if n > 4 * rows:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 2 * rows / n))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), h, key).limit(rows)
