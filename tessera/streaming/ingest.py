"""Change feeds as streams: idempotent upserts into a versioned table, watermarks, and progress while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.streaming.listener import StreamingQueryListener

from tessera.operators.tables import KeyedTable
from tessera.storage import shared_dir


def latest_table(stream: DataFrame, key: str, order: list[str], root: str, buckets: int = 16) -> KeyedTable:
    """The table that ``latest_by_key`` keeps: key, n, and the last row as a struct."""
    value = [c for c in stream.columns if c != key and c not in order]
    last = stream.select(F.struct(*order, *value).alias("x")).schema["x"].dataType.simpleString()
    return KeyedTable(stream.sparkSession, root, f"{key} {stream.schema[key].dataType.simpleString()}, n long, last {last}", [key], buckets)


def latest_by_key(stream: DataFrame, key: str, order: list[str], kind: str = "latest", buckets: int = 16, root: str | None = None, log: str | None = None) -> DataFrame:
    """Run a stream to its end: each key's last row by ``order``, and how many rows it had.

    Every batch is reduced to one row a key before it meets the state, and rewrites the buckets
    of its own keys only. The version that a batch leaves carries the batch's number, so a batch
    that is run again changes nothing. With ``root`` and ``log`` a later run goes on from there.
    """
    spark = stream.sparkSession
    value = [c for c in stream.columns if c != key and c not in order]
    table = latest_table(stream, key, order, root or shared_dir(spark, kind), buckets)

    def fold(stored: DataFrame, new: DataFrame) -> DataFrame:
        return stored.unionByName(new).groupBy(key).agg(F.sum("n").cast("long").alias("n"), F.max("last").alias("last"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(key, F.struct(*order, *value).alias("last"))
        new = rows.groupBy(key).agg(F.count("*").alias("n"), F.max("last").alias("last"))
        path = shared_dir(spark, f"{kind}-batch")  # the merge reads it twice
        new.write.parquet(path)
        table.merge(spark.read.schema(new.schema).parquet(path), tag=f"batch {batch_id}", fold=fold)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", log or shared_dir(spark, f"{kind}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read().select(key, "n", "last.*")


def file_stream(spark: SparkSession, folder: str, name: str, schema, max_files: int = 16) -> DataFrame:
    """A Parquet table, file or folder, as a stream."""
    reader: DataStreamReader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def windowed_counts(stream: DataFrame, ts: str, key: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; rows later than ``late`` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), key).agg(F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Rows done so far of a stream that ``observed`` counts, reported as each batch ends while the build goes on."""

    METRIC = "tessera_progress"

    def __init__(self, report: Callable[[int, int], None], total: int):
        self.report, self.total, self.done = report, total, 0

    @classmethod
    def observed(cls, stream: DataFrame) -> DataFrame:
        """The stream with its rows counted as they pass."""
        return stream.observe(cls.METRIC, F.count(F.lit(1)).alias("rows"))

    def onQueryStarted(self, event) -> None:
        self.report(self.done, self.total)

    def onQueryProgress(self, event) -> None:
        seen = (event.progress.observedMetrics or {}).get(self.METRIC)
        if seen is not None and seen["rows"]:
            self.done += seen["rows"]
            self.report(self.done, self.total)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def build_with_progress(stream: DataFrame, total: int, step: Callable[[DataFrame, int], None], report: Callable[[int, int], None], log: str | None = None) -> int:
    """Run ``step(batch, number)`` over a stream to its end; ``report(done, total)`` at the start and after every batch.

    ``total`` comes from a count pass. What a step has read of its batch counts once: a step
    that reads the batch again would be seen again, so each batch is written down first.
    Returns the rows done; a run that goes on from ``log`` counts what is left.
    """
    spark = stream.sparkSession
    listener = Progress(report, total)

    def run(batch: DataFrame, number: int) -> None:
        path = shared_dir(spark, "batch")
        batch.write.parquet(path)
        step(spark.read.schema(batch.schema).parquet(path), number)

    spark.streams.addListener(listener)
    try:
        query = Progress.observed(stream).writeStream.foreachBatch(run).option("checkpointLocation", log or shared_dir(spark, "build-log")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return listener.done
