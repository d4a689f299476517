"""Incremental forms: deduplication, latest-wins upserts, windows over event streams.

Every stream reads files and stops when it has taken what is there (availableNow),
so the same code runs as a catch-up job or, with another trigger, for ever.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import fresh_path, versions


def latest(d: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return d.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def current_votes(events: DataFrame, keys: list[str], action: str, ts: str, tie: str) -> DataFrame:
    """Each key's present vote: a later vote replaces an earlier one."""
    return events.groupBy(*keys).agg(F.max_by(action, F.struct(ts, tie)).alias("vote"))


def retained(events: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows without a date, or at most so many days older than the newest."""
    newest = F.broadcast(events.agg(F.max(ts).alias("newest_")))
    return events.crossJoin(newest).where(F.col(ts).isNull() | (F.date_diff("newest_", ts) <= days)).drop("newest_")


def event_stream(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A stream over a Parquet file, or the files of a folder, its event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        files = spark.readStream.schema(schema).parquet(path)
    else:
        folder, _, name = path.rstrip("/").rpartition("/")
        files = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return files.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """What a stream appends until its input is used up, from Parquet files.

    With a path of the caller's, a later run goes on from the offsets of the one before.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, f"stream-{name}")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", path + "-offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _newest(stream: DataFrame, root: str) -> DataFrame:
    spark, found = stream.sparkSession, versions(stream.sparkSession, root)
    return spark.read.schema(stream.schema).parquet(found[max(found)]) if found else spark.createDataFrame([], stream.schema)


def run_whole(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """A stream's aggregates once its input is used up, with the windows still open.

    Complete mode: each batch writes the whole result as a new version, the last one
    counts. With a path of the caller's, a later run goes on from there.
    """
    root = path or fresh_path(stream.sparkSession, f"stream-{name}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/version-{number}")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", root + "/offsets").trigger(availableNow=True).start().awaitTermination()
    return _newest(stream, root)


def _watermarked(stream: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """Without a delay no row is late: every window stays open, for run_whole."""
    return stream if delay is None else stream.withWatermark(ts, delay)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, ts: str, delay: str | None, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over fixed windows of event time (an extension; so is sessions)."""
    g = _watermarked(stream, ts, delay).groupBy(F.window(ts, size), *keys).agg(*aggregates)
    return g.select(F.col("window.start").alias("start"), *[c for c in g.columns if c != "window"])


def sessions(stream: DataFrame, ts: str, delay: str | None, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    g = _watermarked(stream, ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(*aggregates)
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in g.columns if c != "session_window"])


def upsert_stream(stream: DataFrame, keys: list[str], order: list[Column], name: str, path: str | None = None) -> DataFrame:
    """Keep-last table of a stream: each batch is merged with the version before it and written as a new one.

    With a path of the caller's, a later run merges into what an earlier one left; a
    batch that is run again replaces its own version.
    """
    spark = stream.sparkSession
    root = path or fresh_path(spark, f"stream-{name}")

    def merge(batch: DataFrame, number: int) -> None:
        before = {k: v for k, v in versions(spark, root).items() if k < number}
        old = spark.read.schema(stream.schema).parquet(before[max(before)]) if before else batch.limit(0)
        latest(old.unionByName(batch), keys, order).write.mode("overwrite").parquet(f"{root}/version-{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", root + "/offsets").trigger(availableNow=True).start().awaitTermination()
    return _newest(stream, root)


def backoff(attempt: int, base: float = 1.0, factor: float = 2.0, most: float = 60.0, jitter: float = 0.0, seed: int | None = None) -> float:
    """Seconds to wait before an attempt (from 1): exponential, bounded, with optional jitter."""
    wait = min(most, base * factor ** (attempt - 1))
    return wait + (random.Random(seed).uniform(0, jitter * wait) if jitter else 0.0)


def retry(work, attempts: int, retryable: tuple[type[BaseException], ...], sleep, base: float = 1.0):
    """work(), again after each retryable error; other errors pass through at once."""
    for attempt in range(1, attempts + 1):
        try:
            return work()
        except retryable:
            if attempt == attempts:
                raise
            sleep(backoff(attempt, base))
