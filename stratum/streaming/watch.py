"""Streams: a watched folder of snapshots, a note log folded into a store, running column profiles.

The engine these operators follow has no event time; windows and watermarks below are Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, schema: str, on_change: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Call on_change with each batch of new rows of a Parquet folder: every interval, or what is there and stop."""
    stream = spark.readStream.schema(schema).parquet(path)
    writer = stream.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def last_version(spark: SparkSession, store_path: str, below: int) -> int | None:
    """The highest complete version of a store under a number, on any file system that Spark reads."""
    at = lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join((store_path, *x)))
    fs = at().getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at())] if fs.exists(at()) else []
    numbers = (int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(at(n, "_SUCCESS")))
    return max((n for n in numbers if n < below), default=None)


def fold_notes(store_path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For watch(): merges notes into a store of one row per key, later notes winning, a new version each batch.

    The version's number is the batch's, so a batch that is repeated after a failure writes the same version.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("version", F.lit(number))
        before = last_version(spark, store_path, number)
        if before is not None:
            new = spark.read.parquet(f"{store_path}/v{before}").unionByName(new)
        last = new.groupBy(key).agg(F.max_by(F.struct(*[x for x in new.columns if x != key]), "version").alias("x"))
        last.select(key, "x.*").select(*new.columns).write.mode("overwrite").parquet(f"{store_path}/v{number}")

    return fold


def running_profile(values: DataFrame, key: str, value: str) -> DataFrame:
    """Streaming count, mean and sample variance per key, updated with every batch; state is three numbers per key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in batches:
            x = pd.to_numeric(pdf[value], errors="coerce").dropna()
            if m := len(x):
                d, t = float(x.mean()) - mean, n + m
                m2 += float(((x - x.mean()) ** 2).sum()) + d * d * n * m / t
                mean += d * m / t
                n = t
        state.update((n, mean, m2))
        yield pd.DataFrame([(k[0], n, mean, m2 / (n - 1) if n > 1 else 0.0)], columns=[key, "n", "avg", "var"])

    kind = values.schema[key].dataType.simpleString()
    return values.select(key, value).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n long, avg double, var double", "n long, mean double, m2 double", "update", "NoTimeout")


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window, for batches and streams alike; streams drop state that is too late."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def expire(cache: DataFrame, now, ttl_seconds: int, time: str = "created") -> DataFrame:
    """Entries of a cache table that are younger than their time to live."""
    return cache.where(F.col(time) > F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(ttl_seconds)))
