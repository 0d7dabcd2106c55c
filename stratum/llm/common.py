"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where checkpoints go when the session names no folder and its master is this machine.
LOCAL_SHARED = "/tmp/checkpoints"

#: Rows of a small table that may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000

#: Rows of a batch that Spark sends to a worker, where small_batches() is asked for, and the setting that says so.
BATCH_ROWS, ARROW_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The caches of kept().
KEPT: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session has none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{LOCAL_SHARED}/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing needs any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if os.path.basename(path).startswith("table-"):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, weight=None) -> DataFrame:
    """Mark a materialized table for broadcast if it has few rows, else leave the join to a shuffle.

    Rows of no fixed size need a weight: how many rows of a fixed size each counts for.
    """
    if weight is None:
        few = df.limit(rows + 1).count() <= rows
    else:
        few = (df.agg(F.sum(weight).alias("n")).first().n or 0) <= rows
    return F.broadcast(df) if few else df


def text_hash(col: str = "text"):
    """With doc_id it tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def first_by_hash(rows: DataFrame, per_class: int) -> DataFrame:
    """Of rows with a class y and a hash o, distinct ones of the per_class smallest o of each class.

    Hashes are even, so about four times as many as are asked for lie below a limit that the number of different ones
    gives; the others are left out before any rows of a class meet.
    """
    different = rows.groupBy("y").agg(F.approx_count_distinct("o").alias("d")).collect()  # one row for each class
    if not different:
        return rows.limit(0)
    limit = lambda d: int(-(2**63) + (2**64 - 1) * min(1.0, 4 * per_class / max(1, d))) if 4 * per_class < d else 2**63 - 1
    few = F.broadcast(rows.sparkSession.createDataFrame([(r.y, limit(r.d)) for r in different], f"y {rows.schema['y'].dataType.simpleString()}, most long"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("o"))
    near = rows.join(few, "y").where("o <= most").select(*rows.columns).distinct()
    return near.withColumn("r", rank).where(F.col("r") <= per_class).drop("r")


def bounded_sample(rows: DataFrame, per_class: int, most_bytes: int, seed: int) -> tuple[list[str], list]:
    """Texts and classes of a sample of rows (id, y, t) for a classifier: the first distinct ones by a hash of id and text.

    At most per_class rows of each class and, over all classes in equal shares, most_bytes of text reach the driver,
    however often ids and rows repeat and however long texts are.
    """
    marked = rows.select("y", F.xxhash64("id", "t", F.lit(seed)).alias("o"), F.coalesce("t", F.lit("")).alias("t"))
    first = first_by_hash(marked.select("y", "o", F.octet_length("t").alias("n")), per_class).toArrow().sort_by([("y", "ascending"), ("o", "ascending")])
    share, cuts, used = most_bytes // max(1, len(first["y"].unique())), {}, {}
    for y, o, n in zip(*(first[c].to_pylist() for c in ("y", "o", "n"))):
        used[y] = used.get(y, 0) + n
        if used[y] <= share:
            cuts[y] = o
    if not cuts:
        return [], []
    kind = rows.schema["y"].dataType.simpleString()
    few = F.broadcast(rows.sparkSession.createDataFrame(list(cuts.items()), f"y {kind}, cut long"))
    found = marked.join(few, "y").where("o <= cut").dropDuplicates(["y", "o"]).select("y", "o", "t").toArrow().sort_by([("o", "ascending"), ("y", "ascending")])
    return found["t"].to_pylist(), found["y"].to_pylist()


def arrow_pieces(batch: pa.RecordBatch, size: int = 8 << 20, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece has much more text than size bytes, unless one row has."""
    texts = batch.column(batch.schema.get_field_index(col))
    start = total = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        total += n or 0
        if total >= size:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def kept(maxsize: int):
    """A cache of what a worker keeps from task to task, until a task of another module's operator comes."""

    def cached(make):
        KEPT.append(lru_cache(maxsize)(make))
        return KEPT[-1]

    return cached


def let_go(module: str) -> None:
    """Drop what this worker keeps for operators of other modules, as each worker gets tasks of all stages in turn."""
    for cache in KEPT:
        if cache.__module__ != module:
            cache.cache_clear()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on at most so many rows go to a worker together: executor and worker both hold such a batch, for each task."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, rows)


def releasing(run):
    """A batch function that gives freed memory back when its task ends, as workers live on for other tasks."""

    def wrapped(batches):
        let_go(run.__module__)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that a frame does not have yet, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
