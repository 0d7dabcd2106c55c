"""Exact top-k search by integer inner product, a block of documents at a time.

Components become floor(scale * x). Documents are taken in ranges (blocks); a block keeps, per term (component),
its largest and smallest value, and its forward index: the rows of its vectors. For a query the sum over the terms
of the larger of query value times either extreme bounds every score in the block. Each query visits its blocks in
order of that bound and stops when the next one is below its k-th score; ties are visited, so equal scores still go
to the smaller id. The k-th best among the other queries, which are documents themselves, is a first threshold.

Nothing passes through the driver but two counts. Documents are packed into blocks once and written to the shared
folder, a row for each block; queries are quantized and written likewise. Queries are dealt to chunks of about CHUNK,
blocks to groups of up to GROUP; every group of blocks meets every chunk of queries in one task, which holds the chunk
and streams the blocks. Each such meeting gives at most k rows for each query, and a last ranking merges them. So the
queries are shuffled once for each group and the blocks once for each chunk; no task grows with either.

Cases: vectors that are null, or hold null or non-finite components, and rows with a null id take no part; vectors of
different lengths are not compared; rows of one id are the same document for leaving out the query itself. Equal rows
of a query (id and quantized vector) are one query; rows of one id with different vectors are queries of their own, each
with its own ranks. Repeated candidates count as often as they occur. Ids are 64-bit integers throughout; ties go to the
smaller id. Fewer than k candidates give all; an empty table gives no rows; other columns, whatever their names, are
ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, releasing

#: Documents of a block, blocks that are looked at together, blocks of a group, queries of a chunk, and how many of
#: them give first thresholds.
BLOCK, BLOCKS, GROUP, CHUNK, FIRST = 512, 64, 2048, 8192, 1024


def quantized(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of the usable rows of a batch, by length of the vector."""
    ids, lists = batch.column(0), batch.column(1)
    good = ~np.asarray(lists.is_null()) & ~np.asarray(ids.is_null())
    sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(-1))
    values = pa.compute.fill_null(pa.compute.list_flatten(lists).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == n))
        x = values[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
        ok = np.isfinite(x).all(1)
        yield ids[rows[ok]], np.floor(scale * x[ok])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers, by floating point where that is exact."""
    largest = (np.abs(q).max(initial=0)) * (np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q @ x.T).astype(np.int64) if largest < 2**53 else q.astype(np.int64) @ x.astype(np.int64).T


LOWEST = np.iinfo(np.int64).min


class Best:
    """The k best (score, id) of each query so far, and what a score must reach to count."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.score = np.full((len(ids), k), LOWEST)
        self.doc = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = np.full(len(ids), LOWEST)
        for start in range(0, len(ids), BLOCK):
            s = products(vectors[start : start + BLOCK], vectors[:FIRST])
            s[ids[start : start + BLOCK][:, None] == ids[None, :FIRST]] = LOWEST
            if s.shape[1] > k:
                self.least[start : start + BLOCK] = np.partition(s, -k, axis=1)[:, -k]

    def add(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        s = products(self.q[rows], x)
        s[self.ids[rows][:, None] == ids[None, :]] = LOWEST
        hit, col = np.nonzero((s >= self.least[rows][:, None]) & (s > LOWEST))
        if not len(hit):
            return
        touched, at = np.unique(hit, return_inverse=True)
        r = rows[touched]
        own = np.repeat(np.arange(len(touched)), self.k)
        who = np.concatenate([own, at])
        score = np.concatenate([self.score[r].ravel(), s[hit, col]])
        doc = np.concatenate([self.doc[r].ravel(), ids[col]])
        order = np.lexsort((doc, -score.astype(np.float64) if np.abs(score[score > LOWEST]).max(initial=0) < 2**53 else ~score, who))
        rank = np.arange(len(order)) - np.searchsorted(who[order], np.arange(len(touched)))[who[order]]
        kept = order[rank < self.k]
        self.score[r], self.doc[r] = score[kept].reshape(-1, self.k), doc[kept].reshape(-1, self.k)
        self.least[r] = np.maximum(self.least[r], self.score[r, -1])

    def visit(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Take blocks of documents, best bounds first, until none can add to a query."""
        starts = np.arange(0, len(ids), BLOCK)
        high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
        pos, neg = np.maximum(self.q, 0), np.minimum(self.q, 0)
        bound = pos @ high.T + neg @ low.T
        bound += np.abs(bound) * 1e-12  # never below the sum, whatever its rounding
        order = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(len(self.q))
        for r in range(len(starts)):
            block = order[active, r]
            still = bound[active, block] >= self.least[active].astype(np.float64)
            active, block = active[still], block[still]
            if not len(active):
                return
            for b in np.unique(block):
                self.add(active[block == b], ids[starts[b] : starts[b] + BLOCK], x[starts[b] : starts[b] + BLOCK])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the query, its id, document, score) of what is best."""
        q, j = np.nonzero(self.score > LOWEST)
        return q, self.ids[q], self.doc[q, j], self.score[q, j]


def _smallest(x: np.ndarray) -> np.ndarray:
    """Integers in the smallest of three types that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16) if most < 1 << 15 else x.astype(np.int32) if most < 1 << 31 else x


def _vectors(data: bytes, rows: int, n: int) -> np.ndarray:
    """The vectors of _smallest(), whose type shows in their size."""
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // max(1, rows * n)] if n else np.float64).reshape(rows, n).astype(np.float64)


def blocks_of(rows: DataFrame, scale: int) -> DataFrame:
    """Rows (id, v) packed into blocks: id (a number of its own), n (length of the vectors), ids, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, x in quantized(batch, scale):
                for start in range(0, len(ids), BLOCK):
                    some, vectors = ids[start : start + BLOCK], _smallest(x[start : start + BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([x.shape[1]]), pa.array([some.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["id", "n", "ids", "x"])
                    number += 1

    return rows.mapInArrow(releasing(run), "id long, n long, ids binary, x binary")


def queries_of(rows: DataFrame, scale: int) -> DataFrame:
    """The distinct queries among rows (id, v): id, n, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in quantized(batch, scale):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), x.shape[1])), pa.array([v.tobytes() for v in x + 0.0], pa.binary())], ["id", "n", "x"])

    return rows.mapInArrow(releasing(run), "id long, n long, x binary").distinct()


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query(id) holds, the k best of all other rows."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    blocks, queries = materialize(blocks_of(rows, scale)), materialize(queries_of(rows.where(is_query(F.col("id"))), scale))
    n_blocks, n_queries = blocks.count(), queries.count()
    chunks = max(1, -(-n_queries // CHUNK))
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_blocks // GROUP), min(n_blocks // BLOCKS, -(-tasks // chunks)))
    asked = queries.withColumn("c", F.pmod(F.xxhash64("id", "x"), F.lit(chunks))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    shown = blocks.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    both = asked.select(F.col("g").cast("long"), F.col("c").cast("long"), "n", F.lit(0).alias("side"), "id", F.lit(None).cast("binary").alias("ids"), "x")
    both = both.union(shown.select(F.col("g").cast("long"), F.col("c").cast("long"), "n", F.lit(1).alias("side"), "id", "ids", "x"))
    both = both.repartition("g", "c", "n").sortWithinPartitions("g", "c", "n", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asks, best, waiting = None, [], None, []

        def look() -> None:
            nonlocal best
            if asks and best is None:
                best = Best(np.array([i for i, _ in asks], np.int64), np.stack([np.frombuffer(x, np.float64) for _, x in asks]), k)
            if best and waiting:
                best.visit(np.concatenate([i for i, _ in waiting]), np.concatenate([x for _, x in waiting]))
            waiting.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            look()
            if best:
                at, q, d, s = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array([asks[i][1] for i in at], pa.binary()), pa.array(d), pa.array(s)], ["query_id", "x", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if place != (r["g"], r["c"], r["n"]):
                    yield from flush()
                    place, asks, best, waiting = (r["g"], r["c"], r["n"]), [], None, []
                if r["side"] == 0:
                    asks.append((r["id"], r["x"]))
                elif asks:
                    ids = np.frombuffer(r["ids"], np.int64)
                    waiting.append((ids, _vectors(r["x"], len(ids), r["n"])))
                    if len(waiting) >= BLOCKS:
                        look()
        yield from flush()

    got = both.mapInArrow(releasing(run), "query_id long, x binary, vec_id long, score long")
    got = got.select("query_id", F.sha2("x", 256).alias("x"), "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id", "x").orderBy(F.desc("score"), "vec_id"))
    return got.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def top_k_sql(k: int = 10, scale: int = 1024, every: int = 100) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % {every} = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
  FROM a q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {k}"""
