"""The content store as tables, and what is asked of it.

    files(file_hash, num_segments)          file_segments(file_hash, seq, cas_hash, start, end, len)
    cas_blocks(cas_hash, num_chunks, bytes) cas_chunks(cas_hash, idx, chunk_hash, start, len)

Lookups are equi-joins on full hashes; runs and coalesced ranges are gaps-and-islands windows within one file or block;
set operations are groupings and anti-joins. Only packing and covering, where each step depends on the last, run as
grouped Arrow functions, one file or store at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.lineage import cut

BLOCK_TARGET = 15 << 20
SHARD_TARGET = 48 << 20
MAX_REFS = 512
U32 = 4294967295
#: Places in the store from which runs of a chunk are looked for.
CANDIDATES = 8
#: Bytes of a block that meet the segments that need some of them.
PAGE = 1 << 13


def with_offsets(chunks: DataFrame, by: str = "cas_hash", order: str = "idx") -> DataFrame:
    """Chunks with start: the bytes before each in its block."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum("len").over(w), F.lit(0)))


def coalesce_ranges(ranges: DataFrame, by: str = "file_hash", order: str = "seq") -> DataFrame:
    """Neighbours of one hash whose ends meet become one range: by, seq (from 0), cas_hash, start, end."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.when((F.lag("cas_hash").over(w) == F.col("cas_hash")) & (F.lag("end").over(w) == F.col("start")), 0).otherwise(1)
    islands = ranges.withColumn("new", new).withColumn("island", F.sum("new").over(w) - 1)
    return islands.groupBy(by, F.col("island").alias("seq"), "cas_hash").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def slice_ranges(ranges: DataFrame, start: int, length: int, by: str = "file_hash", order: str = "seq") -> DataFrame:
    """The part of each concatenation that holds [start, start + length); short where the file is."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("end") - F.col("start")
    rows = ranges.withColumn("at", F.coalesce(F.sum(n).over(w), F.lit(0)))
    first, last = F.greatest(F.lit(start) - F.col("at"), F.lit(0)), F.least(F.lit(start + length) - F.col("at"), n)
    return rows.where(first < last).select(by, order, "cas_hash", (F.col("start") + first).alias("start"), (F.col("start") + last).alias("end"))


def reconstruction(files: DataFrame, segments: DataFrame, rank: str | None = None) -> DataFrame:
    """Segments of the asked files in order; with a rank column (which store) the first store's only."""
    rows = segments.join(files.select("file_hash").distinct(), "file_hash")
    if rank:
        w = Window.partitionBy("file_hash")
        rows = rows.withColumn("__first", F.min(rank).over(w)).where(F.col(rank) == F.col("__first")).drop("__first")
    return rows


def dedup_runs(file_chunks: DataFrame, cas_chunks: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """Runs of a file's chunks that a block holds in a row: file_id, cas_hash, first_seq, first_idx, n_chunks, start, end.

    An equi-join on the chunk hash; a run is an island of equal seq - idx. A chunk that the store holds in more than
    ``candidates`` places (a blank line) gives hits with the first so many by (cas_hash, idx), and wherever it lies
    on a diagonal of its file and a block that a rarer chunk shows, so runs go on through it; it is never joined
    with all its places. Runs of such chunks alone are reported from those first places.
    """
    count = cas_chunks.groupBy("chunk_hash").agg(F.count("*").alias("places"))
    common = count.where(F.col("places") > candidates).select("chunk_hash")
    place = F.row_number().over(Window.partitionBy("chunk_hash").orderBy("cas_hash", "idx"))
    few = cas_chunks.withColumn("place", place).where(F.col("place") <= candidates).drop("place")
    left = file_chunks.select("file_id", "seq", F.col("hash").alias("chunk_hash"))
    hits = left.join(few, "chunk_hash").withColumn("diagonal", F.col("seq") - F.col("idx"))
    hits = hits.join(common.withColumn("common", F.lit(True)), "chunk_hash", "left")
    shown = hits.where("common IS NULL").select("file_id", "cas_hash", "diagonal").distinct()
    through = left.join(common, "chunk_hash").join(shown, "file_id").withColumn("idx", F.col("seq") - F.col("diagonal"))
    through = through.join(cas_chunks, ["cas_hash", "idx", "chunk_hash"])
    names = ["file_id", "seq", "cas_hash", "idx", "start", "len", "diagonal"]
    hits = hits.select(*names).union(through.select(*names)).distinct()
    w = Window.partitionBy("file_id", "cas_hash", "diagonal").orderBy("seq")
    islands = hits.withColumn("island", F.col("seq") - F.row_number().over(w))
    return islands.groupBy("file_id", "cas_hash", "diagonal", "island").agg(
        F.min("seq").alias("first_seq"), F.min("idx").alias("first_idx"), F.count("*").alias("n_chunks"), F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end")
    ).drop("diagonal", "island")


def greedy_cover(runs: DataFrame) -> DataFrame:
    """Left to right, at each chunk the longest run that covers it (smallest block, then place, on ties), cut to start
    there: file_id, first_seq, cas_hash, first_idx, n_chunks. Chunks that no run covers are left out."""

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf.first_seq, pdf.n_chunks, pdf.cas_hash, pdf.first_idx))
        out, at, i, live = [], -1, 0, []
        while i < len(rows) or live:
            if not live:
                at = max(at, rows[i][0])
            while i < len(rows) and rows[i][0] <= at:
                live.append(rows[i])
                i += 1
            live = [r for r in live if r[0] + r[1] > at]
            if not live:
                continue
            s, n, h, idx = min(live, key=lambda r: (-(r[0] + r[1] - at), r[2], r[3] + at - r[0]))
            out.append((pdf.file_id.iloc[0], at, h, idx + at - s, s + n - at))
            at = s + n
        return pd.DataFrame(out, columns=["file_id", "first_seq", "cas_hash", "first_idx", "n_chunks"])

    kind = runs.schema["file_id"].dataType.simpleString()
    return runs.groupBy("file_id").applyInPandas(cover, f"file_id {kind}, first_seq long, cas_hash string, first_idx long, n_chunks long")


def self_references(chunks: DataFrame, by: str = "file_id") -> DataFrame:
    """Chunks with first_seq: where the same content came first in its file or block."""
    return chunks.withColumn("first_seq", F.min("seq").over(Window.partitionBy(by, "hash")))


def pack(items: DataFrame, by: str, order: str, size: str, target: int, over: bool = True) -> DataFrame:
    """Items with bin: filled in order, closed once their sum passes (over) or reaches the target.

    The running sum restarts with every bin, so each group is walked in order, in batches, by one task.
    """
    rows = items.repartition(by).sortWithinPartitions(by, order)
    k, n = rows.columns.index(by), rows.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, number = object(), 0, 0
        for batch in batches:
            out = []
            for g, s in zip(batch.column(k).to_pylist(), batch.column(n).to_pylist()):
                if g != group:
                    group, total, number = g, 0, 0
                out.append(number)
                total += s or 0
                if total > target or total == target and not over:
                    total, number = 0, number + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "bin"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("bin", T.IntegerType())]))


def union_stores(first: DataFrame, second: DataFrame, key: str, on_conflict: str = "first") -> DataFrame:
    """Rows of both by key; where both have one, the first's (or the second's)."""
    a, b = (first, second) if on_conflict == "first" else (second, first)
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def difference_stores(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """What the second has and the first has not."""
    return second.join(first.select(key).distinct(), key, "left_anti")


def store_totals(cas_blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """stored, stored_on_disk (what a block has without that figure counts in full), materialized, and counts."""
    a = cas_blocks.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("stored"), F.coalesce(F.sum(F.coalesce(F.nullif("bytes_on_disk", F.lit(0)), "bytes")), F.lit(0)).alias("stored_on_disk"),
        F.count("*").alias("n_blocks"), F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("n_chunks"),
    )
    b = segments.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("materialized"), F.countDistinct("file_hash").alias("n_files"), F.count("*").alias("n_segments"))
    return a.crossJoin(b)  # one row each


def shard_size(totals: DataFrame, record: int = 48, lookup: int = 12) -> DataFrame:
    """Bytes of a serialized store: a header per file and block, a record per segment and chunk, a lookup entry each."""
    files, blocks, segments, chunks = (F.col(x) for x in ("n_files", "n_blocks", "n_segments", "n_chunks"))
    size = (files + segments + blocks + chunks) * record + (files + blocks + chunks) * lookup
    return totals.withColumn("size", size)


def store_references(segments: DataFrame, owners: DataFrame) -> DataFrame:
    """For segments (shard, shard_rank, cas_hash): chunks that refer to the latest earlier shard that owns the block.

    owners(cas_hash, owner, owner_rank). The join is on the block; the rank is compared after it.
    """
    rows = segments.join(owners, "cas_hash").where("owner_rank < shard_rank")
    latest = rows.groupBy("shard", "cas_hash", "seq").agg(F.max_by("owner", "owner_rank").alias("owner"), F.first("n_chunks").alias("n"))
    return top_references(latest.groupBy("shard", "owner").agg(F.sum("n").alias("chunks")))


def top_references(counts: DataFrame, k: int = MAX_REFS) -> DataFrame:
    """shard, owner, chunks: summed, held to 32 bits, the k largest per shard."""
    rows = counts.groupBy("shard", "owner").agg(F.least(F.sum("chunks"), F.lit(U32)).alias("chunks"))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("chunks"), "owner"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def shard_hints(references: DataFrame, total_bytes: int, per: int = 16384) -> DataFrame:
    """Shards worth fetching for a file of so many bytes: at least one chunk in so many bytes."""
    return references.groupBy("owner").agg(F.sum("chunks").alias("chunks")).where(F.col("chunks") >= total_bytes // per)


def global_lookup(table: DataFrame, asked: DataFrame, salt: bytes) -> DataFrame:
    """Chunks and the store that was registered last for their salted hash: table(salted_hash, shard, seq)."""
    from stratum.functions.scalar import salted

    last = table.groupBy("salted_hash").agg(F.max_by("shard", "seq").alias("shard"))
    return asked.withColumn("salted_hash", salted("hash", F.lit(salt))).join(last, "salted_hash")


def compact(shards: DataFrame, target: int = SHARD_TARGET, by: str | None = None) -> DataFrame:
    """Groups of consecutive shards (by mtime, then name) that together reach the target: shard, bin.

    One row a shard is walked in order; with by (such as the folder) each of its values on its own, in parallel.
    """
    rows = shards if by else shards.withColumn("all", F.lit(0))
    packed = pack(rows.withColumn("__order", F.struct("mtime", "shard")), by or "all", "__order", "size", target, over=False)
    return packed.drop("__order") if by else packed.drop("__order", "all")


def compacted(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """The rows of the shards (column shard) of each group as one shard, named by what it holds; of equal keys one stays.

    Groups that hold the same have the same name; bin tells them apart.
    """
    joined = rows.join(groups.select("shard", "bin"), "shard").dropDuplicates(["bin", *key])
    names = joined.groupBy("bin").agg(F.sha2(F.sum(F.xxhash64(*key).cast("decimal(38,0)")).cast("string"), 256).alias("name"))
    return joined.join(names, "bin").select("bin", F.col("name").alias("shard"), *(c for c in rows.columns if c != "shard"))


def pieces(segments: DataFrame, data: DataFrame, start: int = 0, length: int | None = None) -> DataFrame:
    """file_hash, seq, page, piece of files, or of a range of them, in order of seq and page, for files that are too long
    for one row.

    Blocks are dealt by page, so that a segment meets the pages it needs and no whole block.
    """
    rows = segments if length is None and not start else slice_ranges(segments, start, length if length is not None else 1 << 62)
    first, last = (F.floor(F.greatest(x - 1, F.lit(0)) / PAGE).cast("int") for x in (F.when(F.col("start") < F.col("end"), F.col("start") + 1).otherwise(F.col("start")), F.col("end")))
    rows = rows.withColumn("page", F.explode(F.sequence(first, F.greatest(first, last))))
    # bytes are bound once by the outer transform: a column would be copied for every page
    cut_up = F.transform(F.array("bytes"), lambda b: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(b) - 1, F.lit(0)) / PAGE).cast("int")), lambda k: F.substring(b, k * PAGE + 1, F.lit(PAGE))))
    paged = data.select("cas_hash", F.posexplode(cut_up[0]).alias("page", "bytes"))
    at = F.col("page").cast("long") * PAGE
    a, b = F.greatest(F.col("start") - at, F.lit(0)), F.least(F.col("end") - at, F.lit(PAGE))
    return rows.join(paged, ["cas_hash", "page"]).select("file_hash", "seq", "page", F.substring("bytes", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).alias("piece"))


def reconstruct(segments: DataFrame, data: DataFrame, start: int = 0, length: int | None = None) -> DataFrame:
    """file_hash and bytes of files, or of a range of them: segments joined to data(cas_hash, bytes), in order.

    A file must fit a row (under 1 GB); pieces() gives longer ones part by part.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "page", "piece"))), lambda x: F.hex(x.piece))
    return pieces(segments, data, start, length).groupBy("file_hash").agg(F.unhex(F.array_join(ordered, "")).alias("bytes"))


def clean(df: DataFrame, file_id: str, data: str, target: int, hashers: int, block_target: int = BLOCK_TARGET, lanes: int | None = None) -> dict[str, DataFrame]:
    """Files to a store: chunks, and new content packed into blocks, as the four tables (and pointers).

    Blocks are filled in lanes, as many as the session has shuffle partitions unless told otherwise. One shuffle by
    chunk hash finds the first copy of every chunk, one by file rebuilds the segments. Chunks and placed chunks are
    each computed once and written to the shared folder, whatever tables are read of the result.
    """
    from stratum.functions.scalar import pointer_text
    from stratum.operators.chunks import content_chunks
    from stratum.operators.merkle import file_hashes

    chunks = cut(content_chunks(df, file_id, data, target, hashers, with_bytes=True))
    lanes = lanes or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fresh = chunks.groupBy("hash").agg(F.min_by(F.struct("len", "bytes"), F.struct("file_id", "seq")).alias("x"), F.min("file_id").alias("home")).select("hash", "x.len", "x.bytes", F.pmod(F.xxhash64("home"), F.lit(lanes)).alias("lane"))
    packed = cut(pack(fresh, "lane", "hash", "len", block_target))
    order = Window.partitionBy("lane", "bin").orderBy("hash")
    placed = packed.withColumn("idx", F.row_number().over(order) - 1)
    names = placed.groupBy("lane", "bin").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x.hash), ""), 256).alias("cas_hash"))
    placed = with_offsets(placed.join(names, ["lane", "bin"]))
    cas_chunks = placed.select("cas_hash", "idx", F.col("hash").alias("chunk_hash"), "start", "len")
    blocks = placed.groupBy("cas_hash").agg(
        F.count("*").alias("num_chunks"), F.sum("len").alias("bytes"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "bytes"))), lambda x: F.hex(x.bytes)), "")).alias("data")
    )
    hashes = file_hashes(chunks)
    segments = chunks.select("file_id", "seq", F.col("hash").alias("chunk_hash")).join(cas_chunks.drop("idx"), "chunk_hash").join(hashes, "file_id")
    segments = segments.dropDuplicates(["file_hash", "seq"]).select("file_hash", "seq", "cas_hash", "start", (F.col("start") + F.col("len")).alias("end"))
    segments = coalesce_ranges(segments).withColumn("len", F.col("end") - F.col("start"))
    size = chunks.groupBy("file_id").agg(F.sum("len").alias("size"))
    pointers = hashes.join(size, "file_id").withColumn("pointer", pointer_text("file_hash", "size"))
    return {"chunks": chunks.drop("bytes"), "file_segments": segments, "cas_blocks": blocks.drop("data"), "cas_chunks": cas_chunks, "cas_data": blocks.select("cas_hash", F.col("data").alias("bytes")), "pointers": pointers}
