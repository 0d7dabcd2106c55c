"""Chunk tables: a file becomes rows (file_id, seq, off, len, hash).

Fixed-size and line chunks are SQL expressions. Content-defined chunks need a running hash over bytes: it is taken
by numpy over the whole file at once (each place's hash depends on the 64 bytes before it alone), and only the cut
decisions walk from match to match. Files are independent; no row is moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalar import c, data_hash

TARGET, HASHERS = 16384, 8
WINDOW = 64


def fixed_chunks(df: DataFrame, file_id: str, data: str, size: int) -> DataFrame:
    """Chunks of size characters (text) or bytes (binary)."""
    n = F.length(c(data))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    rows = df.select(F.col(file_id).alias("file_id"), c(data).alias("data"), F.posexplode(starts).alias("seq", "off"))
    piece = F.substring("data", F.col("off") + 1, F.lit(size))
    return rows.select("file_id", "seq", F.col("off").cast("long").alias("off"), F.length(piece).cast("long").alias("len"), data_hash(piece).alias("hash"))


def line_chunks(df: DataFrame, file_id: str, text: str) -> DataFrame:
    """Lines without their breaks: file_id, seq, len (characters), hash."""
    rows = df.select(F.col(file_id).alias("file_id"), F.split(c(text), "\n").alias("lines"))
    rows = rows.select("file_id", F.posexplode("lines").alias("seq", "line"))
    return rows.select("file_id", "seq", F.length("line").cast("long").alias("len"), data_hash("line").alias("hash"))


def gear(seed: int) -> np.ndarray:
    """256 hash values by a fixed rule: the first eight bytes of SHA-256 of seed and byte."""
    return np.array([int.from_bytes(hashlib.sha256(f"gear {seed} {b}".encode()).digest()[:8], "little") for b in range(256)], np.uint64)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """At each place the gear hash of the 64 bytes that end there, by doubling the window."""
    h = table[data]
    k = 1
    while k < WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint64(k)) if k < len(h) else h[k:]
        k *= 2
    return h


def cut_points(data: bytes, target: int = TARGET, hashers: int = 1, seed: int = 123456) -> list[int]:
    """Where chunks end. With several hashers a chunk ends when each has matched once, in turn, on a share of the
    target: its length varies less."""
    if target & (target - 1) or hashers & (hashers - 1) or target // hashers < 256:
        raise ValueError("target and hashers must be powers of two, with at least 256 bytes of target for each hasher")
    share = target // hashers
    low, high, mask = share // 4, share * 8, np.uint64((share - 1) << (64 - share.bit_length() + 1))
    values = np.frombuffer(data, np.uint8)
    matches = []
    for k in range(hashers):
        h = gear_hashes(values, gear(seed + k))
        matches.append(np.flatnonzero(h & mask == 0) + 1)
    cuts, start, k, n = [], 0, 0, len(data)
    while start < n:
        # the hash restarts at low - 64, so the earliest end is one byte later
        i = np.searchsorted(matches[k], start + low - WINDOW + 1)
        end = int(matches[k][i]) if i < len(matches[k]) else n + 1
        end = min(end, start + high)
        if end > n:
            break
        start, k = end, k + 1
        if k == hashers:
            cuts.append(end)
            k = 0
    if n and (not cuts or cuts[-1] < n):
        cuts.append(n)
    return cuts


def content_chunks(df: DataFrame, file_id: str, data: str, target: int = TARGET, hashers: int = HASHERS, with_bytes: bool = False) -> DataFrame:
    """Content-defined chunks of binary or text (UTF-8) columns; null files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                rows, seqs, offs, lens, hashes, parts = [], [], [], [], [], []
                for i, d in enumerate(batch.column(1).to_pylist()):
                    start = 0
                    for seq, end in enumerate(cut_points(d or b"", target, hashers)):
                        rows.append(i)
                        seqs.append(seq)
                        offs.append(start)
                        lens.append(end - start)
                        hashes.append(hashlib.sha256(d[start:end]).hexdigest())
                        parts.append(d[start:end] if with_bytes else None)
                        start = end
                out = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(seqs, pa.int32()), pa.array(offs, pa.int64()), pa.array(lens, pa.int64()), pa.array(hashes, pa.string())]
                names = ["file_id", "seq", "off", "len", "hash"]
                if with_bytes:
                    out.append(pa.array(parts, pa.binary()))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(out, names)

    kind = df.schema[file_id].dataType.simpleString()
    schema = f"file_id {kind}, seq int, off long, len long, hash string" + ", bytes binary" * with_bytes
    return df.select(F.col(file_id).alias("file_id"), c(data).cast("binary").alias("data")).mapInArrow(run, schema)


def dedup_report(chunks: DataFrame) -> DataFrame:
    """total_chunks, total_bytes, unique_chunks, unique_bytes, dedup_ratio. One grouping by hash."""
    unique = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    return unique.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum(F.col("n") * F.col("len")), F.lit(0)).alias("total_bytes"),
        F.count("*").alias("unique_chunks"), F.coalesce(F.sum("len"), F.lit(0)).alias("unique_bytes"),
    ).withColumn("dedup_ratio", F.round(F.col("unique_bytes") / F.nullif(F.col("total_bytes"), F.lit(0)), 4))


def length_histogram(chunks: DataFrame) -> DataFrame:
    """len, count over unique chunks."""
    return chunks.groupBy("hash").agg(F.max("len").alias("len")).groupBy("len").agg(F.count("*").alias("count"))


def global_dedup_sample(chunks: DataFrame, modulus: int = 1024) -> DataFrame:
    """Chunks by which other stores may find a file: the first of each file, and one in modulus by hash."""
    from stratum.functions.scalar import hash_mod

    return chunks.where((hash_mod("hash", modulus) == 0) | (F.col("seq") == 0))


def spaced_queries(chunks: DataFrame, modulus: int = 1024, spacing: int = 256) -> DataFrame:
    """Of the sampled chunks of each file those that ask other stores: the first, then the next at least so many chunks
    on. Each choice depends on the last one, so a file's few sampled chunks are walked in order."""
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept, last = pdf.sort_values("seq"), [], None
        for seq in pdf["seq"]:
            kept.append(last is None or seq - last >= spacing)
            last = seq if kept[-1] else last
        return pdf[kept]

    rows = global_dedup_sample(chunks, modulus)
    return rows.groupBy("file_id").applyInPandas(walk, rows.schema)


def text_passthrough(data: Column, threshold: int = 262063) -> Column:
    """Whether a file stays as it is: empty, or small text."""
    from stratum.functions.scalar import is_small_text

    return (F.octet_length(data) == 0) | is_small_text(data, threshold)
