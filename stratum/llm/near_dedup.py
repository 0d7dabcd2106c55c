"""Near-duplicate groups by DartMinHash over shingles of five words, similarity 0.8 or more.

A text is the set of its five-word shingles (a text of fewer words is one shingle); with ``weighted`` shingles weigh
as often as they occur. DartMinHash throws darts: every shingle, cell of weight and cell of rank has by its hash a
Poisson number of darts, each with a position in the cell and a coordinate. Per coordinate the earliest dart inside
the shingle's weight is kept. Cells of rank are opened until all coordinates are filled, so a long text costs one
hash per shingle and not one per coordinate. Two texts agree on a coordinate with their Jaccard similarity.

1. Texts with equal shingle sets are one class; one representative goes on, however many copies there are.
2. Coordinates are cut into bands; a band's hash is a bucket. Only (bucket, representative, size) is dealt by bucket.
   Each bucket's hub is its member with the most neighbours; every member whose size allows it is compared with its
   hubs, exactly, by their shingle sets.
3. Connected representatives get one label (alternating hub steps until nothing changes).
4. In buckets that still hold several labels, members besides the hub are compared with one another in blocks, as
   matrix products, each pair in the first bucket that it shares, those of the bucket's most frequent label only
   with the others; a block gives at most one link per member that joins two labels. So no link that the bands show is lost and no list of all pairs is ever written.

Who meets whom (2 and 4) is worked out with ids alone. Then the texts are read again, and each shingle set goes
straight to the groups that wait for it, through one shuffle; sets are never stored. Members of one hub are dealt to
lanes of LANE members, each with its own copy of the hub's set, and blocks hold about BLOCK members a side, so no task
grows with a group. Joins by bucket, shingle set and group deal keys of over HOT rows by broadcast (there are at most
rows / HOT of them); the steps of 3 leave skewed vertices to adaptive execution.

Cases: null, empty and blank texts belong to no group and stay; a text of signs alone is one shingle; repeated rows are
copies; ids may be null; a very long text costs in proportion to its words; an empty table gives no rows; extra columns
are ignored, or kept by drop_near_duplicates(), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pieces, bounded_broadcast, discard, fresh, materialize, releasing, text_hash

WORD = re.compile(r"\w+")
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
#: Members of a side of a block; of a lane of a hub; of a bucket that joins by broadcast.
BLOCK, LANE, HOT = 192, 256, 100_000
REMEMBERED = 200_000
U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Poisson(1): chance of at most so many darts in a cell.
_AT_MOST = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800], float))
_STEPS = (_AT_MOST * 2.0**64).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class Shingles:
    """Shingle hashes of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def of(self, text: str, counts: bool = False):
        """The distinct shingle hashes in order, and how often each occurs."""
        words = WORD.findall(text.lower()) or [" ".join(text.split())] * (not text.isspace() and text != "")
        known = self.words
        try:
            w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for x in {x for x in words if x not in known}:
                known[x] = int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(w):
            return (w, w.astype(np.float64)) if counts else w
        n = max(1, len(w) - SHINGLE + 1)
        h = w[:n].copy()
        for i in range(1, min(SHINGLE, len(w))):
            h = mix(h) * GOLD + w[i : i + n]
        h = mix(h + U(min(SHINGLE, len(w))))
        return np.unique(h, return_counts=True) if counts else np.unique(h)


def dart_minhash(element: np.ndarray, doc: np.ndarray, docs: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """docs x k earliest darts (32 bits each) of weighted elements; doc says whose element it is, in order."""
    best = np.full(docs * k, np.iinfo(np.uint64).max, np.uint64)
    if weight is not None:  # one region for each whole unit of weight and one for the rest
        cells = np.ceil(weight).astype(np.int64)
        unit = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        inside = np.minimum(1.0, np.repeat(weight, cells) - unit)
        element, doc = mix(np.repeat(element, cells) + unit.astype(np.uint64) * GOLD), np.repeat(doc, cells)
    else:
        inside = None
    low, step = 0, 1
    while len(element):
        per = mix(element[:, None] + (np.arange(low, low + step, dtype=np.uint64) * MIX2)[None, :]).ravel()
        rank_cell = np.tile(np.arange(low, low + step, dtype=np.uint64), len(element))
        number = np.searchsorted(_STEPS, per, side="right")
        at = np.repeat(np.arange(len(per)), number)
        nth = (np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)).astype(np.uint64)
        dart = mix(per[at] + (nth + U(1)) * GOLD)
        owner = np.repeat(doc, step)[at]
        place = mix(dart + MIX1)
        rank = np.minimum((rank_cell[at] << U(20)) + (place >> U(44)), U(0xFFFFFFFF))  # cell, then place within it
        if inside is not None:
            hit = (mix(dart + MIX2) >> U(11)).astype(np.float64) * 2.0**-53 < np.repeat(inside, step)[at]
            dart, owner, rank = dart[hit], owner[hit], rank[hit]
        coordinate = ((dart >> U(32)) * U(k) >> U(32)).astype(np.int64)
        np.minimum.at(best, owner.astype(np.int64) * k + coordinate, (rank << U(32)) | (mix(dart) >> U(32)))
        low += step
        open_docs = (best.reshape(docs, k) == np.iinfo(np.uint64).max).any(1)
        if low >= 4000:  # cells of rank are 12 bits; a coordinate that is empty by then stays so for all
            break
        keep = open_docs[doc]
        element, doc = element[keep], doc[keep]
        if inside is not None:
            inside = inside[keep]
        step = max(1, min(low, 400_000 // max(1, len(element)), 4000 - low))
    return (best & U(0xFFFFFFFF)).astype(np.uint32).reshape(docs, k)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """docs x BANDS bucket hashes."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD), (len(s), BANDS)).copy()
    for i in range(ROWS):
        h = mix(h) * GOLD + s[:, :, i]
    return mix(h).view(np.int64)


def set_id(shingles: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    return blake2b(shingles.tobytes() + (b"" if counts is None else counts.astype(np.float64).tobytes()), digest_size=16).digest()


def signatures(docs: DataFrame, key: str, text: str, weighted: bool) -> DataFrame:
    """Per row: id, h (text hash), rid (id of the shingle set, null for null and blank texts), n (its size), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for whole in batches:
            for batch in arrow_pieces(whole, 2 << 20):
                sets, weights, rids = [], [], []
                for t in batch.column(2).to_pylist():
                    s, c = shingles.of(t or "", True)
                    sets.append(s)
                    weights.append(c)
                    rids.append(set_id(s, c if weighted else None) if len(s) else None)
                sizes = [len(s) for s in sets]
                doc = np.repeat(np.arange(len(sets)), sizes)
                sig = dart_minhash(np.concatenate(sets), doc, len(sets), BANDS * ROWS, np.concatenate(weights).astype(np.float64) if weighted else None)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(band_hashes(sig).ravel()))
                n = pa.array([int(c.sum()) for c in weights] if weighted else sizes, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rids, pa.binary()), n, bands], ["id", "h", "rid", "n", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), text_hash(text).alias("h"), F.col(text).alias("text"))
    return rows.mapInArrow(releasing(run), f"id {kind}, h long, rid binary, n long, bands array<long>")


def send_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, weighted: bool) -> DataFrame:
    """Every shingle set where it is waited for: the columns of the table wanted (id, h, rid, targets: array of structs) with
    the fields of each target in place of targets, and s and c, the set and its weights."""
    rest = [f for f in wanted.schema.fields if f.name not in ("id", "h")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for whole in batches:
            for batch in arrow_pieces(whole, 2 << 20):
                found = [shingles.of(t or "", True) for t in batch.column(batch.num_columns - 1).to_pylist()]
                s = pa.array([x.tobytes() for x, _ in found], pa.binary())
                c = pa.array([w.astype(np.float32).tobytes() if weighted else b"" for _, w in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], s, c], [*batch.schema.names[:-1], "s", "c"])

    texts = docs.select(F.col(key).alias("doc_key"), text_hash(text).alias("doc_hash"), F.col(text).alias("text"))
    wanted = bounded_broadcast(wanted, weight=F.size("targets") + 4)
    rows = texts.join(wanted, (F.col("doc_hash") == F.col("h")) & F.col("doc_key").eqNullSafe(F.col("id"))).select(*(f.name for f in rest), "text")
    schema = T.StructType([*rest, T.StructField("s", T.BinaryType()), T.StructField("c", T.BinaryType())])
    return rows.mapInArrow(releasing(run), schema).withColumn("target", F.explode("targets")).drop("targets").select("*", "target.*").drop("target")


def similarity(a: bytes, b: bytes, ca: bytes, cb: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if ca:
        both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        p, q = np.frombuffer(ca, np.float32), np.frombuffer(cb, np.float32)
        common = float(np.minimum(p[i], q[j]).sum())
        return common / (float(p.sum()) + float(q.sum()) - common)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    common = int((x[at] == y).sum())
    return common / (len(x) + len(y) - common)


def star_links(docs: DataFrame, edges: DataFrame, reps: DataFrame, keep: Callable, key: str, text: str, least: float, weighted: bool) -> DataFrame:
    """The edges (rid, hub, size: of the bucket) whose sets are similar enough, as (a, b)."""
    lanes = edges.select("rid", "hub", F.pmod(F.xxhash64("rid", F.lit(3)), F.ceil(F.col("size") / LANE)).alias("lane"))
    hubs = lanes.select(F.col("hub").alias("rid"), F.struct("hub", "lane", F.lit(0).alias("side")).alias("target")).distinct()
    each = lanes.select("rid", F.struct("hub", "lane", F.lit(1).alias("side")).alias("target")).union(hubs)
    wanted = keep(each.groupBy("rid").agg(F.collect_list("target").alias("targets")).join(reps.select("rid", "h", "id"), "rid"))
    sent = send_sets(docs, wanted, key, text, weighted).repartition("hub", "lane").sortWithinPartitions("hub", "lane", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set, hub_weights = None, b"", b""
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, a, b = whole.slice(start, 256), [], []
                for r in batch.to_pylist():
                    if r["side"] == 0:
                        hub, hub_set, hub_weights = r["hub"], r["s"], r["c"]
                    elif r["hub"] == hub and similarity(r["s"], hub_set, r["c"], hub_weights) >= least:
                        a.append(r["rid"])
                        b.append(hub)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return sent.select("hub", "lane", "side", "rid", "s", "c").mapInArrow(releasing(run), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of edges (a, b): the smallest vertex it is connected to.

    Large-star and small-star steps in turn; each is a grouping by vertex that halves distances, and the edge table
    is written to the shared folder after each round, so a lost executor costs one round.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(edges.where("a <> b").distinct())
    last = None
    while True:
        # large star: larger neighbours go to the smallest one
        least = both(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both(edges).where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours and the vertex itself go to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m")).where("x <> m").distinct()
        new = materialize(small.select(F.col("x").alias("a"), F.col("m").alias("b")))
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        discard(edges)
        edges = new
        if mark == last:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
        last = mark


def _block_links(rid: list, label: np.ndarray, bands: np.ndarray, band: int, side: np.ndarray, sets: list, weights: list, least: float) -> list[tuple[bytes, bytes]]:
    """Links that join labels, among members of one bucket block; side: 0 and 1 are compared across, else (2) all."""
    n = len(rid)
    sizes = np.array([len(s) for s in sets])
    allowed = np.triu(label[:, None] != label[None, :], 1)
    if (side != 2).any():
        allowed &= side[:, None] != side[None, :]
    for earlier in range(band):  # a pair belongs to the first bucket that it shares
        allowed &= bands[:, earlier][:, None] != bands[:, earlier][None, :]
    if not weights:
        allowed &= np.minimum(sizes[:, None], sizes[None, :]) >= least * np.maximum(sizes[:, None], sizes[None, :])
    if not allowed.any():
        return []
    if weights:
        i, j = np.nonzero(allowed)
        sim = np.zeros((n, n))
        for a, b in zip(i, j):
            sim[a, b] = similarity(sets[a].tobytes(), sets[b].tobytes(), weights[a], weights[b])
    else:
        owner = np.repeat(np.arange(n), sizes)
        _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often[column] > 1
        owner, column = owner[shared], column[shared]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], np.unique(column[order], return_inverse=True)[1] if len(column) else column
        common = np.zeros((n, n), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            part = slice(*np.searchsorted(column, [start, start + 4096]))
            m = np.zeros((n, 4096), np.float32)
            m[owner[part], column[part] - start] = 1
            common += m @ m.T
        sim = common / (sizes[:, None] + sizes[None, :] - common)
    i, j = np.nonzero(allowed & (sim >= least))
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    heads: dict = {}
    for x, v in enumerate(label.tolist()):
        root[x] = heads.setdefault(v, x)
    links = []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = find(a), find(b)
        if p != q:
            root[p] = q
            links.append((rid[a], rid[b]))
    return links


def residual_links(docs: DataFrame, members: DataFrame, reps: DataFrame, keep: Callable, key: str, text: str, least: float, weighted: bool) -> DataFrame:
    """Links (a, b) between labels within buckets: members (bucket, rid, label, top, n_top, n_rest).

    Members with their bucket's most frequent label (top) stand in blocks of their own and meet the other blocks only.
    """
    common, rest = F.ceil(F.col("n_top") / BLOCK).cast("int"), F.ceil(F.col("n_rest") / BLOCK).cast("int")
    lane = lambda n: F.pmod(F.xxhash64("rid", F.lit(5)), n).cast("int")
    is_top = F.col("label") == F.col("top")
    rows = members.withColumn("own", F.when(is_top, lane(common)).otherwise(common + lane(rest)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(is_top, common).otherwise(F.lit(0)), common + rest - 1)))
    rows = rows.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"),
        "bucket", F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "rid", "label",
    )
    # a block whose members all have one label has nothing to compare
    open_blocks = rows.groupBy("g").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("g")
    rows = rows.join(open_blocks, "g")
    each = rows.groupBy("rid", "label").agg(F.collect_list(F.struct("g", "bucket", "side")).alias("targets"))
    wanted = keep(each.join(reps.select("rid", "h", "id", "bands"), "rid").withColumn("label", F.xxhash64("label")))
    sent = send_sets(docs, wanted, key, text, weighted).withColumn("band", F.array_position("bands", F.col("bucket")).cast("int") - 1)
    rows = sent.repartition("g").sortWithinPartitions("g").select("g", "band", "side", "rid", "label", "bands", "s", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        met: set = set()  # repeated rows of one id and text come more than once

        def flush() -> pa.RecordBatch:
            weights = [r["c"] for r in waiting]
            links = _block_links(
                [r["rid"] for r in waiting], np.array([r["label"] for r in waiting]), np.array([r["bands"] for r in waiting]), waiting[0]["band"],
                np.array([r["side"] for r in waiting]), [np.frombuffer(r["s"], np.uint64) for r in waiting], weights if any(weights) else [], least,
            )
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for r in batch.slice(start, 256).to_pylist():
                    if waiting and waiting[0]["g"] != r["g"]:
                        yield flush()
                        waiting.clear()
                        met.clear()
                    if r["rid"] not in met:
                        met.add(r["rid"])
                        waiting.append(r)
        if waiting:
            yield flush()

    return rows.mapInArrow(releasing(run), "a binary, b binary")


def hot_keys(df: DataFrame, rows: str, key: str) -> DataFrame | None:
    """Keys that more than HOT rows have, if any: there can't be more of them than all rows / HOT."""
    found = df.where(F.col(rows) > HOT).select(key)
    return found if found.limit(1).count() else None


def by_key(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key, with the hot keys dealt by broadcast."""
    if hot is None:
        return left.join(right, key, how)
    few = F.broadcast(hot)
    usual = left.join(few, key, "left_anti").join(right, key, how)
    return usual.unionByName(left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR, weighted: bool = False) -> DataFrame:
    """Per row: id, h (text hash), class_id (the smallest id of its group), label (null for texts without words),
    first (whether it is its group's smallest id, and text hash of these; null without a group)."""
    spent = []

    def keep(df: DataFrame) -> DataFrame:
        spent.append(materialize(df))
        return spent[-1]

    rows = keep(signatures(docs, key, text, weighted))
    reps = rows.where("rid IS NOT NULL").groupBy("rid").agg(F.min(F.struct("h", "id")).alias("x"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    reps = keep(reps.select("rid", "x.h", "x.id", "n", "bands", "copies"))
    pairs = reps.select("rid", "n", F.explode("bands").alias("bucket"))
    sizes = keep(pairs.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    hot = hot_keys(sizes, "size", "bucket")
    members = keep(by_key(pairs, bounded_broadcast(sizes), "bucket", hot))
    degree = members.groupBy("rid").agg(F.sum("size").alias("degree"))
    ranked = members.select("bucket", "rid", "n").join(degree, "rid")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "rid", "n")).alias("x")).select("bucket", F.col("x.rid").alias("hub"), F.col("x.n").alias("hub_n"))
    others = by_key(members, bounded_broadcast(keep(hubs)), "bucket", hot).where("rid <> hub")
    # a pair whose sizes differ too much can't be similar
    edges = others.where(F.least("n", "hub_n") >= least * F.greatest("n", "hub_n")).groupBy("rid", "hub").agg(F.max("size").alias("size"))
    edges = keep(star_links(docs, edges, reps, keep, key, text, least, weighted))
    labels = components(edges)
    spent.append(labels)
    rest = others.join(labels, F.col("rid") == F.col("v"), "left").select("bucket", "rid", F.coalesce("label", "rid").alias("label"))
    rest = keep(rest)
    by_label = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    top = F.max_by("label", F.struct("n", "label")).alias("top")
    unsure = by_label.groupBy("bucket").agg(top, F.max("n").alias("n_top"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    unsure = bounded_broadcast(keep(unsure.select("bucket", "top", "n_top", (F.col("n") - F.col("n_top")).alias("n_rest"))))
    more = residual_links(docs, by_key(rest, unsure, "bucket", hot), reps, keep, key, text, least, weighted)
    labels = components(edges.union(more))
    spent.append(labels)
    named = by_key(rows.select("id", "h", "rid"), labels.withColumnRenamed("v", "rid"), "rid", hot_keys(reps, "copies", "rid"), "left")
    named = materialize(named.select("id", "h", F.coalesce("label", "rid").alias("label")))
    for table in spent:
        discard(table)
    smallest = materialize(named.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least_id"), F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    named = by_key(named, smallest.drop("n"), "label", hot_keys(smallest, "n", "label"), "left")
    first = F.when(F.col("first").isNotNull(), F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")))
    class_id = F.when(F.col("least_id").isNull(), F.col("id")).otherwise(F.col("least_id"))
    return named.select("id", "h", class_id.alias("class_id"), "label", first.alias("first"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """One document of each group, the one of smallest id (and text hash), all columns; null and blank texts stay."""
    found = near_duplicates(docs, key, text, least)
    grouped = materialize(found.where("first IS NOT NULL").groupBy("id", "h").agg(F.max("first").alias("first"), F.count("*").alias("n")))
    (h,) = fresh(docs, "text_hash")
    marked = docs.withColumn(h, text_hash(text))
    gone = bounded_broadcast(grouped.where("NOT first OR n > 1").select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h")))
    same = lambda i, g: marked[key].eqNullSafe(i) & (marked[h] == g)
    out = marked.join(gone, same(gone.gone_id, gone.gone_h), "left_anti").drop(h)
    again = grouped.where("first AND n > 1").select(F.col("id").alias("twice_id"), F.col("h").alias("twice_h"))
    if again.limit(1).count():  # rows of one id and text: one of them stays
        again = marked.join(bounded_broadcast(again), same(F.col("twice_id"), F.col("twice_h"))).dropDuplicates(["twice_id", "twice_h"])
        out = out.unionByName(again.select(*(marked[c] for c in docs.columns)))
    return out
