"""Repository analytics over snapshots: tree_entries(snapshot, path, oid, mode, size).

Everything is a join or grouping on path, object id or hash; small rule lists and file-type tables are broadcast.
"""

from __future__ import annotations

import math
import mimetypes
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.scalar import ancestors, extension, file_name, join_path, normalize_path, parent
from stratum.operators.lineage import cut, small

LANES, LANE_BITS = 32, 16
REPORT_SIMILAR = 0.5
CELLS = 1 << LANE_BITS

#: The file types that are told apart here; pass a larger table (extension, name, mime) for more.
FILE_TYPES = (
    ("csv", "Comma-Separated Values", "text/csv"), ("tsv", "Tab Separated Values", "text/tab-separated-values"), ("txt", "Text File", "text/plain"),
    ("json", "JavaScript Object Notation (JSON)", "application/json"), ("md", "Markdown", "text/markdown"), ("html", "HyperText Markup Language (HTML)", "text/html"),
    ("xml", "XML - Extensible Markup Language", "application/xml"), ("pdf", "Adobe Portable Document Format", "application/pdf"), ("png", "Portable Network Graphics (PNG)", "image/png"),
    ("jpg", "JPEG Image", "image/jpeg"), ("py", "Python Source File", "text/x-python"), ("parquet", "Apache Parquet", "application/vnd.apache.parquet"),
    ("zip", "Zip Archive", "application/zip"), ("twb", "Tableau Workbook", "application/twb"), ("tds", "Tableau Datasource", "application/tds"),
)
OCTETS = "application/octet-stream"


def file_type_table(df: DataFrame, types=FILE_TYPES) -> DataFrame:
    """The named types, then what Python's own mime table knows under a name made from the extension."""
    named = {t[0] for t in types}
    rest = [(ext[1:], f"{ext[1:].upper()} File", mime) for ext, mime in sorted(mimetypes.MimeTypes(()).types_map[True].items()) if ext[1:] not in named]
    return df.sparkSession.createDataFrame([*types, *rest], "ext string, type_name string, mime string")


def classify(df: DataFrame, path: str = "path", types: DataFrame | None = None) -> DataFrame:
    """All columns and ext, type_name, mime by the path's extension (letter case counts)."""
    rows = df.withColumn("ext", extension(path))
    types = small(types) if types is not None else F.broadcast(file_type_table(df))  # a fixed list
    name = F.when(F.col("ext") == "", "Unknown").otherwise(F.coalesce("type_name", F.concat(F.lit("Unknown (."), F.col("ext"), F.lit(")"))))
    return rows.join(types, "ext", "left").withColumn("type_name", name).withColumn("mime", F.coalesce("mime", F.lit(OCTETS)))


def dir_summary(df: DataFrame, path: str = "path", recursive: bool = False) -> DataFrame:
    """folder, ext, count of files with an extension; recursive: for every folder above a file, the root being ''."""
    rows = df.select(F.explode(ancestors(path)).alias("folder") if recursive else parent(path).alias("folder"), extension(path).alias("ext"))
    return rows.where("ext <> ''").groupBy("folder", "ext").agg(F.count("*").alias("count"))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status (added, deleted, modified), old_oid, new_oid, old_size, new_size of what differs."""
    a = before.select("path", F.col("oid").alias("old_oid"), F.col("size").alias("old_size"))
    b = after.select("path", F.col("oid").alias("new_oid"), F.col("size").alias("new_size"))
    status = F.when(F.col("old_oid").isNull(), "added").when(F.col("new_oid").isNull(), "deleted").otherwise("modified")
    return a.join(b, "path", "full_outer").where(~F.col("old_oid").eqNullSafe(F.col("new_oid"))).select("path", status.alias("status"), "old_oid", "new_oid", "old_size", "new_size")


def repo_size(tree: DataFrame) -> DataFrame:
    """n_files and bytes, a pointer (is_pointer, filesize) counting as what it points to."""
    size = F.when(F.col("is_pointer"), F.col("filesize")).otherwise(F.col("size"))
    return tree.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def detailed_repo_size(before: DataFrame, after: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: repo_bytes and stored_bytes after a commit (what all files hold, what their blocks hold), and its stats."""
    used = usage.join(after.select("oid").distinct(), "oid", "left_semi")
    blocks = used.groupBy("cas_hash").agg(F.max("bytes").alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("stored_bytes"))
    files = after.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("repo_bytes"), F.count("*").alias("n_files"))
    return files.crossJoin(blocks).crossJoin(commit_stats(before, after, usage))  # one row each


def commit_stats(before: DataFrame, after: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: what a commit adds. usage(oid, cas_hash, bytes) says which blocks a file uses.

    new_blocks and new_block_bytes: blocks that no file before used; modified_bytes: bytes of changed files;
    bytes_in_new: of these in new blocks; reused_bytes: the rest; saved_bytes: what files of the commit share.
    """
    prev = usage.join(before.select("oid").distinct(), "oid", "left_semi").select("cas_hash").distinct()
    changed = tree_diff(before, after).where("new_oid IS NOT NULL").select("path", F.col("new_oid").alias("oid"))
    used = changed.join(usage, "oid").join(prev.withColumn("old", F.lit(True)), "cas_hash", "left")
    new = F.col("old").isNull()
    per_block = used.groupBy("cas_hash").agg(F.sum("bytes").alias("b"), F.max("bytes").alias("once"), F.first("old").alias("old"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return per_block.agg(
        F.count_if(new).alias("new_blocks"), zero(F.sum(F.when(new, F.col("once")))).alias("new_block_bytes"), zero(F.sum("b")).alias("modified_bytes"),
        zero(F.sum(F.when(new, F.col("b")))).alias("bytes_in_new"), zero(F.sum(F.when(~new, F.col("b")))).alias("reused_bytes"), zero(F.sum(F.when(new, F.col("b") - F.col("once")))).alias("saved_bytes"),
    )


def block_usage(segments: DataFrame, by: str = "oid") -> DataFrame:
    """by, cas_hash, bytes: how much of each block a file's segments (start, end) use; combined map-side."""
    return segments.groupBy(by, "cas_hash").agg(F.sum(F.col("end") - F.col("start")).alias("bytes"))


def transaction(tree: DataFrame, log: DataFrame, cancelled: bool = False) -> DataFrame:
    """The tree after a log of operations as a whole, or as it was: if the log is cancelled, or if an operation's source
    is not in the tree."""
    if not cancelled:
        needed = log.where("op IN ('delete', 'copy', 'move')").select(F.col("src").alias("path"))
        if not needed.join(tree.select("path"), "path", "left_anti").limit(1).count():
            return apply_log(tree, log)
    return tree.select("path", "oid", "size")


def file_coverage(changed: DataFrame, usage: DataFrame, new_blocks: DataFrame) -> DataFrame:
    """path, bytes, new_bytes of changed files (path, oid)."""
    marked = changed.join(usage, "oid").join(new_blocks.select("cas_hash").distinct().withColumn("new", F.lit(1)), "cas_hash", "left")
    return marked.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.col("bytes") * F.col("new")), F.lit(0)).alias("new_bytes"))


def minhash_lanes(parts: DataFrame, by: str, hash_col: str = "hash") -> DataFrame:
    """by, lanes: the least of each of 32 16-bit slices over a file's part hashes.

    The first 16 slices are of the hash, the others of the hash's hash; one aggregation, combined map-side.
    """
    twice = F.sha2(F.col(hash_col), 256)
    lane = lambda h, k: F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("int")
    mins = [F.min(lane(F.col(hash_col) if k < 16 else F.col("__twice"), k % 16)).alias(f"l{k}") for k in range(LANES)]
    rows = parts.select(by, hash_col, twice.alias("__twice")).groupBy(by).agg(*mins)
    return rows.select(by, F.array(*(f"l{k}" for k in range(LANES))).alias("lanes"))


def lane_similarity(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / LANES


def most_similar(lanes: DataFrame, by: str, least: float = REPORT_SIMILAR) -> DataFrame:
    """by, other, similarity: for each file the most similar other (smallest name on ties), if at least so similar.

    Files with the same 32 lanes are each other's best and stand for one signature in the rest. Two signatures that
    agree on so many lanes agree on one of the rarest few of each (as many as may differ, and one more), whatever the
    order of rareness is, if it is one for all: signatures meet by an equi-join on those lanes and their values, where
    their lanes are compared in full at once; pairs that are not so similar are not written. The order is that of counts
    in a table of fixed size, 65,536 cells for each lane.
    """
    few = min(LANES, LANES - math.ceil(least * LANES) + 1)
    lanes = cut(lanes)
    groups = cut(lanes.groupBy("lanes").agg(F.min(by).alias("__rep"), F.count("*").alias("__n")))
    pair = lanes.join(groups.where("__n > 1"), "lanes")
    second = pair.where(F.col(by) != F.col("__rep")).groupBy("lanes").agg(F.min(by).alias("__second"))
    same = pair.join(second, "lanes").select(by, F.when(F.col(by) == F.col("__rep"), F.col("__second")).otherwise(F.col("__rep")).alias("other"), F.lit(1.0).alias("similarity"))
    tokens = _rarest(groups, few).select("__rep", "__n", "lanes", F.explode("__rarest").alias("__token"))
    left = tokens.where("__n = 1").select(F.col("__rep").alias("__a"), F.col("lanes").alias("__la"), "__token")
    right = tokens.select(F.col("__rep").alias("__b"), F.col("lanes").alias("__lb"), "__token")
    agree = reduce(add, (F.col("__la")[k].eqNullSafe(F.col("__lb")[k]).cast("int") for k in range(LANES)))
    pairs = left.join(right, "__token").where("__a <> __b").select("__a", "__b", (agree / LANES).alias("s")).where(F.col("s") >= least)
    best = pairs.groupBy("__a").agg(F.min(F.struct((-F.col("s")).alias("s"), "__b")).alias("x"))
    return same.unionByName(best.select(F.col("__a").alias(by), F.col("x.__b").alias("other"), (-F.col("x.s")).alias("similarity")))


def _rarest(groups: DataFrame, few: int) -> DataFrame:
    """Signatures (all without nulls) with __rarest: their rarest few lanes with their values, each as a number; without
    those that no other signature has."""
    groups = groups.where(~F.exists("lanes", lambda x: x.isNull()))
    cell = lambda k: F.col("lanes")[k].bitwiseAND(CELLS - 1) + k * CELLS
    counts = groups.select(F.explode(F.array(*(cell(k) for k in range(LANES)))).alias("c")).groupBy("c").agg(F.count("*").alias("n")).where("n > 1").toPandas()
    often = np.ones(LANES * CELLS, np.int64)
    often[counts["c"].to_numpy()] = counts["n"].to_numpy()
    shared = groups.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = batch.column(batch.schema.names.index("lanes")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, LANES)
            n = shared.value[(lanes & CELLS - 1) + np.arange(LANES) * CELLS]
            token = np.arange(LANES) << 32 | lanes & 0xFFFFFFFF
            order = np.lexsort((token, n), axis=1)[:, :few]
            n, token = np.take_along_axis(n, order, 1), np.take_along_axis(token, order, 1)
            kept = n > 1
            ends = pa.array(np.concatenate([[0], kept.sum(1).cumsum()]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(token[kept], pa.int64()))], [*batch.schema.names, "__rarest"])

    return groups.mapInArrow(run, T.StructType([*groups.schema.fields, T.StructField("__rarest", T.ArrayType(T.LongType()))]))


def match_rules(paths: DataFrame, rules: DataFrame, default: str | None = None) -> DataFrame:
    """path, strategy by the longest rule that is the path or a folder above it; '*' is the default rule.

    The path's ancestors are joined to the rules by equality, so no pair of path and rule is compared.
    """
    steps = F.concat(ancestors("path"), F.array("path", F.lit("*")))
    hits = paths.select("path", F.explode(steps).alias("rule")).join(small(rules.select(F.col("path").alias("rule"), "strategy")), "rule")
    best = hits.groupBy("path").agg(F.max_by("strategy", F.struct(F.when(F.col("rule") == "*", -1).otherwise(F.length("rule")), "rule")).alias("strategy"))
    return paths.select("path").join(best, "path", "left").select("path", F.coalesce("strategy", F.lit(default)).alias("strategy"))


def parse_rules(lines: DataFrame, text: str = "line") -> DataFrame:
    """strategy, path of rule lines; blank lines and those from '#' on are comments."""
    t = F.trim(F.regexp_replace(text, "#.*$", ""))
    return lines.where(t.rlike(r"^(?i)(smudge|pointer)\s+\S")).select(F.upper(F.regexp_extract(t, r"^(\S+)", 1)).alias("strategy"), F.regexp_replace(F.regexp_extract(t, r"^\S+\s+(.*)$", 1), "/+$", "").alias("path"))


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Paths with more than one strategy."""
    return rules.groupBy("path").agg(F.countDistinct("strategy").alias("n")).where("n > 1")


def path_list(paths: DataFrame, listed: DataFrame, inside: str, outside: str) -> DataFrame:
    """path, strategy: one for paths on a list, another for the rest."""
    return paths.join(listed.select("path").distinct().withColumn("__in", F.lit(True)), "path", "left").select("path", F.when(F.col("__in"), inside).otherwise(outside).alias("strategy"))


def apply_log(tree: DataFrame, log: DataFrame) -> DataFrame:
    """The snapshot after a log (seq, op, src, dst, oid, size): put, delete, copy and move of single paths.

    Sources are read from the snapshot before; per path the last operation counts.
    """
    source = tree.select(F.col("path").alias("src"), F.col("oid").alias("s_oid"), F.col("size").alias("s_size"))
    rows = log.join(source, "src", "left")
    puts = rows.where("op IN ('put', 'copy', 'move')").select(F.col("dst").alias("path"), "seq", F.coalesce("oid", "s_oid").alias("oid"), F.coalesce("size", "s_size").alias("size"))
    gone = rows.where("op IN ('delete', 'move')").select(F.col("src").alias("path"), "seq", F.lit(None).cast("string").alias("oid"), F.lit(None).cast("long").alias("size"))
    last = puts.unionByName(gone).groupBy("path").agg(F.max_by(F.struct("oid", "size"), F.struct("seq", F.col("oid").isNotNull())).alias("x"))
    kept = tree.select("path", "oid", "size").join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.where("x.oid IS NOT NULL").select("path", "x.oid", "x.size"))


def copy_plan(tree: DataFrame, source: str, dest: str, recursive: bool = False) -> DataFrame:
    """src, dst of copying a file, folder or glob (in the last component) to a place of the tree.

    A folder copies only if recursive: into an existing folder under its own name, else as the folder that is named. A
    file goes into a folder that exists or is written with a slash; a folder cannot take a file's place.
    """
    as_folder, target = dest.endswith("/"), dest.rstrip("/")
    kind = tree.agg(F.max(F.when(F.col("path") == target, 1).when(F.col("path").startswith(f"{target}/") if target else F.lit(True), 2)).alias("k")).first()["k"]
    is_folder = kind == 2 or not target
    here = source.rstrip("/")
    if "*" in source:
        base, _, pattern = source.rpartition("/")
        if "*" in base:
            raise ValueError("a wildcard may only stand in the last component")
        regex = "^" + "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in r"\.[]{}()+-^$|" else ch for ch in pattern) + "$"
        rest = F.col("path") if not base else F.substring("path", F.lit(len(base) + 2), F.length("path"))
        rows = tree.where(F.col("path").startswith(f"{base}/") if base else F.lit(True))
        first = F.split_part(rest, F.lit("/"), F.lit(1))
        rows = rows.where(first.rlike(regex) & (F.lit(recursive) | ~rest.contains("/")))
        if kind == 1:
            raise ValueError("several files cannot take the place of one")
        return rows.select(F.col("path").alias("src"), join_path(F.lit(target), rest).alias("dst"))
    file = tree.where(F.col("path") == here).limit(1).count()
    if file and not source.endswith("/"):
        dst = join_path(F.lit(target), file_name("path")) if as_folder or is_folder else F.lit(target)
        return tree.where(F.col("path") == here).select(F.col("path").alias("src"), dst.alias("dst"))
    rows = tree.where(F.col("path").startswith(f"{here}/"))
    if not rows.limit(1).count():
        raise ValueError(f"{source} does not exist")
    if not recursive:
        raise ValueError("a folder needs a recursive copy")
    if kind == 1:
        raise ValueError("a folder cannot take the place of a file")
    under = f"{target}/{here.rpartition('/')[2]}" if is_folder and target else here.rpartition("/")[2] if is_folder else target
    return rows.select(F.col("path").alias("src"), F.concat(F.lit(f"{under}/"), F.substring("path", F.lit(len(here) + 2), F.length("path"))).alias("dst"))


def chart_dependencies(charts: DataFrame, tree: DataFrame) -> DataFrame:
    """chart, data_path of charts (path, json) whose data URLs are relative and name a file of the tree."""
    rows = charts.where(F.col("path").endswith(".vg.json") | F.col("path").endswith(".vl.json"))
    one = F.get_json_object("json", "$.data.url")
    many = F.from_json(F.get_json_object("json", "$.data"), "array<struct<url:string>>")
    urls = F.when(one.isNotNull(), F.array(one)).otherwise(F.transform(many, lambda x: x.url))
    urls = rows.select("path", F.explode(F.array_distinct(urls)).alias("url")).where(F.col("url").isNotNull() & ~F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^//"))
    wanted = urls.select(F.col("path").alias("chart"), normalize_path(F.when(F.col("url").startswith("/"), F.col("url")).otherwise(join_path(parent("path"), "url"))).alias("data_path"))
    return wanted.join(tree.select(F.col("path").alias("data_path")).distinct(), "data_path", "left_semi").select("chart", "data_path")


def reachable(edges: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """root, node: all that is reached from roots (root) along edges (src, dst); cycles end."""
    edges = edges.select("src", "dst").distinct()
    done = front = cut(roots.select("root", F.col("root").alias("node")).distinct())
    for _ in range(rounds):
        new = front.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = cut(new.join(done, ["root", "node"], "left_anti"))
        if front.isEmpty():
            return done
        done = done.unionByName(front)
    raise ValueError("the graph is deeper than the allowed rounds")


def roots_and_cycles(edges: DataFrame) -> DataFrame:
    """node, kind: 'root' for nodes without an incoming edge, 'cycle' for those that reach themselves."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    roots = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("kind", F.lit("root"))
    starts = edges.select(F.col("src").alias("root"), F.col("dst").alias("root_dst")).distinct()
    reach = reachable(edges, starts.select(F.col("root_dst").alias("root")).distinct()).withColumnRenamed("root", "root_dst")
    cycles = starts.join(reach, "root_dst").where("node = root").select("node").distinct().withColumn("kind", F.lit("cycle"))
    return roots.unionByName(cycles)


def resolve(asked: DataFrame, local: DataFrame, remote: DataFrame, key: str, value: str, policy: str = "local_first") -> DataFrame:
    """key, value from the local table, the remote one, or the local and then the remote one."""
    if policy not in ("local_first", "local_only", "remote_only"):
        raise ValueError(f"no such policy: {policy}")
    a, b = local.select(key, F.col(value).alias("__l")), remote.select(key, F.col(value).alias("__r"))
    rows = asked.select(key).distinct()
    if policy != "remote_only":
        rows = rows.join(a, key, "left")
    if policy != "local_only":
        rows = rows.join(b, key, "left")
    return rows.select(key, F.coalesce(*(x for x in ("__l", "__r") if x in rows.columns)).alias(value))


def last_by(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
