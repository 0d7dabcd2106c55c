"""Operators of the engine against small reference models, properties and case tables."""

import collections
import json
import math
import random
import statistics

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.functions import scalar as S
from stratum.operators import chunks as C
from stratum.operators import dedup as D
from stratum.operators import merkle as M
from stratum.operators import profile as P
from stratum.operators import repository as R
from stratum.operators import summaries as U
from stratum.operators import workbook as W
from stratum.sources import readers as I


class StreamingHistogram:
    """Values one by one: 20 bins whose scale doubles around its centre."""

    def __init__(self):
        self.bins, self.scale = [0] * 20, None

    def add(self, v):
        if self.scale is None:
            self.scale = math.nextafter(v, -math.inf), math.nextafter(v, math.inf)
        a, b = self.scale
        while v < a or v > b:
            new = [0] * 20
            for i, n in enumerate(self.bins):
                new[5 + i // 2] += n
            self.bins, half = new, max((b - a) / 2, 2.0**-52)
            a, b = self.scale = a - half, b + half
        self.bins[min(19, int((v - a) / (b - a) * 20))] += 1


@pytest.mark.parametrize("values", [[9, 1, 2, 3, 4, 5, 6, 7, 8, 5, 8, 8, 8, 8], [float(x) for x in np.random.default_rng(0).random(3000)]])
def test_histogram_equals_streaming(spark, values):
    s = StreamingHistogram()
    for v in values:
        s.add(float(v))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    r = P.profile(df, ["v"], ["i"]).first()
    assert (r.scale_min, r.scale_max) == s.scale and sum(abs(a - b) for a, b in zip(r.bin_counts, s.bins)) <= 2
    assert r.n == len(values) and math.isclose(r.avg, statistics.fmean(values)) and math.isclose(r["var"], statistics.variance(values))


def test_special_values_and_merge(spark):
    nan, inf = float("nan"), float("inf")
    values = [-25, 100.5, -350.2, nan, 234.1, inf, 98.6, nan, 87.1, -87.2, -inf, -240.3, inf, nan]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    r = P.moments(df, ["v"], ["i"]).first()
    assert (r.nan_count, r.neg_inf, r.pos_inf, r.n) == (3, 1, 2, 8)
    both = P.combine_moments(P.moments(df.where("i < 5"), ["v"], ["i"]), P.moments(df.where("i >= 5"), ["v"], ["i"])).first()
    assert all(math.isclose(both[k], r[k]) for k in ("avg", "var", "std", "min", "max")) and both.n == 8
    empty = P.profile(df.where("i < 0"), ["v"], ["i"]).first()
    assert empty.n == 0 and empty.bin_counts is None and empty["var"] is None


def test_items(spark):
    rows = [(str(j), "x" * 60) for j in range(100) for _ in range(j + 1)]
    df = spark.createDataFrame(rows, "a string, b string")
    counts = P.item_counts(df, ["a", "b"])
    merged = P.merge_items(counts, counts)
    top = P.top_items(merged)
    got = {r.item: r["count"] for r in top.where("column = 'a'").collect()}
    assert len(got) == 50 and all(n == 2 * (int(i) + 1) for i, n in got.items())
    assert top.where("column = 'b'").first().item == "x" * 50 + "..."
    assert {r.item for r in P.heavy_hitters(df, "a", 0.0195).collect()} == {"98", "97", "99"}
    assert {r.item for r in P.approximate_items(df, "a", 3).collect()} == {"99", "98", "97"}


def test_cut_text_keeps_characters(spark):
    t = spark.createDataFrame([("aé漢😀z",), ("",), (None,)], "t string")
    for n in range(12):
        got = [r[0] for r in t.select(P.cut_text("t", n)).collect()]
        x = "aé漢😀z"
        want = x if len(x.encode()) <= n else max((x[:i] for i in range(6) if len(x[:i].encode()) <= n), key=len) + "..."
        assert got == [want, "", None]


def test_int_scale():
    assert P.final_int_scale(0, 2, 0, 2) == (-9, 11)
    a, b = P.final_int_scale(0, 2, -1000, 50)
    assert a <= -1000 and b >= 50 and (b - a) % 20 == 0
    a, b = P.final_int_scale(0, 2, -(2**63), 2**63 - 1)
    assert -(2**63) <= a and b < 2**63
    with pytest.raises(ValueError):
        P.final_int_scale(0, 1, 0, 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\t é漢\n', max_size=6), min_size=1, max_size=4), min_size=1, max_size=5), st.lists(st.integers(0, 80), max_size=5))
def test_table_parser_split_anywhere(rows, cuts):
    rows = [r for r in rows if r != [""]] or [["x"]]
    data = "".join(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\n" for r in rows).encode()
    parser, out, at = I.TableParser(), [], 0
    for c in sorted(min(c, len(data)) for c in cuts):
        out += parser.feed(data[at:c])
        at = c
    assert out + parser.feed(data[at:], True) == rows


def test_headers_and_files(spark, tmp_path):
    assert I.infer_header(["C1", ""]) == (["C1", ""], True) and I.infer_header(["1", "x"]) == (["Column 0", "Column 1"], False)
    assert I.delimiter("a.tsv") == "\t" and I.delimiter("comma") == ","
    (tmp_path / "a.csv").write_text('h1,h2\n1,"x,y"\n2\n3,4,5\n')
    (tmp_path / "b.tsv").write_bytes(b" 1\t2\n\xff\t4")
    cells = I.read_table_files(spark, str(tmp_path)).collect()
    got = {(r.file.rsplit("/", 1)[1], r.row, r.name): r.value for r in cells}
    assert got == {("a.csv", 0, "h1"): "1", ("a.csv", 0, "h2"): "x,y", ("a.csv", 1, "h1"): "2", ("a.csv", 2, "h1"): "3", ("a.csv", 2, "h2"): "4",
                   ("b.tsv", 0, "Column 0"): "1", ("b.tsv", 0, "Column 1"): "2", ("b.tsv", 1, "Column 0"): "�", ("b.tsv", 1, "Column 1"): "4"}
    assert I.directory_size(I.list_files(spark, str(tmp_path))).first().n_files == 2


def test_chunks_properties(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000).astype(np.uint8).tobytes()
    for target, hashers in ((1024, 1), (4096, 8), (16384, 8)):
        cuts = C.cut_points(data, target, hashers)
        sizes = np.diff([0, *cuts])
        assert cuts[-1] == len(data) and sizes.max() <= target * 8 and (sizes[:-1] >= hashers * (target // hashers // 4 - 64)).all()
        assert target / 3 < sizes[:-1].mean() < target * 3
    one = C.cut_points(data, 1024)
    moved = C.cut_points(data[:1000] + b"inserted" + data[1000:], 1024)
    assert len({c - 8 for c in moved} & set(one)) > 0.9 * len(one)
    with pytest.raises(ValueError):
        C.cut_points(b"x", 1000)
    h = C.gear_hashes(np.frombuffer(data[:500], np.uint8), C.gear(7))
    x, table = 0, [int(v) for v in C.gear(7)]
    for i in range(500):
        x = (x * 2 + table[data[i]]) % 2**64
        if i >= 64:
            assert (int(h[i]) - x) % 2**64 == 0
    df = spark.createDataFrame([(1, data), (2, b""), (3, None), (4, b"ab")], "id int, data binary")
    parts = C.content_chunks(df, "id", "data", 1024, 1, with_bytes=True).orderBy("file_id", "seq").collect()
    assert b"".join(p.bytes for p in parts if p.file_id == 1) == data and {p.file_id for p in parts} == {1, 4}


def test_clean_round_trip(spark):
    rng = random.Random(2)
    base = bytes(rng.randrange(256) for _ in range(9000))
    files = {1: base, 2: base[:5000] + b"new" + base[5000:], 3: b"hello world", 4: b"hello world", 5: b"", 6: bytes(3000)}
    df = spark.createDataFrame(list(files.items()), "id int, data binary")
    store = D.clean(df, "id", "data", 256, 1, block_target=2000)
    hashes = {r.file_id: r.file_hash for r in store["pointers"].collect()}
    got = {r.file_hash: bytes(r.bytes) for r in D.reconstruct(store["file_segments"], store["cas_data"]).collect()}
    assert all(got[hashes[i]] == files[i] for i in hashes) and set(hashes) == {1, 2, 3, 4, 6} and hashes[3] == hashes[4]
    part = {r.file_hash: bytes(r.bytes) for r in D.reconstruct(store["file_segments"], store["cas_data"], 3, 3).collect()}
    assert part[hashes[3]] == b"lo "
    stored = store["cas_blocks"].agg(F.sum("bytes")).first()[0]
    assert stored < sum(map(len, files.values())) * 0.7


def test_blocks_meet_segments_by_page(spark):
    rng = random.Random(7)
    blocks = {"a": rng.randbytes(3 * D.PAGE), "b": rng.randbytes(100), "e": b""}
    n, p = len(blocks["a"]), D.PAGE
    parts = {"f": [("a", p - 5, p + 5), ("b", 0, 100), ("a", 0, n), ("a", p, 2 * p)], "g": [("b", 7, 7), ("a", n - 1, n), ("a", n, n), ("e", 0, 0)], "h": [("e", 0, 0)]}
    seg = spark.createDataFrame([(f, i, *x) for f, xs in parts.items() for i, x in enumerate(xs)], "file_hash string, seq int, cas_hash string, start long, end long")
    data = spark.createDataFrame(list(blocks.items()), "cas_hash string, bytes binary")
    whole = {f: b"".join(blocks[c][s:e] for c, s, e in xs) for f, xs in parts.items()}
    assert {r.file_hash: bytes(r.bytes) for r in D.reconstruct(seg, data).collect()} == whole
    assert {r.file_hash: bytes(r.bytes) for r in D.reconstruct(seg, data, p, p + 9).collect()} == {"f": whole["f"][p : 2 * p + 9]}
    assert D.pieces(seg, data).agg(F.max(F.octet_length("piece"))).first()[0] <= p


def test_greedy_cover(spark):
    runs = [(1, 0, "a", 5, 3), (1, 1, "b", 0, 6), (1, 9, "c", 2, 1), (1, 9, "b", 9, 1)]
    df = spark.createDataFrame(runs, "file_id int, first_seq long, cas_hash string, first_idx long, n_chunks long")
    got = [tuple(r)[1:] for r in D.greedy_cover(df).orderBy("first_seq").collect()]
    assert got == [(0, "a", 5, 3), (3, "b", 2, 4), (9, "b", 9, 1)]


def test_merkle(spark):
    leaves = [(S_hash(i), 10 + i) for i in range(100)]
    assert M.root([]) == "0" * 64 and M.root(leaves[:1]) == leaves[0][0]
    for groups in M.tree(leaves):
        assert all(1 <= len(g) <= 9 for g in groups) and all(len(g) >= 3 for g in groups[:-1])
    df = spark.createDataFrame([(f, i, *leaves[i]) for f in (1, 2) for i in range(60 + f * 20)], "file_id int, seq int, hash string, len long")
    edges = M.merkle_edges(df).cache()
    roots = {r.file_id: r for r in M.merkle_roots(df).collect()}
    found = M.descendants(edges, spark.createDataFrame([(r.root,) for r in roots.values()], "root string")).collect()
    for f, r in roots.items():
        mine = sorted((x.off, x.node, x.len) for x in found if x.root == r.root)
        assert [(n, s) for _, n, s in mine] == leaves[: 60 + f * 20] and all(a[0] + a[2] == b[0] for a, b in zip(mine, mine[1:]))
    assert M.violations(edges).count() == 0
    broken = edges.withColumn("child_len", F.when((F.col("pos") == 0) & (F.col("level") == 0), 1).otherwise(F.col("child_len")))
    assert M.violations(broken).where("rule = 'hash'").count() > 0
    up = M.ancestors(edges, spark.createDataFrame([(leaves[5][0],)], "node string"), spark.createDataFrame([(roots[1].root,)], "node string")).collect()
    assert [(r.ancestor, r.off) for r in up] == [(roots[1].root, sum(n for _, n in leaves[:5]))]
    whole = M.reconstruct_between(edges, spark.createDataFrame([(roots[1].root,)], "root string"), df.where("file_id = 1").select(F.col("hash").alias("node")).distinct())
    assert whole.count() == 80
    assert M.reconstruct_between(edges, spark.createDataFrame([(roots[1].root,)], "root string"), df.where("seq < 9").select(F.col("hash").alias("node")).distinct()).count() == 0


def S_hash(i):
    import hashlib

    return hashlib.sha256(str(i).encode()).hexdigest()


def test_node_sets(spark):
    schema = "hash string, len long, children array<string>, attributes int"
    a = spark.createDataFrame([("p", 3, ["x", "y"], 1), ("x", 1, [], 0), ("y", 2, [], 0)], schema)
    b = spark.createDataFrame([("p", 3, [], 2), ("x", 1, [], 0)], schema)
    u = {r.hash: (r.children, r.attributes) for r in M.union_nodes(a, b).collect()}
    assert u == {"p": (["x", "y"], 3), "x": ([], 0), "y": ([], 0)}
    assert sorted(r.hash for r in M.difference_nodes(a, b).collect()) == ["p", "x", "y"]


def test_pack(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 1, 10, 11, 1])] + [("h", 0, 3)], "g string, i int, s long")
    bins = lambda over: [r.bin for r in D.pack(df, "g", "i", "s", 10, over).where("g = 'g'").orderBy("i").collect()]
    assert bins(True) == [0, 0, 0, 1, 1, 2] and bins(False) == [0, 0, 1, 1, 2, 3]


def test_equal_compacted_groups_stay_apart(spark, tmp_path):
    from stratum.plans.queries import QUERIES

    orders = spark.range(40 * 400).select((F.col("id") % 40).alias("o_custkey"), F.floor(F.col("id") / 40).alias("o_orderkey"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    assert [tuple(r) for r in QUERIES["store_compaction"](spark, str(tmp_path)).collect()] == [(400, 20)]
    rows = spark.createDataFrame([(f"s{i}", k) for i in range(6) for k in range(4 if i < 4 else i)], "shard string, k long")
    shards = rows.groupBy("shard").agg(F.count("*").alias("size")).withColumn("mtime", F.substring("shard", 2, 1).cast("int"))
    got = D.compacted(rows, D.compact(shards, 8), ["k"]).collect()
    assert collections.Counter(r.bin for r in got) == {0: 4, 1: 4, 2: 5}
    assert len({r.shard for r in got}) == 2 and len({(r.bin, r.k) for r in got}) == len(got)


def test_store_algebra(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(D.union_stores(a, b, "k")) == [(1, "a"), (2, "a"), (3, "b")]
    assert rows(D.union_stores(a, b, "k", "second")) == [(1, "a"), (2, "b"), (3, "b")]
    assert rows(D.difference_stores(a, b, "k")) == [(3, "b")] and rows(D.difference_stores(a, a, "k")) == []
    assert rows(D.union_stores(a, a, "k")) == rows(a)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_script(a, b):
    steps = U.edit_script(a, b)
    assert [x for s, x, _ in steps if s != "add"] == a
    assert [(x if s == "none" else y) for s, x, y in steps if s != "delete"] == b
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
    assert sum(s == "none" for s, _, _ in steps) == lcs[-1][-1]


def test_arguments():
    assert [U.check_arguments(), U.check_arguments("a", "a"), U.check_arguments("a", "b"), U.check_arguments(None, None, "x", "x"), U.check_arguments("a", None, "x", "x")] == [1, 5, 0, 5, 0]


def test_dir_summary(spark):
    paths = "foo/text_1.txt foo/bar/text_2.txt foo/bar/text_3.txt foo/rebar/text_4.txt morefoo/text_5.txt morefoo/bar/text_6.txt noext .hidden".split()
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    flat = {r.folder: r["count"] for r in R.dir_summary(df).collect()}
    assert flat == {"foo/bar": 2, "foo/rebar": 1, "foo": 1, "morefoo/bar": 1, "morefoo": 1}
    deep = {r.folder: r["count"] for r in R.dir_summary(df, recursive=True).collect()}
    assert (deep["foo"], deep["morefoo"], deep[""]) == (4, 2, 6)


def test_copy_plans(spark):
    tree = spark.createDataFrame([(p,) for p in ("a/x.txt", "a/y.csv", "a/b/z.txt", "d/e.txt", "f")], "path string")
    plan = lambda *x, **k: {(r.src, r.dst) for r in R.copy_plan(tree, *x, **k).collect()}
    assert plan("f", "new") == {("f", "new")} and plan("f", "new/") == {("f", "new/f")} and plan("f", "d") == {("f", "d/f")}
    assert plan("a", "d", recursive=True) == {("a/x.txt", "d/a/x.txt"), ("a/y.csv", "d/a/y.csv"), ("a/b/z.txt", "d/a/b/z.txt")}
    assert plan("a", "n", recursive=True) == {("a/x.txt", "n/x.txt"), ("a/y.csv", "n/y.csv"), ("a/b/z.txt", "n/b/z.txt")}
    assert plan("a/*.txt", "n") == {("a/x.txt", "n/x.txt")}
    for bad in (("a", "d"), ("q", "d"), ("*/x", "d")):
        with pytest.raises(ValueError):
            R.copy_plan(tree, *bad)
    with pytest.raises(ValueError):
        R.copy_plan(tree, "a", "f", recursive=True)


def test_pointers_and_ranges(spark):
    h = "ab" * 32
    good = f"# pointer version 0\nfilesize = 5\nhash = '{h}'\n"
    texts = [good, good.replace("version 0", "version 1"), good.replace("5", "-5"), "hash = 'x'", "", good + " " * 200, f"# pointer version 0\nhash = '{h}'\nfilesize = 7\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0].is_valid for r in df.select(S.parse_pointer("t")).collect()] == [True, False, False, False, False, False, True]
    part = spark.createDataFrame([(b"hello world",)], "d binary").select(S.paged("d", F.lit(3), F.lit(3)).alias("x"), S.paged("d", F.lit(8), F.lit(9)).alias("y")).first()
    assert (bytes(part.x.bytes), part.x.eof, bytes(part.y.bytes), part.y.eof) == (b"lo ", False, b"rld", True)
    start = spark.createDataFrame([("é".encode(),), ("a漢".encode()[:-1],), (b"\xff123",), (b"",)], "d binary")
    assert [r[0] for r in start.select(S.may_start_text("d")).collect()] == [True, True, False, True]


def test_formulas():
    names = {("[s]", "[a]"): "Amount", ("", "[b]"): "Bee"}
    sub = lambda t: W.substitute_columns(t, lambda s, c: names.get((s, c)))
    assert sub("SUM([s].[a]) + [b]") == ("SUM([Amount]) + [Bee]", [("[s]", "[a]"), ("", "[b]")])
    assert sub("[x].[y] .. [b]")[0] == "[x].[y] .. [Bee]" and sub("[a [b]]") == (None, []) and sub("[a") == (None, []) and sub("plain") == ("plain", [])


def test_most_similar(spark):
    parts = [(f, S_hash(i)) for f, r in (("a", range(40)), ("b", range(40)), ("c", range(2, 42)), ("d", range(100, 140))) for i in r]
    lanes = R.minhash_lanes(spark.createDataFrame(parts, "f string, hash string"), "f")
    sig = {r.f: r.lanes for r in lanes.collect()}
    got = {r.f: (r.other, r.similarity) for r in R.most_similar(lanes, "f").collect()}
    assert got["a"] == ("b", 1.0) and got["b"] == ("a", 1.0) and "d" not in got
    assert got["c"] == ("a", sum(x == y for x, y in zip(sig["c"], sig["a"])) / 32)


def test_most_similar_meets_on_rare_lanes(spark):
    rng = random.Random(3)
    # the first half of the lanes is that of hundreds of files, of which few agree on another one
    sigs = {f"f{i:03d}": [k if k < 15 or i % 2 and k < 17 else rng.randrange(1 << 16) for k in range(32)] for i in range(400)}
    sigs |= {f"g{i}": [*sigs[f"f{i:03d}"][:32 - i], *(rng.randrange(1 << 16) for _ in range(i))] for i in range(20)} | {"h": list(range(32))}
    lanes = spark.createDataFrame(list(sigs.items()), "f string, lanes array<int>")
    want = {}
    for a, x in sigs.items():
        n, b = min((-sum(p == q for p, q in zip(x, y)), b) for b, y in sigs.items() if b != a)
        if n <= -16:
            want[a] = (b, -n / 32)
    assert {r.f: (r.other, r.similarity) for r in R.most_similar(lanes, "f").collect()} == want
    few = R._rarest(lanes.groupBy("lanes").agg(F.min("f").alias("f")), 17).select(F.explode("__rarest").alias("t")).groupBy("t").count()
    assert few.agg(F.max("count")).first()[0] < 300


def test_streams(spark, tmp_path):
    from stratum.streaming import watch as T

    notes, store = str(tmp_path / "notes"), str(tmp_path / "store")
    fold = T.fold_notes(store, "k")
    for v, rows in enumerate([[(1, "a"), (2, "a")], [(2, "b"), (3, "b")]]):
        spark.createDataFrame(rows, "k int, v string").write.mode("append").parquet(notes)
        T.watch(spark, notes, "k int, v string", fold, str(tmp_path / "check")).awaitTermination()
        assert {(r.k, r.v) for r in spark.read.parquet(f"{store}/v{v}").collect()} == ({(1, "a"), (2, "a")} if v == 0 else {(1, "a"), (2, "b"), (3, "b")})
    spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "k string, v double").write.parquet(str(tmp_path / "values"))
    stream = T.running_profile(spark.readStream.schema("k string, v double").parquet(str(tmp_path / "values")), "k", "v")
    q = stream.writeStream.format("memory").queryName("running").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n, r.avg, r["var"]) for r in spark.table("running").collect()} == {("x", 2, 2.0, 2.0), ("y", 1, 5.0, 0.0)}


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", ["profile_moments", "profile_histogram", "frequent_items", "dir_summary_recursive", "commit_stats", "dedup_runs", "most_similar", "change_map"])
def test_queries_agree_with_sql(spark, name):
    import os

    from stratum.plans.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    out = con.execute(SQL[name])
    at = [x[0] for x in out.description]
    assert got == sorted(repr([norm(r[at.index(c)]) for c in cols]) for r in out.fetchall())


def test_graphemes_stay_whole(spark):
    s = "\U0001F91A\U0001F3FEa\U0001F91A "
    df = spark.createDataFrame([(s,)], "x string")
    for limit, kept in ((0, ""), (7, ""), (8, s[:2]), (9, s[:3]), (10, s[:3]), (18, s)):
        want = kept if kept == s or len(s.encode()) <= limit else kept + "..."
        assert df.select(P.cut_text("x", limit).alias("y")).first().y == want


def test_sketch_ranges_hold(spark):
    rng = random.Random(3)
    values = [min(int(rng.paretovariate(0.8)), 400) for _ in range(4000)]
    parts = [values[k::3] for k in range(3)]
    true = collections.Counter(map(str, values))
    merged = P.merge_sketches(*(P.sketch(spark.createDataFrame([(v,) for v in p], "v int"), ["v"], 15) for p in parts), capacity=15)
    rows = {r["item"]: r for r in merged.collect()}
    assert len(rows) == 16 and all(r["n"] == 4000 for r in rows.values())
    assert all(r.count_min <= true[i] <= r.count_max for i, r in rows.items() if i is not None)
    assert all(n <= rows[None].count_max for i, n in true.items() if i not in rows)
    sure = {r["item"] for r in P.frequent(merged, 0.05, guaranteed=True).collect()}
    assert sure <= {i for i, n in true.items() if n >= 200} <= {r["item"] for r in P.frequent(merged, 0.05).collect()}
    exact = P.sketch(spark.createDataFrame([(v,) for v in values], "v int"), ["v"])
    assert {r["item"]: r.count_min for r in exact.collect() if r["item"]} == dict(true)
    assert P.sketch(spark.createDataFrame([], "v int"), ["v"]).count() == 0


def test_runs_through_a_very_common_chunk(spark):
    files = [(f, k, "blank" if k % 3 == 1 else f"{f % 5}-{k}") for f in range(40) for k in range(9)] + [(99, k, "blank") for k in range(4)]
    left = spark.createDataFrame(files, "file_id long, seq int, hash string")
    store = left.select(F.concat(F.lit("b"), F.lpad(F.col("file_id").cast("string"), 2, "0")).alias("cas_hash"), F.col("seq").cast("long").alias("idx"), F.col("hash").alias("chunk_hash"), (F.col("seq") * 10).cast("long").alias("start"), F.lit(10).cast("long").alias("len"))
    runs = D.dedup_runs(left, store.where("cas_hash < 'b07' OR cas_hash = 'b99'"))
    got = {(r.file_id, r.cas_hash, r.first_seq, r.n_chunks) for r in runs.collect()}
    assert {(f, f"b0{f % 5}", 0, 9) for f in range(40)} <= got  # whole files, through the blank lines
    hot = D.dedup_runs(left, store)
    assert hot.where("n_chunks = 1").groupBy("file_id", "first_seq").count().agg(F.max("count")).first()[0] <= 8
    assert hot.where("file_id = 99").count() <= 4 * 8


def test_captions_given_twice(spark):
    cols = spark.createDataFrame([("f", "d", "[a]", "A", "", "t"), ("f", "d", "[a]", "B", "", "t"), ("f", "d", "[k]", "K", "1 + 2", ""), ("f", "d", "[s]", "S", "[a] + [k]", ""), ("f", "d", "[u]", "U", "[a] * 2", "")], "file string, datasource string, column string, caption string, formula string, table string")
    text = W.formula_captions(cols)
    assert {r["column"]: r.formula_text for r in text.collect()} == {"[k]": "1 + 2", "[s]": "[A] + [K]", "[u]": "[A] * 2"}
    assert {r["column"]: r["table"] for r in W.calculated_tables(cols, text).collect()} == {"[k]": "", "[s]": "", "[u]": "t"}


def test_rings_and_exports(spark, tmp_path):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"))
    hosts = ["a", "b", "c"]
    whole = {r.k: r.h for r in df.select("k", S.server_of("k", hosts).alias("h")).collect()}
    less = {r.k: r.h for r in df.select("k", S.server_of("k", hosts[:2]).alias("h")).collect()}
    assert set(whole.values()) == set(hosts) and all(less[k] == h for k, h in whole.items() if h != "c")
    with pytest.raises(ValueError):
        S.ring([])
    seg = spark.createDataFrame([("f1", 0, "c1", 0, 5), ("f2", 0, "c2", 0, 5)], "file_hash string, seq long, cas_hash string, start long, end long")
    ch = spark.createDataFrame([("c1", 0, "h1"), ("c2", 0, "h2")], "cas_hash string, idx long, chunk_hash string")
    out = I.export_standalone(seg, ch, "f1")
    assert [tuple(r) for r in I.import_standalone(out, "segment", "file_hash string, seq long, cas_hash string, start long, end long").collect()] == [("f1", 0, "c1", 0, 5)]
    assert [r.chunk_hash for r in I.import_standalone(out, "chunk", "cas_hash string, idx long, chunk_hash string").collect()] == ["h1"]
    for name in ("s1", "s2"):
        I.write_store({"cas_chunks": ch, "file_segments": seg}, str(tmp_path / name), rows_per_file=1)
    many = I.read_store(spark, str(tmp_path / "*"), ["cas_chunks"])["cas_chunks"]
    assert sorted((r.store, r.cas_hash) for r in many.collect()) == [(s, k) for s in ("s1", "s2") for k in ("c1", "c2")]
    assert I.store_name(ch, ["cas_hash", "idx"]) == I.store_name(ch.orderBy(F.desc("idx")).repartition(3), ["cas_hash", "idx"]) != I.store_name(ch.limit(1), ["cas_hash", "idx"])
    I.append_notes(ch, str(tmp_path / "notes"))
    I.append_notes(ch.limit(1), str(tmp_path / "notes"))
    assert spark.read.parquet(str(tmp_path / "notes")).count() == 3
    assert [json.loads(r.value)["idx"] for r in I.to_json_lines(ch).collect()] == [0, 0]


def test_changes_roll_up(spark):
    rows = [
        ("datasource", "", "d", "", "none"), ("group", "d", "g", "", "none"), ("filter", "g", "x", "0", "none"), ("filter", "g", "y", "0.1", "none"), ("filter", "g", "z", "0.1.0", "change"),
        ("datasource", "", "e", "", "none"), ("column", "e", "c", "", "none"), ("dashboard", "", "b", "", "none"), ("zone", "b", "z", "0", "add"), ("worksheet", "", "w", "", "delete"), ("rows", "w", "r", "", "delete"), ("datasource", "", "f", "", "add"), ("column", "f", "c", "", "add"),
    ]
    got = {(r.kind, r.name, r.path): r.status for r in W.rolled_up(spark.createDataFrame(rows, "kind string, parent string, name string, path string, status string")).collect()}
    want = {(k, n, p): s for k, _, n, p, s in rows}
    want |= {x: "change" for x in (("filter", "y", "0.1"), ("filter", "x", "0"), ("group", "g", ""), ("datasource", "d", ""), ("dashboard", "b", ""))}
    assert got == want
    one = spark.createDataFrame([([f"c{k}" for k in range(51)], [1] * 51), (["a"], [1, 2]), (["a"], [1])], "h array<string>, s array<int>")
    assert [r.w for r in one.select(U.table_warnings(F.col("h"), F.col("s")).alias("w")).collect()] == [["wide"], ["unequal"], []]
