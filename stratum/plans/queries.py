"""Registered queries of the engine over the test tables, each next to the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
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
from stratum.streaming import watch as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- column profiles -------------------------------------------------------------------------------------------------

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_UNPIVOT = "SELECT * FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME c VALUE v)"


@query(f"""
WITH u AS ({_UNPIVOT})
SELECT c AS "column", count(v) AS n, count(*) FILTER (isnan(v)) AS nan_count, min(v) AS min, max(v) AS max, round(avg(v), 4) AS avg, round(var_samp(v), 3) AS var,
  arg_min(v, l_orderkey * 100 + l_linenumber) AS first FROM u GROUP BY c""")
def profile_moments(spark, sf_dir):
    m = P.moments(table(spark, sf_dir, "lineitem"), NUMBERS, ["l_orderkey", "l_linenumber"])
    return m.select("column", "n", "nan_count", "min", "max", F.round("avg", 4).alias("avg"), F.round("var", 3).alias("var"), "first")


@query(f"""
WITH RECURSIVE u AS ({_UNPIVOT}),
m AS (SELECT c, arg_min(v, l_orderkey * 100 + l_linenumber) AS f, min(v) AS lo, max(v) AS hi FROM u GROUP BY c),
s AS (
  SELECT c, nextafter(f, '-inf'::DOUBLE) AS a, nextafter(f, 'inf'::DOUBLE) AS b, lo, hi FROM m
  UNION ALL SELECT c, a - greatest((b - a) / 2, pow(2.0, -52)), b + greatest((b - a) / 2, pow(2.0, -52)), lo, hi FROM s WHERE lo < a OR hi > b),
z AS (SELECT c, a, b FROM s WHERE lo >= a AND hi <= b)
SELECT c AS "column", least(floor((v - a) / (b - a) * 20), 19)::INTEGER AS bin, count(*) AS count FROM u JOIN z USING (c) GROUP BY ALL""")
def profile_histogram(spark, sf_dir):
    p = P.profile(table(spark, sf_dir, "lineitem"), NUMBERS, ["l_orderkey", "l_linenumber"])
    return p.select("column", F.posexplode("bin_counts").alias("bin", "count")).where("count > 0")


@query()
def profile_lineitem(spark, sf_dir):
    return P.profile(table(spark, sf_dir, "lineitem"), [*NUMBERS, "l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("""
WITH v AS (SELECT unnest([1.5, 'nan'::DOUBLE, 'inf'::DOUBLE, '-inf'::DOUBLE, NULL, -25.0]) AS x FROM region)
SELECT 'x' AS "column", count(x) FILTER (isfinite(x)) AS n, count(*) FILTER (isnan(x)) AS nan_count, count(*) FILTER (x = 'inf'::DOUBLE) AS pos_inf,
  count(*) FILTER (x = '-inf'::DOUBLE) AS neg_inf, min(x) FILTER (isfinite(x)) AS min, max(x) FILTER (isfinite(x)) AS max FROM v""")
def profile_special_values(spark, sf_dir):
    x = F.explode(F.array(*(F.lit(v) for v in (1.5, float("nan"), float("inf"), float("-inf"), None, -25.0))))
    return P.moments(table(spark, sf_dir, "region").select(x.alias("x")), ["x"], ["x"]).select("column", "n", "nan_count", "pos_inf", "neg_inf", "min", "max")


@query("""
SELECT 'v' AS "column", count(*) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 4) AS avg, round(var_samp(l_quantity), 3) AS var FROM lineitem""")
def profile_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("v"))
    a, b = (P.moments(rows.where((F.col("l_orderkey") % 3 == 0) == side), ["v"], ["l_orderkey"]) for side in (True, False))
    return P.combine_moments(a, b).select("column", "n", "min", "max", F.round("avg", 4).alias("avg"), F.round("var", 3).alias("var"))


@query("""
WITH RECURSIVE m AS (SELECT min(p_partkey) AS lo, max(p_partkey) AS hi FROM part),
s AS (SELECT -9::BIGINT AS a, 11::BIGINT AS b, lo, hi FROM m UNION ALL SELECT a - (b - a) // 2, b + (b - a) // 2, lo, hi FROM s WHERE lo < a OR hi > b),
z AS (SELECT a, b FROM s WHERE lo >= a AND hi <= b)
SELECT least(floor((p_partkey - a)::DOUBLE / (b - a) * 20), 19)::INTEGER AS bin, count(*) AS count FROM part, z GROUP BY ALL""")
def int_histogram(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    r = d.agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi")).first()
    scale = P.final_int_scale(0, 2, r.lo, r.hi)
    return P.histograms(d, {"p_partkey": scale}).select("bin", "count")


def _top(table_name: str, column: str) -> str:
    return f"SELECT '{column}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, {column})::INTEGER AS rank, {column} AS item, count(*) AS count FROM {table_name} WHERE {column} IS NOT NULL GROUP BY {column} QUALIFY rank <= 50"


@query(" UNION ALL ".join(f"({_top(t, x)})" for t, x in (("part", "p_type"), ("part", "p_brand"), ("orders", "o_orderpriority"), ("events", "event_type"))))
def frequent_items(spark, sf_dir):
    parts = P.item_counts(table(spark, sf_dir, "part"), ["p_type", "p_brand"])
    return P.top_items(P.merge_items(parts, P.item_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"]), P.item_counts(table(spark, sf_dir, "events"), ["event_type"])))


@query("""
WITH c AS (SELECT l_partkey AS item, count(*) AS count FROM lineitem GROUP BY 1), t AS (SELECT sum(count)::BIGINT AS total FROM c)
SELECT item, count, count AS count_min, count AS count_max FROM c, t WHERE count >= greatest(1, floor(total * 0.0006))""")
def heavy_hitters(spark, sf_dir):
    return P.heavy_hitters(table(spark, sf_dir, "lineitem"), "l_partkey", 0.0006)


@query()
def approximate_items(spark, sf_dir):
    return P.approximate_items(table(spark, sf_dir, "lineitem"), "l_returnflag", 3)


_EMOJI = "\U0001F91A\U0001F3FEa\U0001F91Ae\u0301"


@query(f"""
WITH t AS (SELECT p_partkey, substr(p_name, 1, (p_partkey % 9)::INTEGER) || '{_EMOJI}' || p_name AS x FROM part),
k AS (SELECT p_partkey, x, max(n) AS n FROM (SELECT p_partkey, x, unnest(range(0, 13)) AS n FROM t) WHERE strlen(substring_grapheme(x, 1, n)) <= 12 GROUP BY ALL)
SELECT p_partkey, CASE WHEN strlen(x) <= 12 THEN x ELSE substring_grapheme(x, 1, n) || '...' END AS name FROM k""")
def cut_text(spark, sf_dir):
    text = F.concat(F.expr("substring(p_name, 1, int(p_partkey % 9))"), F.lit(_EMOJI), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", P.cut_text(text, 12).alias("name"))


_HALF = """c{0} AS (SELECT l_suppkey::VARCHAR AS item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey::VARCHAR) AS r FROM lineitem WHERE l_linenumber % 2 = {0} GROUP BY 1),
k{0} AS (SELECT * FROM c{0} WHERE r <= 40), m{0} AS (SELECT coalesce(max(n), 0) AS missed FROM c{0} WHERE r = 41)"""
_MERGED = f"""WITH {_HALF.format(0)}, {_HALF.format(1)}, b AS (SELECT m0.missed + m1.missed AS missed FROM m0, m1),
u AS (SELECT item, (coalesce(k0.n, 0) + coalesce(k1.n, 0))::BIGINT AS count_min, (coalesce(k0.n, m0.missed) + coalesce(k1.n, m1.missed))::BIGINT AS count_max
  FROM k0 FULL JOIN k1 USING (item), m0, m1),
o AS (SELECT *, row_number() OVER (ORDER BY count_max DESC, count_min DESC, item) AS r FROM u)"""


def _merged(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    parts = [P.sketch(li.where(F.col("l_linenumber") % 2 == k), ["l_suppkey"], 40) for k in (0, 1)]
    return P.merge_sketches(*parts, capacity=40)


@query(f"""{_MERGED}
SELECT item, count_min, count_max, (SELECT count(*) FROM lineitem) AS n FROM o WHERE r <= 40
UNION ALL SELECT NULL, 0, greatest((SELECT missed FROM b), coalesce((SELECT max(count_max) FROM o WHERE r = 41), 0)), (SELECT count(*) FROM lineitem)""")
def sketch_merge(spark, sf_dir):
    return _merged(spark, sf_dir).drop("column")


@query(f"""{_MERGED}, l AS (SELECT greatest(1, floor(count(*) * 0.008)) AS least FROM lineitem)
SELECT item, count_min, count_max, count_min >= least AS guaranteed FROM o, l WHERE r <= 40 AND count_max >= least""")
def sketch_frequent(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    sure = P.frequent(merged, 0.008, guaranteed=True).select("item", F.lit(True).alias("sure"))
    return P.frequent(merged, 0.008).join(sure, "item", "left").select("item", "count_min", "count_max", F.coalesce("sure", F.lit(False)).alias("guaranteed"))


@query("""
WITH u AS (SELECT * FROM (UNPIVOT (SELECT p_partkey, p_size::VARCHAR AS p_size, p_brand::VARCHAR AS p_brand, p_retailprice::VARCHAR AS p_retailprice FROM part) ON p_size, p_brand, p_retailprice INTO NAME c VALUE v)),
n AS (SELECT c, count(TRY_CAST(v AS DOUBLE)) AS n, min(TRY_CAST(v AS DOUBLE)) AS min, round(avg(TRY_CAST(v AS DOUBLE)), 4) AS avg FROM u GROUP BY c),
k AS (SELECT c, v, count(*) AS k, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS r FROM u GROUP BY c, v)
SELECT n.c AS "column", n.n, n.min, n.avg, string_agg(v || ':' || k, ',' ORDER BY r) AS top FROM n JOIN k ON k.c = n.c AND r <= 5 WHERE n.c <> 'p_retailprice' GROUP BY ALL""")
def column_profiles(spark, sf_dir):
    p = P.column_profiles(table(spark, sf_dir, "part"), ["p_size", "p_brand"], ["p_partkey"], 5)
    return p.select("column", "n", "min", F.round("avg", 4).alias("avg"), F.array_join(F.transform("top", lambda x: F.concat(x.item, F.lit(":"), x.count_max)), ",").alias("top"))


@query("""
WITH c AS (SELECT event_type AS file, 0 AS col, 'user' AS name, event_id AS "row", user_id::VARCHAR AS value FROM events UNION ALL SELECT event_type, 1, 'value', event_id, round(value, 1)::VARCHAR FROM events),
t AS (SELECT file, col, value, count(*) AS k, row_number() OVER (PARTITION BY file, col ORDER BY count(*) DESC, value) AS r FROM c WHERE value IS NOT NULL GROUP BY file, col, value),
s AS (SELECT file, col, name, count(*) AS cells, count(TRY_CAST(value AS DOUBLE)) AS n, min(TRY_CAST(value AS DOUBLE)) AS min, max(TRY_CAST(value AS DOUBLE)) AS max, arg_min(TRY_CAST(value AS DOUBLE), "row") AS first FROM c GROUP BY file, col, name)
SELECT s.file, s.col, any_value(name) AS name, any_value(cells) AS cells, any_value(n) AS n, any_value(min) AS min, any_value(max) AS max, any_value(first) AS first, string_agg(value || ':' || k, ',' ORDER BY r) AS top
FROM s JOIN t ON t.file = s.file AND t.col = s.col AND r <= 3 GROUP BY s.file, s.col""")
def cell_profiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cell = lambda col, name, v: F.struct(F.lit(col).alias("col"), F.lit(name).alias("name"), v.cast("string").alias("value"))
    cells = e.select(F.col("event_type").alias("file"), F.col("event_id").alias("row"), F.inline(F.array(cell(0, "user", F.col("user_id")), cell(1, "value", F.round("value", 1)))))
    p = P.cell_profiles(cells, 3)
    return p.select("file", "col", "name", "cells", "n", "min", "max", "first", F.array_join(F.transform("top", lambda x: F.concat(x.item, F.lit(":"), x["count"])), ",").alias("top"))


_SPELLED = ("1", " 1", "1 ", "1d", "1.", ".5", "-2e3", "nan", "-nan", "Infinity", "x", "", "+7.25")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in zip(_SPELLED, (1.0, "NULL", "NULL", "NULL", 1.0, 0.5, -2000.0, "NULL", "NULL", "NULL", "NULL", "NULL", 7.25))) + ") t(spelled, number)")
def strict_numbers(spark, sf_dir):
    x = S.strict_double("spelled")
    return spark.createDataFrame([(t,) for t in _SPELLED], "spelled string").select("spelled", P.finite(x).alias("number"))


# --- files and folders -----------------------------------------------------------------------------------------------

_EXT = "CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.json' WHEN 3 THEN '.tsv' WHEN 4 THEN '.foo' ELSE '' END"
_TREE = f"SELECT doc_id, source || '/' || lang || '/d' || doc_id || {_EXT} AS path, sha256(text) AS oid, strlen(text)::BIGINT AS size FROM documents"
_A, _B = f"SELECT * FROM ({_TREE}) WHERE doc_id % 3 <> 0", f"SELECT * REPLACE (CASE WHEN doc_id % 10 = 1 THEN sha256(oid) ELSE oid END AS oid) FROM ({_TREE}) WHERE doc_id % 5 <> 0"


def tree(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.expr(_EXT)
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), ext)).alias("path"), S.data_hash("text").alias("oid"), F.octet_length("text").cast("long").alias("size"))


def two_trees(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = tree(spark, sf_dir)
    return t.where("doc_id % 3 <> 0"), t.where("doc_id % 5 <> 0").withColumn("oid", F.when(F.col("doc_id") % 10 == 1, F.sha2("oid", 256)).otherwise(F.col("oid")))


@query(f"""
WITH t AS (SELECT *, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM ({_TREE}))
SELECT ext, CASE ext WHEN '' THEN 'Unknown' WHEN 'txt' THEN 'Text File' WHEN 'csv' THEN 'Comma-Separated Values' WHEN 'json' THEN 'JavaScript Object Notation (JSON)'
  WHEN 'tsv' THEN 'Tab Separated Values' ELSE 'Unknown (.' || ext || ')' END AS type_name, count(*) AS n FROM t GROUP BY ALL""")
def file_types(spark, sf_dir):
    return R.classify(tree(spark, sf_dir)).groupBy("ext", "type_name").agg(F.count("*").alias("n"))


@query(f"SELECT folder, ext, count(*) AS count FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM ({_TREE})) WHERE ext <> '' GROUP BY folder, ext")
def dir_summary(spark, sf_dir):
    return R.dir_summary(tree(spark, sf_dir))


@query(f"""
WITH t AS (SELECT path, regexp_extract(path, '\\.([^./]*)$', 1) AS ext, string_split(path, '/') AS p FROM ({_TREE})),
u AS (SELECT ext, p, unnest(range(0, len(p))) AS k FROM t WHERE ext <> '')
SELECT array_to_string(p[1:k], '/') AS folder, ext, count(*) AS count FROM u GROUP BY ALL""")
def dir_summary_recursive(spark, sf_dir):
    return R.dir_summary(tree(spark, sf_dir), recursive=True)


_RULES = (("SMUDGE", "*"), ("POINTER", "src1"), ("SMUDGE", "src1/en"), ("POINTER", "src2/de/d7.csv"), ("POINTER", "src"))


@query(f"""
WITH r(strategy, rule) AS (VALUES {', '.join(map(str, _RULES))}), t AS ({_TREE})
SELECT path, arg_max(strategy, CASE WHEN rule = '*' THEN -1 ELSE length(rule) END) AS strategy FROM t JOIN r ON rule = '*' OR path = rule OR starts_with(path, rule || '/') GROUP BY path""")
def lazy_rules(spark, sf_dir):
    return R.match_rules(tree(spark, sf_dir), spark.createDataFrame(list(_RULES), "strategy string, path string"))


@query("SELECT 'a/b' AS path, 2::BIGINT AS n")
def rule_conflicts(spark, sf_dir):
    lines = spark.createDataFrame([("smudge a/b/ # twice",), ("POINTER a/b",), ("pointer c",), ("# none",), ("",)], "line string")
    return R.rule_conflicts(R.parse_rules(lines))


@query(f"SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'in' ELSE 'out' END AS strategy FROM ({_TREE})")
def path_list(spark, sf_dir):
    t = tree(spark, sf_dir)
    return R.path_list(t, t.where("doc_id % 7 = 0"), "in", "out")


@query(f"""
WITH a AS ({_A}), b AS ({_B})
SELECT path, CASE WHEN a.oid IS NULL THEN 'added' WHEN b.oid IS NULL THEN 'deleted' ELSE 'modified' END AS status, a.oid AS old_oid, b.oid AS new_oid, a.size AS old_size, b.size AS new_size
FROM a FULL JOIN b USING (path) WHERE a.oid IS DISTINCT FROM b.oid""")
def tree_diff(spark, sf_dir):
    return R.tree_diff(*two_trees(spark, sf_dir))


@query(f"SELECT count(*) AS n_files, sum(CASE WHEN doc_id % 4 = 0 THEN size * 10 ELSE size END)::BIGINT AS bytes FROM ({_TREE})")
def repo_size(spark, sf_dir):
    t = tree(spark, sf_dir).withColumn("is_pointer", F.col("doc_id") % 4 == 0)
    return R.repo_size(t.withColumn("filesize", F.col("size") * 10))


_USAGE = "SELECT DISTINCT sha256(text) AS oid, sha256(substr(text, 1, 40)) AS cas_hash, strlen(text)::BIGINT AS bytes FROM documents"


@query(f"""
WITH a AS ({_A}), b AS ({_B}), u AS ({_USAGE}), prev AS (SELECT DISTINCT cas_hash FROM u JOIN a USING (oid)),
ch AS (SELECT path, b.oid FROM a FULL JOIN b USING (path) WHERE a.oid IS DISTINCT FROM b.oid AND b.oid IS NOT NULL),
x AS (SELECT cas_hash, sum(bytes) AS b, max(bytes) AS once, bool_or(cas_hash IN (SELECT cas_hash FROM prev)) AS old FROM ch JOIN u USING (oid) GROUP BY 1)
SELECT count(*) FILTER (NOT old) AS new_blocks, coalesce(sum(once) FILTER (NOT old), 0)::BIGINT AS new_block_bytes, coalesce(sum(b), 0)::BIGINT AS modified_bytes,
  coalesce(sum(b) FILTER (NOT old), 0)::BIGINT AS bytes_in_new, coalesce(sum(b) FILTER (old), 0)::BIGINT AS reused_bytes, coalesce(sum(b - once) FILTER (NOT old), 0)::BIGINT AS saved_bytes FROM x""")
def commit_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    usage = d.select(S.data_hash("text").alias("oid"), S.data_hash(F.substring("text", 1, 40)).alias("cas_hash"), F.octet_length("text").cast("long").alias("bytes")).distinct()
    return R.commit_stats(*two_trees(spark, sf_dir), usage)


@query(f"""
WITH b AS ({_B}), u AS ({_USAGE}), x AS (SELECT cas_hash, max(bytes) AS m FROM u WHERE oid IN (SELECT oid FROM b) GROUP BY 1)
SELECT (SELECT count(*) FROM b) AS n_files, (SELECT sum(size)::BIGINT FROM b) AS repo_bytes, (SELECT sum(m)::BIGINT FROM x) AS stored_bytes""")
def detailed_repo_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    usage = d.select(S.data_hash("text").alias("oid"), S.data_hash(F.substring("text", 1, 40)).alias("cas_hash"), F.octet_length("text").cast("long").alias("bytes")).distinct()
    return R.detailed_repo_size(*two_trees(spark, sf_dir), usage).select("n_files", "repo_bytes", "stored_bytes")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'local' WHEN c_custkey % 2 = 0 THEN 'remote' END AS v FROM customer")
def lookup_policy(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select("c_custkey")
    side = lambda n, v: k.where(F.col("c_custkey") % n == 0).withColumn("v", F.lit(v))
    return R.resolve(k, side(3, "local"), side(2, "remote"), "c_custkey", "v")


@query(f"""
WITH t AS (SELECT regexp_extract(path, '^src1/([^/]*)', 1) AS name, size FROM ({_TREE}) WHERE starts_with(path, 'src1/'))
SELECT name, 'dir' AS type, sum(size)::BIGINT AS size FROM t GROUP BY name""")
def list_folder(spark, sf_dir):
    return I.children(tree(spark, sf_dir), "src1")


@query("SELECT * FROM (VALUES (33188, 'blob', 'ab12', 10::BIGINT, 'a/é.txt'), (16384, 'tree', 'cd34', NULL, 'dir')) t(mode, type, oid, size, path)")
def tree_listing(spark, sf_dir):
    lines = spark.createDataFrame([('100644 blob ab12      10\t"a/\\303\\251.txt"',), ("040000 tree cd34       -\tdir",), ("nonsense",)], "line string")
    return I.parse_tree_listing(lines)


@query(f"""
WITH t AS ({_TREE}), keep AS (SELECT path, oid, size FROM t WHERE doc_id NOT IN (1, 2)), one AS (SELECT * FROM t WHERE doc_id IN (1, 2, 3))
SELECT * FROM keep WHERE path NOT IN ('new/x') UNION ALL SELECT 'moved', oid, size FROM one WHERE doc_id = 1 UNION ALL SELECT 'copied', oid, size FROM one WHERE doc_id = 3
UNION ALL SELECT 'new/x', repeat('0', 64), 5""")
def operation_log(spark, sf_dir):
    t = tree(spark, sf_dir)
    p = {r.doc_id: r.path for r in t.where("doc_id IN (1, 2, 3)").collect()}
    log = [(1, "move", p[1], "moved", None, None), (2, "delete", p[2], None, None, None), (3, "copy", p[3], "copied", None, None), (4, "put", None, "new/x", "1" * 64, 4), (5, "put", None, "new/x", "0" * 64, 5)]
    return R.apply_log(t, spark.createDataFrame(log, "seq int, op string, src string, dst string, oid string, size long"))


@query(f"SELECT path AS src, 'backup/' || substr(path, 6) AS dst FROM ({_TREE}) WHERE starts_with(path, 'src1/')")
def copy_plan(spark, sf_dir):
    return R.copy_plan(tree(spark, sf_dir), "src1", "backup/", recursive=True)


@query(f"SELECT path AS src, 'src2/' || regexp_extract(path, '([^/]*)$', 1) AS dst FROM ({_TREE}) WHERE regexp_matches(path, '^src1/en/d1[^/]*\\.csv$')")
def copy_plan_glob(spark, sf_dir):
    return R.copy_plan(tree(spark, sf_dir), "src1/en/d1*.csv", "src2")


_CHARTS = (("a/b/x.vg.json", '{"data": {"url": "../../%s"}}'), ("y.vl.json", '{"data": [{"url": "%s"}, {"url": "http://h/z.csv"}]}'), ("z.json", '{"data": {"url": "%s"}}'))


@query(f"WITH t AS ({_TREE}) SELECT c AS chart, path AS data_path FROM t, (VALUES ('a/b/x.vg.json'), ('y.vl.json')) v(c) WHERE doc_id = 1")
def chart_dependencies(spark, sf_dir):
    t = tree(spark, sf_dir)
    one = t.where("doc_id = 1").select(F.col("path").alias("p"))
    charts = spark.createDataFrame(list(_CHARTS), "path string, json string").join(F.broadcast(one)).select("path", F.expr("replace(json, '%s', p)").alias("json"))
    return R.chart_dependencies(charts, t)


_EDGES = "SELECT c_custkey AS src, c_custkey * 2 AS dst FROM customer"


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(root, node) AS (SELECT v, v FROM (VALUES (1::BIGINT), (3::BIGINT)) t(v) UNION SELECT root, dst FROM r JOIN e ON node = src) SELECT root, node FROM r")
def reachable(spark, sf_dir):
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") * 2).alias("dst"))
    return R.reachable(e, spark.createDataFrame([(1,), (3,)], "root long"))


@query("SELECT * FROM (VALUES (1::BIGINT, 'root'), (2::BIGINT, 'cycle'), (3::BIGINT, 'cycle'), (9::BIGINT, 'cycle')) t(node, kind)")
def roots_and_cycles(spark, sf_dir):
    return R.roots_and_cycles(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (9, 9)], "src long, dst long"))


# --- chunks and the content store ------------------------------------------------------------------------------------

_FIXED = "SELECT doc_id, source, (i / 200)::BIGINT AS seq, i AS off, length(substr(text, i + 1, 200))::BIGINT AS len, sha256(substr(text, i + 1, 200)) AS hash FROM (SELECT doc_id, source, text, unnest(range(0, length(text), 200)) AS i FROM documents)"
_LINES = "SELECT doc_id, source, generate_subscripts(x, 1) - 1 AS seq, unnest(x) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents)"
_LINES = f"SELECT doc_id, source, seq, length(line)::BIGINT AS len, sha256(line) AS hash FROM ({_LINES})"


def fixed(spark, sf_dir) -> DataFrame:
    return C.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 200)


def lines(spark, sf_dir) -> DataFrame:
    return C.line_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id AS file_id, seq::INTEGER AS seq, off, len, hash FROM ({_FIXED})")
def chunk_fixed(spark, sf_dir):
    return fixed(spark, sf_dir)


@query(f"SELECT doc_id AS file_id, seq::INTEGER AS seq, len, hash FROM ({_LINES})")
def chunk_lines(spark, sf_dir):
    return lines(spark, sf_dir)


_REPORT = "WITH u AS (SELECT hash, count(*) AS n, max(len) AS len FROM ({}) GROUP BY hash) SELECT sum(n)::BIGINT AS total_chunks, sum(n * len)::BIGINT AS total_bytes, count(*) AS unique_chunks, sum(len)::BIGINT AS unique_bytes, round(sum(len) / sum(n * len), 4) AS dedup_ratio FROM u"


@query(_REPORT.format(_LINES))
def dedup_ratio_lines(spark, sf_dir):
    return C.dedup_report(lines(spark, sf_dir))


@query(_REPORT.format(_FIXED))
def dedup_ratio_fixed(spark, sf_dir):
    return C.dedup_report(fixed(spark, sf_dir))


@query()
def dedup_ratio_content(spark, sf_dir):
    return C.dedup_report(C.content_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 256, 1))


@query(f"SELECT len, count(*) AS count FROM (SELECT hash, max(len) AS len FROM ({_LINES}) GROUP BY hash) GROUP BY len")
def chunk_length_histogram(spark, sf_dir):
    return C.length_histogram(lines(spark, sf_dir))


@query("SELECT doc_id AS file_id, strlen(text)::BIGINT AS bytes FROM documents WHERE text <> ''")
def content_chunk_bytes(spark, sf_dir):
    k = C.content_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 2048, 8)
    return k.groupBy("file_id").agg(F.sum("len").alias("bytes"))


@query()
def chunk_content(spark, sf_dir):
    return C.content_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 1)


@query(f"""SELECT doc_id AS file_id, seq::INTEGER AS seq, len, hash FROM ({_LINES}) WHERE seq = 0 OR ('0x' || substr(hash, 62, 3))::INTEGER % 64 = 0""")
def global_dedup_sample(spark, sf_dir):
    return C.global_dedup_sample(lines(spark, sf_dir), 64)


_STORE = f"SELECT sha256(doc_id::VARCHAR) AS cas_hash, seq AS idx, hash AS chunk_hash, (sum(len) OVER (PARTITION BY doc_id ORDER BY seq) - len)::BIGINT AS start, len FROM ({_LINES})"


def store_chunks(spark, sf_dir) -> DataFrame:
    k = lines(spark, sf_dir).select(S.data_hash(F.col("file_id").cast("string")).alias("cas_hash"), F.col("seq").cast("long").alias("idx"), F.col("hash").alias("chunk_hash"), "len")
    return D.with_offsets(k)


@query(_STORE)
def store_offsets(spark, sf_dir):
    return store_chunks(spark, sf_dir)


@query(f"""
WITH s AS (SELECT *, count(*) OVER (PARTITION BY chunk_hash) AS places, row_number() OVER (PARTITION BY chunk_hash ORDER BY cas_hash, idx) AS place FROM ({_STORE})),
f AS (SELECT doc_id AS file_id, seq, hash AS chunk_hash FROM ({_LINES})),
h AS (SELECT file_id, seq, cas_hash, idx, start, len, seq - idx AS d, places FROM f JOIN s USING (chunk_hash) WHERE place <= 8),
w AS (SELECT DISTINCT file_id, cas_hash, d FROM h WHERE places <= 8),
hot AS (SELECT DISTINCT chunk_hash FROM s WHERE places > 8),
t AS (SELECT f.file_id, f.seq, s.cas_hash, s.idx, s.start, s.len, w.d FROM f JOIN hot USING (chunk_hash) JOIN w ON w.file_id = f.file_id JOIN s ON s.cas_hash = w.cas_hash AND s.idx = f.seq - w.d AND s.chunk_hash = f.chunk_hash),
g AS (SELECT file_id, seq, cas_hash, idx, start, len, d FROM h UNION SELECT * FROM t),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY file_id, cas_hash, d ORDER BY seq) AS island FROM g)
SELECT file_id, cas_hash, min(seq)::INTEGER AS first_seq, min(idx) AS first_idx, count(*) AS n_chunks, min(start) AS start, max(start + len) AS "end" FROM i GROUP BY file_id, cas_hash, d, island""")
def dedup_runs(spark, sf_dir):
    return D.dedup_runs(lines(spark, sf_dir), store_chunks(spark, sf_dir))


@query()
def dedup_cover(spark, sf_dir):
    return D.greedy_cover(dedup_runs(spark, sf_dir))


@query(f"SELECT doc_id AS file_id, seq::INTEGER AS seq, len, hash, (min(seq) OVER (PARTITION BY doc_id, hash))::INTEGER AS first_seq FROM ({_LINES})")
def self_references(spark, sf_dir):
    return D.self_references(lines(spark, sf_dir))


_RANGES = f"SELECT doc_id AS file_hash, seq, sha256((seq // 3)::VARCHAR) AS cas_hash, ((seq % 3) * 10)::BIGINT AS start, ((seq % 3) * 10 + CASE WHEN doc_id % 4 = 0 AND seq % 3 = 1 THEN 5 ELSE 10 END)::BIGINT AS \"end\" FROM ({_LINES})"


def ranges(spark, sf_dir) -> DataFrame:
    r = lines(spark, sf_dir).withColumn("start", ((F.col("seq") % 3) * 10).cast("long"))
    cut = (F.col("file_id") % 4 == 0) & (F.col("seq") % 3 == 1)
    return r.select(F.col("file_id").alias("file_hash"), F.col("seq").cast("long").alias("seq"), S.data_hash(F.floor(F.col("seq") / 3).cast("string")).alias("cas_hash"), "start", (F.col("start") + F.when(cut, 5).otherwise(10)).alias("end"))


@query(f"""
WITH r AS ({_RANGES}), n AS (SELECT *, CASE WHEN lag(cas_hash) OVER w = cas_hash AND lag("end") OVER w = start THEN 0 ELSE 1 END AS nw FROM r WINDOW w AS (PARTITION BY file_hash ORDER BY seq)),
i AS (SELECT *, (sum(nw) OVER (PARTITION BY file_hash ORDER BY seq) - 1)::BIGINT AS island FROM n)
SELECT file_hash, island AS seq, cas_hash, min(start) AS start, max("end") AS "end" FROM i GROUP BY ALL""")
def coalesce_ranges(spark, sf_dir):
    return D.coalesce_ranges(ranges(spark, sf_dir))


@query(f"""
WITH r AS ({_RANGES}), a AS (SELECT *, (sum("end" - start) OVER (PARTITION BY file_hash ORDER BY seq) - ("end" - start))::BIGINT AS pos FROM r)
SELECT file_hash, seq, cas_hash, start + greatest(15 - pos, 0) AS start, start + least(40 - pos, "end" - start) AS "end" FROM a WHERE greatest(15 - pos, 0) < least(40 - pos, "end" - start)""")
def slice_ranges(spark, sf_dir):
    return D.slice_ranges(ranges(spark, sf_dir), 15, 25)


def _two_stores(spark, sf_dir):
    s = lines(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("num_chunks"), F.sum("len").alias("bytes"))
    return s.where("file_id % 2 = 0"), s.where("file_id % 3 = 0").withColumn("bytes", F.col("bytes") + 1)


_TWO = f"s AS (SELECT doc_id AS file_id, count(*) AS num_chunks, sum(len)::BIGINT AS bytes FROM ({_LINES}) GROUP BY 1), a AS (SELECT * FROM s WHERE file_id % 2 = 0), b AS (SELECT file_id, num_chunks, bytes + 1 AS bytes FROM s WHERE file_id % 3 = 0)"


@query(f"WITH {_TWO} SELECT * FROM a UNION ALL SELECT * FROM b WHERE file_id NOT IN (SELECT file_id FROM a)")
def store_union(spark, sf_dir):
    return D.union_stores(*_two_stores(spark, sf_dir), "file_id")


@query(f"WITH {_TWO} SELECT * FROM b UNION ALL SELECT * FROM a WHERE file_id NOT IN (SELECT file_id FROM b)")
def store_union_second(spark, sf_dir):
    return D.union_stores(*_two_stores(spark, sf_dir), "file_id", "second")


@query(f"WITH {_TWO} SELECT * FROM b WHERE file_id NOT IN (SELECT file_id FROM a)")
def store_difference(spark, sf_dir):
    return D.difference_stores(*_two_stores(spark, sf_dir), "file_id")


@query(f"""
WITH s AS (SELECT doc_id, count(*) AS n, sum(len)::BIGINT AS b FROM ({_LINES}) GROUP BY 1)
SELECT sum(b)::BIGINT AS stored, sum(CASE WHEN doc_id % 2 = 0 THEN b // 2 ELSE b END)::BIGINT AS stored_on_disk, count(*) AS n_blocks, sum(n)::BIGINT AS n_chunks, sum(b)::BIGINT AS materialized,
  count(DISTINCT doc_id) AS n_files, count(*) AS n_segments, ((2 * count(*) + count(*) + sum(n)) * 48 + (2 * count(*) + sum(n)) * 12)::BIGINT AS size FROM s""")
def store_totals(spark, sf_dir):
    s = lines(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("num_chunks"), F.sum("len").alias("bytes"))
    blocks = s.withColumn("bytes_on_disk", F.when(F.col("file_id") % 2 == 0, F.floor(F.col("bytes") / 2)).otherwise(0))
    blocks = blocks.withColumn("bytes_on_disk", F.when((F.col("file_id") % 2 == 0) & (F.col("bytes") < 2), None).otherwise(F.col("bytes_on_disk")))
    return D.shard_size(D.store_totals(blocks, s.select(F.col("file_id").alias("file_hash"), F.col("bytes").alias("len"))))


_REFS = "SELECT l_suppkey % 7 AS shard, l_partkey % 5 AS owner, l_linenumber::BIGINT AS chunks FROM lineitem"


@query(f"SELECT * FROM (SELECT shard, owner, least(sum(chunks), 4294967295)::BIGINT AS chunks FROM ({_REFS}) GROUP BY shard, owner) QUALIFY row_number() OVER (PARTITION BY shard ORDER BY chunks DESC, owner) <= 3")
def top_references(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("shard"), (F.col("l_partkey") % 5).alias("owner"), F.col("l_linenumber").cast("long").alias("chunks"))
    return D.top_references(r, 3)


@query(f"SELECT owner, sum(chunks)::BIGINT AS chunks FROM ({_REFS}) GROUP BY owner HAVING sum(chunks) >= 655360000 // 16384")
def shard_hints(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5).alias("owner"), F.col("l_linenumber").cast("long").alias("chunks"))
    return D.shard_hints(r, 655360000)


_SEG = "SELECT 's' || (l_suppkey % 6) AS shard, l_suppkey % 6 AS shard_rank, l_partkey % 50 AS cas_hash, l_orderkey * 10 + l_linenumber AS seq, 2 AS n_chunks FROM lineitem"


@query(f"""
WITH g AS ({_SEG}), o AS (SELECT DISTINCT cas_hash, 's' || r AS owner, r AS owner_rank FROM (SELECT l_partkey % 50 AS cas_hash, l_suppkey % 4 AS r FROM lineitem WHERE l_linenumber = 1)),
j AS (SELECT shard, cas_hash, seq, arg_max(owner, owner_rank) AS owner FROM g JOIN o USING (cas_hash) WHERE owner_rank < shard_rank GROUP BY ALL)
SELECT shard, owner, (2 * count(*))::BIGINT AS chunks FROM j GROUP BY ALL""")
def store_references(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    seg = li.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 6).cast("string")).alias("shard"), (F.col("l_suppkey") % 6).alias("shard_rank"), (F.col("l_partkey") % 50).alias("cas_hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit(2).alias("n_chunks"))
    own = li.where("l_linenumber = 1").select((F.col("l_partkey") % 50).alias("cas_hash"), (F.col("l_suppkey") % 4).alias("owner_rank")).distinct().withColumn("owner", F.concat(F.lit("s"), F.col("owner_rank").cast("string")))
    return D.store_references(seg, own)


@query(f"""
WITH RECURSIVE o AS (SELECT o_custkey % 20 AS g, o_orderkey AS k, o_totalprice::BIGINT AS s, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT g, k, s, i, 0 AS bin, s AS total FROM o WHERE i = 1
  UNION ALL SELECT o.g, o.k, o.s, o.i, CASE WHEN r.total > 1000000 THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.total > 1000000 THEN o.s ELSE r.total + o.s END FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
SELECT g, k, s, bin FROM r""")
def greedy_pack(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("g"), F.col("o_orderkey").alias("k"), F.rint("o_totalprice").cast("long").alias("s"))
    return D.pack(o, "g", "k", "s", 1_000_000)


@query("SELECT doc_id AS file_hash, substr(text, 101, 150) AS part FROM documents WHERE length(text) > 100")
def reconstruct_range(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) > 100").select("doc_id", F.explode(F.sequence(F.lit(0), (F.length("text") - 1).cast("int"), F.lit(200))).alias("off"), "text")
    k = d.select(F.col("doc_id").alias("file_hash"), F.floor(F.col("off") / 200).alias("seq"), F.encode(F.substring("text", F.col("off") + 1, F.lit(200)), "UTF-32").alias("bytes"))
    k = k.withColumn("cas_hash", F.sha2("bytes", 256))
    segments = k.select("file_hash", "seq", "cas_hash", F.lit(0).cast("long").alias("start"), F.octet_length("bytes").cast("long").alias("end"))
    data = k.select("cas_hash", "bytes").dropDuplicates(["cas_hash"])
    return D.reconstruct(segments, data, 4 * 100, 4 * 150).select("file_hash", F.decode("bytes", "UTF-32").alias("part"))


@query("SELECT sha256(text) AS content, count(*) > 0 AS whole FROM documents WHERE text <> '' GROUP BY 1")
def clean_and_reconstruct(spark, sf_dir):
    store = D.clean(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 1)
    seg = store["file_segments"]
    out = D.reconstruct(seg, store["cas_data"])
    return out.groupBy(F.sha2("bytes", 256).alias("content")).agg((F.count("*") > 0).alias("whole"))


def _stored(spark, sf_dir) -> str:
    """A store of all documents, written to the shared folder and read again."""
    from stratum.operators.lineage import cut

    k = cut(store_chunks(spark, sf_dir))
    segments = k.groupBy(F.col("cas_hash").alias("file_hash")).agg(F.lit(0).cast("long").alias("seq"), F.max(F.col("start") + F.col("len")).alias("end"))
    segments = segments.select("file_hash", "seq", F.col("file_hash").alias("cas_hash"), F.lit(0).cast("long").alias("start"), "end", F.col("end").alias("len"))
    blocks = k.groupBy("cas_hash").agg(F.count("*").alias("num_chunks"), F.sum("len").alias("bytes"))
    path = k.inputFiles()[0].rsplit("/", 1)[0] + "-store"
    I.write_store({"file_segments": segments, "cas_chunks": k, "cas_blocks": blocks, "cas_data": blocks.select("cas_hash")}, path)
    return path


@query(f"""
WITH k AS ({_STORE}), b AS (SELECT cas_hash, count(*) AS n, sum(len) AS bytes FROM k GROUP BY 1)
SELECT sum(n)::BIGINT AS n_chunks, sum(bytes)::BIGINT AS bytes, count(*) AS n_blocks, sum(bytes)::BIGINT AS materialized, count(*) AS n_files, true AS same_name FROM b""")
def store_round_trip(spark, sf_dir):
    """A store written and read: its totals, and whether its name is that of what was written."""
    store = I.read_store(spark, _stored(spark, sf_dir))
    totals = D.store_totals(store["cas_blocks"].withColumn("bytes_on_disk", F.lit(0)), store["file_segments"])
    same = I.store_name(store["cas_chunks"], ["cas_hash", "idx", "chunk_hash"]) == I.store_name(store_chunks(spark, sf_dir), ["cas_hash", "idx", "chunk_hash"])
    return totals.select("n_chunks", F.col("stored").alias("bytes"), "n_blocks", "materialized", "n_files", F.lit(same).alias("same_name"))


_SHARDS = "SELECT (o_custkey % 40)::VARCHAR AS shard, o_custkey % 40 AS mtime, o_orderkey % 500 AS k, count(*) AS v FROM orders GROUP BY ALL"


@query(f"""
WITH RECURSIVE r AS ({_SHARDS}), s AS (SELECT shard, mtime, count(*) AS size FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY mtime) AS i FROM s),
g AS (SELECT shard, i, size AS total, 0 AS bin FROM o WHERE i = 1 UNION ALL SELECT o.shard, o.i, CASE WHEN g.total >= 600 THEN o.size ELSE g.total + o.size END, CASE WHEN g.total >= 600 THEN g.bin + 1 ELSE g.bin END FROM g JOIN o ON o.i = g.i + 1),
d AS (SELECT DISTINCT bin, k FROM r JOIN g USING (shard))
SELECT n_keys, count(*) AS n_shards FROM (SELECT bin, count(*) AS n_keys FROM d GROUP BY bin) GROUP BY n_keys""")
def store_compaction(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_custkey") % 40).cast("string").alias("shard"), (F.col("o_custkey") % 40).alias("mtime"), (F.col("o_orderkey") % 500).alias("k")).distinct()
    shards = rows.groupBy("shard", "mtime").agg(F.count("*").alias("size"))
    merged = D.compacted(rows.drop("mtime"), D.compact(shards, 600), ["k"])
    return merged.groupBy("bin").agg(F.count("*").alias("n_keys")).groupBy("n_keys").agg(F.count("*").alias("n_shards"))


@query(f"""
WITH k AS ({_STORE}), f AS (SELECT doc_id, min(hash) AS h FROM ({_LINES}) WHERE doc_id % 3 = 0 GROUP BY doc_id)
SELECT 'd' || doc_id AS path, sum(k.len)::BIGINT AS bytes, (sum(k.len) FILTER (idx % 2 = 0))::BIGINT AS new_bytes FROM ({_LINES}) JOIN k ON k.cas_hash = sha256(doc_id::VARCHAR) AND k.idx = seq GROUP BY doc_id""")
def file_coverage(spark, sf_dir):
    """How many bytes of each file lie in blocks that are new; here every other chunk is a block of its own."""
    k = lines(spark, sf_dir)
    usage = k.select(F.col("file_id").cast("string").alias("oid"), F.concat_ws("-", "file_id", "seq").alias("cas_hash"), F.col("len").alias("bytes"))
    changed = k.select(F.concat(F.lit("d"), F.col("file_id").cast("string")).alias("path"), F.col("file_id").cast("string").alias("oid")).distinct()
    new = k.where("seq % 2 = 0").select(F.concat_ws("-", "file_id", "seq").alias("cas_hash"))
    return R.file_coverage(changed, usage, new)


@query("SELECT c_custkey::VARCHAR AS path, CASE WHEN c_custkey % 2 = 0 THEN 'stored' WHEN c_custkey % 3 = 0 THEN 'computed' END AS summary FROM customer WHERE c_custkey >= 5")
def summary_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_custkey", F.col("c_custkey").alias("file_hash"), F.col("c_custkey").alias("oid"))
    files = I.large_enough(c, "c_custkey", 5)
    stored = c.where("c_custkey % 2 = 0").select("file_hash", F.lit("stored").alias("summary"))
    return U.summary_for(files, stored, c.where("c_custkey % 3 = 0").select("oid", F.lit("computed").alias("summary")))


@query("SELECT 'le' AS kind, o_orderpriority || ', ' || count(*) || ', ' AS value FROM orders GROUP BY o_orderpriority")
def text_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).select("o_orderpriority", "n", F.lit(None).cast("string").alias("x"))
    return I.to_text(o).select(F.lit("le").alias("kind"), "value")


@query("""
SELECT 'orders{priority=' || o_orderpriority || ',status=' || o_orderstatus || '}' AS name, count(*)::DOUBLE AS value FROM orders GROUP BY o_orderpriority, o_orderstatus
UNION ALL SELECT 'prices.le_' || b || '.0', count(*)::DOUBLE FROM orders, (VALUES (1000), (100000), (200000)) t(b) WHERE o_totalprice <= b GROUP BY b""")
def flat_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    counted = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("value"))
    label = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    counted = counted.select(F.lit("orders").alias("name"), label.alias("labels"), "value", F.lit(None).cast("map<double,bigint>").alias("buckets"))
    below = F.map_from_arrays(F.array(*(F.lit(float(b)) for b in (1000, 100000, 200000))), F.array(*(F.count_if(F.col("o_totalprice") <= b) for b in (1000, 100000, 200000))))
    spread = o.agg(below.alias("buckets")).select(F.lit("prices").alias("name"), F.expr("map()").cast("map<string,string>").alias("labels"), F.lit(None).cast("long").alias("value"), F.map_filter("buckets", lambda _, n: n > 0).alias("buckets"))
    return I.flatten_metrics(counted.unionByName(spread), buckets="buckets")


@query("""
WITH p AS (SELECT sha256('h' || h || '#' || k) AS place, 'h' || h AS host FROM range(5) t(h), range(64) u(k)),
f AS (SELECT c_custkey, min(place) AS place FROM customer LEFT JOIN p ON place >= sha256(c_custkey::VARCHAR) GROUP BY c_custkey)
SELECT c_custkey, coalesce(host, (SELECT arg_min(host, place) FROM p)) AS host FROM f LEFT JOIN p USING (place)""")
def hash_ring(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.server_of(F.col("c_custkey").cast("string"), [f"h{k}" for k in range(5)]).alias("host"))


@query("SELECT DISTINCT l_returnflag, CASE l_returnflag WHEN 'R' THEN 'LZ4' WHEN 'N' THEN 'NONE' END AS scheme FROM lineitem")
def compression_schemes(spark, sf_dir):
    spelled = F.when(F.col("l_returnflag") == "R", " lz4").when(F.col("l_returnflag") == "N", "None").otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_returnflag").distinct().select("l_returnflag", S.compression_scheme(spelled).alias("scheme"))


@query("SELECT l_suppkey AS oid, l_partkey % 50 AS cas_hash, sum(l_linenumber * 10)::BIGINT AS bytes FROM lineitem GROUP BY ALL")
def block_usage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("oid"), (F.col("l_partkey") % 50).alias("cas_hash"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_linenumber") * 10).alias("end"))
    return R.block_usage(li)


_SIDE = {t: (f"c_custkey % {m} = 0", f"c_custkey % {n} = 0") for t, m, n in (("csv", 2, 3), ("twb", 5, 5), ("tds", 7, 4))}


@query("WITH r AS (" + " UNION ALL ".join(
    f"SELECT c_custkey, '{t}' AS type, {k} AS k, CASE WHEN NOT ({a}) AND NOT ({b}) THEN 'no_summaries' WHEN ({a}) AND NOT ({b}) THEN 'after_not_found' WHEN ({b}) AND NOT ({a}) THEN 'before_not_found' WHEN c_custkey % 10 = 0 THEN 'diff' ELSE 'no_diff' END AS status FROM customer"
    for k, (t, (a, b)) in enumerate(_SIDE.items())) + """),
g AS (SELECT c_custkey, type, status FROM r WHERE status IN ('diff', 'no_diff')),
w AS (SELECT c_custkey, coalesce(arg_min(status, k) FILTER (status <> 'no_summaries'), 'no_summaries') AS status FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM g) GROUP BY c_custkey)
SELECT * FROM g UNION ALL SELECT c_custkey, NULL, status FROM w""")
def type_diffs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(True).alias("before"), F.lit(True).alias("after"))
    for t, (a, b) in _SIDE.items():
        changed = F.when(F.col("c_custkey") % 10 == 0, "y").otherwise("x")
        c = c.withColumn(f"before_{t}", F.when(F.expr(a), F.lit("x"))).withColumn(f"after_{t}", F.when(F.expr(b), changed))
    return U.type_diffs(c, "c_custkey")


@query(f"SELECT path, repeat('0', 64) AS oid, 1::BIGINT AS size FROM ({_TREE}) WHERE doc_id = 1 UNION ALL SELECT path, oid, size FROM ({_TREE}) WHERE doc_id <> 1")
def transactions(spark, sf_dir):
    """One that is applied, one that is cancelled and one that fails whole."""
    t = tree(spark, sf_dir)
    path = t.where("doc_id = 1").first().path
    schema = "seq int, op string, src string, dst string, oid string, size long"
    good = spark.createDataFrame([(1, "put", None, path, "0" * 64, 1)], schema)
    bad = spark.createDataFrame([(1, "put", None, path, "2" * 64, 2), (2, "delete", "no such path", None, None, None)], schema)
    return R.transaction(R.transaction(R.transaction(t, good), bad), good.withColumn("size", F.lit(9).cast("long")), cancelled=True)


@query("SELECT o_orderkey, substr(o_orderpriority, 3, 4) AS bytes, 2 + 4 >= length(o_orderpriority) AS eof FROM orders")
def paged_read(spark, sf_dir):
    p = S.paged(F.encode("o_orderpriority", "UTF-8"), F.lit(2), F.lit(4))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", F.decode("p.bytes", "UTF-8").alias("bytes"), "p.eof")


@query(f"""
WITH k AS ({_LINES}), last AS (SELECT hash, arg_max('s' || (doc_id % 9), doc_id * 1000 + seq) AS shard FROM k GROUP BY hash)
SELECT doc_id AS file_id, seq::INTEGER AS seq, shard FROM k JOIN last USING (hash) WHERE seq = 0 OR ('0x' || substr(hash, 62, 3))::INTEGER % 64 = 0""")
def global_lookup(spark, sf_dir):
    k = lines(spark, sf_dir)
    salt = b"\1" * 32
    known = k.select(S.salted("hash", F.lit(salt)).alias("salted_hash"), F.concat(F.lit("s"), (F.col("file_id") % 9).cast("string")).alias("shard"), (F.col("file_id") * 1000 + F.col("seq")).alias("seq"))
    return D.global_lookup(known, C.global_dedup_sample(k, 64), salt).select("file_id", "seq", "shard")


@query()
def merkle_roots(spark, sf_dir):
    return M.merkle_roots(lines(spark, sf_dir))


@query()
def merkle_edges(spark, sf_dir):
    return M.merkle_edges(lines(spark, sf_dir))


#: A tree of its own for each customer: three children, whose hash is right, or not, or whose positions have a gap, or one of which has two sizes.
_TREES = """SELECT c_custkey, k AS pos, sha256('leaf' || c_custkey || '-' || k) AS child, 10 + k + CASE WHEN c_custkey % 5 = 3 AND k = 3 THEN 1 ELSE 0 END AS child_len FROM customer, (VALUES (0), (1), (2)) t(k)"""


@query(f"""
WITH e AS ({_TREES}), p AS (SELECT c_custkey, sha256(string_agg(child || ' : ' || child_len || chr(10), '' ORDER BY pos)) AS h FROM e GROUP BY c_custkey)
SELECT 'hash' AS rule, CASE WHEN c_custkey % 5 = 1 THEN sha256(h) END AS node FROM p WHERE c_custkey % 5 = 1
UNION ALL SELECT 'positions', h FROM p WHERE c_custkey % 5 = 2
UNION ALL SELECT 'size', sha256('leaf' || c_custkey || '-0') FROM customer WHERE c_custkey % 5 = 3
UNION ALL SELECT 'hash', sha256('other' || c_custkey) FROM customer WHERE c_custkey % 5 = 3""")
def merkle_violations(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    leaf = lambda k: F.struct(F.lit(k).alias("pos"), F.sha2(F.concat(F.lit("leaf"), key, F.lit(f"-{k}")), 256).alias("child"), F.lit(10 + k).cast("long").alias("child_len"))
    trees = table(spark, sf_dir, "customer").select("c_custkey", F.array(*(leaf(k) for k in range(3))).alias("kids"))
    text = F.array_join(F.transform("kids", lambda x: F.concat(x.child, F.lit(" : "), x.child_len.cast("string"), F.lit("\n"))), "")
    kind = F.col("c_custkey") % 5
    edges = trees.withColumn("parent", F.when(kind == 1, F.sha2(F.sha2(text, 256), 256)).otherwise(F.sha2(text, 256))).select("c_custkey", "parent", F.inline("kids"))
    edges = edges.withColumn("pos", F.col("pos") + F.when((kind == 2) & (F.col("pos") == 2), 1).otherwise(0)).select("c_custkey", "parent", "pos", "child", "child_len")
    twice = edges.where((kind == 3) & (F.col("pos") == 0)).select("c_custkey", F.sha2(F.concat(F.lit("other"), key), 256).alias("parent"), "pos", "child", (F.col("child_len") + 1).alias("child_len"))
    return M.violations(edges.unionByName(twice).drop("c_custkey"))


@query(f"SELECT doc_id AS file_id, count(*) AS n, sum(len)::BIGINT AS bytes FROM ({_LINES}) GROUP BY 1 HAVING count(*) > 1")
def merkle_leaves(spark, sf_dir):
    k = lines(spark, sf_dir)
    e = M.merkle_edges(k)
    tops = M.merkle_roots(k).where("n_leaves > 1")
    found = M.descendants(e, tops.select("root"))
    return tops.join(found, "root").groupBy("file_id").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@query(f"""
WITH n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS attributes, strlen(text)::BIGINT AS len FROM documents)
SELECT sum(len) FILTER (attributes & 1 > 0)::BIGINT AS block_bytes, count(*) FILTER (attributes & 1 > 0) AS n_blocks, sum(len) FILTER (attributes & 2 > 0)::BIGINT AS file_bytes, count(*) FILTER (attributes & 2 > 0) AS n_files FROM n""")
def node_totals(spark, sf_dir):
    bits = F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0) + F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0)
    return M.node_totals(table(spark, sf_dir, "documents").select(bits.alias("attributes"), F.octet_length("text").cast("long").alias("len")))


@query()
def spaced_queries(spark, sf_dir):
    return C.spaced_queries(lines(spark, sf_dir), 4, 8)


# --- similarity ------------------------------------------------------------------------------------------------------


def _lane(h: str, k: int) -> str:
    return f"min(('0x' || substr({h}, {4 * (k % 16) + 1}, 4))::INTEGER)"


_LANES = "SELECT doc_id, [" + ", ".join(_lane("hash" if k < 16 else "sha256(hash)", k) for k in range(32)) + f"] AS lanes FROM ({_LINES}) GROUP BY doc_id"


@query(f"SELECT doc_id AS file_id, lanes FROM ({_LANES})")
def minhash_lanes(spark, sf_dir):
    return R.minhash_lanes(lines(spark, sf_dir), "file_id")


@query(f"""
WITH s AS ({_LANES}), v AS (SELECT doc_id, unnest(lanes) AS v, generate_subscripts(lanes, 1) AS k FROM s),
p AS (SELECT a.doc_id AS file_id, b.doc_id AS other, count(*) / 32.0 AS similarity FROM v a JOIN v b ON a.k = b.k AND a.v = b.v AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= 16)
SELECT file_id, other, similarity::DOUBLE AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY similarity DESC, other) = 1""")
def most_similar(spark, sf_dir):
    return R.most_similar(R.minhash_lanes(lines(spark, sf_dir), "file_id"), "file_id")


# --- summaries and diffs ---------------------------------------------------------------------------------------------


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    after = c.where("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    return c.where("c_custkey % 11 <> 0"), after


_CUST = "b AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 11 <> 0), a AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 7 <> 0)"
_STATUS = "CASE WHEN b.c_name IS NULL THEN 'add' WHEN a.c_name IS NULL THEN 'delete' WHEN b.c_mktsegment = a.c_mktsegment THEN 'none' ELSE 'change' END"


@query(f"WITH {_CUST} SELECT c_custkey, b.c_mktsegment AS before_c_mktsegment, a.c_mktsegment AS after_c_mktsegment, {_STATUS} AS status FROM b FULL JOIN a USING (c_custkey)")
def keyed_diff(spark, sf_dir):
    return U.keyed_diff(*_customers(spark, sf_dir), ["c_custkey"], ["c_mktsegment"])


@query(f"""
WITH {_CUST}, d AS (SELECT coalesce(b.c_nationkey, a.c_nationkey) AS c_nationkey, {_STATUS} AS s FROM b FULL JOIN a USING (c_custkey)),
m AS (SELECT c_nationkey, count(*) FILTER (s = 'add') AS added, count(*) FILTER (s = 'change') AS changed, count(*) FILTER (s = 'delete') AS deleted FROM d GROUP BY 1)
SELECT *, added + changed + deleted AS total, CASE WHEN greatest(added, changed, deleted) = 0 THEN 'none' WHEN added >= changed AND added >= deleted THEN 'add' WHEN changed >= deleted THEN 'change' ELSE 'delete' END AS most FROM m""")
def change_map(spark, sf_dir):
    return U.change_map(U.keyed_diff(*_customers(spark, sf_dir), ["c_nationkey", "c_custkey"], ["c_mktsegment"]), ["c_nationkey"])


@query(f"WITH {_CUST} SELECT * FROM b UNION ALL SELECT * FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b)")
def summary_merge(spark, sf_dir):
    return U.merge_store(*_customers(spark, sf_dir), "c_custkey")


@query(f"""
WITH {_CUST} SELECT a.c_custkey, CASE WHEN b.c_custkey IS NULL THEN a.c_name END AS c_name, CASE WHEN b.c_custkey IS NULL OR a.c_mktsegment <> b.c_mktsegment THEN a.c_mktsegment END AS c_mktsegment
FROM a LEFT JOIN b USING (c_custkey) WHERE b.c_custkey IS NULL OR a.c_mktsegment <> b.c_mktsegment""")
def summary_difference(spark, sf_dir):
    b, a = _customers(spark, sf_dir)
    return U.store_difference(a, b, ["c_name", "c_mktsegment"], "c_custkey")


@query(f"WITH {_CUST} SELECT c_custkey, coalesce(a.c_name, b.c_name) AS c_name, coalesce(a.c_mktsegment, b.c_mktsegment) AS c_mktsegment FROM a FULL JOIN b USING (c_custkey)")
def summary_fields(spark, sf_dir):
    return U.merge_fields(*_customers(spark, sf_dir), ["c_name", "c_mktsegment"], "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'csv;' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN 'twb;' ELSE '' END AS types FROM customer")
def summary_types(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, 1).alias("csv"), F.when(F.col("c_custkey") % 3 == 0, 1).alias("twb"))
    return c.select("c_custkey", U.list_types(("csv", "twb")).alias("types"))


_CASES = [(b, bd, a, ad) for b, bd in ((False, None), (True, None), (True, "x")) for a, ad in ((False, None), (True, None), (True, "x"), (True, "y"))]
_WANT = ("no_summaries", "no_summaries", "insert", "insert", "no_summaries", "no_summaries", "before_not_found", "before_not_found", "remove", "after_not_found", "no_diff", "diff")
_CODE = {"no_summaries": 4, "before_not_found": 2, "after_not_found": 3}


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}', {_CODE.get(w, 0)})" for i, w in enumerate(_WANT)) + ') t("case", status, code)')
def diff_cases(spark, sf_dir):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(_CASES)], "case int, b boolean, bd string, a boolean, ad string")
    s = U.diff_status(F.col("b"), F.col("bd"), F.col("a"), F.col("ad"))
    return rows.select("case", s.alias("status"), U.error_code(s).alias("code"))


@query()
def ordered_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("a"))
    return U.ordered_diff(d.withColumn("b", F.filter("a", lambda x, i: i % 4 != 1)), "doc_id", "a", "b")


@query("SELECT doc_id, (len(string_split(text, chr(10))) + 2) // 4 AS deleted FROM documents WHERE len(string_split(text, chr(10))) > 1")
def ordered_diff_counts(spark, sf_dir):
    d = ordered_diff(spark, sf_dir)
    return d.groupBy("doc_id").agg(F.count_if(F.col("status") == "delete").alias("deleted")).where("deleted > 0")


_BOOK = """<workbook version="18.1"><datasources><datasource name="ds1" caption="Sales"><connection><relation name="orders" table="[orders]" type="table"/></connection>
<column name="[amount]" caption="Amount" datatype="real" role="measure"/><column name="[calc]" caption="Twice" datatype="real" role="measure"><calculation class="tableau" formula="[amount] * 2"/></column>
<column name="[secret]" hidden="true" datatype="string" role="dimension"/>
<metadata-records><metadata-record class="column"><local-name>[amount]</local-name><parent-name>[orders]</parent-name><local-type>real</local-type></metadata-record>
<metadata-record class="column"><local-name>[city]</local-name><parent-name>[orders]</parent-name><local-type>string</local-type></metadata-record></metadata-records></datasource></datasources>
<worksheets><worksheet name="Sheet 1"><table><rows>[ds1].[amount]</rows><cols/></table></worksheet></worksheets>
<dashboards><dashboard name="Board"><zones><zone name="outer"><zone name="inner"/></zone></zones></dashboard></dashboards></workbook>"""


def _books(spark) -> DataFrame:
    return spark.createDataFrame([("a.twb", _BOOK), ("b.twb", _BOOK.replace("Twice", "Double").replace("Sheet 1", "Sheet 2")), ("c.twb", "no xml")], "path string, text string")


@query("""SELECT * FROM (VALUES ('a.twb', 'datasource', 1::BIGINT), ('a.twb', 'relation', 1), ('a.twb', 'column', 3), ('a.twb', 'metadata', 2), ('a.twb', 'worksheet', 1), ('a.twb', 'rows', 1), ('a.twb', 'cols', 1),
 ('a.twb', 'dashboard', 1), ('a.twb', 'zone', 2)) t(file, kind, n)""")
def workbook_items(spark, sf_dir):
    return W.workbook_items(_books(spark)).where("file = 'a.twb'").groupBy("file", "kind").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (VALUES ('[amount]', 'Amount', 'orders', ''), ('[calc]', 'Twice', '', '[Amount] * 2'), ('[city]', 'city', 'orders', '')) t("column", caption, table_name, formula_text)""")
def workbook_columns(spark, sf_dir):
    cols = W.datasource_columns(W.workbook_items(_books(spark)).where("file = 'a.twb'"))
    text = W.formula_captions(cols).select("column", "formula_text")
    return cols.join(text, "column", "left").select("column", "caption", F.coalesce("table", F.lit("")).alias("table_name"), F.coalesce("formula_text", F.lit("")).alias("formula_text"))


@query("SELECT 'orders' AS table_name, '[calc]' AS \"column\"")
def workbook_calculated(spark, sf_dir):
    cols = W.datasource_columns(W.workbook_items(_books(spark)).where("file = 'a.twb'"))
    return W.calculated_tables(cols, W.formula_captions(cols)).select(F.col("table").alias("table_name"), "column")


@query("SELECT * FROM (VALUES ('column', 'change', 1::BIGINT), ('worksheet', 'add', 1), ('worksheet', 'delete', 1), ('rows', 'add', 1), ('rows', 'delete', 1), ('cols', 'add', 1), ('cols', 'delete', 1)) t(kind, status, n)")
def workbook_diff(spark, sf_dir):
    i = W.workbook_items(_books(spark))
    return W.workbook_diff(i.where("file = 'a.twb'"), i.where("file = 'b.twb'")).where("status <> 'none'").groupBy("kind", "status").agg(F.count("*").alias("n"))


# --- scalar functions ------------------------------------------------------------------------------------------------

_BYTES = (0, 5, 1023, 1024, 1536, 1048576, 5000000, 1073741824, 1099511627776, 1200000000000)


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}::BIGINT, '{t}')" for n, t in zip(_BYTES, ("0 bytes", "5 bytes", "1023 bytes", "1 KiB", "1.50 KiB", "1 MiB", "4.77 MiB", "1 GiB", "1 TiB", "1.09 TiB"))) + ") t(n, text)")
def human_bytes(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in _BYTES], "n long").select("n", S.human_bytes("n").alias("text"))


@query("SELECT doc_id, path, sha256(path) AS h, substr(sha256(path), 1, 16) AS short, ('0x' || substr(sha256(path), 62, 3))::BIGINT % 1024 AS sampled, sha256(path) || '.shard' AS shard FROM (" + _TREE + ")")
def hash_functions(spark, sf_dir):
    h = S.data_hash("path")
    return tree(spark, sf_dir).select("doc_id", "path", h.alias("h"), S.truncated(h).alias("short"), S.hash_mod(h, 1024).alias("sampled"), S.shard_name(h).alias("shard"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/:]+)/*$', 1), '\\.git$', '') AS name, regexp_matches(url, '^[a-z][a-z0-9+.-]*://') AS remote FROM pages")
def url_functions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.repo_name("url").alias("name"), S.is_remote("url").alias("remote"))


@query("SELECT * FROM (VALUES ('git@h.org:a/b.git', 'https://h.org/a/b.git', 'b'), ('ssh://git@h.org/a/b', 'https://h.org/a/b', 'b'), ('https://h.org/x', 'https://h.org/x', 'x')) t(url, https, name)")
def remote_addresses(spark, sf_dir):
    u = spark.createDataFrame([("git@h.org:a/b.git",), ("ssh://git@h.org/a/b",), ("https://h.org/x",)], "url string")
    return u.select("url", S.to_https("url").alias("https"), S.repo_name("url").alias("name"))


@query("SELECT * FROM (VALUES ('v1.2.10', true), ('1.10.0-rc', true), ('0.9.9', false), ('none', NULL)) t(text, recent)")
def versions(spark, sf_dir):
    v = spark.createDataFrame([("v1.2.10",), ("1.10.0-rc",), ("0.9.9",), ("none",)], "text string")
    return v.select("text", (S.version_parts("text") >= S.version_parts(F.lit("1.2.3"))).alias("recent"))


@query("SELECT * FROM (VALUES ('3,6', 3::BIGINT, 6::BIGINT, [0::BIGINT]), ('0,40', 0, 40, [0, 1, 2]), ('6,3', NULL, NULL, NULL), ('x', NULL, NULL, NULL)) t(text, start, \"end\", blocks)")
def byte_ranges(spark, sf_dir):
    r = spark.createDataFrame([("3,6",), ("0,40",), ("6,3",), ("x",)], "text string").withColumn("r", S.byte_range("text"))
    return r.select("text", "r.start", "r.end", F.when(F.col("r").isNotNull(), S.blocks_of_range("r.start", "r.end", 16)).alias("blocks"))


@query("SELECT doc_id, n_chars, true AS is_valid, n_chars AS filesize FROM documents")
def pointers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("p", S.parse_pointer(S.pointer_text(S.data_hash("text"), F.col("n_chars"))))
    return d.select("doc_id", "n_chars", "p.is_valid", "p.filesize")


@query("SELECT doc_id, strlen(text) = 0 OR strlen(text) < 2000 AS passes FROM documents")
def passthrough(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.text_passthrough(F.encode("text", "UTF-8"), 2000).alias("passes"))


@query(f"SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, 'x/' || path AS joined, path AS normal FROM ({_TREE})")
def path_functions(spark, sf_dir):
    p = F.concat(F.lit("./a/../"), F.col("path"))
    return tree(spark, sf_dir).select("path", S.file_name("path").alias("name"), S.parent("path").alias("folder"), S.join_path(F.lit("x/"), F.col("path")).alias("joined"), S.normalize_path(p).alias("normal"))


@query("SELECT * FROM (VALUES ('[a].[b]', ['a', 'b'], 'SUM(x)'), ('[c]', ['c'], 'SUM(x)')) t(text, parts, caption)")
def identifiers(spark, sf_dir):
    return spark.createDataFrame([("[a].[b]",), ("[c]",)], "text string").select("text", S.identifiers("text").alias("parts"), S.caption_of(F.lit("Sum"), F.lit("x")).alias("caption"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'City' END AS geo, CASE WHEN p_size > 25 THEN 7 END AS error FROM part")
def roles_and_guards(spark, sf_dir):
    role = F.when(F.col("p_size") % 2 == 0, "[City].[Name]").otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", S.geo_role(role).alias("geo"), S.summary_guard("p_size", 25).alias("error"))


@query("SELECT * FROM (VALUES ('see ' || repeat('a', 40) || '.', 'see ' || repeat('b', 40) || '.', 1::INTEGER)) t(text, new, n)")
def object_ids(spark, sf_dir):
    m = F.create_map(F.lit("a" * 40), F.lit("b" * 40))
    t = spark.createDataFrame([("see " + "a" * 40 + ".",)], "text string")
    return t.select("text", S.replace_ids("text", m).alias("new"), F.size(S.ids_in_text("text")).alias("n"))


# --- time ------------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return T.windowed_counts(table(spark, sf_dir, "events"))


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def cache_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("t")).first().t
    return T.expire(e, now, 86400, "ts").select("event_id")
