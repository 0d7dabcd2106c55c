"""Column profiles: special values, moments, 20-bin histograms on an adaptive scale, frequent items.

A profile is two aggregations over the data, whatever the number of columns: the first gives counts, moments, extremes
and the first value of each column, from which the driver computes each scale (a handful of scalars); the second
counts bins. Both combine map-side; neither moves a row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 20
TOP, TEXT_BYTES = 50, 50
#: Half the error of the frequent-item count: capacity is its inverse and one.
EPSILON = 1e-4


def final_scale(first: float, low: float, high: float) -> tuple[float, float]:
    """The scale after all values: one step around the first value, doubled until it holds them all."""
    a, b = math.nextafter(first, -math.inf), math.nextafter(first, math.inf)
    while low < a or high > b:
        half = max((b - a) / 2, 2.0**-52)
        a, b = a - half, b + half
    return a, b


def final_int_scale(low0: int, high0: int, low: int, high: int) -> tuple[int, int]:
    """As final_scale for whole numbers: padded to a multiple of the bins, doubled within 64 bits."""
    if high0 - low0 < 2 or (high0 - low0) % 2:
        raise ValueError("the first scale must be even and at least 2 wide")
    pad = -(high0 - low0) % BINS
    a, b = low0 - pad // 2, high0 + (pad + 1) // 2
    while low < a or high > b:
        half = (b - a) // 2
        if a - half < -(2**63) or b + half >= 2**63:
            break
        a, b = a - half, b + half
    return a, b


def bin_of(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(F.floor((x - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def finite(x: Column) -> Column:
    """A column without NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def moments(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Per column: n, nan, pos_inf, neg_inf, min, max, avg, var, std, first (by order). One aggregation."""
    at = F.struct(*order)
    each = []
    for name in columns:
        x = F.col(name).cast("double")
        v = finite(x)
        each.append(
            F.struct(
                F.lit(name).alias("column"), F.count(v).alias("n"), F.count_if(F.isnan(x)).alias("nan_count"),
                F.count_if(x == float("inf")).alias("pos_inf"), F.count_if(x == float("-inf")).alias("neg_inf"),
                F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"),
                F.when(F.count(v) > 0, F.coalesce(F.var_samp(v), F.lit(0.0))).alias("var"),
                F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"),
                F.min_by(v, F.when(v.isNotNull(), at)).alias("first"),
            )
        )
    return df.agg(F.array(*each).alias("c")).select(F.inline("c"))


def histograms(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """column, bin, count of the finite values, for given scales. Empty bins have no row."""
    cells = []
    for name, (a, b) in scales.items():
        v = finite(F.col(name).cast("double"))
        cells.append(F.struct(F.lit(name).alias("column"), bin_of(v, F.lit(a), F.lit(b)).alias("bin")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, bin int, count long")
    return df.select(F.inline(F.array(*cells))).where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count("*").alias("count"))


def profile(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row per column: moments, scale_min, scale_max and bin_counts (null without a finite value)."""
    m = moments(df, columns, order)
    rows = {r["column"]: r for r in m.collect()}  # one row per column
    scales = {k: final_scale(r["first"], r["min"], r["max"]) for k, r in rows.items() if r["n"]}
    spark = df.sparkSession
    table = spark.createDataFrame([tuple(rows[k]) + scales.get(k, (None, None)) for k in columns], m.schema.add("scale_min", "double").add("scale_max", "double"))
    h = histograms(df, scales).groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("by_bin"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.col("by_bin")[b.cast("int")], F.lit(0)))
    return table.join(F.broadcast(h), "column", "left").select(*table.columns, F.when(F.col("by_bin").isNotNull(), counts).alias("bin_counts"))


def combine_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Profiles of two disjoint parts as one, by the pairwise formula; histograms combine by summing equal scales."""
    n, m = F.col("a.n"), F.col("b.n")
    t = n + m
    delta = F.col("b.avg") - F.col("a.avg")
    m2 = F.coalesce(F.col("a.var"), F.lit(0.0)) * F.greatest(n - 1, F.lit(0)) + F.coalesce(F.col("b.var"), F.lit(0.0)) * F.greatest(m - 1, F.lit(0)) + F.coalesce(delta * delta * n * m / F.nullif(t, F.lit(0)), F.lit(0.0))
    avg = F.when(n == 0, F.col("b.avg")).when(m == 0, F.col("a.avg")).otherwise(F.col("a.avg") + delta * m / t)
    var = F.when(t > 0, F.when(t > 1, m2 / (t - 1)).otherwise(0.0))
    return a.alias("a").join(b.alias("b"), "column").select(
        "column", t.alias("n"), *((F.col(f"a.{k}") + F.col(f"b.{k}")).alias(k) for k in ("nan_count", "pos_inf", "neg_inf")),
        F.least("a.min", "b.min").alias("min"), F.greatest("a.max", "b.max").alias("max"), avg.alias("avg"), var.alias("var"), F.sqrt(var).alias("std"),
    )


def item_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, item, count of all values as text; exact, combined map-side. Nulls count as no item."""
    cells = F.array(*(F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("item")) for x in columns))
    return df.select(F.inline(cells)).where("item IS NOT NULL").groupBy("column", "item").agg(F.count("*").alias("count"))


def merge_items(*counts: DataFrame) -> DataFrame:
    """Item counts of disjoint parts as one."""
    return reduce(DataFrame.unionByName, counts).groupBy("column", "item").agg(F.sum("count").alias("count"))


def top_items(counts: DataFrame, k: int = TOP, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """The k most frequent items per column: column, rank, item (cut at text_bytes, then '...'), count.

    Ranking within a column keeps k rows in each task before any are moved.
    """
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "item"))
    return counts.select("column", rank.alias("rank"), cut_text("item", text_bytes).alias("item"), "count").where(F.col("rank") <= k)


def cut_text(x, limit: int = TEXT_BYTES) -> Column:
    """A text of more than so many bytes cut before the grapheme that passes them, with '...' behind.

    Graphemes within the limit lie in its first characters, one more of which shows where the last of them ends.
    """
    x = F.col(x) if isinstance(x, str) else x
    graphemes = F.regexp_extract_all(F.substring(x, 1, limit + 1), F.lit(r"(\X)"), F.lit(1))
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def add(so_far: Column, g: Column) -> Column:
        fits = so_far.open & (F.octet_length(so_far.text) + F.octet_length(g) <= limit)
        return F.struct(F.when(fits, F.concat(so_far.text, g)).otherwise(so_far.text).alias("text"), fits.alias("open"))

    return F.when(F.octet_length(x) <= limit, x).otherwise(F.concat(F.aggregate(graphemes, start, add, lambda r: r.text), F.lit("...")))


def heavy_hitters(df: DataFrame, column: str, epsilon: float) -> DataFrame:
    """Items with at least max(1, epsilon * n) occurrences, exactly: item, count, count_min, count_max."""
    rows = df.where(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).alias("item")).agg(F.count("*").alias("count"))
    total = rows.agg(F.count("*").alias("total"))
    kept = counts.crossJoin(F.broadcast(total)).where(F.col("count") >= F.greatest(F.lit(1), F.floor(F.col("total") * epsilon)))
    return kept.select("item", "count", F.col("count").alias("count_min"), F.col("count").alias("count_max"))


def sketch(df: DataFrame, columns: list[str], capacity: int = int(math.ceil(1 / EPSILON)) + 1) -> DataFrame:
    """A mergeable summary of frequent items: column, item, count_min, count_max, n.

    At most ``capacity`` items for each column, whose true counts lie within count_min and count_max; one more row,
    without an item, bounds by its count_max any item that is not listed. n is the number of values.
    """
    return _kept(item_counts(df, columns).select("column", "item", F.col("count").alias("count_min"), F.col("count").alias("count_max"), F.col("count").alias("n")), capacity)


def merge_sketches(*parts: DataFrame, capacity: int = int(math.ceil(1 / EPSILON)) + 1) -> DataFrame:
    """The summary of all parts together: ranges add up, and a part that does not list an item adds its bound for such."""
    rows = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))
    rest = rows.where("item IS NULL").select("column", "part", F.col("count_max").alias("missed"), "n")
    total = rest.groupBy("column").agg(F.sum("missed").alias("all_missed"), F.sum("n").alias("all_n"))
    items = rows.where("item IS NOT NULL").join(F.broadcast(rest.drop("n")), ["column", "part"])
    items = items.groupBy("column", "item").agg(F.sum("count_min").alias("count_min"), F.sum(F.col("count_max") - F.col("missed")).alias("over"))
    items = items.join(F.broadcast(total), "column").select("column", "item", "count_min", (F.col("over") + F.col("all_missed")).alias("count_max"), F.lit(0).cast("long").alias("n"))
    none = total.select("column", F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("count_min"), F.col("all_missed").alias("count_max"), F.col("all_n").alias("n"))
    return _kept(items.unionByName(none), capacity)


def _kept(rows: DataFrame, capacity: int) -> DataFrame:
    """The items of largest count_max, the smaller item on ties, and a row that bounds the others.

    Each task keeps capacity rows of a column before any are moved; what it drops is bounded by one row.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count_max"), F.desc("count_min"), "item")
    listed = rows.where("item IS NOT NULL")
    top = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= capacity + 1)
    missed = top.where(F.col("rank") == capacity + 1).select("column", F.col("count_max").alias("bound"), F.lit(0).cast("long").alias("n"))
    bounds = missed.unionByName(rows.select("column", F.when(F.col("item").isNull(), F.col("count_max")).otherwise(0).alias("bound"), "n"))
    bounds = bounds.groupBy("column").agg(F.max("bound").alias("count_max"), F.sum("n").alias("n"))
    top = top.where(F.col("rank") <= capacity).select("column", "item", "count_min", "count_max")
    top = top.join(F.broadcast(bounds.select("column", "n")), "column")
    return top.unionByName(bounds.select("column", F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("count_min"), "count_max", "n"))


def frequent(summary: DataFrame, epsilon: float = EPSILON, guaranteed: bool = False) -> DataFrame:
    """Items of a summary with possibly (or certainly) max(1, epsilon * n) occurrences: column, item, count_min, count_max."""
    least = F.greatest(F.lit(1), F.floor(F.col("n") * epsilon))
    rows = summary.where(F.col("item").isNotNull() & (F.col("count_min" if guaranteed else "count_max") >= least))
    return rows.select("column", "item", "count_min", "count_max")


def column_profiles(df: DataFrame, columns: list[str], order: list[str], k: int = TOP, capacity: int = int(math.ceil(1 / EPSILON)) + 1) -> DataFrame:
    """One row per column, of any type: its profile (of what reads as a number) and top, its k most frequent items as
    (item, count_min, count_max) from a summary of bounded size."""
    numbers = df.select(*order, *(F.col(x).try_cast("double").alias(x) for x in columns if x not in order))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count_max"), F.desc("count_min"), "item"))
    top = sketch(df, columns, capacity).where("item IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= k)
    top = top.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", cut_text("item").alias("item"), "count_min", "count_max"))), lambda x: x.dropFields("rank")).alias("top"))
    return profile(numbers, columns, order).join(F.broadcast(top), "column", "left")


def cell_profiles(cells: DataFrame, k: int = TOP) -> DataFrame:
    """Profiles by file and column of a table of cells (file, row, col, name, value): counts and moments of the numbers,
    and the k most frequent values. One aggregation for any number of files."""
    x = F.col("value").try_cast("double")
    v = finite(x)
    by = ["file", "col", "name"]
    first = F.min_by(v, F.when(v.isNotNull(), F.col("row")))
    stats = cells.groupBy(*by).agg(
        F.count("*").alias("cells"), F.count(v).alias("n"), F.count_if(F.isnan(x)).alias("nan_count"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("avg"), F.when(F.count(v) > 0, F.coalesce(F.var_samp(v), F.lit(0.0))).alias("var"), first.alias("first"),
    )
    counts = cells.groupBy(*by, "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "value"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(*by)
    top = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", cut_text("value").alias("item"), "count"))), lambda x: x.dropFields("rank")).alias("top"))
    return stats.join(top, by, "left")


def approximate_items(df: DataFrame, column: str, k: int = TOP, epsilon: float = EPSILON) -> DataFrame:
    """The k most frequent items from a mergeable sketch of bounded size: item, count."""
    size = int(math.ceil(1 / epsilon)) + 1
    return df.agg(F.expr(f"approx_top_k(`{column}`, {k}, {size})").alias("t")).select(F.inline("t"))
