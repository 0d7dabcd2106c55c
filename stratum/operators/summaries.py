"""Summary store and structural diffs: keyed tables of nullable summary structs, merged, compared and reported."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of failed diffs.
ERRORS = {"invalid_arguments": 1, "before_not_found": 2, "after_not_found": 3, "no_summaries": 4, "same_hash": 5, "not_in_repository": 6, "too_large": 7, "internal": 255}
TYPES = ("csv", "libmagic", "twb", "tds")
#: Types that can be compared, in the order in which their errors count; columns beyond which a table is called wide.
COMPARED, WIDE = ("csv", "twb", "tds"), 50


def merge_store(first: DataFrame, second: DataFrame, key: str = "file_hash") -> DataFrame:
    """Both stores; the first's row wins."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def store_difference(new: DataFrame, stored: DataFrame, fields: Iterable[str], key: str = "file_hash") -> DataFrame:
    """Rows of new that the store lacks, and for changed rows the fields that differ (null where they do not)."""
    fields = list(fields)
    old = stored.select(F.col(key), *(F.col(f).alias(f"__old_{f}") for f in fields), F.lit(True).alias("__there"))
    rows = new.join(old, key, "left")
    same = [F.col(f).eqNullSafe(F.col(f"__old_{f}")) for f in fields]
    changed = F.col("__there").isNull()
    for s in same:
        changed |= ~s
    return rows.where(changed).select(key, *(F.when(F.col("__there").isNull() | ~s, F.col(f)).alias(f) for f, s in zip(fields, same)))


def merge_fields(a: DataFrame, b: DataFrame, fields: Iterable[str], key: str = "file_hash") -> DataFrame:
    """By key, each field from b where it has one, else from a."""
    fields = list(fields)
    x, y = a.select(key, *(F.col(f).alias(f"__a_{f}") for f in fields)), b.select(key, *(F.col(f).alias(f"__b_{f}") for f in fields))
    return x.join(y, key, "full_outer").select(key, *(F.coalesce(f"__b_{f}", f"__a_{f}").alias(f) for f in fields))


def list_types(fields: Iterable[str] = TYPES) -> Column:
    """The names of the summaries a row has, each with a semicolon behind."""
    return F.concat(*(F.when(F.col(f).isNotNull(), F.lit(f"{f};")).otherwise("") for f in fields))


def summary_for(files: DataFrame, by_hash: DataFrame, computed: DataFrame) -> DataFrame:
    """path, summary: the stored summary of a file's hash, else the one computed from its blob."""
    a = by_hash.select("file_hash", F.col("summary").alias("__s"))
    b = computed.select("oid", F.col("summary").alias("__c"))
    return files.join(a, "file_hash", "left").join(b, "oid", "left").select("path", F.coalesce("__s", "__c").alias("summary"))


def diff_status(before: Column, before_data: Column, after: Column, after_data: Column) -> Column:
    """What comparing two optional summaries gives: insert, remove, diff, no_diff or the name of an error.

    before and after say whether the file is there, the data columns hold the summary of one type or null.
    """
    had, has = before_data.isNotNull(), after_data.isNotNull()
    return (
        F.when(~before & ~after, "no_summaries")
        .when(before & ~after, F.when(had, "remove").otherwise("no_summaries"))
        .when(~before & after, F.when(has, "insert").otherwise("no_summaries"))
        .when(~had & ~has, "no_summaries").when(had & ~has, "after_not_found").when(~had & has, "before_not_found")
        .when(before_data.eqNullSafe(after_data), "no_diff").otherwise("diff")
    )


def type_diffs(rows: DataFrame, key: str = "path", types: Iterable[str] = COMPARED) -> DataFrame:
    """key, type, status of comparing two versions of files, type by type.

    rows: key, before and after (whether the file is there), and before_x and after_x for each type x. Types that
    cannot be compared are left out if another one can; else one row without a type gives the first error that says
    more than that there are no summaries.
    """
    status = lambda t: diff_status(F.col("before"), F.col(f"before_{t}"), F.col("after"), F.col(f"after_{t}"))
    each = F.array(*(F.struct(F.lit(t).alias("type"), status(t).alias("status")) for t in types))
    failed = lambda x: x.status.isin(*ERRORS)
    good = F.filter("each", lambda x: ~failed(x))
    why = F.get(F.filter("each", lambda x: failed(x) & (x.status != "no_summaries")), F.lit(0)).status
    bad = F.array(F.struct(F.lit(None).cast("string").alias("type"), F.coalesce(why, F.lit("no_summaries")).alias("status")))
    return rows.withColumn("each", each).select(key, F.inline(F.when(F.size(good) > 0, good).otherwise(bad)))


def table_warnings(headers: Column, summaries: Column) -> Column:
    """What is odd about a table's summary, given its headers and the summaries of its columns: 'wide', 'unequal'."""
    wide, unequal = F.when(F.size(headers) > WIDE, "wide"), F.when(F.size(headers) != F.size(summaries), "unequal")
    return F.array_compact(F.array(wide, unequal))


def error_code(status: Column) -> Column:
    """The code of a status, 0 if it is none."""
    out = F.lit(0)
    for name, code in ERRORS.items():
        out = F.when(status == name, code).otherwise(out)
    return out


def check_arguments(before_hash: str | None = None, after_hash: str | None = None, before_id: str | None = None, after_id: str | None = None) -> int:
    """0, or the code of what is wrong with the ends of a diff; ids count only without hashes."""
    if not any((before_hash, after_hash, before_id, after_id)):
        return ERRORS["invalid_arguments"]
    if before_hash or after_hash:
        return ERRORS["same_hash"] if before_hash == after_hash else 0
    return ERRORS["same_hash"] if before_id == after_id else 0


def diff_item(before: Column, after: Column) -> Column:
    """status (add, delete, change, none), before, after (null if nothing changed)."""
    none = before.eqNullSafe(after)
    status = F.when(none, "none").when(before.isNull(), "add").when(after.isNull(), "delete").otherwise("change")
    return F.struct(status.alias("status"), before.alias("before"), F.when(~none, after).alias("after"))


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], order: str | None = None) -> DataFrame:
    """keys, status, and for each value before_x and after_x. Of repeated keys after, the last (by order) counts."""
    if order:
        after = after.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")
    a = before.select(*keys, *(F.col(v).alias(f"before_{v}") for v in values), F.lit(True).alias("__a"))
    b = after.select(*keys, *(F.col(v).alias(f"after_{v}") for v in values), F.lit(True).alias("__b"))
    same = F.lit(True)
    for v in values:
        same &= F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}"))
    status = F.when(F.col("__a").isNull(), "add").when(F.col("__b").isNull(), "delete").when(same, "none").otherwise("change")
    return a.join(b, keys, "full_outer").withColumn("status", status).drop("__a", "__b")


def change_map(diffs: DataFrame, by: list[str]) -> DataFrame:
    """by, added, changed, deleted, total, most: how many items changed, and the largest kind ('none' if none)."""
    one = lambda s: F.count_if(F.col("status") == s)
    rows = diffs.groupBy(*by).agg(one("add").alias("added"), one("change").alias("changed"), one("delete").alias("deleted"))
    most = F.greatest("added", "changed", "deleted")
    name = F.when(most == 0, "none").when(F.col("added") == most, "add").when(F.col("changed") == most, "change").otherwise("delete")
    return rows.withColumn("total", F.col("added") + F.col("changed") + F.col("deleted")).withColumn("most", name)


def merge_change_maps(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Change maps of two disjoint parts as one: by, added, changed, deleted, total."""
    return a.unionByName(b).groupBy(*by).agg(*(F.sum(x).alias(x) for x in ("added", "changed", "deleted", "total")))


def edit_script(before: list, after: list) -> list[tuple[str, object, object]]:
    """A smallest list of (status, before, after) that turns one list into another; deletions and additions in one
    place pair up as changes. Furthest-reaching paths by number of edits, in memory that grows with the edits."""
    n, m = len(before), len(after)
    furthest, trail = {1: 0}, []
    for d in range(n + m + 1):
        trail.append(dict(furthest))
        for k in range(-d, d + 1, 2):
            x = furthest[k + 1] if k == -d or k != d and furthest[k - 1] < furthest[k + 1] else furthest[k - 1] + 1
            while x < n and x - k < m and before[x] == after[x - k]:
                x += 1
            furthest[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    steps, x, y = [], n, m
    for d in range(len(trail) - 1, -1, -1):
        v, k = trail[d], x - y
        down = k == -d or k != d and v.get(k - 1, -1) < v.get(k + 1, -1)
        px = v[k + 1] if down else v.get(k - 1, 0)
        py = px - (k + 1 if down else k - 1)
        while x > max(px, 0) and y > max(py, 0) and (d == 0 or x > px + (not down) or y > py + down):
            x, y = x - 1, y - 1
            steps.append(("none", before[x], None))
        if d:
            if down:
                y -= 1
                steps.append(("add", None, after[y]))
            else:
                x -= 1
                steps.append(("delete", before[x], None))
    out, gone, new = [], [], []

    def close() -> None:
        for i in range(max(len(gone), len(new))):
            if i < len(gone) and i < len(new):
                out.append(("change", gone[i], new[i]))
            else:
                out.append(("delete", gone[i], None) if i < len(gone) else ("add", None, new[i]))
        gone.clear()
        new.clear()

    for status, a, b in reversed(steps):
        if status == "none":
            close()
            out.append((status, a, b))
        else:
            (gone if status == "delete" else new).append(a if status == "delete" else b)
    close()
    return out


def ordered_diff(lists: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, pos, status, before, after for two columns of string arrays; null is an empty list."""

    def run(batches):
        for pdf in batches:
            rows = [(k, i, *step) for k, a, b in zip(pdf[key], pdf[before], pdf[after]) for i, step in enumerate(edit_script(list(a) if a is not None else [], list(b) if b is not None else []))]
            yield pd.DataFrame(rows, columns=[key, "pos", "status", "before", "after"])

    kind = lists.schema[key].dataType.simpleString()
    return lists.select(key, before, after).mapInPandas(run, f"`{key}` {kind}, pos int, status string, before string, after string")
