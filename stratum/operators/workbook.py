"""Workbooks and data sources in XML: flattened tables, captions, calculated columns, typed diffs.

Each workbook is parsed once, in a table function over Arrow batches, into long rows; all that follows is joins. Nested
structures (zones, filters) are rows with a path and a depth.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalar import name_or_caption

ITEMS = "file string, kind string, parent string, name string, caption string, path string, depth int, attributes map<string,string>"
#: Operators of relationship conditions.
OPERATORS = frozenset(("=", "<=", "<", ">=", ">", "<>", "AND", "OR"))


def strip(x: str | None) -> str:
    return re.sub(r"^\[+|\]+$", "", x or "")


def items_of(file: str, text: str) -> Iterator[tuple]:
    """Rows of one workbook or data source; none if it is no XML."""
    try:
        top = ET.fromstring(text)
    except ET.ParseError:
        return
    sources = top.findall("datasources/datasource") if top.tag == "workbook" else [top] if top.tag == "datasource" else []
    row = lambda kind, parent, e, path="", depth=0, **more: (file, kind, parent, e.get("name") or "", e.get("caption") or "", path, depth, {**e.attrib, **more})
    for d in sources:
        name = d.get("name") or d.get("formatted-name") or ""
        yield (file, "datasource", "", name, d.get("caption") or "", "", 0, dict(d.attrib))
        for r in d.iter("relation"):
            yield row("relation", name, r)
        for e in d.iter("relationship"):
            expression = e.find("expression")
            if expression is not None:
                yield (file, "relationship", name, condition(expression), "", "", 0, {})
        for e in d.findall("column"):
            formula = e.find("calculation")
            yield row("column", name, e, formula=formula.get("formula", "") if formula is not None else "")
        for e in d.findall("column-instance"):
            yield row("column-instance", name, e)
        for e in d.iter("metadata-record"):
            if e.get("class") == "column":
                get = lambda k: (e.findtext(k) or "")
                yield (file, "metadata", name, get("local-name"), get("remote-alias"), "", 0, {"table": strip(get("parent-name")), "type": get("local-type")})
        for g in d.findall("group"):
            yield row("group", name, g)
            yield from _nested(file, "filter", g.get("name") or "", g, "groupfilter")
    for w in top.findall("worksheets/worksheet"):
        name = w.get("name") or ""
        title = "".join(x.text or "" for x in w.findall("layout-options/title/formatted-text/run"))
        yield row("worksheet", "", w, title=title)
        for place in ("rows", "cols"):
            yield (file, place, name, w.findtext(f"table/{place}") or "", "", "", 0, {})
        for e in w.findall("table/view/datasource-dependencies/column-instance"):
            yield row("column-instance", name, e)
        for e in w.findall("table/view/filter"):
            yield row("worksheet-filter", name, e)
    for b in top.findall("dashboards/dashboard"):
        yield row("dashboard", "", b)
        for zones in b.findall("zones"):
            yield from _nested(file, "zone", b.get("name") or "", zones, "zone")


def _nested(file: str, kind: str, parent: str, element: ET.Element, tag: str) -> Iterator[tuple]:
    work = [(e, str(i), 0) for i, e in enumerate(element.findall(tag))]
    while work:
        e, path, depth = work.pop()
        yield (file, kind, parent, e.get("name") or e.get("member") or "", e.get("caption") or "", path, depth, dict(e.attrib))
        work += [(x, f"{path}.{i}", depth + 1) for i, x in enumerate(e.findall(tag))]


def condition(e: ET.Element) -> str:
    """A relationship's expression tree as infix text; inner conditions in brackets."""
    op, parts = e.get("op") or "", e.findall("expression")
    if not parts:
        return op
    if op not in OPERATORS:
        return f"{op}({', '.join(map(condition, parts))})"
    return f" {op} ".join(f"({condition(p)})" if p.findall("expression") and (p.get("op") in ("AND", "OR")) else condition(p) for p in parts)


def workbook_items(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per datasource, column, relation, worksheet, zone... of XML files."""
    names = [x.split()[0] for x in ITEMS.split(", ")]

    def run(batches):
        for pdf in batches:
            for f, t in zip(pdf["f"], pdf["t"]):
                yield pd.DataFrame(list(items_of(f, t or "")), columns=names)

    return files.select(F.col(path).alias("f"), F.col(text).alias("t")).mapInPandas(run, ITEMS)


def datasource_columns(items: DataFrame) -> DataFrame:
    """file, datasource, column, caption, role, type, table, formula: visible columns and what metadata alone knows."""
    a = F.col("attributes")
    cols = items.where("kind = 'column'").where(F.coalesce(a["hidden"], F.lit("false")) != "true")
    meta = items.where("kind = 'metadata'").select("file", F.col("parent").alias("datasource"), F.col("name").alias("column"), a["table"].alias("table"), a["type"].alias("meta_type"))
    cols = cols.select("file", F.col("parent").alias("datasource"), F.col("name").alias("column"), name_or_caption("name", "caption").alias("caption"), a["role"].alias("role"), a["datatype"].alias("type"), a["formula"].alias("formula"))
    known = items.where("kind = 'column'").select("file", F.col("parent").alias("datasource"), F.col("name").alias("column"))
    keys = ["file", "datasource", "column"]
    extra = meta.join(known, keys, "left_anti").select(*keys, F.regexp_replace("column", r"^\[+|\]+$", "").alias("caption"), F.lit(None).cast("string").alias("role"), F.col("meta_type").alias("type"), F.lit("").alias("formula"), "table")
    return cols.join(meta.drop("meta_type"), keys, "left").unionByName(extra)


def substitute_columns(text: str, find: Callable[[str, str], str | None]) -> tuple[str | None, list[tuple[str, str]]]:
    """A formula with [source].[column] (or [column]) replaced by captions, and what it depends on.

    find(source, column) gives a caption or None; source is '' for a lone column. Unbalanced or nested brackets give
    (None, []).
    """
    depth = 0
    for ch in text:
        depth += (ch == "[") - (ch == "]")
        if depth not in (0, 1):
            return None, []
    if depth:
        return None, []
    found: list[tuple[str, str]] = []

    def one(m: re.Match) -> str:
        source, column = (m[1], m[2]) if m[2] is not None else ("", m[1])
        caption = find(source, column)
        if caption is None:
            return m[0]
        found.append((source, column))
        return f"[{caption}]"

    return re.sub(r"(\[[^\[\]]*\])(?:\.(\[[^\[\]]*\]))?", one, text), found


def formula_captions(columns: DataFrame) -> DataFrame:
    """file, datasource, column, formula_text, depends_on of columns with a formula, captions in place of names.

    Captions travel as one map per file: as many entries as its workbook has columns.
    """
    one = columns.groupBy("file", F.concat_ws("\0", "datasource", "column").alias("k")).agg(F.min("caption").alias("caption"))  # a column may come twice
    names = one.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "caption"))).alias("names"))

    def run(batches):
        for pdf in batches:
            out = []
            for f, d, k, formula, known in zip(pdf.file, pdf.datasource, pdf.column, pdf.formula, pdf.names):
                known = dict(known)
                text, needs = substitute_columns(formula, lambda s, x: known.get(f"{strip(s) or d}\0{x}"))
                out.append((f, d, k, text, [f"{strip(s) or d}.{x}" for s, x in needs]))
            yield pd.DataFrame(out, columns=["file", "datasource", "column", "formula_text", "depends_on"])

    rows = columns.where("formula <> ''").join(names, "file").select("file", "datasource", "column", "formula", "names")
    return rows.mapInPandas(run, "file string, datasource string, column string, formula_text string, depends_on array<string>")


def calculated_tables(columns: DataFrame, formulas: DataFrame) -> DataFrame:
    """file, datasource, column, table of calculated columns: the one table that all they rest on agree in, else ''.

    A calculated column that rests on no column is of no table, and so is what mixes it with others.
    """
    from stratum.operators.repository import reachable

    node = lambda d, k: F.concat_ws("\0", "file", F.concat_ws(".", d, k))
    edges = formulas.select(node("datasource", "column").alias("src"), F.explode("depends_on").alias("x"), "file").select("src", F.concat_ws("\0", "file", "x").alias("dst"))
    tables = columns.where("formula = '' OR formula IS NULL").select(node("datasource", "column").alias("node"), F.coalesce("table", F.lit("")).alias("table"), F.col("datasource").alias("of"))
    tables = tables.unionByName(formulas.where(F.size("depends_on") == 0).select(node("datasource", "column").alias("node"), F.lit("").alias("table"), F.col("datasource").alias("of")))
    starts = formulas.select("file", "datasource", "column", node("datasource", "column").alias("root"))
    reach = reachable(edges, starts.select("root")).where("root <> node").join(tables, "node")
    one = reach.join(starts, "root").groupBy("root").agg(F.countDistinct("table").alias("n"), F.max("table").alias("t"), F.max((F.col("of") != F.col("datasource")).cast("int")).alias("foreign"))
    return starts.join(one, "root", "left").select("file", "datasource", "column", F.when((F.col("n") == 1) & (F.col("foreign") == 0), F.col("t")).otherwise("").alias("table"))


def workbook_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, parent, name, path, status of all items of two versions, by name within their parent."""
    from stratum.operators.summaries import keyed_diff

    value = F.to_json(F.struct("caption", "depth", F.map_from_entries(F.array_sort(F.map_entries("attributes"))).alias("attributes")))
    side = lambda df: df.select("kind", "parent", "name", "path", value.alias("value"))
    return keyed_diff(side(before), side(after), ["kind", "parent", "name", "path"], ["value"]).select("kind", "parent", "name", "path", "status")


#: What holds items of a kind, from the innermost holders to the outermost.
HOLDERS = (
    {"filter": ("group",)},
    {
        "relation": ("datasource",), "relationship": ("datasource",), "column": ("datasource",), "metadata": ("datasource",), "group": ("datasource",),
        "column-instance": ("datasource", "worksheet"), "rows": ("worksheet",), "cols": ("worksheet",), "worksheet-filter": ("worksheet",), "zone": ("dashboard",),
    },
)


def rolled_up(diff: DataFrame) -> DataFrame:
    """A diff of workbook_diff() in which what holds a changed item, at any depth, has changed too.

    Items are joined by equality to the places and names above them; nothing is compared in pairs.
    """
    parts = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    nested = diff.where("status <> 'none' AND path LIKE '%.%'").select("kind", "parent", F.explode(above).alias("path")).distinct()
    diff = _marked(diff, nested, ["kind", "parent", "path"])
    for holders in HOLDERS:
        pairs = [(k, h) for k, v in holders.items() for h in v]
        held = F.array(*(F.struct(F.lit(k).alias("of"), F.lit(h).alias("holder")) for k, h in pairs))
        marks = diff.where("status <> 'none'").select("kind", F.col("parent").alias("name"), F.inline(held)).where("kind = of").select(F.col("holder").alias("kind"), "name").distinct()
        diff = _marked(diff, marks, ["kind", "name"])
    return diff


def _marked(diff: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """The diff with what is marked and had not changed as changed."""
    rows = diff.join(marks.withColumn("__mark", F.lit(True)), keys, "left")
    status = F.when((F.col("status") == "none") & F.col("__mark").isNotNull(), "change").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*diff.columns)
