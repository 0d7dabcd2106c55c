"""Readers and writers: delimited text with inferred headers, tree listings, folders of files, stores, pointers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.scalar import NUMBER, c

COLUMNS = 50
LEAST_BYTES = 256 << 10


def delimiter(name: str) -> str:
    """The character for comma, tab or a path that ends in .csv or .tsv."""
    known = {"comma": ",", ",": ",", "tab": "\t", "\t": "\t"}
    if name in known:
        return known[name]
    if name.lower().endswith(".tsv"):
        return "\t"
    if name.lower().endswith(".csv"):
        return ","
    raise ValueError(f"no delimiter is called {name}")


class TableParser:
    """Rows of delimited text from byte pieces cut anywhere, also within quotes or characters.

    Quotes double within quotes; bytes that are no UTF-8 become replacement characters; the last row needs no break.
    """

    def __init__(self, sep: str = ","):
        self.sep, self.left, self.rows = sep, b"", []

    def feed(self, piece: bytes, last: bool = False) -> list[list[str]]:
        data = self.left + piece
        rows, start, i, quoted, cells, cell_at, n = [], 0, 0, False, [], 0, len(data)
        sep = ord(self.sep)
        while i < n:
            b = data[i]
            if b == 34:
                if quoted and i + 1 == n and not last:
                    break  # the next piece tells whether it is doubled
                quoted = not quoted
            elif not quoted and b == sep:
                cells.append(data[cell_at:i])
                cell_at = i + 1
            elif not quoted and b in (10, 13):
                if b == 13 and i + 1 == n and not last:
                    break
                cells.append(data[cell_at:i])
                i += b == 13 and i + 1 < n and data[i + 1] == 10
                rows.append(cells)
                cells, cell_at, start = [], i + 1, i + 1
            i += 1
        self.left = data[start:]
        if last and self.left:
            rows.append([*cells, data[cell_at:]])
            self.left = b""
        return [[self._text(x) for x in r] for r in rows if r != [b""]]

    @staticmethod
    def _text(cell: bytes) -> str:
        if cell[:1] == b'"':
            cell = cell[1 : -1 if cell[-1:] == b'"' and len(cell) > 1 else None].replace(b'""', b'"')
        return cell.decode("utf-8", "replace")


def is_number(x: str) -> bool:
    import re

    return re.match(NUMBER, x) is not None


def infer_header(first: list[str]) -> tuple[list[str], bool]:
    """Names, and whether the first row holds them: it does if every cell is empty or no number."""
    if all(x == "" or not is_number(x) for x in first):
        return list(first), True
    return [f"Column {i}" for i in range(len(first))], False


def read_table_files(spark: SparkSession, path: str, glob: str = "*", sep: str | None = None, columns: int = COLUMNS, piece: int = 1 << 16) -> DataFrame:
    """Cells of all delimited files under a path: file, row (from 0, header aside), col, name, value; the first 50
    columns. Cells beyond the header's are dropped and missing ones skipped; the first row without header is trimmed.

    Files are parsed one at a time in pieces, one task for some files; a cell table feeds the profile by file and column.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                parser, header, at, out = TableParser(sep or ("\t" if name.lower().endswith(".tsv") else ",")), None, 0, []
                for k in range(0, len(content) + 1, piece):
                    for row in parser.feed(content[k : k + piece], k + piece > len(content)):
                        if header is None:
                            header, named = infer_header(row)
                            if named:
                                continue
                            row = [x.strip() for x in row]
                        out += [(name, at, i, header[i], v) for i, v in enumerate(row[: min(columns, len(header))])]
                        at += 1
                    if len(out) > 50_000:
                        yield pd.DataFrame(out, columns=["file", "row", "col", "name", "value"])
                        out = []
                yield pd.DataFrame(out, columns=["file", "row", "col", "name", "value"])

    return files.select("path", "content").mapInPandas(run, "file string, row long, col int, name string, value string")


def read_wide_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One table of many files of one layout, all columns text, read in splits by the built-in reader."""
    return spark.read.csv(path, sep=sep, header=True, multiLine=False, quote='"', escape='"', mode="PERMISSIVE")


def large_enough(files: DataFrame, size: str = "length", least: int = LEAST_BYTES) -> DataFrame:
    """Files that are worth a summary."""
    return files.where(F.col(size) >= least)


def list_files(spark: SparkSession, path: str, modified_after: str | None = None, recursive: bool = True, content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of the files under a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    df = reader.load(path)
    return df if content else df.drop("content")


def parse_tree_listing(lines: DataFrame, text: str = "line") -> DataFrame:
    """mode (number), type, oid, size (null for folders), path of `mode type oid size<TAB>path` lines."""
    p = r"^(\d+) (\w+) ([0-9a-f]+)\s+(-|\d+)\t(.*)$"
    part = lambda k: F.regexp_extract(text, p, k)
    return lines.where(F.col(text).rlike(p)).select(
        F.conv(part(1), 8, 10).cast("int").alias("mode"), part(2).alias("type"), part(3).alias("oid"), part(4).try_cast("long").alias("size"), unquote_path(part(5)).alias("path")
    )


@F.pandas_udf(T.StringType())
def _unquote(s: pd.Series) -> pd.Series:
    import re

    plain = {"n": b"\n", "t": b"\t", "r": b"\r", "a": b"\a", "b": b"\b", "f": b"\f", "v": b"\v", '"': b'"', "\\": b"\\"}

    def one(x: str | None) -> str | None:
        if x is None or len(x) < 2 or x[0] != '"' or x[-1] != '"':
            return x
        parts = re.split(r"(\\[0-7]{3}|\\.)", x[1:-1])
        return b"".join(p.encode() if not p.startswith("\\") else plain.get(p[1:], p.encode()) if len(p) == 2 else bytes([int(p[1:], 8) & 255]) for p in parts).decode("utf-8", "replace")

    return s.map(one)


def unquote_path(x):
    """A path in double quotes with its escapes (octal bytes, letters) undone; other paths stay."""
    x = c(x)
    return F.when(x.startswith('"'), _unquote(x)).otherwise(x)


def children(tree: DataFrame, folder: str = "") -> DataFrame:
    """name, type (file or dir), size of what lies directly in a folder."""
    base = f"{folder}/" if folder else ""
    rows = tree.where(F.col("path").startswith(base)).withColumn("rest", F.substring("path", F.lit(len(base) + 1), F.length("path")))
    name = F.split_part("rest", F.lit("/"), F.lit(1))
    return rows.groupBy(name.alias("name")).agg(F.when(F.max(F.col("rest").contains("/").cast("int")) == 1, "dir").otherwise("file").alias("type"), F.sum("size").alias("size"))


def directory_size(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


STORE_KEYS = {"file_segments": ["file_hash", "seq"], "cas_chunks": ["cas_hash", "idx"], "cas_blocks": ["cas_hash"], "cas_data": ["cas_hash"]}


def write_store(tables: dict[str, DataFrame], path: str, partitions: int | None = None, rows_per_file: int = 4_000_000) -> None:
    """Each table sorted by its hash within ranges of hashes, so that lookups read few row groups.

    A file is closed at so many rows. A table appears as a whole, when its job commits.
    """
    for name, df in tables.items():
        if name in STORE_KEYS:
            by = STORE_KEYS[name]
            df = (df.repartitionByRange(partitions, by[0]) if partitions else df.repartitionByRange(by[0])).sortWithinPartitions(*by)
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{name}")


def store_name(table: DataFrame, key: list[str]) -> str:
    """A name from what a table holds, whatever the order of its rows: one aggregation."""
    r = table.select(F.xxhash64(*key).cast("decimal(38,0)").alias("a"), F.xxhash64(*key, F.lit(1)).cast("decimal(38,0)").alias("b")).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return hashlib.sha256(f"{r.n}:{r.a}:{r.b}".encode()).hexdigest()


def read_store(spark: SparkSession, path: str, names: Iterable[str] = tuple(STORE_KEYS)) -> dict[str, DataFrame]:
    """The tables of one store, or with a pattern for path ('stores/*') of all stores, a column store saying whose rows they are."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    return out if "*" not in path else {n: df.withColumn("store", F.regexp_extract(F.input_file_name(), f"([^/]+)/{n}/[^/]*$", 1)) for n, df in out.items()}


def append_notes(df: DataFrame, path: str) -> None:
    """Add rows to an append-only log."""
    df.withColumn("note_time", F.current_timestamp()).write.mode("append").parquet(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def to_text(df: DataFrame, sep: str = ", ") -> DataFrame:
    """Each row as a line of text, its columns with a separator between; nulls are empty."""
    return df.select(F.concat_ws(sep, *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in df.columns)).alias("value"))


def flatten_metrics(df: DataFrame, name: str = "name", labels: str = "labels", value: str = "value", buckets: str | None = None) -> DataFrame:
    """(name, value) of metrics: labels (a map) behind the name, by key; a histogram's buckets (bound to count) one by one."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    whole = F.concat(F.col(name), F.when(F.size(labels) > 0, F.concat(F.lit("{"), text, F.lit("}"))).otherwise(""))
    plain = df.where(F.col(value).isNotNull()).select(whole.alias("name"), F.col(value).cast("double").alias("value"))
    if not buckets:
        return plain
    each = df.where(F.col(buckets).isNotNull()).select(whole.alias("name"), F.explode(buckets).alias("bound", "count"))
    return plain.unionByName(each.select(F.concat("name", F.lit(".le_"), F.col("bound").cast("string")).alias("name"), F.col("count").cast("double").alias("value")))


def export_standalone(segments: DataFrame, chunks: DataFrame, file_hash: str) -> DataFrame:
    """All rows that one file needs, as one table (kind, json), which import_standalone() takes back."""
    s = segments.where(F.col("file_hash") == file_hash)
    k = chunks.join(s.select("cas_hash").distinct(), "cas_hash", "left_semi")
    return s.select(F.lit("segment").alias("kind"), F.to_json(F.struct(*s.columns)).alias("json")).unionByName(k.select(F.lit("chunk").alias("kind"), F.to_json(F.struct(*k.columns)).alias("json")))


def import_standalone(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("x")).select("x.*")
