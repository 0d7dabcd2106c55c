"""Column functions: hashes, byte sizes, paths, versions, URLs, byte ranges, parsing rules. All run in the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text of a number as a strict parser takes it: no blanks, no type suffix.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|[0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?)$"
HASH_LEN = 64
ZERO_HASH = "0" * HASH_LEN


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_double(x) -> Column:
    """The number that a text spells, else null; a signed nan counts as NaN."""
    x = c(x)
    return F.when(x.rlike(NUMBER), F.coalesce(x.try_cast("double"), F.lit(float("nan"))))


def data_hash(x) -> Column:
    """Content id: 64 hex digits of SHA-256. Text is hashed as UTF-8."""
    return F.sha2(c(x), 256)


def salted(h, salt: Column) -> Column:
    """A hash under a salt, so that ids can be compared without giving them away."""
    return F.sha2(F.concat(salt.cast("binary"), F.unhex(c(h))), 256)


def is_hash(x) -> Column:
    return c(x).rlike("^[0-9a-fA-F]{64}$")


def truncated(h) -> Column:
    """The first 64 bits of a hash, as hex."""
    return F.substring(c(h), 1, 16)


def hash_mod(h, m: int) -> Column:
    """The last 64 bits of a hash modulo a power of two up to 4096."""
    if m & (m - 1) or not 0 < m <= 4096:
        raise ValueError("the modulus must be a power of two up to 4096")
    return F.conv(F.substring(c(h), 62, 3), 16, 10).cast("long") % m


def human_bytes(n) -> Column:
    """1024-based size: whole numbers as they are, others with two digits."""
    n = c(n).cast("long")
    out = F.when(n == 0, "0 bytes")
    for power, unit in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")):
        div = 1024**power
        text = F.when(n % div == 0, F.concat((n / div).cast("long").cast("string"), F.lit(f" {unit}")))
        out = out.when(n >= div, text.otherwise(F.concat(F.format_string("%.2f", n / F.lit(float(div))), F.lit(f" {unit}"))))
    return out.otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def file_name(path) -> Column:
    return F.regexp_extract(c(path), "([^/]*)$", 1)


def parent(path) -> Column:
    """The folder of a path, empty at the root."""
    return F.regexp_extract(c(path), "^(.*)/[^/]*$", 1)


def join_path(a, b) -> Column:
    return F.when(c(a) == "", c(b)).otherwise(F.concat(F.regexp_replace(c(a), "/+$", ""), F.lit("/"), c(b)))


def extension(path) -> Column:
    """What follows the last dot of the name, if a name comes before it."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def ancestors(path) -> Column:
    """All folders above a path, from the root (empty) down."""
    parts = F.split(c(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def normalize_path(path) -> Column:
    """A relative path without '.' and '..' steps."""
    steps = F.filter(F.split(c(path), "/"), lambda s: (s != "") & (s != "."))
    start = F.array().cast("array<string>")
    up = F.aggregate(steps, start, lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == "..", acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(up, "/")


def version_parts(x) -> Column:
    """major, minor, patch of the first x.y.z in a text; structs compare as versions do."""
    x, p = c(x), r"(\d+)\.(\d+)\.(\d+)"
    return F.when(x.rlike(p), F.struct(*(F.regexp_extract(x, p, k + 1).cast("long").alias(n) for k, n in enumerate(("major", "minor", "patch")))))


def repo_name(url) -> Column:
    """Last part of a remote's address without .git."""
    return F.regexp_extract(c(url), r"([^/:]+?)(?:\.git)?/*$", 1)


def is_remote(url) -> Column:
    return c(url).rlike(r"^(?:[a-z][a-z0-9+.-]*://|[^/@]+@[^/:]+:)")


def to_https(url) -> Column:
    """user@host:path and ssh://user@host/path as https://host/path."""
    u = F.regexp_replace(c(url), r"^ssh://(?:[^@/]+@)?", "https://")
    return F.regexp_replace(u, r"^[^/@]+@([^/:]+):", "https://$1/")


def byte_range(text) -> Column:
    """(start, end) of "start,end", half open; null if it is none."""
    t, p = c(text), r"^\s*(\d+)\s*,\s*(\d+)\s*$"
    a, b = (F.regexp_extract(t, p, k).try_cast("long") for k in (1, 2))
    return F.when(t.rlike(p) & (b >= a), F.struct(a.alias("start"), b.alias("end")))


def blocks_of_range(start, end, size: int = 16 << 20) -> Column:
    """The numbers of the blocks that a byte range touches."""
    s, e = c(start), c(end)
    return F.when(e > s, F.sequence(F.floor(s / size), F.floor((e - 1) / size))).otherwise(F.array().cast("array<bigint>"))


def paged(data, offset, count) -> Column:
    """(bytes, eof) of a read at an offset, both ends clamped."""
    d, o = c(data), c(offset)
    size = F.octet_length(d)
    first = F.least(F.greatest(o, F.lit(0)), size)
    last = F.least(first + F.greatest(c(count), F.lit(0)), size)
    return F.struct(F.substring(d, (first + 1).cast("int"), (last - first).cast("int")).alias("bytes"), (last >= size).alias("eof"))


def identifiers(x) -> Column:
    """The parts of [a].[b]."""
    return F.regexp_extract_all(c(x), F.lit(r"\[([^\]]+)\]"), F.lit(1))


def strip_brackets(x) -> Column:
    return F.regexp_replace(c(x), r"^\[+|\]+$", "")


def strip_quotes(x) -> Column:
    return F.regexp_replace(c(x), r"""^["']+|["']+$""", "")


def name_or_caption(name, caption) -> Column:
    return F.coalesce(F.nullif(c(caption), F.lit("")), strip_brackets(name))


def caption_of(derivation, x) -> Column:
    """A column under its aggregation: SUM(x), CNTD(x), AGG(x)."""
    d = c(derivation)
    return F.when(d.isNull() | d.isin("None", ""), c(x)).otherwise(
        F.concat(F.when(d == "User", "AGG").when(d == "CountD", "CNTD").otherwise(F.upper(d)), F.lit("("), c(x), F.lit(")"))
    )


def summary_kind(mime) -> Column:
    """Which analyzer a mime type asks for."""
    m = F.split_part(c(mime), F.lit(";"), F.lit(1))
    return F.when(m.isin("text/csv", "text/tab-separated-values"), "csv").when(m == "application/twb", "twb").when(m == "application/tds", "tds").otherwise("type")


def delimiter_for(path) -> Column:
    return F.when(extension(path) == "tsv", "\t").otherwise(",")


def is_small_text(data, threshold: int = 262063) -> Column:
    """Whether bytes are valid UTF-8 and short enough to stay as they are; threshold 0 turns it off."""
    d = c(data)
    if threshold == 0:
        return F.lit(False)
    return (F.octet_length(d) < threshold) & F.is_valid_utf8(d.cast("string"))


def may_start_text(data) -> Column:
    """Whether bytes are valid UTF-8 but for a character cut at the end."""
    d = c(data)
    return F.exists(F.sequence(F.lit(0), F.lit(3)), lambda k: F.is_valid_utf8(F.substring(d, F.lit(1), (F.octet_length(d) - k).cast("int")).cast("string")))


def is_large_file_pointer(text, prefix: str = "version https://git-lfs") -> Column:
    return c(text).startswith(prefix)


def parse_pointer(text, tag: str = "# pointer version", limit: int = 150) -> Column:
    """version, filesize, hash, is_valid of a pointer text: header line, then the two keys in any order.

    The tag is the first line without its number; pass the one that your store writes.
    """
    t = c(text)
    version = F.regexp_extract(t, rf"^{tag} (\S+)", 1)
    size = F.regexp_extract(t, r"(?m)^filesize\s*=\s*(\d+)\s*$", 1).try_cast("long")
    h = F.regexp_extract(t, r"""(?m)^hash\s*=\s*['"]([0-9a-f]{64})['"]\s*$""", 1)
    valid = (F.octet_length(t) < limit) & t.startswith(tag) & (version == "0") & size.isNotNull() & (h != "")
    return F.struct(F.coalesce(valid, F.lit(False)).alias("is_valid"), version.alias("version"), size.alias("filesize"), h.alias("hash"))


def pointer_text(h, size, tag: str = "# pointer version") -> Column:
    return F.format_string(f"{tag} 0\nfilesize = %d\nhash = '%s'\n", c(size).cast("long"), c(h))


def shard_name(h) -> Column:
    return F.concat(c(h), F.lit(".shard"))


def shard_hash_of_name(name) -> Column:
    return F.nullif(F.regexp_extract(c(name), r"([0-9a-f]{64})\.shard$", 1), F.lit(""))


def ids_in_text(x) -> Column:
    """All 40-digit object ids in a message."""
    return F.regexp_extract_all(c(x), F.lit(r"\b([0-9a-f]{40})\b"), F.lit(1))


def replace_ids(x, mapping: Column) -> Column:
    """A message with every object id that a map holds replaced."""
    pieces = F.regexp_extract_all(c(x), F.lit(r"\b[0-9a-f]{40}\b|[^0-9a-f]+|[0-9a-f]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(mapping[p], p)), "")


def geo_role(semantic_role) -> Column:
    """The kind of place in a semantic role such as [City].[Name]; null without one."""
    return F.nullif(F.regexp_extract(c(semantic_role), r"^\[([^\]]+)\]", 1), F.lit(""))


def summary_guard(size, limit: int = 262063) -> Column:
    """Null, or the error code of a blob that is too large to be summarised where it is."""
    return F.when(c(size) > limit, F.lit(7))


#: Names of compression schemes.
COMPRESSION = ("NONE", "LZ4")


def compression_scheme(name) -> Column:
    """A scheme's name as it is listed, whatever its letter case; null if there is none of that name."""
    upper = F.upper(F.trim(c(name)))
    return F.when(upper.isin(*COMPRESSION), upper)


def ring(hosts: list[str], points: int = 64) -> list[tuple[str, str]]:
    """Places of hosts on a ring of hashes: (hash, host) in order. Without a host there is no ring."""
    if not hosts:
        raise ValueError("a ring needs a host")
    return sorted((hashlib.sha256(f"{host}#{k}".encode()).hexdigest(), host) for host in set(hosts) for k in range(points))


def server_of(key, hosts: list[str], points: int = 64) -> Column:
    """The host whose place on the ring follows the hash of a key; a host that goes gives only its own keys away."""
    places = ring(hosts, points)
    following = F.filter(F.array(*(F.struct(F.lit(h).alias("at"), F.lit(name).alias("host")) for h, name in places)), lambda x: x.at >= F.sha2(c(key), 256))
    return F.coalesce(F.get(following, F.lit(0)).host, F.lit(places[0][1]))
