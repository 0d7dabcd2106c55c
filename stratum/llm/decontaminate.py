"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical words: numbers, names (capitalised within a sentence) and units (after a number)
turn into typed placeholders, everything else into lower case. Windows of eight canonical words are hash-joined with
those of all benchmark items. What hits on one diagonal of a document and an item must fill the slots consistently:
a value that the item repeats must be repeated by the document. An item counts as leaked if consistent diagonals
cover at least half of its windows, so questions with other numbers and names are found too; or if a consistent run of
matching words holds 13 or more that agree as they are (plain words, and slots filled with the item's own values),
whatever share of the item that is, so long exact passages are found. An item of fewer than eight words is one window
of its own length, of its words as they are; documents have such windows for the lengths that the benchmark has. Items
of fewer than four words say too little to be looked for within a sentence: they count where they make up a whole one
(from one of ``. ! ? : ;`` or a line's end to the next).

Documents are read once, all texts of about 1 MB together as arrays of characters, tokens and words; only windows that
survive a bit table of fixed size over the benchmark's hashes become strings again and reach the join, which then
decides exactly. Benchmark windows are broadcast only up to a counted bound.

Cases: null and empty texts and items hold no window; very long texts are read whole, in time linear in their length;
an empty table of documents or items gives no rows and drops nothing; windows of fewer than four plain words match only with the same numbers and names, and count for runs, or for the
share of an item that has no other windows; repeated rows (same id and text) give their matches once; null ids are ids
of their own; extra columns are ignored by find_leaks() and kept by drop_leaks(), whatever their names.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pieces, bounded_broadcast, fresh, kept, materialize, releasing, text_hash

WIDTH, PLAIN, COVERED = 8, 4, 0.5
#: Words of a consistent run that agree as they are; so many are a leak.
RUN = 13
BITS = 24
#: Units that follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml l cl dl gal s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years "
    "mph kmh hz khz mhz ghz w kw mw v a k c f eur usd gbp dollar dollars euro euros cent cents percent pct meter meters metre metres inch inches foot feet mile miles "
    "gram grams kilogram kilograms liter liters litre litres kb mb gb tb".split()
)
LONGEST = max(map(len, UNITS))
NUM, NAME, UNIT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
EXACT = np.uint64(0xC2B2AE3D27D4EB4F)
_PLAIN, _CAPITAL, _NUMBER, _STOP = 0, 1, 2, 4
#: Of a character: what it builds (letters, a number, a stop), then further marks.
_BUILDS, _POINT, _UPPER, _LOWER, _DIGIT, _SIGN = 3, 4, 8, 16, 32, 64
#: Characters that are looked at together.
SLICE = 1 << 17


@kept(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all characters the marks and the value of the lower-case form; of the marks the kind of a token that begins so."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    marks, low = np.zeros(len(every), np.uint8), np.arange(len(every), dtype=np.uint64)
    for builds, found in ((1, r"[^\W\d_]+"), (2, r"\d+"), (3, r"[.!?:;\n]+")):
        for m in re.finditer(found, every):
            marks[m.start() : m.end()] = builds
    marks[[ord("."), ord(",")]] |= _POINT
    for i in np.flatnonzero(marks == 1).tolist():
        c = every[i]
        if c.isupper():
            marks[i] |= _UPPER
        elif c.islower() or c.istitle():
            marks[i] |= _LOWER
        if not c.isalpha():
            marks[i] |= _DIGIT if c.isdigit() else _SIGN
        if len(c.lower()) == 1:  # the one longer form is no other character's
            low[i] = ord(c.lower())
    kinds = np.arange(256)
    builds = kinds & _BUILDS
    kinds = np.where((builds == 3) | (kinds & _SIGN > 0), _STOP, np.where((builds == 2) | (kinds & _DIGIT > 0), _NUMBER, _PLAIN)).astype(np.uint8)
    low = (low + np.uint64(1)) * MULTIPLY
    low = (low ^ (low >> np.uint64(30))) * MIX
    return marks, low ^ (low >> np.uint64(27)), kinds


@kept(2)
def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _slices(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """The characters of a text by number, a slice at a time."""
    for lo in range(0, len(text), SLICE):
        yield lo, np.frombuffer(text[lo : lo + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _spelled(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of a text that ends with a line: start, end, kind, and a hash of its lower-case form. Tokens are numbers
    (from a digit to a digit, over digits, points and commas), runs of other letters, and runs of ``.!?:;`` and line ends."""
    marks, values, kinds = _characters()
    mark = np.empty(len(text), np.uint8)
    for lo, at in _slices(text):
        mark[lo : lo + len(at)] = marks.take(at)
    builds = mark & _BUILDS
    points = np.flatnonzero(mark & _POINT)
    if len(points):  # a run of points between two digits is part of a number
        first = np.flatnonzero(np.diff(points, prepend=-2) > 1)
        last = np.append(first[1:], len(points)) - 1
        inner = (mark[points[first] - 1] & _BUILDS == 2) & (mark[points[last] + 1] & _BUILDS == 2) & (points[first] > 0)
        builds[points[np.repeat(inner, last - first + 1)]] = 2
    change = np.flatnonzero(builds[1:] != builds[:-1]) + 1
    start, end = np.concatenate([[0], change]), np.append(change, len(text))
    token = np.flatnonzero(builds[start])
    start, end = start[token], end[token]
    kind = kinds[mark[start]]
    upper = np.flatnonzero((mark[start] & _UPPER > 0) & (kind == _PLAIN))
    if len(upper):  # a capital with a small letter after it
        both = np.bitwise_or.reduceat(mark, np.stack([start[upper], end[upper]], 1).ravel())[::2]
        kind[upper[both & _LOWER > 0]] = _CAPITAL
    # the characters' values times powers of a base, summed up to each place; a token's sum is taken back to the power 0
    base, inverse = int(MULTIPLY), pow(int(MULTIPLY), -1, 1 << 64)
    h, back, carry = np.zeros(len(start), np.uint64), np.ones(len(start), np.uint64), np.zeros(1, np.uint64)
    for lo, at in _slices(text):
        total = values.take(at)
        total *= _powers(base)[: len(at)]
        total = np.concatenate([carry, np.cumsum(total) * np.uint64(pow(base, lo, 1 << 64)) + carry])
        (i, j), (m, n) = np.searchsorted(start, [lo, lo + len(at)]), np.searchsorted(end, [lo, lo + len(at)])
        h[m:n] += total[end[m:n] - lo]
        h[i:j] -= total[start[i:j] - lo]
        back[i:j] = _powers(inverse)[start[i:j] - lo] * np.uint64(pow(inverse, lo, 1 << 64))
        carry = total[-1:]
    h *= back
    if "\u03a3" in text:  # the one letter whose small form depends on its place
        places = [m.start() for m in re.finditer("\u03a3", text)]
        for i in np.unique(np.searchsorted(start, places, "right") - 1).tolist():
            low, h[i] = text[start[i] : end[i]].lower().replace("i\u0307", "\u0130"), 0
            for lo, at in _slices(low):
                h[i : i + 1] += (values.take(at) * _powers(base)[: len(at)] * np.uint64(pow(base, lo, 1 << 64))).sum(keepdims=True)
    h = (h ^ (h >> np.uint64(32))) * MIX
    return start, end, kind, h ^ (h >> np.uint64(29))


class Canon:
    """The canonical words of texts, one after the other."""

    def __init__(self, texts: list[str | None]) -> None:
        """Hashes of the canonical words and of the words as they are, whether each is a slot, how many sentences end before it, where it stands; of each text the first character and word."""
        self.text = "\n".join([t or "" for t in texts] + [""])
        start, end, kind, raw = _spelled(self.text)
        before = np.concatenate([np.array([_STOP], np.uint8), kind[:-1]])[: len(kind)]
        number = kind == _NUMBER
        unit = np.zeros(len(kind), bool)
        maybe = np.flatnonzero((before == _NUMBER) & (kind <= _CAPITAL) & (end - start <= LONGEST))
        unit[maybe] = [self.text[i:j].lower() in UNITS for i, j in zip(start[maybe].tolist(), end[maybe].tolist())]
        name = (kind == _CAPITAL) & (before != _STOP) & ~unit
        h = raw.copy()
        h[number], h[unit], h[name] = NUM, UNIT, NAME
        stop = kind == _STOP
        word = np.flatnonzero(~stop)
        self.h, self.raw, self.slot, self.sentence = h[word], raw[word], (number | unit | name)[word], np.cumsum(stop)[word]
        self.start, self.end = start[word], end[word]
        self.texts = np.cumsum([0] + [len(t or "") + 1 for t in texts[:-1]])
        self.first = np.searchsorted(self.start, self.texts)

    def token(self, w: int) -> str:
        return self.text[self.start[w] : self.end[w]].lower()

    def windows(self, lengths: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(starts, hashes, widths) of the windows, also of those that reach into the next text: first those that are
        specific enough, then the others by their words as they are, then those of the given shorter lengths; how many are
        of the first sort."""
        h, raw, sentence = self.h, self.raw, self.sentence
        n = len(h) - WIDTH + 1
        starts, hashes, widths, specific = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        if n > 0:
            plain = np.concatenate([[0], np.cumsum(~self.slot)])
            enough = plain[WIDTH:] - plain[:-WIDTH] >= PLAIN
            good, rest = np.flatnonzero(enough), np.flatnonzero(~enough)
            starts, hashes, widths, specific = [good, rest], [_rolled(h, n, 0)[good], _rolled(raw, n, EXACT, rest)], [np.full(n, WIDTH)], len(good)
        for width in lengths:
            m = len(raw) - width + 1
            if m > 0:
                places = np.arange(m)
                if width < PLAIN:  # whole sentences only
                    edge = np.concatenate([[-1], sentence, [sentence[-1] + 1]])
                    places = places[(edge[:m] < sentence[:m]) & (edge[width + 1 :] > sentence[width - 1 :]) & (sentence[:m] == sentence[width - 1 :])]
                starts.append(places)
                hashes.append(_rolled(raw, m, EXACT + np.uint64(width), places, width))
                widths.append(np.full(len(places), width))
        return np.concatenate(starts), np.concatenate(hashes), np.concatenate(widths), specific


def _rolled(h: np.ndarray, n: int, seed: int, at: np.ndarray | None = None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the windows of words h, of all n or of those that start at some places."""
    rolled = np.full(n if at is None else len(at), seed, np.uint64)
    for i in range(width):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * MULTIPLY + (h[i : i + n] if at is None else h[at + i])
    rolled = (rolled ^ (rolled >> np.uint64(32))) * MIX
    return rolled ^ (rolled >> np.uint64(32))


def windows(texts: DataFrame, table: np.ndarray | None, lengths: tuple[int, ...] = ()) -> DataFrame:
    """Rows (k, h, p, gram, slots) of the windows of texts (k, h, text); with a bit table only those in it, and also windows
    of the given shorter lengths; without, a shorter text is one window, and rows hold (n, extra) too: n windows make up the
    text, extra ones only lengthen runs."""
    fields = [*texts.schema.fields[:2], T.StructField("p", T.LongType()), T.StructField("gram", T.LongType()), T.StructField("slots", T.ArrayType(T.StringType()))]
    if table is None:
        fields += [T.StructField("n", T.LongType()), T.StructField("extra", T.BooleanType())]
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for whole in batches:
            for batch in arrow_pieces(whole, 1 << 20):
                rows, ps, grams, slots, ns, extras = [], [], [], [], [], []
                column = batch.column(2).to_pylist()
                for i, some in enumerate([column] if bits is not None else [[t] for t in column]):
                    canon = Canon(some)
                    p, g, width, specific = canon.windows(lengths)
                    if bits is not None:  # all texts of the batch at once
                        low = (g & np.uint64((1 << BITS) - 1)).astype(np.int64)
                        inside = np.flatnonzero((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
                        p, g, width = p[inside], g[inside], width[inside]
                        of = np.searchsorted(canon.first, p, "right") - 1
                        own = np.append(canon.first[1:], len(canon.h))[of] >= p + width
                        p, g, width, of = p[own], g[own], width[own], of[own]
                        rows += of.tolist()
                        ps += (p - canon.first[of]).tolist()
                    else:
                        n = len(canon.h)
                        if 0 < n < WIDTH:
                            p, g, width = np.zeros(1, np.int64), _rolled(canon.raw, 1, EXACT + np.uint64(n), None, n), np.array([n])
                        total = specific or len(p)
                        rows += [i] * len(p)
                        ps += p.tolist()
                        ns += [total] * len(p)
                        extras += [x >= total for x in range(len(p))]
                    slots += [[canon.token(j) if canon.slot[j] and n == WIDTH else "" for j in range(start, start + n)] for start, n in zip(p.tolist(), width.tolist())]
                    grams += g.view(np.int64).tolist()
                take = pa.array(rows, pa.int32())
                more = [pa.array(ns, pa.int64()), pa.array(extras, pa.bool_())] if bits is None else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(ps, pa.int64()), pa.array(grams, pa.int64()), pa.array(slots, pa.list_(pa.string())), *more],
                    [f.name for f in fields],
                )

    return texts.mapInArrow(releasing(run), T.StructType(fields))


def _evidence(hits: list[dict]) -> tuple[list[int], bool]:
    """Of the hits of a document and an item on one diagonal: the item's windows that count, and whether a run is long enough."""
    values = {f["w"]: (f["b"], f["d"]) for x in hits for f in x["fills"]}
    whole = {(f["b"], f["d"]) for x in hits if not x["extra"] for f in x["fills"]}
    counted = {x["q"] for x in hits if not x["extra"]} if len({b for b, _ in whole}) == len(whole) else set()
    ends, runs = [], []
    for lo, hi in sorted((x["q"], x["q"] + WIDTH) for x in hits):
        if ends and lo <= ends[-1][1]:
            ends[-1][1] = max(hi, ends[-1][1])
        else:
            ends.append([lo, hi])
    for lo, hi in ends:  # the longest consistent run up to every word
        start, agree, fill, times = lo, 0, {}, Counter()
        for w in range(lo, hi):
            b, d = values.get(w, ("", ""))
            while b and times[b] and fill[b] != d:
                old, new = values.get(start, ("", ""))
                times[old] -= 1
                agree -= old == new
                start += 1
            fill[b] = d
            times[b] += 1
            agree += b == d
            if agree >= RUN:
                if runs and runs[-1][0] == start:
                    runs[-1][1] = w + 1
                else:
                    runs.append([start, w + 1])
    counted |= {x["q"] for x in hits if not x["extra"] and any(lo <= x["q"] and x["q"] + WIDTH <= hi for lo, hi in runs)}
    return sorted(counted), bool(runs)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the column hits by qs, first and long."""
    for batch in batches:
        at = batch.schema.get_field_index("hits")
        found = [_evidence(x) for x in batch.column(at).to_pylist()]
        first = [min(x["q"] for x in hits) if not qs else qs[0] for hits, (qs, _) in zip(batch.column(at).to_pylist(), found)]
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in rest), pa.array([qs for qs, _ in found], pa.list_(pa.int64())), pa.array(first, pa.int64()), pa.array([x for _, x in found], pa.bool_())],
            [*(batch.schema.names[i] for i in rest), "qs", "first", "long"],
        )


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document (id and text) and leaked item: key, text_hash, item, n_windows, coverage, first_word."""
    asked = benchmark.select(F.col(item).alias("k"), text_hash(item_text).alias("h"), F.col(item_text).alias("text"))
    asked = materialize(windows(asked, None).dropDuplicates(["k", "h", "p"]))
    lows = asked.select(F.col("gram").bitwiseAND((1 << BITS) - 1).alias("low")).distinct().toArrow()["low"].to_numpy()
    lengths = tuple(sorted(r.n for r in asked.select(F.size("slots").alias("n")).where(F.col("n") < WIDTH).distinct().collect()))
    table = np.zeros(1 << (BITS - 3), np.uint8)
    np.bitwise_or.at(table, lows >> 3, (1 << (lows & 7)).astype(np.uint8))
    found = windows(docs.select(F.col(key).alias("k"), text_hash(text).alias("h"), F.col(text).alias("text")), table, lengths)
    items = bounded_broadcast(asked, 200_000).select(F.col("k").alias("item"), F.col("h").alias("ih"), F.col("p").alias("q"), "gram", F.col("slots").alias("item_slots"), F.col("n").alias("item_n"), "extra")
    hits = found.join(items, "gram")
    zipped = F.transform(F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d")), lambda x, i: F.struct((F.col("q") + i).alias("w"), x.b.alias("b"), x.d.alias("d")))
    filled = F.filter(zipped, lambda x: (x.b != "") | (x.d != ""))
    diagonals = hits.groupBy("k", "h", "item", "ih", "item_n", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set(F.struct("q", "extra", filled.alias("fills"))).alias("hits"))
    kinds = [*diagonals.schema.fields[:-1], T.StructField("qs", T.ArrayType(T.LongType())), T.StructField("first", T.LongType()), T.StructField("long", T.BooleanType())]
    weighed = diagonals.mapInArrow(releasing(_weigh), T.StructType(kinds)).where((F.size("qs") > 0) | F.col("long"))
    share = F.size(F.array_distinct(F.flatten(F.collect_list("qs"))))
    leaks = weighed.groupBy("k", "h", "item", "ih", "item_n").agg(share.cast("long").alias("n_windows"), F.min(F.col("first") + F.col("diagonal")).alias("first_word"), F.max("long").alias("long"))
    coverage = F.col("n_windows") / F.col("item_n")
    return leaks.where((coverage >= COVERED) | F.col("long")).select(F.col("k").alias(key), F.col("h").alias("text_hash"), F.col("item").alias(item), "n_windows", coverage.alias("coverage"), "first_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leaked item, all columns."""
    bad = materialize(find_leaks(docs, benchmark, key, text).select(F.col(key).alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    (h,) = fresh(docs, "text_hash")
    marked = docs.withColumn(h, text_hash(text))
    bad = bounded_broadcast(bad)
    return marked.join(bad, marked[key].eqNullSafe(bad.bad_id) & (marked[h] == bad.bad_hash), "left_anti").drop(h)
