"""Secret scans with a worklist of decoded layers.

Each text is the first layer. A layer is scanned for secrets; URL escapes and Unicode escapes in it give one new
layer each, every base64 run one more, whatever bytes it holds, and one for each reading as UTF-16 if there are NULs.
Base64 that is wrapped over lines is read line by line and as a whole. Compressed bytes (gzip, zlib and bzip2 with all
their members, and base64 that is raw deflate from end to end) are inflated wherever they begin: in base64, in URL or
backslash escapes (read byte by byte), or as characters below U+0100. New layers join the worklist until none is left;
a layer whose content was seen before at the same place is not taken again, and compressed bytes that are being opened
already are not opened within themselves, so cycles end. Every decoded character knows the span of the text it came
from, and what is found in a layer is reported at that span, under a kind that names the decoding, such as
``url.assign``; what is found in compressed bytes, at the span of these.

What comes out of compressed bytes is never held whole: it is scanned in windows that overlap, each a worklist of its
own, and an encoded run that goes on beyond a window is decoded as it comes. So there is no limit to what is read, and
memory depends on the text and on WINDOW alone. Equal compressed bytes of a text are opened once, if they fit a window.
Compressed bytes are found anywhere in such a stream and in base64 in it, as in bytes that are held. Two limits remain:
compressed bytes are followed DEPTH deep into one another (they can be made to grow for ever), and in an inflated stream
of more than WINDOW bytes, escapes (and what stands in them) that go on beyond a window are read window by window, so
compressed bytes in them are followed only if they fit in one.

Cases: null and empty texts have no spans; very long texts are read whole, in time linear in their length; rows may
repeat; an empty table gives no rows; each row stands alone, other columns, whatever their names, are kept by redact()
and ignored by find_secrets().
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pieces, releasing

#: Kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: As in forms, where a blank is a plus sign.
FORM = re.compile(r"(?:%[0-9A-Fa-f]{2}|\+)+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+(?:\r\n|\r|\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
BASE64_PARTS = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
#: How compressed bytes begin; zlib's other headers count at the start of bytes only.
COMPRESSED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\x78[\x01\x5e\x9c\xda]")
COMPRESSED_CHARS = re.compile("\x1f\x8b\x08|BZh[1-9]1AY&SY|\x78[\x01\x5e\x9c\xda]")
#: Escapes of bytes that are no printable ASCII; compressed bytes hold some.
ESCAPED = re.compile(r"%[0189A-Fa-f][0-9A-Fa-f]|\\(?:x|u00)[0189A-Fa-f][0-9A-Fa-f]")
BACKSLASH = re.compile(r"""\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[0abtnvfr\\'"]""")
SHORT = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}
#: Bytes of an inflated stream that are looked at together, and how many of them again with the next ones.
WINDOW, OVERLAP = 1 << 20, 1 << 16
#: How deep compressed bytes are followed into one another.
DEPTH = 50
PIECE = 1 << 14
RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n"
OPEN = RUN + b"=%\\.~&#;"
MASK = "[REDACTED]"
LATIN = re.compile("[\x00-\xff]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the secrets that stand in a text as they are."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text; pieces say which stretch of it came from which span of the original, which ones are as they stand
    there (kept), and which ones stood so in the layer before (old)."""

    __slots__ = ("text", "name", "starts", "spans", "kept", "old")

    def __init__(self, text: str, name: str, starts: list[int], spans: list[tuple[int, int]], kept: list[bool], old: list[bool] | None = None):
        self.text, self.name, self.starts, self.spans, self.kept, self.old = text, name, starts, spans, kept, old or kept

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original under [start, end) of this layer."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, max(start, end - 1)) - 1
        a, b = self.spans[i][0], self.spans[j][1]
        if self.kept[i]:
            a += start - self.starts[i]
        if self.kept[j]:
            b = self.spans[j][0] + end - self.starts[j]
        return a, b

    def decoded(self, start: int, end: int) -> bool:
        """Whether a stretch that the layer before had not touches [start, end)."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, max(start, end - 1)) - 1
        return not all(self.old[i : j + 1])


def _from_url(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _from_unicode(run: str) -> str:
    if run[0] == "&":
        return html.unescape(run)
    if run[1] == "u":
        units = bytes.fromhex(run.replace("\\u", ""))
        return units.decode("utf-16-be", "replace")
    if run[1] == "x":
        return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")
    code = int(run[2:], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


class Inflate:
    """Inflates bytes that come in pieces, all members that follow one another, into a Stream."""

    def __init__(self, head: bytes, sink: Stream, raw: bool = False):
        self.make = bz2.BZ2Decompressor if head[:3] == b"BZh" else lambda: zlib.decompressobj(-15 if raw else 47)
        self.starts = (b"BZh",) if head[:3] == b"BZh" else (b"\x1f\x8b",) if head[:2] == b"\x1f\x8b" else ()
        self.step = 1 if head[:3] == b"BZh" else PIECE  # bz2 gives up what a call had said before a fault
        self.d, self.sink, self.broken, self.some = self.make(), sink, False, False

    def _step(self, d, data: bytes) -> bytes:
        """Take data, or what was left of it; the rest of it stays with the inflater."""
        return d.decompress(data, WINDOW)

    def _left(self, d) -> bytes | None:
        """What to go on with; None: new data."""
        if d.eof:
            return None
        if isinstance(d, bz2.BZ2Decompressor):
            return None if d.needs_input else b""
        return d.unconsumed_tail or None

    def _out(self, data: bytes) -> None:
        if data:
            self.some = True
            self.sink.feed(data)

    def feed(self, data: memoryview | bytes) -> int:
        """Bytes used, up to the end of the last member or a fault; what comes before a fault counts. Last bytes that may
        begin a member are not used: they are to be given again, with what follows."""
        at = 0
        while at < len(data) and not self.broken:
            if self.d.eof:
                start = bytes(data[at : at + 3])
                if any(len(start) < len(x) and x.startswith(start) for x in self.starts):
                    break
                if not start.startswith(self.starts or b"\0no"):
                    self.broken = True
                    break
                self.d = self.make()
            piece = bytes(data[at : at + self.step])
            before = self.d.copy() if hasattr(self.d, "copy") else None
            part, told = piece, 0
            try:
                while part is not None:
                    out = self._step(self.d, part)
                    told += len(out)
                    self._out(out)
                    part = self._left(self.d)
                at += len(piece) - len(self.d.unused_data)
            except (zlib.error, OSError, EOFError, ValueError):
                self.broken = True
                at += self._up_to_fault(before, piece, told)
        return at

    def _up_to_fault(self, d, piece: bytes, told: int) -> int:
        """Byte by byte again, for what a call gave up together with its fault; told: what it has already said."""
        for i in range(len(piece) if d else 0):
            try:
                out = d.decompress(piece[i : i + 1])
            except zlib.error:
                return i
            self._out(out[told:])
            told = max(0, told - len(out))
        return len(piece)


class Stream:
    """The kinds of secrets in bytes that come in pieces: whole if they fit a window, else window by window."""

    def __init__(self, name: str, depth: int, opened: dict, coded: bool = False):
        self.name, self.depth, self.opened, self.coded, self.found = name, depth, opened, coded, set()
        self.buffer, self.kept, self.long = bytearray(), 0, False
        self.inside: Inside | None = None  # of a long stream
        self.raw: Inflate | None = None  # of a long stream that may be raw deflate as a whole
        self.run: Stream | None = None  # of a long base64 run
        self.pending = b""

    def feed(self, data: bytes) -> None:
        while data:  # by windows, whatever the size of a piece
            part, data = data[:WINDOW], data[WINDOW:]
            if self.inside:
                self.inside.feed(part)
            if self.raw:
                self.raw.feed(part)
            if self.run:
                self._go_on(part)
            self.buffer += part
            if len(self.buffer) > self.kept + WINDOW:
                self._window()

    def _window(self) -> None:
        data = bytes(self.buffer)
        if not self.long:
            self.long = True
            if self.depth < DEPTH:
                self.inside = Inside(self.depth, self.opened)
                self.inside.feed(data)
                if self.coded:
                    self.raw = Inflate(b"", Stream("zip", self.depth + 1, self.opened), True)
                    self.raw.feed(data)
        data = re.sub(rb" {65,}", b" " * 64, data)  # so that a name and its value never get far apart
        self._scan(data)
        start, keep = len(data.rstrip(RUN)), len(data.rstrip(OPEN))
        if self.run is None and len(data) - start > WINDOW // 2 and self.depth < DEPTH:
            self.run, self.pending = Stream("base64", self.depth + 1, self.opened, True), b""
            self._go_on(data[start:])
        keep = len(data) - OVERLAP if len(data) - keep > WINDOW // 2 else min(keep, len(data) - OVERLAP)
        self.buffer = bytearray(data[max(0, keep) :])
        self.kept = len(self.buffer)

    def _go_on(self, data: bytes) -> None:
        """Decode what belongs to the run; it ends with the first character that does not."""
        rest = data.lstrip(RUN)
        coded = self.pending + data[: len(data) - len(rest)].translate(bytes.maketrans(b"-_", b"+/"), b"\r\n")
        cut = len(coded) if rest else len(coded) // 4 * 4
        self.pending = coded[cut:]
        self.run.feed(_bytes(coded[:cut].decode("ascii")))
        if rest:
            self._end_run()

    def _end_run(self) -> None:
        self.run.feed(_bytes(self.pending.decode("ascii")))
        self.found |= self.run.close()
        self.run, self.pending = None, b""

    def _scan(self, data: bytes) -> None:
        for text, *_ in _readings(data, [0, len(data)]):
            self.found |= {kind for _, kind, _ in unwrap(Layer(text, self.name, [0], [(0, len(text))], [False]), self.opened, self.depth)}

    def close(self) -> set[str]:
        if self.run:
            self._end_run()
        data = bytes(self.buffer)
        if data:
            self._scan(data)
            if not self.long:
                self.found = self.found.union(*(kinds for kinds, *_ in kinds_inside(data, self.opened, self.depth, self.coded)))
        if self.inside:
            self.found |= self.inside.close()
        if self.raw and self.raw.d.eof and not self.raw.broken:
            self.found |= self.raw.sink.close()
        return self.found


class Inside:
    """The kinds of secrets in compressed bytes anywhere in bytes that come in pieces, as kinds_inside() finds them in bytes
    that are held: what ends within a window is opened as one, what goes on beyond it is inflated as it comes."""

    def __init__(self, depth: int, opened: dict, first: bool = True):
        self.depth, self.opened, self.found = depth, opened, set()
        self.buffer, self.first = bytearray(), first
        self.probe: Inflate | None = None  # tells where what the buffer begins with ends
        self.told = 0
        self.item: Inflate | None = None  # what goes on beyond a window
        self.rest: Inside | None = None  # what follows the item's first byte, while it is not known to be compressed

    def feed(self, data: bytes) -> None:
        chain = [self]
        while chain[-1].rest:
            chain.append(chain[-1].rest)
        for x in reversed(chain):
            x.buffer += data
            while x._decided(False):
                pass

    def close(self) -> set[str]:
        while self._decided(True):
            pass
        return self.found

    def _decided(self, last: bool) -> bool:
        """Take one step; whether there may be another one before more bytes come."""
        if self.item:
            return self._item(last)
        if not self.probe:
            start = 0
            if not (self.first and _compressed(bytes(self.buffer[:PIECE]))):
                m = COMPRESSED.search(self.buffer, int(self.first))
                if not m:  # the longest of these starts has ten bytes
                    self.first = False
                    del self.buffer[: max(0, len(self.buffer) - 9)]
                    return False
                start = m.start()
            self.first = False
            del self.buffer[:start]
            self.probe, self.told = Inflate(bytes(self.buffer[:PIECE]), Stream("", DEPTH, {})), 0
            self.probe.sink.feed = len
        used = -1
        while used and not self.probe.broken and self.told < len(self.buffer):
            used = self.probe.feed(bytes(self.buffer[self.told : self.told + PIECE]))
            self.told += used
        if self.probe.broken or last:
            used = self.told if self.probe.some else 0
            if used:
                self.found |= kinds_at(bytes(self.buffer[:used]), self.opened, self.depth)[0]
            del self.buffer[: max(1, used)]
            self.probe = None
            return True
        if len(self.buffer) <= WINDOW:
            return False
        if not self.probe.some:
            self.rest = Inside(self.depth, self.opened, False)
            self.rest.feed(bytes(self.buffer[1:]))
        self.item, self.probe = Inflate(bytes(self.buffer[:PIECE]), Stream("zip", self.depth + 1, self.opened)), None
        return True

    def _item(self, last: bool) -> bool:
        del self.buffer[: self.item.feed(bytes(self.buffer))]
        if self.item.some:
            self.rest = None
        if not self.item.broken and not last:
            return False
        self.found |= self.item.sink.close()
        self.item = None
        if x := self.rest:  # it was none
            self.found |= x.found
            self.buffer, self.probe, self.told, self.item, self.rest = x.buffer, x.probe, x.told, x.item, x.rest
        return True


def _compressed(data: bytes) -> bool:
    """Whether bytes begin as compressed ones do."""
    return bool(COMPRESSED.match(data)) or data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 < 8 and (data[0] << 8 | data[1]) % 31 == 0


def kinds_at(data: memoryview | bytes, opened: dict, depth: int, raw: bool = False) -> tuple[set[str], int]:
    """Kinds of secrets in the compressed bytes that data begins with, and how many bytes these are (0: none)."""
    if depth >= DEPTH:
        return set(), 0
    head = bytes(data[:PIECE])
    probe = Inflate(b"" if raw else head, Stream("", DEPTH, {}), raw)
    probe.sink.feed = len  # only whether it goes on
    probe.feed(head)
    if probe.broken:
        data = head
    digest = hashlib.sha256(data).digest() + bytes([raw])
    if digest not in opened:
        opened[digest] = (set(), 0)  # for what holds itself
        inflate = Inflate(b"" if raw else head, Stream("zip", depth + 1, opened), raw)
        used = inflate.feed(data)
        if raw and (inflate.broken or used < len(data) or not inflate.d.eof):
            return opened[digest]
        opened[digest] = (inflate.sink.close(), used if inflate.some else 0)
    return opened[digest]


def kinds_inside(data: bytes, opened: dict, depth: int, coded: bool = False) -> Iterator[tuple[set[str], int, int]]:
    """(kinds, start, end) of secrets in compressed bytes anywhere in data; coded: data may be raw deflate as a whole."""
    at, view = 0, memoryview(data)
    if _compressed(data):
        kinds, at = kinds_at(view, opened, depth)
        yield kinds, 0, at
    while m := COMPRESSED.search(data, max(at, 1)):
        kinds, used = kinds_at(view[m.start() :], opened, depth)
        at = m.start() + max(1, used)
        yield kinds, m.start(), at
    if coded:
        yield kinds_at(view, opened, depth, True)[0], 0, len(data)


def _bytes(run: str) -> bytes:
    body = run.rstrip("=")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return b""


def _readings(data: bytes, cuts: list[int]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Bytes as UTF-8, and if there are NULs as UTF-16 either way from either byte: the text, where the stretches
    between cuts start in it, and which stretches have any text."""
    for coding, skip in (("utf-8", 0), *((c, k) for c in ("utf-16-le", "utf-16-be") for k in (0, 1) if 0 in data)):
        reader, out, starts, which, size = codecs.getincrementaldecoder(coding)("replace"), [], [], [], 0
        for k in range(len(cuts) - 1):
            text = reader.decode(data[max(cuts[k], skip) : cuts[k + 1]], k + 2 == len(cuts))
            if text:
                starts.append(size)
                which.append(k)
                out.append(text)
                size += len(text)
        if out:
            yield "".join(out), starts, which


def _place(lines: list[tuple[int, int]], n: int) -> int:
    """Where the n-th character of some lines stands."""
    for a, b in lines:
        if n < b - a:
            return a + n
        n -= b - a
    return lines[-1][1] - 1


def _from_base64(layer: Layer, lines: list[tuple[int, int]], found: Found, zipped: bool = False) -> Iterator[Layer]:
    """The layers in a base64 run that stands on one or more lines; on request only what is compressed in it."""
    data = _bytes("".join(layer.text[a:b] for a, b in lines))
    if not data:
        return
    for kinds, start, end in kinds_inside(data, found.opened, found.depth, True):
        if kinds:
            first, last = _place(lines, start * 4 // 3), _place(lines, (end * 4 - 1) // 3)
            found.add(kinds, layer.origin(first, first + 1)[0], layer.origin(last, last + 1 if end < len(data) else lines[-1][1])[1])
    if zipped:
        return
    cuts, spans, at = [], [], 0
    for k, (a, b) in enumerate(lines):  # a byte can lie on two lines
        cuts.append(min(at * 3 // 4, len(data)))
        spans.append((layer.origin(*((lines[k - 1][1] - 1, b) if at % 4 else (a, b)))))
        at += b - a
    cuts.append(len(data))
    for text, starts, which in _readings(data, cuts):
        yield Layer(text, "base64", starts, [spans[k] for k in which], [False] * len(which))


def _from_wrapped(layer: Layer, start: int, end: int, found: Found) -> Iterator[Layer]:
    """The layers in base64 lines read as one, from wherever a run may begin: other words can stand before it."""
    lines = [m.span() for m in LINE.finditer(layer.text, start, end)]
    lines[-1] = (lines[-1][0], end)
    ways = set()
    for k, (a, b) in enumerate(lines):
        for at in (a, *(m.start() for m in BASE64_PARTS.finditer(layer.text, a, b) if k == 0 and m.start() > a)):
            way = (sum(y - x for x, y in lines[:k]) + at - a) % 4 if len(ways) < 4 else -1
            known = way < 0 or way in ways
            if not known or layer.text.startswith(("H4sI", "Qlpo", "eA", "eF", "eJ", "eN"), at):
                yield from _from_base64(layer, [(at, b), *lines[k + 1 :]], found, known)
            ways.add(way)


def _rewritten(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with every match of a pattern decoded, if there is any."""
    out, starts, spans, kept, old, at, size = [], [], [], [], [], 0, 0

    def add(text: str, start: int, end: int, whole: bool) -> None:
        nonlocal size
        if not text:
            return
        if whole:  # keep the pieces of this layer apart
            k = bisect_right(layer.starts, start) - 1
            while start < end:
                stop = min(end, layer.starts[k + 1] if k + 1 < len(layer.starts) else end)
                starts.append(size)
                spans.append(layer.origin(start, stop))
                kept.append(layer.kept[k])
                old.append(True)
                out.append(layer.text[start:stop])
                size += stop - start
                start, k = stop, k + 1
        else:
            starts.append(size)
            spans.append(layer.origin(start, end))
            kept.append(False)
            old.append(False)
            out.append(text)
            size += len(text)

    for m in pattern.finditer(layer.text):
        add(layer.text[at : m.start()], at, m.start(), True)
        add(decode(m[0]), m.start(), m.end(), False)
        at = m.end()
    if not at:
        return None
    add(layer.text[at:], at, len(layer.text), True)
    return Layer("".join(out), name, starts, spans, kept, old) if out else None


class Found:
    """Spans (start, kind, end) of a worklist, the compressed bytes opened for it, and how deep in others it is."""

    def __init__(self, opened: dict, depth: int):
        self.spans, self.opened, self.depth = set(), opened, depth

    def add(self, kinds: set[str], start: int, end: int) -> None:
        self.spans.update((start, kind, end) for kind in kinds)


def _open_escaped(layer: Layer, found: Found) -> None:
    """Compressed bytes in a layer: as characters below U+0100, or as escapes of bytes among other characters."""
    views = [layer] if COMPRESSED_CHARS.search(layer.text) else []
    if ESCAPED.search(layer.text):
        from_url = lambda run: bytes.fromhex(run.replace("%", "").replace("+", "20")).decode("latin-1")
        views += [_rewritten(layer, URL, from_url, ""), _rewritten(layer, FORM, from_url, "") if "+" in layer.text else None]
        views.append(_rewritten(layer, BACKSLASH, lambda c: chr(int(c[2:], 16)) if c[1] in "xu" else SHORT.get(c[1], c[1]), ""))
    for view in filter(None, views):
        at = start = end = 0
        while m := COMPRESSED_CHARS.search(view.text, at):
            at = m.start()
            if at >= end:
                start, end = LATIN.match(view.text, at).span()
                stretch = view.text[start:end].encode("latin-1")
            kinds, used = kinds_at(memoryview(stretch)[at - start :], found.opened, found.depth)
            used = max(1, used)
            if kinds:
                found.add(kinds, *view.origin(at, at + used))
            at += used


def unwrap(first: Layer, opened: dict, depth: int = 0) -> set[tuple[int, str, int]]:
    """(start, kind, end) of the secrets in a layer, if it is a decoded one, and in all that is decoded from it."""
    seen, work, found = {hashlib.sha256(first.text.encode("utf-8", "surrogatepass")).digest()}, deque([first]), Found(opened, depth)
    while work:
        layer = work.popleft()
        if layer.name:
            for start, kind, end in base_spans(layer.text):
                if layer.decoded(start, end):
                    found.add({f"{layer.name}.{KINDS[kind]}"}, *layer.origin(start, end))
        _open_escaped(layer, found)
        grown = []
        if "%" in layer.text:
            grown.append(_rewritten(layer, URL, _from_url, "url"))
        if "\\" in layer.text or "&#" in layer.text:
            grown.append(_rewritten(layer, UNICODE, _from_unicode, "unicode"))
        for run in BASE64.finditer(layer.text):
            dashed = "-" in run[0] or "_" in run[0]  # a dash can belong to a run or end it
            for m in (run, *(BASE64_PARTS.finditer(layer.text, *run.span()) if dashed else ())):
                grown += _from_base64(layer, [m.span()], found)
        if "\n" in layer.text or "\r" in layer.text:
            for run in WRAPPED.finditer(layer.text):
                grown += _from_wrapped(layer, *run.span(), found)
        for new in grown:
            if new:
                digest = hashlib.sha256(repr((new.text, new.starts, new.spans, new.kept)).encode("utf-8", "surrogatepass")).digest()
                if digest not in seen:
                    seen.add(digest)
                    work.append(new)
    return found.spans


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """The base spans, and (start, kind, end) of what decoded layers add."""
    more = unwrap(Layer(text, "", [0], [(0, len(text))], [True]), {}) if text else ()
    return base_spans(text), sorted(more)


def joined(base: list[tuple[int, int, int]], more: list[tuple[int, str, int]] = ()) -> str:
    """Spans as kind:start:end, by start, then base kinds as listed, then the others by name."""
    spans = [(s, k, "", e) for s, k, e in base] + [(s, len(KINDS), k, e) for s, k, e in more]
    return ",".join(f"{name or KINDS[k]}:{s}:{e}" for s, k, name, e in sorted(spans))


def redacted(text: str | None) -> str | None:
    """A text with every span, merged where they overlap, replaced by a mask."""
    if not text:
        return text
    base, more = all_spans(text)
    out, at = [], 0
    for start, end in sorted([(s, e) for s, _, e in base] + [(s, e) for s, _, e in more]):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, counts of the base kinds, sha256 of the base spans, and all spans. One pass, no shuffle."""
    names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_pieces(whole):
                counts, sums, spans = [[], [], []], [], []
                for t in batch.column(1).to_pylist():
                    base, more = all_spans(t or "")
                    for k, out in enumerate(counts):
                        out.append(sum(s[1] == k for s in base))
                    sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(base, more))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        releasing(run), f"`{key}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in the text masked; null texts stay null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_pieces(whole, col=text):
                new = pa.array([redacted(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(releasing(run), docs.schema)
