"""SentencePiece encoding and decoding by suffix-array matching.

The distinct new words of a batch are laid end to end and indexed by a suffix array (sorted to the length of the
longest piece). Every piece of the vocabulary is binary-searched in it; its range lists all its occurrences, each an
edge from its first to its last character. The edges are sorted by where they end and relaxed from left to right: a
piece may end at a place if it may follow the piece that was found for the place where it starts. For a merge-based
model two pieces may stand side by side if merging their characters gives these two back, which leaves exactly one
way to each place, the one that the library finds. (In long runs of one character, such as a ruled line, pieces can
merge in another order than they were made, and a place may have no way; such a word is left to the library.)
Characters without a piece become byte pieces.

A text is first cut where no piece of the vocabulary reaches over (between letters and other characters, before white
space), so that its words recur; a worker remembers the words it has met. Decoding joins the pieces' bytes.

Cases: null and empty texts have no pieces and decode to an empty text; very long texts are encoded whole; rows may
repeat; an empty table gives no rows; other columns, whatever their names, are ignored. A literal U+2581 stands for a
blank, as in the library, so such a text does not come back as it was, and round_trip says so.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pieces, kept, releasing

BLANK = "▁"
#: Ways to cut a text, the finest first; one fits a vocabulary if it leaves every piece whole.
CUTS = (
    re.compile(f"\n|{BLANK}*[^\\W\\d_²³¹¼-¾]+|{BLANK}*(?:[\\d_²³¹¼-¾]|[^\\w{BLANK}\n])+|{BLANK}+"),
    re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+"),
    re.compile("(?s).+"),
)
#: Words and pairs that a worker remembers, and characters in one suffix array.
REMEMBERED, INDEXED = 500_000, 150_000
#: What stands before a word, and for a character without a piece.
NOTHING, BYTES = -1, -2


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first characters (at least depth), by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] if k < len(rank) else 0
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1] + 1
        k *= 2
    return np.argsort(rank, kind="stable")


class Pieces:
    """Encoder and decoder of one model file; merging follows the scores."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        p = self.library = SentencePieceProcessor(model_file=path)
        size = p.get_piece_size()
        normal = [i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.text = [p.id_to_piece(i) for i in range(size)]
        self.id = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: p.get_score(i) for i in normal}
        self.byte = {int(self.text[i][1:-1], 16): i for i in range(size) if p.is_byte(i)}
        self.unknown = p.unk_id()
        self.surface = [t.replace(BLANK, " ").encode() for t in self.text]
        for i in range(size):
            if p.is_control(i):
                self.surface[i] = b""
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.pieces = np.array(normal, np.int64)
        self.shared = list(range(size))  # one object for each id, however many words hold it
        self.length = np.array([len(self.text[i]) for i in normal])
        self.depth = int(self.length.max())
        self.low = np.zeros((len(normal), self.depth), np.uint32)
        for k, i in enumerate(normal):
            self.low[k, : self.length[k]] = [ord(c) + 1 for c in self.text[i]]
        self.high = np.where(np.arange(self.depth) < self.length[:, None], self.low, np.uint32(0xFFFFFFFF))
        self.size_of = {i: len(self.text[i]) for i in normal}
        self.words = next(cut for cut in CUTS if all(len(cut.findall(t)) == 1 for t in self.id))
        self.together: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def by_library(self, word: str) -> tuple[int, ...]:
        """A word without a way through its edges."""
        if word[0] == BLANK:
            return tuple(self.library.encode(word[1:].replace(BLANK, " "), num_threads=1)) if len(word) > 1 else (self.id[BLANK],)
        return tuple(self.library.encode("\n" + word, num_threads=1)[2:])

    def merge(self, text: str) -> list[str]:
        """Plain merging, for the few characters of two pieces."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        if b == BYTES:
            return True  # nothing merges with it, and what stands before stands there already
        if a < 0:
            return self._alone(b)
        return self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]

    def _alone(self, a: int) -> bool:
        return a < 0 or self.merge(self.text[a]) == [self.text[a]]

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array, and for every piece the range of suffixes that begin with it."""
        order = suffix_array(codes, self.depth)
        padded = np.concatenate([codes, np.zeros(self.depth, np.uint32)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)

        def bound(keys: np.ndarray) -> np.ndarray:
            low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(order))
            rows = np.arange(len(keys))
            while (low < high).any():
                mid = (low + high) // 2
                w = windows[order[np.minimum(mid, len(order) - 1)]]
                differ = w != keys
                first = differ.argmax(1)
                less = (w[rows, first] < keys[rows, first]) & (low < high)
                low = np.where(less, mid + 1, low)
                high = np.where(less | (low >= high), high, mid)
            return low

        return order, bound(self.low), bound(self.high)

    def learn(self, words: list[str]) -> None:
        """Encode new words, as many together as one index of bounded size holds."""
        part, size = [], 0
        for w in words:
            part.append(w)
            size += len(w) + 1
            if size >= INDEXED:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)

    def _learn(self, words: list[str]) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        joined = "\0".join(words)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        codes[(starts - 1)[1:]] = 0  # between words stands what no piece and no text has
        order, low, high = self.ranges(codes)
        count = high - low
        has = np.flatnonzero(count)
        at = np.repeat(low[has] - (np.cumsum(count[has]) - count[has]), count[has]) + np.arange(count[has].sum())
        begin, piece = order[at], np.repeat(has, count[has])
        end = begin + self.length[piece]
        single = np.zeros(len(codes), bool)
        single[begin[self.length[piece] == 1]] = True
        bare = np.flatnonzero(~single & (codes > 0))
        begin, end = np.concatenate([begin, bare]), np.concatenate([end, bare + 1])
        piece = np.concatenate([self.pieces[piece], np.full(len(bare), BYTES)])
        sort = np.argsort(end, kind="stable")
        last: list[int | None] = [None] * (len(codes) + 1)
        for s in starts.tolist():
            last[s] = NOTHING
        together, may_follow = self.together, self.may_follow
        if len(together) > REMEMBERED:
            together.clear()
        for s, e, p in zip(begin[sort].tolist(), end[sort].tolist(), piece[sort].tolist()):
            a = last[s]
            if a is None or last[e] is not None:
                continue
            pair = (a + 2) << 32 | (p + 2)
            good = together.get(pair)
            if good is None:
                good = together[pair] = may_follow(a, p)
            if good:
                last[e] = p
        size_of, known, shared = self.size_of, self.known, self.shared
        for word, start, n in zip(words, starts.tolist(), lengths.tolist()):
            ids, i = [], start + n
            if last[i] is None:  # merges of a run of one character can depend on its length
                known[word] = self.by_library(word)
                continue
            while i > start:
                p = last[i]
                if p == BYTES:
                    ids.extend(self.byte.get(b, self.unknown) for b in reversed(word[i - 1 - start].encode("utf-8", "surrogatepass")))
                    i -= 1
                else:
                    ids.append(shared[p])
                    i -= size_of[p]
            known[word] = tuple(reversed(ids))

    def encode(self, texts: list[str]) -> list[list[int]]:
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, w))) for w in self._words(texts)]

    def _words(self, texts: list[str]) -> list[list[str]]:
        """The words of texts, all of them known."""
        split = [self.words.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        words = set(chain.from_iterable(split))
        new = {w for w in words if w not in self.known}
        if new:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                new = words
            self.learn(sorted(new))
        return split

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@kept(2)
def pieces(path: str) -> Pieces:
    """One for each worker process and file, until a task of another operator comes. Its many small objects make no cycles: they need few collections."""
    made = Pieces(path)
    gc.freeze()
    gc.set_threshold(200_000, 50, 100)
    return made


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_pieces, piece_ids, and whether decoding gives the text back. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for whole in batches:
            for batch in arrow_pieces(whole, 1 << 19):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = p.encode(texts)
                same = [p.decode(i) == t for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], [key, "n_pieces", "piece_ids", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(releasing(run), f"`{key}` {kind}, n_pieces long, piece_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "piece_ids") -> DataFrame:
    """Per row: key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(releasing(run), f"`{key}` {kind}, text string")
