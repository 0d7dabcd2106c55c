"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A byte-level BPE splits a text into words and merges within each. For a word, the last token of every
prefix is the one vocabulary entry that ends there and may follow the last token of what precedes it: two
tokens may stand side by side if encoding their concatenation gives these two back. So one pass from left
to right finds the count at each prefix from shorter prefixes. Counts of words add up, and a running sum over
the words of a text with the counts at each prefix of the word that a cut falls in answers how many tokens any prefix
has, and where a budget ends, without encoding again. A cut joins the blanks before it to one word and takes
contractions and special strings apart; only these few characters are split anew.

Cases: null and empty texts have no tokens and no bytes; special strings within a text count as one token, as
the library does by default; a very long text, or word, costs in proportion to its length; rows may repeat; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pieces

#: The library's word pattern, for any text and for texts below U+0250.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
WORDS_LATIN = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)

CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))

#: Words a worker remembers, and characters in them; then it forgets all and starts anew.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 16_000_000


class PrefixCounter:
    """Token counts of texts and of all their prefixes for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.vocab = {raw(s): k for s, k in spec["model"]["vocab"].items()}
        #: By pair of tokens the rank of their merge; by token what it was merged from.
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            x, y = map(raw, m.split(" ") if isinstance(m, str) else m)
            pair, whole = (self.vocab[x], self.vocab[y]), self.vocab[x + y]
            self.ranks[pair] = rank
            self.parts.setdefault(whole, (*pair, rank))
        self.longest = max(map(len, self.vocab))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self._split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._latin = re.compile(WORDS_LATIN)
        self._beyond = re.compile("[^\x00-ɏ]")
        self._any = regex.compile(WORDS)
        self._path, self._library = path, None
        self._edges: tuple[dict, dict] = ({}, {})
        self.together: dict[int, bool] = {}
        self.counts: dict[str, int] = {}
        self.chars = 0

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at one edge of a token (0: left, 1: right) as it is merged, and the rank that ends each."""
        found = self._edges[side].get(token)
        if found is None:
            found, ends = [(token, float("inf"))], token
            while ends in self.parts:
                *both, rank = self.parts[ends]
                ends = both[side]
                found.append((ends, rank))
            self._edges[side][token] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart: no merge across their border comes before those within them.

        Of equal merges the leftmost comes first, so the border loses against the left token and wins
        against the right one.
        """
        ranks = self.ranks
        for x, x_ends in self._edge(a, 1):
            for y, y_ends in self._edge(b, 0):
                rank = ranks.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def may_stand(self, token: int) -> bool:
        """Whether a token's own bytes give that token."""
        if token not in self.parts:
            return True
        x, y, _ = self.parts[token]
        ranks, rank = self.ranks, self.parts[token][2]
        if not (self.may_stand(x) and self.may_stand(y)):
            return False
        return all(
            not ((m := ranks.get((p, q))) is not None and m < min(p_ends, rank) and m <= min(q_ends, rank) and (p, q) != (x, y))
            for p, p_ends in self._edge(x, 1)
            for q, q_ends in self._edge(y, 0)
        )

    def prefixes(self, words: list[bytes]) -> Iterator[list[int]]:
        """For each word the token count at each byte prefix, the empty one first.

        Words in order share what they begin with: only the rest of each is computed.
        """
        vocab, longest, together = self.vocab, self.longest, self.together
        last, count, before = [-1], [0], b""
        for word in words:
            n, same = len(word), 0
            for p, q in zip(before, word):
                if p != q:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for i in range(same + 1, n + 1):
                for start in range(i - 1, max(i - longest, 0) - 1, -1):
                    token = vocab.get(word[start:i])
                    if token is None:
                        continue
                    key = (last[start] + 1) << 32 | token
                    good = together.get(key)
                    if good is None:
                        if len(together) > REMEMBERED:
                            together.clear()
                        good = together[key] = self.may_follow(last[start], token) if start else self.may_stand(token)
                    if good:
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            before = word
            yield count

    def word_prefixes(self, word: str) -> list[int]:
        """The token count at each prefix of a word, by characters, the empty one first."""
        coded = word.encode("utf-8", "surrogatepass")
        counts = next(self.prefixes([coded]))
        if len(coded) == len(word):
            return counts
        return [counts[0], *(counts[n] for n in accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in word))]

    def learn(self, words: set[str]) -> None:
        """Remember the counts of words."""
        if len(self.counts) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.counts.clear()
            self.chars = 0
        self.chars += sum(map(len, words))
        new = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words if w not in self.counts)
        for (_, w), count in zip(new, self.prefixes([b for b, _ in new])):
            self.counts[w] = count[-1]

    def words(self, text: str) -> list[str]:
        """The library's words of a text without special strings."""
        if not self._beyond.search(text):
            return self._latin.findall(text)
        if self._strange(text):
            return [text[a:b] for _, (a, b) in self._tokenizer().pre_tokenizer.pre_tokenize_str(text)]
        return self._any.findall(text)

    def _tokenizer(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def _strange(self, text: str) -> bool:
        """Whether a text has characters that this Unicode version leaves free and another may know."""
        return any(unicodedata.category(c) == "Cn" for c in set(text) if c > "ɏ")

    def word_counts(self, words: list[str]) -> list[int]:
        try:
            return list(map(self.counts.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return list(map(self.counts.__getitem__, words))

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text in turn as plain pieces and special strings."""
        if not self._split_special:
            yield text, False
            return
        at = 0
        for m in self._split_special.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Where each word ends (characters), and the token count of the text up to there."""
        ends, counts = [], []
        for piece, special in self.pieces(text):
            words = [piece] if special else self.words(piece)
            ends += map(len, words)
            counts += [1] if special else self.word_counts(words)
        return list(accumulate(ends)), list(accumulate(counts))

    def count(self, text: str) -> int:
        return sum(1 if special else sum(self.word_counts(self.words(piece))) for piece, special in self.pieces(text))

    def count_all(self, texts: list[str]) -> list[int]:
        """The counts of many texts, whose new words are learned together."""
        split = [[[p] if special else self.words(p) for p, special in self.pieces(t)] for t in texts]
        known, new = self.counts, set()
        for text in split:
            for words in text[::2]:
                new.update(words)
        if not known.keys() >= new:
            self.learn(new)
        get = self.counts.__getitem__
        return [sum(map(get, chain.from_iterable(text[::2]))) + len(text) // 2 for text in split]

    def _blanks(self, text: str, end: int, table: tuple[list[int], list[int]]) -> list[int]:
        """The counts at each prefix that ends in the blanks before end, from the empty run of blanks on."""
        start = end
        while start and _blank(text[start - 1]):
            start -= 1
        ends, counts = table
        k = bisect_right(ends, start)
        before = counts[k - 1] if k else 0
        return [before + n for n in self.word_prefixes(text[start:end])]

    def inside(self, text: str, k: int, table: tuple[list[int], list[int]]) -> list[int]:
        """The counts at each prefix of the text that ends in its k-th word, the whole word included."""
        ends, counts = table
        start, before = (ends[k - 1], counts[k - 1]) if k else (0, 0)
        word = text[start : ends[k]]
        if _blank(word[-1]):
            return self._blanks(text, ends[k], table)[-len(word) :]
        if word in self.special:  # its parts can go on the word before it, and take one of the blanks
            j = k
            while j and _blank(text[ends[j - 1] - 1]):
                j -= 1
            j = max(0, j - 1)
            at, before = (ends[j - 1], counts[j - 1]) if j else (0, 0)
            return [*(before + self.count(text[at:i]) for i in range(start + 1, ends[k])), counts[k]]
        if word in CONTRACTIONS:
            return [*(before + self.count(word[:i]) for i in range(1, len(word))), counts[k]]
        found = [before + n for n in self.word_prefixes(word)[1:]]
        if len(word) > 1 and _blank(word[0]):
            found[0] = self._blanks(text, start + 1, table)[-1]
        return found

    def every_prefix(self, text: str) -> list[int]:
        """The token count of text[:i] for every i."""
        table = self.table(text)
        return [0, *chain.from_iterable(self.inside(text, k, table) for k in range(len(table[0])))]

    def count_at(self, text: str, chars: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """Tokens of text[:chars], from the table and the prefixes of the word that the cut falls in."""
        if chars <= 0:
            return 0
        table = table or self.table(text)
        k = bisect_left(table[0], chars)
        return self.inside(text, k, table)[chars - 1 - (table[0][k - 1] if k else 0)]

    def fit(self, text: str, budget: int) -> int:
        """The length in characters of the longest prefix of at most so many tokens."""
        table = self.table(text)
        ends, counts = table
        if not counts or counts[-1] <= budget:
            return len(text)
        k = bisect_right(counts, budget)
        if k + 1 < len(ends) and _blank(text[ends[k] - 1]) and _blank(text[ends[k]]):
            k += 1  # a cut right after its first blank joins that to the blanks before it
        while True:  # a cut can save a token of the words before it, so the word that passes the budget can have none
            start = ends[k - 1] if k else 0
            found = self.inside(text, k, table)
            fits = max((i for i, n in enumerate(found, 1) if n <= budget), default=0)
            if fits or not k:
                return start + fits
            k -= 1


def _blank(c: str) -> bool:
    """Whether the word pattern takes a character for white space."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes each byte as a printable character: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    """One for each worker process and file. Its many small objects make no cycles: they need few collections."""
    made = PrefixCounter(path)
    gc.freeze()
    gc.set_threshold(200_000, 50, 100)
    return made


def token_counts(docs: DataFrame, path: str, budget: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit, and fit_chars: the longest prefix within the budget.

    One pass without a shuffle; a worker holds the vocabulary and a bounded memory of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for batch in arrow_pieces(whole, 4 << 20):
                out: list[list] = [[], [], [], []]
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for t, n in zip(texts, c.count_all(texts)):
                    for x, v in zip(out, (len(t.encode("utf-8", "surrogatepass")), n, n > budget, c.fit(t, budget) if n > budget else len(t))):
                        x.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int64())))],
                    [key, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    )


def token_table(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", every: bool = False) -> DataFrame:
    """Per row: key, and the stored prefix table: word_ends (characters) and token_counts up to each; with every also
    prefix_counts, the count at each prefix of the text (element i: of i characters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for batch in arrow_pieces(whole, 1 << 20):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                tables = [c.table(t) for t in texts]
                kind = pa.list_(pa.int32())
                columns = [pa.array([a for a, _ in tables], kind), pa.array([b for _, b in tables], kind)]
                if every:
                    columns.append(pa.array([c.every_prefix(t) for t in texts], kind))
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "word_ends", "token_counts", *(["prefix_counts"] if every else [])])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, word_ends array<int>, token_counts array<int>" + (", prefix_counts array<int>" if every else "")
    )


def count_of_prefix(chars, counts: str = "prefix_counts"):
    """Tokens of the first so many characters, from a stored table alone."""
    return F.get(F.col(counts), F.least(F.lit(chars), F.size(counts) - 1))


def prefix_of_budget(budget, counts: str = "prefix_counts"):
    """Characters of the longest prefix of at most so many tokens, from a stored table alone."""
    return F.array_max(F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.get(F.col(counts), i) <= F.lit(budget)))
