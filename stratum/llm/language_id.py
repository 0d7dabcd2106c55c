"""Language identification with a string kernel.

A text is the set of its character n-grams of 1 to 4 letters (blended spectrum, presence only), hashed into a
binary vector; the kernel of two texts is the size of their intersection over the geometric mean of their sizes.
Nyström landmarks turn it into a few hundred features, and one ridge regression per language against the rest is
solved in closed form. A batch is scored by two matrix products: texts by landmarks, kernels by languages.

Landmarks and training texts are bounded samples per language (``per_lang`` rows, ``most_bytes`` of text over all);
every whole text is scored in one pass without a shuffle. The vector has 2^14 cells: a text of some thousand different
grams fills a fair part of them, its kernel with others then counts chance meetings too, and what tells languages apart
is what is missing. Cases: null texts and texts without a letter are ``und`` with score 0; very long texts are read
whole; a null id is not held out and teaches nothing; without any training text all predictions are ``und``; equal rows
teach once and are all scored; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pieces, bounded_sample

BITS, LONGEST = 14, 4
UNKNOWN = "und"
MULTIPLY = np.uint32(0x9E3779B1)


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Binary n-gram vectors of texts as float32 rows, and whether each text has a letter."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    low = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    has = np.bincount(doc[is_letter], minlength=len(texts)) > 0
    # anything but letters becomes one blank; runs of blanks collapse
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes, doc = np.where(is_letter, codes, 32)[keep].astype(np.uint32), doc[keep]
    flat, h = out.reshape(-1), codes * MULTIPLY
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(codes) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * MULTIPLY + codes[n - 1 :]
        mixed = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        at = (mixed >> np.uint32(32 - BITS)).astype(np.int64) + (doc[: len(h)].astype(np.int64) << BITS)
        flat[at if n == 1 else at[doc[: len(h)] == doc[n - 1 :]]] = 1
    return out, has


class Model:
    def __init__(self, langs: list[str], landmarks: np.ndarray, norms: np.ndarray, weights: np.ndarray):
        self.langs, self.landmarks, self.norms, self.weights = langs, landmarks, norms, weights

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks.T) / np.maximum(1, np.sqrt(x.sum(1)))[:, None] / self.norms

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x, has = presence(texts)
        f = 4 * (np.hstack([self.kernel(x), np.ones((len(x), 1), np.float32)]) @ self.weights)
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, has)], np.where(has, p.max(1), 0.0)


def train(texts: list[str], langs: list[str], landmarks_per_lang: int = 48, ridge: float = 1e-3) -> Model:
    """Nyström ridge regression of +1 / -1 for each language, languages weighing the same."""
    known = sorted(set(langs))
    if not known:
        return Model([], np.empty((0, 1 << BITS), np.float32), np.empty(0), np.empty((0, 0)))
    label = np.array([known.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks_per_lang] for k in range(len(known))])
    marks = presence([texts[i] for i in chosen])[0]
    model = Model(known, marks, np.maximum(1, np.sqrt(marks.sum(1))), np.empty((0, 0)))
    among = model.kernel(marks).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))  # kernels @ root: the features
    root = np.block([[root, np.zeros((len(root), 1))], [np.zeros((1, root.shape[1])), np.ones((1, 1))]])
    gram, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(known)))
    size = np.bincount(label, minlength=len(known))
    for start in range(0, len(texts), 200):
        part = slice(start, start + 200)
        k = model.kernel(presence(texts[part])[0])
        z = np.hstack([k, np.ones((len(k), 1))]) @ root
        w = (1.0 / size[label[part]])[:, None]
        gram += z.T @ (z * w)
        right += (z * w).T @ np.where(label[part][:, None] == np.arange(len(known)), 1.0, -1.0)
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), right)
    model.weights = (root @ solved).astype(np.float32)
    return model


def training_sample(docs: DataFrame, allowed, per_lang: int, key: str, text: str, lang: str, most_bytes: int = 64 << 20) -> tuple[list[str], list[str]]:
    """At most per_lang rows of each language, and most_bytes of text in all, by hash."""
    rows = docs.select(F.col(key).alias("id"), F.col(lang).alias("y"), F.col(text).alias("t"))
    rows = rows.where(F.col("id").isNotNull() & F.col("y").isNotNull() & F.col("t").isNotNull())
    return bounded_sample(rows.where(allowed(F.col("id"))), per_lang, most_bytes, 43)


def predict_language(docs: DataFrame, fold: int = 4, held: int = 2, per_lang: int = 800, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, held_out (crc32 of the id mod fold is held), lang_pred, score."""
    remainder = lambda c: F.crc32(c.cast("string")) % fold
    model = train(*training_sample(docs, lambda c: remainder(c) != held, per_lang, key, text, lang))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in arrow_pieces(whole, 1 << 20):
                for batch in (piece.slice(k, 256) for k in range(0, piece.num_rows, 256)):
                    name, score = sent.value.predict([t or "" for t in batch.column(2).to_pylist()])
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(score.astype(np.float64))], [key, "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = F.coalesce(remainder(F.col(key)) == held, F.lit(False))
    return docs.select(F.col(key), out.alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
