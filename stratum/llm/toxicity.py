"""Toxicity scores from bags of subwords: embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (2 to 4, with marks at its ends) and of itself, all
hashed into one table, so a misspelling or an unseen ending shares most of its vector with what was learned. A
window of words is the average of its words and goes through the softmax; a text is as toxic as its worst window,
so that a long text does not dilute a short insult. Training lowers the softmax loss first on averages of whole
texts, then on worst windows; gradients reach embeddings and softmax alike.

Learned on a bounded sample of labelled rows (``per_class`` of each label and ``most_bytes`` of text); scored on whole
texts, one pass without a shuffle. Cases: null and empty texts get the score of an empty window; very long texts are
scored whole; rows without label are scored too; equal rows teach once and are all scored, rows of one id each for
themselves; a null id is not held out and teaches nothing; without labels all scores are alike; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pieces, bounded_sample, first_by_hash

WORD = re.compile(r"\w+")
BUCKETS, GRAMS, WIDTH = 1 << 18, (2, 3, 4), 8
WINDOW, STRIDE = 2, 1
REMEMBERED = 600_000
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of words, and for each the index of its word."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    found, owners, h = [], [], codes * MULTIPLY
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] ^ (h[: len(codes) - n + 1] >> np.uint64(29))) * MULTIPLY + codes[n - 1 :]
        if n in GRAMS:
            same = owner[: len(h)] == owner[n - 1 :]
            found.append(_bucket(h[same]))
            owners.append(owner[: len(h)][same])
    # the word itself: a polynomial over its characters
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    within = (np.arange(len(codes)) - np.repeat(starts, lengths)).astype(np.uint64)
    mixed = (codes + within * np.uint64(0x100000001B3)) * MULTIPLY
    mixed ^= mixed >> np.uint64(31)
    whole = np.add.reduceat(mixed * MULTIPLY, starts) if len(words) else np.empty(0, np.uint64)
    found.append(_bucket(whole))
    owners.append(np.arange(len(words), dtype=np.int32))
    return np.concatenate(found), np.concatenate(owners)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - 18)).astype(np.int32)


def windows(doc_starts: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: each window's text, its first and last place."""
    counts = np.maximum(1, -(-(doc_ends - doc_starts - WINDOW) // STRIDE) + 1)
    counts = np.where(doc_ends > doc_starts, counts, 0)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    first = np.arange(counts.sum(), dtype=np.int32)
    first -= np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    first *= STRIDE
    first += doc_starts.astype(np.int32)[doc]
    return doc, first, np.minimum(first + WINDOW, doc_ends.astype(np.int32)[doc])


def window_means(z: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums within each window alone, so that a text scores the same beside any others."""
    means = z[first].astype(np.float64)
    for k in range(1, WINDOW):
        means += np.where(first + k < last, z[np.minimum(first + k, len(z) - 1)], 0.0)
    means /= WINDOW
    return means


def train(texts: Iterable[str], toxic: np.ndarray, epochs: int = 60, seed: int = 7) -> tuple[np.ndarray, float]:
    """Per bucket the difference of the two softmax inputs that its vector adds, and the bias."""
    vocabulary: dict[str, int] = {}
    ids, ends = [], []
    for t in texts:
        words = WORD.findall(t.lower())
        ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
        ends.append(len(words))
    if not vocabulary:
        return np.zeros(BUCKETS, np.float32), -1.0
    tokens, doc_ends = np.concatenate(ids), np.cumsum(ends)
    del ids
    doc_starts = doc_ends - np.asarray(ends)
    grams, owner = gram_buckets(list(vocabulary))
    share = (1.0 / np.bincount(owner, minlength=len(vocabulary)))[owner].astype(np.float32)
    used, slot = np.unique(grams, return_inverse=True)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (len(used), WIDTH)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    y = toxic.astype(np.int64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    length = np.maximum(1, doc_ends - doc_starts)
    doc, first, last = windows(doc_starts, doc_ends)
    state = [np.full(x.shape, 1e-8, np.float32) for x in (table, softmax, bias)]
    for epoch in range(epochs):
        averages = epoch < epochs // 4
        margin = softmax[:, 1] - softmax[:, 0]
        z = np.bincount(owner, (table @ margin)[slot] * share, len(vocabulary))
        zt = z[tokens]
        if averages:
            total = np.concatenate([[0.0], np.cumsum(zt)])
            logit = (total[doc_ends] - total[doc_starts]) / length
        else:
            means = window_means(zt, first, last)
            begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            highest = np.maximum.reduceat(means, begins)
            top = np.flatnonzero(means == np.repeat(highest, np.diff(np.append(begins, len(means)))))
            best = top[np.append(True, doc[top][1:] != doc[top][:-1])]
            logit = np.zeros(len(ends))
            logit[doc[best]] = means[best]
        p = 1 / (1 + np.exp(-np.clip(logit + bias[1] - bias[0], -30, 30)))
        g = (p - y) * weight  # by the margin
        if averages:
            per_token = np.repeat(g / length, doc_ends - doc_starts)
            per_word = np.bincount(tokens, per_token, len(vocabulary))
        else:
            places = first[best][:, None] + np.arange(WINDOW)
            inside = places < last[best][:, None]
            per_word = np.bincount(tokens[places[inside]], np.repeat(g[doc[best]] / WINDOW, inside.sum(1)), len(vocabulary))
        per_gram = np.bincount(slot, per_word[owner] * share, len(used)).astype(np.float32)
        g_margin = per_gram @ table
        grads = (per_gram[:, None] * margin[None, :] + 2e-6 * table, np.stack([-g_margin, g_margin], 1), np.array([-g.sum(), g.sum()], np.float32))
        for x, d, s, rate in zip((table, softmax, bias), grads, state, (0.5, 0.2, 0.1)):
            s *= 0.95
            s += 0.05 * d * d
            x -= rate * (0.98**epoch) * d / (np.sqrt(s) + 1e-7)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = table @ (softmax[:, 1] - softmax[:, 0])
    return out, float(bias[1] - bias[0])


class Scorer:
    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias, self.known = value, bias, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        split = [WORD.findall(t.lower()) for t in texts]
        new = {w for w in set().union(*split) if w not in self.known}
        if new:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                new = set().union(*split)
            words = list(new)
            grams, owner = gram_buckets(words)
            z = np.bincount(owner, self.value[grams], len(words)) / np.bincount(owner, minlength=len(words))
            self.known.update(zip(words, z.tolist()))
        get = self.known.__getitem__
        ends = np.cumsum([len(w) for w in split])
        z = np.fromiter((v for w in split for v in map(get, w)), np.float64, int(ends[-1]) if len(ends) else 0)
        doc, first, last = windows(ends - np.array([len(w) for w in split], np.int64), ends)
        means = window_means(z, first, last)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, doc, means)
        worst[np.isneginf(worst)] = 0.0
        return 1 / (1 + np.exp(-np.clip(worst + self.bias, -500, 500)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, per_class: int, key: str = "doc_id", text: str = "text", most_bytes: int = 64 << 20):
    """At most per_class rows of each label, and most_bytes of text, by hash, as (texts, labels).

    At most per_class ids of each label are drawn first, so they are broadcast and no text is shuffled.
    """
    rows = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(allowed(F.col("id")))
    drawn = first_by_hash(rows.withColumn("o", F.xxhash64("id", F.lit(41))), per_class).select("id", "y")
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(drawn), "id")
    texts, y = bounded_sample(found, per_class, most_bytes, 41)
    return texts, np.array(y, np.int64)


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, per_class: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out (crc32 of the id mod fold is 0), score, predicted."""
    remainder = lambda c: F.crc32(c.cast("string")) % fold
    texts, y = training_sample(docs, labels, "toxic", lambda c: remainder(c) != 0, per_class, key, text)
    value, bias = train(texts, y)
    del texts
    model = docs.sparkSession.sparkContext.broadcast((value, bias))
    kept: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept.get("s") or kept.setdefault("s", Scorer(*model.value))
        for whole in batches:
            for batch in arrow_pieces(whole, 4 << 20):
                s = scorer.scores([t or "" for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [key, "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    held = F.coalesce(remainder(F.col(key)) == 0, F.lit(False))
    return docs.select(F.col(key), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")
