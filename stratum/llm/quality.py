"""Document quality by hierarchical empirical Bayes.

A logistic regression on surface features gives each document's own evidence. Its probabilities are summed by host
and by path within host; each host's rate is shrunk towards the global rate and each path's towards its host's, by
as many pseudo-documents as the spread between sites suggests (method of moments), so sparse sites say little.
The document's evidence and its path's posterior are then combined as log odds.

The regression is fitted on a bounded sample of labelled rows (``per_class`` of each label, 64 MB of text); sites are counted over
all documents. Two passes over the texts; the only shuffle before the verdict carries one partial sum per site and
task. Site rates are broadcast if their number is small and joined by shuffle otherwise.

Cases: null and empty texts have evidence from their zero features; null hosts and paths are sites of their own;
without labels of both kinds the evidence is even and everything is kept; equal rows teach once, count for their site as
often as they occur, and are all scored; very long texts are read whole; an empty table gives no rows; all columns are
kept, and where one has the name of a new one, the new one gets a leading underscore.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pieces, bounded_broadcast, fresh, materialize, releasing
from .toxicity import training_sample

SYMBOLS = "*$%&#|^~=<>@"


def features(text: str) -> list[float]:
    """Shares of repeated, distinct, upper-case and bare-symbol words, densities of symbols, marks and digits, size."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 9
    return [
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(words)) / n**0.9,
        sum(map(str.isupper, words)) / n,
        words.count("|") / n,
        min(4.0, sum(map(text.count, SYMBOLS)) / n),
        min(4.0, text.count("!") / n),
        min(4.0, sum(map(text.count, "0123456789")) / n),
        min(40.0, len(text) / n) / 10,
        math.log1p(n) / 10,
    ]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method, for standardised features; the last weight is the bias of raw ones."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1] + 1 if len(x) else 10)
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(len(w)) / 10
        w -= np.linalg.solve(h, z.T @ (p - y) / len(z) + ridge * np.append(w[:-1], 0) / 10)
    return np.append(w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum())


def evidence(docs: DataFrame, weights: np.ndarray, name: str, text: str) -> DataFrame:
    """All columns and, under name, the log odds of the document's own evidence."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_pieces(whole, col=text):
                x = np.array([features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(weights) - 1)
                logit = np.clip(x @ weights[:-1] + weights[-1], -12, 12)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logit)], [*batch.schema.names, name])

    return docs.mapInArrow(releasing(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _strength(groups: DataFrame, mean) -> float:
    """Pseudo-documents by which the rates of groups (columns s, n) are shrunk towards a mean column."""
    r = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("within"),
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("g"),
    ).first()
    if not r.n or r.g < 2:
        return 100.0
    within = r.within / r.n
    spread = (r.between - (r.g - 1) * within) / max(1e-9, r.n - r.n2 / r.n)
    return float(min(1e6, max(2.0, within / spread - 1))) if spread > 1e-12 else 1e6


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 5000, host: str = "source", path: str = "lang", key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of docs and evidence, host_rate, path_rate, score, keep (score >= least).

    Where docs has such a column, the new one's name gets a leading underscore.
    """
    texts, y = training_sample(docs, labels, "quality", lambda c: F.lit(True), per_class, key, text)
    weights = fit(np.array([features(t) for t in texts]).reshape(-1, 9), y.astype(np.float64))
    del texts
    narrow = docs.select(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    p = evidence(narrow, weights, "logit", "text").select("host", "path", (1 / (1 + F.exp(-F.col("logit")))).alias("p"))
    sites = materialize(p.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")))
    total = sites.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(1 - 1e-6, max(1e-6, (total.s or 0.0) / total.n if total.n else 0.5))
    hosts = sites.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    k = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_rate"))
    paths = sites.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = _strength(paths, F.col("host_rate"))
    paths = materialize(paths.select("host", "path", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")))
    e, hr, pr, sc, keep = fresh(docs, "evidence", "host_rate", "path_rate", "score", "keep")
    site = bounded_broadcast(paths).select(*(F.col(c).alias(f"__site_{c}") for c in paths.columns))
    scored = evidence(docs, weights, e, text)
    scored = scored.join(site, scored[host].cast("string").eqNullSafe(site["__site_host"]) & scored[path].cast("string").eqNullSafe(site["__site_path"]), "left")
    rate = F.least(F.greatest(F.coalesce("__site_path_rate", F.lit(mean)), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col(e) + F.log(rate / (1 - rate)) - math.log(mean / (1 - mean))
    score = 1 / (1 + F.exp(-odds))
    return scored.select(*(scored[c] for c in docs.columns), F.col(e), F.col("__site_host_rate").alias(hr), F.col("__site_path_rate").alias(pr), score.alias(sc), (score >= least).alias(keep))
