"""Classifiers against plain Python on the same definition, and awkward tables for every operator and stage."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from stratum.llm import decontaminate, language_id, license_scan, near_dedup, quality, secret_scan, sentence_pieces, token_counts, topk_search, toxicity
from stratum.llm.common import bounded_sample
from tests.llm.test_operators import SCHEMA, frame, prose

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def labelled(spark, pairs, name):
    return spark.createDataFrame(pairs, f"doc_id long, {name} int")


def corpus(rng, n):
    texts, y = [], []
    for i in range(n):
        words, good = prose(rng, rng.randint(3, 60)).split(), i % 4 > 0
        texts.append(" ".join(words) if good else rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 30)]))
        y.append(int(good))
    return texts, y


def plain_quality(rows, weights):
    """(host rate, path rate, score) of rows (host, path, text), in plain Python."""
    logit = [min(12.0, max(-12.0, sum(a * b for a, b in zip(quality.features(t or ""), weights)) + weights[-1])) for _, _, t in rows]
    p = [1 / (1 + math.exp(-x)) for x in logit]
    mean = min(1 - 1e-6, max(1e-6, sum(p) / len(p)))

    def sums(keys):
        out = {}
        for k, v in zip(keys, p):
            s, n = out.get(k, (0.0, 0))
            out[k] = s + v, n + 1
        return out

    def strength(groups, centre):
        n, n2, g = sum(n for _, n in groups.values()), sum(n * n for _, n in groups.values()), len(groups)
        if g < 2:
            return 100.0
        between = sum(n * (s / n - centre(k)) ** 2 for k, (s, n) in groups.items())
        within = sum(n * centre(k) * (1 - centre(k)) for k, (s, n) in groups.items()) / n
        spread = (between - (g - 1) * within) / max(1e-9, n - n2 / n)
        return min(1e6, max(2.0, within / spread - 1)) if spread > 1e-12 else 1e6

    hosts, paths = sums([h for h, _, _ in rows]), sums([(h, q) for h, q, _ in rows])
    k = strength(hosts, lambda _: mean)
    host_rate = {h: (s + k * mean) / (n + k) for h, (s, n) in hosts.items()}
    k = strength(paths, lambda x: host_rate[x[0]])
    path_rate = {x: (s + k * host_rate[x[0]]) / (n + k) for x, (s, n) in paths.items()}
    out = []
    for (h, q, _), e in zip(rows, logit):
        r = min(1 - 1e-6, max(1e-6, path_rate[h, q]))
        out.append((host_rate[h], path_rate[h, q], 1 / (1 + math.exp(-(e + math.log(r / (1 - r)) - math.log(mean / (1 - mean)))))))
    return out


def test_quality_by_hand(spark):
    rng = random.Random(31)
    texts, y = corpus(rng, 400)
    texts += [None, "", texts[0], texts[0], " ".join(texts) * 20]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None] + [f"s{i}"]), None, *"xxxxxx") for i, t in enumerate(texts)]
    docs, labels = spark.createDataFrame(rows, SCHEMA).repartition(3), labelled(spark, list(enumerate(y)) + [(1, 1), (None, 1), (5, None)], "quality")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    sample, kept = toxicity.training_sample(docs, labels, "quality", lambda c: c.isNotNull(), 5000)
    assert len(sample) == 400 and sorted(kept.tolist()) == sorted(y)  # a label that is given twice teaches once
    weights = quality.fit(np.array([quality.features(t) for t in sample]), kept.astype(float))
    want = plain_quality([(r[3], r[2], r[1]) for r in rows], weights.tolist())
    assert len(got) == len(rows)
    for r, (host, path, score) in zip(rows, want):
        g = got[r[0]]
        assert abs(g.host_rate - host) < 1e-9 and abs(g.path_rate - path) < 1e-9 and abs(g["_score"] - score) < 1e-9 and g.keep == (g["_score"] >= 0.5)


def plain_gram_bucket(text):
    """The bucket of some characters, by the rolling rule."""
    h = 0
    for i, c in enumerate(text):
        h = ((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 + ord(c)) % 2**64 if i else ord(c) * 0x9E3779B97F4A7C15 % 2**64
    h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % 2**64
    return h >> 46


def plain_word_bucket(word):
    total = 0
    for i, c in enumerate(f"<{word}>"):
        x = (ord(c) + i * 0x100000001B3) * 0x9E3779B97F4A7C15 % 2**64
        total += (x ^ (x >> 31)) * 0x9E3779B97F4A7C15
    h = total % 2**64
    return ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % 2**64) >> 46


def test_toxicity_forward_pass(spark):
    rng = random.Random(32)
    texts = [prose(rng, rng.randint(1, 30)) + (" grumf" if i % 5 == 0 else "") for i in range(200)] + [None, "", "x", "ünï 日本", prose(rng, 40_000) + " grumf", "a b", "a b"]
    labels = labelled(spark, [(i, int(i % 5 == 0)) for i in range(200)] + [(7, 0), (7, 0)], "toxic")
    docs = frame(spark, texts).union(frame(spark, texts[:3]))  # repeated rows
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(texts) + 3
    got = {r.doc_id: r.score for r in rows}
    assert all(r.score == got[r.doc_id] for r in rows)
    sample, y = toxicity.training_sample(docs, labels, "toxic", lambda c: c.isNotNull() & (zlib_crc(c) % 5 != 0), 2000)
    value, bias = toxicity.train(sample, y)

    def word(w):
        marked = f"<{w}>"
        buckets = [plain_gram_bucket(marked[i : i + n]) for n in (2, 3, 4) for i in range(len(marked) - n + 1)] + [plain_word_bucket(w)]
        return sum(float(value[b]) for b in buckets) / len(buckets)

    for i, t in enumerate(texts):
        if len(t or "") > 5000:
            continue
        z = [word(w) for w in re.findall(r"\w+", (t or "").lower())]
        means = [sum(z[k : k + 2]) / 2 for k in range(max(1, len(z) - 1))] if z else [0.0]
        assert abs(got[i] - 1 / (1 + math.exp(-(max(means) + bias)))) < 1e-6
    assert got[204] > 0.5


def zlib_crc(c):
    from pyspark.sql import functions as F

    return F.crc32(c.cast("string"))


def plain_cells(text):
    """The cells of a text's 1- to 4-grams, by the rolling rule."""
    letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    cells = set()
    for n in range(1, 5):
        for i in range(len(letters) - n + 1):
            h = 0
            for k, c in enumerate(letters[i : i + n]):
                h = ((h ^ (h >> 15)) * 0x9E3779B1 + ord(c)) % 2**32 if k else ord(c) * 0x9E3779B1 % 2**32
            cells.add(((h ^ (h >> 16)) * 0x85EBCA6B % 2**32) >> 18)
    return cells


def test_language_kernel_and_ridge(spark):
    rng, parts = random.Random(33), {"aa": "ka ro mi tu".split(), "bb": "ße ün pf schl".split(), "cc": "ção nh õe lh".split()}
    texts, langs = [], []
    for i in range(90):
        lang = list(parts)[i % 3]
        texts.append(" ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(2, 30))))
        langs.append(lang)
    cells = [plain_cells(t) for t in texts]
    x, has = language_id.presence(texts)
    assert has.all() and [set(np.flatnonzero(row)) - {plain_blank()} for row in x] == [c - {plain_blank()} for c in cells]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    model = language_id.train(texts, langs, landmarks_per_lang=10)
    known = sorted(parts)
    marks = [i for k in known for i in [j for j, v in enumerate(langs) if v == k][:10]]
    K = np.array([[kernel(set(np.flatnonzero(x[i])), set(np.flatnonzero(x[j]))) for j in marks] for i in range(len(texts))])
    W = K[marks]
    # weighted ridge on Nyström features W^-1/2, solved in another way: as one least-squares problem
    value, vector = np.linalg.eigh((W + W.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))
    z = np.hstack([K @ root, np.ones((len(K), 1))])
    weight = np.array([1 / math.sqrt(langs.count(v)) for v in langs])
    target = np.array([[1.0 if v == k else -1.0 for k in known] for v in langs])
    a = np.vstack([z * weight[:, None], math.sqrt(1e-3) * np.eye(z.shape[1])])
    b = np.vstack([target * weight[:, None], np.zeros((z.shape[1], 3))])
    f = 4 * z @ np.linalg.lstsq(a, b, rcond=None)[0]
    p = np.exp(f) / np.exp(f).sum(1, keepdims=True)
    name, score = model.predict(texts)
    assert [known[i] for i in p.argmax(1)] == name and np.abs(score - p.max(1)).max() < 2e-3
    rows = [(i, t, v, "x", "y") for i, (t, v) in enumerate(zip(texts, langs))] + [(900, " ".join(texts) * 100, "aa", "x", "y"), (0, texts[0], "aa", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out string")
    got = language_id.predict_language(docs).collect()
    assert len(got) == 92 and {r.doc_id for r in got} >= {0, 900} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def plain_blank():
    """The cell of a blank, which a text may or may not have at its end."""
    h = 32 * 0x9E3779B1 % 2**32
    return (h ^ (h >> 16)) * 0x85EBCA6B % 2**32 >> 18


def test_samples_are_bounded(spark):
    rows = [(1, k % 2, f"text {k}" * 10) for k in range(300)] + [(2, 0, "same")] * 500 + [(3, 1, "z" * 100_000)]
    df = spark.createDataFrame(rows, "id long, y int, t string")
    texts, y = bounded_sample(df, 40, 1 << 30, 1)
    assert y.count(0) == y.count(1) == 40 and len(set(texts)) == 80
    texts, y = bounded_sample(df, 1000, 4000, 1)
    assert 3000 < sum(map(len, texts)) <= 4000 and set(y) == {0, 1}
    assert bounded_sample(df.limit(0), 5, 100, 1) == ([], [])
    many = spark.range(20_000).selectExpr("id", "int(id % 2) AS y", "string(id) AS t")
    texts, y = bounded_sample(many.union(many).repartition(7), 50, 1 << 30, 1)
    assert y.count(0) == y.count(1) == 50 and len(set(texts)) == 100


OPERATORS = {
    "op1": lambda d, x: token_counts.token_counts(d, BPE, 20), "table": lambda d, x: token_counts.token_table(d, BPE), "op2": lambda d, x: sentence_pieces.encode(d, PIECES),
    "op3": lambda d, x: quality.score_quality(d, x["labels"]), "op4": lambda d, x: license_scan.scan_licenses(d), "op5": lambda d, x: toxicity.score_toxicity(d, x["toxic"]),
    "op6": lambda d, x: decontaminate.find_leaks(d, x["benchmark"]), "op7": lambda d, x: language_id.predict_language(d), "op9": lambda d, x: near_dedup.near_duplicates(d),
    "op10": lambda d, x: secret_scan.find_secrets(d), "redact": lambda d, x: secret_scan.redact(d), "leaks": lambda d, x: decontaminate.drop_leaks(d, x["benchmark"]),
    "near": lambda d, x: near_dedup.drop_near_duplicates(d),
}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(34)
    texts, y = corpus(rng, 60)
    return {
        "texts": texts, "labels": labelled(spark, list(enumerate(y)), "quality"), "toxic": labelled(spark, [(i, i % 2) for i in range(60)], "toxic"),
        "benchmark": spark.createDataFrame([(0, texts[1]), (None, None), (1, "")], "item_id long, text string"),
    }


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, tables, name):
    run, texts = OPERATORS[name], tables["texts"]
    assert run(frame(spark, []), tables).count() == 0
    rows = [(None, None, None, None, None, *"xxxxxx"), (None, "", None, None, None, *[None] * 6), (1, " ".join(texts) * 30, "en", "s", 1, *"xxxxxx"), (1, None, "en", None, 1, *"xxxxxx")]
    rows += [(2, texts[2], "en", "s", 3, *"xxxxxx")] * 3 + [(2, texts[3], "en", "s", 3, *"xxxxxx"), (-(2**63), texts[4], "en", "s", 3, *"xxxxxx")]
    found = run(spark.createDataFrame(rows, SCHEMA), tables).collect()
    want = {"op6": None, "near": len(rows) - 2, "leaks": len(rows) - 1}.get(name, len(rows))
    if name == "leaks":  # the long text holds the item
        assert sorted(r.text or "" for r in found) == sorted(r[1] or "" for r in rows if r[1] is None or texts[1] not in r[1])
    elif want is not None:
        assert len(found) == want


def test_awkward_pipeline_stages(spark, tables, tmp_path):
    texts = tables["texts"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, keep boolean, text_hash string, h string"
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", None, "x", "x") for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None, None, None, None, None), (None, "", None, None, 0, None, None, None, None), (1, texts[1], "en", "s", 5, "x", None, "x", "x"), (1, texts[1], "en", "s", 5, "x", None, "x", "x")]
    rows += [(70, "see password=abcdefghijkl9 " + prose(random.Random(35), 40), "en", "s", 1, "x", None, "x", "x"), (71, " ".join(texts[5:9] * 200), "en", "s", 1, "x", None, "x", "x")]
    for docs in (rows, []):
        where = tmp_path / str(len(docs))
        spark.createDataFrame(docs, schema).write.parquet(str(where / "documents.parquet"))
        tables["labels"].write.parquet(str(where / "labels.parquet"))
        tables["benchmark"].write.parquet(str(where / "benchmark.parquet"))
        step = spark.read.parquet(str(where / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, str(where))
            assert step.columns == [c.split()[0] for c in schema.split(", ")]
            step.collect()
        out = corpus_pipeline.run(spark, str(where)).collect()
        assert [r.doc_id for r in out].count(1) == 0 and len(out) == step.count()
        assert not docs or (sum(r.doc_id is None for r in out) == 2 and 70 in {r.doc_id for r in out})


def test_top_k_of_awkward_tables(spark):
    df = spark.createDataFrame([(100, [1.0]), (200, []), (300, None), (400, [2.0])], "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS rank", "3 AS score")
    assert sorted(tuple(r) for r in topk_search.top_k(df, lambda c: c % 100 == 0).collect()) == [(100, 1, 400, 2048 * 1024), (400, 1, 100, 2048 * 1024)]
