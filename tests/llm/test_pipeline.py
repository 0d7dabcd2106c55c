"""The pipeline on the smallest table, each stage against a plain version of its rule."""

import os
import re

import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from stratum.llm import decontaminate, sentence_pieces
from stratum.llm.common import materialize, releasing, small_batches, table
from tests.llm.test_operators import plain_groups, plain_secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    from sentencepiece import SentencePieceProcessor

    docs = table(spark, SF, "documents")
    seen = [docs.toPandas().sort_values("doc_id")]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        seen.append(docs.toPandas().sort_values("doc_id"))
    start, good, single, clean, masked, pieces = seen
    labels = table(spark, SF, "labels").toPandas().set_index("doc_id").quality
    known = start[start.doc_id.isin(labels.index)]
    right = sum((d in set(good.doc_id)) == bool(labels[d]) for d in known.doc_id)
    assert right >= 0.97 * len(known)
    groups = plain_groups(good.doc_id.tolist(), good.text.tolist())
    assert single.doc_id.tolist() == sorted(set(groups))
    items = [" ".join(re.findall(r"\w+", t.lower())) for t in table(spark, SF, "benchmark").toPandas().text]
    leaked = [d for d, t in zip(single.doc_id, single.text) if any(f" {i} " in f" {' '.join(re.findall(chr(92) + 'w+', t.lower()))} " for i in items)]
    assert clean.doc_id.tolist() == [d for d in single.doc_id if d not in leaked]
    assert masked.doc_id.tolist() == clean.doc_id.tolist() and list(masked.columns) == list(start.columns)
    assert not any(plain_secrets(t) for t in masked.text) and (masked.text.str.len() == masked.n_chars).all()
    lib = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [list(x) for x in pieces.piece_ids] == [lib.encode(t) for t in masked.text] and pieces.round_trip.all()


def test_workers_let_go_of_other_stages():
    path = public_tokenizers.path("piece_bpe_32k.model")
    same = lambda batches: iter(batches)
    same.__module__ = sentence_pieces.__name__
    made = sentence_pieces.pieces(path)
    assert list(releasing(same)([1, 2])) == [1, 2] and sentence_pieces.pieces(path) is made
    decontaminate.Canon(["a word"])
    assert list(releasing(lambda batches: iter(batches))([1, 2])) == [1, 2]
    assert sentence_pieces.pieces.cache_info().currsize == decontaminate._characters.cache_info().currsize == 0
    again = sentence_pieces.pieces(path)
    assert again is not made and again.encode(["Some text"]) == made.encode(["Some text"])


@pytest.fixture
def largest_batch(spark):
    """The most rows that a worker gets together, of a single partition of 2500."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    def after(asked, step):
        spark.conf.set(name, asked)
        step()
        found = [r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 2500
        return max(found)

    yield after
    spark.conf.set(name, before)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_send_small_batches(spark, largest_batch, stage):
    assert largest_batch("10000", lambda: stage(spark, table(spark, SF, "documents"), SF)) == 1000


@pytest.mark.parametrize("asked, most", [("0", 1000), ("300", 300), ("1000", 1000)])
def test_smaller_batches_stay(spark, largest_batch, asked, most):
    assert largest_batch(asked, lambda: small_batches(spark)) == most
