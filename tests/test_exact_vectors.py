"""The exact vector search in single precision with a check: near ties, copies, zero vectors and slices, and the size of a block of queries."""

import numpy as np
import pytest

from corpusweave.operators import latent as L
from corpusweave.operators import retrieve as R


@pytest.mark.parametrize("cut", [3, 50, 1000])
def test_ties_below_single_precision_are_told_apart(cut):
    rng = np.random.default_rng(2)
    q = R._unit(rng.standard_normal((9, 16)))
    x = R._unit(rng.standard_normal((600, 16)))
    x[100:200] = R._unit(q[0] + 1e-8 * rng.standard_normal((100, 16)))  # scores differ in the ninth place and later
    x[200:230] = x[7]  # copies, by id
    x = np.concatenate([R._unit(x), np.full((2, 16), np.nan)])
    ids = rng.permutation(len(x))
    best = R.Nearest(len(q), 5)
    for at in range(0, len(x), cut):
        best.meet(q, q.astype(np.float32), x[at : at + cut], ids[at : at + cut], np.zeros(len(x[at : at + cut]), bool))
    score = np.round(q @ x[:600].T, 12)
    for i in range(len(q)):
        order = np.lexsort((ids[:600], -score[i]))[:5]
        assert best.id[i].tolist() == ids[order].tolist() and np.allclose(best.score[i], score[i][order], atol=1e-12)


def test_short_vectors_are_searched_in_large_blocks(spark, monkeypatch):
    """2,500 queries of 8 dimensions read the chunks once, not in five blocks."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((2500, 8)))]
    calls, real = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: calls.append(1) or real(value))
    chunks = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>")
    found = R.vector_search(chunks, chunks.toDF("query_id", "vector"), 1)
    assert found.where("query_id = chunk_id").count() == 2500 and len(calls) == 1


def test_a_word_is_hashed_once(monkeypatch):
    calls, real = [], L.bucket_of
    monkeypatch.setattr(L, "bucket_of", lambda w, bits: calls.append(w) or real(w, bits))
    e = L.LatentEmbedder(np.ones(16), np.eye(16))
    assert e.embed(["a b a", "b a"])[0] != e.embed(["a"])[0] and sorted(calls) == ["a", "b"]
