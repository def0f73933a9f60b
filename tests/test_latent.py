"""Latent vectors against a plain singular value decomposition, over partitionings, and against hash vectors in a search."""

import hashlib
import os
import random

import numpy as np
import pytest

from corpusweave.functions.embed import HashingEmbedder
from corpusweave.operators import latent as L
from corpusweave.operators import retrieve as R
from corpusweave.plans import catalogue

DIR = "/root/testdata/sf0.01"
SCHEMA = "chunk_id bigint, text string"


def corpus(seed, n):
    r = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    return [(i, " ".join(r.choice(topics[i % 6]) for _ in range(r.randrange(1, 40)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "?!")]


def matrix(rows, bits, idf):
    m = np.zeros((len(rows), 1 << bits))
    for i, (_, t) in enumerate(rows):
        for w in (t or "").split():
            if w.isalnum():
                m[i, L.bucket_of(w, bits)] += 1
    m = np.where(m > 0, 1 + np.log(np.maximum(m, 1)), 0) * idf
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def test_basis_is_the_leading_singular_space(spark):
    rows = corpus(1, 400)
    e = L.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), dimensions=6, bits=10, power=5)
    m = matrix(rows, 10, e.idf.astype(np.float64))
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    image = m @ e.basis
    assert np.allclose(np.linalg.norm(image, axis=0), s[:6], rtol=1e-3)
    assert np.allclose(np.abs(np.sum(vt[:6].T * e.basis, axis=0)), 1, atol=1e-2)
    assert (e.basis[np.abs(e.basis).argmax(axis=0), np.arange(6)] > 0).all()


def test_vectors_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(corpus(2, 300), SCHEMA)
    a, b = L.fit(df.coalesce(1), 5, 10), L.fit(df.repartition(4), 5, 10)
    texts = ["t0w1 t0w2", "T3W4, t3w5!", "nowhere", "", None]
    x, y = np.array(a.embed(texts)), np.array(b.embed(texts))
    assert np.allclose(x, y, atol=1e-4) and np.allclose(np.linalg.norm(x[:2], axis=1), 1, atol=1e-5)
    assert not x[3:].any()
    near = np.array(a.embed(["t0w1 t0w2", "t0w9 t0w11", "t4w1 t4w2"]))
    assert near[0] @ near[1] > 0.8 > 0.3 > abs(near[0] @ near[2])  # words of one topic, none shared


def test_empty_corpus(spark):
    e = L.fit(spark.createDataFrame([], SCHEMA), 4, 8)
    assert np.isfinite(e.basis).all() and len(e.embed(["x"])[0]) == 4


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are absent")
def test_latent_vectors_find_better_than_hash_vectors(spark):
    got = {r.embedder: r for r in catalogue.latent_eval(spark, DIR).collect()}
    assert got["latent"].mrr >= got["hash"].mrr and got["latent"].hit_rate >= 0.95


def test_texts_are_embedded_once_however_many_blocks(spark, tmp_path, monkeypatch):
    """The blocks of queries read vectors that are written; a text isn't embedded again for each of them."""
    rows = [(i, t, f"l{i % 6}") for i, t in corpus(3, 300)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    calls = spark.sparkContext.accumulator(0)
    plain = catalogue.embed_column

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def embed(self, texts):
            calls.add(len(texts))
            return self.inner.embed(texts)

    monkeypatch.setattr(catalogue, "embed_column", lambda df, text, embedder: plain(df, text, Counted(embedder)))
    monkeypatch.setattr(R, "MOST_QUERIES", 2)
    got = catalogue.latent_eval(spark, str(tmp_path)).collect()
    assert len(got) == 2 and calls.value == 2 * sum(t is not None for _, t, _ in rows)


def test_hash_vectors_are_sums_of_signs():
    v = HashingEmbedder(8).embed(["a b a", "", None])
    want = np.zeros(8)
    for term in ("a", "b", "a", "a b", "b a"):
        h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
        want[h % 8] += 1 if h >> 63 else -1
    assert np.allclose(v[0], want / np.linalg.norm(want)) and not any(v[1]) and not any(v[2])


def test_products_of_dense_and_of_rare_buckets(spark, monkeypatch):
    """A product with all texts' weights equals the plain one, with buckets on both sides of DENSE and texts of several slices."""
    rows = L.rows_of(spark.createDataFrame(corpus(4, 1500), SCHEMA).coalesce(1), 14).cache()
    idf = np.zeros(1 << 14)
    for b in {int(b) for r in rows.collect() for b in r.buckets}:
        idf[b] = 1 + b % 5
    for i in range(L.DENSE + 100):  # seen elsewhere: the texts' buckets of the highest idf are rare
        idf[i] = idf[i] or 1.5
    q = np.random.default_rng(6).standard_normal((1 << 14, 3))
    m = matrix(corpus(4, 1500), 14, idf)
    assert np.allclose(L._product(rows, idf, q), m.T @ (m @ q), rtol=1e-4, atol=1e-4)
    at = L._weights(rows.select("buckets", "tf").toArrow().combine_chunks().to_batches()[0].slice(600, 300), idf)
    assert at[0].max() < 300 and len(at[0]) == len(at[1]) == len(at[2])
