"""The byte network: against plain loops and numeric gradients, long texts, odd tables, and accuracy on rows not learned from."""

import os
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("corpusweave.llm")
from corpusweave.llm import quality  # noqa: E402

DIR = "/root/testdata/sf0.01"
TEXTS = [b"", b"x", b"A short text.", bytes(range(256)) * 3, b"ab " * 400, "Grüße, 日本語".encode() * 9]


def plain(net, text):
    """Features of one text, window by window."""
    per = quality.CELL * quality.BLOCK
    blocks = -(-(len(text) + quality.CELL) // per)
    codes = list(text) + [quality.PAD] * (blocks * per - len(text))
    first, second = net.filters[:, : quality.FILTERS], net.filters[:, quality.FILTERS :]
    cells = [np.concatenate([net.embed[b] for b in codes[i : i + quality.CELL]]) for i in range(0, len(codes), quality.CELL)]
    windows = [a @ first + b @ second for a, b in zip(cells, cells[1:])]
    values = []
    at = 0
    while True:
        values.append(np.maximum(np.max(windows[at : at + quality.CHUNK], axis=0) + net.bias, 0))
        if at + quality.CHUNK >= len(cells):
            break
        at += quality.STEP
    return np.concatenate([np.mean(values, axis=0), np.max(values, axis=0)])


def network():
    net = quality.Network(5)
    net.bias += np.random.default_rng(1).normal(0, 0.3, quality.FILTERS).astype(np.float32)
    return net


def test_features_equal_plain_loops():
    net = network()
    want = np.array([plain(net, t) for t in TEXTS])
    assert np.allclose(net.features(TEXTS), want, atol=1e-4)
    assert np.allclose(net.features(TEXTS[::-1])[::-1], want, atol=1e-4)  # whatever the neighbours


def test_slices_change_nothing(monkeypatch):
    net, r = network(), random.Random(2)
    texts = [r.randbytes(n) for n in (760, 768, 769, 1020, 1024, 1532, 1536, 5000, 12345)]
    want = net.features(texts)
    monkeypatch.setattr(quality, "SLICE", 700)
    assert np.allclose(net.features(texts), want, atol=1e-5)


def test_gradients():
    net = network()
    y, w = np.array([1, 0, 1, 0, 1, 0], np.float32), np.full(6, 1 / 6, np.float32)
    _, grads = net.gradients(TEXTS, y, w)
    r = np.random.default_rng(3)
    for p, g in zip(net.params(), grads):
        flat, own = p.reshape(-1), g.reshape(-1)
        for i in r.choice(np.flatnonzero(np.abs(own) > 1e-3), 6):
            keep, step = flat[i], np.float32(2e-3)
            flat[i] = keep + step
            up = net.gradients(TEXTS, y, w)[0]
            flat[i] = keep - step
            down = net.gradients(TEXTS, y, w)[0]
            flat[i] = keep
            assert own[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 700_000, "c"), (3, "y", "d"), (None, "z", "e")], "doc_id bigint, text string, score string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, label int")
    assert quality.train(docs, labels([])) == 0.5
    assert quality.train(docs, labels([(1, 1), (1, None), (None, 0), (1, 7)])) == 1.0
    out = quality.score(docs, 0.25)
    assert sorted(out.columns) == ["doc_id", "predicted", "score", "text"] and {(r.score, r.predicted) for r in out.collect()} == {(0.25, 0)}
    rows = quality.score(docs, network()).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), network()).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}" + "w" * (i % 7 * 100)) for i in range(3000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(3000)], "doc_id bigint, label int")
    texts, ys, share = quality.sample(docs, labels, 200, 1 << 20, 500)
    assert 100 < len(texts) < 300 and max(map(len, texts)) <= 500 and 40 < sum(ys) < 140
    known = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert share == pytest.approx(sum(i % 10 > 0 for i in known) / len(known))
    assert not {int(t.split()[1].rstrip(b"w")) for t in texts} - set(known)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are absent")
def test_held_out_accuracy(spark):
    rows = quality.query(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert quality.query(spark, DIR).count() == docs
    held = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.93
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
