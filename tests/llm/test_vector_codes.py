"""Vector codes: against a plain Lloyd in Python integers, odd vectors, and what a round shuffles."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("corpusweave.llm")
from corpusweave.llm import vector_codes  # noqa: E402

SCHEMA = "vec_id bigint, vector array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """{(vec_id, place): (code, error)} and the codebooks' digest, in Python integers."""
    good = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good or len(good[0][1]) % parts:
        return [], None
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    whole = [[max(-vector_codes.LONG, min(vector_codes.LONG, math.floor(1024 * float(np.float32(x))))) for x in v] for _, v, _ in good]
    w = len(whole[0]) // parts
    cut = [[tuple(x[p * w : (p + 1) * w]) for p in range(parts)] for x in whole]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for x in cut:
            d = [[sum((a - b) ** 2 for a, b in zip(x[p], e)) for e in books[p]] for p in range(parts)]
            best = [min(range(len(one)), key=lambda j, one=one: (one[j], j)) for one in d]
            out.append((best, sum(one[j] for one, j in zip(d, best))))
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, (best, _) in zip(cut, found) if best[p] == e]
                if own:
                    books[p][e] = tuple(sum(col) // len(own) for col in zip(*own))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(i), str(label), best, min(err, vector_codes.LONG)) for (i, _, label), (best, err) in zip(good, assign())), digest


def check(spark, rows, **settings):
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), **settings)
    want, digest = plain(rows, **settings)
    assert sorted((str(r.vec_id), str(r.label), list(r.code), r.error) for r in coded.collect()) == want
    assert (books.sha256() if books else None) == digest
    return coded


def test_equals_plain_lloyd(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.3, 8)], int(i) % 3) for i in r.permutation(300)]
    check(spark, rows, entries=16)
    check(spark, rows[:50], entries=256, rounds=1)


def test_odd_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(0, 1, 4)], None) for i in range(40)]
    rows += [(100, None, 1), (101, [], 1), (102, [1.0, None, 0.0, 0.0], 1), (103, [1.0, float("nan"), 0.0, 0.0], 1), (104, [float("inf")] * 4, 1)]
    rows += [(105, [1.0] * 8, 1), (None, [0.5] * 4, 2), (7, [0.25] * 4, 2), (7, [0.25] * 4, 2), (106, [0.0] * 4, 3)]
    check(spark, rows, entries=8)
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA))[0].count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], SCHEMA))[0].count() == 0


def test_large_components(spark):
    """Beyond what doubles multiply exactly, and beyond a long."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.choice([1e5, -3e6, 0.5, 7e9], 4)], 1) for i in range(30)]
    check(spark, rows, entries=4)
    check(spark, [*rows, (99, [3e38, -3e38, 1e16, 1.0], 1)], entries=4)


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [1.0, 1.0, 1.0, 1.0], 1) for i in range(5)] + [(9, [0.0, 2.0, 1.0, 3.0], 1)]
    check(spark, rows, entries=4)
    codes, _ = vector_codes.Codebooks([[(1, 1), (1, 1)], [(0, 2), (2, 0)]]).assign(np.array([[1, 1, 1, 1]]))
    assert codes.tolist() == [[0, 0]]


def test_label_sums(spark, monkeypatch):
    rows = [(i, i % 4 if i % 5 else None, [0], i) for i in range(60)]
    coded = spark.createDataFrame(rows, "vec_id bigint, label int, code array<int>, error bigint")
    want = {}
    for _, label, _, e in rows:
        want[label] = want.get(label, 0) + e
    get = lambda: sorted((r.vec_id, r.label_error) for r in vector_codes.label_sums(coded).collect())
    assert get() == [(i, want[label]) for i, label, _, _ in rows]
    monkeypatch.setattr(vector_codes, "LABELS", 1)
    monkeypatch.setattr(vector_codes, "HOT_LABEL", 12)
    assert get() == [(i, want[label]) for i, label, _, _ in rows]


def test_only_changed_parts_are_counted():
    """A round over vectors whose indexes stay has no change rows."""
    books = vector_codes.Codebooks([[(0, 0), (10, 10)], [(0, 0), (10, 10)]])
    changes = vector_codes.Changes(books)
    assert list(changes.rows()) == []
    x = np.array([[1, 1, 9, 9], [2, 2, 8, 8]])
    changes.add(x, 0, np.array([0, 0]), 1)
    changes.add(x[:1], 1, np.array([1]), 1)
    changes.add(x[:1], 1, np.array([0]), -1)
    assert [(p, e, n, [int(v) for v in s]) for p, e, n, s in changes.rows()] == [(0, 0, 2, [3, 3]), (1, 0, -1, [-9, -9]), (1, 1, 1, [9, 9])]
