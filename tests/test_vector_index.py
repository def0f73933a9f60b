"""The vector index: recall against the exact search, equal to it where all is probed, odd vectors, rows added later."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import retrieve as R
from corpusweave.operators import vector_index as V
from corpusweave.plans import catalogue

DIR = "/root/testdata/sf0.1"
SCHEMA = "chunk_id bigint, embedding array<float>"


def mixture(seed, n, dim=12, centres=40):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, dim))
    return [(i, (c[i % centres] + 0.3 * r.standard_normal(dim)).tolist()) for i in range(n)]


def queries_of(df):
    return df.where("chunk_id % 50 = 0").selectExpr("chunk_id as query_id", "embedding as vector")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = mixture(2, 3000) + [(5000, None), (5001, []), (5002, [0.0] * 12), (5003, [1.0, None] + [0.0] * 10), (5050, [1.0, 2.0]), (5100, [2.0, 4.1]), (5101, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    return df, V.Index.build(df, str(tmp_path_factory.mktemp("ann") / "index"))


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())


def test_recall_and_scores(spark, made):
    df, index = made
    q = queries_of(df)
    found, exact = index.search(q, 10), R.vector_search(df, q, 10)
    r = V.recall(found, exact).agg(F.avg("recall"), F.count("*")).first()
    assert r[0] >= 0.9 and r[1] == 62
    scores = {(x.query_id, x.chunk_id): x.score for x in exact.collect()}
    assert all(abs(scores[x.query_id, x.chunk_id] - x.score) < 1e-9 for x in found.collect() if (x.query_id, x.chunk_id) in scores)
    assert index.codec.probes < len(index.codec.centres)


def test_all_cells_probed_is_the_exact_search(spark, made, monkeypatch):
    df, index = made
    q = queries_of(df)
    exact = rows(R.vector_search(df, q, 10))
    assert rows(index.search(q, 10, probes=10**9, exact=True)) == exact
    monkeypatch.setattr(R, "MOST_QUERIES", 9)
    assert rows(index.search(q, 10, probes=10**9, exact=True)) == exact


def test_opened_again_and_added_to(spark, made):
    df, index = made
    again = V.Index.open(spark, index.path)
    q = queries_of(df)
    assert rows(again.search(q, 5)) == rows(index.search(q, 5))
    v = df.where("chunk_id = 50").first().embedding
    again.add(spark.createDataFrame([(9999, v), (None, v), (9998, None)], SCHEMA))
    best = [r.chunk_id for r in again.search(q.where("query_id = 50"), 3).orderBy("rank").collect()]
    assert best[:2] == [50, 9999]


def test_equal_vectors_come_by_id(spark):
    rows_ = [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(3000)] + mixture(3, 200, 4)
    rows_ = [(i, v) for i, (_, v) in enumerate(rows_)]
    index = V.Index.build(spark.createDataFrame(rows_, SCHEMA).repartition(5))
    q = spark.createDataFrame([(0, [1.0, 1.0, 0.0, 0.0])], "query_id bigint, vector array<float>")
    assert [r.chunk_id for r in index.search(q, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_candidates_are_compared_where_they_lie(spark, made):
    """No table of candidates, whose number would grow with queries times rows: one scan, of which k rows a query and task come."""
    _, index = made
    q = queries_of(made[0]).where("query_id < 3000")
    plan = index.search(q, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "SortMergeJoin" not in plan
    asked = V.unit(np.array([r.vector for r in q.orderBy("query_id").collect()]))
    found = index._ranked(np.arange(len(asked), dtype=np.int32), asked, 3, 10, 10.0)
    assert 0 < found.count() <= 10 * len(asked) * found.rdd.getNumPartitions()


@pytest.mark.parametrize("copies", [1, 40])
def test_rows_within_the_margin_are_compared(copies, monkeypatch):
    """Slices in any order give the exact search's rows if the margin covers what codes are wrong by; few others are compared."""
    r = np.random.default_rng(5)
    x = np.repeat(V.unit(r.standard_normal((4000 // copies, 16))), copies, axis=0)
    wrong = 0.02 * r.uniform(-1, 1, (9, len(x)))
    q, ids = V.unit(r.standard_normal((20, 16))), r.permutation(len(x))
    some = np.arange(3, 12)
    compared = []
    put = R.Nearest.put
    monkeypatch.setattr(R.Nearest, "put", lambda self, i, *rest: compared.append(len(i)) or put(self, i, *rest))
    best = R.Nearest(len(q), 5)
    for at in np.split(np.arange(len(x)), [7, 9, 1000, 2500]):
        V._compare(best, some, (q[some] @ x[at].T + wrong[:, at]).astype(np.float32), 0.02, q, x[at], ids[at])
    exact = np.round(q[some] @ x.T, 12)
    for i, s in zip(some, exact):
        order = np.lexsort((ids, -s))[:5]
        assert best.id[i].tolist() == ids[order].tolist() and np.allclose(best.score[i], s[order], atol=1e-11)
    assert (best.score[:3] == -np.inf).all() and (best.score[12:] == -np.inf).all()
    assert sum(compared) < exact.size / 5


def test_vectors_of_a_sliced_batch():
    column = pa.array([[1.0, 2.0], None, [3.0], [3.0, 4.0], [0.0, 0.0], [0.0, 5.0]], pa.list_(pa.float32()))
    own, x = V._vectors(column.slice(2, 4), 2)
    assert own.tolist() == [1, 3] and np.allclose(x, [[0.6, 0.8], [0.0, 1.0]])


def test_filter_on_cells_reaches_the_scan(spark, made):
    _, index = made
    plan = index._in([1, 2])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell, [1,2])]" in plan


def test_empty_and_tiny_tables(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<float>")
    assert V.Index.build(spark.createDataFrame([], SCHEMA)).search(q).count() == 0
    index = V.Index.build(spark.createDataFrame([(7, [1.0, 1.0])], SCHEMA))
    assert [r.chunk_id for r in index.search(q).collect()] == [7]
    assert index.search(q.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are absent")
def test_recall_over_the_whole_table(spark):
    r = catalogue.ann_recall(spark, DIR).agg(F.avg("recall"), F.count("*")).first()
    assert r[0] >= 0.9 and r[1] == 40
    assert catalogue.ann_topk(spark, DIR).count() == 400
