"""Operators against small sequential versions and hand-made cases."""

import random

from pyspark.sql import functions as F

from corpusweave.operators import crawl as C
from corpusweave.operators import index as I
from corpusweave.operators import retrieve as R
from corpusweave.operators import extract as E
from corpusweave.sources.store import Store
from corpusweave import schemas as S


def test_rate_slots_equal_a_sequential_fold(spark):
    random.seed(3)
    rows, t = [], 0
    for i in range(400):
        t += random.choice([0, 10, 900, 4000])
        rows.append((f"d{i % 7}", t, i, 1000))
    got = {r.seq: (r.slot, r.wait) for r in C.rate_slots(spark.createDataFrame(rows, "domain string, now_us bigint, seq bigint, delay bigint")).collect()}
    following: dict = {}
    for d, now, i, delay in rows:
        slot = max(now, following.get(d, 0))
        following[d] = slot + delay
        assert got[i] == (slot, slot - now)


def test_versions_change_detection(spark):
    rows = [("p", i, i, h) for i, h in enumerate("AABA")]
    f = spark.createDataFrame(rows, "page string, fetched_at bigint, seq bigint, content_hash string")
    assert [(r.seq, r.version_no) for r in C.versions(f).orderBy("seq").collect()] == [(0, 1), (2, 2), (3, 3)]
    known = spark.createDataFrame([("p", 3, "A")], "page string, version_no int, content_hash string")
    assert [(r.seq, r.version_no) for r in C.versions(f, known).orderBy("seq").collect()] == [(2, 4), (3, 5)]


def test_budget_of_the_example(spark):
    links = spark.createDataFrame([(1, 0, i, f"u{i}") for i in range(5)], "session int, parent int, place int, url string")
    counted = spark.createDataFrame([(1, 1, 3)], "session int, prior int, max_pages int")
    assert [r.outcome for r in C.budget(links, counted).orderBy("place").collect()] == ["enqueued", "enqueued", "skipped", "dropped", "dropped"]


def test_rrf_ties_keep_first_appearance(spark):
    lists = spark.createDataFrame([(0, 0, 1, 11), (0, 0, 2, 12), (0, 1, 1, 12), (0, 1, 2, 11)], "query_id int, list int, rank int, chunk_id bigint")
    assert [r.chunk_id for r in R.rrf(lists, 5).orderBy("rank").collect()] == [11, 12]


def test_searches_without_matches_are_empty(spark):
    posts = I.postings(spark.createDataFrame([(1, "one two"), (2, None)], "chunk_id bigint, text string"))
    q = spark.createDataFrame([(0, "?!"), (1, "three"), (2, "TWO two")], "query_id bigint, q string")
    assert [(r.query_id, r.chunk_id) for r in R.keyword_search(posts, q).collect()] == [(2, 1)]
    vec = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "chunk_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, vector array<float>")
    assert [(r.chunk_id, r.score) for r in R.vector_search(vec, queries).collect()] == [(3, 1.0)]
    assert {r.chunk_id for r in R.lsh_candidates(vec, queries).collect()} >= {3}


def test_hyperplane_keys_find_near_vectors(spark):
    import numpy as np

    r = np.random.default_rng(9)
    centres = r.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + 0.15 * r.standard_normal(16)).tolist()) for i in range(600)] + [(900, None), (901, [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    queries = chunks.where("chunk_id % 50 = 0 and chunk_id < 900").selectExpr("chunk_id as query_id", "embedding as vector")
    found = {tuple(x) for x in R.lsh_candidates(chunks, queries).collect()}
    best = {(x.query_id, x.chunk_id) for x in R.vector_search(chunks, queries, 10).collect()}
    assert len(found & best) / len(best) >= 0.9 and len(found) < 12 * 600


def test_evaluation(spark):
    hits = spark.createDataFrame([(0, 1, "a/x"), (0, 2, "b/y"), (1, 1, "c")], "query_id int, rank int, url string")
    gold = spark.createDataFrame([(0, "y"), (1, "q"), (2, "z")], "query_id int, expect string")
    r = R.evaluate(hits, gold).first()
    assert abs(r.hit_rate - 1 / 3) < 1e-9 and abs(r.mrr - 1 / 6) < 1e-9


def test_backfill_upsert_and_create_are_idempotent(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id bigint")
    chunks = spark.createDataFrame([(1, 0)], "document_id bigint, chunk_index int")
    assert [r.id for r in I.backfill(docs, chunks).collect()] == [2]
    new = spark.createDataFrame([(1, 7), (1, 8)], "document_id bigint, chunk_index int")
    once = I.replace_chunks(chunks, new)
    assert sorted(map(tuple, I.replace_chunks(once, new).collect())) == sorted(map(tuple, once.collect())) == [(1, 7), (1, 8)]


def test_nothing_to_extract_is_skipped(spark):
    rows = E.outcome(E.extract(spark.createDataFrame([(1, None, "<body><nav>x</nav></body>"), (2, "https://h/", "<p>t</p>")], "page_version_id bigint, url string, raw_html string")))
    assert {r.page_version_id: r.outcome for r in rows.collect()} == {1: "skipped", 2: "processed"}


def test_store_snapshots(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    schema = S.ddl("id bigint, queue string")
    assert s.read("t", schema).count() == 0
    for i in range(4):
        s.append("t", spark.createDataFrame([(i,)], "id bigint"), schema)
    assert sorted(r.id for r in s.read("t", schema).collect()) == [0, 1, 2, 3] and len(s._parts("t")) == 4


def test_search_plan_cuts_to_k_before_the_shuffle(spark):
    e = spark.range(100).select(F.col("id").alias("chunk_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, vector array<double>")
    plan = R.vector_search(e, q, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_only_scans_are_spread(spark, tmp_path):
    from corpusweave.functions.partition import is_scan, spread

    path = str(tmp_path / "Exchange InArrow")  # names in a plan decide nothing
    spark.range(10).withColumnRenamed("id", "Exchange").coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    assert is_scan(scan.where("Exchange > 1").selectExpr("Exchange + 1 as x")) and spread(scan).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for df in (scan.repartition(1), scan.groupBy("Exchange").count(), scan.join(scan.withColumnRenamed("Exchange", "b"), F.col("Exchange") == F.col("b")), scan.mapInArrow(lambda it: it, "Exchange bigint"), scan.orderBy("Exchange")):
        assert not is_scan(df)
    assert is_scan(spark.createDataFrame([(1,)], "a int")) and is_scan(spark.createDataFrame([], "a int"))


def test_chunks_are_counted_in_a_public_vocabulary(spark):
    import pickle

    import pytest

    pytest.importorskip("public_tokenizers")
    from corpusweave.functions import chunk as H

    own = H.default_tokenizer()
    assert isinstance(own, H.RankTokenizer) and len(pickle.dumps(own)) < 1000
    text = " ".join(f"Sentence {i} tells of gardens and grüne Blätter." for i in range(300))
    made = I.chunk(spark.createDataFrame([(1, "T", text)], "document_id bigint, title string, cleaned_text string")).orderBy("chunk_index").collect()
    assert len(made) > 4 and all(r.token_count == len(own.encode(r.text)) <= H.MOST for r in made)
    words = I.chunk(spark.createDataFrame([(1, "T", text)], "document_id bigint, title string, cleaned_text string"), H.PieceTokenizer()).collect()
    assert len(words) != len(made)


def test_nearest_keeps_k_rows_whatever_the_slices():
    """What a task holds and returns of a search doesn't grow with its batches; null ids first, nan never."""
    import numpy as np

    r = np.random.default_rng(4)
    score = np.round(r.standard_normal((5, 300)), 1)
    score[2], score[:, 7] = np.nan, np.nan
    ids, null = r.permutation(300).astype(np.int64), np.arange(300) % 50 == 0
    ids[null] = R.LEAST_ID
    best = R.Nearest(5, 4)
    for at in range(0, 300, 23):
        best.add(score[:, at : at + 23], ids[at : at + 23], null[at : at + 23])
    got = best.rows(np.arange(5)).to_pylist()
    want = [(q, s, i) for q in (0, 1, 3, 4) for s, i in sorted((-score[q, j], (not null[j], ids[j])) for j in range(300) if j != 7)[:4]]
    assert [(x["number"], -x["score"], (x["chunk_id"] is not None, R.LEAST_ID if x["chunk_id"] is None else x["chunk_id"])) for x in got] == want
