"""The keyword index against plain scoring: random texts, blocks of queries, buckets, parts built apart, and what pruning saves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import index as I
from corpusweave.operators import keyword_index as K
from corpusweave.operators import retrieve as R


def texts(seed, n):
    """Words of very different frequency; one that every text has, and one word many times."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [(i, "common " + " ".join(words[min(int(r.paretovariate(0.7)), 399)] for _ in range(r.choice([2, 10, 60])))) for i in range(n)]
    out[3] = (3, "many " * 300)
    return [*out, (n, None), (n + 1, ""), (n + 2, "?!")]


def plain(rows, asked, k):
    out = {}
    for q, text in asked:
        own = sorted(set((text or "").split()))
        found = []
        for i, t in rows:
            words = (t or "").split()
            s = math.fsum(K.WEIGHTS[min(words.count(w), 255)] / len(own) for w in own)
            if s > 0:
                found.append((-round(s, 12), i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return {q: x for q, x in out.items() if x}


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found] and np.allclose([s for _, s in got[q]], [s for _, s in found], atol=1e-11)


@pytest.fixture(scope="module")
def rows():
    return texts(1, 2500)


@pytest.fixture(scope="module")
def index(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(3)
    return K.build(I.terms(df)).cache()


ASKED = [(0, "common w1 w2 w300"), (1, "w7"), (2, "many many w5"), (3, None), (4, "nothing here"), (5, "common"), (6, " ".join(f"w{i}" for i in range(60)))]


def test_equals_plain_scoring(spark, index, rows):
    queries = spark.createDataFrame(ASKED, "query_id bigint, q string")
    same(answers(R.keyword_search(index, queries, 7)), plain(rows, ASKED, 7))


def test_blocks_of_queries_and_of_products(spark, index, rows, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(K, "PRODUCTS", 50)
    queries = spark.createDataFrame(ASKED, "query_id bigint, q string")
    same(answers(R.keyword_search(index, queries, 3)), plain(rows, ASKED, 3))


def test_parts_built_apart(spark, rows):
    cut = lambda a, b: I.terms(spark.createDataFrame(rows[a:b], "chunk_id bigint, text string"))
    index = K.build(cut(0, 900), 1).unionByName(K.build(cut(900, None), 2))
    assert index.where("bucket = -1").select("shard").distinct().count() == index.where("bucket = -1").count()
    assert index.select(F.explode("ids")).count() == len(rows)
    queries = spark.createDataFrame(ASKED, "query_id bigint, q string")
    same(answers(R.keyword_search(index, queries, 5)), plain(rows, ASKED, 5))


def test_pruning_saves_products(spark, rows):
    """A lexeme that every chunk has and a rare one: once k chunks with the rare one are known, the common postings of the others are left."""
    more = [(i, "common " + ("rare " if i % 40 == 0 else "") + f"x{i % 50}") for i in range(6000)]
    index = K.build(I.terms(spark.createDataFrame(more, "chunk_id bigint, text string").coalesce(1)))
    asked = [(q, f"common rare x{q * 7}") for q in range(5)]
    count = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    lists = R.query_lexemes(spark.createDataFrame(asked, "query_id bigint, q string"))
    got = R.top_k(K.search(index, lists, 3, count), 3)
    same(answers(got), plain(more, asked, 3))
    plain_products, made = (c.value for c in count)
    assert plain_products > 30_000 and made < 0.5 * plain_products


def test_a_few_lexemes_read_their_buckets_alone(spark, index):
    rows = index.where("bucket >= 0").collect()
    assert {K.bucket_of(w) == r.bucket for r in rows for w in r.lexemes} == {True}
    assert max(len(r.ids) for r in index.where("bucket = -1").collect()) <= K.SHARD


def test_empty_index_and_no_queries(spark):
    index = K.build(I.terms(spark.createDataFrame([], "chunk_id bigint, text string")))
    queries = spark.createDataFrame([(1, "word")], "query_id bigint, q string")
    assert R.keyword_search(index, queries).count() == 0
    assert R.keyword_search(index, queries.where("false")).count() == 0


@pytest.mark.parametrize("frequent, rows_", [(512, 1024), (0, 7), (3, 100)])
def test_many_queries_are_scored_together(spark, index, rows, monkeypatch, frequent, rows_):
    """Frequent lexemes by a matrix product, the others by their postings, whatever falls to which, as plain scoring."""
    monkeypatch.setattr(K, "FREQUENT", frequent)
    monkeypatch.setattr(K, "ROWS", rows_)
    monkeypatch.setattr(K, "PRODUCTS", 5000)
    r = random.Random(9)
    asked = ASKED + [(100 + i, " ".join(r.choice(rows[:2500])[1].split()[: r.choice([1, 3, 30])])) for i in range(120)]
    best = K.Best(K.Queries.of([sorted(set((t or "").split())) for _, t in asked], [len(set((t or "").split())) for _, t in asked]), 7)
    every = index.where("bucket >= 0").collect()
    for ids in index.where("bucket = -1").collect():
        own = [x for x in every if x.shard == ids.shard]
        place = {w: i for i, w in enumerate(best.q.lexemes.to_pylist())}
        parts = []
        for x in own:
            ends = np.cumsum(x.sizes)
            c, f = np.frombuffer(x.chunks, "<u2"), np.frombuffer(x.tfs, np.uint8)
            parts += [(place[w], n, t, c[e - n : e], f[e - n : e]) for w, n, t, e in zip(x.lexemes, x.sizes, x.tops, ends) if w in place]
        word, sizes, tops = (np.array([p[i] for p in parts], np.int64) for i in range(3))
        best.add(word, sizes, tops, np.concatenate([p[3] for p in parts]).astype(np.int64), np.concatenate([p[4] for p in parts]), np.array(ids.ids, np.int64))
    got = {}
    for x in best.rows().to_pylist():
        got.setdefault(asked[x["number"]][0], []).append((x["chunk_id"], x["score"]))
    same(got, plain(rows, asked, 7))


def test_lexemes_of_queries_are_hashed_once_a_batch(spark, index, rows, monkeypatch):
    """Not once for each row of the index: what a search costs besides its products doesn't grow with rows times lexemes."""
    calls, real = [], K.pc.index_in
    monkeypatch.setattr(K.pc, "index_in", lambda *a, **b: calls.append(1) or real(*a, **b))

    class Shared:
        value = K.Queries.of([["common", "w1"], ["w7"]], [2, 1])

    batches = index.coalesce(1).toArrow().combine_chunks().to_batches()
    out = [r for b in K._matching(Shared)(batches) for r in b.to_pylist()]
    assert sum(len(b) for b in batches) > len(batches) == len(calls)
    assert len({r["shard"] for r in out if r["words"]}) == index.where("bucket = -1").count()


@pytest.fixture(scope="module")
def whole(spark, rows):
    return K.build_whole(I.terms(spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(5))).cache()


def many(rows, seed=11, n=150):
    r = random.Random(seed)
    return ASKED + [(100 + i, " ".join(r.choice(rows[:2500])[1].split()[: r.choice([1, 3, 30])])) for i in range(n)]


@pytest.mark.parametrize("richest, most", [(1, 10_000), (2, 10_000), (50, 10_000), (1, 40)])
def test_whole_shards_equal_plain_scoring(spark, whole, rows, monkeypatch, richest, most):
    """The richest shards first, then the others above their scores; in blocks of queries too."""
    monkeypatch.setattr(K, "RICHEST", richest)
    monkeypatch.setattr(K, "WHOLE_QUERIES", most)
    asked = many(rows)
    assert whole.count() == 5
    same(answers(R.keyword_search(whole, spark.createDataFrame(asked, "query_id bigint, q string"), 7)), plain(rows, asked, 7))


def scored_here(index, asked, k, floor, monkeypatch=None, **constants):
    for name, value in constants.items():
        monkeypatch.setattr(K, name, value)
    own = [sorted(set((t or "").split())) for _, t in asked]

    class Shared:
        value = K.Queries.of(own, [len(x) for x in own]), floor

    class Count(list):
        def add(self, n):
            self.append(n)

    count = Count(), Count()
    batches = index.select("lexemes", "hashes", "sizes", "tops", "chunks", "tfs", "ids").toArrow().to_batches()
    out = [x for b in K._scored_whole(Shared, k, count)(batches) for x in b.to_pylist()]
    got = {}
    for x in out:
        got.setdefault(asked[x["number"]][0], []).append((x["chunk_id"], x["score"]))
    return got, *(sum(c) for c in count)


@pytest.mark.parametrize("constants", [{}, {"EARLY": 0.0}, {"EARLY": 1.0}, {"CELLS": 1, "PRODUCTS": 50}, {"TABLED": 1}, {"CELLS": 3000, "TABLED": 3, "EARLY": 0.5}])
def test_chunks_are_pruned_by_a_floor(whole, rows, monkeypatch, constants):
    """With each query's k-th score known, all that reach it are found, whatever is left to look-ups."""
    asked = many(rows)
    want = plain(rows, asked, 7)
    floor = np.array([want[q][6][1] if len(want.get(q, [])) == 7 else -1.0 for q, _ in asked])
    got, all_products, made = scored_here(whole, asked, 7, floor, monkeypatch, **constants)
    same(got, want)
    if not constants:
        assert all_products > 100_000 and made < 0.7 * all_products


def test_lexemes_with_one_hash_are_told_apart(whole, rows, monkeypatch):
    asked = many(rows, n=5)
    monkeypatch.setattr(K, "_hashes", lambda words: np.array([len(w) for w in words.to_pylist()], np.uint64))
    words = K._Words(K.pa.array(["aa", "bb", "c"]))
    own, word = words(np.array([1, 2, 2, 3], np.uint64), K.pa.array(["c", "bb", "xx", "yyy"]))
    assert list(zip(own.tolist(), word.tolist())) == [(0, 2), (1, 1)]


def test_whole_shards_of_bounded_size_hold_every_chunk_that_has_lexemes(rows, monkeypatch):
    monkeypatch.setattr(K, "WHOLE_CHUNKS", 100)
    monkeypatch.setattr(K, "WHOLE_POSTINGS", 900)
    text = {i: t.split() for i, t in rows if t and t != "?!"}
    ids = sorted(text)
    lists = [sorted(set(text[i])) for i in ids]
    parts = [(np.array(ids[a::2]), np.array([len(x) for x in lists[a::2]]), K.pa.array([w for x in lists[a::2] for w in x]).dictionary_encode(), np.array([min(text[i].count(w), 255) for i, x in zip(ids[a::2], lists[a::2]) for w in x], np.uint8)) for a in (0, 1)]
    seen, last = {}, math.inf
    for rich, lexemes, _, sizes, tops, chunks, tfs, own in K._whole_rows(parts):
        sizes, tops, chunks, tfs, own = (np.frombuffer(x, kind) for x, kind in ((sizes, "<i4"), (tops, np.uint8), (chunks, "<u2"), (tfs, np.uint8), (own, "<i8")))
        assert len(own) <= 100 and (len(tfs) <= 900 or len(own) == 1) and rich <= last
        last = rich
        for w, n, top, end in zip(lexemes.to_pylist(), sizes.tolist(), tops.tolist(), np.cumsum(sizes).tolist()):
            assert top == tfs[end - n : end].max() and (np.diff(chunks[end - n : end].astype(int)) > 0).all()
            seen |= {(int(own[c]), w): int(f) for c, f in zip(chunks[end - n : end].tolist(), tfs[end - n : end].tolist())}
    assert seen == {(i, w): min(text[i].count(w), 255) for i in ids for w in text[i]}
