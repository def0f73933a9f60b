"""Searches and answers over whole tables against brute force."""

import math
import random
import re
from urllib.parse import urlsplit

import pytest

from corpusweave.operators import retrieve as R
from corpusweave.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """330 documents, most with a vector, 30 vectors without a document, and events of odd and even users."""
    r = random.Random(8)
    d = str(tmp_path_factory.mktemp("whole"))
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 20, 120]))) + r.choice(["", " [4]"]), f"site{i % 3}.example") for i in range(330)]
    docs[7] = (7, None, "site1.example")
    docs[120] = (120, docs[100][1], "site0.example")
    vecs = [(i, [r.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(4)], r.randrange(4)) for i in range(360) if i % 11]
    vecs[20] = (vecs[20][0], [0.0] * 4, 1)
    events = [(i, i % 5) for i in range(40)]
    for name, rows, schema in (("documents", docs, "doc_id bigint, text string, source string"), ("embeddings", vecs, "vec_id bigint, embedding array<float>, label int"), ("events", events, "event_id bigint, user_id bigint")):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d, {i: (t, s) for i, t, s in docs}, {i: (v, x) for i, v, x in vecs}, events


def cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    n = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return dot(a, b) / n if n else None


def brute_vectors(vectors, v, k):
    scored = [(-s, i) for i, x in vectors.items() if v and (s := cosine(x, v)) is not None]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def terms(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def brute_words(texts, q, k):
    asked, scored = list(dict.fromkeys(terms(q))), []
    for i, t in texts.items():
        tf = {x: terms(t).count(x) for x in asked}
        if any(tf.values()):
            scored.append((-round(math.fsum(0.1 / R.PI2_6 * math.fsum(1 / j**2 for j in range(1, min(n, 255) + 1)) / len(asked) for n in tf.values()), 12), i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


def fused(lists, k):
    seen = {}
    for at, found in lists:
        for rank, (i, _) in enumerate(found, 1):
            seen.setdefault(i, []).append((at, rank))
    return [(i, -s) for s, _, i in sorted((-sum(1 / (60 + n) for _, n in x), x[0], i) for i, x in seen.items())][:k]


def brute_hybrid(tables, k):
    """query id: its ranked (chunk, score)."""
    _, docs, vecs, _ = tables
    vectors, texts = {i: v for i, (v, _) in vecs.items() if i in docs}, {i: t for i, (t, _) in docs.items()}
    pool = max(k, 10)
    return {i: fused([(0, brute_vectors(vectors, vectors.get(i), pool)), (1, brute_words(texts, texts[i], pool))], k) for i in docs if i % 50 == 0}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_answers_use_the_whole_search(spark, tables):
    d, docs, _, _ = tables
    want = {q: [i for i, _ in found] for q, found in brute_hybrid(tables, 5).items()}
    assert len(want) == 7 and any(i % 50 and i > 200 for x in want.values() for i in x)
    url = lambda i: f"https://{docs[i][1]}/{i}"
    texts = {i: docs[i][0] for x in want.values() for i in x}
    assert any(len(t or "") > 400 for t in texts.values())
    block = lambda n, i: f"[{n}] Source: {url(i)}\n{texts[i]}"
    assert rows(catalogue.rag_context(spark, d)) == sorted((q, "\n\n".join(block(n, i) for n, i in enumerate(x, 1) if texts[i] is not None)) for q, x in want.items())
    short = lambda t: t if t is None or len(t) <= 160 else t[:160] + "…"
    assert rows(catalogue.citations(spark, d)) == sorted((q, n, url(i), f"Doc {i}", short(texts[i])) for q, x in want.items() for n, i in enumerate(x, 1))
    assert rows(catalogue.distinct_sources(spark, d)) == sorted((q, len(set(x))) for q, x in want.items())
    hosts = {q: len({urlsplit(url(i)).netloc for i in x}) for q, x in want.items()}
    assert rows(catalogue.multi_source_hosts(spark, d)) == sorted((q, n, n >= 2) for q, n in hosts.items())


def test_limits_of_all_events_and_markers_behind_whole_texts(spark, tables):
    d, docs, _, events = tables
    assert rows(catalogue.crawl_limits(spark, d)) == [(i, 4 if i % 3 == 0 else 2, 9 if i % 3 == 0 else 50 if i % 2 else 30) for i, _ in events]
    got = {(r.doc_id, r.pos): (r.marker, r.url) for r in catalogue.inline_citations(spark, d).collect()}
    link = lambda m: (m, f"https://source/{m}" if 1 <= m <= 5 else None)
    assert got == {(i, n): link(m) for i, (t, _) in docs.items() if t is not None for n, m in ((1, i % 7), (2, i % 3 + 1))}


def ranked(want):
    return sorted((q, n, i, round(s, 6)) for q, found in want.items() for n, (i, s) in enumerate(found, 1))


def near(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("most", [1000, 4])
def test_searches_take_every_query_also_in_blocks(spark, tables, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_QUERIES", most)
    d, docs, vecs, _ = tables
    vectors, texts = {i: v for i, (v, _) in vecs.items()}, {i: t for i, (t, _) in docs.items()}
    top = {i: brute_vectors(vectors, v, 10) for i, v in vectors.items() if i % 50 == 0}
    assert len(top) == 7 and near(catalogue.vector_topk(spark, d)) == ranked(top)
    assert near(catalogue.keyword_or_rank(spark, d)) == ranked({i: brute_words(texts, t, 10) for i, t in texts.items() if i % 50 == 0})
    hybrid = brute_hybrid(tables, 10)
    assert near(catalogue.hybrid_rrf(spark, d)) == ranked(brute_hybrid(tables, 5))
    groups = {g: fused([(sub, hybrid[g * 100 + sub * 50]) for sub in (0, 1) if g * 100 + sub * 50 in hybrid], 8) for g in {i // 100 for i in hybrid}}
    assert near(catalogue.multi_query_rrf(spark, d)) == ranked(groups)
    firsts = [next((n for n, i in enumerate([i for i, _ in brute_vectors(vectors, vectors[q], 6) if i != q][:5], 1) if vecs[i][1] == vecs[q][1]), None) for q in top]
    got = catalogue.retrieval_eval(spark, d).first()
    assert (got.hit_rate, got.mrr) == (round(sum(x is not None for x in firsts) / 7, 6), round(sum(1 / x for x in firsts if x) / 7, 6))


def test_english_search_takes_every_query(spark, tables):
    d, docs, _, _ = tables
    texts = {i: t for i, (t, _) in docs.items()}  # words and digits that the stemmer leaves as they are
    assert near(catalogue.keyword_english(spark, d)) == ranked({i: brute_words(texts, t, 10) for i, t in texts.items() if i % 50 == 0})
