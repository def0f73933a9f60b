"""The trigram index against a plain ILIKE, with short patterns, odd characters, several blocks and texts added later."""

import random
import re

import pytest

from corpusweave.operators import substring_index as S
from corpusweave.plans import catalogue

ODD = [(9000, None), (9001, ""), (9002, "ab"), (9003, "a%b_c"), (9004, "Straße ÄÖÜ İstanbul ΑΣ"), (9005, "line\nbreak x"), (9006, "𝒳𝒴𝒵 日本語"), (9007, "aaa" * 500)]


def texts(seed, n):
    r = random.Random(seed)
    return [(i, "".join(r.choice("abcdeAB é_ ") for _ in range(r.choice([3, 20, 200])))) for i in range(n)]


def like(pattern, text):
    """ILIKE by one regular expression."""
    return re.fullmatch("".join(".*" if x == "%" else "." if x == "_" else re.escape(x) for x in S.folded(pattern)), S.folded(text), re.S) is not None


PATTERNS = ["%abc%", "%ABC_d%", "abc%", "%cde", "%ab%cd%ea%", "a", "%a%", "%é%", "ab", "_b", "%", "", "___", "%xyzxyz%", "%straße%", "%äöü i%", "%ασ%", "%\nbreak%", "%日本語", "%aaaa%", "a%b_c", "%__a b__%", "%abca%bcab%", "%aba%aba%"]


@pytest.fixture(scope="module")
def rows():
    return texts(3, 2600) + ODD


@pytest.fixture(scope="module")
def index(spark, rows):
    return S.SubstringIndex.build(spark.createDataFrame(rows, "id bigint, text string").repartition(3))


def asked(spark, patterns):
    return spark.createDataFrame(list(enumerate(patterns)), "pattern_id bigint, pattern string")


def want(rows, patterns):
    return sorted((i, d) for i, p in enumerate(patterns) if p is not None for d, t in rows if t is not None and like(p, t))


def test_equals_ilike(spark, index, rows):
    got = sorted(map(tuple, index.search(asked(spark, [*PATTERNS, None])).collect()))
    assert got == want(rows, PATTERNS)


def test_random_patterns_in_blocks(spark, index, rows, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_PATTERNS", 7)
    r = random.Random(5)
    patterns = []
    for _ in range(40):
        t = r.choice(rows[:2600])[1]
        a = r.randrange(len(t))
        p = list(t[a : a + r.choice([3, 6, 12])])
        for _ in range(r.randrange(3)):
            p[r.randrange(len(p))] = r.choice("%_")
        patterns.append("%" + "".join(p) + r.choice(["%", ""]))
    assert sorted(map(tuple, index.search(asked(spark, patterns)).collect())) == want(rows, patterns)


def test_candidates_are_few_and_complete(spark, index, rows):
    patterns = ["%abcd%", "%a_c%"]
    found = index.candidates(patterns)
    assert {r.number for r in found.collect()} == {0}  # the other has no trigram
    hits = len(want(rows, patterns[:1]))
    assert hits <= found.count() < len(rows) / 2


def test_texts_added_later(spark, rows):
    index = S.SubstringIndex.build(spark.createDataFrame(rows[:1000], "id bigint, text string"))
    index.add(spark.createDataFrame(rows[1000:], "id bigint, text string"))
    assert index.texts().select("shard", "place").distinct().count() == len([t for _, t in rows if t is not None])
    assert sorted(map(tuple, index.search(asked(spark, PATTERNS[:5])).collect())) == want(rows, PATTERNS[:5])


def test_empty_index(spark):
    index = S.SubstringIndex.build(spark.createDataFrame([], "id bigint, text string"))
    assert index.search(asked(spark, ["%abc%", "%a%"])).count() == 0
    assert index.search(asked(spark, ["x"]).where("false")).count() == 0


def test_matcher():
    r = random.Random(6)
    for _ in range(4000):
        p, t = "".join(r.choice("ab%_") for _ in range(r.randrange(7))), "".join(r.choice("ab") for _ in range(r.randrange(8)))
        assert S.Matcher(p)(t) == like(p, t), (p, t)


def test_patterns_in_upper_case_keep_their_length(spark, tmp_path):
    """ß is one character in upper case too, as in the query's SQL."""
    rows = [(50, "1234567auß xnschen"), (51, "vor auß ynsch nach"), (52, "vor auss ynsch nach"), (100, None), (150, "1234567ﬁŉǰ_ſıςµ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, catalogue.substring_search(spark, str(tmp_path)).collect())) == [(50, 50), (50, 51), (150, 150)]


def test_many_patterns_meet_a_text_once(spark, rows, tmp_path):
    """No candidates are written and no text is sent for a single pattern; the same rows as ILIKE, several ids of one pattern too."""
    index = S.SubstringIndex.build(spark.createDataFrame(rows, "id bigint, text string").repartition(3), f"{tmp_path}/index")
    r = random.Random(8)
    patterns = PATTERNS + ["%" + "".join(r.choice("abcde_% ") for _ in range(r.choice([4, 5, 9]))) + r.choice(["%", ""]) for _ in range(80)] + PATTERNS[:3]
    got = index.search(asked(spark, patterns))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan and sorted(p.name for p in (tmp_path / "index").iterdir()) == ["texts"]
    assert sorted(map(tuple, got.collect())) == want(rows, patterns)


@pytest.mark.parametrize("wide", [False, True])
def test_places_equal_ilike(rows, wide):
    """Also where four characters don't fit into an integer, and texts and patterns shorter than four."""
    own = [t for _, t in rows[:600] + rows[-len(ODD) :] if t is not None] + ["".join(map(chr, range(1000, 1600)))] * wide
    places, r = S.Places(own), random.Random(7)
    assert places.exact != wide
    patterns = list(PATTERNS)
    for _ in range(200):
        t = r.choice(own)
        a = r.randrange(len(t) + 1)
        p = list(t[a : a + r.choice([2, 6, 12])])
        for _ in range(r.randrange(3) * bool(p)):
            p[r.randrange(len(p))] = r.choice("%_")
        patterns.append(r.choice(["%", ""]) + "".join(p) + r.choice(["%", ""]))
    for p in patterns:
        assert places.match(S.folded(p)).tolist() == [i for i, t in enumerate(own) if like(p, t)], p
