"""Conversation repair: edits against all edit sequences, reports against SQL, large conversations against small ones."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusweave.llm")
from corpusweave.llm import conversations as cv  # noqa: E402

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def every_edit(messages):
    """(cost, audit) of the best of all edit sequences with at most two insertions at each place."""
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    per = []
    for symbol, fault in messages:
        late = fault == cv.TRUNCATED
        own = [("D", 3, "")]
        if fault not in (cv.BLANK, cv.DUPLICATE):
            own += [("K", late, symbol or "-"), ("R", 2 + late, "u"), ("R", 2 + late, "a")]
        per.append(own)
    for chosen in itertools.product(*per):
        for gaps in itertools.product(inserts, repeat=len(messages) + 1):
            out = gaps[0] + "".join(c[2] + g for c, g in zip(chosen, gaps[1:]))
            if re.fullmatch("(s?(ua)+)?", out):
                audit = "I" * len(gaps[0]) + "".join(c[0] + "I" * len(g) for c, g in zip(chosen, gaps[1:]))
                found = (sum(c[1] for c in chosen) + 2 * sum(map(len, gaps)), audit)
                best = min(best or found, found)
    return best


def test_shortest_path_is_the_best_of_all():
    r = random.Random(4)
    for n in [0, 1, 1, 2, 2, 2] + [3] * 14:
        messages = [(r.choice(["s", "u", "u", "a", "a", "x", ""]), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        costs, places = cv.backward(messages, cv.END)
        labels, roles, state = cv.forward(places, 0, True)
        assert (costs[0], labels) == every_edit(messages), messages
        assert state in cv.FINAL and len(roles) == len(labels)


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_cut_anywhere(cut):
    """Costs and edits through the 4 x 4 costs of pieces are those of the whole."""
    r = random.Random(cut)
    messages = [(r.choice("suuaax"), r.choice([0, 0, 1, 2, 3])) for _ in range(40)]
    costs, places = cv.backward(messages, cv.END)
    want = cv.forward(places, 0, True)[0]
    pieces = [messages[i : i + cut] for i in range(0, 40, cut)]
    ahead, behind = cv.END, []
    for own in reversed(pieces):
        behind.append(ahead)
        to = [cv.backward(own, tuple(0 if g == q else cv.FAR for g in range(4)))[0] for q in range(4)]
        ahead = tuple(min(to[q][p] + ahead[q] for q in range(4)) for p in range(4))
    assert ahead == costs
    state, got = 0, ""
    for own, after in zip(pieces, reversed(behind)):
        labels, _, state = cv.forward(cv.backward(own, after)[1], state, own is pieces[-1])
        got += labels
    assert got == want


def table(seed, n):
    r = random.Random(seed)
    texts = ["Hello.", "Hello.", "What?", "no end", " \t", "", None, "a.b!c", "Grüße!\n", "x" * 3000 + "."]
    rows = []
    for conv in range(n):
        for turn in range(r.choice([1, 2, 5, 9, 40])):
            rows.append((conv, r.choice([turn, turn, turn, 2 * turn, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts)))
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = table(8, 60)
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", dropped bigint").write.parquet(f"{d}/conversations.parquet")
    return d


def test_odd_conversations_equal_sql(spark, odd):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{odd}/conversations.parquet/*.parquet'")
    rel = con.sql(cv.SQL)
    got = sorted(str(tuple(r)) for r in cv.query(spark, odd).select(*rel.columns).collect())
    assert got == sorted(str(r) for r in rel.fetchall())


@pytest.mark.parametrize("hot", [300, 5000])
def test_large_conversations_equal_small_ones(spark, odd, hot):
    rows = cv.damage(spark.read.parquet(f"{odd}/conversations.parquet").withColumn("conv_id", F.when(F.col("conv_id") % 7 > 0, F.col("conv_id"))))
    small, own = cv.repair(rows)
    large, other = cv.repair(rows, hot)
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(small) == key(large)
    texts = lambda df: {str(r.conv_id): r.all for r in df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("s")).select("conv_id", F.transform("s", lambda x: F.concat(x["role"], F.lit(":"), x["text"])).alias("all")).collect()}
    assert texts(own) == texts(other)


def test_digest_is_of_the_messages(spark, odd):
    import hashlib

    report, messages = cv.repair(cv.damage(spark.read.parquet(f"{odd}/conversations.parquet")))
    held = {}
    for r in sorted(messages.collect(), key=lambda r: (r.conv_id, r.place)):
        held.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in report.collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(held.get(r.conv_id, [])).encode()).hexdigest()


def test_equal_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, "user", "Same.", False)] * 200 + [(2, 1, "user", "x.", True)], SCHEMA + ", dropped boolean")
    for hot in (cv.HOT_BYTES, 2000):
        got = {r.conv_id: r for r in cv.repair(rows, hot)[0].collect()}
        assert (got[1].duplicate, got[1].cost, got[1].audit, got[1].gaps) == (199, 199 * 3 + 2, "K" + "D" * 199 + "I", 0)
        assert (got[2].cost, got[2].audit, got[2].blank) == (0, "", 0)
    report, messages = cv.repair(cv.damage(spark.createDataFrame([], SCHEMA)))
    assert report.count() == 0 and messages.count() == 0
