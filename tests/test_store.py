"""The store: changes by key against a dictionary, buckets, compaction, and writers at the same time."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from corpusweave import schemas as S
from corpusweave.sources.store import BUCKETS, Store

SCHEMA = S.ddl("id bigint, name string")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id bigint, name string").coalesce(1)


def state(store):
    return {r.id: r.name for r in store.read("t", SCHEMA).collect()}


def buckets(path):
    return {x for x in os.listdir(path) if x.startswith("bucket=")}


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    r, store, want = random.Random(4), Store(spark, str(tmp_path)), {}
    for step in range(14):
        what = r.choice(["append", "upsert", "upsert", "delete", "compact", "compact all"])
        if what == "append":
            new = {i: f"a{step}" for i in range(1000 * step, 1000 * step + r.randrange(1, 8))}
            store.append("t", rows(spark, *new.items()), SCHEMA)
            want |= new
        elif what == "upsert":
            new = {r.choice([*want, 5000 + step]): f"u{step}" for _ in range(5)} if want else {1: "first"}
            store.upsert("t", rows(spark, *new.items()), SCHEMA, "id")
            want |= new
        elif what == "delete" and want:
            gone = r.sample(sorted(want), min(3, len(want)))
            store.delete("t", rows(spark, *[(i, None) for i in [*gone, 99_999]]), SCHEMA, "id")
            want = {i: x for i, x in want.items() if i not in gone}
        elif what.startswith("compact"):
            store.compact("t", SCHEMA, "id" if what == "compact" else None)
        assert state(store) == want and store.read("t", SCHEMA).count() == len(want), (step, what)


def test_changes_and_compaction_touch_their_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("t", rows(spark, *[(i, "old") for i in range(500)]), SCHEMA)
    store.compact("t", SCHEMA, "id")
    assert len(buckets(tmp_path / "t" / "s2")) == BUCKETS
    store.upsert("t", rows(spark, (7, "new")), SCHEMA, "id")
    touched = buckets(tmp_path / "t" / "u3")
    assert len(touched) == 1 and spark.read.parquet(str(tmp_path / "t" / "u3")).count() == 1
    plan = store.read("t", SCHEMA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and "bucket" in plan
    store.compact("t", SCHEMA, "id")
    assert buckets(tmp_path / "t" / "s4") == touched  # the others stay where they are
    assert state(store) == {i: "new" if i == 7 else "old" for i in range(500)}
    store.upsert("t", rows(spark, (8, "newer"), (501, "more")), SCHEMA, "id")
    store.compact("t", SCHEMA, "id")
    store.delete("t", rows(spark, (9, None)), SCHEMA, "id")
    got = state(store)
    assert len(got) == 500 and got[7] == "new" and got[8] == "newer" and got[501] == "more" and 9 not in got


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    store, failed = Store(spark, str(tmp_path)), []

    def writer(k):
        try:
            own = Store(spark, str(tmp_path))
            for i in range(4):
                own.append("t", rows(spark, (100 * k + i, "x")), SCHEMA)
                own.upsert("t", rows(spark, (100 * k + i, f"w{k}")), SCHEMA, "id")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    store.compact("t", SCHEMA, "id")
    [t.join() for t in threads]
    store.compact("t", SCHEMA, "id")
    assert not failed
    assert state(store) == {100 * k + i: f"w{k}" for k in range(4) for i in range(4)} and store.read("t", SCHEMA).count() == 16


def test_a_compaction_keeps_what_was_finished_meanwhile(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("t", rows(spark, (1, "a")), SCHEMA)
    late = store._claim("t")  # a writer that has its number and isn't done
    store.append("t", rows(spark, (3, "c")), SCHEMA)
    store.compact("t", SCHEMA)
    rows(spark, (2, "b")).write.parquet(f"{tmp_path}/t/d{late}")
    assert state(store) == {1: "a", 2: "b", 3: "c"}
    store.compact("t", SCHEMA)
    assert state(store) == {1: "a", 2: "b", 3: "c"}


def test_a_file_is_created_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    made = [store._create(f"{tmp_path}/x y#1%2", str(i)) for i in range(3)]
    assert made == [True, False, False] and store._text(f"{tmp_path}/x y#1%2") == "0" and os.listdir(tmp_path) == ["x y#1%2"]


@pytest.mark.parametrize("how", ["append", "upsert"])
def test_unfinished_parts_are_not_read(spark, tmp_path, how):
    store = Store(spark, str(tmp_path))
    store.append("t", rows(spark, (1, "a")), SCHEMA)
    kind = how[0].replace("a", "d")
    rows(spark, (2, "b")).withColumn("bucket", F.lit(0)).withColumn("_gone", F.lit(False)).write.parquet(f"{tmp_path}/t/{kind}2")
    os.remove(tmp_path / "t" / f"{kind}2" / "_SUCCESS")
    assert state(store) == {1: "a"}
