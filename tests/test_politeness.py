"""Slots, cooldowns and retries as a stream with timers: against the fold over a table and a plain simulation, with restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusweave.operators import crawl as C
from corpusweave.streaming import politeness as P

START = 1_700_000_000_000


def stamp(ms):
    return datetime.datetime.fromtimestamp((START + ms) / 1000, datetime.timezone.utc)


def events(seed, n, domains=4):
    r, rows, now = random.Random(seed), [], 0
    for i in range(n):
        now += r.choice([0, 0, 50, 700, 5000])
        d = f"d{r.randrange(domains)}"
        if r.random() < 0.5:
            rows.append((d, stamp(now), i, "job", f"u{i}", 1, 0, 1000))
        else:
            rows.append((d, stamp(now), i, "answer", f"u{i}", r.randrange(1, 5), r.choice([200, 200, 403, 403, 429, 404, 500, 0]), 1000))
    return rows


def outcome(df):
    return sorted(map(tuple, df.select("domain", "at_ms", "url", "attempt", "event", "in_cooldown").collect()))


def run(spark, path, tmp_path, name, idle=P.IDLE_MS, per_trigger=1):
    stream = spark.readStream.schema(P.INPUT).option("maxFilesPerTrigger", per_trigger).parquet(path)
    q = P.politeness_stream(stream, idle_ms=idle).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_slots_of_the_fold_are_the_closed_form(spark):
    rows = [x for x in events(3, 200) if x[3] == "job"]
    df = spark.createDataFrame(rows, P.INPUT)
    got = {r.url: r.at_ms for r in P.politeness(df).where("event = 'due'").collect()}
    arrivals = df.select("domain", F.unix_millis("at").alias("now_us"), "seq", F.col("delay_ms").alias("delay"), "url")
    assert got == {r.url: r.slot for r in C.rate_slots(arrivals).collect()} and len(got) == len(rows)


def test_cooldowns_of_the_fold_are_those_of_the_crawl(spark):
    rows = [(*x[:5], 4, *x[6:]) for x in events(5, 200) if x[3] == "answer"]  # last attempts, so that nothing is tried again
    df = spark.createDataFrame(rows, P.INPUT)
    want = C.cooldown(df.select("domain", F.unix_millis("at").alias("now_ms"), "seq", F.col("status").isin(403, 429).alias("blocked")))
    want = {f"u{r.seq}": r.in_cooldown for r in want.collect()}
    got = {r.url: r.in_cooldown for r in P.politeness(df).collect()}
    assert got == want and any(got.values())


def test_retries_wait_out_their_backoff_and_end_dead(spark):
    rows = [("d", stamp(0), 1, "answer", "u", 1, 500, 1000), ("d", stamp(100_000), 2, "answer", "u", 4, 500, 1000), ("d", stamp(1), 3, "answer", "v", 1, 404, 0)]
    got = outcome(P.politeness(spark.createDataFrame(rows, P.INPUT)))
    assert got == [("d", START + 1, "v", 1, "done", False), ("d", START + 1000, "u", 2, "due", False), ("d", START + 100_000, "u", 4, "dead", False)]


@pytest.mark.parametrize("seed", [1])
def test_stream_equals_fold_out_of_order_and_over_restarts(spark, tmp_path, seed):
    rows = events(seed, 160)
    want = outcome(P.politeness(spark.createDataFrame(rows, P.INPUT)))
    assert {x[4] for x in want} == {"due", "done", "dead"} and any(x[5] for x in want)
    r = random.Random(seed)
    src = str(tmp_path / "src")
    parts = [rows[i : i + 40] for i in range(0, 160, 40)]
    for k, part in enumerate(parts):
        part = sorted(part, key=lambda x: x[1].timestamp() + r.uniform(0, 4))  # a little out of order
        spark.createDataFrame(part, P.INPUT).coalesce(1).write.mode("append").parquet(src)
        run(spark, src, tmp_path, "out")  # every part after a restart
    flush = [("zz", stamp(10_000_000), 10_000, "answer", "end", 1, 200, 0), ("zz", stamp(10_100_000), 10_001, "answer", "end2", 1, 200, 0)]
    for row in flush:
        spark.createDataFrame([row], P.INPUT).coalesce(1).write.mode("append").parquet(src)
        run(spark, src, tmp_path, "out")
    got = outcome(spark.read.schema(P.OUTPUT).parquet(str(tmp_path / "out")).where("domain <> 'zz'"))
    assert got == want
    held = spark.read.format("statestore").option("path", str(tmp_path / "out-c")).option("stateVarName", "state").load()
    assert [x.key.domain for x in held.select("key").collect() if x.key.domain != "zz"] == []  # idle domains are forgotten
