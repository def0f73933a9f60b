"""The filter of known addresses: equal to the anti-join, few false positives, extended, and without reading the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from corpusweave.operators import known as N


def urls(spark, names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_equals_the_anti_join(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    have, f = [], N.KnownFilter(spark, str(tmp_path / "f"))
    for k in range(4):
        more = [f"https://h{r.randrange(50)}.example/{r.randrange(20_000)}" for _ in range(700)]
        f.extend(urls(spark, more))
        have += more
        known = urls(spark, have)
        asked = urls(spark, [*(f"https://h{r.randrange(50)}.example/{r.randrange(20_000)}" for _ in range(900)), None, have[0], have[-1]])
        want = sorted(x.url for x in asked.where("url is not null").distinct().join(known, "url", "left_anti").collect())
        monkeypatch.setattr(N, "LISTED", 1000 if k % 2 else 3)  # by a list, and by a join
        assert sorted(x.url for x in f.fresh(asked, known).collect()) == want and want
    again = N.KnownFilter(spark, str(tmp_path / "f"))
    assert again.fresh(urls(spark, have), urls(spark, have)).count() == 0
    again.rebuild(urls(spark, have))
    assert len(again._segments()) == 1 and again.fresh(urls(spark, [*have, "new"]), urls(spark, have)).count() == 1


def test_false_positives_are_few(spark, tmp_path):
    f = N.KnownFilter(spark, str(tmp_path / "f"))
    f.extend(spark.range(60_000).select(F.concat(F.lit("https://known.example/"), "id").alias("url")))
    r = f.asked(spark.range(60_000).select(F.concat(F.lit("https://other.example/"), "id").alias("url"))).agg(F.avg(F.col("maybe").cast("double")), F.count("*")).first()
    assert r[1] == 60_000 and r[0] < 0.01
    known = f.asked(spark.range(60_000).select(F.concat(F.lit("https://known.example/"), "id").alias("url")))
    assert known.where("not maybe").count() == 0


def test_the_table_is_not_read_whole(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.range(20_000).select(F.format_string("https://h.example/%08d", "id").alias("url")).coalesce(1).sortWithinPartitions("url").write.parquet(path)
    pages, f = spark.read.parquet(path), N.KnownFilter(spark, str(tmp_path / "f"))
    f.extend(pages)
    only_new = f.fresh(urls(spark, [f"https://new.example/{i}" for i in range(20)]), pages)
    plan = only_new._jdf.queryExecution().toString()
    assert only_new.count() == 20 and path not in plan or "In(url" in plan
    some = f.fresh(urls(spark, ["https://h.example/00000007", "https://new.example/x"]), pages)
    assert [r.url for r in some.collect()] == ["https://new.example/x"]
    assert "PushedFilters: [IsNotNull(url), EqualTo(url" in some._jdf.queryExecution().toString() or "In(url" in some._jdf.queryExecution().toString()


@pytest.mark.parametrize("empty", ["filter", "asked"])
def test_empty_sides(spark, tmp_path, empty):
    f = N.KnownFilter(spark, str(tmp_path / "f"))
    if empty == "asked":
        f.extend(urls(spark, ["a"]))
        assert f.fresh(urls(spark, []), urls(spark, ["a"])).count() == 0
    else:
        assert [r.url for r in f.fresh(urls(spark, ["b", "b"]), urls(spark, [])).collect()] == ["b"]
        f.extend(urls(spark, []))
        assert f.fresh(urls(spark, ["b"]), urls(spark, [])).count() == 1
