"""Streaming forms agree with the batch forms."""

from corpusweave.operators import crawl as C
from corpusweave.streaming.streams import PAGES, cooldown_stream, process_pages

EVENTS = [("a", t, i, b) for i, (t, b) in enumerate([(0, True), (10_000, True), (20_000, False), (30_000, True), (40_000, True), (200_000, True)])] + [("b", 5, 9, True)]
SCHEMA = "domain string, now_ms bigint, seq bigint, blocked boolean"


def test_stream_of_pages_is_processed_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    for i in (1, 2):
        spark.createDataFrame([(i, f"https://h/{i}", f"<title>T{i}</title><body><p>text {i}</p></body>")], PAGES).write.mode("append").parquet(src)
        process_pages(spark, src, out, ckpt).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.page_version_id, r.title, r.cleaned_text, r.content_type) for r in rows) == [(1, "T1", "text 1", "listing"), (2, "T2", "text 2", "listing")]


def test_cooldown_batch_and_stream(spark, tmp_path):
    want = sorted((r.seq, r.in_cooldown) for r in C.cooldown(spark.createDataFrame(EVENTS, SCHEMA)).collect())
    assert want == [(0, False), (1, False), (2, False), (3, False), (4, True), (5, False), (9, False)]
    src = str(tmp_path / "src")
    spark.createDataFrame(EVENTS, SCHEMA).coalesce(1).write.parquet(src)
    q = cooldown_stream(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("memory").queryName("cold").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.seq, r.in_cooldown) for r in spark.table("cold").collect()) == want


def test_rejects_of_the_stream_are_written(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from corpusweave.operators import extract as E

    monkeypatch.setattr(E, "invalid_document", lambda: F.col("title") == "Bad")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(i, f"https://h/{i}", f"<title>{t}</title><body><p>text</p></body>") for i, t in ((1, "Good"), (2, "Bad"))], PAGES).write.parquet(src)
    process_pages(spark, src, out, str(tmp_path / "c")).awaitTermination()
    assert [r.title for r in spark.read.parquet(out).collect()] == ["Good"] and [r.title for r in spark.read.parquet(out + "-rejects").collect()] == ["Bad"]


def test_stream_of_documents_is_indexed_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusweave.functions.embed import HashingEmbedder
    from corpusweave.operators import keyword_index as K
    from corpusweave.operators import retrieve as R
    from corpusweave.streaming.streams import TEXTS, index_documents

    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    texts = [(i, f"T{i}", f"Document number{i} tells of common things. " * 40) for i in range(6)]
    for part in (texts[:3], texts[3:]):
        spark.createDataFrame(part, TEXTS).write.mode("append").parquet(src)
        for _ in range(2):  # started again without anything new
            index_documents(spark, src, out, ckpt, embedder=HashingEmbedder(16), analyzer="simple").awaitTermination()
    chunks = spark.read.parquet(out + "/chunks")
    assert chunks.select("document_id").distinct().count() == 6 and chunks.select("id").distinct().count() == chunks.count()
    assert {len(r.embedding) for r in chunks.collect()} == {16}
    index = spark.read.schema(K.INDEX).parquet(out + "/keyword_index")
    assert index.where("bucket = -1").select(F.explode("ids")).count() == chunks.count()
    queries = spark.createDataFrame([(i, f"number{i}") for i in range(6)], "query_id bigint, q string")
    best = R.keyword_search(index, queries, 1).join(chunks, F.col("chunk_id") == F.col("id")).collect()
    assert {(r.query_id, r.document_id) for r in best} == {(i, i) for i in range(6)}
