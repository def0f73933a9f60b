"""The queue and the pages as data sources: a crawl over a local server, killed and restarted, has every page once."""

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corpusweave.sources import queue as Q
from corpusweave.sources.fetch import RESULT

LINKS = {"": ["a", "b", "c"], "a": ["d", ""], "b": ["d", "e"], "c": ["f"], "d": [], "e": [], "f": []}


class Site:
    """A small site that counts its requests and holds some of them until it's told to go on."""

    def __init__(self):
        self.asked, self.held, self.go, self.waiting = Counter(), set(), threading.Event(), threading.Event()
        site = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                name = self.path[1:]
                site.asked[name] += 1
                if name in site.held:
                    site.waiting.set()
                    site.go.wait(20)
                self.send_response(200 if name in LINKS else 404)
                self.end_headers()
                self.wfile.write("".join(f"<a href='/{x}'>{x}</a>" for x in LINKS.get(name, ())).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.server.server_port}/"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def site():
    s = Site()
    yield s
    s.go.set()
    s.server.shutdown()


def pages(spark, queue, out, wait=True):
    Q.register(spark)
    rows = spark.readStream.format("crawl_pages").option("path", queue).load()
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c")
    q = q.trigger(availableNow=True).start() if wait else q.start()
    if wait:
        q.awaitTermination()
    return q


def test_a_killed_crawl_has_every_page_once(spark, tmp_path, site):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    Q.register(spark)
    put = lambda *names: spark.createDataFrame([(site.base + n,) for n in names], "url string").coalesce(1).write.format("crawl_queue").option("path", queue).mode("append").save()
    put("", "a", "a")
    pages(spark, queue, out)
    put("b", "c", "nowhere")
    site.held = {"c"}
    q = pages(spark, queue, out, wait=False)
    assert site.waiting.wait(60)  # in the middle of a batch
    q.stop()
    site.held, _ = set(), site.go.set()
    put("d")
    pages(spark, queue, out)  # the batch that was cut off
    pages(spark, queue, out)
    got = Counter((r.url.removeprefix(site.base), r.status) for r in spark.read.schema(RESULT).parquet(out).collect())
    assert got == Counter({("", 200): 1, ("a", 200): 1, ("b", 200): 1, ("c", 200): 1, ("nowhere", 404): 1, ("d", 200): 1})
    assert site.asked[""] == site.asked["a"] == 1
    pages(spark, queue, out)
    assert spark.read.parquet(out).count() == 6


def test_a_crawl_feeds_its_own_queue(spark, tmp_path, site):
    """Pages, their links that aren't known yet, the queue again, until nothing is new."""
    queue, out, known = str(tmp_path / "queue"), str(tmp_path / "out"), str(tmp_path / "known")
    Q.register(spark)
    spark.createDataFrame([(site.base,)], "url string").write.mode("append").parquet(known)
    spark.createDataFrame([(site.base,)], "url string").write.format("crawl_queue").option("path", queue).mode("append").save()
    for _ in range(4):
        pages(spark, queue, out)
        links = spark.read.parquet(out).select(F.explode(F.regexp_extract_all("html", F.lit("href='/([a-z]*)'"), F.lit(1))).alias("x")).select(F.concat(F.lit(site.base), "x").alias("url")).distinct()
        new = links.join(spark.read.parquet(known), "url", "left_anti").cache()
        if new.isEmpty():
            break
        new.write.format("crawl_queue").option("path", queue).mode("append").save()
        new.write.mode("append").parquet(known)
    assert site.asked == Counter(dict.fromkeys(LINKS, 1)) and spark.read.parquet(out).count() == len(LINKS)


def test_a_stream_written_to_the_queue_commits_once(spark, tmp_path):
    Q.register(spark)
    src, queue = str(tmp_path / "src"), str(tmp_path / "queue")
    for k in range(3):
        spark.createDataFrame([(f"http://h{i}/{k}",) for i in range(5)], "url string").coalesce(1).write.mode("append").parquet(src)
        rows = spark.readStream.schema("url string").parquet(src)
        rows.writeStream.format("crawl_queue").option("path", queue).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    folder = Q.Folder(queue)
    assert folder.commits() >= 3
    writer = Q._StreamWriter(queue)
    again = writer.write(iter([type("Row", (), {"url": "http://h0/again"})()]))
    writer.commit([again], 0)  # a batch that is committed a second time
    assert not folder.exists(again.names[0])
    reader = Q._PageReader({"path": queue})
    names = [n for p in reader.partitions({"commits": 0}, reader.latestOffset()) for n in p.names]
    urls = [u for n in names for u in folder.read(n).split()]
    assert len(urls) == len(set(urls)) == 15
    hosts = [{u.split("/")[2] for n in p.names for u in folder.read(n).split()} for p in reader.partitions({"commits": 0}, reader.latestOffset())]
    assert sum(map(len, hosts)) == 5  # a host is in one partition


def test_time_between_requests_of_a_host(tmp_path, site):
    folder = Q.Folder(str(tmp_path / "queue"))
    folder.write("commits/0", __import__("json").dumps(folder.put(iter([site.base + x for x in "abc"]))))
    reader = Q._PageReader({"path": str(tmp_path / "queue"), "delayMs": "200"})
    began = time.monotonic()
    found = [b for p in reader.partitions({"commits": 0}, {"commits": 1}) for b in reader.read(p)]
    assert len(found) == 3 and time.monotonic() - began >= 0.4
