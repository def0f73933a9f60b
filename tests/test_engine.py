"""Crawl, process, index, search and ask over a small offline site."""

import pytest
from pyspark.sql import functions as F

from corpusweave import schemas as S
from corpusweave.engine import Engine
from corpusweave.functions.embed import HashingEmbedder
from corpusweave.sources.fetch import FixtureFetcher

BASE = "https://site.example/"


def page(title, body, links=()):
    nav = "".join(f'<a href="{x}">{x}</a>' for x in links)
    return f"<html><head><title>{title}</title></head><body><nav>{nav}</nav><main><p>{body}</p></main></body></html>"


PAGES = {
    BASE: page("Home", "Welcome to the garden pages about plants and soil.", ["/roses", "/tulips#top", "https://other.example/x", "/gone"]),
    BASE + "roses": page("Roses", "Roses need pruning in late winter. They like sun and rich soil.", ["/", "/deep"]),
    BASE + "tulips": page("Tulips", "Tulips are planted in autumn. Their bulbs need cold months."),
    BASE + "deep": page("Deep", "A deep page on compost and mulch."),
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    pages = spark.createDataFrame(list(PAGES.items()), "url string, html string")
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), FixtureFetcher(pages), embedder=HashingEmbedder(128))
    e.add_sites(spark.createDataFrame([(1, "Garden", BASE, 500, True, "static", 2, 50), (2, "Closed", "https://closed.example/", 500, False, "static", 2, 50)], "id bigint, name string, base_url string, crawl_delay_ms int, allowed boolean, render_mode string, max_depth int, max_pages int"))
    e.start_crawl(1)
    e.process()
    e.index()
    return e


def test_crawl_follows_links_to_the_depth_and_counts_outcomes(engine):
    status = {r.url: r.status for r in engine.table("pages").collect()}
    assert status == {BASE: "crawled", BASE + "roses": "crawled", BASE + "tulips": "crawled", BASE + "deep": "crawled", BASE + "gone": "failed"}
    s = engine.table("crawl_sessions").first()
    assert (s.status, s.pages_crawled, s.pages_failed, s.pages_skipped) == ("completed", 4, 1, 0)


def test_second_crawl_of_unchanged_pages_adds_no_version_and_no_document(engine):
    before = engine.table("page_versions").count(), engine.table("documents").count(), engine.table("chunks").count()
    engine.start_crawl(1, max_depth=1)
    engine.process()
    engine.index()
    assert before == (engine.table("page_versions").count(), engine.table("documents").count(), engine.table("chunks").count()) == (4, 4, 4)
    last = engine.table("crawl_sessions").orderBy(F.desc("id")).first()
    assert (last.pages_crawled, last.pages_skipped) == (0, 1)


@pytest.mark.parametrize("mode", ["keyword", "semantic", "hybrid"])
def test_search_finds_the_page(engine, mode):
    hits = engine.search("pruning roses in winter", mode, 2).collect()
    assert hits[0].url == BASE + "roses" and hits[0].rank == 1 and hits[0].title == "Roses"


def test_ask_cites_all_hits_and_sub_queries_replace_the_question(engine):
    out = engine.ask("When are tulips planted?", 3)
    assert [c["marker"] for c in out["citations"]] == [1, 2, 3] and "autumn" in out["answer"] and out["mode"] == "hybrid"
    both = engine.ask("anything at all", 2, ["tulips bulbs", "compost mulch"])
    assert {BASE + "tulips", BASE + "deep"} <= {c["url"] for c in both["citations"]} and len(both["citations"]) == 4


def test_listings_and_details(engine):
    rows, total = engine.list_pages(site_id=1, status="crawled", limit=2)
    assert total == 4 and rows.count() == 2
    docs, total = engine.list_documents(q="SOIL")
    assert total == 2 and all(r.length > 0 for r in docs.collect())
    doc = docs.first()
    one, chunks, counts = engine.get_document(doc.id)
    assert one.cleaned_text.startswith(doc.excerpt) and counts.n_chunks == counts.n_embedded == chunks.count()
    p, versions = engine.get_page(rows.first().id)
    assert p.status == "crawled" and versions.first().version_no == 1 and engine.get_raw(p.id).first().document_id is not None
    t = engine.stats()["totals"].first()
    assert (t.sites, t.pages, t.pages_crawled, t.documents, t.chunks_embedded) == (2, 5, 4, 4, 4)
    assert engine.list_sites().count() == 2 and engine.list_crawls(1).count() >= 1 and engine.get_site(1)[0].name == "Garden"


def test_refusals(engine):
    with pytest.raises(PermissionError):
        engine.start_crawl(2)
    with pytest.raises(LookupError):
        engine.start_crawl(9)
    with pytest.raises(ValueError):
        engine.search(" ", "hybrid", 5)


def test_budget_stops_the_crawl(spark, tmp_path):
    pages = spark.createDataFrame([(BASE, page("Home", "x", [f"/{i}" for i in range(5)])), *[(f"{BASE}{i}", page(str(i), "y")) for i in range(5)]], "url string, html string")
    e = Engine(spark, str(tmp_path), FixtureFetcher(pages), embedder=HashingEmbedder(16))
    e.add_sites(spark.createDataFrame([(1, "Many", BASE, True)], "id bigint, name string, base_url string, allowed boolean"))
    e.start_crawl(1, max_depth=1, max_pages=3)
    assert {r.url: r.status for r in e.table("pages").collect()} == {BASE: "crawled", BASE + "0": "crawled", BASE + "1": "crawled", BASE + "2": "skipped"}
    assert S.crawl_request("3", "4") == (3, 4)


def small_site(spark, root, rows, **site):
    """An engine over pages (url, html, status) of one site."""
    e = Engine(spark, root, FixtureFetcher(spark.createDataFrame(rows, "url string, html string, status int")), embedder=HashingEmbedder(16))
    base = {"id": 1, "name": "One", "base_url": BASE, "crawl_delay_ms": 500, "allowed": True} | site
    e.add_sites(spark.createDataFrame([tuple(base.values())], "id bigint, name string, base_url string, crawl_delay_ms int, allowed boolean"))
    return e


def test_robots_are_fetched_once_and_forbidden_pages_are_skipped(spark, tmp_path):
    rows = [(BASE, page("Home", "x", ["/open", "/closed/1"]), 200), (BASE + "open", page("Open", "y"), 200), (BASE + "closed/1", page("No", "z"), 200), ("https://site.example/robots.txt", "User-agent: *\nDisallow: /closed\nCrawl-delay: 2", 200)]
    e = small_site(spark, str(tmp_path), rows)
    session = e.start_crawl(1, max_depth=1)
    assert {r.url: r.status for r in e.table("pages").collect()} == {BASE: "crawled", BASE + "open": "crawled", BASE + "closed/1": "skipped"}
    s = e.table("crawl_sessions").first()
    assert (s.pages_crawled, s.pages_skipped, s.pages_failed) == (2, 1, 0)
    assert e.table("robots").count() == 1 and "Disallow: /closed" in e.get_site(1)[0].robots_txt
    seen = {r.url: r.now_ms for r in e.table("fetches").where(F.col("session_id") == session).collect()}
    assert set(seen) == {BASE, BASE + "open"} and seen[BASE + "open"] - seen[BASE] >= 2000  # robots are stricter than the site's 500 ms
    assert e.table("page_versions").count() == 2


def test_retries_and_cooldowns_end_as_dead_letters(spark, tmp_path):
    rows = [(BASE, page("Home", "x", ["/a", "/b", "/c", "/busy", "/gone"]), 200), *[(f"{BASE}{x}", None, 403) for x in "abc"], (BASE + "busy", None, 503), (BASE + "gone", None, 404)]
    e = small_site(spark, str(tmp_path), rows, crawl_delay_ms=100)
    e.start_crawl(1, max_depth=1)
    status = {r.url: r.status for r in e.table("pages").collect()}
    assert status[BASE] == "crawled" and all(status[BASE + x] == "pending" for x in ("a", "b", "c"))
    tries = e.table("fetches").where(f"url <> '{BASE}'").orderBy("now_ms", "url").collect()
    per = {}
    for r in tries:
        per.setdefault(r.url, []).append((r.attempt, r.in_cooldown))
    assert all([a for a, _ in per[BASE + x]] == [1, 2, 3, 4] for x in ("a", "b", "c"))
    blocks = [r for r in tries if r.status == 403]
    assert not any(r.in_cooldown for r in blocks[:3]) and all(r.in_cooldown for r in tries if r.now_ms > blocks[2].now_ms)  # three blocks in a minute
    by = sorted(tries, key=lambda r: r.now_ms)
    assert all(b.now_ms - a.now_ms >= 100 for a, b in zip(by, by[1:]))
    dead = {r.job_id: (r.attempts_made, r.error_message) for r in e.table("failed_jobs").collect()}
    assert {BASE + x for x in "abc"} <= set(dead) and all(n == 4 for n, _ in dead.values())
    assert dead[BASE + "a"][1] == "site.example is in cooldown"


def test_an_append_writes_only_new_rows(spark, tmp_path):
    from corpusweave.sources.store import Store

    schema = S.ddl("id bigint, name string")
    store = Store(spark, str(tmp_path))
    rows = lambda *xs: spark.createDataFrame([(x, str(x)) for x in xs], "id bigint, name string").coalesce(1)
    count = lambda part: spark.read.parquet(f"{tmp_path}/t/{part}").count()
    store.append("t", rows(1, 2), schema)
    store.append("t", rows(3), schema)
    assert (count("d1"), count("d2")) == (2, 1) and sorted(r.id for r in store.read("t", schema).collect()) == [1, 2, 3]
    old = store.read("t", schema)
    store.compact("t", schema)
    store.append("t", rows(4), schema)
    assert count("s3") == 3 and count("d4") == 1 and store.read("t", schema).count() == 4 and old.count() == 3
    store.write("t", rows(9), schema)
    store.write("t", rows(8), schema)
    assert [r.id for r in store.read("t", schema).collect()] == [8] and not (tmp_path / "t" / "d1").exists() and store.read("none", schema).count() == 0


def test_plain_http_survives_bad_servers():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from corpusweave.sources.fetch import HttpFetcher

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/broken":
                self.wfile.write(b"nonsense\r\n\r\n")
                return
            self.send_response(429 if self.path == "/busy" else 302 if self.path == "/moved" else 200)
            self.send_header("Content-Type", "text/html; charset=" + ("klingon" if self.path == "/charset" else "utf-8"))
            if self.path == "/moved":
                self.send_header("Location", "/end")
            self.end_headers()
            self.wfile.write("grüße".encode() * (1000 if self.path == "/long" else 1))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, f = f"http://127.0.0.1:{server.server_port}", HttpFetcher(timeout=5, most=700)
    assert f.get(base + "/x") == (200, "grüße", base + "/x") and f.get(base + "/charset")[1] == "grüße"
    assert f.get(base + "/moved") == (200, "grüße", base + "/end") and f.get(base + "/busy")[0] == 429
    assert f.get(base + "/broken")[0] == 0 and f.get("http://127.0.0.1:1/")[0] == 0 and f.get("no url")[0] == 0
    assert len(f.get(base + "/long")[1].encode()) <= 702
    server.shutdown()


def test_ids_are_unique_where_hashes_collide(spark, tmp_path, monkeypatch):
    from corpusweave import engine as module

    monkeypatch.setattr(module, "key", lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(11)) + 1)
    rows = [(BASE, page("Home", "x", [f"/{i}" for i in range(6)]), 200), *[(f"{BASE}{i}", page(f"T{i}", f"text of page number {i}."), 200) for i in range(6)]]
    e = small_site(spark, str(tmp_path), rows, crawl_delay_ms=10)
    e.start_crawl(1, max_depth=1)
    e.process()
    e.index()
    for name in ("pages", "page_versions", "documents", "chunks"):
        ids = [r.id for r in e.table(name).select("id").collect()]
        assert len(ids) == len(set(ids)) == 7, name
    by = {r.id: r.url for r in e.table("pages").collect()}
    assert all(f"text of page number {by[r.page_id][-1]}." in r.raw_html for r in e.table("page_versions").collect() if by[r.page_id] != BASE)
    assert {r.url for r in e.search("number", "keyword", 10).collect()} == {f"{BASE}{i}" for i in range(6)}


def test_pages_are_changed_not_rewritten(spark, tmp_path):
    import os

    e = small_site(spark, str(tmp_path), [(BASE, page("Home", "x", ["/a"]), 200), (BASE + "a", page("A", "y"), 200)], crawl_delay_ms=10)
    e.start_crawl(1, max_depth=1)
    parts = sorted(x for x in os.listdir(tmp_path / "pages") if x[0] in "sdu")
    assert {x[0] for x in parts} == {"d", "u"}
    assert all(spark.read.parquet(str(tmp_path / "pages" / x)).count() == 1 for x in parts)
    e.compact()
    assert {r.url: r.status for r in e.table("pages").collect()} == {BASE: "crawled", BASE + "a": "crawled"}


def test_a_domain_has_one_delay(spark, tmp_path):
    """Robots of http and of https ask for different delays; the domain's slots keep the longer one."""
    other = BASE.replace("https", "http")
    rows = [(BASE, page("Home", "x"), 200), (BASE + "robots.txt", "User-agent: *\nCrawl-delay: 1", 200), (other + "robots.txt", "User-agent: *\nCrawl-delay: 3", 200)]
    e = small_site(spark, str(tmp_path), rows, crawl_delay_ms=10)
    site = e.table("sites").first()
    jobs = spark.createDataFrame([(BASE + "a", 1.0), (BASE + "b", 1.0), (other + "c", 3.0), (other + "d", 3.0)], "url string, robots_delay double")
    times = sorted(r.now_ms for r in e._attempt(jobs, site, 1, 0, 1).collect())
    assert all(b - a >= 3000 for a, b in zip(times, times[1:]))


def test_a_body_that_is_too_long_fails(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from corpusweave.sources.fetch import TOO_LARGE, HttpFetcher

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"x" * int(self.path[1:]))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    urls = spark.createDataFrame([(base + n,) for n in ("700", "701")], "url string")
    got = {r.url.removeprefix(base): (r.status, r.html) for r in HttpFetcher(timeout=5, most=700).fetch(urls).collect()}
    server.shutdown()
    assert got == {"700": (200, "x" * 700), "701": (TOO_LARGE, None)}
