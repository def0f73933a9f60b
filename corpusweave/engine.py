"""The engine: crawl, process, index, search and ask over snapshot tables.

Stages find their work by anti-joins against what is already there, so each can be run again at any time and a lost run
leaves nothing behind. Ids are hashes of natural keys (url, page and version, document and place), stable across runs; a hash that
another row has is drawn again, and rows are found by their natural keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas as S
from .functions import text as X
from .functions.embed import HashingEmbedder, embed_column
from .operators import answer as A
from .operators import catalog as G
from .operators import crawl as C
from .operators import extract as E
from .operators import index as I
from .operators import keyword_index as K
from .operators import known as N
from .operators import retrieve as R
from .sources.fetch import by_mode, robots_rules, with_robots
from .sources.staging import staged
from .sources.store import Store

TABLES = {"sites": S.SITES, "pages": S.PAGES, "page_versions": S.PAGE_VERSIONS, "documents": S.DOCUMENTS, "chunks": S.CHUNKS, "failed_jobs": S.FAILED_JOBS, "crawl_sessions": S.CRAWL_SESSIONS, "keyword_index": S.ddl(K.INDEX), "robots": S.ddl("origin string, robots_txt string"), "fetches": S.ddl("session_id bigint, url string, domain string, attempt int, now_ms bigint, status int, in_cooldown boolean")}

#: What rows are replaced by, in tables whose rows change.
KEYS = {"sites": "id", "pages": "url"}


def key(*columns) -> F.Column:
    """A positive 63-bit id of a natural key."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


class Engine:
    def __init__(self, spark: SparkSession, root: str, fetcher, js_fetcher=None, embedder=None, generator=None, tokenizer=None, analyzer: str = "english"):
        self.spark, self.store, self.known = spark, Store(spark, root), N.KnownFilter(spark, f"{root.rstrip('/')}/known")
        self.fetcher, self.js_fetcher = fetcher, js_fetcher or fetcher
        self.embedder, self.generator, self.tokenizer, self.analyzer = embedder or HashingEmbedder(), generator, tokenizer, analyzer

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, TABLES[name])

    def write(self, name: str, df: DataFrame) -> None:
        self.store.write(name, df, TABLES[name])

    def change(self, name: str, df: DataFrame) -> None:
        """Rows of df in place of those of the same key."""
        self.store.upsert(name, df, TABLES[name], KEYS[name])

    def with_ids(self, name: str, rows: DataFrame, *natural: str) -> DataFrame:
        """rows, each of another natural key, with ids that no row of the table nor another of them has."""
        taken, out, done = self.table(name).select("id"), staged(rows.withColumn("id", key(*natural)), "ids"), []
        for salt in range(1, 100):
            again = out.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id").union(out.select("id").join(taken, "id", "left_semi"))
            for other in done:
                again = again.union(out.select("id").join(other.select("id"), "id", "left_semi"))
            if again.isEmpty():
                break
            bad = staged(again.distinct(), "ids")
            done.append(out.join(bad, "id", "left_anti"))
            out = staged(out.join(bad, "id", "left_semi").withColumn("id", key(*natural, F.lit(salt))), "ids")
        for other in done:
            out = out.unionByName(other)
        return out

    def add_pages(self, rows: DataFrame) -> None:
        """New pages, of other addresses than there are; the filter has them first."""
        rows = self.with_ids("pages", rows, "url")
        self.known.extend(rows)
        self.store.append("pages", rows, TABLES["pages"])
        if len(self.known._segments()) > N.MOST_SEGMENTS:
            self.known.rebuild(self.table("pages"))

    def new_urls(self, urls: DataFrame) -> DataFrame:
        """Distinct addresses without a page."""
        if not self.known._segments():
            self.known.extend(self.table("pages"))
        return self.known.fresh(urls, self.table("pages"))

    def add_sites(self, sites: DataFrame) -> None:
        """Sites that aren't known by their base address yet."""
        self.store.append("sites", I.find_or_create(self.table("sites").select("base_url"), sites, "base_url"), TABLES["sites"])

    # ------------------------------------------------------------ crawl

    def start_crawl(self, site_id, max_depth=None, max_pages=None, robots: DataFrame | None = None) -> int:
        """Crawls a site breadth first and returns the session's id. A site that isn't allowed is refused.

        robots: origin, robots_txt that are used instead of fetching them.
        """
        site_id = S.positive_id(site_id)
        max_depth, max_pages = S.crawl_request(max_depth, max_pages)
        site = self.table("sites").where(F.col("id") == site_id).first()
        if site is None:
            raise LookupError(f"no site {site_id}")
        if site.allowed is False:
            raise PermissionError(f"site {site_id} is not allowed")
        depth = max_depth if max_depth is not None else (site.max_depth if site.max_depth is not None else 2)
        most = max_pages if max_pages is not None else (site.max_pages or 50)
        sessions = self.table("crawl_sessions")
        session = (sessions.agg(F.max("id")).first()[0] or 0) + 1
        started = self.spark.range(1).select(F.current_timestamp()).first()[0]
        frontier = self.spark.createDataFrame([(site.base_url, 0)], "url string, depth int")
        self.add_pages(self.new_urls(frontier).select("url", F.lit(site_id).alias("site_id"), F.lit("pending").alias("status")))
        counted, tally = 1, {"crawled": 0, "skipped": 0, "failed": 0}
        for level in range(depth + 1):
            links = self._round(frontier, site, session, level, robots, tally)
            if links is None or level == depth:
                break
            first = links.groupBy("url").agg(F.min(F.struct("parent", "place")).alias("p")).select("url", "p.parent", "p.place")
            new = first.join(self.new_urls(first), "url")
            limit = self.spark.createDataFrame([(session, counted, most)], "session bigint, prior bigint, max_pages int")
            judged = C.budget(new.withColumn("session", F.lit(session)), limit).where("outcome <> 'dropped'")
            fresh = judged.select(F.lit(site_id).alias("site_id"), "url", F.when(F.col("outcome") == "enqueued", "pending").otherwise("skipped").alias("status"))
            self.add_pages(fresh)
            frontier = self.table("pages").where((F.col("site_id") == site_id) & (F.col("status") == "pending")).join(links.select("url").distinct(), "url", "left_semi").select("url", F.lit(level + 1).alias("depth"))
            enqueued = frontier.count()
            counted += enqueued
            if not enqueued:
                break
        row = [(session, site_id, "completed", depth, most, tally["crawled"], tally["skipped"], tally["failed"], started)]
        done = self.spark.createDataFrame(row, "id bigint, site_id bigint, status string, max_depth int, max_pages int, pages_crawled int, pages_skipped int, pages_failed int, started_at timestamp").withColumn("finished_at", F.current_timestamp())
        self.store.append("crawl_sessions", done, TABLES["crawl_sessions"])
        return session

    def _rules(self, urls: DataFrame, site) -> DataFrame:
        """origin, robots_txt of urls: asked for once for each origin and stored; the site's row keeps the first text."""
        origins = urls.select(F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1).alias("origin")).distinct()
        new = origins.join(self.table("robots"), "origin", "left_anti")
        if not new.isEmpty():
            self.store.append("robots", robots_rules(new, self.fetcher), TABLES["robots"])
            own = self.table("robots").where((F.col("origin") == F.regexp_extract(F.lit(site.base_url), r"^([a-z]+://[^/?#]+)", 1)) & (F.col("robots_txt") != "")).first()
            if own is not None and site.robots_txt is None:
                text = F.when((F.col("id") == site.id) & F.col("robots_txt").isNull(), F.lit(own.robots_txt)).otherwise(F.col("robots_txt"))
                self.change("sites", self.table("sites").where(F.col("id") == site.id).withColumn("robots_txt", text))
        return self.table("robots")

    def _attempt(self, jobs: DataFrame, site, session: int, level: int, attempt: int) -> DataFrame:
        """One try of jobs (url, robots_delay): url, http_status, html, final_url, domain, now_ms, in_cooldown.

        A domain's requests take slots spaced by its delay, after the ones before them; a retry also waits out its backoff. Where a
        domain's origins ask for different delays, the longest holds for all.
        A request that meets a cooldown isn't made.
        """
        before = self.table("fetches").where(F.col("session_id") == session)
        start = F.unix_millis(F.current_timestamp())
        wait = F.lit(0) if attempt == 1 else X.backoff_ceiling(F.lit(attempt - 1)) * (1 + F.rand()) / 2
        delay = X.effective_delay(F.lit(site.crawl_delay_ms or 0), F.col("robots_delay"))
        last = before.groupBy("domain").agg(F.max("now_ms").alias("last"))
        arrivals = jobs.withColumn("domain", X.host(F.col("url"))).join(last, "domain", "left").withColumn("delay", F.max((delay * 1000).cast("bigint")).over(Window.partitionBy("domain")))
        arrivals = arrivals.withColumn("now_us", (F.greatest(start + wait, F.coalesce(F.col("last") + F.col("delay") / 1000, F.lit(0))) * 1000).cast("bigint")).withColumn("seq", F.col("url"))
        plan = f"{self.store.root}/rounds/{session}-{level}-{attempt}"
        slots = C.rate_slots(arrivals).select("url", "domain", (F.col("slot") / 1000).cast("bigint").alias("now_ms"), F.lit(site.render_mode or "static").alias("render_mode"))
        slots.withColumn("wait_ms", F.col("now_ms") - start).write.mode("overwrite").parquet(plan + "-slots")
        urls = self.spark.read.parquet(plan + "-slots")
        got = by_mode(urls, self.fetcher, self.js_fetcher)
        got.select("url", "domain", "now_ms", F.col("status").alias("http_status"), "html", "final_url").write.mode("overwrite").parquet(plan)  # a fetch isn't repeated
        got = self.spark.read.schema("url string, domain string, now_ms bigint, http_status int, html string, final_url string").parquet(plan)
        seen = before.select("domain", "now_ms", key("url").alias("seq"), (F.col("status").isin(403, 429) & ~F.col("in_cooldown")).alias("blocked"))
        events = seen.unionByName(got.select("domain", "now_ms", key("url").alias("seq"), F.col("http_status").isin(403, 429).alias("blocked")))
        cold = C.cooldown(events).select("seq", "now_ms", F.col("in_cooldown").alias("cold"))
        done = got.withColumn("seq", key("url")).join(cold, ["seq", "now_ms"]).drop("seq").withColumn("in_cooldown", F.col("cold") | (F.col("http_status") == -1)).drop("cold")
        self.store.append("fetches", done.select(F.lit(session).alias("session_id"), "url", "domain", F.lit(attempt).alias("attempt"), "now_ms", F.col("http_status").alias("status"), "in_cooldown"), TABLES["fetches"])
        return done

    def _round(self, frontier: DataFrame, site, session: int, level: int, robots: DataFrame | None, tally: dict) -> DataFrame | None:
        """One level of the crawl: robots, slots, fetch and retries, versions, links. Returns the links of changed pages, or None."""
        urls = with_robots(frontier, robots if robots is not None else self._rules(frontier, site))
        path = f"{self.store.root}/rounds/{session}-{level}"
        urls.select("url", "robots_ok", "robots_delay").write.mode("overwrite").parquet(path + "-robots")
        urls = self.spark.read.parquet(path + "-robots")
        yes, jobs, final, dead = F.lit(True), urls.where("robots_ok").select("url", "robots_delay"), [], None
        for attempt in range(1, C.ATTEMPTS + 1):
            got = self._attempt(jobs, site, session, level, attempt).withColumn("fate", C.outcome(yes, yes, yes, F.col("in_cooldown"), F.col("http_status"), yes))
            final.append(got.where("fate <> 'retry'"))
            again = got.where("fate = 'retry'")
            if again.isEmpty():
                break
            jobs, dead = urls.join(again.select("url"), "url", "left_semi").select("url", "robots_delay"), again if attempt == C.ATTEMPTS else None
        got = final[0]
        for more in final[1:]:
            got = got.unionByName(more)
        got = got.join(self.table("pages").select("url", F.col("id").alias("page_id")), "url")
        got = got.withColumn("content_hash", F.when(F.col("http_status") < 400, X.sha(F.coalesce("html", F.lit("")))))
        versions = self.table("page_versions")
        latest = G.latest_versions(versions, ["content_hash"]).withColumnRenamed("page_id", "page")
        good = got.where("http_status < 400").select(F.col("page_id").alias("page"), F.lit(0).alias("fetched_at"), F.lit(0).alias("seq"), "content_hash")
        new = C.versions(good, latest).select(F.col("page").alias("page_id"), "version_no", "content_hash")
        new = new.join(got.select("page_id", F.col("html").alias("raw_html")), "page_id").withColumn("fetched_at", F.current_timestamp())
        new = self.with_ids("page_versions", new, "page_id", "version_no")
        self.store.append("page_versions", new, TABLES["page_versions"])
        changed = new.select("page_id").withColumn("changed", F.lit(True))
        log = got.join(changed, "page_id", "left").select("page_id", "url", "http_status", "html", "final_url", "content_hash", F.coalesce("changed", F.lit(False)).alias("changed"))
        log = log.withColumn("outcome", C.outcome(yes, yes, yes, F.lit(False), F.col("http_status"), F.col("changed")))
        refused = urls.where("not robots_ok").select("url", F.lit("skipped").alias("outcome"))
        log = log.unionByName(refused, allowMissingColumns=True).withColumn("session", F.lit(session))
        for r in C.session_counters(log).collect():  # one session
            tally["crawled"] += r.pages_crawled
            tally["skipped"] += r.pages_skipped
            tally["failed"] += r.pages_failed
        status = F.when(F.col("outcome").isin("failed", "skipped"), F.col("outcome")).otherwise("crawled")
        seen = log.select(F.col("url"), status.alias("new_status"), F.col("http_status").alias("new_http"), F.col("content_hash").alias("new_hash"))
        pages = self.table("pages").join(seen, "url")
        self.change("pages", pages.withColumn("status", F.coalesce("new_status", "status")).withColumn("http_status", F.coalesce("new_http", "http_status")).withColumn("content_hash", F.coalesce("new_hash", "content_hash")).withColumn("last_crawled_at", F.when(F.col("new_status").isNotNull(), F.current_timestamp()).otherwise(F.col("last_crawled_at"))))
        if dead is not None:  # every attempt was made
            error = F.when(F.col("in_cooldown"), F.format_string("%s is in cooldown", "domain")).otherwise(F.format_string("status %d", "http_status"))
            tried = dead.select(F.lit("scrape").alias("queue"), F.col("url").alias("job_id"), F.to_json(F.struct("url")).alias("payload"), error.alias("error_message"), F.lit(C.ATTEMPTS).alias("attempts_made"), F.current_timestamp().alias("failed_at"))
            letters = C.dead_letters(tried).withColumn("id", key("job_id", F.lit(session)))
            self.store.append("failed_jobs", letters, TABLES["failed_jobs"])
        return E.links(log.where("changed").select("page_id", F.col("final_url").alias("url"), "html")).withColumnRenamed("page_id", "parent")

    # ------------------------------------------------------------ process and index

    def process(self) -> None:
        """Page versions without a document become documents; rejects go to failed_jobs."""
        todo = self.table("page_versions").join(self.table("documents").select("page_version_id"), F.col("id") == F.col("page_version_id"), "left_anti")
        url = self.table("pages").select(F.col("id").alias("page_id"), "url")
        good, bad = E.documents(E.extract(todo.join(url, "page_id", "left").select(F.col("id").alias("page_version_id"), "url", "raw_html")))
        self.store.append("documents", self.with_ids("documents", good, "page_version_id"), TABLES["documents"])
        self.store.append("failed_jobs", bad.select(key("page_version_id").alias("id"), F.lit("process").alias("queue"), F.lit("invalid document").alias("error_message"), F.current_timestamp().alias("failed_at")), TABLES["failed_jobs"])

    def index(self) -> None:
        """Documents without chunks are chunked, embedded and posted."""
        todo = I.backfill(self.table("documents"), self.table("chunks"))
        made = I.chunk(todo.select(F.col("id").alias("document_id"), "title", "cleaned_text"), self.tokenizer)
        made = embed_column(self.with_ids("chunks", made, "document_id", "chunk_index"), "text", self.embedder)
        self.store.append("chunks", made, TABLES["chunks"])  # of documents that had none
        chunks = self.table("chunks")
        index = self.table("keyword_index")
        fresh = chunks.select(F.col("id").alias("chunk_id"), "text").join(index.select(F.explode("ids").alias("chunk_id")), "chunk_id", "left_anti")
        generation = (index.agg(F.max(F.shiftright("shard", 40))).first()[0] or 0) + 1
        self.store.append("keyword_index", K.build(I.terms(fresh, self.analyzer), generation), TABLES["keyword_index"])

    def compact(self) -> None:
        """Every table that has grown by parts becomes one snapshot; of those whose rows change only the buckets that parts touch are made anew."""
        for name, schema in TABLES.items():
            self.store.compact(name, schema, KEYS.get(name))

    # ------------------------------------------------------------ queries

    def list_sites(self) -> DataFrame:
        return G.site_page_counts(self.table("sites"), self.table("pages")).orderBy("id")

    def get_site(self, site_id) -> tuple:
        site_id = S.positive_id(site_id)
        return self.table("sites").where(F.col("id") == site_id).first(), G.recent_sessions(self.table("crawl_sessions"), self.table("sites"), 10, site_id)

    def list_crawls(self, site_id) -> DataFrame:
        return G.recent_sessions(self.table("crawl_sessions"), self.table("sites"), 50, S.positive_id(site_id))

    def list_pages(self, site_id=None, status=None, q=None, limit=None, offset=None) -> tuple[DataFrame, int]:
        limit, offset = S.page(limit, offset)
        S.choice(status, "status", S.PAGE_STATUS)
        rows = G.pages_where(self.table("pages"), site_id and S.positive_id(site_id, "siteId"), status, S.text(q, "q", 1, 500, False))
        return G.with_site(G.paginated(rows, limit, offset), self.table("sites")).orderBy(F.desc("id")), rows.count()

    def get_page(self, page_id) -> tuple:
        page_id = S.positive_id(page_id)
        versions = self.table("page_versions").where(F.col("page_id") == page_id).select("id", "version_no", "content_hash", "fetched_at", F.length("raw_html").alias("raw_length"))
        return self.table("pages").where(F.col("id") == page_id).first(), versions.orderBy(F.desc("version_no"))

    def get_raw(self, page_id, version=None) -> DataFrame:
        """The latest or the given version with its html and its document's id."""
        rows = self.table("page_versions").where(F.col("page_id") == S.positive_id(page_id))
        rows = rows.where(F.col("version_no") == S.positive_id(version, "version")) if version is not None else rows.orderBy(F.desc("version_no")).limit(1)
        docs = self.table("documents").select(F.col("id").alias("document_id"), "page_version_id")
        return rows.join(docs, rows.id == docs.page_version_id, "left").select(rows["*"], "document_id")

    def list_documents(self, site_id=None, content_type=None, q=None, limit=None, offset=None) -> tuple[DataFrame, int]:
        limit, offset = S.page(limit, offset)
        rows = G.documents_where(self.table("documents"), self.table("page_versions"), self.table("pages"), site_id and S.positive_id(site_id, "siteId"), S.text(content_type, "contentType", 1, 50, False), S.text(q, "q", 1, 500, False))
        return G.with_site(G.paginated(rows, limit, offset), self.table("sites")).orderBy(F.desc("id")), rows.select("id").distinct().count()

    def get_document(self, document_id) -> tuple:
        document_id = S.positive_id(document_id)
        chunks = self.table("chunks").where(F.col("document_id") == document_id)
        counts = chunks.agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded")).first()
        return self.table("documents").where(F.col("id") == document_id).first(), chunks.drop("embedding").orderBy("chunk_index"), counts

    def stats(self) -> dict:
        t = self.table
        jobs = t("failed_jobs").select("queue", F.lit("failed").alias("state"))
        return {"totals": G.totals(t("sites"), t("pages"), t("page_versions"), t("documents"), t("chunks"), t("failed_jobs")), "queues": G.queue_depths(jobs), "recent": G.recent_sessions(t("crawl_sessions"), t("sites"))}

    def _queries(self, texts: list[str]) -> DataFrame:
        rows = [(0, i, t, v) for i, (t, v) in enumerate(zip(texts, self.embedder.embed(texts)))]
        return self.spark.createDataFrame(rows, "group_id int, sub int, q string, vector array<float>")

    def _lexemes(self, queries: DataFrame) -> DataFrame | None:
        if self.analyzer == "simple":
            return None
        terms = queries.withColumn("terms", F.array_distinct(I.english(self.spark)("q")))
        return terms.select("query_id", F.explode("terms").alias("lexeme"), F.size("terms").alias("n"))

    def _resolved(self, hits: DataFrame) -> DataFrame:
        return R.resolve_hits(hits, self.table("chunks"), self.table("documents"), self.table("page_versions"), self.table("pages")).orderBy("rank")

    def search(self, q, mode=None, k=None) -> DataFrame:
        q, mode, k = S.search_request(q, mode, k)
        queries = self._queries([q]).withColumn("query_id", F.col("sub").cast("bigint"))
        chunks = self.table("chunks").select(F.col("id").alias("chunk_id"), "embedding")
        pool = k if mode != "hybrid" else max(k, R.POOL)
        semantic = R.vector_search(chunks, queries, pool) if mode != "keyword" else None
        keyword = R.keyword_search(self.table("keyword_index"), queries, pool, self._lexemes(queries)) if mode != "semantic" else None
        hits = semantic if keyword is None else keyword if semantic is None else R.rrf(semantic.withColumn("list", F.lit(0)).unionByName(keyword.withColumn("list", F.lit(1))), k)
        return self._resolved(hits)

    def ask(self, question, k=None, sub_queries=None) -> dict:
        """A cited answer; with sub-queries these alone are searched for."""
        question, k, subs = S.ask_request(question, k, sub_queries)
        if subs:
            chunks = self.table("chunks").select(F.col("id").alias("chunk_id"), "embedding")
            asked = self._queries(subs)
            lexemes = self._lexemes(asked.withColumn("query_id", F.struct("group_id", "sub")))
            hits = self._resolved(R.multi_search(chunks, self.table("keyword_index"), asked, k, lexemes))
        else:
            hits = self.search(question, "hybrid", k)
        out = A.answer(question, hits.collect(), self.generator)  # k rows
        return out | {"sources": len({c["url"] for c in out["citations"]})}
