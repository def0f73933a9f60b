"""Listing, detail and statistics queries over the stage tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percentage


def every(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def contains(column: str, q: str) -> Column:
    """Case-insensitive; percent signs and underscores in q are wildcards."""
    return F.col(column).ilike(f"%{q}%")


def pages_where(pages: DataFrame, site_id: int | None = None, status: str | None = None, q: str | None = None) -> DataFrame:
    return pages.where(every([c for c in (F.col("site_id") == site_id if site_id is not None else None, F.col("status") == status if status else None, contains("url", q) if q else None) if c is not None]))


def with_site(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Left join: a row without a site stays."""
    return rows.join(sites.select(F.col("id").alias("site_id"), F.col("name").alias("site_name"), F.col("base_url").alias("site_url")), "site_id", "left")


def paginated(rows: DataFrame, limit: int, offset: int, key: str = "id") -> DataFrame:
    """Newest first."""
    return rows.orderBy(F.desc(key)).offset(offset).limit(limit)


def documents_where(documents: DataFrame, versions: DataFrame, pages: DataFrame, site_id: int | None = None, content_type: str | None = None, q: str | None = None) -> DataFrame:
    """Documents with their version and page, filtered; excerpts and lengths in place of texts."""
    d = documents.where(every([c for c in (F.col("content_type") == content_type if content_type else None, contains("title", q) | contains("cleaned_text", q) if q else None) if c is not None]))
    v = versions.select(F.col("id").alias("page_version_id"), "page_id", "version_no")
    p = pages.select(F.col("id").alias("page_id"), "site_id", "url")
    p = p.where(F.col("site_id") == site_id) if site_id is not None else p
    return d.join(v, "page_version_id").join(p, "page_id").withColumn("excerpt", F.left("cleaned_text", F.lit(300))).withColumn("length", F.length("cleaned_text")).drop("cleaned_text")


def site_page_counts(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Every site with its pages and crawled pages, zero if it has none; robots text only as a flag."""
    n = pages.groupBy("site_id").agg(F.count("*").alias("n_pages"), F.count(F.when(F.col("status") == "crawled", 1)).alias("n_crawled"))
    out = sites.join(n.withColumnRenamed("site_id", "id"), "id", "left").fillna(0, ["n_pages", "n_crawled"])
    return out.withColumn("robots_txt_cached", F.col("robots_txt").isNotNull()).drop("robots_txt") if "robots_txt" in sites.columns else out


def latest_versions(versions: DataFrame, keep: list[str]) -> DataFrame:
    """The version with the highest number of each page."""
    return versions.groupBy("page_id").agg(F.max_by(F.struct("version_no", *keep), "version_no").alias("v")).select("page_id", "v.*")


def chunk_progress(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, n_chunks, n_embedded and percent of every document."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded"))
    out = documents.select(F.col("id").alias("document_id")).join(n, "document_id", "left").fillna(0, ["n_chunks", "n_embedded"])
    return out.withColumn("percent", percentage(F.col("n_embedded"), F.col("n_chunks")))


def totals(sites: DataFrame, pages: DataFrame, versions: DataFrame, documents: DataFrame, chunks: DataFrame, failed_jobs: DataFrame) -> DataFrame:
    """All counts in one row: one aggregate for each table."""
    status = lambda s: F.count(F.when(F.col("status") == s, 1))
    one = lambda t, name: t.agg(F.count("*").alias(name))
    rows = [
        one(sites, "sites"),
        pages.agg(F.count("*").alias("pages"), status("crawled").alias("pages_crawled"), status("failed").alias("pages_failed"), status("skipped").alias("pages_skipped"), status("pending").alias("pages_pending")),
        one(versions, "page_versions"),
        one(documents, "documents"),
        chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("chunks_embedded")),
        one(failed_jobs, "dead_letter_jobs"),
    ]
    return reduce(lambda a, b: a.crossJoin(b), rows)  # each side is one row


def queue_depths(jobs: DataFrame, states=("waiting", "active", "completed", "failed", "delayed")) -> DataFrame:
    return jobs.groupBy("queue").pivot("state", list(states)).count().fillna(0)


def recent_sessions(sessions: DataFrame, sites: DataFrame, limit: int = 5, site_id: int | None = None) -> DataFrame:
    own = sessions if site_id is None else sessions.where(F.col("site_id") == site_id)
    return with_site(own.orderBy(F.desc("id")).limit(limit), sites).orderBy(F.desc("id"))


def site_by(sites: DataFrame, site: int | str | None = None) -> DataFrame:
    """The site with an id or a base address that contains a text; the first one without either."""
    if isinstance(site, int):
        sites = sites.where(F.col("id") == site)
    elif site:
        sites = sites.where(contains("base_url", site))
    return sites.orderBy("id").limit(1)
