"""Table schemas, allowed values and request validators."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TABLE = T.StructType([T.StructField("caption", T.StringType()), T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])
LINK = T.StructType([T.StructField(x, T.StringType()) for x in ("url", "text", "type")])
KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType()), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()), "array<bigint>": T.ArrayType(T.LongType()), "structured": T.StructType([T.StructField("tables", T.ArrayType(TABLE)), T.StructField("documentLinks", T.ArrayType(LINK))])}


def ddl(text: str) -> T.StructType:
    """A flat schema from "name kind, ..."; needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in text.split(","))])


STAMPS = ", created_at timestamp, updated_at timestamp"
STRUCTURED = "struct<tables:array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>,documentLinks:array<struct<url:string,text:string,type:string>>>"
SITES = ddl("id bigint, name string, base_url string, robots_txt string, crawl_delay_ms int, allowed boolean, render_mode string, max_depth int, max_pages int" + STAMPS)
PAGES = ddl("id bigint, site_id bigint, url string, status string, content_hash string, last_crawled_at timestamp, http_status int" + STAMPS)
PAGE_VERSIONS = ddl("id bigint, page_id bigint, version_no int, raw_html string, content_hash string, fetched_at timestamp" + STAMPS)
DOCUMENTS = ddl("id bigint, page_version_id bigint, title string, cleaned_text string, structured_data structured, content_type string" + STAMPS)
CHUNKS = ddl("id bigint, document_id bigint, chunk_index int, heading_path string, text string, token_count int, embedding vector" + STAMPS)
FAILED_JOBS = ddl("id bigint, queue string, job_id string, payload string, error_message string, error_stack string, attempts_made int, failed_at timestamp" + STAMPS)
CRAWL_SESSIONS = ddl("id bigint, site_id bigint, status string, max_depth int, max_pages int, pages_crawled int, pages_skipped int, pages_failed int, started_at timestamp, finished_at timestamp" + STAMPS)

PAGE_STATUS = ("pending", "crawled", "failed", "skipped")
SESSION_STATUS = ("running", "completed", "failed")
RENDER_MODES = ("static", "js")
CONTENT_TYPES = ("article", "listing", "table", "mixed")
MODES = ("keyword", "semantic", "hybrid")

# The seed sites.
SEED_SITES = [
    (1, "Books to Scrape", "https://books.toscrape.com/", 500, "static", 2, 50),
    (2, "Quotes to Scrape (JS)", "https://quotes.toscrape.com/js/", 500, "js", 2, 50),
    (3, "Scrape This Site (real static)", "https://www.scrapethissite.com/pages/", 1000, "static", 2, 30),
]


def seed_sites(spark) -> DataFrame:
    rows = [(i, name, url, None, delay, True, mode, depth, pages) for i, name, url, delay, mode, depth, pages in SEED_SITES]
    return spark.createDataFrame(rows, "id bigint, name string, base_url string, robots_txt string, crawl_delay_ms int, allowed boolean, render_mode string, max_depth int, max_pages int")


# ---------------------------------------------------------------- request validation: out of range is an error, not a clamp


def integer(value: Any, name: str, low: int, high: int | None = None, default: int | None = None) -> int | None:
    """A whole number, numeric strings included."""
    if value is None:
        return default
    number: int | None = None
    if isinstance(value, str) and value.strip().lstrip("+-").isdecimal():
        number = int(value)
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf") and value == int(value):
        number = int(value)
    if number is None or number < low or (high is not None and number > high):
        raise ValueError(f"{name} must be a whole number from {low}" + (f" to {high}" if high is not None else ""))
    return number


def text(value: Any, name: str, low: int, high: int, required: bool = True) -> str | None:
    """A trimmed string of low to high characters."""
    if value is None and not required:
        return None
    value = value.strip() if isinstance(value, str) else ""
    if not low <= len(value) <= high:
        raise ValueError(f"{name} must have {low} to {high} characters")
    return value


def choice(value: Any, name: str, allowed: tuple[str, ...], default: str | None = None) -> str | None:
    if value is None:
        return default
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value


def positive_id(value: Any, name: str = "id") -> int:
    if value is None:
        raise ValueError(f"{name} is required")
    return integer(value, name, 1)


def page(limit: Any = None, offset: Any = None) -> tuple[int, int]:
    return integer(limit, "limit", 1, 100, 20), integer(offset, "offset", 0, None, 0)


def search_request(q: Any, mode: Any = None, k: Any = None) -> tuple[str, str, int]:
    return text(q, "q", 1, 1000), choice(mode, "mode", MODES, "hybrid"), integer(k, "k", 1, 50, 5)


def ask_request(question: Any, k: Any = None, sub_queries: list[str] | None = None) -> tuple[str, int, list[str] | None]:
    question, k = text(question, "question", 3, 1000), integer(k, "k", 1, 20, 5)
    if sub_queries is not None:
        if not 1 <= len(sub_queries) <= 5:
            raise ValueError("subQueries must have 1 to 5 items")
        sub_queries = [text(x, "subQueries", 1, 500) for x in sub_queries]
        k = max(k, 2 * len(sub_queries))
    return question, k, sub_queries


def crawl_request(max_depth: Any = None, max_pages: Any = None) -> tuple[int | None, int | None]:
    return integer(max_depth, "maxDepth", 0, 10), integer(max_pages, "maxPages", 1, 5000)


def invalid_job(queue: str) -> F.Column:
    """Whether a row breaks its queue's payload shape: scrape (siteId, url, depth, sessionId), process (pageVersionId), index (documentId)."""
    wrong = lambda col: F.col(col).isNull() | (F.col(col) <= 0)
    if queue == "scrape":
        url = F.coalesce(F.col("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\s]+"), F.lit(False))
        return wrong("siteId") | ~url | F.coalesce(F.col("depth") < 0, F.lit(False)) | F.coalesce(F.col("sessionId") <= 0, F.lit(False))
    return wrong({"process": "pageVersionId", "index": "documentId"}[queue])


def invalid_document() -> F.Column:
    """Whether a normalized document breaks its shape."""
    return F.col("page_version_id").isNull() | (F.col("page_version_id") <= 0) | F.col("cleaned_text").isNull() | ~F.coalesce(F.col("content_type").isin(*CONTENT_TYPES), F.lit(False))
