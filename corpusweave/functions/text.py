"""Column expressions on text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII and Unicode white space, as browsers see it (Java syntax).
SPACES = r"[\s\u000B   -     　﻿]+"
#: (?![\s\S]) is the very end in Java and in Python, where $ also stands before a last line end.
SENTENCE = r"""[^.!?]+[.!?]+["')\]]*\s*|[^.!?]+(?![\s\S])"""
BLANKS = " \t\n\r\x0b\x0c"
WORD = r"[^\p{L}\p{N}]+"
# File extensions that count as documents.
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "tsv", "rtf", "odt", "ods", "odp", "txt", "json", "xml", "zip")


def normalize_whitespace(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACES, " "))


def clean_title(col: Column) -> Column:
    return F.nullif(normalize_whitespace(col), F.lit(""))


def sentences(col: Column) -> Column:
    """Trimmed sentences; the text itself if nothing matches."""
    found = F.filter(F.transform(F.regexp_extract_all(col, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s, F.lit(BLANKS))), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(col))


def simple_tokens(col: Column) -> Column:
    """The simple analyzer: lower case, split at what is neither letter nor digit."""
    return F.filter(F.split(F.lower(col), WORD), lambda t: t != "")


def snippet(col: Column, size: int = 160) -> Column:
    return F.when(F.length(col) > size, F.concat(F.left(col, F.lit(size)), F.lit("…"))).otherwise(col)


def host(col: Column) -> Column:
    """Host with a non-default port; the string itself if it can't be parsed."""
    authority = F.lower(F.regexp_replace(F.try_parse_url(col, F.lit("AUTHORITY")), "^[^@]*@", ""))
    scheme = F.lower(F.try_parse_url(col, F.lit("PROTOCOL")))
    bare = F.when(scheme == "https", F.regexp_replace(authority, ":443$", "")).when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(authority)
    return F.coalesce(F.nullif(bare, F.lit("")), col)


def extension(path: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)), F.lit(""))


def content_type(text: Column, n_tables: Column, readable: Column) -> Column:
    return F.when((n_tables > 0) & (F.length(text) >= 500), "mixed").when(n_tables > 0, "table").when(~readable & (F.length(text) < 500), "listing").otherwise("article")


def sha(col: Column) -> Column:
    return F.sha2(col, 256)


def backoff_ceiling(attempt: Column, base: int = 1000, most: int = 30000) -> Column:
    """Twice the least delay before the attempt; a delay is drawn between half of it and it."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most)))


def backoff(attempt: Column, seed: int | None = None) -> Column:
    c = backoff_ceiling(attempt)
    return F.round(c / 2 + F.rand(seed) * c / 2).cast("bigint")


def effective_delay(site_ms: Column, robots_seconds: Column) -> Column:
    return F.greatest(site_ms.cast("double"), F.coalesce(robots_seconds, F.lit(0.0)) * 1000)


def transient(status: Column) -> Column:
    """Statuses that are tried again."""
    return (status == 429) | ((status >= 500) & (status <= 599))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100)).otherwise(0.0)
