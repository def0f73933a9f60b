"""Processing: raw pages to documents, once at ingest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.partition import small_batches, spread
from ..functions.text import content_type
from ..schemas import STRUCTURED, invalid_document


def extract(pages: DataFrame) -> DataFrame:
    """page_version_id, title, text, used_readability, structured of pages (page_version_id, url, raw_html); url null counts as ''."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, url, html in zip(pdf.page_version_id, pdf.url, pdf.raw_html):
                root = H.parse(html)
                title, text, used = H.extract(html, root)
                rows.append((i, title, text, used, {"tables": H.tables(html, root), "documentLinks": H.document_links(html, url, root)}))
            yield pd.DataFrame(rows, columns=["page_version_id", "title", "text", "used_readability", "structured"])

    small_batches(pages.sparkSession)
    rows = pages.select("page_version_id", F.coalesce("url", F.lit("")).alias("url"), "raw_html")
    return spread(rows).mapInPandas(run, f"page_version_id bigint, title string, text string, used_readability boolean, structured {STRUCTURED}")


def links(pages: DataFrame) -> DataFrame:
    """page_id, place, url: links of pages (page_id, url, html) to their own host, each once, in document order."""

    def run(batches):
        for pdf in batches:
            rows = [(i, k, x) for i, url, html in zip(pdf.page_id, pdf.url, pdf.html) for k, x in enumerate(H.same_host_links(html, url))]
            yield pd.DataFrame(rows, columns=["page_id", "place", "url"])

    small_batches(pages.sparkSession)
    return spread(pages.select("page_id", "url", "html")).mapInPandas(run, "page_id bigint, place int, url string")


def outcome(extracted: DataFrame) -> DataFrame:
    """Adds content_type and outcome: processed, or skipped if there is no text, no table and no document link."""
    nothing = (F.coalesce(F.col("text"), F.lit("")) == "") & (F.size("structured.tables") == 0) & (F.size("structured.documentLinks") == 0)
    kind = content_type(F.col("text"), F.size("structured.tables"), F.col("used_readability"))
    return extracted.withColumn("content_type", kind).withColumn("outcome", F.when(nothing, "skipped").otherwise("processed"))


def documents(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): the normalized rows that are worth storing, and those that break the shape."""
    rows = outcome(extracted).where("outcome = 'processed'").select("page_version_id", "title", F.col("text").alias("cleaned_text"), F.col("structured").alias("structured_data"), "content_type")
    bad = invalid_document()
    return rows.where(~bad), rows.where(bad)
