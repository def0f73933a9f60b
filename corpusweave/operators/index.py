"""Indexing: chunks, postings, idempotent sinks and backfill."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunk import chunk_document, default_tokenizer
from ..functions.partition import small_batches
from ..functions.text import simple_tokens


def chunk(documents: DataFrame, tokenizer=None, compat: bool = True) -> DataFrame:
    """document_id, chunk_index, heading_path, text, token_count of documents (document_id, title, cleaned_text). Tokens are those of a public
    BPE vocabulary, if none is given."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        for pdf in batches:
            rows = [(d, i, x.heading_path, x.text, x.token_count) for d, title, text in zip(pdf.document_id, pdf.title, pdf.cleaned_text) for i, x in enumerate(chunk_document(text, title, tokenizer, compat=compat))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "heading_path", "text", "token_count"])

    small_batches(documents.sparkSession)
    return documents.select("document_id", "title", "cleaned_text").mapInPandas(run, "document_id bigint, chunk_index int, heading_path string, text string, token_count int")


def postings(chunks: DataFrame, analyzer: str = "simple") -> DataFrame:
    """chunk_id, lexeme, tf of chunks (chunk_id, text), by the simple or the english analyzer."""
    return terms(chunks, analyzer).select("chunk_id", F.explode("terms").alias("lexeme")).groupBy("chunk_id", "lexeme").agg(F.count("*").alias("tf"))


def terms(chunks: DataFrame, analyzer: str = "simple") -> DataFrame:
    """chunk_id, terms: the lexemes of chunks (chunk_id, text) in order; what the keyword index is built from."""
    return chunks.select("chunk_id", (simple_tokens(F.col("text")) if analyzer == "simple" else english(chunks.sparkSession)("text")).alias("terms"))


def english(spark):
    """Arrow UDF of the english analyzer, with Spark's own stop list."""
    from pyspark.ml.feature import StopWordsRemover

    from ..functions.analyze import english_tokens

    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: english_tokens(t, stop) if t is not None else None)

    return run


def backfill(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without a single chunk, by id."""
    return documents.join(chunks.select("document_id").distinct(), documents.id == F.col("document_id"), "left_anti").orderBy("id")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The next snapshot: rows of new replace rows of old with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent re-index: all chunks of the documents in new are replaced."""
    return upsert(old, new, "document_id")


def find_or_create(known: DataFrame, found: DataFrame, key: str = "url") -> DataFrame:
    """Rows of found with keys that aren't known yet, one for each key."""
    return found.join(known.select(key), key, "left_anti").dropDuplicates([key])
