"""Structured Streaming forms of the stages: incremental processing, and the domain cooldown as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.embed import embed_column
from ..operators import extract as E
from ..operators import index as I
from ..operators import keyword_index as K
from ..operators.crawl import cooldown_fold
from ..sources.staging import staged, unstage

PAGES = "page_version_id bigint, url string, raw_html string"
TEXTS = "document_id bigint, title string, cleaned_text string"
BLOCK_EVENTS = "domain string, now_ms bigint, seq bigint, blocked boolean"


def process_pages(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """New page versions become documents, each micro-batch once: its output directory is named by the batch. What breaks the shape lies
    beside the documents, in ``<target>-rejects``."""

    def batch(rows: DataFrame, number: int) -> None:
        extracted = staged(E.extract(rows), "extracted")  # parsed once for both
        done, rejected = E.documents(extracted)
        done.write.mode("overwrite").parquet(f"{target}/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{target}-rejects/batch={number}")
        unstage(extracted)

    return spark.readStream.schema(PAGES).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_documents(spark: SparkSession, source: str, target: str, checkpoint: str, tokenizer=None, embedder=None, analyzer: str = "english") -> StreamingQuery:
    """New documents become chunks with vectors (``<target>/chunks``) and a part of the keyword index (``<target>/keyword_index``), each
    micro-batch once; shards of a batch have numbers of their own, so the parts together are one index."""

    def batch(rows: DataFrame, number: int) -> None:
        made = I.chunk(rows, tokenizer).withColumn("id", F.xxhash64("document_id", "chunk_index").bitwiseAND(F.lit((1 << 63) - 1)))
        made = staged(embed_column(made, "text", embedder), "chunks")  # embedded once for both
        made.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        terms = I.terms(made.select(F.col("id").alias("chunk_id"), "text"), analyzer)
        K.build(terms, number + 1).write.mode("overwrite").parquet(f"{target}/keyword_index/batch={number}")
        unstage(made)

    return spark.readStream.schema(TEXTS).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Cooldown(StatefulProcessor):
    """Blocks, window end and cooldown end of a domain, as in the batch fold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "blocks long, window long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = tuple(self.state.get()) if self.state.exists() else (0, 0, 0)
        for pdf in rows:
            pdf = pdf.sort_values(["now_ms", "seq"])
            cold, state = cooldown_fold(pdf.now_ms.tolist(), pdf.blocked.tolist(), state)
            yield pdf.assign(in_cooldown=cold)[["domain", "now_ms", "seq", "blocked", "in_cooldown"]]
        self.state.update(state)

    def close(self) -> None:
        pass


def cooldown_stream(events: DataFrame) -> DataFrame:
    """Adds in_cooldown to a stream of crawl answers (domain, now_ms, seq, blocked), in order of arrival."""
    return events.groupBy("domain").transformWithStateInPandas(statefulProcessor=Cooldown(), outputStructType=BLOCK_EVENTS + ", in_cooldown boolean", outputMode="append", timeMode="none")
