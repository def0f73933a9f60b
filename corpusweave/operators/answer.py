"""Grounded answers: context, citations and the generator interface."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet

# Fixed value: the answer without sources.
NO_ANSWER = "I don't have enough information in the indexed sources to answer that."
#: What a generator is told before the sources.
INSTRUCTION = "You are given numbered excerpts of web pages. Write a short answer that rests on nothing but these excerpts, and put the number of the excerpt, as [n], behind each statement. Where they don't settle the question, say so."


class ExtractiveGenerator:
    """Offline stand-in: the sentence of each source that shares most words with the question, cited."""

    def generate(self, question: str, context: str) -> str:
        asked = set(re.findall(r"\w+", question.lower()))
        best = []
        for block in context.split("\n\n["):
            m = re.match(r"\[?(\d+)\] Source: [^\n]*\n(.*)", block, re.S)
            if m:
                sentences = re.findall(r"[^.!?]+[.!?]*", m[2])
                if sentences:
                    s = max(sentences, key=lambda x: len(asked & set(re.findall(r"\w+", x.lower()))))
                    best.append((len(asked & set(re.findall(r"\w+", s.lower()))), -int(m[1]), s.strip()))
        found = [f"{s} [{-i}]" for n, i, s in sorted(best, reverse=True)[:3] if n]
        return " ".join(found) or NO_ANSWER


def context(hits: DataFrame) -> DataFrame:
    """query_id, context: numbered sources in rank order. hits: query_id, rank, url, text."""
    block = F.transform(F.array_sort(F.collect_list(F.struct("rank", "url", "text"))), lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Source: "), s["url"], F.lit("\n"), s["text"]))
    return hits.groupBy("query_id").agg(F.array_join(block, "\n\n").alias("context"))  # k hits for each query


def citations(hits: DataFrame) -> DataFrame:
    """query_id, marker, url, title, snippet: every hit is cited."""
    return hits.select("query_id", F.col("rank").cast("bigint").alias("marker"), "url", "title", snippet(F.col("text")).alias("snippet"))


def cited_markers(text: Column) -> Column:
    """Markers like [3] in an answer, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint"))


def answer(question: str, hits: list, generator=None) -> dict:
    """hits: rows with url, title, text in rank order."""
    if not hits:
        return {"answer": NO_ANSWER, "citations": [], "mode": "hybrid"}
    text = "\n\n".join(f"[{i}] Source: {h.url}\n{h.text}" for i, h in enumerate(hits, 1))
    cited = [{"marker": i, "url": h.url, "title": h.title, "snippet": h.text[:160] + "…" if len(h.text) > 160 else h.text} for i, h in enumerate(hits, 1)]
    return {"answer": (generator or ExtractiveGenerator()).generate(question, text).strip(), "citations": cited, "mode": "hybrid"}
