"""Embedder interface; the offline default hashes words into a fixed number of signed buckets."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .partition import small_batches

DIMENSIONS, BATCH = 1536, 100


class HashingEmbedder:
    """Deterministic unit vectors: words and word pairs, signed by their hash. The same text has the same vector everywhere."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = re.findall(r"\w+", (text or "").lower())
            terms = [*words, *map(" ".join, zip(words, words[1:]))]
            h = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in terms), "<u8")
            place, sign = (h % np.uint64(self.dimensions)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
            v = np.bincount(place, sign, self.dimensions)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


def embed_column(df: DataFrame, text: str, embedder=None, into: str = "embedding") -> DataFrame:
    """Adds vectors, in batches as a remote embedder takes them; a null text has none."""
    embedder = embedder or HashingEmbedder()
    small_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        some = [i for i, t in enumerate(texts) if t is not None]
        for k in range(0, len(some), BATCH):
            part = some[k : k + BATCH]
            for i, v in zip(part, embedder.embed([texts.iloc[i] for i in part])):
                out[i] = v
        return pd.Series(out)

    return df.withColumn(into, run(text))
