"""Latent semantic vectors: a randomised singular value decomposition of the corpus' TF-IDF matrix, in Spark.

A text is a row of weights (1 + log tf) * idf over 2**BITS buckets of lexeme hashes, of length one. The decomposition needs products of the matrix'
transpose with itself and a thin matrix alone: every task computes them over its rows, an Arrow batch at a time, and sends one thin
matrix of its own, cut into blocks of buckets, whatever the number of its rows; these are added by block. The thin matrices (buckets x (dimensions
+ OVER)) come to the driver, which orthonormalises them: their size is set by the parameters. After POWER such rounds the leading
right singular vectors follow from a small eigenproblem. A vector is a text's row times them, of length one; each of
them has the sign that makes its largest component positive, so vectors are the same for every run and partitioning but for rounding.

Texts without a lexeme of the corpus have the zero vector, which no search finds; a null text has none.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.partition import spread
from ..functions.text import simple_tokens
from ..sources.staging import staged, unstage

BITS, DIMENSIONS, OVER, POWER = 15, 64, 16, 3
STEP = 1 << 11
DENSE, ROWS = 1 << 13, 512  # buckets of the most texts, which are multiplied as dense matrices of so many texts
KNOWN = 1 << 17  # words whose buckets a worker keeps
SLICES = 64  # blocks of buckets in which partial products are sent
WORD = re.compile(r"[^\W_]+")


def bucket_of(word: str, bits: int = BITS) -> int:
    return zlib.crc32(word.encode()) % (1 << bits)


class LatentEmbedder:
    """Embeds texts by a fitted basis: idf of each bucket, and buckets x dimensions."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray):
        self.idf, self.basis = idf.astype(np.float32), basis.astype(np.float32)
        self.bits, self.dimensions = int(math.log2(len(idf))), basis.shape[1]
        self.known: dict[str, int] = {}

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = WORD.findall((text or "").lower())
            if len(self.known) > KNOWN:
                self.known.clear()
            known = self.known
            buckets = np.array([known[w] if w in known else known.setdefault(w, bucket_of(w, self.bits)) for w in words], np.int64)
            at, tf = np.unique(buckets, return_counts=True)
            v = ((1 + np.log(tf)) * self.idf[at]) @ self.basis[at] if len(at) else np.zeros(self.dimensions)
            n = np.linalg.norm(v)
            out.append((v / n if n > 1e-12 else np.zeros(self.dimensions)).astype(np.float32).tolist())
        return out


def rows_of(chunks: DataFrame, bits: int = BITS) -> DataFrame:
    """chunk_id, buckets, tf: the distinct buckets of each text and their counts. chunks: chunk_id, text."""
    hashed = F.transform(simple_tokens(F.coalesce("text", F.lit(""))), lambda w: (F.crc32(w.cast("binary")) % (1 << bits)).cast("int"))

    def count(batches):
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(batch)), np.diff(at))
            pair, n = np.unique(doc.astype(np.int64) << bits | flat, return_counts=True)
            bounds = np.searchsorted(pair >> bits, np.arange(len(batch) + 1)).astype(np.int32)
            sides = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (pair & ((1 << bits) - 1), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], ["chunk_id", "buckets", "tf"])

    words = spread(chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "text")).select("chunk_id", hashed.alias("words"))
    return words.mapInArrow(count, "chunk_id bigint, buckets array<int>, tf array<int>")


def _weights(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of a batch (buckets, tf); each row has length one."""
    lists = batch.column(0)
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(batch)), sizes)
    bucket, tf = lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy()
    w = (1 + np.log(tf)) * idf[bucket]
    norm = np.sqrt(np.bincount(row, w * w, len(batch)))
    return row, bucket, w / np.maximum(norm, 1e-300)[row]


def _product(rows: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The matrix' transpose times the matrix times q."""
    spark, size, width = rows.sparkSession, len(idf), q.shape[1]
    shared = spark.sparkContext.broadcast((idf, q))
    step = -(-size // SLICES)

    def multiply(batches):
        idf, q = shared.value
        total, some = np.zeros((size, width)), False
        common = np.argsort(np.where(idf > 0, idf, np.inf), kind="stable")[:DENSE]
        column = np.full(size, -1)
        column[common] = np.arange(len(common))
        thin, sums = q[common].astype(np.float32), np.zeros((len(common), width))
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            row, bucket, w = _weights(batch, idf)
            if not len(row):
                continue
            some = True
            dense = np.zeros((len(batch), len(common)), np.float32)
            rare = column[bucket] < 0
            dense[row[~rare], column[bucket[~rare]]] = w[~rare]
            row, bucket, w = row[rare], bucket[rare], w[rare]
            y = (dense @ thin).astype(np.float64)
            for at in range(0, len(row), STEP):  # of so many weights at a time, which stay in the processor's cache
                part = slice(at, at + STEP)
                own, first = np.unique(row[part], return_index=True)
                y[own] += np.add.reduceat(w[part, None] * q[bucket[part]], first, axis=0)
            sums += dense.T @ y.astype(np.float32)
            order = np.argsort(bucket, kind="stable")
            row, bucket, w = row[order], bucket[order], w[order]
            for at in range(0, len(row), STEP):
                part = slice(at, at + STEP)
                own, first = np.unique(bucket[part], return_index=True)
                total[own] += np.add.reduceat(w[part, None] * y[row[part]], first, axis=0)
        total[common] += sums
        if some:
            for i in range(SLICES):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i * step : (i + 1) * step].tobytes()], pa.binary())], ["slice", "sums"])

    def add(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(x.as_py()) for x in table["sums"])
        return pa.table({"slice": table["slice"][:1], "sums": pa.array([out.tobytes()], pa.binary())})

    parts = rows.select("buckets", "tf").mapInArrow(multiply, "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary").collect()  # buckets x width numbers
    out = np.zeros((size, width))
    for r in parts:
        out[r.slice * step : (r.slice + 1) * step] = np.frombuffer(r.sums).reshape(-1, width)
    return out


def fit(chunks: DataFrame, dimensions: int = DIMENSIONS, bits: int = BITS, power: int = POWER, seed: int = 5) -> LatentEmbedder:
    """The embedder of a corpus: chunk_id, text."""
    rows = staged(rows_of(chunks, bits), "weights")
    size = 1 << bits
    n = rows.count()
    idf = np.zeros(size)
    for r in rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect():  # one row a bucket
        idf[r.b] = math.log((1 + n) / (1 + r.n)) + 1
    q = np.random.default_rng(seed).standard_normal((size, min(dimensions + OVER, size)))
    for _ in range(power):
        q, _ = np.linalg.qr(_product(rows, idf, q))
    value, vector = np.linalg.eigh((lambda t: (t + t.T) / 2)(q.T @ _product(rows, idf, q)))
    unstage(rows)
    basis = q @ vector[:, np.argsort(-value)[:dimensions]]
    largest = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
    return LatentEmbedder(idf, basis * np.where(largest < 0, -1.0, 1.0))
