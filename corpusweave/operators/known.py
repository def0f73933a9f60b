"""Which addresses are known already: blocked Bloom filters before the exact join.

Keys are dealt to SHARDS by a hash. A shard's filter is a run of blocks of 512 bits; a key sets PROBES bits of one block, so a
look-up touches 64 bytes. Every extension writes filters of its own keys alone, sized by their number; a look-up asks all of a shard's
filters, and where there are more than MOST_SEGMENTS extensions, they are made anew from the table. What no filter has is new for
certain; only the rest is compared with the table: few by a pushed-down list, which skips row groups, more by an anti-join.
A filter that's too old misses keys, so keys are put in before their rows are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import hadoop_path, staged

SHARDS, BITS, PROBES, BLOCK = 256, 14, 7, 512
MOST_SEGMENTS = 32
#: So many addresses are compared by a list.
LISTED = 1000
FILTERS = "segment bigint, shard int, blocks int, bits binary"


def _hashed(urls: DataFrame) -> DataFrame:
    h = F.xxhash64("url", F.lit(1))
    return urls.select("url", F.pmod(F.xxhash64("url"), F.lit(SHARDS)).cast("int").alias("shard"), h.alias("h1"), F.xxhash64("url", F.lit(2)).alias("h2"))


def _bits(h1: np.ndarray, h2: np.ndarray, blocks: int) -> np.ndarray:
    """Places of each key's bits: keys x PROBES."""
    block = (h1.view(np.uint64) >> np.uint64(16)) % np.uint64(blocks)
    inside = (h2.view(np.uint64)[:, None] >> (np.arange(PROBES, dtype=np.uint64) * np.uint64(9))) & np.uint64(BLOCK - 1)
    return (block[:, None] * np.uint64(BLOCK) + inside).astype(np.int64)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


class KnownFilter:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _segments(self) -> list[int]:
        fs, p = hadoop_path(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(hadoop_path(self.spark, f"{self.path}/{n}/_SUCCESS")[1]))

    def filters(self) -> DataFrame:
        segments = self._segments()
        if not segments:
            return self.spark.createDataFrame([], FILTERS)
        return self.spark.read.schema(FILTERS).parquet(*[f"{self.path}/{n}" for n in segments])

    def extend(self, urls: DataFrame) -> None:
        """Puts addresses in; those that are in already do no harm."""
        segment = max(self._segments(), default=0) + 1

        def make(group: pa.Table) -> pa.Table:
            n = group.num_rows
            blocks = max(1, -(-n * BITS // BLOCK))
            bits = np.zeros(blocks * BLOCK, bool)
            bits[_bits(_column(group, "h1"), _column(group, "h2"), blocks).ravel()] = True
            return pa.table({"segment": pa.array([segment], pa.int64()), "shard": pa.array([group["shard"][0].as_py()], pa.int32()), "blocks": pa.array([blocks], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        keys = _hashed(urls.select("url").where("url is not null")).drop("url")
        keys.groupBy("shard").applyInArrow(make, FILTERS).write.mode("overwrite").parquet(f"{self.path}/{segment}")

    def rebuild(self, urls: DataFrame) -> None:
        """One extension of all addresses, in place of those there are."""
        before = self._segments()
        self.extend(urls)
        for n in before:
            fs, p = hadoop_path(self.spark, f"{self.path}/{n}")
            fs.delete(p, True)

    def asked(self, urls: DataFrame) -> DataFrame:
        """url, maybe: False where the address is new for certain. urls: distinct."""

        def look(keys: pa.Table, filters: pa.Table) -> pa.Table:
            h1, h2 = _column(keys, "h1"), _column(keys, "h2")
            maybe = np.zeros(len(h1), bool)
            for blocks, bits in zip(filters["blocks"].to_pylist(), filters["bits"].to_pylist()):
                at, held = _bits(h1, h2, blocks), np.frombuffer(bits, np.uint8)
                maybe |= ((held[at >> 3] >> (at & 7)) & 1).astype(bool).all(axis=1)
            return pa.table({"url": keys["url"].combine_chunks().cast(pa.string()), "maybe": pa.array(maybe)})

        keys = _hashed(urls.select("url"))
        return keys.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(look, "url string, maybe boolean")

    def fresh(self, urls: DataFrame, known: DataFrame) -> DataFrame:
        """The distinct addresses of urls that aren't in known (url), exactly; known is read for those alone that a filter has."""
        judged = staged(self.asked(urls.select("url").where("url is not null").distinct()), "asked")
        maybe, new = judged.where("maybe").select("url"), judged.where("not maybe").select("url")
        listed = [r.url for r in maybe.limit(LISTED + 1).collect()]
        if not listed:
            return new
        held = known.select("url").where(F.col("url").isin(listed)) if len(listed) <= LISTED else known.select("url")
        return new.unionByName(maybe.join(held, "url", "left_anti"))
