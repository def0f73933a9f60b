"""Helpers shared by the corpus operators: Arrow batches of texts, word bounds, rolling hashes, staged tables.

Everything that runs in a task works on slices of at most ``SLICE_BYTES`` of text (one longer document makes a slice of
its own), so the memory of a task doesn't depend on how many documents a partition has.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.partition import spread
from ..sources.staging import clean, shared_folder, staged, unstage  # noqa: F401

SLICE_BYTES = 1 << 20
BATCH_ROWS = 512
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- Spark side


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts differ in length by four orders of magnitude, and a batch is held whole by a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > 8 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return spread(df).mapInArrow(fn, schema)


# ---------------------------------------------------------------- task side


def texts_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 bounds of its rows; null is an empty text."""
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type)
    bounds = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(bounds) else raw, bounds - (bounds[0] if len(bounds) else 0)


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes together, or one row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_bounds(raw: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word, and the n+1 bounds of the documents in words. is_word: 256 booleans."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    m = is_word[raw]
    edge = np.ones(len(m) + 1, bool)
    np.not_equal(m[1:], m[:-1], out=edge[1:-1])
    edge[bounds] = True  # a word never spans two documents
    first = edge[:-1] & m
    last = edge[1:] & m
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one integer, zeros beyond the end; no copy of the text but one."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


_SHIFT = (U64(8) * (U64(8) - np.arange(9, dtype=U64))) % U64(64)
#: Which bits of a lane belong to a span that has so many bytes in it.
_LANE = np.where(np.arange(9) > 0, U64(0xFFFFFFFFFFFFFFFF) >> _SHIFT, U64(0))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, all at once, whatever their lengths.

    A span is cut into lanes of eight bytes; each lane is mixed, moved by its number and mixed again, and the sum is mixed
    with the length. No arithmetic structure of the bytes is left in what is summed, unlike in a polynomial modulo a power
    of two, which has equal values for whole families of different words.
    """
    if not len(starts):
        return np.zeros(0, U64)
    at = lanes(raw)
    sizes = ends - starts
    salt = mix(np.array([seed * 2 + 1], U64))[0]
    hashed = lambda place, left, number: mix(mix((at[place] & _LANE[np.minimum(left, 8)]) ^ salt) + number * U64(_BASE))
    h = hashed(starts, sizes, np.array([1], U64))
    two = np.flatnonzero(sizes > 8)
    if len(two):
        h[two] += hashed(starts[two] + 8, sizes[two] - 8, np.array([2], U64))
        more = two[sizes[two] > 16]
        if len(more):  # the rest lane by lane, in one list
            counts = (sizes[more] - 9) // 8
            first = np.cumsum(counts) - counts
            number = np.arange(int(counts.sum())) - np.repeat(first, counts) + 2
            x = hashed(np.repeat(starts[more], counts) + 8 * number, np.repeat(sizes[more], counts) - 8 * number, (number + 1).astype(U64))
            h[more] += np.add.reduceat(x, first)
    return mix(h ^ (sizes.astype(U64) * U64(0xD6E8FEB86659FD93)))


def same_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which spans hold the same bytes as the spans of another text: eight bytes at a time, while any pair is equal."""
    sizes = ends - starts
    same = sizes == other_ends - other_starts
    left = np.flatnonzero(same & (sizes > 0))
    if not len(left):
        return same
    one, two, k = lanes(raw), lanes(other), 0
    while len(left):
        keep = _LANE[np.minimum(sizes[left] - k, 8)]
        equal = (one[starts[left] + k] & keep) == (two[other_starts[left] + k] & keep)
        same[left[~equal]] = False
        k += 8
        left = left[equal & (sizes[left] > k)]
        if k > 1024 and len(left):  # few and long
            a, b = raw.data, other.data
            for i in left.tolist():
                same[i] = a[starts[i] + k : ends[i]] == b[other_starts[i] + k : other_ends[i]]
            break
    return same


PRIME = U64((1 << 61) - 1)
_MULTIPLIERS = (U64(0x2E3779B1), U64(0x35EBCA6B))  # bases of the rolling hash, under 2**30


def _times(x: np.ndarray, base: np.uint64) -> np.ndarray:
    """x * base modulo PRIME (not fully reduced, under 2**62), for x under 2**62 and a base under 2**30."""
    high = (x >> U64(31)) * base
    low = (x & U64(0x7FFFFFFF)) * base
    out = (high >> U64(30)) + ((high & U64(0x3FFFFFFF)) << U64(31)) + low
    return (out & PRIME) + (out >> U64(61))


def gram_hashes(words: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every k consecutive word hashes (len(words)-k+1 of them, documents not regarded).

    The polynomial is taken modulo a prime, by Horner's rule over all windows at once. base: 0 or 1, for two independent hashes.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    last, step = U64(k * _BASE & 0xFFFFFFFFFFFFFFFF), 1 << 14  # so many windows stay in the processor's cache
    for at in range(0, n, step):
        x = words[at : at + step + k - 1] % PRIME
        m = len(x) - k + 1
        h = x[:m].copy()
        for i in range(1, k):
            h = _times(h, _MULTIPLIERS[base])
            h += x[i : i + m]
            h = (h & PRIME) + (h >> U64(61))
        out[at : at + m] = mix(h % PRIME + last)
    return out


def gram_starts(doc_words: np.ndarray, k: int) -> np.ndarray:
    """Which word positions start k words of one document: a mask over len(words)-k+1 positions."""
    total = int(doc_words[-1])
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    for b in np.unique(doc_words[1:-1]):
        ok[max(0, b - k + 1) : max(0, min(b, n))] = False
    return ok


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def covered(starts: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Mask of the n positions that lie in one of the runs starting at starts, of k positions each."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + k, -1)
    return np.cumsum(d[:-1]) > 0


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def hex_list(col: str) -> F.Column:
    """SHA-256 of the comma-joined, string-sorted elements of an array column."""
    return F.sha2(F.array_join(F.array_sort(F.transform(col, lambda x: x.cast("string"))), ","), 256)


WHITESPACE_WORD = np.ones(256, bool)
WHITESPACE_WORD[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers as differences in byte planes, without planes of zeros; Spark's codec squeezes the rest."""
    d = np.diff(values, prepend=U64(0))
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8).T
    keep = 8
    while keep > 1 and not planes[keep - 1].any():
        keep -= 1
    return bytes([keep]) + planes[:keep].tobytes()


def places(h: np.ndarray, check: np.ndarray, table: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where each pair (h, check) stands in a table sorted by its hashes; -1 where it doesn't."""
    out = np.full(len(h), -1, np.int64)
    if not len(table) or not len(h):
        return out
    at = np.searchsorted(table, h)
    left = np.flatnonzero(at < len(table))
    while len(left):  # once, unless hashes in the table are equal
        left = left[table[at[left]] == h[left]]
        ok = checks[at[left]] == check[left]
        out[left[ok]] = at[left[ok]]
        left = left[~ok]
        at[left] += 1
        left = left[at[left] < len(table)]
    return out


def unpack_sorted(data: bytes) -> np.ndarray:
    keep = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(keep, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :keep] = planes.T
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=U64)


#: Bits of a block's number that tell the parts of one rank apart.
PART_BITS = 20


def order_blocks(docs: DataFrame, key: str, block_bytes: int, bins: int = 512) -> tuple[DataFrame, int]:
    """(docs with a column block, total bytes of text). The rank block >> PART_BITS rises with the key, which isn't null.

    Ranks are intervals between quantiles of the key, weighted by bytes of text: at most ``bins`` of them, and where that leaves more
    than block_bytes in each, as many again inside every interval (only these quantiles come to the driver or are
    broadcast, bins + bins**2 numbers at most); what is still larger is cut evenly. A key that several quantiles fall on is a
    rank of its own, in parts by the place of the row in its file or partition, so equal rows part too: only such a rank has
    more than one part, and its rows have one key. docs: a scan, whose rows come in the same order again if a task is repeated.
    """
    weight = F.octet_length("text") + 16
    total, text, low, high = docs.agg(F.sum(weight), F.sum(F.octet_length("text")), F.min(key), F.max(key)).first()
    if low is None:
        return docs.withColumn("block", F.lit(0).cast("bigint")), 0
    wanted = max(1, -(-total // block_bytes))
    first = min(bins, wanted)
    second = min(bins, -(-wanted // first))
    third = -(-wanted // (first * second))

    def draws(number: int) -> DataFrame:
        """Keys, each about as often as its share of ``number`` says."""
        dice = F.shiftrightunsigned(F.xxhash64(key, "text", F.lit(3)), 11) / float(1 << 53)
        return docs.select(F.col(key).alias("key"), F.explode(F.array_repeat(F.lit(0), F.floor(weight * (number / total) + dice).cast("int"))).alias("x")).select("key")

    def place(df: DataFrame, column: str, edges: F.Column, many: F.Column) -> DataFrame:
        """Adds rank (among the distinct edges) and many (how many quantiles fall on the key); steps, so that each is computed once."""
        df = df.withColumn("n", F.size(F.filter(edges, lambda e: e <= F.col(column))))
        on = F.when(F.col("n") > 0, F.try_element_at(edges, F.greatest("n", F.lit(1)))) == F.col(column)
        df = df.withColumn("many", F.coalesce(F.when(on, F.try_element_at(many, F.greatest("n", F.lit(1)))), F.lit(0)))
        df = df.withColumn("many", F.when(F.col("many") > 1, F.col("many")).otherwise(0))
        return df.withColumn("rank", F.col("n") * 2 + (F.col("many") == 0).cast("int")).drop("n")

    def times(edges: F.Column) -> F.Column:
        return F.transform(F.array_distinct(edges), lambda e: F.size(F.filter(edges, lambda x: x == e)))

    ask = lambda n: [i / n for i in range(1, n)] or [1.0]
    found = sorted(draws(64 * first).agg(F.percentile_approx("key", ask(first), 8 * bins).alias("edges")).first().edges or [high])
    distinct = sorted(set(found))
    outer = F.lit(distinct).cast("array<bigint>"), F.lit([found.count(x) for x in distinct]).cast("array<int>")
    docs = place(docs, key, *outer)
    rank, part = F.col("rank").cast("bigint"), F.col("many") * (total // first // block_bytes + 1)
    if second > 1:
        inner = place(draws(64 * first * second), "key", *outer).groupBy(F.col("rank").alias("outer")).agg(F.percentile_approx("key", ask(second), 8 * bins).alias("edges"), F.min("key").alias("least"), F.max("key").alias("most"))
        inner = inner.select("outer", F.array_distinct(F.array_sort("edges")).alias("edges"), times(F.array_sort("edges")).alias("times"), "least", "most")
        docs = docs.withColumnsRenamed({"rank": "outer", "many": "heavy"}).join(F.broadcast(inner), "outer", "left")
        docs = place(docs, key, F.coalesce("edges", F.array().cast("array<bigint>")), F.coalesce("times", F.array().cast("array<int>")))
        heavy = F.col("heavy") > 0
        part = F.when(heavy, F.col("heavy") * (total // first // block_bytes + 1)).otherwise(F.col("many") * (total // (first * second) // block_bytes + 1))
        rank = F.col("outer").cast("bigint") * (2 * second + 2) + F.when(heavy, 0).otherwise(F.col("rank"))
        if third > 1:
            share = (F.col(key).cast("double") - F.col("least").cast("double")) / F.greatest(F.col("most").cast("double") - F.col("least").cast("double"), F.lit(1.0))
            step = F.coalesce(F.greatest(F.lit(0), F.least(F.floor(share * second * third), F.lit(second * third - 1))), F.lit(0))  # rises with the key
            rank = rank * (second * third) + F.when(heavy | (F.col("many") > 0), 0).otherwise(step)
    salt = F.when(part > 0, F.pmod(F.monotonically_increasing_id(), F.least(part, F.lit(1 << PART_BITS)))).otherwise(0)
    block = F.shiftleft(rank.cast("bigint"), PART_BITS) + salt.cast("bigint")
    return docs.withColumn("block", block).drop("outer", "heavy", "rank", "many", "edges", "times", "least", "most"), text or 0
