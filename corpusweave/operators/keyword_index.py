"""Keyword search over stored postings with block maxima.

The index has one row for each shard (at most SHARD chunks that follow each other in the input) and bucket (hash of the lexeme): the lexemes,
the largest frequency of each in the shard, and the chunks and frequencies of their postings, packed. A lexeme that every
chunk has is one entry in each shard, so no key is hot, and building it shuffles nothing. A search reads the buckets that its queries' lexemes fall
into, keeps matching lexemes in the scan, and brings what is left of each shard together. There a query is scored only
if the sum of its lexemes' maxima can reach the worst of its k best so far (at first, of chunks with its rarest lexemes), and with the
lexemes that such a score needs (MaxScore): the others are looked up where a chunk can still get in. Many queries at once meet a shard's
frequent lexemes in one matrix product and the others posting by posting. Only the k best of each query leave a task.

Queries are met in blocks of bounded number and size, one job each, whose results are written.

An index for many queries at once (build_whole) has each shard in one row, so a block of queries reads it without a shuffle, and a task's chunks sorted by their
number of lexemes. Weights hardly grow with frequency, so the best chunks are mostly those with the most lexemes: the RICHEST shards are searched first, and the k-th
score of each query there is a floor for all other shards. A query's postings are added up from its rarest lexeme on, only until the frequent ones
that are left can't lift a chunk over EARLY of what it needs; the few chunks that may still get in have the others looked up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.partition import small_batches, spread
from ..sources.staging import new_folder, staged, unstage

SHARD, BUCKETS = 1024, 16
#: Queries and bytes of lexemes of one block.
BLOCK_QUERIES, BLOCK_BYTES = 8000, 64 << 20
#: Products of a posting and a query that are held at a time.
PRODUCTS = 1 << 21
#: So many queries at least that can get a chunk of a shard are scored together: by a matrix product over the shard's frequent lexemes, so
#: many at most, those whose shares of its chunks and of the queries have a product of COMMON at least; the others posting by posting.
TOGETHER, FREQUENT, COMMON, ROWS = 64, 512, 0.01, 1024
#: A whole shard's chunks and postings at most, and the postings that a task holds and sorts.
WHOLE_CHUNKS, WHOLE_POSTINGS, HELD_POSTINGS = 4096, 1 << 20, 1 << 22
#: Queries and bytes of lexemes of one block that meets whole shards.
WHOLE_QUERIES, WHOLE_BYTES = 1 << 14, 128 << 20
#: Shards that are searched first; the share of a needed score that is left to look-ups; scores held at a time; lexemes looked up in a table.
RICHEST, EARLY, CELLS, TABLED = 12, 0.85, 1 << 18, 2048
PI2_6 = 1.64493406685
#: The weight of a frequency: the sum of 1/j^2 for the first 255 occurrences, scaled so that endless occurrences give 0.1.
WEIGHTS = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 256) ** 2.0)]) * 0.1 / PI2_6
INDEX = "shard bigint, bucket int, lexemes array<string>, sizes array<int>, tops binary, chunks binary, tfs binary, ids array<bigint>"
_INDEX = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("lexemes", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("tops", pa.binary()), ("chunks", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.int64()))])


def bucket_of(lexeme: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(lexeme.encode()) % buckets


def _shard_rows(number: int, ids: list[int], chunk: np.ndarray, lexemes: pa.Array, tf: np.ndarray | None):
    """The index rows of one shard, from pairs (place of the chunk, lexeme) and their frequencies; without these pairs are counted."""
    yield number, -1, None, None, None, None, None, ids
    if not len(lexemes):
        return
    coded = lexemes.dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    pair = code * SHARD + chunk
    pair, at, count = np.unique(pair, return_inverse=True, return_counts=True)
    tf = np.minimum(count if tf is None else np.bincount(at, tf).astype(np.int64), 255)
    of = pair // SHARD
    sizes = np.bincount(of, minlength=len(words))
    first = np.cumsum(sizes) - sizes
    tops = np.maximum.reduceat(tf, first)
    buckets = np.array([bucket_of(w) for w in words])
    for b in np.unique(buckets).tolist():
        own = np.flatnonzero(buckets == b)
        places = _ranges(first[own], sizes[own])
        yield number, b, [words[i] for i in own.tolist()], sizes[own].tolist(), tops[own].astype(np.uint8).tobytes(), (pair[places] % SHARD).astype("<u2").tobytes(), tf[places].astype(np.uint8).tobytes(), None


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges [first, first + size), one range after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), _INDEX)], schema=_INDEX)


def build(terms: DataFrame, generation: int = 0) -> DataFrame:
    """The index of terms (chunk_id, terms: the lexemes of a chunk in any order, or null). generation: another one for each part of an index
    that is built in several, so that shards have numbers of their own. Also takes (chunk_id, terms, tfs), distinct lexemes with their frequencies."""
    counted = "tfs" in terms.columns

    def run(batches):
        from pyspark import TaskContext

        number = (generation << 40) + (TaskContext.get().partitionId() << 20)
        ids: list[int] = []
        chunk: list[np.ndarray] = []
        words: list[pa.Array] = []
        tfs: list[np.ndarray] = []

        def flush():
            lexemes = pa.concat_arrays(words) if words else pa.array([], pa.string())
            return _batch(list(_shard_rows(number, ids, np.concatenate(chunk) if chunk else np.zeros(0, np.int64), lexemes, np.concatenate(tfs) if counted and tfs else None)))

        for batch in batches:
            at = 0
            while at < len(batch):
                some = batch.slice(at, SHARD - len(ids))
                at += len(some)
                lists = some.column(1)
                sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
                chunk.append(np.repeat(np.arange(len(some)) + len(ids), sizes))
                words.append(lists.flatten().cast(pa.string()))
                if counted:
                    tfs.append(some.column(2).flatten().to_numpy(zero_copy_only=False))
                ids += some.column(0).to_pylist()
                if len(ids) == SHARD:
                    yield flush()
                    number += 1
                    ids, chunk, words, tfs = [], [], [], []
        if ids:
            yield flush()

    columns = [F.col("chunk_id").cast("bigint").alias("chunk_id"), "terms", *(["tfs"] if counted else [])]
    return spread(terms.where("chunk_id is not null").select(*columns)).mapInArrow(run, INDEX)


WHOLE = "shard bigint, rich float, lexemes array<string>, hashes binary, sizes binary, tops binary, chunks binary, tfs binary, ids binary"


def build_whole(terms: DataFrame) -> DataFrame:
    """The index for many queries at once, of terms as for build: one row for each shard, rich being the mean number of lexemes of its chunks."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            lists = batch.column(1)
            sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            pair = np.repeat(np.arange(len(batch), dtype=np.int64) << 32, sizes) | coded.indices.to_numpy()
            pair, count = np.unique(pair, return_counts=True)
            lexemes = pa.DictionaryArray.from_arrays(pa.array((pair & 0xFFFFFFFF).astype(np.int32)), coded.dictionary)
            parts.append((batch.column(0).to_numpy(), np.bincount(pair >> 32, minlength=len(batch)), lexemes, np.minimum(count, 255).astype(np.uint8)))
            held += len(pair)
            if held >= HELD_POSTINGS:
                for row in _whole_rows(parts):
                    yield _whole_batch(number, row)
                    number += 1
                parts, held = [], 0
        if held:
            for row in _whole_rows(parts):
                yield _whole_batch(number, row)
                number += 1

    small_batches(terms.sparkSession)
    return spread(terms.where("chunk_id is not null").select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "terms")).mapInArrow(run, WHOLE)


def _whole_rows(parts: list[tuple]):
    """The shards of chunks (ids, their numbers of lexemes, lexemes chunk by chunk, frequencies), those with the most lexemes first."""
    ids, sizes, tf = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
    lexemes = pa.chunked_array([p[2] for p in parts]).unify_dictionaries()
    code = np.concatenate([c.indices.to_numpy() for c in lexemes.chunks])
    words = lexemes.chunk(0).dictionary
    first = np.cumsum(sizes) - sizes
    rank = np.empty(len(words), np.int64)  # lexemes by hash, so that they are met in order
    rank[np.argsort(_hashes(words), kind="stable")] = np.arange(len(words))
    words, code = words.take(pa.array(np.argsort(rank))), rank[code]
    order = np.lexsort((ids, -sizes))
    order = order[sizes[order] > 0]  # nothing finds the others
    run, at = np.cumsum(sizes[order]), 0
    while at < len(order):
        end = int(np.searchsorted(run, WHOLE_POSTINGS + (run[at - 1] if at else 0), "right"))
        own = order[at : min(max(end, at + 1), at + WHOLE_CHUNKS)]
        at += len(own)
        places = _ranges(first[own], sizes[own])
        chunk = np.repeat(np.arange(len(own)), sizes[own])
        by = np.argsort(code[places] * WHOLE_CHUNKS + chunk)
        word, f = code[places][by], tf[places][by]
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        n = np.diff(np.concatenate([start, [len(word)]]))
        lexemes = words.take(pa.array(word[start]))
        yield float(sizes[own].mean()), lexemes, _hashes(lexemes).astype("<u8").tobytes(), n.astype("<i4").tobytes(), np.maximum.reduceat(f, start).tobytes(), chunk[by].astype("<u2").tobytes(), f.tobytes(), ids[own].astype("<i8").tobytes()


def _whole_batch(number: int, row: tuple) -> pa.RecordBatch:
    rich, words, *packed = row
    lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rich], pa.float32()), lists, *(pa.array([x], pa.binary()) for x in packed)], [c.split()[0] for c in WHOLE.split(", ")])


def of_postings(postings: DataFrame) -> DataFrame:
    """The index of postings (chunk_id, lexeme, tf)."""
    lists = postings.groupBy("chunk_id").agg(F.collect_list(F.struct("lexeme", F.col("tf").cast("bigint").alias("tf"))).alias("p"))  # one chunk's
    return build(lists.select("chunk_id", F.col("p.lexeme").alias("terms"), F.col("p.tf").alias("tfs")))


# ---------------------------------------------------------------- one shard


@dataclass
class Queries:
    """A block of queries: distinct lexemes, and for each the queries that have it; one divided by each query's number of lexemes."""

    lexemes: pa.Array
    bounds: np.ndarray
    query: np.ndarray
    share: np.ndarray

    def __post_init__(self):
        word = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        order = np.argsort(self.query, kind="stable")
        self.owner, self.word = self.query[order].astype(np.int32), word[order].astype(np.int32)  # the same pairs, query by query

    @classmethod
    def of(cls, lists: list[list[str]], counts: list[int]) -> Queries:
        return cls.coded(pa.array([w for own in lists for w in own], pa.string()).dictionary_encode(), np.array([len(own) for own in lists], np.int64), np.array(counts))

    @classmethod
    def coded(cls, words: pa.DictionaryArray, sizes: np.ndarray, counts: np.ndarray) -> Queries:
        """words: the lexemes of one query after the other, sizes: how many each has. Lexemes of many queries come first."""
        n = max(1, len(sizes))
        pair = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(len(sizes)), sizes))
        per = np.bincount(pair // n, minlength=len(words.dictionary))
        order = np.argsort(-per, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pair = np.sort(rank[pair // n] * n + pair % n)
        return cls(words.dictionary.take(pa.array(order)), np.concatenate([[0], np.cumsum(per[order])]).astype(np.int64), pair % n, np.array([1 / x if x else 0.0 for x in counts.tolist()]))

    def __reduce__(self):  # arrow arrays are sent as lists
        return _queries, (self.lexemes.to_pylist(), self.bounds, self.query, self.share)


def _queries(lexemes, bounds, query, share):
    return Queries(pa.array(lexemes, pa.string()), bounds, query, share)


@dataclass
class _Shard:
    """Postings, lexeme by lexeme: sizes and first places; chunks, weights, and lexeme * SHARD + chunk, which rises."""

    sizes: np.ndarray
    first: np.ndarray
    chunks: np.ndarray
    weights: np.ndarray
    keys: np.ndarray
    ids: np.ndarray


class _Lookup:
    """Frequencies in a shard by (lexeme, chunk): of its most frequent lexemes in a table, of the others by binary search."""

    def __init__(self, sizes: np.ndarray, first: np.ndarray, chunks: np.ndarray, tfs: np.ndarray, width: int):
        common = np.argsort(-sizes, kind="stable")[:TABLED]
        self.column = np.full(len(sizes), -1, np.int64)
        self.column[common] = np.arange(len(common))
        places = _ranges(first[common], sizes[common])
        self.table = np.zeros((len(common), width), np.uint8)
        self.table[np.repeat(np.arange(len(common)), sizes[common]), chunks[places]] = tfs[places]
        self.keys, self.tfs, self.width = np.repeat(np.arange(len(sizes)) * width, sizes) + chunks, tfs, width

    def __call__(self, lex: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        column = self.column[lex]
        out = self.table[np.maximum(column, 0), chunk]
        other = np.flatnonzero(column < 0)
        if len(other):
            wanted = lex[other].astype(np.int64) * self.width + chunk[other]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[other] = np.where(self.keys[place] == wanted, self.tfs[place], 0)
        return out


class Best:
    """The k best chunks of each query of a block that a task has met. asked, made: products that plain scoring takes, and those computed.
    floor: scores that k chunks of each query reach elsewhere."""

    def __init__(self, queries: Queries, k: int, floor: np.ndarray | None = None):
        self.q, self.k, self.floor = queries, k, floor
        n = len(queries.share)
        self.score, self.chunk = np.full((n, k), -1.0), np.zeros((n, k), np.int64)
        self.asked = self.made = 0

    def add(self, word: np.ndarray, sizes: np.ndarray, tops: np.ndarray, chunks: np.ndarray, tfs: np.ndarray, ids: np.ndarray) -> None:
        """A shard's postings: word (place among the queries' lexemes), their sizes and maxima; chunks (rising in a lexeme), tfs: one
        lexeme after the other."""
        q = self.q
        if len(q.share) >= TOGETHER:
            return self._add_many(word, sizes, tops, chunks, tfs, ids)
        per = q.bounds[word + 1] - q.bounds[word]
        lex = np.repeat(np.arange(len(word)), per)  # (lexeme, query) pairs
        query = q.query[_ranges(q.bounds[word], per)]
        self.asked += int(sizes[lex].sum())
        most = WEIGHTS[tops[lex]] * q.share[query]
        total = np.bincount(query, most, len(q.share))
        alive = np.flatnonzero((total > 0) & (total >= self.score[:, -1] - 1e-9))
        if not len(alive):
            return
        order = np.lexsort((most, query))
        order = order[np.isin(query[order], alive)]
        shard = _Shard(sizes, np.cumsum(sizes) - sizes, chunks, WEIGHTS[tfs], np.repeat(np.arange(len(sizes)) * SHARD, sizes) + chunks, ids)
        lex, query, most = lex[order], query[order], most[order]
        low, high = np.searchsorted(query, alive), np.searchsorted(query, alive, "right")
        work = np.cumsum(np.add.reduceat(sizes[lex], low))
        at = 0
        while at < len(alive):
            end = max(at + 1, int(np.searchsorted(work, PRODUCTS + (work[at - 1] if at else 0), "right")))
            part = slice(low[at], high[end - 1])
            self._score(shard, alive[at:end], lex[part], query[part], most[part])
            at = end

    def _add_many(self, word: np.ndarray, sizes: np.ndarray, tops: np.ndarray, chunks: np.ndarray, tfs: np.ndarray, ids: np.ndarray) -> None:
        """The same for many queries, which would pay more for their order than pruning saves."""
        q = self.q
        query, lex = self._met(word)
        self.asked += int(sizes[lex].sum())
        total = np.bincount(query, WEIGHTS[tops][lex], len(q.share)) * q.share
        alive = np.flatnonzero((total > 0) & (total >= self.score[:, -1] - 1e-9))
        if not len(alive):
            return
        row = np.full(len(q.share), -1, np.int64)
        row[alive] = np.arange(len(alive))
        row = row[query]
        row, lex = row[row >= 0], lex[row >= 0]
        first, weights = np.cumsum(sizes) - sizes, WEIGHTS[tfs]
        met = sizes * np.bincount(lex, minlength=len(sizes))
        frequent = np.argsort(-met, kind="stable")[:FREQUENT]
        frequent = frequent[met[frequent] >= COMMON * len(ids) * len(alive)]
        column = np.full(len(sizes), -1, np.int64)
        column[frequent] = np.arange(len(frequent))
        dense = np.zeros((len(frequent), len(ids)))
        dense[np.repeat(np.arange(len(frequent)), sizes[frequent]), chunks[_ranges(first[frequent], sizes[frequent])]] = weights[_ranges(first[frequent], sizes[frequent])]
        for at in range(0, len(alive), ROWS):
            end = min(at + ROWS, len(alive))
            part = slice(np.searchsorted(row, at), np.searchsorted(row, end))
            own, which = row[part] - at, lex[part]
            col = column[which]
            has = np.zeros((end - at, len(frequent)))
            has[own[col >= 0], col[col >= 0]] = 1.0
            table = has @ dense
            self.made += has.shape[0] * dense.size
            own, which = own[col < 0], which[col < 0]
            done = np.cumsum(sizes[which])
            i = 0
            while i < len(own):  # so many products at a time
                j = max(i + 1, int(np.searchsorted(done, PRODUCTS + (done[i - 1] if i else 0), "right")))
                n = sizes[which[i:j]]
                places = _ranges(first[which[i:j]], n)
                self.made += len(places)
                np.add.at(table.reshape(-1), np.repeat(own[i:j] * len(ids), n) + chunks[places], weights[places])
                i = j
            self._keep(alive[at:end], table * q.share[alive[at:end], None], ids)

    def _met(self, word: np.ndarray, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, place in word) of the queries' lexemes that a shard has, query by query."""
        local = np.full(len(self.q.lexemes), -1, np.int32)
        local[word] = np.arange(len(word))
        lex = local[self.q.word]
        some = np.flatnonzero(lex >= 0 if may is None else (lex >= 0) & may[self.q.owner])
        return self.q.owner[some], lex[some]

    def add_whole(self, word: np.ndarray, sizes: np.ndarray, tops: np.ndarray, chunks: np.ndarray, tfs: np.ndarray, ids: np.ndarray) -> None:
        """A whole shard's postings, as for add."""
        least = self.score[:, -1] if self.floor is None else np.maximum(self.score[:, -1], self.floor)
        if 2 * np.count_nonzero(least > 0) < len(least):
            return self._add_many(word, sizes, tops, chunks, tfs, ids)
        weights = WEIGHTS[tfs]
        need = np.where(least > 0, (least - 1e-9) / np.maximum(self.q.share, 1e-300), 0.0) - 1e-6  # running sums aren't exact
        may = need <= np.bincount(chunks, weights, len(ids)).max()  # whatever lexemes they have
        query, lex = self._met(word, may)
        self.asked += int(sizes[lex].sum())
        top = WEIGHTS[tops][lex]
        total = np.bincount(query, top, len(least))
        open_ = (total > 0) & (total >= need)
        some = np.flatnonzero(open_[query])
        query, lex, top = query[some], lex[some], top[some]
        if not len(query):
            return
        new = np.concatenate([[True], query[1:] != query[:-1]])
        start = np.flatnonzero(new)
        live, row = query[start], np.cumsum(new) - 1
        run = np.cumsum(top)
        reach = run - (run - top)[start][row]  # what a chunk can have with the lexemes up to here, frequent ones first
        late = reach <= EARLY * need[query]
        rest = np.bincount(row[late], top[late], len(live))
        low_row, low = row[late], lex[late]
        row, lex = row[~late], lex[~late]
        low_start = np.searchsorted(low_row, np.arange(len(live) + 1))
        first = np.cumsum(sizes) - sizes
        bound = np.maximum(need[live] - rest, 1e-9)
        ends = np.searchsorted(row, np.arange(len(live)), "right")
        work = np.cumsum(sizes[lex])
        work = np.where(ends > 0, work[ends - 1], 0) if len(work) else np.zeros(len(live), np.int64)
        width, look, at = len(ids), None, 0
        while at < len(live):
            end = max(at + 1, min(int(np.searchsorted(work, PRODUCTS + (work[at - 1] if at else 0), "right")), at + max(1, CELLS // width)))
            part = slice(ends[at - 1] if at else 0, ends[end - 1])
            n = sizes[lex[part]]
            places = _ranges(first[lex[part]], n)
            self.made += len(places)
            table = np.bincount(np.repeat((row[part] - at) * width, n) + chunks[places], weights[places], (end - at) * width)
            may = np.flatnonzero(table.reshape(end - at, width) >= bound[at:end, None])
            if len(may):
                i, j = at + may // width, may % width
                value = table[may]
                if len(low):
                    look = look or _Lookup(sizes, first, chunks, tfs, width)
                    value = value + self._rest(look, low, low_start, i, j)
                own = live[i]
                value = np.round(value * self.q.share[own], 12)
                good = (value > 0) & (value >= least[own] - 1e-11)
                self._put(own[good], value[good], ids[j[good]])
            at = end

    def _rest(self, look: _Lookup, low: np.ndarray, low_start: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What the lexemes low[low_start[i] : low_start[i + 1]] add to the chunks j."""
        out, per = np.zeros(len(i)), low_start[i + 1] - low_start[i]
        done, at = np.cumsum(per), 0
        while at < len(i):
            end = max(at + 1, int(np.searchsorted(done, PRODUCTS + (done[at - 1] if at else 0), "right")))
            n = per[at:end]
            self.made += int(n.sum())
            found = look(low[_ranges(low_start[i[at:end]], n)], np.repeat(j[at:end], n))
            out[at:end] = np.bincount(np.repeat(np.arange(end - at), n), WEIGHTS[found], end - at)
            at = end
        return out

    def _keep(self, queries: np.ndarray, table: np.ndarray, ids: np.ndarray) -> None:
        """Puts a shard's scores (queries x chunks) among the best."""
        least = self.score[queries, -1]
        may = (table > 0) & (table >= least[:, None] - 1e-11)  # not rounded yet
        many = np.flatnonzero(may.sum(axis=1) > 4 * self.k)
        if len(many):
            at = table.shape[1] - self.k
            may[many] &= table[many] >= np.partition(table[many], at, axis=1)[:, at, None] - 1e-11
        i, j = np.nonzero(may)
        self._put(queries[i], np.round(table[i, j], 12), ids[j])

    def _put(self, query: np.ndarray, value: np.ndarray, chunk: np.ndarray) -> None:
        """Puts single scores among the best."""
        if not len(query):
            return
        own, i = np.unique(query, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(own)), self.k), i])
        value = np.concatenate([self.score[own].ravel(), value])
        chunk = np.concatenate([self.chunk[own].ravel(), chunk])
        order = np.lexsort((chunk, -value, row))
        top = order[np.searchsorted(row[order], np.arange(len(own)))[:, None] + np.arange(self.k)]
        self.score[own], self.chunk[own] = value[top], chunk[top]

    def _seeds(self, shard: _Shard, alive: np.ndarray, lex: np.ndarray, row: np.ndarray, share: np.ndarray) -> np.ndarray:
        """What a chunk must reach in queries that have no k chunks yet: the k-th best score of the chunks with their rarest lexemes."""
        least = self.score[alive, -1].copy()
        sizes = shard.sizes[lex]
        order = np.lexsort((sizes, row))
        run = np.cumsum(sizes[order])
        start = np.searchsorted(row[order], np.arange(len(alive)))
        before = run - sizes[order] - (run - sizes[order])[start][row[order]]
        chosen = order[(before < 4 * self.k) & (least[row[order]] < 0)]
        chosen = chosen[sizes[chosen] <= 16 * self.k]
        if not len(chosen):
            return least
        n = sizes[chosen]
        seeds = np.unique(np.repeat(row[chosen] * SHARD, n) + shard.chunks[_ranges(shard.first[lex[chosen]], n)])
        of, chunk = seeds // SHARD, seeds % SHARD
        stop = np.searchsorted(row, np.arange(len(alive)), "right")
        begin = np.searchsorted(row, np.arange(len(alive)))
        per = (stop - begin)[of]
        pair = _ranges(begin[of], per)
        wanted = lex[pair] * SHARD + np.repeat(chunk, per)
        self.made += len(wanted)
        place = np.minimum(np.searchsorted(shard.keys, wanted), len(shard.keys) - 1)
        value = np.where(shard.keys[place] == wanted, shard.weights[place] * share[pair], 0.0)
        score = np.add.reduceat(value, np.cumsum(per) - per)
        order = np.lexsort((-score, of))
        first = np.searchsorted(of, np.arange(len(alive)))
        count = np.bincount(of, minlength=len(alive))
        full = np.flatnonzero(count >= self.k)
        least[full] = np.maximum(least[full], score[order[first[full] + self.k - 1]])
        return least

    def _score(self, shard: _Shard, alive: np.ndarray, lex: np.ndarray, query: np.ndarray, most: np.ndarray) -> None:
        """Pairs of alive queries in their order, the lexemes of each by rising maximum."""
        row, share = np.searchsorted(alive, query), self.q.share[query]
        least = self._seeds(shard, alive, lex, row, share) - 1e-9
        run = np.cumsum(most)
        start = np.searchsorted(row, np.arange(len(alive)))
        reach = run - (run - most)[start][row]  # a chunk with only the lexemes up to here
        needed = reach >= least[row]

        def sums(some: np.ndarray) -> np.ndarray:
            """Scores by query and chunk of these pairs."""
            n = shard.sizes[lex[some]]
            places = _ranges(shard.first[lex[some]], n)
            self.made += len(places)
            return np.bincount(np.repeat(row[some] * SHARD, n) + shard.chunks[places], np.repeat(share[some], n) * shard.weights[places], len(alive) * SHARD)

        score = sums(np.flatnonzero(needed))
        rest = np.bincount(row[~needed], most[~needed], len(alive))
        table = score.reshape(len(alive), SHARD)
        may = (table > 0) & (table + rest[:, None] >= least[:, None])
        open_ = may.any(axis=1)
        left = open_ & (rest > 0)
        if left.any():  # the lexemes left out, for the chunks that may still get in
            i, chunk = np.nonzero(may & left[:, None])
            low = np.flatnonzero(~needed & left[row])
            begin, stop = np.searchsorted(row[low], i), np.searchsorted(row[low], i, "right")
            per = stop - begin
            found = int(per.sum())
            if found <= PRODUCTS and found < shard.sizes[lex[low]].sum():
                pair = low[_ranges(begin, per)]
                wanted = lex[pair] * SHARD + np.repeat(chunk, per)
                self.made += found
                place = np.minimum(np.searchsorted(shard.keys, wanted), len(shard.keys) - 1)
                value = np.where(shard.keys[place] == wanted, shard.weights[place] * share[pair], 0.0)
                score = score + np.bincount(np.repeat(i * SHARD + chunk, per), value, len(score))
            else:
                score = score + np.where(score > 0, sums(low), 0.0)
            table = score.reshape(len(alive), SHARD)
        table = np.round(table[:, : len(shard.ids)], 12)
        for i, k in zip(np.flatnonzero(open_).tolist(), alive[open_].tolist()):
            found = np.flatnonzero((table[i] > 0) & (table[i] >= least[i]))
            if len(found):
                s = np.concatenate([self.score[k], table[i, found]])
                c = np.concatenate([self.chunk[k], shard.ids[found]])
                top = np.lexsort((c, -s))[: self.k]
                self.score[k], self.chunk[k] = s[top], c[top]

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > 0)
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(self.chunk[i, j]), pa.array(self.score[i, j])], ["number", "chunk_id", "score"])


# ---------------------------------------------------------------- search

_MATCH = "shard bigint, words binary, sizes binary, tops binary, chunks binary, tfs binary, ids array<bigint>"


def _matching(shared):
    schema = pa.schema([("shard", pa.int64()), *[(x, pa.binary()) for x in ("words", "sizes", "tops", "chunks", "tfs")], ("ids", pa.list_(pa.int64()))])

    def run(batches):
        q: Queries = shared.value
        for batch in batches:
            rows = []
            lists = batch.column(2)
            place_of = pc.index_in(lists.values, value_set=q.lexemes)  # the queries' lexemes are hashed once a batch, not for each row
            bounds = lists.offsets.to_numpy()
            for i in range(len(batch)):
                if batch.column(1)[i].as_py() < 0:
                    rows.append((batch.column(0)[i].as_py(), None, None, None, None, None, batch.column(7)[i].as_py()))
                    continue
                place = place_of.slice(bounds[i], bounds[i + 1] - bounds[i])
                own = np.flatnonzero(np.asarray(place.is_valid()))
                if not len(own):
                    continue
                sizes = batch.column(3)[i].values.to_numpy().astype(np.int64)
                places = _ranges((np.cumsum(sizes) - sizes)[own], sizes[own])
                tops, chunks, tfs = (np.frombuffer(batch.column(n)[i].as_py(), kind) for n, kind in ((4, np.uint8), (5, "<u2"), (6, np.uint8)))
                words = place.take(pa.array(own)).to_numpy().astype("<i4")
                rows.append((batch.column(0)[i].as_py(), words.tobytes(), sizes[own].astype("<i4").tobytes(), tops[own].tobytes(), chunks[places].tobytes(), tfs[places].tobytes(), None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _scored(shared, k: int, count=None):
    def run(batches):
        best = Best(shared.value, k)
        now, parts, ids = None, [], None

        def close():
            if parts and ids is not None:
                word, sizes, tops, chunks, tfs = (np.concatenate([np.frombuffer(p[n], kind) for p in parts]) for n, kind in enumerate(("<i4", "<i4", np.uint8, "<u2", np.uint8)))
                best.add(word.astype(np.int64), sizes.astype(np.int64), tops, chunks.astype(np.int64), tfs, np.array(ids, np.int64))

        for batch in batches:
            for r in zip(*(col.to_pylist() for col in batch.columns)):
                if r[0] != now:
                    close()
                    now, parts, ids = r[0], [], None
                if r[6] is not None:
                    ids = r[6]
                else:
                    parts.append(r[1:6])
        close()
        if count is not None:
            count[0].add(best.asked)
            count[1].add(best.made)
        yield best.rows()

    return run


def search(index: DataFrame, lexemes: DataFrame, k: int, count=None) -> DataFrame:
    """query_id, chunk_id, score: the k best chunks of each query and at most k more for each task, scores rounded to twelve places.
    lexemes: query_id, lexeme, n (by which weights are divided), or a list of lexemes, own, instead of lexeme. count: two accumulators, for the products of plain scoring and for those computed."""
    if "rich" in index.columns:
        return _search_whole(index, lexemes, k, count)
    spark = index.sparkSession
    kind = lexemes.schema["query_id"].dataType
    asked = lexemes if "own" in lexemes.columns else lexemes.groupBy("query_id", "n").agg(F.collect_set("lexeme").alias("own"))  # one query's
    asked = asked.where("n > 0").select("query_id", "n", "own")
    size = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x) + 16)
    asked = staged(asked.withColumn("size", size), "queries")
    n, total = asked.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, -(-n // (BLOCK_QUERIES // 2)), -(-total // (BLOCK_BYTES // 2))) if n > BLOCK_QUERIES or total > BLOCK_BYTES else 1
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("chunk_id", T.LongType()), T.StructField("score", T.DoubleType())])
    path = new_folder(spark, "found")
    for b in range(blocks):
        rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked).collect()  # bounded above
        if not rows:
            continue
        queries = Queries.of([r.own for r in rows], [r.n for r in rows])
        shared = spark.sparkContext.broadcast(queries)
        buckets = sorted({bucket_of(w) for r in rows for w in r.own})
        near = index if len(buckets) == BUCKETS else index.where(F.col("bucket").isin(-1, *buckets))
        match = near.mapInArrow(_matching(shared), _MATCH)
        found = match.repartition("shard").sortWithinPartitions("shard").mapInArrow(_scored(shared, k, count), "number int, chunk_id bigint, score double")
        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)], T.StructType([T.StructField("number", T.IntegerType()), T.StructField("query_id", kind)]))
        found.join(F.broadcast(names), "number").select(*schema.names).write.mode("append").parquet(path)
    unstage(asked)
    if not n:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


class _Words:
    """Finds the queries' lexemes among those of a shard: by hashes, then the strings are compared."""

    def __init__(self, lexemes: pa.Array):
        self.lexemes, own = lexemes, _hashes(lexemes)
        self.place = np.argsort(own, kind="stable")
        self.hashes = own[self.place]
        self.distinct = bool((self.hashes[1:] != self.hashes[:-1]).all())

    def __call__(self, hashes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place among words, place among the queries' lexemes) of those that are both."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        own = np.flatnonzero(self.hashes[at] == hashes)
        word = self.place[at[own]]
        if self.distinct and (not len(own) or pc.all(pc.equal(words.take(pa.array(own)), self.lexemes.take(pa.array(word)))).as_py()):
            return own, word
        number = {w: i for i, w in enumerate(self.lexemes.to_pylist())}  # different strings with one hash
        found = np.array([number.get(w, -1) for w in words.to_pylist()], np.int64)
        return np.flatnonzero(found >= 0), found[found >= 0]


def _scored_whole(shared, k: int, count=None):
    def run(batches):
        queries, floor = shared.value
        best, words = Best(queries, k, floor), _Words(queries.lexemes)
        for batch in batches:
            for i in range(len(batch)):
                hashes, sizes, tops, chunks, tfs, ids = (np.frombuffer(batch.column(n)[i].as_buffer(), kind) for n, kind in enumerate(("<u8", "<i4", np.uint8, "<u2", np.uint8, "<i8"), 1))
                own, word = words(hashes, batch.column(0)[i].values)
                if not len(own):
                    continue
                sizes = sizes.astype(np.int64)
                places = _ranges((np.cumsum(sizes) - sizes)[own], sizes[own])
                best.add_whole(word, sizes[own], tops[own], chunks[places].astype(np.int64), tfs[places], ids)
        if count is not None:
            count[0].add(best.asked)
            count[1].add(best.made)
        yield best.rows()

    return run


def _search_whole(index: DataFrame, lexemes: DataFrame, k: int, count=None) -> DataFrame:
    """search in an index of build_whole: every block of queries meets the richest shards first and then all others."""
    spark = index.sparkSession
    kind = lexemes.schema["query_id"].dataType
    asked = lexemes if "own" in lexemes.columns else lexemes.groupBy("query_id", "n").agg(F.collect_set("lexeme").alias("own"))  # one query's
    size = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x) + 16)
    asked = staged(asked.where("n > 0").select("query_id", F.col("n").cast("bigint").alias("n"), "own").withColumn("size", size), "queries")
    n, total = asked.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("chunk_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not n:
        unstage(asked)
        return spark.createDataFrame([], schema)
    many = n > WHOLE_QUERIES or total > WHOLE_BYTES
    blocks = max(2, -(-4 * n // (3 * WHOLE_QUERIES)), -(-4 * total // (3 * WHOLE_BYTES))) if many else 1
    small_batches(spark)
    richest = [r.shard for r in index.select("shard", "rich").orderBy(F.desc("rich"), "shard").limit(RICHEST).collect()]
    columns = ["lexemes", "hashes", "sizes", "tops", "chunks", "tfs", "ids"]
    first = staged(index.where(F.col("shard").isin(richest)).select(*columns), "richest")
    others = index.where(~F.col("shard").isin(richest)).select(*columns)
    path = new_folder(spark, "found")
    for b in range(blocks):
        rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked).select("query_id", "n", "own").toArrow().combine_chunks()  # bounded above
        if not rows.num_rows:
            continue
        own = rows["own"].combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        queries = Queries.coded(own.flatten().dictionary_encode(), pc.list_value_length(own).to_numpy().astype(np.int64), rows["n"].to_numpy())
        shared = spark.sparkContext.broadcast((queries, None))
        made = "number int, chunk_id bigint, score double"
        found = staged(spread(first).mapInArrow(_scored_whole(shared, k, count), made), "first")
        w = Window.partitionBy("number").orderBy(F.desc("score"))
        kth = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("number", "score").toArrow()
        floor = np.full(rows.num_rows, -1.0)
        floor[kth["number"].to_numpy()] = kth["score"].to_numpy()
        lifted = spark.sparkContext.broadcast((queries, floor))
        more = spread(others).mapInArrow(_scored_whole(lifted, k, count), made)
        names = spark.createDataFrame(rows.select(["query_id"]).append_column("number", pa.array(np.arange(rows.num_rows, dtype=np.int32))))
        for some in (found, more):
            some.join(F.broadcast(names), "number").select(F.col("query_id").cast(kind).alias("query_id"), "chunk_id", "score").write.mode("append").parquet(path)
        unstage(found)
        shared.unpersist()
        lifted.unpersist()
    unstage(asked, first)
    return spark.read.schema(schema).parquet(path)
