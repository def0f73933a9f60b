"""Substring search (ILIKE) over a trigram index.

The index has, for each shard of at most SHARD texts and each bucket of trigrams, which texts of the shard hold which trigram, packed; and
the texts by shard, so that those of a shard can be read without the others. A trigram is three folded characters in one integer
(21 bits each), so different trigrams are never taken for each other. A pattern's literal runs give the trigrams that a text must have; a
search reads their buckets, counts for each text how many of a pattern's trigrams it has, and compares the texts that have all.
Patterns without a run of three characters have no trigram: they are compared with every text.

MANY patterns and more at once have candidates in nearly every shard. Then each shard's texts are read once, as one array of characters with
the places of every four characters in it: a pattern's pieces are looked up at the places of their rarest four, and pieces follow each other by binary
search, for all texts of the shard together. No text is sent, copied or walked through for a single pattern.

Folding is the simple lower case of each character, of texts and patterns alike. ``%`` stands for any characters and ``_`` for one; there is no
escape. A null text or pattern matches nothing; the empty pattern matches the empty text alone.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.partition import spread
from ..sources.staging import hadoop_path, new_folder, staged

SHARD, BUCKETS = 1024, 64
SHARD_CHARS = 4 << 20  # a shard ends behind the text with which it passes this
#: Patterns and characters of one block.
BLOCK_PATTERNS, BLOCK_GRAMS = 1 << 16, 1 << 22
#: So many patterns at least meet the places of characters in whole shards instead of the stored postings.
MANY = 64
#: Matches in one Arrow batch, about.
MATCHES = 1 << 18
MOST_SHARDS = 4096  # in a pushed-down list
GRAMS = "shard bigint, bucket int, grams binary, sizes binary, texts binary"
TEXTS = "shard bigint, place int, id bigint, text string"


@cache
def _folds() -> np.ndarray:
    low = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and len(x := chr(i).lower()) == 1:
            low[i] = ord(x)
    low[0x130] = ord("i")
    return low


def fold(text: str) -> np.ndarray:
    """Code points of the text in simple lower case."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _folds()[x]


def folded(text: str) -> str:
    return text.lower() if text.isascii() else fold(text).tobytes().decode("utf-32-le", "surrogatepass")


@cache
def _uppers() -> dict[int, str]:
    return {i: x for i in range(0x110000) if not 0xD800 <= i < 0xE000 and len(x := chr(i).upper()) == 1 and x != chr(i)}


def simple_upper(col: Column) -> Column:
    """Simple upper case, one character for each: where the full one is longer (ß) the character stays, which folds to the same."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x.translate(_uppers()), na_action="ignore")

    return run(col)


def grams(codes: np.ndarray) -> np.ndarray:
    """Distinct trigrams, rising."""
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    x = codes.astype(np.int64)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:])


def bucket_of(gram: np.ndarray) -> np.ndarray:
    return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS


def pattern_grams(pattern: str) -> np.ndarray:
    """The trigrams of a pattern's literal runs."""
    found = [grams(fold(run)) for run in re.split("[%_]", pattern)]
    return np.unique(np.concatenate(found))


class Matcher:
    """A pattern as its pieces between % signs: each is found leftmost behind the one before; the first and last are anchored."""

    def __init__(self, pattern: str):
        self.pieces = [re.compile("".join("." if x == "_" else re.escape(x) for x in piece), re.S) for piece in folded(pattern).split("%")]
        self.sizes = [len(piece) for piece in folded(pattern).split("%")]

    def __call__(self, text: str) -> bool:
        """text: folded."""
        if len(self.pieces) == 1:
            return self.pieces[0].fullmatch(text) is not None
        first = self.pieces[0].match(text)
        end = len(text) - self.sizes[-1]
        if first is None or end < first.end() or self.pieces[-1].match(text, end) is None:
            return False
        at = first.end()
        for piece in self.pieces[1:-1]:
            found = piece.search(text, at, end)
            if found is None:
                return False
            at = found.end()
        return True


class Places:
    """The texts of a shard as one array of folded characters, numbered by the shard's alphabet, a 0 behind each, with the places of every four characters,
    by a 16-bit hash. Four characters are one integer, which is compared; where the alphabet is too large for that it's a hash, and
    the characters are compared too."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.starts = self.ends - self.sizes
        codes = fold("\n".join([*texts, ""]))
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        alphabet = np.flatnonzero(seen)
        number = np.zeros(0x110000, np.min_scalar_type(len(alphabet)))
        number[alphabet] = np.arange(1, len(alphabet) + 1)
        self.codes, self.exact = number[codes], len(alphabet) < 256
        self.codes[self.ends] = 0
        self.number = {chr(c): i for i, c in enumerate(alphabet.tolist(), 1)}
        self.quads = self._quad(*(self.codes[j : len(codes) - 3 + j].astype(np.uint32) for j in range(4))) if len(codes) > 3 else np.zeros(0, np.uint32)
        own = self._slot(self.quads).astype(np.uint16)
        self.order = np.argsort(own, kind="stable").astype(np.int32)  # radix sort
        self.first = [0, *np.cumsum(np.bincount(own, minlength=1 << 16)).tolist()]
        self.sorted = self.quads[self.order]
        self.last: tuple = (None, None, None)

    def _quad(self, a, b, c, d):
        """Of numbers or of arrays of 32-bit integers."""
        if self.exact:
            return a << 24 | b << 16 | c << 8 | d
        for x in (b, c, d):
            a = a * 0x01000193 & 0xFFFFFFFF ^ x
        return a

    @staticmethod
    def _slot(quad):
        return (quad * 0x9E3779B1 & 0xFFFFFFFF) >> 16

    def _agree(self, at: np.ndarray, own: list, done: int = -4) -> np.ndarray:
        """Of the places at those where a piece stands: its characters' numbers, None for any. done: where four of them are known to stand."""
        j = 0
        while j < len(own) and len(at):
            four = own[j : j + 4]
            if self.exact and len(four) == 4 and None not in four:
                if j != done:
                    at = at[self.quads[at + j] == self._quad(*four)]
                j += 4
                continue
            if not (self.exact and done <= j < done + 4):
                x = self.codes[at + j]
                at = at[x > 0 if own[j] is None else x == own[j]]
            j += 1
        return at

    def _numbers(self, piece: str) -> list | None:
        """None if the shard lacks one of the characters."""
        own = [None if x == "_" else self.number.get(x, 0) for x in piece]
        return None if 0 in own else own

    def find(self, piece: str) -> np.ndarray:
        """Rising places where a piece (not empty) stands."""
        own = self._numbers(piece)
        least, off, last = None, 0, len(self.codes) - len(piece)
        if own is None or last < 0:
            return np.zeros(0, np.int64)
        for j in range(len(own) - 3):
            if None not in own[j : j + 4]:
                quad = self._quad(*own[j : j + 4])
                slot = self._slot(quad)
                size = self.first[slot + 1] - self.first[slot]
                if least is None or size < least:
                    least, off, value, some = size, j, quad, slice(self.first[slot], self.first[slot + 1])
        if least is None:  # not four characters in a row: all places
            at = np.flatnonzero(self.codes[: last + 1] > 0 if own[0] is None else self.codes[: last + 1] == own[0])
            return self._agree(at, own)
        at = self.order[some][self.sorted[some] == value].astype(np.int64) - off
        at = at[(at >= 0) & (at <= last)]
        return at if self.exact and len(own) == 4 else self._agree(at, own, off)

    def _first(self, piece: str) -> tuple[np.ndarray, np.ndarray]:
        """The texts that have a piece, and where it first stands in each."""
        if self.last[0] != piece:
            at = self.find(piece)
            text = np.searchsorted(self.ends, at)
            new = np.ones(len(at), bool)
            new[1:] = text[1:] != text[:-1]
            self.last = piece, text[new], at[new]
        return self.last[1:]

    def _stands(self, piece: str, at: np.ndarray) -> np.ndarray:
        """Whether a piece stands at each of the places."""
        own = self._numbers(piece)
        return np.zeros(len(at), bool) if own is None else np.isin(at, self._agree(at, own))

    def match(self, pattern: str) -> np.ndarray:
        """The texts (their numbers, rising) that match a folded pattern."""
        head, *rest = pattern.split("%")
        text, at = None, None
        if head or not rest:
            text = np.flatnonzero(self.sizes >= len(head) if rest else self.sizes == len(head))
            text = text[self._stands(head, self.starts[text])]
            at = self.starts[text] + len(head)
        if not rest:
            return text
        tail = rest.pop()
        for piece in filter(None, rest):
            if text is None:
                text, at = self._first(piece)
            else:
                places = self.find(piece)
                i = np.searchsorted(places, at)
                some = i < len(places)
                text, at = text[some], places[i[some]]
            at = at + len(piece)
            some = at <= self.ends[text]
            text, at = text[some], at[some]
        if text is None:
            text, at = np.arange(len(self.sizes)), self.starts
        if tail:
            some = at <= self.ends[text] - len(tail)
            text = text[some]
            text = text[self._stands(tail, self.ends[text] - len(tail))]
        return text


class SubstringIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> SubstringIndex:
        """docs: id, text. Writes the texts of the index to a path that nothing uses yet; its postings are written when a search first asks for them."""
        spark = docs.sparkSession
        own = cls(spark, path or new_folder(spark, "trigrams"))
        own.add(docs)
        return own

    def _generation(self) -> int:
        fs, path = hadoop_path(self.spark, f"{self.path}/texts")
        if not fs.exists(path):
            return 0
        return (self.texts().agg(F.max(F.shiftright("shard", 40))).first()[0] or 0) + 1

    def add(self, docs: DataFrame) -> None:
        """Texts that aren't in the index yet."""
        generation = self._generation()

        def number(batches):
            from pyspark import TaskContext

            shard, place, held = (generation << 40) + (TaskContext.get().partitionId() << 20), 0, 0
            for batch in batches:
                rows = []
                for text in batch.column(1).to_pylist():
                    rows.append((shard, place))
                    place, held = place + 1, held + len(text)
                    if place == SHARD or held >= SHARD_CHARS:
                        shard, place, held = shard + 1, 0, 0
                shards, places = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(places, pa.int32()), *batch.columns], ["shard", "place", "id", "text"])

        rows = spread(docs.select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null"))
        rows.mapInArrow(number, TEXTS).write.mode("append").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/texts")

    def texts(self) -> DataFrame:
        return self.spark.read.schema(TEXTS).parquet(f"{self.path}/texts")

    def _grams(self) -> DataFrame:
        """The postings; those of texts that have none yet are written."""
        paths = []
        for generation in [r[0] for r in self.texts().select(F.shiftright("shard", 40)).distinct().collect()]:  # one for each add
            paths.append(f"{self.path}/grams/generation={generation}")
            fs, done = hadoop_path(self.spark, f"{paths[-1]}/_SUCCESS")
            if not fs.exists(done):
                made = self.texts().where(F.shiftright("shard", 40) == generation)
                together = made.repartition("shard").sortWithinPartitions("shard", "place")
                together.select("shard", "place", "text").mapInArrow(_packed, GRAMS).write.mode("overwrite").partitionBy("bucket").parquet(paths[-1])
        schema = "shard bigint, grams binary, sizes binary, texts binary, generation bigint, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/grams").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def candidates(self, patterns: list[str]) -> DataFrame:
        """number, shard, place of the texts that have all trigrams of a pattern (numbered in this list), of those that have one."""
        per = [pattern_grams(p) for p in patterns]
        every, bounds = np.unique(np.concatenate([np.zeros(0, np.int64), *per])), np.array([len(x) for x in per])
        pairs = sorted((g, i) for i, own in enumerate(per) for g in np.searchsorted(every, own).tolist())
        first = np.searchsorted(np.array([g for g, _ in pairs], np.int64), np.arange(len(every) + 1))
        shared = self.spark.sparkContext.broadcast((every, first, np.array([i for _, i in pairs], np.int64), bounds))
        rows = self._grams().where(F.col("bucket").isin(sorted(set(bucket_of(every).tolist())))) if len(every) else self._grams().where("false")

        def match(batches):
            every, *_ = shared.value
            for batch in batches:
                out = []
                for shard, own, sizes, texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    own, sizes, texts = np.frombuffer(own, "<i8"), np.frombuffer(sizes, "<u2").astype(np.int64), np.frombuffer(texts, "<u2")
                    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
                    hit = np.flatnonzero(own[at] == every)
                    if len(hit):
                        start = np.cumsum(sizes) - sizes
                        n = sizes[at[hit]]
                        places = np.repeat(start[at[hit]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                        out.append((shard, hit.astype("<i4").tobytes(), n.astype("<i4").tobytes(), texts[places].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "grams", "sizes", "texts"])

        def count(batches):
            every, first, pattern, bounds = shared.value
            now, parts = None, []

            def close():
                if not parts:
                    return
                gram, n, text = (np.concatenate([np.frombuffer(p[i], kind) for p in parts]).astype(np.int64) for i, kind in enumerate(("<i4", "<i4", "<u2")))
                start = np.cumsum(n) - n
                seen = np.zeros(len(bounds), np.int64)  # trigrams that the shard has at all
                per = first[gram + 1] - first[gram]
                owner = pattern[np.repeat(first[gram] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))]
                np.add.at(seen, owner, 1)
                of = np.repeat(np.arange(len(gram)), per)
                for i in np.flatnonzero((seen == bounds) & (bounds > 0)).tolist():
                    own = of[owner == i]
                    own = own[np.argsort(n[own], kind="stable")]
                    left = text[start[own[0]] : start[own[0]] + n[own[0]]]
                    for g in own[1:].tolist():  # the rarest first
                        left = left[np.isin(left, text[start[g] : start[g] + n[g]])]
                        if not len(left):
                            break
                    if len(left):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), i, np.int32)), pa.array(np.full(len(left), now, np.int64)), pa.array(left.astype(np.int32))], ["number", "shard", "place"])

            for batch in batches:
                for r in zip(*(col.to_pylist() for col in batch.columns)):
                    if r[0] != now:
                        yield from close()
                        now, parts = r[0], []
                    parts.append(r[1:])
            yield from close()

        met = rows.select("shard", "grams", "sizes", "texts").mapInArrow(match, "shard bigint, grams binary, sizes binary, texts binary")
        return met.repartition("shard").sortWithinPartitions("shard").mapInArrow(count, "number int, shard bigint, place int")

    def search(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, id of the texts that match patterns (pattern_id, pattern), in blocks of bounded size; the results of more than one are written."""
        kind = patterns.schema["pattern_id"].dataType
        schema = T.StructType([T.StructField("pattern_id", kind), T.StructField("id", T.LongType())])
        asked = staged(patterns.where("pattern is not null").select("pattern_id", "pattern"), "patterns")
        n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
        blocks = max(1, -(-n // BLOCK_PATTERNS), -(-size // BLOCK_GRAMS))
        if blocks > 1:
            blocks *= 2
        if not n:
            return self.spark.createDataFrame([], schema)
        if blocks == 1:
            return self._matches(asked.collect(), schema)  # bounded above
        path = new_folder(self.spark, "matches")
        for b in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("pattern_id", "pattern"), F.lit(blocks)) == b).collect()  # bounded above
            if rows:
                self._matches(rows, schema).write.mode("append").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _matches(self, rows: list, schema: T.StructType) -> DataFrame:
        place = {p: i for i, p in enumerate(sorted({r.pattern for r in rows}, key=folded))}  # equal ones are met once, equal beginnings one after the other
        names = self.spark.createDataFrame([(place[r.pattern], r.pattern_id) for r in rows], T.StructType([T.StructField("number", T.IntegerType()), schema["pattern_id"]]))
        out = self._many(list(place)) if len(place) >= MANY else self._few(list(place))
        return out.join(F.broadcast(names), "number").select(*schema.names)

    def _many(self, patterns: list[str]) -> DataFrame:
        """number, id of the texts that match; every text is read once."""
        shared = self.spark.sparkContext.broadcast([folded(p) for p in patterns])

        def run(batches):
            ids, texts, held = [], [], 0

            def close():
                places, own, out, size = Places(texts), np.array(ids, np.int64), [], 0
                for i, pattern in enumerate(shared.value):
                    found = places.match(pattern)
                    if len(found):
                        out.append((i, found))
                        size += len(found)
                    if size >= MATCHES:
                        yield batch_of(out, own)
                        out, size = [], 0
                if out:
                    yield batch_of(out, own)

            def batch_of(out, own):
                number = np.repeat(np.array([i for i, _ in out], np.int32), [len(x) for _, x in out])
                return pa.RecordBatch.from_arrays([pa.array(number), pa.array(own[np.concatenate([x for _, x in out])])], ["number", "id"])

            for batch in batches:
                for id_, text in zip(*(col.to_pylist() for col in batch.columns)):
                    ids.append(id_)
                    texts.append(text)
                    held += len(text)
                    if len(ids) == SHARD or held >= SHARD_CHARS:
                        yield from close()
                        ids, texts, held = [], [], 0
            if ids:
                yield from close()

        return spread(self.texts().select("id", "text")).mapInArrow(run, "number int, id bigint")

    def _few(self, patterns: list[str]) -> DataFrame:
        """The same by the stored postings: candidates are compared."""
        shared = self.spark.sparkContext.broadcast(patterns)
        short = [i for i, p in enumerate(patterns) if not len(pattern_grams(p))]
        found = staged(self.candidates(patterns), "candidates")
        shards = [r.shard for r in found.select("shard").distinct().limit(MOST_SHARDS + 1).collect()]
        texts = self.texts() if len(shards) > MOST_SHARDS else self.texts().where(F.col("shard").isin(shards))
        found = found.groupBy("shard", "place").agg(F.collect_list("number").alias("numbers"))  # of one text, fewer than MANY

        def verify(batches):
            own = {}
            for batch in batches:
                out = []
                for numbers, id_, text in zip(*(col.to_pylist() for col in batch.columns)):
                    low = folded(text)
                    for number in numbers:
                        if number not in own:
                            own[number] = Matcher(shared.value[number])
                        if own[number](low):
                            out.append((number, id_))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.int64())], ["number", "id"])

        def scan(batches):
            own = [(i, Matcher(shared.value[i])) for i in short]
            for batch in batches:
                for id_, text in zip(*(col.to_pylist() for col in batch.columns)):
                    low = folded(text)
                    hits = [i for i, m in own if m(low)]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int32()), pa.array([id_] * len(hits), pa.int64())], ["number", "id"])

        out = texts.join(found, ["shard", "place"]).select("numbers", "id", "text").mapInArrow(verify, "number int, id bigint")
        if short:
            out = out.unionByName(spread(self.texts().select("id", "text")).mapInArrow(scan, "number int, id bigint"))
        return out


def _packed(batches):
    """The trigrams of each shard, by bucket."""
    schema = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])
    now, own, place = None, [], []

    def close():
        if not own or not sum(map(len, own)):
            return
        gram, text = np.concatenate(own), np.repeat(np.array(place, np.int64), [len(x) for x in own])
        order = np.argsort(gram, kind="stable")
        gram, text = gram[order], text[order]
        words, size = np.unique(gram, return_counts=True)
        bucket = bucket_of(words)
        start = np.cumsum(size) - size
        for b in np.unique(bucket).tolist():
            some = np.flatnonzero(bucket == b)
            n = size[some]
            places = np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b], pa.int32()), pa.array([words[some].astype("<i8").tobytes()], pa.binary()), pa.array([n.astype("<u2").tobytes()], pa.binary()), pa.array([text[places].astype("<u2").tobytes()], pa.binary())], schema=schema)

    for batch in batches:
        for shard, at, text in zip(*(col.to_pylist() for col in batch.columns)):
            if shard != now:
                yield from close()
                now, own, place = shard, [], []
            own.append(grams(fold(text)))
            place.append(at)
    yield from close()
