"""Token counts by a map-side two-tier lookup.

The vocabulary is a sentencepiece BPE whose pieces never hold a space mark after another character, so no merge crosses
the start of a run of spaces: a text's count is the sum over its pre-tokens, a run of spaces with the following
non-spaces (every text starts with one space more, the dummy prefix). That property is checked when the model is loaded.

Tier 1: a broadcast table of the most frequent pre-tokens with their lengths (``FREQUENT`` entries of at most ``LONGEST``
bytes, so its size has a fixed bound). They are the most frequent of a sample of SAMPLE_BYTES of text, drawn at random from
the texts of at most SAMPLE_TEXT bytes; SAMPLE_ROWS bounds what comes to the driver. The sample decides only what is looked up and
what is encoded, never a count.
Tier 2: pre-tokens that miss are encoded by the library, once per worker while they stay in its bounded cache.
Both tiers find a pre-token by its hash and then compare its bytes, so a count doesn't rest on a hash. Neither pre-tokens
nor texts are shuffled.

Defined cases: null and empty texts have 0 bytes and 0 tokens. A text with U+2581, which the library takes for a space,
is encoded whole. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Entries of the broadcast table and bytes of an entry.
FREQUENT, LONGEST = 1 << 16, 64
#: Of the sample: expected bytes, bytes of a text, and the most rows.
SAMPLE_BYTES, SAMPLE_TEXT, SAMPLE_ROWS = 8 << 20, 16 << 10, 16 << 10
#: Entries of a worker's cache of misses.
CACHE = 300_000
LIMIT = 4096
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x20] = False


class Library:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: Whether counts are sums over pre-tokens; else whole texts are encoded.
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.misses: dict[bytes, int] = {}
        #: Tokens of a space that stands alone at the end of a text.
        self.space = 1 if self.model.piece_to_id(MARK) != self.model.unk_id() else len(MARK.encode())

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def pretoken_lengths(self, pretokens: list[str]) -> list[int]:
        """Tokens of pre-tokens without their first space; the empty one is a space alone."""
        return [n if p else self.space for p, n in zip(pretokens, self.lengths(pretokens))]


_libraries: dict[str, Library] = {}


def library(path: str) -> Library:
    if path not in _libraries:
        _libraries[path] = Library(path)
    return _libraries[path]


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def pretokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of every pre-token, its hash, and the documents' bounds in pre-tokens.

    The byte range leaves out one space: the one that the library's dummy prefix puts back.
    """
    space = raw == 0x20
    first = np.ones(len(raw), bool)
    first[1:] = space[1:] & ~space[:-1]
    heads = bounds[:-1][bounds[1:] > bounds[:-1]]
    first[heads] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(raw))
    docs = np.searchsorted(starts, bounds)
    lead = np.zeros(len(raw), bool)
    lead[heads] = True
    starts = starts + ~lead[starts]  # a document's first pre-token has the dummy prefix as its space
    return starts, ends, c.span_hashes(raw, starts, ends), docs


def frequent(docs: DataFrame, rows: int = FREQUENT) -> list[bytes]:
    """The most frequent pre-tokens of the sample, the first of equal ones in byte order."""
    texts = docs.select("text").where(F.octet_length("text") <= SAMPLE_TEXT)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    drawn = texts.where(F.rand(5) < SAMPLE_BYTES / max(total, 1)).limit(SAMPLE_ROWS).toArrow()
    counts: dict[bytes, int] = {}
    for batch in drawn.to_batches():
        raw, bounds = c.texts_of(batch, "text")
        data = raw.tobytes()
        starts, ends, _, _ = pretokens(raw, bounds)
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a <= LONGEST:
                counts[data[a:b]] = counts.get(data[a:b], 0) + 1
    return sorted(counts, key=lambda w: (-counts[w], w))[:rows]


class Table:
    """Sorted hashes of pre-tokens, their token counts, and their bytes to compare with."""

    def __init__(self, words: list[bytes], lengths: list[int]):
        self.raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = ends - [len(w) for w in words] if words else ends
        h = c.span_hashes(self.raw, starts, ends)
        order = np.argsort(h, kind="stable")
        self.hashes, self.starts, self.ends, self.lengths = h[order], starts[order], ends[order], np.array(lengths, np.int64)[order]

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the spans that the table holds, their token counts)."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), self.lengths
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[at] == hashes)
        at = at[hit]
        same = c.same_spans(raw, starts[hit], ends[hit], self.raw, self.starts[at], self.ends[at])
        return hit[same], self.lengths[at[same]]


def count_tokens(docs: DataFrame, path: str | None = None, rows: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document. rows: entries of the broadcast table."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lib = library(_path(path))
    words = frequent(docs, rows) if lib.splits and rows else []
    table = spark.sparkContext.broadcast(Table(words, lib.pretoken_lengths([w.decode() for w in words]) if words else []))

    def run(batches):
        lib = library(_path(path))
        for batch in batches:
            raw, bounds = c.texts_of(batch, "text")
            out = []
            for i, j in c.slices(bounds):
                out.append(_counts(lib, table.value, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
            n = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return c.map_batches(docs, run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def _counts(lib: Library, table: Table, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n_docs = len(bounds) - 1
    if not len(raw):
        return np.zeros(n_docs, np.int64)
    data = raw.tobytes()
    if not lib.splits:
        return np.array(lib.lengths([data[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])]), np.int64)
    starts, ends, h, docs = pretokens(raw, bounds)
    n = np.zeros(len(h), np.int64)
    miss = np.ones(len(h), bool)
    known, lengths = table.find(raw, starts, ends, h)
    n[known], miss[known] = lengths, False
    miss = np.flatnonzero(miss)
    if len(miss):
        _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
        one = miss[first][back]  # the first miss with the same hash
        odd = miss[~c.same_spans(raw, starts[miss], ends[miss], raw, starts[one], ends[one])]  # the same hash, other bytes
        at = np.concatenate([miss[first], odd])
        keys = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        cache = lib.misses
        new = [k for k in dict.fromkeys(keys) if k not in cache]
        got = dict(zip(new, lib.pretoken_lengths([k.decode() for k in new])))
        values = np.array([got[k] if k in got else cache[k] for k in keys], np.int64)
        n[miss] = values[: len(first)][back]
        n[odd] = values[len(first) :]
        if len(cache) + len(got) > CACHE:
            cache.clear()
        cache.update((k, v) for k, v in got.items() if len(k) <= LONGEST)
    total = np.concatenate([[0], np.cumsum(n)])
    out = total[docs[1:]] - total[docs[:-1]]
    if MARK.encode() in data:
        for d in range(n_docs):
            if MARK.encode() in (own := data[bounds[d] : bounds[d + 1]]):
                out[d] = lib.lengths([own.decode()])[0]
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op9: bytes and tokens of every document."""
    out = count_tokens(c.read(spark, sf_dir, "documents"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
