"""BPE encoding and decoding with a contiguous rank array.

A vocabulary file with word ends (``</w>``) is read for its tokens and merge ranks; the encoder is this module's own. A
word is an array of part boundaries with the rank of the merge of each part and its right neighbour beside them. The
smallest rank is found by a scan (the leftmost of equal ones), its right boundary is deleted and the ranks to the left and
right are refreshed, until no rank is left. Words are short, so scanning beats a heap.

A word of more than LONG bytes (a text without spaces, say) takes the same merges in the same order from a heap of
(rank, place) over a linked list of parts, in linear-logarithmic time.

The text rules are those of the vocabulary file: strings of special tokens are cut out first; the rest is NFC-normalised,
lower-cased character by character, and split into contractions, letter runs, single digits and other runs; white space is
dropped. None of these looks across white space, so a white-space-delimited chunk has the same ids wherever it stands,
and workers keep the ids of short chunks in a bounded cache of two generations. Normal forms, case and classes of letters
depend on the version of the Unicode tables. Chunks of characters that are the same in all of them (OLD) are
handled by Python's; any other chunk is normalised and split by the rules of the file as the library itself loads them. The
ids of its words are this module's in both cases.

Defined cases: null is the empty text, with no ids and the decoded text ``""``. Lone surrogates can't occur in Spark
strings. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

VOCABULARY = "word_bpe_49k.json"
#: Entries of one cache generation; a worker holds two.
CACHE = 120_000
# The white space of the Unicode standard, and the split pattern of the vocabulary file.
SPACE = "\x09-\x0d\x20\x85\xa0  -     　"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
#: str.split() also splits at these, which are no white space to the pattern.
ODD = regex.compile("[\x1c-\x1f]")
#: Characters that have had their class, case and normal form since long before any Unicode version in use.
OLD = regex.compile("[\x00-\x7e\xa0-\u0220\u0222-\u0233\u0250-\u02ad\u0300-\u0345\u0384-\u038a\u038e-\u03a1\u03a3-\u03ce\u0401-\u040c\u040e-\u044f\u0451-\u045c\u045e-\u0481\u2010-\u2027\u2030-\u2046\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
NONE = 1 << 30
#: Bytes from which a word's merges are taken from a heap, and characters of a chunk from which it isn't cached.
LONG, UNCACHED = 256, 128


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Generations(dict):
    """A cache that forgets: when CACHE entries are in, they become the old generation and a new one begins."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    def __init__(self, path: str, suffix: str = "</w>"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.path = path
        self.letters = byte_letters()
        self.first = [vocab[x] for x in self.letters]
        self.last = [vocab[x + suffix] for x in self.letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        #: (left id, right id) -> rank << 32 | id of the merged token
        self.ranks = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.chunks = Generations(self._chunk)
        self.cached = Generations(self._word)
        self.rules = None

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        parts = [self.first[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        parts = self._merged(parts) if len(parts) > LONG else self._scanned(parts)
        return b"".join(p.to_bytes(4, "little") for p in parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        get = self.ranks.get
        none = NONE << 32
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best >= none:
                break
            i = ranks.index(best)
            parts[i] = best & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merged(self, parts: list[int]) -> list[int]:
        """The merges of _scanned in the same order: the smallest rank, the leftmost of equal ones."""
        get, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(best, i) for i, p in enumerate(zip(parts, parts[1:])) if (best := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get((parts[i], parts[j])) != best:
                continue  # a part of this pair has been merged since
            parts[i], parts[j] = best & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (new, i))
            if (k := before[i]) >= 0 and (new := get((parts[k], parts[i]))) is not None:
                heapq.heappush(heap, (new, k))
        return [p for p in parts if p >= 0]

    def _split(self, chunk: str) -> list[str]:
        """The normalised words of a chunk."""
        if OLD.fullmatch(chunk):
            text = unicodedata.normalize("NFC", chunk)
            return self.words.findall(text.replace("Σ", "σ").lower())  # a final sigma is no case of its own here
        if self.rules is None:
            from tokenizers import Tokenizer

            file = Tokenizer.from_file(self.path)
            self.rules = file.normalizer, file.pre_tokenizer[0]
        return [w for w, _ in self.rules[1].pre_tokenize_str(self.rules[0].normalize_str(chunk))]

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(self.cached[w] if len(w) <= UNCACHED else self._word(w) for w in self._split(chunk))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is not None and any(x in text for x in self.special):
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if ODD.search(text):
            return self._chunk(text)
        return b"".join(self.chunks[x] if len(x) <= UNCACHED else self._chunk(x) for x in text.split())

    def decode(self, ids: bytes) -> str:
        """The file has no decoder: tokens stand apart by one space, special ones included."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of docs with a text, and ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    path: the vocabulary file, the same on every worker; by default the installed public one. Columns of docs that are
    called ids or decoded give way to the results.
    """
    docs = docs.drop("ids", "decoded").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        own = codec(_path(path))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            step = 64
            for i in range(0, len(texts), step):
                ids = [own.encode(t) if t else b"" for t in texts[i : i + step]]
                part = batch.slice(i, step)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())], [*batch.schema.names, "ids", "decoded"])

    return c.map_batches(docs, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: ids and round trip of every document."""
    out = encode_decode(c.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
