"""Benchmark decontamination by winnowing.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Every ``window`` consecutive words of a
benchmark item are one window; an item with fewer words, but at least one, is one shorter window.

Winnowing: of the ``window - k + 1`` word k-grams in a window the smallest hash is kept. Equal windows keep equal hashes,
so every shared span of ``window`` words meets in the join of document and benchmark fingerprints. A hit is then extended
to the windows around it: the whole window is looked up by its hash and compared word by word. Items shorter than a
window are looked up as whole spans of their own length.

A benchmark of at most ``broadcast_bytes`` of text is broadcast as arrays (five to ten times its text): fingerprints, and
for each window a hash, its place in one text and the texts that have it; items of one text are one text with several ids. Documents stream
past it without a shuffle: a document gathers the distinct windows that it has, then their distinct texts, then these texts' ids. A larger
benchmark never comes to the driver: its fingerprints and windows are made in tasks and staged, the distinct fingerprints of each
text are joined with them, and only texts that hit send the windows around their hits to be compared, by an equi-join on
the window's words. Both ways give the same rows.

Defined cases: null or wordless texts have no words, no hits and are not contaminated; items that are null or wordless
hit nothing; items with a null id hit words but are not listed; repeated items count once for each distinct id; repeated
document rows are judged each for itself; an empty benchmark contaminates nothing. All columns of docs come back in a
struct, so no name clashes with the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text up to which it's broadcast.
BROADCAST_BYTES = 8 << 20


def normal(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and their bounds there, so that a run of words is one span."""
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(to[-1] + sizes[-1]) if len(sizes) else 0, 0x20, np.uint8)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + place] = raw[np.repeat(starts, sizes) + place]
    return out, to, to + sizes


class Index:
    """Fingerprints and windows of a benchmark, in arrays."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW, k: int = GRAM):
        self.window, self.k = window, k
        by: dict[str, set] = {}
        for i, text in items:
            by.setdefault(text or "", set()).add(i)
        texts = [text.encode() for text in by]
        #: the ids of each distinct text
        self.ids = [np.array(sorted(x for x in ids if x is not None), np.int64) for ids in by.values()]
        raw = c.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        starts, ends, docs = c.word_bounds(raw, np.cumsum([0, *map(len, texts)]), c.ALNUM_WORD)
        self.raw, starts, ends = normal(raw, starts, ends)
        words = c.span_hashes(self.raw, starts, ends)
        counts = np.diff(docs)
        prints = c.gram_starts(docs, window)
        self.prints = np.unique(winnowed(c.gram_hashes(words, k), window - k + 1)[prints])
        #: for each size: sorted hashes of windows, their bounds in raw, and the texts that have them as a list of ranges
        self.spans = {}
        for size in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            if size == window:
                at = np.flatnonzero(prints)
                text = np.searchsorted(docs, at, "right") - 1
            else:
                text = np.flatnonzero(counts == size)
                at = docs[:-1][text]
            h = c.gram_hashes(words, size)[at]
            order = np.lexsort((text, h))
            h, text, s, e = h[order], text[order], starts[at[order]], ends[at[order] + size - 1]
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & c.same_spans(self.raw, s[1:], e[1:], self.raw, s[:-1], e[:-1])
            again = same.copy()
            again[1:] &= text[1:] == text[:-1]
            first = np.flatnonzero(~same[~again])
            h, s, e, text = h[~again], s[~again], e[~again], text[~again]
            self.spans[size] = (h[first], *(x.astype(np.int32) for x in (s[first], e[first], np.append(first, len(h)), text)))

    def ids_of(self, size: int, windows: np.ndarray) -> np.ndarray:
        """The distinct texts of distinct windows."""
        *_, ranges, text = self.spans[size]
        n = ranges[windows + 1] - ranges[windows]
        return np.unique(text[np.repeat(ranges[windows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w consecutive k-gram hashes."""
    n = len(grams) - w + 1
    if n <= 0:
        return grams[:0]
    out = grams[:n].copy()
    for i in range(1, w):
        np.minimum(out, grams[i : i + n], out=out)
    return out


class Words:
    """The words of a slice of texts: hashes, bounds in normalised text, and the texts' bounds in words."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        raw = c.LOWER[raw]
        starts, ends, self.docs = c.word_bounds(raw, bounds, c.ALNUM_WORD)
        self.raw, self.starts, self.ends = raw, starts, ends
        self.hashes = c.span_hashes(raw, starts, ends)

    def text(self, at: int, size: int) -> bytes:
        return b" ".join(self.raw[s:e].tobytes() for s, e in zip(self.starts[at : at + size], self.ends[at : at + size]))

    def prints(self, window: int, k: int) -> np.ndarray:
        """The fingerprint of the window that starts at each word."""
        return winnowed(c.gram_hashes(self.hashes, k), window - k + 1)


def hits(words: Words, index: Index):
    """(size, first words, windows) of every hit, for each size: a word once for each window of the benchmark that equals the one there."""
    raw, starts, ends = normal(words.raw, words.starts, words.ends)
    for size, (table, first, last, *_) in index.spans.items():
        ok = c.gram_starts(words.docs, size)
        at = np.flatnonzero(ok & c.member(words.prints(size, index.k), index.prints) if size == index.window else ok)
        grams = c.gram_hashes(words.hashes, size)[at]
        place = np.searchsorted(table, grams)
        left = np.flatnonzero(place < len(table))
        found, windows = [], []
        while len(left):  # once, unless hashes in the table are equal
            left = left[table[place[left]] == grams[left]]
            a, w = at[left], place[left]
            real = c.same_spans(raw, starts[a], ends[a + size - 1], index.raw, first[w].astype(np.int64), last[w].astype(np.int64))
            found.append(a[real])
            windows.append(w[real])
            place[left] += 1
            left = left[place[left] < len(table)]
        if found:
            yield size, np.concatenate(found), np.concatenate(windows)


def runs_of(docs: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end words of the runs of hit words, none over the bounds of two documents."""
    edge = np.ones(len(hit) + 1, bool)
    np.not_equal(hit[1:], hit[:-1], out=edge[1:-1])
    edge[docs] = True
    return np.flatnonzero(edge[:-1] & hit), np.flatnonzero(edge[1:] & hit) + 1


def merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted word intervals [start, end) without overlaps."""
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


RESULTS = ("n_words", "item_ids", "starts", "ends")
KINDS = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))


def _results(batch: pa.RecordBatch, docs: list[tuple]) -> pa.RecordBatch:
    """row and the results of each document: n_words, items, first and past-the-end words of the hit runs."""
    columns = zip(*docs) if docs else [[]] * 4
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), *(pa.array(x, k) for x, k in zip(columns, KINDS))], ["row", *RESULTS])


def _scan(index):
    """All documents past a broadcast index."""

    def run(batches):
        own = index.value
        for batch in batches:
            raw, bounds = c.texts_of(batch, "text")
            out = []
            for i, j in c.slices(bounds):
                words = Words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                n, docs = int(words.docs[-1]), words.docs
                hit = np.zeros(n, bool)
                texts: dict[int, list[np.ndarray]] = {}
                for size, at, windows in hits(words, own):
                    if not len(at):
                        continue
                    hit |= c.covered(at, size, n)
                    pair = np.unique((np.searchsorted(docs, at, "right") - 1) * np.int64(len(own.spans[size][0])) + windows)
                    doc = pair // len(own.spans[size][0])
                    for x in np.split(pair, np.flatnonzero(np.diff(doc)) + 1):
                        texts.setdefault(int(x[0]) // len(own.spans[size][0]), []).append(own.ids_of(size, x % len(own.spans[size][0])))
                starts, ends = runs_of(docs, hit)
                cut = np.searchsorted(starts, docs)
                for d in range(j - i):
                    ids = np.unique(np.concatenate([own.ids[t] for t in np.unique(np.concatenate(texts[d])).tolist()])) if d in texts else []
                    out.append((int(docs[d + 1] - docs[d]), ids, starts[cut[d] : cut[d + 1]] - docs[d], ends[cut[d] : cut[d + 1]] - docs[d]))
            yield _results(batch, out)

    return run


def _windows(window: int, k: int):
    """Of benchmark items: every window with its fingerprint. item_id, size, print, hash, words."""

    def run(batches):
        for batch in batches:
            raw, bounds = c.texts_of(batch, "text")
            ids = batch.column(batch.schema.get_field_index("item_id")).to_pylist()
            for i, j in c.slices(bounds):
                words = Words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                prints = words.prints(window, k).view(np.int64)
                rows = []
                for d in range(j - i):
                    a, n = int(words.docs[d]), int(words.docs[d + 1] - words.docs[d])
                    size = min(n, window)
                    h = c.gram_hashes(words.hashes[a : a + n], size).view(np.int64).tolist() if n else []
                    rows += [(ids[i + d], size, int(prints[a + x]) if size == window else y, y, words.text(a + x, size).decode()) for x, y in enumerate(h)]
                for x in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows[x : x + 4096]), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["item_id", "size", "print", "hash", "words"])

    return run


def _prints(sizes: list[int], window: int, k: int):
    """Of documents: the distinct fingerprints of each text. t1, t2, size, print."""

    def run(batches):
        for batch in batches:
            raw, bounds = c.texts_of(batch, "text")
            keys = [batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("t1", "t2")]
            for i, j in c.slices(bounds):
                words = Words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                for size in sizes:
                    at = np.flatnonzero(c.gram_starts(words.docs, size))
                    h = (words.prints(window, k) if size == window else c.gram_hashes(words.hashes, size))[at]
                    doc = np.searchsorted(words.docs, at, "right") - 1
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[i:j][doc[new]]) for x in keys), pa.array(np.full(int(new.sum()), size, np.int32)), pa.array(h[new].view(np.int64))], ["t1", "t2", "size", "print"])

    return run


def _extended(window: int, k: int):
    """Of texts with their hit fingerprints: the windows that keep them. t1, t2, at, size, hash, words."""

    def run(batches):
        for batch in batches:
            raw, bounds = c.texts_of(batch, "text")
            get = lambda x: batch.column(batch.schema.get_field_index(x)).to_pylist()
            t1, t2, found = get("t1"), get("t2"), get("found")
            for d in range(batch.num_rows):
                words = Words(raw[bounds[d] : bounds[d + 1]], bounds[d : d + 2] - bounds[d])
                rows = []
                for size in {x["size"] for x in found[d]}:
                    hit = np.unique(np.array([x["print"] for x in found[d] if x["size"] == size], np.int64).view(c.U64))
                    grams = c.gram_hashes(words.hashes, size)
                    at = np.flatnonzero(c.member(words.prints(window, k) if size == window else grams, hit))
                    rows += [(t1[d], t2[d], x, size, h, words.text(x, size).decode()) for x, h in zip(at.tolist(), grams[at].view(np.int64).tolist())]
                for x in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows[x : x + 4096]), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["t1", "t2", "at", "size", "hash", "words"])

    return run


def _finish(batches):
    for batch in batches:
        raw, bounds = c.texts_of(batch, "text")
        get = lambda x: batch.column(batch.schema.get_field_index(x)).to_pylist()
        spans, items, counts = get("spans"), get("items"), []
        for i, j in c.slices(bounds):
            counts += np.diff(c.word_bounds(c.LOWER[raw[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i], c.ALNUM_WORD)[2]).tolist()
        runs = [merged([(x["at"], x["at"] + x["size"]) for x in s or ()]) for s in spans]
        yield _results(batch, [(n, sorted(i or []), [a for a, _ in r], [b for _, b in r]) for n, r, i in zip(counts, runs, items)])


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """row, text, spans and items of every document, by joins with the staged windows of the benchmark."""
    windows = c.staged(c.map_batches(benchmark, _windows(window, k), "item_id bigint, size int, print bigint, hash bigint, words string"), "benchmark-windows")
    prints = c.staged(windows.select("size", "print").distinct(), "benchmark-prints")
    sizes = [r.size for r in prints.select("size").distinct().collect()]  # at most one for each length up to a window
    docs = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    texts = docs.select("t1", "t2", "text")
    found = c.map_batches(texts, _prints(sizes, window, k), "t1 bigint, t2 bigint, size int, print bigint").join(prints, ["size", "print"])
    found = c.staged(found.groupBy("t1", "t2").agg(F.collect_set(F.struct("size", "print")).alias("found")), "hit-texts")
    some = texts.join(found, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    around = c.map_batches(some, _extended(window, k), "t1 bigint, t2 bigint, at int, size int, hash bigint, words string")
    around, key = c.staged(around, "around"), ["size", "hash", "words"]
    met = around.join(windows.select(*key).distinct(), key)
    spans = met.groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "size")).alias("spans"))  # one text's
    pairs = around.select("t1", "t2", *key).distinct().join(windows.where("item_id is not null").select(*key, "item_id").distinct(), key)
    items = pairs.select("t1", "t2", "item_id").distinct().groupBy("t1", "t2").agg(F.collect_list("item_id").alias("items"))
    real = c.staged(spans.join(items, ["t1", "t2"], "left"), "hits")
    c.unstage(windows, prints, found, around)
    return docs.join(real, ["t1", "t2"], "left").select("row", "text", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For every document: row (its columns as a struct), n_words, item_ids (sorted, distinct) and the hit word spans as
    merged [starts, ends).

    docs: text and any other columns; benchmark: item_id, text.
    """
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    docs = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    kinds = [T.StructField("n_words", T.LongType()), T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([docs.schema["row"], *kinds])
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= broadcast_bytes:
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in benchmark.collect()], window, k))
        return c.map_batches(docs, _scan(index), schema)
    return c.map_batches(_joined(docs, benchmark, window, k), _finish, schema)


def n_hit() -> F.Column:
    """Number of words in the merged spans."""
    return F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: contamination of every document by the benchmark."""
    out = decontaminate(c.read(spark, sf_dir, "documents").select("doc_id", "text"), c.read(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), c.hex_list("item_ids").alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
k as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as x from k, unnest(range(1, len(w) - n + 2)) t(i)),
s as (select distinct n from k),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as x from (select * from d, s where len(w) >= n) q, unnest(range(1, len(w) - n + 2)) t(i)),
h as (select distinct doc_id, i, n, item_id from dw join bw using (n, x)),
p as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1),
m as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from h where item_id is not null) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join m using (doc_id)
"""
