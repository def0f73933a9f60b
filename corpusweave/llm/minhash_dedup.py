"""MinHash near-dedup with circulant permutations.

A document's set: the distinct hashes of its word k-shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``); with fewer
words, the whole sequence as one. Two permutations of the 32-bit integers make all coordinates of a signature: the first
scatters the shingles, the second is applied after a circular shift by the coordinate's number, h_i = min P(S(x) + i).
BANDS bands of ROWS coordinates are keys; a pair of Jaccard similarity s shares one with probability
1 - (1 - s**ROWS)**BANDS, at 0.8 more than 0.9999.

Sets are compared by shingle hashes of 61 bits, whose words enter by a hash keyed by a secret that the driver draws for each run, so
no text can be made to collide; signatures, which only propose pairs, are made of hashes without a key and are the same in every run.

1. Documents with equal sets are one class, known by two 64-bit sums over the set; one of its texts stands for it.
2. Stars: in every bucket of a band key the members are confirmed against the bucket's first class, on full sets.
   Components of the confirmed links merge most of each group of copies.
3. The rest: buckets that still hold several components are opened. What they connect is a group (a bucket alone, where
   that would be more than GROUP members). Similar sets have similar sizes, so a group is parted into size classes of which only
   equal and adjacent ones meet, and these into chunks of bounded bytes. A task gets the texts of two chunks, once each, and finds the links
   between different components by products of incidence matrices; it returns a spanning forest: at most a row for each member,
   however many pairs are similar. Pairs that share no band aren't links, whatever the group, so links don't depend on
   how groups are cut.
Confirming stars deals rows by (leader, salt), each salt of a bounded number of members, and streams them past the leader's set,
so a hot leader is no hot task and no group is held.

Defined cases: a null or wordless text has an empty set, is linked with nothing and is kept. A row with a null id is linked
with nothing, has a null component and is kept. Rows of one id are one node of the graph, each with its own text's links. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from secrets import randbits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import connected_components
from .embedding_dedup import forest

SHINGLE, SIMILARITY = 5, (80, 100)
BANDS, ROWS = 36, 6
SALT = 200  # members in one stretch of a leader
GROUP = 4096  # members of a group that isn't a single bucket
CHUNK, CHUNK_SHINGLES = 1024, 1_000_000  # members and shingles of a chunk
BLOCK, BLOCK_SHINGLES = 512, 400_000  # of what one product compares
U32 = np.uint32


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, of 32-bit integers."""
    x = x ^ (x >> U32(16))
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def shingle_hashes(raw: np.ndarray, bounds: np.ndarray, k: int, secret: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and the documents' bounds. secret: keys the words' hashes."""
    raw = c.LOWER[raw]
    starts, ends, docs = c.word_bounds(raw, bounds, c.WHITESPACE_WORD)
    words = c.span_hashes(raw, starts, ends, secret)
    at = np.flatnonzero(c.gram_starts(docs, k))
    h, doc = [c.gram_hashes(words, k)[at]], [np.searchsorted(docs, at, "right") - 1]
    sizes = np.diff(docs)
    for n in range(1, k):  # short texts: the whole sequence
        own = np.flatnonzero(sizes == n)
        if len(own):
            h.append(c.gram_hashes(words, n)[docs[:-1][own]])
            doc.append(own)
    h, doc = np.concatenate(h), np.concatenate(doc)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(bounds)))


def signatures(h: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """(documents, coordinates) minima; documents without shingles get the largest value."""
    out = np.full((len(bounds) - 1, coordinates), 0xFFFFFFFF, U32)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    s = scatter(h.astype(U32))
    step = 1 << 15  # documents whose shingles stay in the processor's cache while all coordinates are made
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(bounds[some + 1], bounds[some[i]] + step, "right")))
        own = s[bounds[some[i]] : bounds[some[j - 1] + 1]]
        cut = bounds[some[i:j]] - bounds[some[i]]
        x = np.empty_like(own)
        t = np.empty_like(own)
        for k in range(coordinates):
            np.add(own, U32(k), out=x)
            np.right_shift(x, U32(15), out=t)
            np.bitwise_xor(x, t, out=x)
            np.multiply(x, U32(0x2C1B3C6D), out=x)
            np.right_shift(x, U32(12), out=t)
            np.bitwise_xor(x, t, out=x)
            np.multiply(x, U32(0x297A2D39), out=x)
            np.right_shift(x, U32(15), out=t)
            np.bitwise_xor(x, t, out=x)
            out[some[i:j], k] = np.minimum.reduceat(x, cut)
        i = j
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit keys, the band's number included."""
    x = sig.reshape(len(sig), bands, rows).astype(c.U64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=c.U64), (len(sig), bands)).copy()
    for r in range(rows):
        out = c.mix(out * c.U64(0x9E3779B97F4A7C15) + x[:, :, r])
    return out.view(np.int64)


def _sets(k: int, bands: int, rows: int, secret: int):
    def run(batches):
        for b in batches:
            raw, bounds = c.texts_of(b, "text")
            parts = []
            for i, j in c.slices(bounds):
                text, cut = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                h, own = shingle_hashes(text, cut, k, secret)
                sums = [np.concatenate([[c.U64(0)], np.cumsum(c.mix(h + c.U64(salt)), dtype=c.U64)]) for salt in (1, 2)]
                keys = [(s[own[1:]] - s[own[:-1]]).view(np.int64) for s in sums]
                parts.append((np.diff(own), *keys, band_keys(signatures(*shingle_hashes(text, cut, k), bands * rows), bands, rows)))
            n, k1, k2, keys = (np.concatenate([p[i] for p in parts]) for i in range(4)) if parts else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), c.list_array(keys.ravel(), np.full(len(n), bands), pa.int64())], ["doc_id", "text_hash", "n", "k1", "k2", "bands"])

    return run


def _confirm(k: int, least: int, of: int, secret: int):
    """Rows sorted by leader, salt, role: the leader's text (role 0), then members' texts. Yields confirmed links."""

    def run(batches):
        leader, own = None, np.zeros(0, c.U64)
        for b in batches:
            raw, bounds = c.texts_of(b, "text")
            heads, roles, ids = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("leader", "role", "id"))
            out: list[tuple[int, int]] = []
            for i, j in c.slices(bounds):
                h, at = shingle_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], k, secret)
                for d in range(i, j):
                    x = h[at[d - i] : at[d - i + 1]]
                    if roles[d] == 0:
                        leader, own = heads[d], x.copy()
                    elif leader == heads[d]:
                        both = int(np.count_nonzero(c.member(x, own)))
                        if both and of * both >= least * (len(x) + len(own) - both):
                            out.append((int(leader), int(ids[d])))
            a, m = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(m, pa.int64())], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, similarity: tuple[int, int], secret: int = 0) -> DataFrame:
    """The pairs (a leader, b member; ids of texts) whose full sets are similar enough. texts: id, text."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    wanted = dealt.select(F.col("b").alias("id"), F.col("a").alias("leader"), "salt", F.lit(1).alias("role")).union(sizes.select(F.col("a").alias("id"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role")))
    rows = wanted.join(texts, "id").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role")
    return c.map_batches(rows, _confirm(k, *similarity, secret), "a bigint, b bigint")


def stars(buckets: DataFrame) -> DataFrame:
    """a, b: in every bucket each member with the smallest class, if their sizes allow the similarity."""
    heads = buckets.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head")).select("key", "head.rep", "head.n").toDF("key", "a", "a_n")
    pair = buckets.join(heads, "key")
    return pair.where("rep <> a and 100 * least(n, a_n) >= 80 * greatest(n, a_n)").select("a", F.col("rep").alias("b")).distinct()


def open_groups(buckets: DataFrame, most: int) -> DataFrame:
    """gkey, rep, component, n: groups in which pairs of different components may still be links.

    Members of buckets with several components, grouped by what such buckets connect; where that is more than most members,
    by bucket.
    """
    facts = buckets.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("head")).where("low <> high").select("key", "head")
    rows = c.staged(buckets.join(facts, "key").select("key", "rep", "component", "n", "head"), "open-buckets")
    groups = connected_components(rows.select(F.col("rep").alias("a"), F.col("head").alias("b"))).toDF("rep", "group")
    sizes = groups.groupBy("group").agg((F.count("*") > most).alias("large"))
    rows = rows.join(groups.join(sizes, "group"), "rep")
    small = rows.where("not large").select(F.col("group").alias("gkey"), "rep", "component", "n").distinct()
    return small.unionByName(rows.where("large").select(F.col("key").alias("gkey"), "rep", "component", "n"))


class Members:
    """Sets with their components and band keys."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.ids, self.components = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.bands = np.array([r[2] for r in rows])
        self.sets = [r[3] for r in rows]
        self.sizes = np.array([len(x) for x in self.sets])

    def cut(self) -> list[tuple[int, int]]:
        """Ranges of at most BLOCK members and BLOCK_SHINGLES shingles, or one member."""
        total, out, i = np.cumsum(self.sizes), [], 0
        while i < len(self.sizes):
            j = int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK_SHINGLES, "right"))
            out.append((i, max(i + 1, min(j, i + BLOCK))))
            i = out[-1][1]
        return out


def block_links(x: Members, a: tuple[int, int], y: Members, b: tuple[int, int], least: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): members a of x and b of y that are links between different components, from the sets' incidence matrices."""
    none = np.zeros(0, np.int64)
    other = x.components[slice(*a)][:, None] != y.components[slice(*b)][None]
    if not other.any():
        return none, none
    left, right = np.concatenate(x.sets[slice(*a)]), np.concatenate(y.sets[slice(*b)])
    common = np.intersect1d(left, right)
    both = np.zeros(other.shape, np.float32)

    def incidence(h: np.ndarray, sizes: np.ndarray):
        at = np.searchsorted(common, h)
        at[at == len(common)] = 0
        keep = common[at] == h
        code, doc = at[keep], np.repeat(np.arange(len(sizes)), sizes)[keep]
        order = np.argsort(code, kind="stable")
        return code[order], doc[order]

    if len(common):
        sides = [incidence(left, x.sizes[slice(*a)]), incidence(right, y.sizes[slice(*b)])]
        step = max(256, (8 << 20) // (4 * max(other.shape)))
        for lo in range(0, len(common), step):
            m = []
            for (code, doc), n in zip(sides, other.shape):
                p, q = np.searchsorted(code, (lo, lo + step))
                one = np.zeros((n, step), np.float32)
                one[doc[p:q], code[p:q] - lo] = 1
                m.append(one)
            both += m[0] @ m[1].T
    sizes = x.sizes[slice(*a)][:, None] + y.sizes[slice(*b)][None]
    i, j = np.nonzero((of * both >= least * (sizes - both)) & (both > 0) & other)
    i, j = i + a[0], j + b[0]
    share = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        share[k : k + (1 << 14)] = (x.bands[i[k : k + (1 << 14)]] == y.bands[j[k : k + (1 << 14)]]).any(axis=1)
    return i[share], j[share]


def tile_links(x: Members, y: Members | None, least: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a spanning forest of the links between two chunks, or inside one (y None), as ids."""
    left, right = [], []
    n = len(x.ids)
    for p, a in enumerate(x.cut()):
        for b in x.cut()[p:] if y is None else y.cut():
            i, j = block_links(x, a, x if y is None else y, b, least, of)
            left.append(i), right.append(j if y is None else j + n)
    ids = x.ids if y is None else np.concatenate([x.ids, y.ids])
    label = forest(len(ids), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _blocks(k: int, least: int, of: int, secret: int):
    """Rows sorted by (gkey, lo, hi): all links between components inside each tile of two chunks."""

    def run(batches):
        at, held = None, ([], [])

        def flush():
            if held[0] and (held[1] if at[1] != at[2] else len(held[0]) > 1):
                links = tile_links(Members(held[0]), Members(held[1]) if at[1] != at[2] else None, least, of)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

        for b in batches:
            raw, bounds = c.texts_of(b, "text")
            get = lambda x: b.column(b.schema.get_field_index(x)).to_pylist()
            keys, rows = list(zip(get("gkey"), get("lo"), get("hi"))), list(zip(get("rep"), get("component"), get("bands"), get("own")))
            for i, j in c.slices(bounds):
                h, own = shingle_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], k, secret)
                for d in range(i, j):
                    if keys[d] != at:
                        yield from flush()
                        at, held = keys[d], ([], [])
                    rep, component, bands, chunk = rows[d]
                    held[chunk != at[1]].append((rep, component, np.array(bands), h[own[d - i] : own[d - i + 1]].copy()))
        if at is not None:
            yield from flush()

    return run


def rest(buckets: DataFrame, classes: DataFrame, texts: DataFrame, k: int, similarity: tuple[int, int], secret: int = 0) -> DataFrame:
    """a, b: the links between different components, of which no pair is made outside a numpy block."""
    groups = open_groups(buckets, GROUP).withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(1.01 * similarity[1] / similarity[0])).cast("bigint"))
    groups = c.staged(groups, "open-groups")
    chunks = groups.groupBy("gkey", "size").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("bigint").alias("chunks"))
    number = lambda size, chunk: F.col(size) * (1 << 32) + chunk
    # sets of sizes that allow the similarity are in the same class or in adjacent ones (1.01: whatever the rounding)
    near = chunks.withColumn("mine", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    near = near.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    near = near.select("gkey", F.col("mine"), number("size", F.col("chunk")).alias("other"))
    rows = groups.join(chunks, ["gkey", "size"]).withColumn("own", number("size", F.pmod(F.xxhash64("rep"), F.col("chunks")))).withColumnRenamed("size", "mine").join(near, ["gkey", "mine"])
    rows = rows.select("gkey", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", F.col("rep").alias("id"), "rep", "component")
    own = c.staged(groups.select("rep").distinct(), "open-members")  # of a size that the joins know
    few = texts.join(own.withColumnRenamed("rep", "id"), "id", "left_semi").join(classes.join(own, "rep", "left_semi").select(F.col("rep").alias("id"), "bands"), "id")
    dealt = rows.join(few, "id").drop("id").repartition("gkey", "lo", "hi").sortWithinPartitions("gkey", "lo", "hi")
    return c.map_batches(dealt, _blocks(k, *similarity, secret), "a bigint, b bigint")


def dedup(docs: DataFrame, k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text). similarity: fraction, 80/100 or more."""
    if similarity[0] * 100 < 80 * similarity[1]:
        raise ValueError("the bands are made for similarities of 0.8 or more")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("bigint"))  # tells texts of one id apart
    secret = randbits(63)
    sets = c.staged(c.map_batches(docs.select("doc_id", "text_hash", "text"), _sets(k, bands, rows, secret), "doc_id bigint, text_hash bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"), "sets")
    linked = sets.where("doc_id is not null and n > 0")
    classes = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = c.staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbers are fixed by writing them
    members = c.staged(sets.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", "rep", "first"), ["k1", "k2"], "left").drop("k1", "k2"), "members")
    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    buckets = c.staged(keys.join(shared, "key"), "buckets")
    wanted = c.staged(classes.select("rep", F.col("first").alias("doc_id"), "text_hash").join(buckets.select("rep").distinct(), "rep", "left_semi"), "wanted")
    needed = c.staged(wanted.select("doc_id").distinct(), "needed")  # written, so that the join knows its size; ids alone, so that it's small
    some = docs.join(needed, "doc_id", "left_semi").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    texts = c.staged(some.join(wanted, ["doc_id", "text_hash"]).select(F.col("rep").alias("id"), "text"), "texts")
    pairs = c.staged(stars(buckets), "pairs")
    links = c.staged(confirmed(pairs, texts, k, similarity, secret), "links")
    # rows of one id are one node: their classes are linked
    known = members.where("doc_id is not null and n > 0")
    several = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").drop("most")
    same = c.staged(known.join(several, "doc_id").select("a", F.col("rep").alias("b")), "same-ids")
    parts = connected_components(links.union(same)).withColumnRenamed("node", "rep")
    merged = buckets.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = c.staged(rest(merged, classes, texts, k, similarity, secret), "links")
    if not more.isEmpty():
        parts = connected_components(links.union(same).union(more)).withColumnRenamed("node", "rep")
    lowest = parts.join(classes.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("component_id"))
    labels = c.staged(parts.join(lowest, "component").select("rep", "component_id"), "labels")
    c.unstage(sets, classes, buckets, wanted, needed, texts, pairs, links, same, more)
    out = members.join(labels, "rep", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "first")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: near-duplicate components of all documents, on 4-word shingles."""
    return dedup(c.read(spark, sf_dir, "documents"), k=4)


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') as x from d, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) t(i)),
n as (select doc_id, count(*) as n from g group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
r as (select doc_id, doc_id as dest from n union select r.doc_id, l.b from r join l on l.a = r.dest),
c as (select doc_id, min(dest) as low from r group by 1)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(low, d.doc_id) as component_id, coalesce(low, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join c using (doc_id)
"""
