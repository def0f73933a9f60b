"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``window`` consecutive words of one document. Every word that
is covered by a window whose word sequence also starts in a document with a smaller id is removed; repeated windows merge
into maximal removal intervals. Windows are judged on the input, not on what is left.

The plan. Documents are dealt to blocks whose ranks rise with the id, by cumulated bytes; an id that holds many rows is a
rank of its own, in several blocks.
1. Each task hashes all windows of its blocks and sends one row for each (block, hash range) with the distinct hashes,
   packed. However often a passage stands in a block, it's sent once: a hot passage can't swell a range.
2. Each hash range meets in one group of bounded size (the number of ranges follows the bytes). The smallest rank with a hash
   owns it; every block of another rank gets it back as removable, a block of the owner's rank gets it back if it has it more
   than once.
3. Each block takes its documents (the same shuffle as in 1) and its hashes, and decides: a removable hash goes, an owned
   one goes in all documents but those with the block's smallest id.
Nothing is collected; a group is a block or a hash range, both of bounded size. A window is known by 85 bits: a Rabin-Karp hash of 61
bits and 24 bits of a second one with another base, modulo a prime. Words enter each by a hash of their own, keyed by a secret that the driver
draws for each run, so no text can be made to collide. Two given windows agree with a chance of 2**-85; among the 2e13 windows of 100 TB of
text a few pairs of different windows are expected to.

Blocks need rows that come in the same order again: if docs isn't a scan, it's written first.

Defined cases: a null text has no words; a null id comes after all others (rows with null ids never remove from each
other); rows with the same id never remove from each other; documents shorter than a window lose nothing; extra columns
are ignored.
"""

from __future__ import annotations

from secrets import randbits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.partition import is_scan
from . import common as c

WINDOW = 13
#: Text bytes of a block, of a hash range, of what a task gathers before it sends, and of a shuffle's partition.
BLOCK_BYTES, RANGE_BYTES, FLUSH_BYTES, TASK_BYTES = 4 << 20, 8 << 20, 8 << 20, 16 << 20
PARTITIONS = 1 << 16  # of a shuffle at most; more bytes make larger ones
LAST = (1 << 63) - 1
U32 = np.uint32


def _three(checks: np.ndarray) -> bytes:
    """The three low bytes of each."""
    return np.ascontiguousarray(checks).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _four(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.reshape(-1).view(U32)


def window_hashes(raw: np.ndarray, bounds: np.ndarray, k: int, secret: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, second hash and first word of every window, and the documents' bounds in words."""
    starts, ends, docs = c.word_bounds(raw, bounds, c.WHITESPACE_WORD)
    at = np.flatnonzero(c.gram_starts(docs, k))
    one, two = (c.gram_hashes(c.span_hashes(raw, starts, ends, s), k, i)[at] for i, s in enumerate(secret))
    return one, (two >> c.U64(40)).astype(U32), at, docs


def _in_order(groups: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by group, hash, second hash; which of that order begin a new one)."""
    order = np.lexsort((hashes, groups))
    same = (hashes[order][1:] == hashes[order][:-1]) & (groups[order][1:] == groups[order][:-1])
    if (same & (checks[order][1:] != checks[order][:-1])).any():  # hashes that agree by chance
        order = np.lexsort((checks, hashes, groups))
        same = (hashes[order][1:] == hashes[order][:-1]) & (groups[order][1:] == groups[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    new = np.ones(len(order), bool)
    new[1:] = ~same
    return order, new


def _send(batches, k: int, ranges: int, secret: tuple[int, int]):
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        blocks, hashes, checks = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
        order, new = _in_order(blocks, hashes, checks)
        at = np.flatnonzero(new)
        again = np.diff(np.append(at, len(order))) > 1
        blocks, hashes, checks = (x[order][at] for x in (blocks, hashes, checks))
        part = (hashes >> c.U64(32)) * c.U64(ranges) >> c.U64(32)
        cut = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(part.astype(np.int64)) != 0)) + 1
        rows = [(int(part[a]), int(blocks[a]), c.pack_sorted(hashes[a:b]), _three(checks[a:b]), np.packbits(again[a:b]).tobytes() if again[a:b].any() else None) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(hashes)])]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows[i : i + 256]), kinds)], ["part", "block", "hashes", "checks", "again"])

    for batch in batches:
        raw, bounds = c.texts_of(batch, "text")
        block = batch.column(batch.schema.get_field_index("block")).to_numpy(zero_copy_only=False)
        for i, j in c.slices(bounds):
            h, check, at, docs = window_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], k, secret)
            if len(h):
                held.append((block[i:j][np.searchsorted(docs, at, "right") - 1], h, check))
            size += int(bounds[j] - bounds[i])
            if size >= FLUSH_BYTES and held:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _settle(table: pa.Table) -> pa.Table:
    """One hash range: for each block its removable hashes, and those of its rank that it has more than once."""
    table = table.sort_by("block")
    blocks = table["block"].to_numpy()
    hashes, checks, repeats = [], [], []
    for h, x, a in zip(table["hashes"], table["checks"], table["again"]):
        hashes.append(c.unpack_sorted(h.as_py()))
        checks.append(_four(x.as_py()))
        n = len(hashes[-1])
        repeats.append(np.unpackbits(np.frombuffer(a.as_py(), np.uint8), count=n).astype(bool) if a.is_valid else np.zeros(n, bool))
    block = np.repeat(blocks, [len(h) for h in hashes])
    h, check, repeat = np.concatenate(hashes), np.concatenate(checks), np.concatenate(repeats)
    del hashes, checks, repeats
    order, new = _in_order(np.zeros(len(h), np.int8), h, check)  # stable: in a hash, blocks rise
    h, check, block, repeat = h[order], check[order], block[order], repeat[order]
    rank = block >> c.PART_BITS
    removable = rank != rank[new][np.cumsum(new) - 1]
    own = ~removable & (repeat | ~new)  # a block that sent a hash twice has it twice
    rows = []
    for what, mask in ((0, removable), (1, own)):
        b, x, y = block[mask], h[mask], check[mask]
        by, first = _in_order(b, x, y)
        by = by[first]
        b, x, y = b[by], x[by], y[by]
        cut = np.flatnonzero(np.diff(b)) + 1
        if len(b):
            rows += [(int(b[s]), what, c.pack_sorted(x[s:e]), _three(y[s:e])) for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(b)])]
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "kind", "hashes", "checks"])


OUT = ["doc_id", "n_words", "starts", "ends", "kept"]


def _remove(k: int, secret: tuple[int, int]):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        sets = [([], []), ([], [])]
        for kind, h, check in zip(marks["kind"].to_pylist(), marks["hashes"], marks["checks"]):
            sets[kind][0].append(c.unpack_sorted(h.as_py()))
            sets[kind][1].append(_four(check.as_py()))
        tables = []
        for hashes, checks in sets:
            h, check = (np.concatenate(hashes), np.concatenate(checks)) if hashes else (np.zeros(0, c.U64), np.zeros(0, U32))
            order, new = _in_order(np.zeros(len(h), np.int8), h, check)
            tables.append((h[order[new]], check[order[new]]))
        removable, owned = tables
        batches = docs.to_batches(max_chunksize=c.BATCH_ROWS)
        least = np.full(len(owned[0]), LAST)  # the smallest id that has an owned hash
        scanned = []
        for b in batches:
            raw, bounds = c.texts_of(b, "text")
            key = b.column(b.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            for i, j in c.slices(bounds):
                h, check, at, words = window_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], k, secret)
                keys = key[i:j][np.searchsorted(words, at, "right") - 1]
                place = c.places(h, check, *owned)
                mine = np.flatnonzero(place >= 0)
                place = place[mine]
                np.minimum.at(least, place, keys[mine])
                go = c.places(h, check, *removable) >= 0
                scanned.append((at[go], at[mine], place, keys[mine], words))
        out = [[] for _ in OUT]
        turn = iter(scanned)
        for b in batches:
            raw, bounds = c.texts_of(b, "text")
            ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            data = raw.tobytes()
            for i, j in c.slices(bounds):
                go, mine, place, keys, words = next(turn)
                gone = c.covered(np.concatenate([go, mine[least[place] < keys]]), k, int(words[-1]))
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                for d in range(i, j):
                    a, z = int(words[d - i]), int(words[d - i + 1])
                    text = data[bounds[d] : bounds[d + 1]].split()
                    own = gone[a:z]
                    if own.any():
                        edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                        s, e = edge[::2].tolist(), edge[1::2].tolist()
                        text = [w for w, x in zip(text, own.tolist()) if not x]
                    else:
                        s, e = [], []
                    for col, x in zip(out, (ids[d], z - a, s, e, b" ".join(text).decode())):
                        col.append(x)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], OUT)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_words, the removed word intervals [starts, ends) and the kept text of every document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs, total = c.order_blocks(docs if is_scan(docs) else c.staged(docs, "docs"), "key", block_bytes)
    secret = randbits(63), randbits(63)
    ranges = max(64, -(-total // range_bytes))
    tasks = min(PARTITIONS, -(-total // TASK_BYTES))  # more than the session's number only where the bytes ask for it
    deal = lambda df, by: df.repartition(tasks, by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(by)
    dealt = deal(docs, "block")
    sent = c.map_batches(dealt, lambda it: _send(it, window, ranges, secret), "part bigint, block bigint, hashes binary, checks binary, again binary")
    marks = deal(sent, "part").groupBy("part").applyInArrow(_settle, "block bigint, kind int, hashes binary, checks binary")
    return dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_remove(window, secret), "doc_id bigint, n_words bigint, starts array<int>, ends array<int>, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what substring dedup removes from every document."""
    out = dedup_substrings(c.read(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as x from d, unnest(range(1, len(w) - 11)) t(i)),
f as (select x, min(doc_id) as first from g group by 1),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from g join f using (x) where first < doc_id),
r as (select doc_id, count(*) as n_removed from gone group by 1),
v as (select doc_id, i as p, w[i] as word from d, unnest(range(1, len(w) + 1)) t(i)),
k as (select doc_id, string_agg(word, ' ' order by p) as kept from v anti join gone using (doc_id, p) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join r using (doc_id) left join k using (doc_id)
"""
