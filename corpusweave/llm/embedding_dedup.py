"""Embedding near-dedup by epsilon grid order join.

Cosine of at least ``threshold`` means that unit vectors lie within epsilon = sqrt(2 - 2 threshold). Unit vectors are
projected on their leading principal directions, and the norm of what is left is one coordinate more: a map that never lengthens a
distance. They are sorted by the grid cells (of width epsilon) of the leading coordinates, lexicographically: the epsilon
grid order. The sorted sequence is cut into groups, one for each range partition, and groups into blocks with bounding boxes. The
join recurses over intervals of the sequence: groups are paired, pairs whose boxes are farther apart than epsilon are
provably without links and skipped. A pair of groups is a tile, to which either group is sent once, so a vector is
sent as often as there are groups, whatever the number of blocks. Inside a tile the recursion goes on, over blocks down to leaves
of LEAF vectors, skipping what is distant. Between two leaves one small matrix product of these coordinates bounds all
cosines from above (the inner products of what is left by those norms); only pairs whose bound reaches the threshold have
their cosine computed, in double precision.

The directions come from a bounded sample of SAMPLE vectors; they decide only what is skipped, never a result. Copies of a vector
that stand together in the order are one node with a count, so copies aren't paired. A tile returns link counts
and a spanning forest of its links, at most a row for each vector, whatever the number of links.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths are never compared (the length is a side of the boxes, so their tiles are skipped). A null vec_id links
with nothing and has a null component. Rows with the same id are one node of the graph. Extra columns (label among them)
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .components import connected_components

THRESHOLD = 0.95
#: Principal directions, those of them that the grid order is of, and sides of a box (length, directions, norm of the rest).
DIRECTIONS, GRID, SIDES = 16, 6, 18
SAMPLE, SAMPLE_BYTES, LENGTHS = 4096, 32 << 20, 16  # vectors, bytes of the sample; lengths of vectors that have directions
SPAN_BITS, LEAF = 4, 512
#: Bytes of a block, of a group of blocks at most, and groups that are made if there are as many blocks.
BLOCK_BYTES, GROUP_BYTES, LEAST_GROUPS = 1 << 20, 16 << 20, 4
COPIES = 1 << 16  # copies that one node counts; more are further nodes
FAR = 1e6  # between the sides of two lengths


def directions(sample: np.ndarray, n: int) -> np.ndarray:
    """Leading principal directions (columns) of unit vectors."""
    if not len(sample):
        return np.zeros((sample.shape[1], 0))
    x = sample - sample.mean(0)
    _, v = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(v[:, ::-1][:, :n])


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares can't overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def coordinates(x: np.ndarray, v: np.ndarray | None) -> np.ndarray:
    """Projections of unit vectors, zeros for directions that are wanting, and the norm of the rest: DIRECTIONS + 1 columns."""
    out = np.zeros((len(x), DIRECTIONS + 1))
    if v is not None:
        out[:, : v.shape[1]] = x @ v
    out[:, -1] = np.sqrt(np.maximum(0, 1 - (out * out).sum(1)))
    return out


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _grid(v, eps: float, kind: str):
    """Rows with the cells and the vector as bytes."""

    def run(batches):
        for b in batches:
            vectors = b.column(b.schema.get_field_index("embedding"))
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(sizes)])
            cells = np.zeros((len(sizes), GRID), np.int32)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = flat[at[own][:, None] + np.arange(dim)]
                cells[own] = np.floor(coordinates(unit(x), v.value.get(int(dim)))[:, :GRID] / eps)
            data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((at * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
            grid = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, GRID, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in ("vec_id", "h1", "h2")), pa.array(sizes, pa.int32()), grid, data], ["vec_id", "h1", "h2", "dim", "cell", "vector"])

    return run


BLOCK = "grp bigint, seq bigint, dim int, lo array<double>, hi array<double>, ids binary, counts binary, vectors binary, rows binary, nodes binary"


def _blocks(v, size: int, kind: str):
    """Consecutive vectors of one length as one row: bounding box, node ids, counts, vectors; and the node of each row."""

    def run(batches):
        group, seq = TaskContext.get().partitionId(), 0
        held, last = [], None  # nodes: [id, count, vector]; (dim, h1, h2) of the last one
        rows, nodes = [], []

        def cut():
            nonlocal seq, held, rows, nodes
            dim = last[0]
            x = np.frombuffer(b"".join(n[2] for n in held), kind).reshape(-1, dim)
            y = coordinates(unit(x), v.value.get(dim))
            lo, hi = ([dim * FAR, *side] for side in ((y.min(0) - 1e-9).tolist(), (y.max(0) + 1e-9).tolist()))
            ids, counts = (np.array([n[i] for n in held], "<i8") for i in (0, 1))
            row = ([group], [seq], [dim], [lo], [hi], [ids.tobytes()], [counts.tobytes()], [x.tobytes()], [np.array(rows, "<i8").tobytes()], [ids[np.array(nodes)].astype("<i8").tobytes()])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 5)
            seq, held, rows, nodes = seq + 1, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(row, kinds)], [n.split(" ")[0] for n in BLOCK.split(", ")])

        for b in batches:
            get = lambda n: b.column(b.schema.get_field_index(n))
            keys = zip(get("dim").to_pylist(), get("h1").to_pylist(), get("h2").to_pylist())
            for key, id, data in zip(keys, get("vec_id").to_pylist(), get("vector").to_pylist()):
                same = held and key == last and data == held[-1][2] and held[-1][1] < COPIES
                if held and not same and (len(held) >= max(LEAF, size // key[0]) or key[0] != last[0]):
                    yield cut()
                if not same:
                    held.append([id, 0, data])
                last = key
                held[-1][1] += 1
                rows.append(id), nodes.append(len(held) - 1)
        if held:
            yield cut()

    return run


def near(a: str = "a", b: str = "b", eps: float = 0.0) -> F.Column:
    """Whether two boxes are at most eps apart."""
    gap = F.zip_with(F.arrays_zip(F.col(f"{a}_lo").alias("lo"), F.col(f"{a}_hi").alias("hi")), F.arrays_zip(F.col(f"{b}_lo").alias("lo"), F.col(f"{b}_hi").alias("hi")), lambda x, y: F.greatest(F.lit(0.0), x["lo"] - y["hi"], y["lo"] - x["hi"]))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps


def block_pairs(boxes: DataFrame, bits: int, eps: float) -> DataFrame:
    """a, b (a <= b): blocks whose boxes are near, by recursion over intervals of 2**SPAN_BITS children. boxes: block, lo, hi
    (arrays of SIDES numbers)."""
    levels = [boxes]
    for _ in range(max(1, -(-bits // SPAN_BITS))):
        down = levels[-1]
        lo, hi = [F.min(F.col("lo")[i]) for i in range(SIDES)], [F.max(F.col("hi")[i]) for i in range(SIDES)]
        levels.append(down.groupBy(F.shiftright("block", SPAN_BITS).alias("block")).agg(F.array(*lo).alias("lo"), F.array(*hi).alias("hi")))
    top = levels[-1]
    pairs = top.select(F.col("block").alias("a"), F.col("block").alias("b"))  # bits are used up: the root alone
    for level in reversed(levels[:-1]):
        one = level.select(F.shiftright("block", SPAN_BITS).alias("a"), F.col("block").alias("na"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
        two = level.select(F.shiftright("block", SPAN_BITS).alias("b"), F.col("block").alias("nb"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
        pairs = pairs.join(one, "a").join(two, "b").where((F.col("na") <= F.col("nb")) & near(eps=eps)).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return pairs


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, nodes 0 to n-1."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(x: np.ndarray, y: np.ndarray, s: int, e: int, t: int, u: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (g, h), g < h, of vectors s to e and t to u with a cosine of at least threshold. y: coordinates, single precision."""
    bound = y[s:e] @ y[t:u].T
    g, h = np.nonzero(bound >= threshold - 1e-4)
    if s == t:
        g, h = g[g < h], h[g < h]
    if not len(g):
        return g, h
    g, h = g + s, h + t
    if len(g) * 4 > (e - s) * (u - t):
        cos = (x[s:e] @ x[t:u].T)[g - s, h - t]
    else:
        cos = np.einsum("ij,ij->i", x[g], x[h])
    ok = cos >= threshold
    for i in np.flatnonzero(np.abs(cos - threshold) < 1e-12):
        ok[i] = math.fsum((x[g[i]] * x[h[i]]).tolist()) >= threshold or np.array_equal(x[g[i]], x[h[i]])
    return g[ok], h[ok]


def join_blocks(one: list[tuple], two: list[tuple] | None, v: np.ndarray | None, threshold: float, eps: float, seen: list | None = None):
    """(node, links, root) of the vectors that have links, between the blocks of two groups, or inside one group (two None).

    blocks: ids, counts, vectors. seen: counts of the vector pairs in all and of those whose leaves were compared, to be added to.
    """
    parts = [*one, *(two or [])]
    ids, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    x = unit(np.concatenate([p[2] for p in parts]))
    full = coordinates(x, v)
    y = full.astype(np.float32)
    n, cut = len(ids), sum(len(p[0]) for p in one)
    leaves = [(s, min(s + LEAF, e)) for lo, e in ((0, cut), (cut, n)) for s in range(lo, e, LEAF)]
    low, high = (np.array([f(full[s:e], axis=0) for s, e in leaves]) for f in (np.min, np.max))
    low, high = low - 1e-9, high + 1e-9
    links = np.zeros(n, np.int64)
    left, right = [], []

    def leaf(p, q):
        (s, e), (t, u) = leaves[p], leaves[q]
        if seen is not None:
            seen[1] += (e - s) * (u - t) if p != q else (e - s) * (e - s - 1) // 2
        g, h = _links(x, y, s, e, t, u, threshold)
        if not len(g):
            return
        np.add.at(links, g, counts[h])
        np.add.at(links, h, counts[g])
        where, at = np.unique(np.concatenate([g, h]), return_inverse=True)
        label = forest(len(where), at[: len(g)], at[len(g) :])
        moved = np.flatnonzero(label != np.arange(len(label)))
        left.append(where[moved]), right.append(where[label[moved]])

    def recurse(p0, p1, q0, q1):
        """Leaves p0 to p1 against q0 to q1: skip if their boxes are distant, else halve the longer interval."""
        gap = np.maximum(0, np.maximum(low[p0:p1].min(0) - high[q0:q1].max(0), low[q0:q1].min(0) - high[p0:p1].max(0)))
        if gap @ gap > eps * eps:
            return
        if p1 - p0 == q1 - q0 == 1:
            leaf(p0, q0)
        elif (p0, p1) == (q0, q1):
            m = (p0 + p1) // 2
            recurse(p0, m, p0, m), recurse(p0, m, m, p1), recurse(m, p1, m, p1)
        elif p1 - p0 >= q1 - q0:
            m = (p0 + p1) // 2
            recurse(p0, m, q0, q1), recurse(m, p1, q0, q1)
        else:
            m = (q0 + q1) // 2
            recurse(p0, p1, q0, m), recurse(p0, p1, m, q1)

    if seen is not None:
        seen[0] += cut * (n - cut) if two is not None else n * (n - 1) // 2
    split = -(-cut // LEAF)
    if two is None:
        recurse(0, split, 0, split)
    else:
        recurse(0, split, split, len(leaves))
    if not left:
        return ids[:0], links[:0], ids[:0]
    label = forest(n, np.concatenate(left), np.concatenate(right))
    some = np.flatnonzero(links)
    return ids[some], links[some], ids[label[some]]


def _tiles(v, threshold: float, eps: float, kind: str):
    """Rows sorted by tile: the blocks of its two groups. Yields the links of every tile."""

    def run(batches):
        at, held = None, ({}, {})

        def flush():
            for dim in held[0]:
                if at[0] == at[1] or dim in held[1]:
                    out = join_blocks(held[0][dim], None if at[0] == at[1] else held[1][dim], v.value.get(dim), threshold, eps)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "links", "root"])

        for b in batches:
            get = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                key = get["a"][i].as_py(), get["b"][i].as_py()
                if key != at:
                    if at is not None:
                        yield from flush()
                    at, held = key, ({}, {})
                dim = get["dim"][i].as_py()
                block = [np.frombuffer(get[n][i].as_buffer(), t).copy() for n, t in (("ids", "<i8"), ("counts", "<i8"), ("vectors", kind))]
                side = held[0] if get["grp"][i].as_py() == key[0] else held[1]
                side.setdefault(dim, []).append((*block[:2], block[2].reshape(-1, dim)))
        if at is not None:
            yield from flush()

    return run


def _members(batches):
    for b in batches:
        get = lambda n: np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in b.column(b.schema.get_field_index(n))] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(get("rows"), pa.int64()), pa.array(get("nodes"), pa.int64())], ["vec_id", "node"])


def dedup_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding). threshold: over 0, up to 1."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    rows = v.where(good)
    total, longest = rows.agg(F.sum(F.size("embedding")), F.max(F.size("embedding"))).first()
    own = rows.select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component"))
    if total:
        eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
        sample = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(max(64, min(SAMPLE, SAMPLE_BYTES // (8 * longest)))).select("embedding").toArrow()
        by: dict[int, list] = {}
        for r in sample.column(0):
            by.setdefault(len(r), []).append(r.values.to_numpy(zero_copy_only=False))
        lengths = sorted(by, key=lambda d: (-len(by[d]), d))[:LENGTHS]
        shared = spark.sparkContext.broadcast({d: directions(unit(np.array(by[d])), min(DIRECTIONS, d)) for d in lengths})
        size = block_bytes // width
        groups = max(-(-total * width // group_bytes), min(LEAST_GROUPS, -(-total * width // block_bytes)))
        grid = c.map_batches(rows.select("vec_id", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2"), "embedding"), _grid(shared, eps, kind), "vec_id bigint, h1 bigint, h2 bigint, dim int, cell array<int>, vector binary")
        order = ["dim", "cell", "h1", "h2", "vec_id"]
        cut = c.staged(c.map_batches(grid.repartitionByRange(groups, *order).sortWithinPartitions(*order).drop("cell"), _blocks(shared, size, kind), BLOCK), "vector-blocks")
        boxes = cut.groupBy(F.col("grp").alias("block")).agg(F.array(*[F.min(F.col("lo")[i]) for i in range(SIDES)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(SIDES)]).alias("hi"))
        pairs = c.staged(block_pairs(boxes, int(groups).bit_length(), eps), "group-pairs")
        sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("grp"))
        tiles = pairs.count()
        work = sides.join(cut.select("grp", "dim", "ids", "counts", "vectors"), "grp").repartition(max(1, 3 * tiles), "a", "b").sortWithinPartitions("a", "b")
        found = c.staged(c.map_batches(work, _tiles(shared, threshold, eps, kind), "node bigint, links bigint, root bigint"), "vector-links")
        members = c.map_batches(cut.select("rows", "nodes"), _members, "vec_id bigint, node bigint")
        # links of a node: those in tiles, and the other copies that it counts
        copies = members.groupBy("node").agg((F.count("*") - 1).alias("links"))
        counts = found.select("node", "links").unionByName(copies).groupBy("node").agg(F.sum("links").alias("links"))
        parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        own = members.join(counts, "node").join(parts, "node", "left").select("vec_id", "links", F.coalesce("component", "node").alias("component"))
    bad = v.where(~good).select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component"))
    return own.unionByName(bad).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: links and components of all vectors."""
    return dedup_embeddings(c.read(spark, sf_dir, "embeddings"))


SQL = r"""
with recursive v as (select vec_id, cast(embedding as double[]) as x from embeddings),
g as (select vec_id, x, sqrt(list_inner_product(x, x)) as norm from v where vec_id is not null and len(x) > 0 and len(list_filter(x, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
r as (select vec_id, vec_id as dest from g union select r.vec_id, l.b from r join l on l.a = r.dest),
c as (select vec_id, min(dest) as low from r group by 1),
n as (select a as vec_id, count(*) as n_links from l group by 1)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(low, v.vec_id) as component_id, coalesce(low, v.vec_id) = v.vec_id as kept
from v left join n using (vec_id) left join c using (vec_id)
"""
