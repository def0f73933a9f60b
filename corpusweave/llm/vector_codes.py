"""Vector code compression: one codebook for each part of a vector, by Lloyd's iteration kept up by differences.

A component x is the integer floor(1024 * x); a vector is cut into ``parts`` equal parts, and a part becomes the index of the nearest entry
of its codebook (squared Euclidean distance, ties to the lower index). The state is one row a vector: its integers and the
indexes assigned last. A round reads the state, assigns anew and writes the next state; beside it every task writes at most
parts x entries rows: what the parts whose index changed add to their new entry's count and component sums, and take
from their old one's. These rows alone are shuffled, and added to the running sums, which are a table of at most parts x entries rows;
the driver gets that table to make the next codebooks, which are broadcast: their size is bounded by the parameters and the
length of a vector. No round shuffles vectors, however the entries are filled, and a lost task is made again from the state
before it.

All arithmetic is exact: integers as doubles while every product sum stays below 2**53, Python integers beyond; sums are
decimals of 38 digits.

Defined cases: vectors that are null, empty, or hold null or non-finite components are dropped, as are those of another length than the
kept vector of the smallest id, or all, if that length isn't a multiple of ``parts``. Components beyond the range of a long count as
its end, and so do distances and their sums. With fewer vectors than entries there are as many entries. Rows of one id are coded each; of
equal ids the row with the smaller vector comes first. A null id comes after all ids. An empty table gives an empty result. Columns other than the id, the vector and the label are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
EXACT = 1 << 20  # integers below it are multiplied as doubles
LONG = (1 << 63) - 1
#: At most so many labels are broadcast with their sums; of more, those with this many rows or more.
LABELS, HOT_LABEL = 1 << 17, 1 << 20
_STATE = "kind int, vec_id bigint, label {label}, x binary, code binary, part int, entry int, n bigint, s array<decimal(38,0)>"


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as 64-bit integers, beyond their range its ends. 1024 is a power of two, so the product is exact."""
    with np.errstate(over="ignore"):
        y = np.floor(x.astype(np.float64) * SCALE)
    out = np.clip(y, -(2.0**62), 2.0**62).astype(np.int64)
    large = np.abs(y) > 2.0**62
    out[large] = [max(-LONG, min(LONG, int(max(-(2.0**64), min(2.0**64, v))))) for v in y[large].tolist()]
    return out


def packed(x: np.ndarray) -> bytes:
    """Integers in two bytes each if they fit, else in eight."""
    small = len(x) == 0 or (x.min() >= -(1 << 15) and x.max() < 1 << 15)
    return x.astype("<i2" if small else "<i8").tobytes()


def unpacked(rows: list[bytes], length: int) -> np.ndarray:
    if all(len(r) == 2 * length for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(len(rows), length).astype(np.int64)
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * length else "<i8") for r in rows]).astype(np.int64).reshape(len(rows), length)


class Codebooks:
    """entries: for each part a list of tuples of Python integers."""

    def __init__(self, entries: list[list[tuple[int, ...]]]):
        self.entries = entries
        self.exact = [np.array(b, object) for b in entries]
        self.small = all(abs(v) < EXACT for b in entries for e in b for v in e)
        self.width = len(entries[0][0])
        if self.small:
            self.flat = [np.array(b, np.float64).T.copy() for b in entries]
            self.norm = [(b * b).sum(axis=0) for b in self.flat]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Index of the nearest entry of every part, and each vector's squared distances summed."""
        w = self.width
        codes = np.empty((len(x), len(self.entries)), np.uint8 if len(self.entries[0]) <= 256 else np.uint16)
        if self.small and w * (2 * EXACT) ** 2 < 1 << 53 and (np.abs(x) < EXACT).all():
            error = np.zeros(len(x))
            y = x.astype(np.float64)
            for p, (book, norm) in enumerate(zip(self.flat, self.norm)):
                own = y[:, p * w : (p + 1) * w]
                far = norm - 2.0 * (own @ book)
                best = far.argmin(axis=1)
                codes[:, p] = best
                error += far[np.arange(len(x)), best] + (own * own).sum(axis=1)
            return codes, error.astype(np.int64)
        error = [0] * len(x)
        for p, book in enumerate(self.exact):
            for i, row in enumerate(x[:, p * w : (p + 1) * w].tolist()):
                far = ((book - np.array(row, object)) ** 2).sum(axis=1).tolist()
                best = min(range(len(far)), key=far.__getitem__)
                codes[i, p] = best
                error[i] += far[best]
        return codes, [min(e, LONG) for e in error]

    def sha256(self) -> str:
        """Of all components, by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for b in self.entries for e in b for v in e).encode()).hexdigest()


class Changes:
    """What changed parts add to and take from counts and sums; parts x entries cells at most."""

    def __init__(self, books: Codebooks):
        self.parts, self.entries, self.width = len(books.entries), len(books.entries[0]), books.width
        self.n = np.zeros((self.parts, self.entries), np.int64)
        self.s = np.zeros((self.parts, self.entries, self.width), np.int64)
        self.large: dict[tuple[int, int], list[int]] = {}

    def add(self, x: np.ndarray, p: int, index: np.ndarray, sign: int) -> None:
        own = x[:, p * self.width : (p + 1) * self.width]
        self.n[p] += sign * np.bincount(index, minlength=self.entries)
        if (np.abs(own) < EXACT).all():
            order = np.argsort(index, kind="stable")
            at, first = np.unique(index[order], return_index=True)
            self.s[p][at] += sign * np.add.reduceat(own[order], first, axis=0)
        else:
            for i, row in zip(index.tolist(), own.tolist()):
                held = self.large.setdefault((p, i), [0] * self.width)
                held[:] = [a + sign * b for a, b in zip(held, row)]

    def rows(self):
        for p in range(self.parts):
            for e in range(self.entries):
                more = self.large.get((p, e))
                if self.n[p, e] or self.s[p, e].any() or more:
                    s = self.s[p, e].tolist()
                    yield p, e, int(self.n[p, e]), [Decimal(v) for v in (map(sum, zip(s, more)) if more else s)]


def _rows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of that length without null or non-finite components, and their components."""
    v = batch.column(1)
    sizes = np.where(np.asarray(v.is_valid()), np.diff(v.offsets.to_numpy()), -1)
    own = np.flatnonzero(sizes == length)
    at = v.offsets.to_numpy()[:-1][own] - v.offsets.to_numpy()[0]
    x = v.flatten() if not v.null_count else v.values.slice(v.offsets[0].as_py(), v.offsets[-1].as_py() - v.offsets[0].as_py())
    flat = x.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is nan
    found = flat[at[:, None] + np.arange(length)] if len(own) else np.zeros((0, length))
    good = np.isfinite(found).all(axis=1)
    return own[good], found[good]


def _step(books: Codebooks, length: int, first: bool, schema: pa.Schema):
    """One round: the next state's rows, then the task's changes. first: the input is vec_id, vector, label instead of a state."""

    def run(batches):
        own = books.value
        changes = Changes(own)
        for batch in batches:
            if first:
                place, x = _rows(batch, length)
                if not len(place):
                    continue
                x = whole_numbers(x)
                kept = batch.take(pa.array(place))
                ids, labels, packs = kept.column(0), kept.column(2), pa.array([packed(r) for r in x], pa.binary())
            else:
                ids, labels, packs = batch.column(0), batch.column(1), batch.column(2)
                x = unpacked(packs.to_pylist(), length)
            codes, _ = own.assign(x)
            raw = codes.astype("<u2").tobytes()
            step = 2 * codes.shape[1]
            made = pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())
            if first:
                for p in range(codes.shape[1]):
                    changes.add(x, p, codes[:, p].astype(np.int64), 1)
            else:
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(len(x), -1).astype(np.int64)
                for p in range(codes.shape[1]):
                    moved = np.flatnonzero(old[:, p] != codes[:, p])
                    if len(moved):
                        changes.add(x[moved], p, old[moved, p], -1)
                        changes.add(x[moved], p, codes[moved, p].astype(np.int64), 1)
            n = len(x)
            none = [pa.nulls(n, f.type) for f in list(schema)[5:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), ids.cast(schema.field(1).type), labels.cast(schema.field(2).type), packs, made, *none], schema=schema)
        for p, e, n, s in changes.rows():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *[pa.nulls(1, schema.field(i).type) for i in range(1, 5)], pa.array([p], pa.int32()), pa.array([e], pa.int32()), pa.array([n], pa.int64()), pa.array([s], schema.field(8).type)], schema=schema)

    return run


def seeds(vectors: DataFrame, entries: int = ENTRIES) -> list[np.ndarray]:
    """The vectors of the smallest kept ids, as integers; the first one's length is that of all kept. ``entries`` rows come to the driver."""
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall(F.coalesce("vector", F.array().cast("array<double>")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.where(good)
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not least:
        return []
    length = len(least[0].vector)
    rows = kept.where(F.size("vector") == length).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    return [whole_numbers(np.array(r.vector, np.float64)) for r in rows]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vectors: vec_id, vector, label. Returns (vec_id, label, code: array<int>, error: bigint of every kept row, staged; the codebooks)."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), "label")
    kind = vectors.schema["label"].dataType.simpleString()
    out_schema = f"vec_id bigint, label {kind}, code array<int>, error bigint"
    start = seeds(vectors, entries)
    if not start or len(start[0]) % parts:
        return spark.createDataFrame([], out_schema), None
    length, width = len(start[0]), len(start[0]) // parts
    books = [[tuple(map(int, x[p * width : (p + 1) * width])) for x in start] for p in range(parts)]
    spec = _STATE.format(label=kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    sample = spark.createDataFrame([], spec)
    schema = to_arrow_schema(sample.schema)
    sums, state = None, None
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(Codebooks(books))
        source = vectors if state is None else state.where("kind = 0").select("vec_id", "label", "x", "code")
        made = c.map_batches(source, _step(shared, length, state is None, schema), sample.schema)
        before, state = state, c.staged(made, "codes", partition="kind")
        if before is not None:
            c.unstage(before)
        gain = state.where("kind = 1").select("part", "entry", "n", "s")
        every = gain if sums is None else gain.unionByName(sums)
        total = every.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).cast("decimal(38,0)").alias(f"s{i}") for i in range(width)])
        before, sums = sums, c.staged(total.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(width)]).alias("s")), "sums")
        if before is not None:
            c.unstage(before)
        for row in sums.where("n > 0").collect():  # parts x entries rows at most
            books[row.part][row.entry] = tuple(int(v) // row.n for v in row.s)
    final = Codebooks(books)
    shared = spark.sparkContext.broadcast(final)

    def run(batches):
        for batch in batches:
            codes, error = shared.value.assign(unpacked(batch.column(2).to_pylist(), length))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = c.staged(c.map_batches(state.where("kind = 0").select("vec_id", "label", "x"), run, out_schema), "coded")
    c.unstage(state, sums)
    return coded, final


def label_sums(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors summed over equal labels, nulls together; beyond a long its end.

    One row a label is joined back: broadcast if there are at most LABELS labels; of more, the labels with HOT_LABEL rows or
    more, of which there are few, and the others by a shuffle in which no label has many rows.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint")
    sums = c.staged(coded.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("rows")).withColumnRenamed("label", "of"), "labels")

    def met(some: DataFrame, these: DataFrame) -> DataFrame:
        return some.join(these, some["label"].eqNullSafe(these["of"])).drop("of", "rows")

    if sums.count() <= LABELS:
        return met(coded, F.broadcast(sums))
    hot, rest = sums.where(F.col("rows") >= HOT_LABEL), sums.where(F.col("rows") < HOT_LABEL)
    cold = coded.join(F.broadcast(hot), coded["label"].eqNullSafe(hot["of"]), "left_anti")
    return met(coded, F.broadcast(hot)).unionByName(met(cold, rest))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: code, error and the label's error of every vector of ``embeddings``, and the digest of the codebooks."""
    vectors = c.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    coded, books = compress(vectors)
    code = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    return label_sums(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    assign = """n{r} as materialized (select i, p, arg_min(e, (d, e)) as e, min(d) as d from (select x.i, x.p, b.e, b.norm - 2 * list_inner_product(x.v, b.v) + x.norm as d from x join b{r} b using (p)) group by all)"""
    update = """t{r} as (select p, e, pos, sum(v::hugeint) as s, count(*) as n from (select x.p, n{r}.e, unnest(x.v) as v, unnest(range(1, len(x.v) + 1)) as pos from x join n{r} using (i, p)) group by all),
u{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by pos)::double[] as v from t{r} group by all),
b{q} as materialized (select p, e, v, list_inner_product(v, v) as norm from (select b.p, b.e, coalesce(u.v, b.v) as v from b{r} b left join u{r} u using (p, e)))"""
    steps = ",\n".join(assign.format(r=r) + ",\n" + update.format(r=r, q=r + 1) for r in range(rounds)) + ",\n" + assign.format(r=rounds)
    return f"""with k as materialized (select row_number() over (order by vec_id) as i, vec_id, label, list_transform(embedding, lambda t: floor({SCALE} * t::double)) as v from embeddings
where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda t: t is not null and isfinite(t)))),
x as materialized (select i, p, v, list_inner_product(v, v) as norm from (select i, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] as v from k, range({parts}) as r(p))),
b0 as materialized (select p, i - 1 as e, v, norm from x where i <= {entries}),
{steps},
c as (select i, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from n{rounds} group by i),
h as (select sha256(string_agg(y.t::bigint::varchar, ',' order by p, e, pos)) as digest from (select p, e, unnest(v) as t, unnest(range(len(v))) as pos from b{rounds}) y)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256 from k join c using (i), h"""


SQL = _sql()
