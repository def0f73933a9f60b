"""Approximate vector search: an inverted file of cells with product-quantised residuals, re-ranked by exact cosines.

Cells and codebooks are fitted on the driver on a bounded sample (SAMPLE_ROWS vectors and SAMPLE_BYTES at most, drawn by a hash of the id);
every row is coded. Rows lie on disk by cell, so that a search skips the row groups of cells it doesn't probe; a cell that holds a
large share of the rows is spread over files by a hash of the id. A search reads the probed cells once for each block of queries: a row's score by
its code is its decoded vector's product with the query, a matrix product for each slice of a cell; what comes within ``margin`` of the k-th
best of its query so far is compared exactly where it lies, and only the k best of each query leave a task. So a task holds one slice of scores and
k rows a query, whatever the number of rows. What a task compares rests on the rows it has met, so other file boundaries can bring in a few more
true neighbours; what comes within margin of the k-th best of all rows is always compared. How many cells are probed, and the margin, are
set when the index is built, from where the true neighbours of some sampled vectors lie, for a share of TARGET of them.

Rows without a vector, and vectors without a direction, are not found, as in the exact search. Vectors of another length than the sample's most
frequent one are kept in a cell of their own and compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.partition import spread
from ..sources.staging import new_folder
from .retrieve import MOST_QUERIES, SCORES, Nearest, in_blocks, top_k

SAMPLE_ROWS, SAMPLE_BYTES = 1 << 16, 64 << 20
MOST_CELLS, ENTRIES, PART = 1 << 14, 256, 4
LEAST_A_CELL = 16  # sampled vectors for each cell
TARGET = 0.98
TUNED = 256  # sampled vectors whose neighbours are looked at
OTHER = -1
#: Rows whose distances to all centres are held at a time, and pairs whose vectors are.
AT_ONCE, PAIRS = 1 << 11, 1 << 15
#: Components of queries' vectors for which blocks of queries are made larger, up to BLOCKS times, as each block reads the rows anew.
ASKED, BLOCKS = 1 << 18, 4
ROWS = "cell int, chunk_id bigint, code binary, embedding array<float>"
_ROWS = pa.schema([("cell", pa.int32()), ("chunk_id", pa.int64()), ("code", pa.binary()), ("embedding", pa.list_(pa.float32()))])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a vector without a direction becomes nan."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres of the rows of x; an empty one moves to a row that is far from its own."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own, far = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, column, k) for column in x.T], axis=1)
        some = count > 0
        centres[some] = sums[some] / count[some, None]
        if not some.all():
            worst = np.argsort(-(far + (x * x).sum(axis=1)), kind="stable")
            centres[~some] = x[worst[: int((~some).sum())]]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, and its squared distance less the row's own square; some rows at a time, which stay in the cache."""
    own, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    lengths, turned = (centres * centres).sum(axis=1), -2 * centres.T
    for i in range(0, len(x), AT_ONCE):
        d = x[i : i + AT_ONCE] @ turned
        d += lengths
        own[i : i + AT_ONCE] = at = d.argmin(axis=1)
        far[i : i + AT_ONCE] = d[np.arange(len(d)), at]
    return own, far


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _nearest(x, centres)[0]


@dataclass
class Codec:
    """centres: cells x length; books: parts x entries x width (length rounded up to whole parts); probes, margin: see Index.search."""

    centres: np.ndarray
    books: np.ndarray
    probes: int = 1
    margin: float = np.inf

    @property
    def length(self) -> int:
        return self.centres.shape[1]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts: parts x rows x width."""
        n, w = len(self.books), self.books.shape[2]
        return np.pad(x, ((0, 0), (0, n * w - x.shape[1]))).reshape(len(x), n, w).transpose(1, 0, 2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of unit vectors."""
        cell = nearest(x, self.centres)
        cut = self.parts(x - self.centres[cell])
        return cell, np.stack([nearest(p, b) for p, b in zip(cut, self.books)], axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        rest = self.books[np.arange(len(self.books)), code].reshape(len(code), -1)[:, : self.length]
        return (self.centres[cell] + rest).astype(np.float32)

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, cells: int | None = None, seed: int = 3) -> Codec:
        """x: sampled unit vectors, of so many rows in all."""
        k = max(1, min(cells or int(np.sqrt(rows)), MOST_CELLS, len(x) // LEAST_A_CELL or 1))
        centres = lloyd(x, k, 10, seed)
        own = cls(centres, np.zeros((-(-x.shape[1] // PART), 1, PART)))
        cut = own.parts(x - centres[nearest(x, centres)])
        entries = min(ENTRIES, len(x))
        own.books = np.stack([lloyd(p, entries, 10, seed + 1 + i) for i, p in enumerate(cut)])
        own.tune(x, seed)
        return own

    def tune(self, x: np.ndarray, seed: int, k: int = 10) -> None:
        """probes: so that TARGET of the k nearest of sampled vectors lie in a probed cell. margin: by codes TARGET of them come no further
        than this below the exact score of the k-th."""
        some = np.random.default_rng(seed).permutation(len(x))[:TUNED]
        cell, code = self.encode(x)
        q = x[some]
        k = min(k, len(x) - 1)
        if k < 1:
            self.probes, self.margin = len(self.centres), np.inf
            return
        best, last = np.zeros((len(q), k), np.int64), np.zeros((len(q), 1))
        for i in range(0, len(q), 16):
            own = some[i : i + 16]
            exact = q[i : i + 16] @ x.T
            exact[np.arange(len(own)), own] = -np.inf
            best[i : i + 16] = at = np.argpartition(exact, len(x) - k, axis=1)[:, len(x) - k :]
            last[i : i + 16] = np.take_along_axis(exact, at, axis=1).min(axis=1, keepdims=True)
        near = q @ self.centres.T
        place = np.empty_like(near, dtype=np.int64)
        np.put_along_axis(place, np.argsort(-near, axis=1), np.arange(near.shape[1])[None], axis=1)
        self.probes = int(np.quantile(np.take_along_axis(place, cell[best], axis=1), TARGET, method="higher")) + 1
        rough = np.einsum("ij,ikj->ik", q, self.decode(cell[best.ravel()], code[best.ravel()]).reshape(*best.shape, -1))
        self.margin = max(0.0, float(np.quantile(last - rough, TARGET, method="higher")))


def _vectors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of that length that have a direction, and these as unit vectors."""
    at = column.offsets.to_numpy()
    sizes = np.where(np.asarray(column.is_valid()), np.diff(at), -1)
    own = np.flatnonzero(sizes == length)
    flat = column.values.slice(at[0], at[-1] - at[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = unit(flat[(at[:-1][own] - at[0])[:, None] + np.arange(length)]) if len(own) else np.zeros((0, length))
    good = np.isfinite(x).all(axis=1)
    return own[good], x[good]


def _compare(best: Nearest, some: np.ndarray, rough: np.ndarray, margin: float, q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
    """Exact scores of the rows x whose rough scores (queries some x rows) come within margin of the k-th best of their query so far."""

    def put(i: np.ndarray, j: np.ndarray) -> None:
        if 8 * len(i) > rough.size:
            whole = np.round(q[some] @ x.T, 12)
            best.put(some[i], whole[i, j], ids[j])
            return
        for at in range(0, len(i), PAIRS):
            a, b = some[i[at : at + PAIRS]], j[at : at + PAIRS]
            best.put(a, np.round(np.einsum("ij,ij->i", q[a], x[b]), 12), ids[b])

    def near() -> np.ndarray:
        return rough >= (best.score[some, -1] - margin - 1e-6).astype(np.float32)[:, None]  # rough scores are of single precision

    may, k = near(), best.k
    many = np.flatnonzero(may.sum(axis=1) > 4 * k)
    if len(many):  # their k best by code first: these raise what the others have to reach
        top = np.argpartition(-rough[many], k - 1, axis=1)[:, :k]
        put(np.repeat(many, k), top.ravel())
        may = near()
        may[many[:, None], top] = False
    i, j = np.nonzero(may)
    if len(i):
        put(i, j)


class Index:
    def __init__(self, spark: SparkSession, path: str, codec: Codec | None):
        self.spark, self.path, self.codec = spark, path.rstrip("/"), codec

    # ------------------------------------------------------------ build

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Index:
        """chunks: chunk_id, embedding. Writes the index to a path that nothing uses yet."""
        spark = chunks.sparkSession
        rows = chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("chunk_id is not null and embedding is not null and size(embedding) > 0")
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
        path = path or new_folder(spark, "vectors")
        share = min(1.0, sample_rows / max(n, 1), sample_bytes / 8 / max(size, 1))
        die = F.shiftrightunsigned(F.xxhash64("chunk_id", F.lit(17)), 11) / float(1 << 53)
        drawn = rows.where(die <= share).orderBy(die, "chunk_id").limit(2 * sample_rows).select("embedding").toArrow().column(0).combine_chunks()
        codec = None
        if len(drawn):
            sizes, often = np.unique(np.diff(drawn.offsets.to_numpy()), return_counts=True)
            _, x = _vectors(drawn, int(sizes[often.argmax()]))
            codec = Codec.fit(x, n, cells) if len(x) else None
        own = cls(spark, path, codec)
        own._save()
        own.add(rows)
        return own

    def _save(self) -> None:
        c = self.codec
        rows = [] if c is None else [("centre", i, 0, v.tolist()) for i, v in enumerate(c.centres)] + [("book", p, e, v.tolist()) for p, b in enumerate(c.books) for e, v in enumerate(b)] + [("tuned", 0, 0, [float(c.probes), c.margin])]
        self.spark.createDataFrame(rows, "kind string, a int, b int, v array<double>").coalesce(1).write.parquet(f"{self.path}/codec")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        rows = spark.read.parquet(f"{path}/codec").orderBy("kind", "a", "b").collect()  # bounded by MOST_CELLS and ENTRIES
        centres = np.array([r.v for r in rows if r.kind == "centre"])
        if not len(centres):
            return cls(spark, path, None)
        books = [r for r in rows if r.kind == "book"]
        tuned = next(r.v for r in rows if r.kind == "tuned")
        return cls(spark, path, Codec(centres, np.array([r.v for r in books]).reshape(books[-1].a + 1, -1, len(books[0].v)), int(tuned[0]), tuned[1]))

    def add(self, chunks: DataFrame) -> None:
        """Codes rows (chunk_id, embedding) with the cells and codebooks there are. An id that is there already is found twice."""
        shared = self.spark.sparkContext.broadcast(self.codec)

        def run(batches):
            codec = shared.value
            for batch in batches:
                ids, vectors = batch.column(0), batch.column(1)
                cell, code = np.full(len(batch), OTHER, np.int32), [None] * len(batch)
                if codec is not None:
                    own, x = _vectors(vectors, codec.length)
                    if len(own):
                        cell[own], codes = codec.encode(x)
                        for i, b in zip(own.tolist(), codes):
                            code[i] = b.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(cell), ids, pa.array(code, pa.binary()), vectors.cast(pa.list_(pa.float32()))], schema=_ROWS)

        rows = chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("chunk_id is not null and embedding is not null")
        coded = spread(rows).mapInArrow(run, ROWS)
        place = F.xxhash64("chunk_id")
        coded.repartitionByRange("cell", place).sortWithinPartitions("cell", place).write.mode("append").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/rows")

    # ------------------------------------------------------------ search

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, margin: float | None = None, exact: bool = False) -> DataFrame:
        """query_id, rank, chunk_id, score of queries (query_id, vector), as the exact search gives them.

        probes: cells each query looks into; margin: rows whose score by code is less than the k-th best exact score by more than this are
        not compared exactly; as tuned if not given. exact: all rows of the probed cells are compared exactly, no codes are read; with all
        cells probed the result is that of the exact search.
        """

        def block(part: DataFrame) -> DataFrame:
            asked = part.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector")).collect()  # at most BLOCKS * MOST_QUERIES
            kind = part.schema["query_id"].dataType
            schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("query_id", kind)])
            names = self.spark.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], schema)
            codec = self.codec
            near, other = [], []
            for i, r in enumerate(asked):
                v = np.array([np.nan if t is None else t for t in r.vector], np.float64)
                good = len(v) and np.isfinite(v).all() and (v * v).sum() > 0
                if good:
                    (near if codec is not None and len(v) == codec.length else other).append((i, v))
            found = self._others(other, k)
            if near:
                place, q = np.array([i for i, _ in near], np.int32), unit(np.array([v for _, v in near]))
                tried = min(probes or codec.probes, len(codec.centres))
                found = found.unionByName(self._exact(place, q, tried, k) if exact else self._ranked(place, q, tried, k, codec.margin if margin is None else margin))
            return top_k(found.join(F.broadcast(names), "number").select("query_id", "chunk_id", "score"), k)

        length = self.codec.length if self.codec is not None else ASKED
        return in_blocks(queries, block, min(BLOCKS, max(1, ASKED // (MOST_QUERIES * length))))

    def _probed(self, q: np.ndarray, probes: int) -> tuple[np.ndarray, list[int]]:
        """Which queries look into each cell (cells x queries), and the cells that any looks into."""
        near = q @ self.codec.centres.T
        out = np.zeros(near.T.shape, bool)
        out[np.argpartition(-near, probes - 1, axis=1)[:, :probes].T, np.arange(len(q))] = True
        return out, np.flatnonzero(out.any(axis=1)).tolist()

    def _in(self, cells: list[int]) -> DataFrame:
        """Rows of these cells; the filter reaches the row groups."""
        everything = len(cells) == len(self.codec.centres)
        return self.rows().where(F.col("cell") >= 0 if everything else F.col("cell").isin(cells))

    def _ranked(self, place: np.ndarray, q: np.ndarray, probes: int, k: int, margin: float) -> DataFrame:
        probed, cells = self._probed(q, probes)
        shared = self.spark.sparkContext.broadcast((place, q, probed, self.codec))

        def run(batches):
            place, q, probed, codec = shared.value
            best, asked, most = Nearest(len(q), k), q.astype(np.float32), max(1, SCORES // codec.length)
            for batch in (whole.slice(i, most) for whole in batches for i in range(0, len(whole), most)):
                own, x = _vectors(batch.column(3), codec.length)
                cell, ids = batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own]
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)[own]
                coded = codec.decode(cell, code)
                order = np.argsort(cell, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    if not len(at) or not len(some := np.flatnonzero(probed[cell[at[0]]])):
                        continue
                    step = max(1, SCORES // len(some))
                    for part in (at[i : i + step] for i in range(0, len(at), step)):
                        _compare(best, some, asked[some] @ coded[part].T, margin, q, x[part], ids[part])
            yield best.rows(place)

        return self._in(cells).select("cell", "chunk_id", "code", "embedding").mapInArrow(run, "number int, chunk_id bigint, score double")

    def _exact(self, place: np.ndarray, q: np.ndarray, probes: int, k: int) -> DataFrame:
        probed, cells = self._probed(q, probes)
        return self._compared(self._in(cells), {q.shape[1]: (place, q)}, k, probed)

    def _others(self, queries: list, k: int) -> DataFrame:
        """Queries of other lengths than the cells', against the rows of their length."""
        by: dict[int, list] = {}
        for i, v in queries:
            by.setdefault(len(v), []).append((i, v))
        tables = {n: (np.array([i for i, _ in own], np.int32), unit(np.array([v for _, v in own]))) for n, own in by.items()}
        if not tables:
            return self.spark.createDataFrame([], "number int, chunk_id bigint, score double")
        return self._compared(self.rows().where(F.col("cell") == OTHER), tables, k, None)

    def _compared(self, rows: DataFrame, tables: dict, k: int, probed: np.ndarray | None) -> DataFrame:
        """Cosines of rows with the queries of their length, with those that probe their cell; the k best of each task."""
        shared = self.spark.sparkContext.broadcast((tables, probed))

        def run(batches):
            tables, probed = shared.value
            best = {n: Nearest(len(place), k) for n, (place, _) in tables.items()}
            for batch in batches:
                cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for n, (_, q) in tables.items():
                    own, x = _vectors(batch.column(2), n)
                    for at in np.split(np.arange(len(own)), np.flatnonzero(np.diff(cell[own])) + 1) if len(own) else []:
                        some = np.arange(len(q)) if probed is None else np.flatnonzero(probed[cell[own[at[0]]]])
                        step = max(1, SCORES // max(1, len(some)))
                        for part in (at[i : i + step] for i in range(0, len(at), step)):
                            score = np.round(q[some] @ x[part].T, 12)
                            i, j = np.nonzero(score >= best[n].score[some, -1:])
                            best[n].put(some[i], score[i, j], ids[own[part]][j])
            for n, (place, _) in tables.items():
                yield best[n].rows(place)

        return rows.select("cell", "chunk_id", "embedding").mapInArrow(run, "number int, chunk_id bigint, score double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact search's rows that the other found, by query."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
