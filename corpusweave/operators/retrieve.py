"""Retrieval: semantic, keyword, reciprocal rank fusion, hybrid and multi-query search, batched over a table of queries.

Query tables are stated sets that meet all rows in blocks, broadcast, whose row count is checked. Top-k is row_number with a
filter, which Spark cuts to k rows a query in every task before it shuffles. Every order is total: the id breaks ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.partition import spread
from ..functions.text import simple_tokens
from ..sources.staging import new_folder, staged, unstage
from . import keyword_index as K
from .keyword_index import PI2_6  # noqa: F401

RRF, POOL = 60, 10
#: Queries in one broadcast; more are searched in blocks of so many.
MOST_QUERIES = 1000
#: Numbers of the vectors of one block of queries; each pass over the chunks costs more than its products if a block is small.
QUERY_NUMBERS = 1 << 20
#: Scores of queries and chunks that are held at a time, and what stands for a null id while they are.
SCORES, LEAST_ID = 1 << 20, -(1 << 63)


def in_blocks(queries: DataFrame, search, times: int = 1) -> DataFrame:
    """Applies search to blocks of at most about times MOST_QUERIES rows of the query table; the results of many blocks are written one after the other."""
    n, most = queries.count(), times * MOST_QUERIES
    if n <= most:
        return search(queries)
    parts = -(-n // (most // 2))
    asked = staged(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts))), "queries", "block")
    path, schema = new_folder(queries.sparkSession, "found"), None
    for i in range(parts):
        found = search(asked.where(F.col("block") == i).drop("block"))
        schema = found.schema
        found.write.mode("append").parquet(path)
    unstage(asked)
    return queries.sparkSession.read.schema(schema).parquet(path)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id, score: the k best rows of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact cosine top-k. chunks: chunk_id, embedding; queries: query_id, vector. Rows without a vector are skipped.

    A block of queries is broadcast as one matrix; slices of every Arrow batch of chunks are matrix products with it, of bounded size and in single
    precision, and scores that can be among the k best are computed in double precision; a task has one row for each of its k best of each query. Scores are rounded to twelve places, so that equal vectors tie.
    """

    def search(part: DataFrame) -> DataFrame:
        asked = part.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector")).collect()  # at most MOST_QUERIES
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(asked):
            by_length.setdefault(len(r.vector), []).append(i)
        lengths = {n: (np.array(at), _unit(np.array([asked[i].vector for i in at], np.float64))) for n, at in by_length.items() if n}
        shared = chunks.sparkSession.sparkContext.broadcast(lengths)

        def run(batches):
            lengths = shared.value
            best = {n: Nearest(len(place), k) for n, (place, _) in lengths.items()}
            single = {n: q.astype(np.float32) for n, (_, q) in lengths.items()}
            for batch in batches:
                vectors = batch.column(1)
                ids = batch.column(0).fill_null(LEAST_ID).to_numpy()
                null = np.asarray(batch.column(0).is_null())
                sizes = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                at = np.cumsum(sizes) - sizes
                for n, (place, q) in lengths.items():
                    own = np.flatnonzero(sizes == n)
                    step = max(1, SCORES // len(place))
                    for some in (own[i : i + step] for i in range(0, len(own), step)):
                        best[n].meet(q, single[n], _unit(flat[at[some][:, None] + np.arange(n)].astype(np.float64)), ids[some], null[some])
            for n, (place, _) in lengths.items():
                yield best[n].rows(place)

        rows = spread(chunks.where("embedding is not null").select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding"))
        found = rows.mapInArrow(run, "number int, chunk_id bigint, score double")
        kind = part.schema["query_id"].dataType
        names = chunks.sparkSession.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], T.StructType([T.StructField("number", T.IntegerType()), T.StructField("query_id", kind)]))
        return top_k(found.join(F.broadcast(names), "number").select("query_id", "chunk_id", "score"), k)

    longest = queries.select(F.max(F.size("vector"))).first()[0] or 1
    return in_blocks(queries, search, max(1, QUERY_NUMBERS // MOST_QUERIES // max(1, longest)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector has no direction and becomes nan."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Nearest:
    """The k best chunks of each of n queries so far, by score and id; a null id comes before others."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.null = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """score: queries x chunks; nan is no score."""
        least = np.maximum(self.score[:, -1] - 1e-11, -np.finfo(float).max)  # scores aren't rounded yet
        may = score >= least[:, None]
        many = np.flatnonzero(may.sum(axis=1) > 4 * self.k)
        if len(many):
            row = np.where(may[many], score[many], -np.inf)
            kth = np.partition(row, row.shape[1] - self.k, axis=1)[:, row.shape[1] - self.k]
            may[many] = row >= kth[:, None] - 1e-11
        i, j = np.nonzero(may)
        self.put(i, np.round(score[i, j], 12), ids[j], null[j])

    def meet(self, q: np.ndarray, single: np.ndarray, x: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Unit vectors: the queries, also in single precision, and chunks."""
        margin = (q.shape[1] + 4) * 2.0**-23  # more than single precision can be wrong by
        score = single @ x.astype(np.float32).T
        least = np.maximum(self.score[:, -1] - margin, -np.finfo(np.float32).max).astype(np.float32)
        may = score >= least[:, None]
        at = np.flatnonzero(may)
        many = np.flatnonzero(np.bincount(at // len(x), minlength=len(q)) > 4 * self.k)
        if len(many):
            row = np.where(may[many], score[many], np.float32(-np.inf))
            kth = np.partition(row, row.shape[1] - self.k, axis=1)[:, row.shape[1] - self.k]
            may[many] = row >= (kth - np.float32(2 * margin))[:, None]
            at = np.flatnonzero(may)
        step = max(1, (1 << 21) // q.shape[1])
        for some in (at[a : a + step] for a in range(0, len(at), step)):
            i, j = some // len(x), some % len(x)
            self.put(i, np.round(np.einsum("ij,ij->i", q[i], x[j]), 12), ids[j], null[j])

    def put(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None) -> None:
        """Single scores, rounded: of the chunks ids for the queries i."""
        null = np.zeros(len(i), bool) if null is None else null
        may = score >= self.score[i, -1]
        i, score, ids, null = i[may], score[may], ids[may], null[may]
        if not len(i):
            return
        own, i = np.unique(i, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(own)), self.k), i])
        value = np.concatenate([self.score[own].ravel(), score])
        id_ = np.concatenate([self.id[own].ravel(), ids])
        gone = np.concatenate([self.null[own].ravel(), null])
        order = np.lexsort((id_, ~gone, -value, row))
        first = np.searchsorted(row[order], np.arange(len(own)))
        top = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.id[own], self.null[own] = value[top], id_[top], gone[top]

    def rows(self, place: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(place[i].astype(np.int32)), pa.array(self.id[i, j], mask=self.null[i, j]), pa.array(self.score[i, j])], ["number", "chunk_id", "score"])


def query_lexemes(queries: DataFrame) -> DataFrame:
    """query_id, own, n: the distinct lexemes of each query and how many there are."""
    return queries.select("query_id", F.array_distinct(simple_tokens(F.col("q"))).alias("own")).select("query_id", "own", F.size("own").alias("n"))


def keyword_search(index: DataFrame, queries: DataFrame, k: int = 5, lexemes: DataFrame | None = None) -> DataFrame:
    """OR-lexeme search over a keyword index, or over postings (chunk_id, lexeme, tf), of which one is made; a query without
    lexemes finds nothing. lexemes: query_id, lexeme, n of the queries, where they aren't of the simple analyzer."""
    if "lexeme" in index.columns:
        index = K.of_postings(index)
    lex = query_lexemes(queries) if lexemes is None else lexemes.join(queries.select("query_id"), "query_id")
    return top_k(K.search(index, lex, k), k)


def rrf(lists: DataFrame, k: int) -> DataFrame:
    """Fuses ranked lists (query_id, list, rank, chunk_id): sum of 1/(60+rank), summed in list order so that ties are stable.

    Equal scores keep the order of first appearance.
    """
    one = lists.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("list", "rank"))).alias("seen"))
    fused = one.select("query_id", "chunk_id", F.aggregate("seen", F.lit(0.0), lambda a, s: a + 1.0 / (RRF + s["rank"])).alias("score"), F.col("seen")[0].alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list", "first.rank")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def hybrid_search(chunks: DataFrame, index: DataFrame, queries: DataFrame, k: int = 5, lexemes: DataFrame | None = None) -> DataFrame:
    """Both arms with a pool of max(k, 10), semantic first, fused. queries: query_id, q, vector; index, lexemes: as for
    keyword_search."""
    pool = max(k, POOL)
    vectors = staged(chunks.where("embedding is not null").select("chunk_id", "embedding"), "vectors")  # blocks of queries read it again
    semantic = vector_search(vectors, queries.where("vector is not null").select("query_id", "vector"), pool).withColumn("list", F.lit(0))
    keyword = keyword_search(index, queries, pool, lexemes).withColumn("list", F.lit(1))
    return rrf(semantic.unionByName(keyword), k)


def multi_search(chunks: DataFrame, index: DataFrame, queries: DataFrame, k: int = 8, lexemes: DataFrame | None = None) -> DataFrame:
    """Hybrid search for each sub-query, then the fused lists are fused. queries: group_id, sub (order), q, vector; lexemes: as
    above, by query_id, a struct of group_id and sub."""
    own = queries.withColumn("query_id", F.struct("group_id", "sub"))
    each = hybrid_search(chunks, index, own, max(k, POOL), lexemes)
    return rrf(each.select(F.col("query_id.group_id").alias("query_id"), F.col("query_id.sub").alias("list"), "rank", "chunk_id"), k)


def resolve_hits(hits: DataFrame, chunks: DataFrame, documents: DataFrame, versions: DataFrame, pages: DataFrame) -> DataFrame:
    """The chunk records of ranked hits: url and title by key joins; Spark broadcasts the hits if they are few."""
    d = documents.select(F.col("id").alias("document_id"), "page_version_id", "title")
    v = versions.select(F.col("id").alias("page_version_id"), "page_id")
    p = pages.select(F.col("id").alias("page_id"), "url")
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "heading_path", "text")
    return c.join(hits, "chunk_id").join(d, "document_id").join(v, "page_version_id").join(p, "page_id").select("query_id", "rank", "chunk_id", "document_id", "url", "title", "heading_path", "text", "score")


def evaluate(results: DataFrame, goldens: DataFrame, k: int = 5) -> DataFrame:
    """hit_rate and mrr over goldens (query_id, expect): rank of the first result whose url contains what is expected."""
    found = goldens.join(results.where(F.col("rank") <= k), "query_id", "left").groupBy("query_id").agg(F.min(F.when(F.contains("url", "expect"), F.col("rank"))).alias("first"))
    return found.agg(F.avg(F.col("first").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def lsh_candidates(chunks: DataFrame, queries: DataFrame, bits: int = 10, tables: int = 24, seed: int = 5) -> DataFrame:
    """Approximate arm: query_id, chunk_id of pairs that share a random-hyperplane key in one of the tables; vector_search over
    them ranks exactly. A pair at an angle of a is found with probability 1 - (1 - (1 - a/pi)**bits)**tables.

    The planes are broadcast and met by a matrix product for each Arrow batch. Vectors of another length than the queries' longest have no key.
    """
    dim = queries.select(F.max(F.size("vector"))).first()[0] or 0
    shared = chunks.sparkSession.sparkContext.broadcast(np.random.default_rng(seed).standard_normal((dim, tables * bits)))

    def run(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = batch.column(1)
            own = np.flatnonzero(np.diff(vectors.offsets.to_numpy()) == dim)
            at = vectors.offsets.to_numpy()[:-1][own] - vectors.offsets.to_numpy()[0]
            x = vectors.flatten().to_numpy(zero_copy_only=False)[at[:, None] + np.arange(dim)].astype(np.float64)
            codes = ((x @ shared.value >= 0).reshape(len(own), tables, bits) * weights).sum(2) + (np.arange(tables, dtype=np.int64) << bits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(own, tables))), pa.array(codes.ravel())], ["id", "key"])

    keys = lambda df, name, vector: df.where(F.col(vector).isNotNull()).select(F.col(name).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id bigint, key bigint")
    a = keys(chunks, "chunk_id", "embedding").withColumnRenamed("id", "chunk_id")
    b = keys(queries, "query_id", "vector").withColumnRenamed("id", "query_id")
    return a.join(b, "key").select("query_id", "chunk_id").distinct()
