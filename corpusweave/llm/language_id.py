"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: the 1- to 3-grams of the lower-cased characters (ASCII non-letters count as a space), hashed to 2**BITS buckets;
a gram's weight is its share of the text's grams times the bucket's inverse document frequency. The regression is trained
with follow-the-regularised-leader and elastic-net penalties, so most weights are exactly zero; a temperature fitted on
the part of the sample that training didn't see calibrates the scores.

The classifier is fitted on the driver from a bounded sample of labelled rows of at most ``sample_text`` bytes (where a language
has no such row, its shortest ones): expected are at most ``per_language`` documents of each language, ``sample_docs``
documents and ``sample_bytes`` of text in all, drawn by a 63-bit hash of id and text, whole texts; never more than twice
``sample_docs`` rows come to the driver, and of those what passes twice ``sample_bytes`` is left out. Of more than
``languages`` languages the most frequent are learned. Prediction runs over all documents, whole texts, and reads nothing but the text.

Defined cases: a text that is null or without a letter is ``und`` with score 0. With no labelled row to learn from every
text is ``und``. Rows with a null id are predicted, never learned from, and not held out. Ties go to the first language in
order. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BITS, GRAMS = 16, (1, 2, 3)
PER_LANGUAGE, SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT, LANGUAGES = 500, 4000, 24 << 20, 32 << 10, 256
SCALE = 40.0  # makes shares of a text about as large as counts of a short one
UND = "und"
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, document after document, and the documents' bounds."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(x) for x in codes])
    x = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    x = np.where(x < 128, _FOLD[np.minimum(x, 127)], x)
    per = [np.maximum(sizes - n + 1, 0) for n in GRAMS]
    bounds = np.concatenate([[0], np.cumsum(np.sum(per, axis=0))])
    out = np.empty(bounds[-1], np.uint32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(x)) - first[doc]
    h = np.zeros(len(x), np.uint32)
    offset = bounds[:-1].copy()
    for n, count in zip(GRAMS, per):
        # h covers n characters from each place on
        if n == 1:
            h = x * np.uint32(0x9E3779B1)
        else:
            h = h[: len(x) - n + 1] * np.uint32(0x85EBCA77) + x[n - 1 :] * np.uint32(0xC2B2AE3D) if len(x) >= n else h[:0]
        g = h + np.uint32(n)
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x2C1B3C6D)
        g ^= g >> np.uint32(13)
        g *= np.uint32(0x297A2D39)
        own = place[: len(h)] <= (sizes[doc[: len(h)]] - n)
        out[(offset[doc[: len(h)]] + place[: len(h)])[own]] = (g >> np.uint32(32 - BITS))[own]
        offset += count
    return out, bounds


class Model:
    """languages, weights (buckets x languages, idf included), bias and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.bias, self.temperature = languages, bias, temperature
        self.columns = [np.ascontiguousarray(weights[:, k]) for k in range(len(languages))]

    def logits(self, texts: list[str]) -> np.ndarray:
        b, bounds = grams(texts)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        out = np.tile(self.bias, (len(texts), 1))
        if len(some):
            for k, w in enumerate(self.columns):
                out[some, k] += np.add.reduceat(w[b], bounds[:-1][some]) * SCALE / n[some]
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> Model:
    """FTRL-proximal over the texts in a seeded order; every fifth text is left for the temperature."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    size, k = 1 << BITS, len(languages)
    df = np.zeros(size)
    rows = []
    for t in texts:
        u, n = np.unique(grams([t])[0], return_counts=True)
        df[u] += 1
        rows.append((u, n / max(n.sum(), 1) * SCALE))
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    order = np.random.default_rng(seed).permutation(len(texts))
    kept, seen = order[::5], np.delete(order, np.s_[::5])
    if not len(seen):
        seen = order
    z, q = np.zeros((size, k)), np.zeros((size, k))
    zb, qb = np.zeros(k), np.zeros(k)

    def weights(zz, qq):
        return np.where(np.abs(zz) <= l1, 0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(qq)) / alpha + l2))

    for _ in range(epochs):
        for i in seen:
            u, x = rows[i]
            x = x * idf[u]
            w = weights(z[u], q[u])
            b = -zb / ((beta + np.sqrt(qb)) / alpha)
            p = softmax((x @ w + b)[None])[0]
            p[y[i]] -= 1
            g = x[:, None] * p
            s = (np.sqrt(q[u] + g * g) - np.sqrt(q[u])) / alpha
            z[u] += g - s * w
            q[u] += g * g
            sb = (np.sqrt(qb + p * p) - np.sqrt(qb)) / alpha
            zb += p - sb * b
            qb += p * p
    model = Model(languages, weights(z, q) * idf[:, None], -zb / ((beta + np.sqrt(qb)) / alpha), 1.0)
    held = [i for i in kept if len(rows[i][0])]
    if held and k > 1:
        logits = model.logits([texts[i] for i in held])
        sure = (len(held) + 1) / (len(held) + 2)  # without an error among n texts, no more than this is known
        target = np.full(logits.shape, (1 - sure) / (k - 1))
        target[np.arange(len(held)), y[held]] = sure
        loss = [(-(target * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(axis=1).mean(), t) for t in np.geomspace(0.05, 20, 61)]
        model.temperature = float(min(loss)[1])
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, sample_text: int = SAMPLE_TEXT, languages: int = LANGUAGES) -> list:
    """The rows to learn from (doc_id, lang, text), in an order that doesn't depend on partitions; bounded as stated above."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).withColumn("size", F.octet_length("text"))
    small = F.col("size") <= sample_text
    sizes = known.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(small).alias("n"), F.sum(F.when(small, F.col("size"))).alias("b"), F.min("size").alias("least"))
    sizes = sizes.orderBy(F.desc("all"), "lang").limit(languages).collect()
    if not sizes:
        return []
    k = len(sizes)
    share = {r.lang: min(1.0, per_language / r.n, sample_docs / k / r.n, sample_bytes / k / max(r.b, 1)) if r.n else 1.0 for r in sizes}
    table = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("lang")]
    most = table({r.lang: max(sample_text, r.least) for r in sizes})
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(5)), 1)
    drawn = known.where((F.col("size") <= most) & (place < F.least(table(share) * float(1 << 63), F.lit((1 << 63) - 1))))
    rows = drawn.select("doc_id", "lang", "text").orderBy(place, "doc_id", "lang").limit(2 * sample_docs).collect()
    held, out = 0, []
    for r in rows:
        held += len(r.text.encode())
        if out and held > 2 * sample_bytes:
            break
        out.append(r)
    return sorted(out, key=lambda r: (r.doc_id, r.lang, r.text))


def train(docs: DataFrame, **bounds: int) -> Model | None:
    """The model of a bounded sample of docs (doc_id, text, lang); None if no row has an id, a text with a letter and a language."""
    rows = [r for r in sample(docs, **bounds) if any(map(str.isalpha, r.text))]
    return fit([r.text for r in rows], [r.lang for r in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred and score in place of columns of these names."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if own and t and any(map(str.isalpha, t))]
            at = 0
            while at < len(some):
                end, size = at, 0
                while end < len(some) and (end == at or size + len(texts[some[end]]) <= c.SLICE_BYTES // 4):
                    size += len(texts[some[end]])
                    end += 1
                best, p = own.predict([texts[i] for i in some[at:end]])
                for i, k, s in zip(some[at:end], best.tolist(), p.tolist()):
                    lang[i], score[i] = own.languages[k], s
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return c.map_batches(docs, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: language and calibrated score of every document, learned from the rows that aren't held out."""
    docs = c.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
