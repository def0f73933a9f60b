"""Quality classifier: a convolutional network over bytes, in numpy.

Every byte has a learned vector of WIDTH numbers. A window is two neighbouring cells of CELL bytes, one window at every cell, so
windows overlap by half and every byte is read; FILTERS learned filters see each window. Chunks are CHUNK cells long and overlap by
a quarter; a chunk's filter value is its largest (max pooling, then a rectifier). A text is the mean of its chunks' values and the
largest of them, from which a logistic layer makes one probability. Forward and backward passes are written out below;
training is Adam on the cross entropy, classes weighted evenly, and a bias that gives the classes their shares back.

The network is fitted on the driver from a bounded sample: at most ``sample_docs`` labelled rows are expected to be drawn by a hash of
their id, half of each class where there are so many, and of their documents those of at most ``sample_text`` bytes, whole texts, up to
``sample_bytes`` in all; never more than twice ``sample_docs`` rows come to the driver. Scores are given to all documents, whole
texts: a text is read in slices of SLICE bytes, whose chunk values are added up, so memory doesn't depend on its length.

Defined cases: a null or empty text is padding alone, and has the network's score of that. A label that is neither 0 nor 1 and
rows with a null id are never learned from; rows with a null id are scored and not held out. Repeated labels and repeated ids are examples each. With labels of one class alone, or none, every score is the share of
label 1 (0.5 without any). Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

CELL, CHUNK, STEP = 4, 64, 48  # bytes a cell; cells a chunk; cells from chunk to chunk
WIDTH, FILTERS = 8, 32
BLOCK = 16  # cells; chunk and step are whole numbers of blocks
SLICE = 1 << 18
PAD = 256
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT = 3000, 12 << 20, 16 << 10


class Layout:
    """Cells and chunks of texts laid one after the other.

    A text takes whole blocks: its bytes, then a cell of padding at least. The window at its last cell would see the next text and is left
    out. Chunks start at every STEP cells and end at the text's last block at the latest. closed: False for the slice of a
    text that goes on, which is whole blocks.
    """

    def __init__(self, texts: list[bytes], closed: bool = True):
        per = BLOCK * CELL
        self.blocks = np.array([-(-(len(t) + CELL * closed) // per) for t in texts])
        self.codes = np.full(int(self.blocks.sum()) * per + CELL, PAD, np.int16)  # one more cell: the last window's second half
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        for t, at in zip(texts, self.first[:-1].tolist()):
            self.codes[at * per : at * per + len(t)] = np.frombuffer(t, np.uint8)
        wide, step = CHUNK // BLOCK, STEP // BLOCK
        self.chunks = np.maximum(1, -(-(self.blocks - wide) // step) + 1)
        number = np.arange(int(self.chunks.sum())) - np.repeat(np.cumsum(self.chunks) - self.chunks, self.chunks)
        self.start = np.repeat(self.first[:-1], self.chunks) + number * step  # first block of each chunk
        self.stop = np.minimum(self.start + wide, np.repeat(self.first[1:], self.chunks))
        self.edge = np.concatenate([[0], np.cumsum(self.chunks)])
        self.last = self.first[1:] * BLOCK - 1 if closed else np.zeros(0, np.int64)


class Network:
    """embed: 257 x WIDTH; filters: two halves of (CELL * WIDTH) x FILTERS; bias; top: 2 * FILTERS weights; offset."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (257, WIDTH)).astype(np.float32)
        self.filters = r.normal(0, 1 / np.sqrt(2 * CELL * WIDTH), (CELL * WIDTH, 2 * FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.top = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.top, self.offset]

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Filter sums of the window at every cell but the last, before the bias."""
        halves = self.embed[codes].reshape(-1, CELL * WIDTH) @ self.filters
        return halves[:-1, :FILTERS] + halves[1:, FILTERS:]

    def pooled(self, plan: Layout) -> tuple[np.ndarray, np.ndarray]:
        """(filter sums of all windows, chunk values: chunks x FILTERS)."""
        sums = self.windows(plan.codes)
        sums[plan.last] = -np.inf
        blocks = sums.reshape(-1, BLOCK, FILTERS).max(axis=1)
        top = blocks[plan.start]
        for k in range(1, CHUNK // BLOCK):
            np.maximum(top, blocks[np.minimum(plan.start + k, plan.stop - 1)], out=top)
        return sums, np.maximum(top + self.bias, 0)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Means and maxima of the chunk values of each text."""
        out = np.zeros((len(texts), 2 * FILTERS))
        short = [i for i, t in enumerate(texts) if len(t) <= SLICE]
        at = 0
        while at < len(short):
            end, size = at, 0
            while end < len(short) and (end == at or size + len(texts[short[end]]) <= SLICE):
                size += len(texts[short[end]])
                end += 1
            plan = Layout([texts[i] for i in short[at:end]])
            _, values = self.pooled(plan)
            some = short[at:end]
            out[some, :FILTERS] = np.add.reduceat(values, plan.edge[:-1], axis=0, dtype=np.float64) / plan.chunks[:, None]
            out[some, FILTERS:] = np.maximum.reduceat(values, plan.edge[:-1], axis=0)
            at = end
        for i in set(range(len(texts))) - set(short):
            out[i] = self._long(texts[i])
        return out

    def _long(self, text: bytes) -> np.ndarray:
        """As above, a slice of chunks at a time; a slice also holds the bytes that its last chunk shares with the next."""
        total, most, number = np.zeros(FILTERS), np.zeros(FILTERS), 0
        step = max(1, SLICE // (STEP * CELL)) * STEP * CELL
        over = (CHUNK - STEP) * CELL
        at = 0
        while True:
            last = len(text) - at + CELL <= step + over
            plan = Layout([text[at:] if last else text[at : at + step + over]], closed=last)
            if not last:
                seen = text[at + step + over : at + step + over + CELL]
                plan.codes[step + over : step + over + len(seen)] = np.frombuffer(seen, np.uint8)
            _, values = self.pooled(plan)
            total += values.sum(axis=0, dtype=np.float64)
            np.maximum(most, values.max(axis=0), out=most)
            number += len(values)
            if last:
                return np.concatenate([total / number, most])
            at += step

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.top.astype(np.float64) + float(self.offset[0]), -500, 500)))

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Weighted cross entropy of a batch, and its gradients by each parameter."""
        plan = Layout(texts)
        sums, values = self.pooled(plan)
        n = len(texts)
        doc = np.repeat(np.arange(n), plan.chunks)
        mean = np.add.reduceat(values, plan.edge[:-1], axis=0) / plan.chunks[:, None]
        most = np.maximum.reduceat(values, plan.edge[:-1], axis=0)
        both = np.concatenate([mean, most], axis=1)
        p = 1 / (1 + np.exp(-np.clip(both @ self.top + self.offset[0], -60, 60)))
        loss = -float((weight * np.where(y == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum())
        d = weight * (p - y)
        g_top, g_offset = both.T @ d, np.array([d.sum()], np.float32)
        back = d[:, None] * self.top
        g = (back[:, :FILTERS] / plan.chunks[:, None])[doc]
        first = values == most[doc]  # of equal chunks each is followed; shares keep the sum right
        share = np.add.reduceat(first.astype(np.float32), plan.edge[:-1], axis=0)
        g += np.where(first, (back[:, FILTERS:] / share)[doc], 0)
        g *= values > 0
        which, f = np.nonzero(g)
        amount = g[which, f]
        # the window in which each chunk's filter is largest
        cells = BLOCK * plan.start[which][:, None] + np.arange(CHUNK)
        cells = np.minimum(cells, BLOCK * plan.stop[which][:, None] - 1)
        at = cells[np.arange(len(which)), sums[cells, f[:, None]].argmax(axis=1)]
        g_bias = np.bincount(f, amount, FILTERS).astype(np.float32)
        g_filters, g_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for half in (0, 1):
            codes = plan.codes[(at + half)[:, None] * CELL + np.arange(CELL)]
            x = self.embed[codes].reshape(len(at), -1)
            hot = np.zeros((len(at), FILTERS), np.float32)
            hot[np.arange(len(at)), f] = amount
            g_filters[:, half * FILTERS : (half + 1) * FILTERS] = x.T @ hot
            into = (amount[:, None] * self.filters[:, half * FILTERS + f].T).reshape(-1, WIDTH)
            flat = codes.ravel()
            for k in range(WIDTH):
                g_embed[:, k] += np.bincount(flat, into[:, k], 257).astype(np.float32)
        return loss, [g_embed, g_filters, g_bias, g_top.astype(np.float32), g_offset]


def fit(texts: list[bytes], labels: list[int], epochs: int = 12, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 11, share: float | None = None) -> Network:
    """Adam over seeded orders of the texts. share: of label 1 among all labels, of which these are drawn by class."""
    net = Network(seed)
    y = np.array(labels, np.float32)
    own = float(y.mean())
    share = own if share is None else share
    weight = np.where(y == 1, 0.5 / own, 0.5 / (1 - own)).astype(np.float32)
    r = np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    t, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            _, grads = net.gradients([texts[j] for j in some], y[some], weight[some] / len(some))
            t += 1
            now = rate * (1 - t / (steps + 1))
            for p, g, m, v in zip(net.params(), grads, first, second):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.offset += np.float32(np.log(share / (1 - share)))  # the classes were weighted evenly
    return net


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, sample_text: int = SAMPLE_TEXT) -> tuple[list[bytes], list[int], float]:
    """(texts, their labels, share of label 1 among all labels to learn from). docs: doc_id, text; labels: doc_id, label."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return [], [], counts.get(1, 0) / total if total else 0.5
    place = lambda *of: F.shiftrightunsigned(F.xxhash64(*of, F.lit(9)), 1)
    most = (1 << 63) - 1
    part = {k: min(1.0, sample_docs / 2 / n) for k, n in counts.items()}
    bound = F.when(F.col("label") == 1, F.lit(min(most, int(part[1] * most)))).otherwise(F.lit(min(most, int(part[0] * most))))
    drawn = known.where(place("doc_id") <= bound).orderBy(place("doc_id"), "doc_id", "label").limit(2 * sample_docs)
    met = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= sample_text).join(F.broadcast(drawn), "doc_id")
    rows = met.select("doc_id", "label", "text").orderBy(place("doc_id", "text"), "doc_id", "label", "text").limit(2 * sample_docs).collect()
    texts, ys, held = [], [], 0
    for r in rows:
        held += len(r.text.encode())
        if texts and held > sample_bytes:
            break
        texts.append(r.text.encode())
        ys.append(r.label)
    return texts, ys, counts.get(1, 0) / total


def train(docs: DataFrame, labels: DataFrame, **bounds: int) -> Network | float:
    """The network, or the share of label 1 if there is nothing to tell apart."""
    texts, ys, share = sample(docs, labels, **bounds)
    return fit(texts, ys, share=share) if 0 < sum(ys) < len(ys) else share


def score(docs: DataFrame, model: Network | float, text: str = "text") -> DataFrame:
    """All columns of docs, with score and predicted in place of columns of these names."""
    from pyspark.sql import types as T

    docs = docs.drop("score", "predicted")
    if not isinstance(model, Network):
        return docs.withColumns({"score": F.lit(float(model)), "predicted": F.lit(int(model >= 0.5))})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(text))
            values = [(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(values))], [*batch.schema.names, "score"])

    return c.map_batches(docs, run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: quality score of every document, learned from the labels that aren't held out."""
    docs = c.read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    labels = c.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
