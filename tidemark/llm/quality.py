"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a fixed sparse ternary index vector drawn from its hash. Over all
documents, a word's context vector is the sum of the index vectors of its
neighbours; words share ``2**bucket_bits`` buckets, so the model's size is fixed and
each task sends one partial matrix, summed per bucket. A document is the mean and
the spread of its words' normalised context and index vectors. A two-layer numpy
network is trained on at most ``max_labels`` labelled documents (a documented bound,
taken by the order of a hash of doc_id, half of it at most from either class) and
its probabilities are calibrated by a temperature fitted on a part of them kept out.

Labels of documents in the held-out fold (crc32 of doc_id as text, modulo 5, is 0)
are never learned from; lang, source and doc_id are no inputs.

Defined cases: null or blank text has no words and is scored from zero vectors;
repeated rows get equal scores; labels that are null, or whose document is missing,
are not learned from; without labels of both classes every score is the share of
ones (0.5 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, as_docs, chunks, mix, small_batches, word_bounds

BUCKET_BITS, DIMS, REACH, NONZERO = 14, 24, 2, 2


def index_vectors(bucket_bits: int = BUCKET_BITS, dims: int = DIMS, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, the dimensions and the signs of its index vector's nonzero components."""
    h = mix(np.arange(1, (1 << bucket_bits) + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(nonzero, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h >> np.uint64(8)) % np.uint64(dims)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0)


def _words(data, offs, bits):
    s, e, first = word_bounds(data, offs)
    return (RangeHash(data).of(s, e) >> np.uint64(64 - bits)).astype(np.int64), first


def _context_task(bits: int, dims: int, reach: int):
    def run(batches):
        at_dim, sign = index_vectors(bits, dims)
        sums = np.zeros((1 << bits) * dims)
        for b in batches:
            for _, _, data, offs in chunks(b):
                w, first = _words(data, offs, bits)
                row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                for d in range(1, reach + 1):
                    if len(w) <= d:
                        continue
                    same = row[d:] == row[:-d]
                    left, right = w[:-d][same], w[d:][same]
                    for a, c in ((left, right), (right, left)):
                        for j in range(at_dim.shape[1]):
                            sums += np.bincount(a * dims + at_dim[c, j], sign[c, j], minlength=len(sums))
        sums = sums.reshape(-1, dims)
        used = np.flatnonzero(np.abs(sums).sum(1))
        step = 2048
        for i in range(0, len(used), step):
            at = used[i : i + step]
            flat = pa.array(sums[at].ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * dims + 1, dims), pa.int32()), flat)], names=["bucket", "v"])

    return run


def context_vectors(docs: DataFrame, bits: int = BUCKET_BITS, dims: int = DIMS, reach: int = REACH) -> np.ndarray:
    """The summed context vectors of all buckets over all documents: 2**bits x dims doubles."""
    part = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_context_task(bits, dims, reach), "bucket int, v array<double>")
    total = part.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(dims)])
    out = np.zeros((1 << bits, dims))
    table = total.toArrow()
    out[table["bucket"].to_numpy()] = np.stack([table[f"v{i}"].to_numpy() for i in range(dims)], 1) if len(table) else 0
    return out


class Pooler:
    """Document vectors: mean and spread of the words' context and index vectors."""

    def __init__(self, context: np.ndarray, bits: int = BUCKET_BITS):
        dims = context.shape[1]
        self.bits = bits
        at, sign = index_vectors(bits, dims)
        own = np.zeros_like(context)
        for j in range(at.shape[1]):
            np.add.at(own, (np.arange(len(own)), at[:, j]), sign[:, j])
        norm = np.sqrt((context**2).sum(1, keepdims=True))
        self.table = np.concatenate([context / np.maximum(norm, 1e-9), own * 0.5, np.log1p(norm) / 10], 1).astype(np.float32)
        self.width = 2 * self.table.shape[1]

    def pool(self, data, offs) -> np.ndarray:
        w, first = _words(data, offs, self.bits)
        n = np.diff(first).astype(np.float32)[:, None]
        out = np.zeros((len(offs) - 1, self.width), np.float32)
        some = np.flatnonzero(n[:, 0])
        if not len(some):
            return out
        half = self.table.shape[1]
        total, square = np.zeros((len(some), half)), np.zeros((len(some), half))
        # a long document is summed a part at a time
        step = 1 << 16
        row = np.repeat(np.arange(len(some)), n[some, 0].astype(np.int64))
        for i in range(0, len(w), step):
            x, r = self.table[w[i : i + step]], row[i : i + step]
            cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            total[r[cut]] += np.add.reduceat(x, cut, 0)
            square[r[cut]] += np.add.reduceat(x * x, cut, 0)
        mean = total / n[some]
        spread = np.sqrt(np.maximum(0, square / n[some] - mean**2))
        out[some, :half], out[some, half:] = mean, spread
        return out


class Network:
    """Two layers (tanh, logistic), Adam, then a temperature for the logits."""

    def __init__(self, width: int, hidden: int = 24, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0
        self.constant = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 1200, rate: float = 0.01, decay: float = 1e-3, seed: int = 2) -> "Network":
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        r = np.random.default_rng(seed)
        out = np.zeros(len(y), bool)
        out[r.permutation(len(y))[: max(1, len(y) // 6)]] = len(y) >= 30
        xt, yt = x[~out], y[~out]
        self.mean, self.scale = xt.mean(0), xt.std(0) + 1e-3
        z = (xt - self.mean) / self.scale
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, steps + 1):
            i = r.integers(0, len(z), min(256, len(z)))
            a, b = z[i], yt[i]
            h = np.tanh(a @ self.p[0] + self.p[1])
            d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3][0]))) - b) / len(i)
            back = np.outer(d, self.p[2]) * (1 - h * h)
            grads = [a.T @ back + decay * self.p[0], back.sum(0), h.T @ d + decay * self.p[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if out.any():
            g, yo = self.logits(x[out]), y[out]
            best = min(np.geomspace(0.5, 8, 25), key=lambda t: float(np.mean(np.logaddexp(0, -(2 * yo - 1) * g / t))))
            self.temperature = float(best)
        return self


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_labels: int) -> DataFrame:
    """At most max_labels documents (doc_id, text, y): by the order of a hash of doc_id within
    each class, no class more than half; none of the held-out fold; of a doc_id's texts one, by hash."""
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(fold != held).distinct()
    order = F.xxhash64("doc_id"), F.col("doc_id")
    each = max(1, max_labels // 2)
    chosen = y.where("y = 0").orderBy(*order).limit(each).unionAll(y.where("y = 1").orderBy(*order).limit(each))
    found = as_docs(docs).join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    return found.groupBy("doc_id", "y").agg(F.min(F.struct("h", "text")).alias("t")).select("doc_id", "t.text", "y")


def _text_arrays(texts: list[str | None]):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _pool_task(pooler_shared):
    def run(batches):
        pooler = pooler_shared.value
        for b in batches:
            for at, to, data, offs in chunks(b):
                x = pooler.pool(data, offs)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, pooler.width), pa.int32()), pa.array(x.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at:to], flat, b.column("y")[at:to]], names=["doc_id", "x", "y"])

    return run


def _score_task(shared):
    def run(batches):
        pooler, net = shared.value
        for b in batches:
            for at, to, data, offs in chunks(b):
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at:to], pa.array(net.score(pooler.pool(data, offs)), pa.float64())], names=["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, max_labels: int = 8000):
    """(pooler, network): context vectors from all documents, the network from the bounded sample."""
    small_batches(docs.sparkSession)
    pooler = Pooler(context_vectors(docs))
    shared = docs.sparkSession.sparkContext.broadcast(pooler)  # 2**bucket_bits rows, whatever the corpus
    rows = training_rows(docs, labels, label, folds, held, max_labels).mapInArrow(_pool_task(shared), "doc_id long, x array<float>, y int").toArrow()
    x = np.concatenate([c.flatten().to_numpy() for c in rows["x"].chunks] or [np.zeros(0, np.float32)]).reshape(-1, pooler.width).astype(np.float64)
    ids, y = rows["doc_id"].to_numpy(), rows["y"].to_numpy().astype(float)
    order = np.lexsort((x[:, 0] if len(x) else ids, y, ids))  # tasks may answer in any order
    return pooler, Network(pooler.width).fit(x[order], y[order])


def _keep_task(shared, threshold: float):
    def run(batches):
        pooler, net = shared.value
        for b in batches:
            for at, to, data, offs in chunks(b):
                keep = net.score(pooler.pool(data, offs)) >= threshold
                yield b.slice(at, to - at).filter(pa.array(keep))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labels: int = 8000) -> DataFrame:
    """The rows of docs, all columns, whose text the classifier does not reject."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labels=max_labels))
    return docs.mapInArrow(_keep_task(model, threshold), docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labels: int = 8000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labels=max_labels))
    out = as_docs(docs).mapInArrow(_score_task(model), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
