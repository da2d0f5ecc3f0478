"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's features are counts of hashed byte trigrams and of hashed 4-grams of its character shapes (letter cases and digits
folded, punctuation kept), damped and weighted by inverse frequency; a singular value decomposition of a sample gives the
latent space. Labelled vectors are broadcast; every document's cosines with all of them come from blocked matrix products,
exactly, and the nearest neighbours' labels are weighted by similarity.

Bound: the model is fitted on at most `max_labelled` labelled rows (those of least hash of the id), which fixes the size of
what is broadcast (about max_labelled * (dims + 1) * 4 bytes) at any corpus size. Every document is scored, whole.
Only text is an input of a score; labels come from rows outside the held-out fold alone.

Cases: null, empty and very short texts get the share of label 1 among the fitted rows, as do all if nothing is labelled
(then 0.5); null labels and ids without a document are not used; of equally similar neighbours those of smaller ids count first;
repeated rows give repeated results; an empty table gives an empty result; other columns never count and stay, but for those named score or
predicted, which give way in score().
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import corpus, hide, least_hashes, show, table

BUCKETS = 1024  # for each of the two kinds of n-grams
BLOCK = 512


def _shapes() -> np.ndarray:
    """Byte -> character class: lower 1, upper 2, digit 3, blank 4, line end 5, bytes of other letters 6, other ASCII its own."""
    t = np.zeros(256, np.uint64)
    for b in range(256):
        c = chr(b)
        t[b] = 6 if b >= 0x80 else 5 if c == "\n" else 4 if c in " \t\r\x0b\x0c" else 3 if c.isdigit() else 2 if c.isupper() else 1 if c.islower() else 7 + b
    return t


SHAPES = _shapes()
MULT = np.uint64(0x9E3779B97F4A7C15)


def _counts(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(BUCKETS, np.float32)
    key = np.zeros(m, np.uint64)
    for i in range(n):
        key = key * np.uint64(base) + codes[i : i + m]
    return np.bincount(((key * MULT) >> np.uint64(54)).astype(np.int64), minlength=BUCKETS).astype(np.float32)


def features(text: bytes | None, piece: int = 1 << 20) -> np.ndarray:
    """Damped relative counts of both kinds of n-grams; a long text is counted in overlapping pieces, whole."""
    raw = np.frombuffer(text or b"", np.uint8)
    out = np.zeros(2 * BUCKETS, np.float32)
    for at in range(0, max(1, len(raw)), piece):
        part = raw[at : at + piece + 3]
        out[:BUCKETS] += _counts(part[: piece + 2].astype(np.uint64), 3, 256)
        out[BUCKETS:] += _counts(SHAPES[part], 4, 200)
    if len(raw):
        out *= 1000.0 / len(raw)
    return np.log1p(out)


def _leading(gram: np.ndarray, dims: int, more: int = 80, rounds: int = 300, near: float = 1e-6) -> np.ndarray:
    """The first eigenvectors of a symmetric matrix, as rows, by subspace iteration until none is off by more than `near` of the greatest
    eigenvalue. It holds a few columns beside the matrix, where eigh() takes ten times the matrix; that is asked if this doesn't settle."""
    q = np.random.default_rng(0).standard_normal((len(gram), min(len(gram), dims + more)))
    for _ in range(rounds):
        q = np.linalg.qr(q)[0]
        z = np.concatenate([gram[at : at + BLOCK].astype(np.float64) @ q for at in range(0, len(gram), BLOCK)])
        values, turn = np.linalg.eigh(q.T @ z)
        first = turn[:, ::-1][:, :dims]
        top, image = values[::-1][:dims], z @ first
        if np.linalg.norm(image - q @ first * top, axis=0).max() <= near * abs(top).max():
            return (q @ first).T
        q = z
    return np.linalg.eigh(gram)[1].T[::-1][:dims]


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int, neighbours: int, power: float):
        self.neighbours, self.power = neighbours, power
        self.share = float(y.mean()) if len(y) else 0.5
        self.y = y.astype(np.float32)
        if not len(y):
            return
        blocks = [slice(at, at + BLOCK) for at in range(0, len(x), BLOCK)]  # whole copies of x would fill the driver
        self.weight = np.log((1 + len(x)) / (1 + sum((x[b] > 0).sum(axis=0) for b in blocks))).astype(np.float32) + np.float32(0.1)
        self.mean = (sum((x[b] * self.weight).sum(axis=0, dtype=np.float64) for b in blocks) / len(x)).astype(np.float32)
        centred = lambda b: x[b] * self.weight - self.mean
        if len(x) < x.shape[1]:
            v = np.linalg.svd(np.concatenate([centred(b) for b in blocks]), full_matrices=False)[2]
        else:
            gram = np.zeros((x.shape[1], x.shape[1]), np.float32)
            for b in blocks:
                c = centred(b)
                gram += c.T @ c
            v = _leading(gram, dims)
            del gram
        self.basis = np.ascontiguousarray(v[:dims].T, np.float32)
        del v
        self.vectors = np.ascontiguousarray(np.concatenate([self._unit(centred(b) @ self.basis) for b in blocks]).T)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    @staticmethod
    def _nearest(cos: np.ndarray, k: int) -> np.ndarray:
        """The places of each row's k greatest values; of equal ones the first."""
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cos, near, axis=1).min(axis=1)
        for i in np.flatnonzero((cos >= least[:, None]).sum(axis=1) > k):
            at = np.flatnonzero(cos[i] >= least[i])
            near[i] = at[np.argsort(-cos[i, at], kind="stable")[:k]]
        return near

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not len(self.y):
            return out
        for at in range(0, len(texts), BLOCK):
            own = texts[at : at + BLOCK]
            x = np.stack([features(t) for t in own])
            cos = self._unit((x * self.weight - self.mean) @ self.basis) @ self.vectors
            k = min(self.neighbours, cos.shape[1])
            near = self._nearest(cos, k)
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 0) ** self.power + 1e-9
            vote = (w * self.y[near]).sum(axis=1) / w.sum(axis=1)
            out[at : at + BLOCK] = np.where([bool(t) and len(t) >= 4 for t in own], vote, self.share)
        return out


def held_out(doc_id: str = "doc_id"):
    """Fold: crc32 of the id as text, mod 4, is 2; a null id is not held out, nor ever learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4096, dims: int = 48, neighbours: int = 25, power: float = 4.0) -> Model:
    """The model from at most max_labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y is not null")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = least_hashes(known, "_id", max_labelled).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    chosen = F.broadcast(sample)  # max_labelled rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                x = [features(t).astype(np.float16).tobytes() for t in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(x, pa.binary())], ["id", "y", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").cast("binary").alias("_text")).join(chosen, F.col("_doc") == F.col("_id"))
    got = rows.select("_id", "_y", "_text").mapInArrow(run, "id long, y int, x binary").toArrow()
    order = pc.sort_indices(got, [("id", "ascending"), ("x", "ascending")]).to_numpy()
    order = order[np.unique(got["id"].to_numpy()[order], return_index=True)[1]]  # one row of each id
    x, y = np.empty((len(order), 2 * BUCKETS), np.float16), got["y"].to_numpy()[order].astype(np.int64)
    for i, at in enumerate(order.tolist()):
        x[i] = np.frombuffer(got["x"][at].as_py(), np.float16)
    del got
    return Model(x, y, dims, neighbours, power)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, and score double, predicted int."""
    known = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    hidden, names, text = hide(docs)
    given = hidden.withColumn("bytes", F.col(text).cast("string").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(known.value)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                s = pa.array(m.scores(part.column(part.num_columns - 1).to_pylist()), pa.float64())
                yield pa.record_batch([*part.columns[:-1], s], [*part.schema.names[:-1], "score"])

    scored = given.mapInArrow(run, hidden.withColumn("score", F.lit(0.0)).schema)
    return show(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), names, "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, **options), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The documents that are predicted good, with their own columns."""
    hidden, names, text = hide(docs)
    marked = score(hidden.withColumn("text", F.col(text)), fit(docs, labels, **options), threshold)
    return show(marked.where("predicted = 1"), names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(corpus(spark, sf_dir), table(spark, sf_dir, "labels"))
