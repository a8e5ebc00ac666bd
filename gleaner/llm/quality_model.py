"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of the whole text passes ``FILTERS`` learned filters of ``WIDTH``
bytes. The responses are max-pooled over chunks of ``2 * STRIDE`` bytes, one
every ``STRIDE`` bytes, so that chunks overlap and cover the whole document. The
mean, maximum and minimum of the chunks' pooled vectors feed a small dense layer
that gives one probability.

Filters over an embedding of 256 byte values are 256-row tables, one per offset,
so that scoring is table look-up and addition, with no multiplication.

The network is fitted on the driver on a bounded sample of labelled rows: at most
about ``max_rows``, half of them of either class while both last, and at most
``max_bytes`` of text, chosen by a hash of doc_id; rows of over a sixteenth of
that are not drawn. A row that is drawn is learned from whole. Scoring covers
every byte of every row. Both work in pieces of ``BLOCK`` bytes.

Defined cases: a null text counts as empty; an empty text is scored as one chunk
of padding; a very long text is scored whole, piece by piece; equal texts score
alike; with one class only, or none, in the training rows the score is that
class's smoothed share; a label of no document, without doc_id or other than 0 or
1 is ignored; a doc_id with several labels takes the lowest, one with several
texts the least; further input columns are kept by ``with_score``, whatever their
names, and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fresh

WIDTH, EMBED, FILTERS, HIDDEN = 5, 8, 16, 12
STRIDE = 128
#: Bytes convolved at a time.
BLOCK = 1 << 18


def _chunks(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes padded to whole strides, and the first stride of each text. starts: n + 1 offsets into ``data``.

    WIDTH - 1 zeros stand before each text, so that no filter reaches from one text into the next.
    """
    sizes = np.diff(starts)
    strides = np.maximum(2, -(-(sizes + WIDTH - 1) // STRIDE))
    first = np.concatenate([[0], np.cumsum(strides)])
    codes = np.zeros(first[-1] * STRIDE + WIDTH, np.uint8)
    at = np.arange(len(data)) + np.repeat(first[:-1] * STRIDE + WIDTH - 1 - starts[:-1], sizes)
    codes[at] = np.frombuffer(data, np.uint8)
    return codes, first


class ByteConvNet:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)), "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)), "bias": np.zeros(FILTERS),
            "dense": r.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)), "dense_bias": np.zeros(HIDDEN), "out": r.normal(0, HIDDEN**-0.5, HIDDEN), "out_bias": np.zeros(1),
        }
        self.constant: float | None = None

    def plain(self) -> dict:
        """Parameters as plain data, for a broadcast that needs no package where it is read."""
        return {"p": self.p, "constant": self.constant}

    @classmethod
    def of(cls, plain: dict) -> ByteConvNet:
        net = cls.__new__(cls)
        net.p, net.constant = plain["p"], plain["constant"]
        return net

    def tables(self) -> np.ndarray:
        return np.einsum("be,kef->kbf", self.p["embed"], self.p["filters"]).astype(np.float32)

    def _pooled(self, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Largest response of each stride and filter."""
        n = len(codes) - WIDTH
        x = tables[0][codes[:n]]
        for k in range(1, WIDTH):
            x += tables[k][codes[k : n + k]]
        return x.reshape(-1, STRIDE, FILTERS)

    def _joined(self, strides: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Chunks of two strides; their mean, max and min per text (no chunk spans two texts)."""
        chunks = np.maximum(strides[:-1], strides[1:])
        keep = np.ones(len(chunks), bool)
        keep[first[1:-1] - 1] = False
        chunks = chunks[keep]
        at = first[:-1] - np.arange(len(first) - 1)
        n = np.diff(first) - 1
        return chunks, keep, at, n, np.concatenate([np.add.reduceat(chunks, at) / n[:, None], np.maximum.reduceat(chunks, at), np.minimum.reduceat(chunks, at)], axis=1)

    def _head(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p["dense"] + self.p["dense_bias"])
        return h, 1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["out_bias"], -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability that a text is good, for each text, over all of its bytes."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, tables, i = np.zeros(len(texts)), self.tables(), 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                size += len(texts[j])
                j += 1
            codes, first = _chunks(b"".join(texts[i:j]), np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])]).astype(np.int64))
            per = BLOCK // STRIDE  # a longer text in parts, pooled stride by stride
            top = [self._pooled(codes[a * STRIDE : min(a + per, first[-1]) * STRIDE + WIDTH], tables).max(axis=1) for a in range(0, first[-1], per)]
            strides = np.maximum(np.concatenate(top) + self.p["bias"].astype(np.float32), 0)
            out[i:j] = self._head(self._joined(strides, first)[-1])[1]
            i = j
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray, prior: float, steps: int = 1100, batch: int = 32, rate: float = 6e-3, seed: int = 11) -> ByteConvNet:
        """Adam on the log loss; ``prior`` is the share of label 1 to which the two classes are weighted."""
        labels = np.asarray(labels, float)
        if len(set(labels)) < 2:
            self.constant = float((labels.sum() + 1) / (len(labels) + 2))
            return self
        weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
        r = np.random.default_rng(seed)
        mean, square, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        epochs = -(-steps // -(-len(texts) // batch))
        rounds = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                g = self._gradients([texts[i] for i in own], labels[own], weight[own])
                step += 1
                speed = rate * (0.5 + 0.5 * np.cos(np.pi * step / rounds)) + 1e-5
                for k, d in g.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * d
                    square[k] = 0.99 * square[k] + 0.01 * d * d
                    self.p[k] -= speed * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        codes, first = _chunks(b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        tables, per, where, raw = self.tables(), BLOCK // STRIDE, [], []
        for a in range(0, first[-1], per):
            full = self._pooled(codes[a * STRIDE : min(a + per, first[-1]) * STRIDE + WIDTH], tables)
            where.append(full.argmax(axis=1))
            raw.append(np.take_along_axis(full, where[-1][:, None, :], axis=1)[:, 0])
        where, raw = np.concatenate(where), np.concatenate(raw) + self.p["bias"]
        strides = np.maximum(raw, 0)
        chunks, keep, at, n, z = self._joined(strides, first)
        h, prob = self._head(z)
        d_logit = weight * (prob - y) / len(y)
        d_h = np.outer(d_logit, self.p["out"]) * (1 - h * h)
        d_z = d_h @ self.p["dense"].T
        text_of = np.repeat(np.arange(len(n)), n)
        d_mean, d_max, d_min = np.split(d_z, 3, axis=1)
        zmax, zmin = z[:, FILTERS : 2 * FILTERS], z[:, 2 * FILTERS :]
        d_chunk = d_mean[text_of] / n[text_of][:, None]
        for best, d in ((chunks == zmax[text_of], d_max), (chunks == zmin[text_of], d_min)):
            ties = np.add.reduceat(best, at, axis=0, dtype=float)
            d_chunk = d_chunk + best * (d / np.maximum(ties, 1))[text_of]
        left, right = np.flatnonzero(keep), np.flatnonzero(keep) + 1
        takes_left = strides[left] >= strides[right]
        d_stride = np.zeros_like(strides)
        np.add.at(d_stride, left, np.where(takes_left, d_chunk, 0))
        np.add.at(d_stride, right, np.where(takes_left, 0, d_chunk))
        d_stride *= raw > 0
        position = (where + np.arange(len(where))[:, None] * STRIDE).ravel()
        column, d = np.tile(np.arange(FILTERS), len(where)), d_stride.ravel()
        g_embed, g_filters = np.zeros_like(self.p["embed"]), np.zeros_like(self.p["filters"])
        for k in range(WIDTH):
            table = np.zeros((256, FILTERS))
            np.add.at(table, (codes[position + k], column), d)
            g_embed += table @ self.p["filters"][k].T
            g_filters[k] = self.p["embed"].T @ table
        return {"embed": g_embed, "filters": g_filters, "bias": d_stride.sum(axis=0), "dense": z.T @ d_h, "dense_bias": d_h.sum(axis=0), "out": h.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2400, max_bytes: int = 24 << 20) -> ByteConvNet:
    """Fit on documents (doc_id, text) with ``labels`` (doc_id, quality); see the module for the bounds."""
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r.quality: r.n for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    bad = min(sizes.get(0, 0), max_rows // 2)
    wanted = {0: bad, 1: min(sizes.get(1, 0), max_rows - bad)}
    share = F.when(F.col("quality") == 1, wanted[1] / max(sizes.get(1, 0), 1)).otherwise(wanted[0] / max(sizes.get(0, 0), 1))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    picked = own.where(unit < share)  # about max_rows
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = bounded_sample(one, "doc_id", share, max_bytes).toArrow().sort_by("doc_id").to_pydict()
    total = sum(sizes.values())
    return ByteConvNet().fit([t.encode() for t in rows["text"]], np.array(rows["quality"]), sizes.get(1, 0) / max(total, 1))


def with_score(docs: DataFrame, net: ByteConvNet, name: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality in a new column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(net.plain())
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ByteConvNet.of(shared.value)
        for batch in batches:
            out = known.score([b or b"" for b in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*own, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.withColumn(fresh(docs, "bytes_"), F.col("text").cast("string").cast("binary")).mapInArrow(run, schema)


def score(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id, score for every row."""
    return with_score(docs.select("doc_id", "text"), net).select("doc_id", "score")
