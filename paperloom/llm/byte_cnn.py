"""A byte-level convolutional quality classifier in numpy.

A filter spans ``width`` bytes and has one learned weight per position and byte value, so a convolution is
a sum of table rows.  A text is cut into chunks that overlap by ``width - 1`` bytes and cover it to the
end; each chunk is max-pooled per filter, and the chunks' pooled features, weighted by their lengths, give
one logit.  Training sees a bounded sample; the class balance comes from all training labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = 256


@dataclass(frozen=True)
class CnnParams:
    """``sample``: labelled texts per class to learn from, each whole, taken in the order of a hash of their id;
    ``group``: chunks that are convolved at a time."""

    width: int = 6
    filters: int = 16
    chunk: int = 1024
    sample: int = 1024
    epochs: int = 30
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7
    threshold: float = 0.3
    group: int = 192


def chunks_of(data: bytes, p: CnnParams) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, chunk + width - 1) symbols, and the number of bytes each chunk answers for."""
    n = max(1, -(-len(data) // p.chunk))
    row = np.full(n * p.chunk + p.width - 1, PAD, np.int16)
    row[: len(data)] = np.frombuffer(data, np.uint8)
    spread = np.lib.stride_tricks.sliding_window_view(row, p.chunk + p.width - 1)[:: p.chunk]
    owned = np.full(n, p.chunk, np.float32)
    owned[-1] = max(1, len(data) - (n - 1) * p.chunk)
    return spread, owned


def convolve(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, chunk: int) -> np.ndarray:
    """(chunks, positions, filters) sums of weight rows."""
    out = np.take(weights[0], x[:, :chunk], axis=0)
    for j in range(1, len(weights)):
        out += np.take(weights[j], x[:, j : j + chunk], axis=0)
    return out + bias


class Model:
    """Filter weights (width, 257, filters), their biases, and the output's weights."""

    def __init__(self, p: CnnParams):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.parts = {
            "weights": rng.normal(0, 0.15, (p.width, PAD + 1, p.filters)).astype(np.float32),
            "bias": np.zeros(p.filters, np.float32),
            "out": rng.normal(0, 0.3, p.filters).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectified maximum of each filter in each chunk, and where it was."""
        acts = convolve(x, self.parts["weights"], self.parts["bias"], self.p.chunk)
        at = acts.argmax(axis=1)
        return np.maximum(np.take_along_axis(acts, at[:, None, :], 1)[:, 0, :], 0), at

    def logits(self, x: np.ndarray, owned: np.ndarray, doc: np.ndarray, docs: int):
        parts = [self.pooled(x[s : s + self.p.group]) for s in range(0, len(x), self.p.group)]
        top, at = (np.concatenate(c) for c in zip(*parts))
        share = owned / np.bincount(doc, owned, docs)[doc]
        mean = np.zeros((docs, top.shape[1]), np.float32)
        np.add.at(mean, doc, top * share[:, None].astype(np.float32))
        return mean @ self.parts["out"] + self.parts["shift"][0], mean, top, at, share

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text."""
        group = self.p.group
        sums, whole = np.zeros((len(texts), self.p.filters)), np.zeros(len(texts))
        held, owner, owns = [], [], []

        def flush():
            top, _ = self.pooled(np.concatenate(held))
            own, doc = np.concatenate(owns), np.concatenate(owner)
            np.add.at(sums, doc, top * own[:, None])
            np.add.at(whole, doc, own)

        size = 0
        for i, t in enumerate(texts):
            x, owned = chunks_of(t, self.p)
            for s in range(0, len(x), group):
                part = x[s : s + group]
                held.append(part)
                owns.append(owned[s : s + group])
                owner.append(np.full(len(part), i))
                size += len(part)
                if size >= group:
                    flush()
                    held, owner, owns, size = [], [], [], 0
        if size:
            flush()
        z = (sums / np.maximum(whole, 1)[:, None]) @ self.parts["out"] + self.parts["shift"][0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, prior: float, p: CnnParams) -> Model:
    """Adam on the logistic loss with the classes weighted alike; the output is then shifted to ``prior``,
    the share of label 1 among all training labels.  Texts are learned from whole."""
    model = Model(p)
    if len(texts) == 0 or labels.min() == labels.max():
        model.parts["out"][:] = 0
        model.parts["shift"][0] = math.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
        return model
    rng = np.random.default_rng(p.seed)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in model.parts.items()}
    second = {k: np.zeros_like(v) for k, v in model.parts.items()}
    step = 0
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        order = rng.permutation(len(texts))
        for s in range(0, len(order), p.batch):
            pick = order[s : s + p.batch]
            cut = [chunks_of(texts[i], p) for i in pick]
            x = np.concatenate([c[0] for c in cut])
            owned = np.concatenate([c[1] for c in cut])
            doc = np.repeat(np.arange(len(pick)), [len(c[0]) for c in cut])
            z, mean, top, at, share = model.logits(x, owned, doc, len(pick))
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            dz = dz.astype(np.float32)
            dtop = dz[doc, None] * share[:, None].astype(np.float32) * model.parts["out"] * (top > 0)
            grads = {"weights": np.zeros_like(model.parts["weights"]), "bias": dtop.sum(0), "out": mean.T @ dz, "shift": np.array([dz.sum()])}
            rows = np.arange(len(x))[:, None]
            filters = np.broadcast_to(np.arange(p.filters), at.shape)
            for j in range(p.width):
                np.add.at(grads["weights"][j], (x[rows, at + j], filters), dtop)
            step += 1
            for k, v in model.parts.items():
                g = grads[k] + p.decay * v
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model.parts["shift"][0] += math.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    return model


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; null ids are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, p: CnnParams = CnnParams(), label: str = "quality") -> Model:
    """Learns from the labelled documents that are not held out, at most ``sample`` labels of each class.

    Repeated labels of an id count once in training and each in the class balance; null texts teach nothing."""
    rows = labels.select("doc_id", F.col(label).alias("y")).filter(~is_held_out(F.col("doc_id")) & F.col("y").isin(0, 1))
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    key = F.md5(F.col("doc_id").cast("string"))
    one = lambda y: rows.filter(F.col("y") == y).distinct().orderBy(key, "doc_id").limit(p.sample)
    chosen = docs.sparkSession.createDataFrame([(r[0], r[1]) for y in (0, 1) for r in one(y).collect()], "doc_id long, y int")
    # At most 2 * sample rows: small enough to send to every task.
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    # An id that several rows have stands for its least text, so that there is one row for each id and label.
    found = found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    taken = [tuple(r) for r in found.orderBy("doc_id", "y").collect()]
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    return train([r[2].encode() for r in taken], np.array([r[1] for r in taken], np.float32), prior, p)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted, one row per input row.

    Null texts score as empty ones, which get the score of a chunk of padding; repeated rows score alike;
    an empty table gives an empty result; only doc_id (for held_out) and text are read, whatever other columns
    are called.  Very long texts are scored to their end.
    """
    p = model.p

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, max(b.num_rows, 1), 500):
                part = b.slice(s, 500)
                texts = [(t.as_py() or "").encode("utf-8", "replace") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
