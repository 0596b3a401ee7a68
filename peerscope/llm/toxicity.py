"""Toxicity from subword-bag embeddings.

A text is the bag of the character n-grams of its words, word edges included.
Every n-gram (hashed) has an embedding; the mean of the bag, where a repeated
n-gram weighs the root of its count and ``PRIOR_GRAMS`` blank ones damp short
texts, goes through a linear softmax. Embeddings and softmax are trained
together in numpy, so a misspelling that was never seen still shares most of
its n-grams.

Fitting takes at most ``per_class`` labelled rows of each class, chosen by the
hash of their id, in one task. A fifth of them calibrates the logits, weighted to the true
class sizes. Scoring covers every row whole. Since the softmax is linear, each
task folds it into one number per n-gram.

Defined cases: an empty or null text has an empty bag and scores the prior;
without labels of both classes every score is the share of label 1, or 0;
repeated rows are each scored, and learned from once, with the least of their texts;
labels that are null are ignored, of labels that disagree the higher one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerscope.llm.hashing import BLANK, LOWER
from peerscope.llm.texts import arrow_lists, doc_texts, map_texts

GRAMS = (3, 4, 5)
BUCKET_BITS = 17
PER_CLASS = 2000
#: Blank n-grams in every bag; n-grams in fewer training texts have no embedding.
PRIOR_GRAMS, MIN_TEXTS = 300, 4

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0, *BLANK]] = True
_FLAT = LOWER.copy()
_FLAT[_IS_BLANK] = 0x20


@dataclass
class Model:
    """Embeddings, softmax weights and bias; the calibration is part of the last two."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self) -> np.ndarray:
        """What each n-gram adds to the difference of the two logits."""
        return (self.embeddings @ self.weights).astype(np.float32)


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram buckets row after row, their weights, and the bounds of the rows."""
    buckets, row = text_subwords(data, offsets)
    key, counts = np.unique(row.astype(np.int64) << BUCKET_BITS | buckets, return_counts=True)
    bounds = np.searchsorted(key, np.arange(len(offsets)) << BUCKET_BITS)
    weight = np.sqrt(counts).astype(np.float32)
    total = np.zeros(len(weight) + 1)
    np.cumsum(weight, out=total[1:])
    total = total[bounds[1:]] - total[bounds[:-1]] + PRIOR_GRAMS
    weight /= np.repeat(total, np.diff(bounds)).astype(np.float32)
    return (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32), weight, bounds


def probabilities(model: tuple[np.ndarray, float], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    value, bias = model
    buckets, weight, bounds = bags(data, offsets)
    total = np.zeros(len(weight) + 1)
    np.cumsum(value[buckets] * weight, dtype=np.float64, out=total[1:])
    logit = total[bounds[1:]] - total[bounds[:-1]] + bias
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def text_subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every character n-gram that lies in one word, edges included."""
    n = len(offsets) - 1
    first = int(offsets[0])
    row = np.repeat(np.arange(n), np.diff(offsets))
    text = np.full(int(offsets[-1]) - first + n + 1, 0x20, np.uint8)
    text[np.arange(len(row)) + row + 1] = _FLAT[data[first:int(offsets[-1])]]
    row = np.append(np.repeat(np.arange(n), np.diff(offsets) + 1), n)
    blanks = np.concatenate([[0], np.cumsum(text == 0x20)])
    value = text.astype(np.uint32) + np.uint32(1)
    buckets, rows = [], []
    code = value
    have = 1
    for size in GRAMS:
        while have < size:
            code = code[:-1] * np.uint32(0x01000193) + value[have:]
            have += 1
        # No blank inside; the first or last character may be the word's edge.
        start = np.flatnonzero(blanks[size - 1:len(code) + size - 1] == blanks[1:len(code) + 1])
        mixed = code[start] + np.uint32(size)
        mixed ^= mixed >> np.uint32(16)
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(0xC2B2AE35)
        buckets.append(mixed >> np.uint32(32 - BUCKET_BITS))
        rows.append(np.minimum(row[start + 1], n - 1))
    return np.concatenate(buckets), np.concatenate(rows)


def labelled_bags(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> DataFrame:
    """``(label, total, buckets, weights)`` of at most ``per_class`` rows per class; ``total`` is the size of the class."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).filter(
        "label IN (0, 1) AND doc_id IS NOT NULL"
    ).groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = known.join(doc_texts(docs).select("doc_id"), "doc_id").groupBy("label").agg(F.count("*").alias("n")).collect()
    sizes = {r["label"]: r["n"] for r in totals}
    # The lowest hashes of each class: an order statistic, so no sort in one task.
    chosen = None
    for value, size in sorted(sizes.items()):
        part = known.filter(F.col("label") == value).join(doc_texts(docs).select("doc_id"), "doc_id", "left_semi")
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = known.limit(0)
    # One row an id, so the sample is bounded however often an id occurs.
    rows = doc_texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def collect(batch, data, offsets):
        buckets, weight, bounds = bags(data, offsets)
        return {
            "label": batch.column("label"), "doc_id": batch.column("doc_id"),
            "buckets": arrow_lists(buckets, bounds), "weights": arrow_lists(weight, bounds),
        }

    bagged = map_texts(rows, collect, "label int, doc_id bigint, buckets array<int>, weights array<float>")
    total = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in sizes.items()], F.lit(0))
    return bagged.withColumn("total", total.cast("long"))


def _collected(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, dict, np.ndarray, np.ndarray, np.ndarray]:
    """Labels in the order of the ids, class sizes, each row's range in the n-grams, and these with their weights.

    The lists stay where they arrive; only their ranges are put in order.
    """
    table = pa.Table.from_batches(batches)
    doc, label = table["doc_id"].to_numpy(), table["label"].to_numpy().astype(np.float64)
    totals = dict(zip(label.tolist(), table["total"].to_pylist(), strict=True))
    lengths = np.concatenate([np.zeros(0, np.int64), *[np.diff(c.offsets.to_numpy()) for c in table["buckets"].chunks]])
    buckets = np.concatenate([np.zeros(0, np.int32), *[c.flatten().to_numpy() for c in table["buckets"].chunks]])
    share = np.concatenate([np.zeros(0, np.float32), *[c.flatten().to_numpy() for c in table["weights"].chunks]])
    ends = np.cumsum(lengths)
    order = np.argsort(doc, kind="stable")
    return label[order], totals, np.stack([ends - lengths, ends], axis=1)[order], buckets, share


def fit(bagged: DataFrame, width: int = 8, steps: int = 400, rate: float = 0.05, batch: int = 128, seed: int = 7) -> Model:
    """Train in one task on the bounded bags; only the model comes to the driver."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            model = _train(held, width, steps, rate, batch, seed)
            yield pa.RecordBatch.from_pydict({
                "embeddings": [model.embeddings.astype("<f4").tobytes()], "weights": [model.weights.astype("<f8").tobytes()], "bias": [float(model.bias)],
            })

    row = bagged.repartition(1).mapInArrow(learn, "embeddings binary, weights binary, bias double").first()
    if row is None:  # no labels at all
        return Model(np.zeros((1 << BUCKET_BITS, width), np.float32), np.zeros(width), -40.0)
    return Model(np.frombuffer(row["embeddings"], "<f4").reshape(-1, width), np.frombuffer(row["weights"], "<f8"), row["bias"])


def _train(batches: list[pa.RecordBatch], width: int, steps: int, rate: float, batch: int, seed: int) -> Model:
    label, totals, bounds, buckets, share = _collected(batches)
    size = 1 << BUCKET_BITS
    if len(totals) < 2:
        return Model(np.zeros((size, width), np.float32), np.zeros(width, np.float32), 40.0 if 1.0 in totals else -40.0)
    share[(np.bincount(buckets, minlength=size) < MIN_TEXTS)[buckets]] = 0
    calibrate = np.arange(len(label)) % 5 == 4
    train = np.flatnonzero(~calibrate) if len(np.unique(label[calibrate])) == 2 and len(np.unique(label[~calibrate])) == 2 else np.arange(len(label))

    def bag(rows):
        """The rows' dense bags over the n-grams that occur in them."""
        first, sizes = bounds[rows, 0], bounds[rows, 1] - bounds[rows, 0]
        place = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        distinct, where = np.unique(buckets[place], return_inverse=True)
        out = np.zeros((len(rows), len(distinct)), np.float32)
        out[np.repeat(np.arange(len(rows)), sizes), where] = share[place]
        return out, distinct

    random = np.random.default_rng(seed)
    embeddings = random.normal(0, 0.01, (size, width)).astype(np.float32)
    weights, bias = np.full(width, 1 / np.sqrt(width)), 0.0
    positives = label[train].mean()
    weigh = np.where(label == 1, 0.5 / positives, 0.5 / (1 - positives))
    moments = [(np.zeros_like(embeddings), np.zeros_like(embeddings)), (np.zeros(width), np.zeros(width)), (np.zeros(1), np.zeros(1))]
    step = 0
    while step < steps:
        order = random.permutation(train)
        for first in range(0, len(order), batch):
            rows = order[first:first + batch]
            dense, distinct = bag(rows)
            mean = dense @ embeddings[distinct]
            error = (1 / (1 + np.exp(-np.clip(mean @ weights + bias, -30, 30))) - label[rows]) * weigh[rows] / len(rows)
            gradients = [dense.T @ np.outer(error, weights).astype(np.float32), mean.T @ error, np.array([error.sum()])]
            step += 1
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            moves = []
            # Adam; embeddings of n-grams that the batch lacks stay as they are.
            for (m, v), g, own in zip(moments, gradients, (distinct, slice(None), slice(None)), strict=True):
                m[own], v[own] = 0.9 * m[own] + 0.1 * g, 0.999 * v[own] + 0.001 * g * g
                moves.append(scale * m[own] / (np.sqrt(v[own]) + 1e-8))
            embeddings[distinct] -= 20 * moves[0]
            weights, bias = weights - moves[1], bias - float(moves[2][0])
    if len(train) == len(label):
        return Model(embeddings, weights, bias + float(np.log(totals[1.0] / totals[0.0])))
    rows = np.flatnonzero(calibrate)
    logit = np.concatenate([d @ (embeddings[k] @ weights) for d, k in (bag(rows[i:i + batch]) for i in range(0, len(rows), batch))])
    slope, shift = _calibration(logit + bias, label[rows], totals)
    return Model(embeddings, slope * weights, slope * bias + shift)


def _calibration(logit: np.ndarray, label: np.ndarray, totals: dict) -> tuple[float, float]:
    """Slope and shift of the logits by Newton's method, rows weighted to the class sizes."""
    scale = max(np.abs(logit).mean(), 1e-9)
    x = np.stack([logit / scale, np.ones(len(logit))], axis=1)
    weigh = np.where(label == 1, totals[1.0] / label.sum(), totals[0.0] / (len(label) - label.sum()))
    weigh *= len(label) / weigh.sum()
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weigh * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        w -= np.clip(np.linalg.solve(curve, x.T @ (weigh * (p - label)) + 0.05 * w), -1, 1)
    return max(float(w[0]), 1e-6) / scale, float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every text; the model ships as one number per n-gram."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.scores(), model.bias))

    def predict(batch, data, offsets):
        return {"doc_id": batch.column("doc_id"), "score": probabilities(shipped.value, data, offsets)}

    return map_texts(doc_texts(docs), predict, "doc_id bigint, score double")


def with_scores(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with the score in a further column; no join, so every row keeps its own."""
    names = docs.columns
    shipped = docs.sparkSession.sparkContext.broadcast((model.scores(), model.bias))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def predict(batch, data, offsets):
        return {**{c: batch.column(c) for c in names}, name: probabilities(shipped.value, data, offsets)}

    return map_texts(docs, predict, schema)
