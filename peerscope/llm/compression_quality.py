"""Quality from compression: which of two dictionaries shortens a text more.

A zstandard dictionary is built from good and one from bad labelled text. Every
text is compressed with both; the difference of the two sizes over their sum,
with the sizes per byte, goes through a logistic calibration.

Fitting takes at most ``per_class`` labelled rows of each class, chosen by the
hash of their id. Half of them fill the dictionaries of at most
``dictionary_bytes``: each row has an even share, which a text that is longer
fills with short parts from its beginning to its end. The other half calibrates.
Scoring covers all rows whole; texts are compressed in one stream.

Defined cases: an empty or null text, and every text where a class has no
labels, scores the share of label 1 (0 without labels); null labels are
ignored; repeated rows are each scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.texts import doc_texts, map_texts

PER_CLASS = 1500
DICTIONARY_BYTES = 1 << 18
LEVEL = 3
#: Parts of a text in a dictionary are about so long.
PART_BYTES = 64


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    prior: float


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled texts of each class, the lowest by the hash of their id."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).filter(
        "label IN (0, 1) AND doc_id IS NOT NULL"
    ).groupBy("doc_id").agg(F.min("label").alias("label"))
    present = known.join(doc_texts(docs).select("doc_id"), "doc_id", "left_semi")
    classes = [present.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = classes[0].unionByName(classes[1])
    # One row an id, so the sample is bounded however often an id occurs.
    rows = doc_texts(docs).join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL AND text != ''")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _compressors(model_good: bytes, model_bad: bytes):
    out = []
    for content in (model_good, model_bad):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False))
    return out


def _sizes(compressors, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    view = memoryview(np.ascontiguousarray(data))
    sizes = np.zeros((len(offsets) - 1, 2))
    for i in range(len(offsets) - 1):
        text = view[int(offsets[i]):int(offsets[i + 1])]
        if len(text):
            sizes[i] = [len(c.compress(text)) for c in compressors]
    return sizes


def features(sizes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The normalised difference, the sizes per byte and the logarithm of the length."""
    total = np.maximum(sizes.sum(axis=1), 1)
    length = np.maximum(length, 1)
    difference = (sizes[:, 1] - sizes[:, 0]) / total
    per_byte = total / (2 * length)
    return np.stack([10 * difference, 10 * difference * np.log10(length), 4 * per_byte, 4 * per_byte**2, np.log10(length), np.ones(len(length))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Build dictionaries and calibration from the bounded sample."""
    sample = labelled_sample(docs, labels, label, per_class)
    placed = sample.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1000003)))
    rows = placed.select("doc_id", "label", "place").toPandas()
    half = rows["place"] % 2 == 0
    shares = {value: dictionary_bytes // max(int((half & (rows["label"] == value)).sum()), 1) for value in (1, 0)}
    # Pieces are cut in the tasks, so what the driver gets is bounded; they fill dictionaries only.
    pieces = _pieces(placed.filter("place % 2 = 0"), shares).toPandas().sort_values(["place", "doc_id"])
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).filter("label IN (0, 1)")
    counts = {r["label"]: r["n"] for r in known.join(doc_texts(docs).select("doc_id"), "doc_id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    contents = [b"".join(bytes(p) for p in pieces[pieces["label"] == value]["piece"]) for value in (1, 0)]
    if not all(len(c) >= 8 for c in contents):
        return Model(b"", b"", np.zeros(6), prior)
    chosen = sample.join(F.broadcast(docs.sparkSession.createDataFrame(
        [(int(x),) for x in rows[~half]["doc_id"]] or [(0,)], "doc_id bigint"
    )), "doc_id")
    measured = _measure(chosen, contents, "label").toPandas().sort_values("doc_id")
    return Model(*contents, _logistic(measured, counts), prior)


def spread_parts(text: bytes, share: int) -> bytes:
    """At most ``share`` bytes of a text: all of it, or short parts at even steps from its first byte to its last."""
    if len(text) <= share:
        return text
    many = max(share // (PART_BYTES + 1), 1)
    size = (share + 1) // many - 1  # a line feed between two
    if many == 1:
        return text[(len(text) - share) // 2:][:share]
    return b"\n".join(text[k * (len(text) - size) // (many - 1):][:size] for k in range(many))


def _pieces(placed: DataFrame, shares: dict[int, int]) -> DataFrame:
    def cut(batch, data, offsets):
        labels = batch.column("label").to_pylist()
        pieces = [spread_parts(data[int(offsets[i]):int(offsets[i + 1])].tobytes(), shares[labels[i]]) for i in range(len(offsets) - 1)]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "place": batch.column("place"), "piece": pieces}

    return map_texts(placed, cut, "doc_id bigint, label int, place bigint, piece binary")


def _measure(rows: DataFrame, contents: list[bytes], *more: str) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(tuple(contents))
    own = {}

    def measure(batch, data, offsets):
        if "c" not in own:
            own["c"] = _compressors(*shipped.value)
        sizes = _sizes(own["c"], data, offsets)
        return {
            "doc_id": batch.column("doc_id"), "good": sizes[:, 0], "bad": sizes[:, 1], "length": np.diff(offsets),
            **{c: batch.column(c) for c in more},
        }

    return map_texts(rows, measure, "doc_id bigint, good double, bad double, length bigint" + "".join(f", {c} int" for c in more))


def _logistic(measured, counts: dict[int, int], rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method, steps halved until the loss falls; rows weigh as much as their class does among all labels."""
    x = features(measured[["good", "bad"]].to_numpy(), measured["length"].to_numpy())
    y = measured["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return np.zeros(x.shape[1])
    weigh = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    weigh *= len(y) / weigh.sum()
    w = np.zeros(x.shape[1])

    def loss(w):
        return (weigh * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + ridge / 2 * (w @ w)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weigh * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, now = np.linalg.solve(curve, x.T @ (weigh * (p - y)) + ridge * w), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if loss(w - step) >= now:
            break
        w -= step
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, good, bad, length)``: sizes with either dictionary, and the calibrated score."""
    if not model.good:
        return doc_texts(docs).select(
            "doc_id", F.lit(model.prior).alias("score"), *[F.lit(0.0).alias(c) for c in ("good", "bad")], F.lit(0).cast("long").alias("length")
        )
    measured = _measure(doc_texts(docs), [model.good, model.bad])
    total = F.greatest(F.col("good") + F.col("bad"), F.lit(1.0))
    length = F.greatest(F.col("length"), F.lit(1))
    difference, per_byte = (F.col("bad") - F.col("good")) / total, total / (2 * length)
    terms = [10 * difference, 10 * difference * F.log10(length), 4 * per_byte, 4 * per_byte * per_byte, F.log10(length), F.lit(1.0)]
    logit = sum((float(w) * t for w, t in zip(model.weights, terms, strict=True)), F.lit(0.0))
    value = F.when(F.col("length") == 0, F.lit(model.prior)).otherwise(1 / (1 + F.exp(-logit)))
    return measured.select("doc_id", value.alias("score"), "good", "bad", "length")
