"""Text vectors: encoding, reduction and blending with the numeric features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, PCA, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.functions.columns import endpoint_description
from peerscope.operators.features import as_points, numeric_features, standardized

# Width of a text vector, and the fewest dimensions kept.
VECTOR_WIDTH = 768
MIN_COMPONENTS = 2


def with_description(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("description", endpoint_description())


def hash_vectors(profiles: DataFrame, width: int = VECTOR_WIDTH) -> DataFrame:
    """``(ip_address, embedding)``: TF-IDF of the description at length 1.

    Pass stored profiles: the document frequencies read them first.
    """
    words = with_description(profiles).select("ip_address", "description")
    pipeline = Pipeline(stages=[
        Tokenizer(inputCol="description", outputCol="words"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=width),
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="vector", p=2.0),
    ])
    encoded = pipeline.fit(words).transform(words)
    return encoded.select("ip_address", vector_to_array("vector", "float32").alias("embedding"))


def encode_vectors(profiles: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``(ip_address, embedding)`` from a model of the caller.

    ``make_encoder`` runs once per task and returns a function from a batch of
    descriptions to their vectors.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            vectors = np.asarray(encoder(batch["description"].tolist()), dtype=np.float32)
            yield pd.DataFrame({"ip_address": batch["ip_address"], "embedding": list(vectors)})

    return with_description(profiles).select("ip_address", "description").mapInPandas(
        encode, "ip_address string, embedding array<float>"
    )


def with_vectors(profiles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Profiles with their stored vector, null where there is none."""
    return profiles.drop("embedding").join(vectors.select("ip_address", "embedding"), "ip_address", "left")


@dataclass(frozen=True)
class Reduced:
    """``points`` ``(ip_address, features)`` and the share of variance per component."""

    points: DataFrame
    explained: list[float]


def reduce_vectors(vectors: DataFrame, components: int, whiten: bool = False) -> Reduced:
    """Centred principal components of ``(ip_address, embedding)``.

    Pass stored rows. Spark's PCA keeps a width x width matrix on the driver
    whatever the number of rows. It does not centre, so the mean of each
    component is taken off; the sign of a component is set so that its largest
    loading is positive.
    """
    rows = vectors.select("ip_address", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
    model = PCA(k=components, inputCol="vector", outputCol="projected").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(components)])
    signs[signs == 0] = 1.0
    projected = model.transform(rows).select("ip_address", vector_to_array("projected").alias("projected"))
    values = [F.col("projected")[i] for i in range(components)]
    moments = projected.agg(*[F.avg(v) for v in values], *[F.stddev_samp(v) for v in values]).first()
    centred = []
    for i, value in enumerate(values):
        mean, spread = moments[i] or 0.0, moments[components + i] or 0.0
        width = spread if whiten and spread > 0 else 1.0
        centred.append((value - F.lit(mean)) * F.lit(float(signs[i]) / width))
    points = projected.select("ip_address", F.array(*centred).alias("features"))
    return Reduced(points, [float(v) for v in model.explainedVariance.toArray()])


def numeric_points(data: DataFrame, weight: float = 1.0) -> DataFrame:
    """The standardised numeric features alone."""
    return as_points(standardized(numeric_features(data)), weight=weight)


def blended_points(data: DataFrame, components: int, whiten: bool = False, weight: float = 1.0) -> Reduced:
    """Reduced text vectors at their own scale beside the weighted numeric features.

    A weight of 0 or less leaves the text alone. ``data`` is the stored
    clustering input.
    """
    text = reduce_vectors(data, components, whiten)
    if weight <= 0:
        return text
    numeric = numeric_points(data, weight).withColumnRenamed("features", "numeric")
    blended = text.points.join(numeric, "ip_address").select(
        "ip_address", F.concat("features", "numeric").alias("features")
    )
    return Reduced(blended, text.explained)


def plane(points: DataFrame, dims: int) -> DataFrame:
    """``(ip_address, x, y)`` of the clustered space, reduced if above two dimensions."""
    if dims > 2:
        points = reduce_vectors(points.withColumnRenamed("features", "embedding"), 2).points
    return points.select("ip_address", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
