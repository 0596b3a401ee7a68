"""How good a clustering is, and how far several agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.functions.ranking import with_global_rank
from peerscope.operators.blocks import BLOCK_ROWS, block_count, compare, prepare
from peerscope.operators.clusters import NOISE, dbscan
from peerscope.operators.knee import Radius, recommend_eps
from peerscope.operators.neighbours import distance_strips, k_distance_curve, k_distances, matrix
from peerscope.operators.reduction import blended_points, numeric_points, reduce_vectors
from peerscope.session import materialize, side_by_side, temporary_tables

# Up to so many clusters of a block are summed by one product of matrices.
FEW_CLUSTERS = 16


def _told(pids: np.ndarray, own: np.ndarray, names: np.ndarray, sizes: np.ndarray, totals: np.ndarray) -> tuple:
    """``(pid, cluster, sum)`` of each point for the clusters of a block that its silhouette may need.

    The first and the last cluster may go on in other blocks. Those between are
    whole, so of them only the point's own and the nearest matter.
    """
    told = names == own[:, None]
    told[:, [0, -1]] = True
    told[np.arange(len(pids)), np.where(told, np.inf, totals / sizes).argmin(axis=1)] = True
    at, nth = np.nonzero(told)
    return pids[at], names[nth], totals[at, nth]


def _sums_of_columns(places: np.ndarray, weights: np.ndarray, count: int) -> Callable:
    """Weighted sums over the columns of each cluster; ``places`` ascend from 0 to ``count``."""
    if count > FEW_CLUSTERS:
        starts = np.searchsorted(places, np.arange(count))
        return lambda apart: np.add.reduceat(apart * weights, starts, axis=1)
    factors = (places[:, None] == np.arange(count)) * weights[:, None]
    return lambda apart: apart @ factors


class _RowSums:
    """Weighted sums over the rows of each cluster of a block, for each column; rows come in the order of clusters.

    Keeps one cluster that may go on in the next rows, and the nearest of the
    clusters that are over, the first of the block apart.
    """

    def __init__(self, places: np.ndarray, weights: np.ndarray, sizes: np.ndarray, columns: int):
        self.places, self.weights, self.sizes = places, weights, sizes
        self.place, self.open = 0, np.zeros(columns)
        self.first, self.mean = None, np.full(columns, np.inf)
        self.nearest, self.total = np.full(columns, -1), np.zeros(columns)

    def add(self, part: slice, apart: np.ndarray) -> None:
        places = self.places[part]
        names = np.arange(self.place, places[-1] + 1)
        sums = ((names[:, None] == places) * self.weights[part]) @ apart
        sums[0] += self.open
        self.place, self.open = names[-1], sums[-1]
        names, sums = names[:-1], sums[:-1]
        if len(names) and names[0] == 0:
            self.first, names, sums = sums[0], names[1:], sums[1:]
        if len(names):
            means = sums / self.sizes[names][:, None]
            best, columns = means.argmin(axis=0), np.arange(sums.shape[1])
            better = means[best, columns] < self.mean
            best, columns = best[better], columns[better]
            self.mean[columns], self.total[columns] = means[best, columns], sums[best, columns]
            self.nearest[columns] = names[best]

    def told(self, pids: np.ndarray, names: np.ndarray) -> list[tuple]:
        """As :func:`_told`. A cluster that is whole in one block has no points in another."""
        found = [(pids, np.full(len(pids), names[self.place]), self.open)]
        if self.first is not None:
            found.append((pids, np.full(len(pids), names[0]), self.first))
        some = self.nearest >= 0
        return [*found, (pids[some], names[self.nearest[some]], self.total[some])]


def _distance_kernel() -> Callable:
    """Weighted sums of distances from each point of either block to the clusters of the other that may matter.

    The points of a block are in the order of their clusters.
    """
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                left = matrix(row.a_coordinates, len(row.a_pids))
                right = matrix(row.b_coordinates, len(row.b_pids))
                a_pids, b_pids, a_own = np.asarray(row.a_pids), np.asarray(row.b_pids), np.asarray(row.a_clusters)
                a_weights, b_weights = np.asarray(row.a_weights, dtype=float), np.asarray(row.b_weights, dtype=float)
                a_names, a_places = np.unique(a_own, return_inverse=True)
                b_names, b_places = np.unique(row.b_clusters, return_inverse=True)
                a_sizes, b_sizes = np.bincount(a_places, a_weights), np.bincount(b_places, b_weights)
                by_cluster = _sums_of_columns(b_places, b_weights, len(b_names))
                back = _RowSums(a_places, a_weights, a_sizes, len(right))
                found = []
                for part, apart in distance_strips(left, right):
                    found.append(_told(a_pids[part], a_own[part], b_names, b_sizes, by_cluster(apart)))
                    if row.a != row.b:
                        back.add(part, apart)
                if row.a != row.b:
                    found += back.told(b_pids, a_names)
                yield pd.DataFrame(dict(zip(("pid", "other", "distance"), map(np.concatenate, zip(*found)))))

    return kernel


def silhouettes(points: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(pid, weight, cluster, silhouette)`` of each distinct clustered position.

    The Euclidean silhouette is defined over the distances between all points,
    so its work is quadratic in distinct positions; each two blocks are compared
    once, and a task returns at most four sums per point, however many clusters
    there are. There are at most ``MOST_BLOCKS`` blocks, so what is shuffled is in
    proportion to the points.
    """
    clustered = points.join(labels.filter(F.col("cluster") != NOISE), "ip_address")
    spots = materialize(clustered.groupBy("cluster", "features").agg(F.count("*").alias("weight")), "spots")
    rows = spots.count()
    count = block_count(rows, block_rows)
    ranked = with_global_rank(spots, ["cluster", "features"], "pid").withColumn(
        "block", F.expr(f"(pid * {count}) div {max(rows, 1)}")
    )
    members = F.sort_array(F.collect_list(F.struct("pid", "weight", "cluster", "features")))
    blocks = materialize(
        ranked.repartition(count, "block").groupBy("block").agg(members.alias("m")).select(
            "block",
            F.col("m.pid").alias("pids"),
            F.col("m.weight").alias("weights"),
            F.col("m.cluster").alias("clusters"),
            F.flatten("m.features").alias("coordinates"),
        ),
        "blocks",
    )
    pairs = materialize(blocks.select(
        F.col("block").alias("a"), F.explode(F.expr(f"sequence(block, {count - 1}L)")).alias("b")
    ), "pairs")
    sums = compare(
        pairs, blocks, ["pids", "weights", "clusters", "coordinates"],
        _distance_kernel(), "pid long, other long, distance double",
    ).groupBy("pid", "other").agg(F.sum("distance").alias("distance"))
    sizes = spots.groupBy(F.col("cluster").alias("other")).agg(F.sum("weight").alias("size"))
    own = F.col("other") == F.col("cluster")
    inner = F.max(F.when(own & (F.col("size") > 1), F.col("distance") / (F.col("size") - 1)))
    nearest = F.min(F.when(~own, F.col("distance") / F.col("size")))
    return (
        sums.join(ranked.select("pid", "weight", "cluster"), "pid")
        .join(sizes, "other")
        .groupBy("pid", "weight", "cluster")
        .agg(inner.alias("inner"), nearest.alias("nearest"))
        .select(
            "pid", "weight", "cluster",
            F.when(F.greatest("inner", "nearest") > 0, (F.col("nearest") - F.col("inner")) / F.greatest("inner", "nearest"))
            .otherwise(0.0)
            .alias("silhouette"),
        )
    )


def cluster_counts(labels: DataFrame) -> DataFrame:
    """Points, clusters and noise of a labelling, in one row."""
    clustered = F.col("cluster") != NOISE
    return labels.agg(
        F.count("*").alias("points"),
        F.count_if(clustered).alias("clustered"),
        F.count_if(~clustered).alias("outliers"),
        # Clusters are numbered from 0 without a gap.
        F.coalesce(F.max("cluster") + 1, F.lit(0)).alias("clusters"),
    )


def silhouette(points: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> float | None:
    """Mean silhouette of the clustered points; None below two clusters or when
    every cluster is one point."""
    found = cluster_counts(labels).first()
    if found["clusters"] < 2 or found["clustered"] <= found["clusters"]:
        return None
    with temporary_tables(points.sparkSession):
        total = silhouettes(points, labels, block_rows).agg(
            F.sum(F.col("silhouette") * F.col("weight")) / F.sum("weight")
        )
        return total.first()[0]


@dataclass(frozen=True)
class Clustering:
    """Stored ``labels`` and ``curve`` of one feature space."""

    labels: DataFrame
    curve: DataFrame
    radius: Radius
    dims: int


def cluster_points(points: DataFrame, min_samples: int, eps: float | None = None,
                   block_rows: int = BLOCK_ROWS) -> Clustering:
    """k-distances, radius and DBSCAN of stored ``points``."""
    space = prepare(points)
    curve = materialize(k_distance_curve(k_distances(space, min_samples, block_rows)), "curve")
    radius = recommend_eps(curve, eps)
    labels = materialize(dbscan(space, radius.eps, min_samples, block_rows), "labels")
    return Clustering(labels, curve, radius, space.dims)


@dataclass(frozen=True)
class Ablation:
    """``summary`` has a row per condition, ``agreement`` one per pair of
    conditions, ``outliers`` one per condition and flagged address."""

    summary: DataFrame
    agreement: DataFrame
    outliers: DataFrame


CONDITIONS = ["text-only", "numeric-only", "blended"]


def outlier_sets(labels: dict[str, DataFrame]) -> DataFrame:
    """``(condition, ip_address)`` of the noise of each labelling."""
    parts = [
        found.filter(F.col("cluster") == NOISE).select(F.lit(name).alias("condition"), "ip_address")
        for name, found in labels.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def jaccard(outliers: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """Overlap of the outlier sets of each two conditions; 1 if both are empty."""
    per_address = outliers.groupBy("ip_address").agg(
        *[F.max((F.col("condition") == c).cast("int")).alias(c) for c in conditions]
    )
    pairs = list(combinations(conditions, 2))
    counts = per_address.agg(*[
        F.struct(
            F.lit(f"{a} vs {b}").alias("pair"),
            F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias("shared"),
            F.sum(F.greatest(F.col(f"`{a}`"), F.col(f"`{b}`"))).alias("either"),
        ).alias(f"pair_{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    return counts.select(F.inline(F.array(*[f"pair_{i}" for i in range(len(pairs))]))).select(
        "pair",
        F.when(F.col("either") > 0, F.round(F.col("shared") / F.col("either"), 4)).otherwise(1.0).alias("jaccard"),
    )


def ablation(data: DataFrame, components: int = 2, whiten: bool = False, weight: float = 1.0,
             block_rows: int = BLOCK_ROWS) -> Ablation:
    """Cluster the same endpoints by text, by numbers and by both, each at the
    radius its own curve recommends. Writes no verdicts. The conditions run side
    by side, since most of their jobs are too small for all cores.

    Below ``2 * components`` endpoints nothing is clustered: all conditions are
    listed with nulls, and no address is an outlier of any.
    """
    min_samples = 2 * components
    schema = "condition string, dims int, eps double, clusters long, outliers long, silhouette double"
    if data.count() < min_samples:
        nothing = data.select(F.lit(CONDITIONS[0]).alias("condition"), "ip_address").limit(0)
        rows = [(name, None, None, None, None, None) for name in CONDITIONS]
        return Ablation(data.sparkSession.createDataFrame(rows, schema), jaccard(nothing), nothing)
    # One after another, since Spark's PCA calls a LAPACK on the driver that keeps state between threads.
    spaces = {
        "text-only": reduce_vectors(data, components, whiten).points,
        "numeric-only": numeric_points(data),
        "blended": blended_points(data, components, whiten, weight if weight > 0 else 1.0).points,
    }
    rows, labels = [], {}
    for name, (clustering, score) in side_by_side(data.sparkSession, {
        name: partial(_scored_clusters, points, min_samples, block_rows) for name, points in spaces.items()
    }).items():
        labels[name] = clustering.labels
        found = cluster_counts(clustering.labels).first()
        rows.append((
            name, clustering.dims, round(clustering.radius.eps, 4), found["clusters"],
            found["outliers"], None if score is None else round(score, 4),
        ))
    summary = data.sparkSession.createDataFrame(rows, schema)
    outliers = outlier_sets(labels)
    return Ablation(summary, jaccard(outliers), outliers)


def _scored_clusters(points: DataFrame, min_samples: int, block_rows: int) -> tuple[Clustering, float | None]:
    points = materialize(points, "points")
    clustering = cluster_points(points, min_samples, block_rows=block_rows)
    return clustering, silhouette(points, clustering.labels, block_rows)
