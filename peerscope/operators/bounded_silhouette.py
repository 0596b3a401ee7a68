"""The Euclidean silhouette between proven bounds, without measuring all pairs of points.

A cluster is cut into pieces: its points inside one block of nearby points. Pieces
of consecutive blocks form groups, groups of groups up to the whole cluster, each
with its weight, centre and variance. The mean distance from a point to a group
lies between the distance ``d`` to its centre and ``sqrt(d^2 + variance)``, both by
Jensen's inequality. From the whole cluster downwards, a block of points takes these
bounds where they differ by at most ``tolerance`` of the distance, opens the group
where they do not, and measures the points of a piece that is still too near.

Clusters that cannot be the nearest other one of any point of a block, by the same
bounds, are not looked at further. The work per block then follows the logarithm of
the number of blocks in few dimensions; where boxes rule out little, as in many
dimensions, it approaches that of the exact silhouette. The number of blocks is
bounded, as in every search, so what is shuffled stays in proportion to the points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.ranking import with_global_rank
from peerscope.operators.blocks import MOST_TASKS, Layout, Space, compare, lay_out
from peerscope.operators.clusters import NOISE
from peerscope.operators.evaluation import cluster_counts
from peerscope.operators.neighbours import distances, matrix, squared_distances, strips
from peerscope.session import materialize, temporary_tables

TOLERANCE = 0.02
PIECE_ROWS = 256
# Blocks, groups or pieces under one group.
FAN_OUT = 8
# So many groups are measured from a block at once, and so many clusters are bounded at once.
GROUPS_AT_ONCE, CLUSTERS_AT_ONCE = 64, 2048
DISTANCES_PER_TASK = 1 << 24
# Room for rounding, as a share of a mean square.
ROUNDING = 1e-12
SUMS = "pid long, other long, low double, high double"


@dataclass(frozen=True)
class Estimate:
    """The mean silhouette is between ``low`` and ``high``."""

    silhouette: float
    low: float
    high: float


def _over_tasks(df: DataFrame, distances: int) -> DataFrame:
    """``df`` over enough tasks for so many distances."""
    return df.repartition(max(1, min(math.ceil(distances / DISTANCES_PER_TASK), MOST_TASKS)))


def _group_columns(dims: int) -> list[Column]:
    """Weight, centre and variance of groups from additive sums."""
    mean_square = F.col("squares") / F.col("weight")
    centre_square = F.expr(" + ".join(["0.0D", *[f"pow(sum_{i} / weight, 2)" for i in range(dims)]]))
    return [
        F.col("weight"),
        F.array(*[F.col(f"sum_{i}") / F.col("weight") for i in range(dims)]).cast("array<double>").alias("centre"),
        (F.greatest(mean_square - centre_square, F.lit(0.0)) + mean_square * ROUNDING).alias("variance"),
    ]


def _added(dims: int) -> list[Column]:
    return [F.sum(c).alias(c) for c in ["weight", *[f"sum_{i}" for i in range(dims)], "squares"]]


def _nearest_kernel() -> Callable:
    """Clusters of a tile that may be the nearest other one of a point in a block, and the block's own.

    ``reach`` is the second lowest upper bound of the tile: every point has a
    cluster other than its own at most that far.
    """
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                low, high = np.asarray(row.low, dtype=float), np.asarray(row.high, dtype=float)
                clusters = np.asarray(row.clusters)
                centres = matrix(row.centres, len(clusters))
                gap = np.maximum(np.maximum(low - centres, centres - high), 0)
                reach = np.maximum(np.abs(low - centres), np.abs(high - centres))
                nearest = np.sqrt((gap**2).sum(axis=1))
                farthest = np.sqrt((reach**2).sum(axis=1) + np.asarray(row.variances))
                bound = np.partition(farthest, 1)[1] if len(farthest) > 1 else np.inf
                own = np.isin(clusters, np.asarray(row.own))
                some = own | (nearest <= bound)
                yield pd.DataFrame({
                    "a": row.block, "cluster": clusters[some], "own": own[some], "nearest": nearest[some], "reach": bound,
                })

    return kernel


def _candidates(layout: Layout, own: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(a, cluster)``: the clusters that block a has to look at. Blocks meet clusters in tiles."""
    ranked = with_global_rank(clusters, ["cluster"], "place").withColumn("tile", F.expr(f"place div {CLUSTERS_AT_ONCE}"))
    members = F.sort_array(F.collect_list(F.struct("cluster", "centre", "variance")))
    tiles = materialize(ranked.groupBy("tile").agg(members.alias("m")).select(
        "tile", F.col("m.cluster").alias("clusters"), F.flatten("m.centre").alias("centres"), F.col("m.variance").alias("variances"),
    ), "tiles")
    count = tiles.count()
    tiled = layout.blocks.select("block", "low", "high").join(own, "block").withColumn(
        "tile", F.explode(F.expr(f"sequence(0L, {max(count - 1, 0)}L)"))
    ).join(tiles, "tile")
    found = materialize(
        _over_tasks(tiled, layout.count * count * CLUSTERS_AT_ONCE)
        .mapInPandas(_nearest_kernel(), "a long, cluster long, own boolean, nearest double, reach double"),
        "candidates",
    )
    reach = found.groupBy("a").agg(F.min("reach").alias("least"))
    return found.join(reach, "a").filter("own OR nearest <= least").select("a", "cluster")


def _far_kernel() -> Callable:
    """Bounds of the summed distances from each point of a block to groups of one cluster."""
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                squared = squared_distances(matrix(row.coordinates, len(row.pids)), matrix(row.centres, len(row.group_weights)))
                weights = np.asarray(row.group_weights, dtype=float)
                yield pd.DataFrame({
                    "pid": row.pids, "other": row.cluster,
                    "low": np.sqrt(squared) @ weights, "high": np.sqrt(squared + np.asarray(row.variances)) @ weights,
                })

    return kernel


def _near_kernel() -> Callable:
    """Summed distances from each point of block a to the points of the wanted clusters in block b.

    The points of a block are in the order of their clusters.
    """
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                some = np.isin(row.b_clusters, row.wanted)
                left, right = matrix(row.a_coordinates, len(row.a_pids)), matrix(row.b_coordinates, len(row.b_pids))[some]
                weights = np.asarray(row.b_weights, dtype=float)[some]
                names, starts = np.unique(np.asarray(row.b_clusters)[some], return_index=True)
                totals = np.concatenate([
                    np.add.reduceat(distances(left[part], right) * weights, starts, axis=1) for part in strips(len(left), len(right))
                ]).ravel()
                yield pd.DataFrame({
                    "pid": np.repeat(row.a_pids, len(names)), "other": np.tile(names, len(left)), "low": totals, "high": totals,
                })

    return kernel


def _descend(layout: Layout, pieces: DataFrame, candidates: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The groups that blocks take bounds of, and the ``(a, cluster, node)`` of the pieces that they measure.

    One round per level. High levels have few groups, so joining them sends the
    groups and not the many blocks that look at one of them.
    """
    dims = layout.dims
    boxes = layout.blocks.select(F.col("block").alias("a"), "low", "high")
    apart = F.expr(" + ".join([
        "0.0D", *[f"pow(greatest(0.0D, low[{i}] - centre[{i}], centre[{i}] - high[{i}]), 2)" for i in range(dims)],
    ]))
    level = 0
    while FAN_OUT**level < layout.count:
        level += 1
    frontier, taken = candidates.withColumn("node", F.lit(0).cast("long")), None
    while True:
        size = FAN_OUT**level
        groups = materialize(
            pieces.groupBy("cluster", F.expr(f"block div {size}").alias("node")).agg(*_added(dims))
            .select("cluster", "node", *_group_columns(dims)),
            "groups",
        )
        met = materialize(
            frontier.join(groups, ["cluster", "node"]).join(boxes, "a")
            .withColumn("taken", F.col("variance") <= 2 * tolerance * apart).drop("low", "high"),
            "met",
        )
        part = met.filter("taken").withColumn("level", F.lit(level))
        taken = part if taken is None else taken.unionByName(part)
        opened = met.filter("NOT taken").select("a", "cluster", "node")
        if level == 0:
            return taken, opened
        level -= 1
        # Only children that exist are met in the next round's join.
        frontier = opened.withColumn("node", F.explode(F.expr(f"sequence(node * {FAN_OUT}, node * {FAN_OUT} + {FAN_OUT - 1})")))


def bounded_silhouettes(points: DataFrame, labels: DataFrame, tolerance: float = TOLERANCE,
                        piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(pid, weight, cluster, silhouette, low, high)`` of each distinct clustered position.

    Mean distances are known to within ``tolerance`` of themselves, which proves
    the silhouette to within ``2 * tolerance``: it is between ``low`` and ``high``.
    With tolerance 0 all distances that may matter are measured, and the three are
    equal. At least two clusters are needed; a cluster of one point has silhouette 0.
    """
    clustered = points.join(labels.filter(F.col("cluster") != NOISE), "ip_address")
    spots = materialize(
        clustered.groupBy("cluster", "features")
        .agg(F.min("ip_address").alias("name"), F.count("*").alias("weight"))
        .withColumn("pid", F.monotonically_increasing_id()),
        "spots",
    )
    size = spots.agg(F.count("*").alias("rows"), F.max(F.size("features")).alias("dims")).first()
    dims = size["dims"] or 0
    layout = lay_out(Space(clustered, spots, size["rows"], dims), block_rows=piece_rows)
    placed = materialize(layout.blocks.select("block", F.explode("pids").alias("pid")).join(spots, "pid"), "placed")
    pieces = materialize(
        placed.groupBy("cluster", "block").agg(
            F.sum("weight").alias("weight"),
            *[F.sum(F.col("weight") * F.col("features")[i]).alias(f"sum_{i}") for i in range(dims)],
            F.sum(F.col("weight") * F.expr(" + ".join(["0.0D", *[f"pow(features[{i}], 2)" for i in range(dims)]]))).alias("squares"),
        ),
        "pieces",
    )
    sizes = materialize(
        pieces.groupBy("cluster").agg(*_added(dims)).select("cluster", *_group_columns(dims)), "sizes"
    )
    own = placed.groupBy("block").agg(F.collect_set("cluster").alias("own"))
    taken, near = _descend(layout, pieces, _candidates(layout, own, sizes), tolerance)
    targets = layout.blocks.select(F.col("block").alias("a"), "pids", "coordinates")
    listed = F.collect_list(F.struct("weight", "centre", "variance"))
    far = materialize(
        taken.groupBy("a", "cluster", "level", F.expr(f"node div {GROUPS_AT_ONCE}").alias("part")).agg(listed.alias("m")).select(
            "a", "cluster", F.col("m.weight").alias("group_weights"), F.flatten("m.centre").alias("centres"),
            F.col("m.variance").alias("variances"),
        ),
        "far",
    )
    bounded = _over_tasks(far.join(targets, "a"), far.count() * GROUPS_AT_ONCE * piece_rows).mapInPandas(_far_kernel(), SUMS)
    # A block goes to each block that measures some of its pieces once, with all its clusters.
    members = F.sort_array(F.collect_list(F.struct("cluster", "pid", "weight", "features")))
    filled = materialize(
        placed.repartition(layout.count, "block").groupBy("block").agg(members.alias("m")).select(
            "block", F.col("m.pid").alias("pids"), F.col("m.weight").alias("weights"), F.col("m.cluster").alias("clusters"),
            F.flatten("m.features").alias("coordinates"),
        ),
        "filled",
    )
    pairs = materialize(near.groupBy("a", F.col("node").alias("b")).agg(F.collect_set("cluster").alias("wanted")), "pairs")
    measured = compare(pairs, filled, ["pids", "weights", "clusters", "coordinates"], _near_kernel(), SUMS)
    sums = bounded.unionByName(measured).groupBy("pid", "other").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    return _scored(sums, placed, sizes)


def _scored(sums: DataFrame, placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Silhouettes from the bounds of summed distances: they rise with the nearest other cluster and fall with the own."""
    own = F.col("other") == F.col("cluster")
    middle = (F.col("low") + F.col("high")) / 2
    ends = {"low": F.col("low"), "middle": middle, "high": F.col("high")}
    inner = [F.max(F.when(own & (F.col("size") > 1), v / (F.col("size") - 1))).alias(f"inner_{k}") for k, v in ends.items()]
    nearest = [F.min(F.when(~own, v / F.col("size"))).alias(f"nearest_{k}") for k, v in ends.items()]

    def score(inside: str, outside: str) -> Column:
        top = F.greatest(inside, outside)
        return F.coalesce(F.when(F.col(inside).isNotNull() & (top > 0), (F.col(outside) - F.col(inside)) / top), F.lit(0.0))

    return (
        sums.join(placed.select("pid", "weight", "cluster"), "pid")
        .join(sizes.select(F.col("cluster").alias("other"), F.col("weight").alias("size")), "other")
        .groupBy("pid", "weight", "cluster").agg(*inner, *nearest)
        .select(
            "pid", "weight", "cluster",
            score("inner_middle", "nearest_middle").alias("silhouette"),
            score("inner_high", "nearest_low").alias("low"),
            score("inner_low", "nearest_high").alias("high"),
        )
    )


def estimate_silhouette(points: DataFrame, labels: DataFrame, tolerance: float = TOLERANCE,
                        piece_rows: int = PIECE_ROWS) -> Estimate | None:
    """Mean silhouette of the clustered points with its bounds; None below two
    clusters or when every cluster is one point."""
    found = cluster_counts(labels).first()
    if found["clusters"] < 2 or found["clustered"] <= found["clusters"]:
        return None
    total = F.sum("weight")
    with temporary_tables(points.sparkSession):
        row = bounded_silhouettes(points, labels, tolerance, piece_rows).agg(
            *[(F.sum(F.col(c) * F.col("weight")) / total).alias(c) for c in ("silhouette", "low", "high")]
        ).first()
    return Estimate(row["silhouette"], row["low"], row["high"])
