"""Distances to near neighbours: counts within a radius and k-distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.functions.ranking import with_global_rank
from peerscope.operators.blocks import (
    BLOCK_ROWS, ROUNDING, Layout, Space, cell_side, compare, lay_out, marked, near_pairs, spread_out,
)
from peerscope.session import materialize


# Share of the squared lengths by which a product of matrices may miss a
# squared distance, with ample room.
PRODUCT_ERROR = 1e-11
ROWS_AT_ONCE = 64
# Distances in memory at a time, however large the blocks are; so few stay in a core's cache.
DISTANCES_AT_ONCE = 1 << 18
# Points of one box, by which a block is searched.
BOX_ROWS = 128
# One in so many neighbours are fewer to list than to multiply; so many times k to sort than to pick from.
FEW = 32
# A product is taken for a distance where its error is below this share of the square.
ENOUGH_DIGITS = 1e-7


def strips(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` whose distances to ``width`` points fit into memory."""
    step = max(1, DISTANCES_AT_ONCE // max(width, 1))
    for start in range(0, rows, step):
        yield slice(start, min(start + step, rows))


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Axis by axis, so that near points keep full precision."""
    total = np.zeros((len(left), len(right)))
    for start in range(0, len(left), ROWS_AT_ONCE):
        part = total[start:start + ROWS_AT_ONCE]
        for axis in range(left.shape[1]):
            part += np.subtract.outer(left[start:start + ROWS_AT_ONCE, axis], right[:, axis]) ** 2
    return total


def _factors(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices whose product holds the squared distances, and the most that can miss by."""
    centre = left.mean(axis=0)
    left, right = left - centre, right - centre
    left_length, right_length = (left**2).sum(axis=1), (right**2).sum(axis=1)
    rows = np.column_stack([-2 * left, left_length, np.ones(len(left))])
    columns = np.vstack([right.T, np.ones(len(right)), right_length])
    return rows, columns, PRODUCT_ERROR * (left_length.max() + right_length.max())


def _by_product(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances from one matrix product, and the most they can miss by."""
    rows, columns, error = _factors(left, right)
    return rows @ columns, error


def distance_strips(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """All distances, strip by strip; those too short for the digits of a product are measured exactly."""
    rows, columns, error = _factors(left, right)
    for part in strips(len(left), len(right)):
        rough = rows[part] @ columns
        short = rough <= error / ENOUGH_DIGITS
        found = np.count_nonzero(short)
        if 8 * found > rough.size:
            yield part, np.sqrt(squared_distances(left[part], right))
            continue
        if found:
            at, to = np.nonzero(short)
            rough[at, to] = ((left[part][at] - right[to]) ** 2).sum(axis=1)
        yield part, np.sqrt(rough, out=rough)


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All distances at once."""
    return np.concatenate([apart for _, apart in distance_strips(left, right)])


def within(left: np.ndarray, right: np.ndarray, eps: float) -> np.ndarray:
    """Which points are within ``eps``; close calls are measured again exactly."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), dtype=bool)
    rough, error = _by_product(left, right)
    near, sure = rough <= eps * eps + error, rough <= eps * eps - error
    if np.count_nonzero(near) == np.count_nonzero(sure):
        return near
    rows, others = np.nonzero(near != sure)
    for start in range(0, len(rows), 1_000_000):
        at, to = rows[start:start + 1_000_000], others[start:start + 1_000_000]
        near[at, to] = ((left[at] - right[to]) ** 2).sum(axis=1) <= eps * eps
    return near


def _boxes(points: np.ndarray) -> list[np.ndarray]:
    """Places of the points of each box: halves along the widest axis, down to ``BOX_ROWS``."""
    pieces, boxes = [np.arange(len(points))], []
    while pieces:
        piece = pieces.pop()
        if len(piece) <= BOX_ROWS:
            boxes.append(np.sort(piece))
            continue
        found, middle = points[piece], len(piece) // 2
        order = np.argpartition(found[:, np.ptp(found, axis=0).argmax()], middle)
        pieces += [piece[order[:middle]], piece[order[middle:]]]
    return boxes


def near_parts(left: np.ndarray, right: np.ndarray, reach: np.ndarray | float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``left`` and in ``right`` that hold all points within their ``reach``.

    No two points meet twice. Blocks grow with the table, so the boxes of whole
    blocks rule out little; a point is only measured against small boxes in reach.
    """
    def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.zeros((len(points), len(low)))
        for axis in range(points.shape[1]):
            at = points[:, axis][:, None]
            total += np.maximum(np.maximum(low[:, axis] - at, at - high[:, axis]), 0) ** 2
        return total

    limit = np.broadcast_to(np.square(reach) * (1 + ROUNDING), len(left))
    low, high = right.min(axis=0, keepdims=True), right.max(axis=0, keepdims=True)
    boxed = np.flatnonzero(gaps(left, low, high)[:, 0] <= limit)
    if not len(boxed):
        return
    boxes = _boxes(right)
    low, high = (np.stack([end(right[b], axis=0) for b in boxes]) for end in (np.min, np.max))
    for rows in _boxes(left[boxed]):
        rows = boxed[rows]
        near = gaps(left[rows], low, high) <= limit[rows][:, None]
        rows, met = rows[near.any(axis=1)], np.flatnonzero(near.any(axis=0))
        if not len(rows):
            continue
        others = np.concatenate([boxes[b] for b in met])
        for part in strips(len(rows), len(others)):
            yield rows[part], others


def matrix(coordinates: np.ndarray, rows: int) -> np.ndarray:
    return np.asarray(coordinates, dtype=float).reshape(rows, -1)


def _count_kernel(eps: float) -> Callable:
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                left = matrix(row.a_coordinates, len(row.a_pids))
                right = matrix(row.b_coordinates, len(row.b_pids))
                # Floats, exact to 2**53, since products of integers are slow.
                a_weights, b_weights = np.asarray(row.a_weights, dtype=float), np.asarray(row.b_weights, dtype=float)
                a_sums, b_sums = np.zeros(len(left)), np.zeros(len(right))
                for rows, others in near_parts(left, right, eps):
                    near = within(left[rows], right[others], eps)
                    if np.count_nonzero(near) * FEW < near.size:
                        at, to = np.nonzero(near)
                        a_sums[rows] += np.bincount(at, b_weights[others[to]], len(rows))
                        b_sums[others] += np.bincount(to, a_weights[rows[at]], len(others))
                        continue
                    near = near.astype(float)
                    a_sums[rows] += near @ b_weights[others]
                    b_sums[others] += a_weights[rows] @ near
                sides = [(row.a_pids, a_sums)] if row.a == row.b else [(row.a_pids, a_sums), (row.b_pids, b_sums)]
                for pids, sums in sides:
                    yield pd.DataFrame({"pid": pids, "neighbours": sums.astype(np.int64)})

    return kernel


def eps_pairs(layout: Layout, eps: float) -> DataFrame:
    """Block pairs to compare for a radius.

    Two blocks inside one micro-cell need no comparison: all their points are
    neighbours. This keeps a region that holds most points from being compared
    with itself.
    """
    pairs = near_pairs(layout, F.lit(float(eps)), both_ways=False)
    settled = (F.col("a") != F.col("b")) & F.coalesce(F.col("a_cell") == F.col("b_cell"), F.lit(False))
    return materialize(pairs.filter(~settled).select("a", "b"), "pairs")


def spot_neighbours(layout: Layout, pairs: DataFrame, eps: float) -> DataFrame:
    """``(pid, neighbours)``: weight within ``eps`` of each spot, itself included."""
    compared = compare(
        pairs, layout.blocks, ["pids", "weights", "coordinates"],
        _count_kernel(eps), "pid long, neighbours long",
    )
    # The blocks of one micro-cell that were not compared with each other.
    own = F.aggregate("weights", F.lit(0).cast("bigint"), lambda total, w: total + w)
    pure = layout.blocks.filter("cell IS NOT NULL").select("cell", "pids", own.alias("own"))
    cells = pure.groupBy("cell").agg(F.sum("own").alias("all"))
    settled = (
        pure.join(cells, "cell")
        .filter("all > own")
        .select(F.explode("pids").alias("pid"), (F.col("all") - F.col("own")).alias("neighbours"))
    )
    compared = compared.unionByName(settled)
    return compared.groupBy("pid").agg(F.sum("neighbours").alias("neighbours"))


def eps_neighbours(space: Space, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How many points lie within ``eps`` of each, itself included."""
    layout = lay_out(space, cell_side(eps, space.dims), block_rows)
    return space.spread(spot_neighbours(layout, eps_pairs(layout, eps), eps), "neighbours")


def _smallest(values: np.ndarray, k: int) -> np.ndarray:
    k = min(k, values.shape[1])
    return np.argpartition(values, k - 1, axis=1)[:, :k]


def nearest(left: np.ndarray, right: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance to and weight of the k nearest points of ``right``, ascending.

    A few more than k are picked by a matrix product and measured exactly; a
    point whose k-th might still be among the others is measured against all.
    """
    parts = [_nearest_of_strip(left[part], right, weights, k) for part in strips(len(left), len(right))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _nearest_of_strip(left: np.ndarray, right: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rough, error = _by_product(left, right)
    spare = 8
    picked = _smallest(rough, k + spare)
    exact = np.stack([((left - right[picked[:, n]]) ** 2).sum(axis=1) for n in range(picked.shape[1])], axis=1)
    order = np.argsort(exact, axis=1, kind="stable")[:, :k]
    squares, chosen = np.take_along_axis(exact, order, axis=1), np.take_along_axis(picked, order, axis=1)
    if picked.shape[1] < len(right):
        reached = np.take_along_axis(rough, picked, axis=1).max(axis=1) - 2 * error
        open_rows = np.flatnonzero(reached <= squares[:, -1])
        for start in range(0, len(open_rows), ROWS_AT_ONCE):
            at = open_rows[start:start + ROWS_AT_ONCE]
            full = squared_distances(left[at], right)
            best = _smallest(full, k)
            values = np.take_along_axis(full, best, axis=1)
            order = np.argsort(values, axis=1, kind="stable")
            squares[at] = np.take_along_axis(values, order, axis=1)
            chosen[at] = np.take_along_axis(best, order, axis=1)
    return np.sqrt(squares), weights[chosen]


def _within_kernel(k: int) -> Callable:
    """Nearest neighbours inside the own block, and the distance that has k of them."""
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                points = matrix(row.coordinates, len(row.pids))
                distances, weights = nearest(points, points, np.asarray(row.weights), k)
                enough = np.cumsum(weights, axis=1) >= k
                reached = np.where(
                    enough.any(axis=1),
                    distances[np.arange(len(points)), enough.argmax(axis=1)],
                    np.inf,
                )
                yield pd.DataFrame({
                    "block": row.block,
                    "place": np.arange(len(points)),
                    "pid": row.pids,
                    "reach": reached,
                    "distances": list(distances),
                    "weights": list(weights),
                })

    return kernel


def _nearest_within(left: np.ndarray, right: np.ndarray, weights: np.ndarray, reach: np.ndarray, k: int) -> tuple:
    """Place in ``left``, distance and weight of up to k nearest points of ``right`` within each point's ``reach``."""
    rough, error = _by_product(left, right)
    near = rough <= (reach**2 + error)[:, None]
    many = np.count_nonzero(near, axis=1) > FEW * k
    near[many] = False
    at, to = np.nonzero(near)
    found = np.sqrt(((left[at] - right[to]) ** 2).sum(axis=1))
    close = found <= reach[at]
    at, to, found = at[close], to[close], found[close]
    order = np.lexsort((found, at))
    at, to, found = at[order], to[order], found[order]
    some = np.arange(len(at)) - np.searchsorted(at, at) < k
    at, found, weight = at[some], found[some], weights[to[some]]
    crowded = np.flatnonzero(many)
    if not len(crowded):
        return at, found, weight
    apart, weighing = nearest(left[crowded], right, weights, k)
    rows, nth = np.nonzero(apart <= reach[crowded][:, None])
    return tuple(map(np.concatenate, ((at, crowded[rows]), (found, apart[rows, nth]), (weight, weighing[rows, nth]))))


def _across_kernel(k: int) -> Callable:
    """Nearest neighbours of block a's points in block b that may be among the k."""
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                left = matrix(row.a_coordinates, len(row.a_pids))
                right = matrix(row.b_coordinates, len(row.b_pids))
                pids, reach, b_weights = np.asarray(row.a_pids), np.asarray(row.a_reach), np.asarray(row.b_weights)
                found = []
                for rows, others in near_parts(left, right, reach):
                    at, apart, weights = _nearest_within(left[rows], right[others], b_weights[others], reach[rows], k)
                    found.append((pids[rows[at]], apart, weights))
                if found:
                    yield pd.DataFrame(dict(zip(("pid", "distance", "weight"), map(np.concatenate, zip(*found)))))

    return kernel


def k_distances(space: Space, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distance from each point to its k-th nearest, itself being the first.

    The own block gives an upper bound; only blocks nearer than that are
    searched. No rows come out if there are fewer than k points.
    """
    layout = lay_out(space, block_rows=max(block_rows, k))
    own = layout.blocks.select("block", "pids", "weights", "coordinates")
    inside = spread_out(own, layout.count, (space.rows // layout.count) ** 2).mapInPandas(
        _within_kernel(k),
        "block long, place int, pid long, reach double, distances array<double>, weights array<long>",
    )
    inside = materialize(inside, "inside")
    blocks = marked(layout.blocks, inside, "reach").withColumn("radius", F.array_max("reach"))
    blocks = materialize(blocks, "reaching")
    reaching = Layout(blocks, layout.count, layout.dims, layout.axes, layout.cuts)
    pairs = materialize(
        near_pairs(reaching, F.col("radius"), both_ways=True).filter("a != b").select("a", "b"), "pairs"
    )
    across = compare(
        pairs, blocks, ["pids", "weights", "coordinates", "reach"],
        _across_kernel(k), "pid long, distance double, weight long",
    )
    candidates = inside.select(
        "pid", F.inline(F.arrays_zip(F.col("distances").alias("distance"), F.col("weights").alias("weight")))
    ).unionByName(across)
    upto = Window.partitionBy("pid").orderBy("distance", "weight").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        candidates.withColumn("upto", F.sum("weight").over(upto))
        .filter(F.col("upto") >= k)
        .groupBy("pid")
        .agg(F.min("distance").alias("k_distance"))
    )
    return space.spread(found.filter(F.col("k_distance") < float("inf")), "k_distance")


def k_distance_curve(distances: DataFrame) -> DataFrame:
    """The distances in ascending order with their place from 0."""
    return with_global_rank(distances, ["k_distance", "ip_address"], "place")
