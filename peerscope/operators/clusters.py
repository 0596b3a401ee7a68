"""DBSCAN over blocks of points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.functions.ranking import with_global_rank
from peerscope.operators.blocks import BLOCK_ROWS, Layout, Space, cell_side, compare, lay_out, marked, spread_out
from peerscope.operators.components import connected_components
from peerscope.operators.neighbours import (
    eps_pairs, matrix, near_parts, spot_neighbours, strips, within,
)
from peerscope.session import materialize

NOISE = -1


def linked_sets(points: np.ndarray, eps: float) -> np.ndarray:
    """For each point the lowest index it is linked to, by breadth-first search
    over distances that are measured when they are needed."""
    lowest = np.full(len(points), -1)
    for seed in range(len(points)):
        if lowest[seed] >= 0:
            continue
        front = np.array([seed])
        while len(front):
            lowest[front] = seed
            rest = np.flatnonzero(lowest < 0)
            others, hit = points[rest], np.zeros(len(rest), dtype=bool)
            for part in strips(len(front), len(rest)):
                hit |= within(points[front[part]], others, eps).any(axis=0)
            front = rest[hit]
    return lowest


def _local_kernel(eps: float) -> Callable:
    """Sets of linked core points within one block, named by one of their pids."""
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                pids, core = np.asarray(row.pids), np.asarray(row.core, dtype=bool)
                points = matrix(row.coordinates, len(pids))[core]
                group = np.full(len(pids), NOISE)
                group[core] = pids[core][linked_sets(points, eps)]
                yield pd.DataFrame({
                    "pid": pids, "block": row.block, "place": np.arange(len(pids)), "locals": group,
                })

    return kernel


def _link_kernel(eps: float) -> Callable:
    """Local sets linked across a pair of blocks, and sets that border points touch.

    A point that is not core has fewer than min_samples neighbours, so it
    touches fewer than that many sets.
    """
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                left = matrix(row.a_coordinates, len(row.a_pids))
                right = matrix(row.b_coordinates, len(row.b_pids))
                a_pids, b_pids = np.asarray(row.a_pids), np.asarray(row.b_pids)
                a_sets, b_sets = np.asarray(row.a_locals), np.asarray(row.b_locals)
                links, borders = [], []
                for rows, others in near_parts(left, right, eps):
                    near, own, other = within(left[rows], right[others], eps), a_sets[rows], b_sets[others]
                    borders.append(_touched(near, a_pids[rows], own, other))
                    if row.a != row.b:
                        borders.append(_touched(near.T, b_pids[others], other, own))
                        links.append(_linked(near, own, other))
                for border, found in ((False, links), (True, borders)):
                    if found:
                        rows = np.unique(np.concatenate(found), axis=0)
                        yield pd.DataFrame({"border": border, "u": rows[:, 0], "v": rows[:, 1]})

    return kernel


def _touched(near: np.ndarray, pids: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Points that are not core, and the sets near them."""
    border, core = np.flatnonzero(own == NOISE), np.flatnonzero(other != NOISE)
    at, to = np.nonzero(near[np.ix_(border, core)])
    return np.unique(np.column_stack([pids[border[at]], other[core[to]]]), axis=0)


def _linked(near: np.ndarray, a_sets: np.ndarray, b_sets: np.ndarray) -> np.ndarray:
    """Pairs of sets with points near each other."""
    rows, others = np.flatnonzero(a_sets != NOISE), np.flatnonzero(b_sets != NOISE)
    if not len(rows) or not len(others):
        return np.empty((0, 2), dtype=np.int64)
    others = others[np.argsort(b_sets[others], kind="stable")]
    names, starts = np.unique(b_sets[others], return_index=True)
    at, to = np.nonzero(np.logical_or.reduceat(near[np.ix_(rows, others)], starts, axis=1))
    return np.unique(np.column_stack([a_sets[rows[at]], names[to]]), axis=0)


def dbscan(space: Space, eps: float, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(ip_address, cluster)``: clusters from 0, noise -1.

    A point is core if at least ``min_samples`` points, itself included, lie
    within ``eps``. Clusters are numbered by their first core point in address
    order, and a border point joins the lowest-numbered cluster it touches, so
    the labels do not depend on partitioning.
    """
    block_rows = max(block_rows, 2 * min_samples)
    layout = lay_out(space, cell_side(eps, max(space.dims, 1)), block_rows)
    labels = _label_blocks(space, layout, eps, min_samples)
    return space.spread(labels, "cluster")


def _label_blocks(space: Space, layout: Layout, eps: float, min_samples: int) -> DataFrame:
    """``(pid, cluster)`` of each spot, from local sets joined across blocks."""
    pairs = eps_pairs(layout, eps)
    cores = spot_neighbours(layout, pairs, eps).select(
        "pid", (F.col("neighbours") >= min_samples).alias("core")
    )
    placed = layout.blocks.select("block", "pids", "coordinates", "cell")
    in_blocks = placed.select("block", F.posexplode("pids").alias("place", "pid")).join(cores, "pid")
    members = materialize(
        spread_out(
            marked(placed.drop("cell"), in_blocks, "core"), layout.count, (space.rows // layout.count) ** 2
        ).mapInPandas(
            _local_kernel(eps), "pid long, block long, place int, locals long"
        ),
        "members",
    )
    blocks = materialize(marked(placed, members, "locals"), "named")
    members = members.select("pid", F.col("locals").alias("local"))
    links = materialize(
        compare(
            pairs, blocks, ["pids", "coordinates", "locals"],
            _link_kernel(eps), "border boolean, u long, v long",
        ).distinct(),
        "links",
    )
    # A block inside one micro-cell is a single set; blocks of one cell are linked.
    pure = blocks.filter("cell IS NOT NULL").select("cell", F.element_at("locals", 1).alias("u"))
    same_cell = pure.join(pure.groupBy("cell").agg(F.min("u").alias("v")), "cell").select("u", "v")
    # A lone pure block may hold points that are not core.
    same_cell = same_cell.filter(f"u != v AND u != {NOISE} AND v != {NOISE}")
    edges = links.filter("NOT border").select("u", "v").unionByName(same_cell)
    roots = connected_components(edges)

    first_names = (
        members.filter(F.col("local") != NOISE)
        .join(space.spots.select("pid", "name"), "pid")
        .groupBy(F.col("local").alias("node"))
        .agg(F.min("name").alias("name"))
    )
    rooted = materialize(
        first_names.join(roots, "node", "left").select(
            F.col("node").alias("local"), F.coalesce("root", "node").alias("root"), "name"
        ),
        "roots",
    )
    numbers = with_global_rank(rooted.groupBy("root").agg(F.min("name").alias("name")), ["name"], "cluster")
    numbered = rooted.drop("name").join(numbers.drop("name"), "root").select("local", "cluster")
    borders = (
        links.filter("border")
        .join(numbered, F.col("v") == F.col("local"))
        .groupBy(F.col("u").alias("pid"))
        .agg(F.min("cluster").alias("border_cluster"))
    )
    return (
        members.join(numbered, "local", "left")
        .join(borders, "pid", "left")
        .select("pid", F.coalesce("cluster", "border_cluster", F.lit(NOISE)).cast("bigint").alias("cluster"))
    )
