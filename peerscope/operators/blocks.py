"""Points cut into blocks of bounded size, and the block pairs worth comparing.

Neighbour searches must not enumerate all pairs of points, nor gather a crowded
region in one task. Points are sorted along their most varied axes and cut into
blocks of equal size, however crowded a region is. A search then works on pairs
of blocks: the bounding boxes rule out most pairs, and a task compares the
points of one pair and returns sums, never the pairs of points.

The number of blocks is bounded, so a block grows with the table. Even where boxes
rule out nothing, a point is sent to as many tasks as there are blocks, and what
is shuffled stays in proportion to the points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.ranking import with_global_rank
from peerscope.session import materialize

BLOCK_ROWS = 2048
# At most so many blocks, whatever ``block_rows`` asks for.
MOST_BLOCKS = 64
# How many quantiles may cut an axis; a box covers at most 64 x 64 bins.
FEWEST_CUTS, MOST_CUTS = 7, 63
SORT_AXES = 4
SEARCH_AXES = 2
# Room for rounding when a bounding box lies just outside a radius.
ROUNDING = 1e-9
# Comparing blocks costs far more than their bytes suggest, so the number of
# tasks follows the distances and not the size of the data: a few comparisons a
# task until all cores are busy, beyond that about a second's work.
COMPARISONS_PER_TASK = 4
DISTANCES_PER_TASK = 1 << 26
# The driver keeps track of so many tasks at most; beyond, a task has more to do.
MOST_TASKS = 20_000


@dataclass(frozen=True)
class Layout:
    """``blocks`` has one row per block.

    ``pids``, ``weights`` and ``coordinates`` (row by row) hold its points,
    ``low`` and ``high`` its bounding box. ``cell`` is set if all its points
    share one micro-cell.
    """

    blocks: DataFrame
    count: int
    dims: int
    axes: list[int]
    cuts: list[list[float]]


@dataclass(frozen=True)
class Space:
    """Points ``(ip_address, features)`` and their distinct positions.

    ``spots`` has a row per position: ``pid``, the lowest address as ``name``
    and the number of points as ``weight``. However many endpoints behave
    alike, they become one spot.
    """

    points: DataFrame
    spots: DataFrame
    rows: int
    dims: int

    def spread(self, by_spot: DataFrame, column: str) -> DataFrame:
        """``(ip_address, column)`` of every point from ``(pid, column)`` of spots."""
        by_position = self.spots.select("pid", "features").join(by_spot, "pid").select("features", column)
        return self.points.join(by_position, "features").select("ip_address", column)


def prepare(points: DataFrame) -> Space:
    """The space of stored ``points``, to be searched as often as needed."""
    spots = materialize(
        points.groupBy("features")
        .agg(F.min("ip_address").alias("name"), F.count("*").alias("weight"))
        .withColumn("pid", F.monotonically_increasing_id()),
        "spots",
    )
    size = spots.agg(F.count("*").alias("rows"), F.max(F.size("features")).alias("dims")).first()
    return Space(points, spots, size["rows"], size["dims"] or 0)


def block_count(rows: int, block_rows: int) -> int:
    return max(1, min(rows // block_rows, MOST_BLOCKS))


def lay_out(space: Space, cell_side: float | None = None, block_rows: int = BLOCK_ROWS) -> Layout:
    """Cut the spots into blocks of ``block_rows`` to twice as many, or into
    ``MOST_BLOCKS`` larger ones.

    With ``cell_side`` they are also sorted by the cubic micro-cell they fall
    in. Within a block points are in the order of their names.
    """
    spots, rows, dims = space.spots, space.rows, space.dims
    count = block_count(rows, block_rows)
    placed = spots.withColumn("cell", F.lit(None).cast("array<bigint>"))
    # More blocks are told apart by more cuts, so a bin holds about as many.
    parts = min(MOST_CUTS, max(FEWEST_CUTS, 2 * math.isqrt(count)))
    steps = [(i + 1) / (parts + 1) for i in range(parts)]
    quantiles = spots.agg(
        *[F.percentile_approx(F.col("features")[i], steps, 1000).alias(str(i)) for i in range(dims)]
    ).first() if dims else []
    cuts = [sorted(set(quantiles[i] or [])) for i in range(dims)]
    if cell_side and dims:
        shifts = ", ".join(f"{_grid_shift(c, cell_side)!r}D" for c in cuts)
        placed = placed.withColumn("cell", F.expr(
            f"transform(features, (x, i) -> floor((x - array({shifts})[i]) / {cell_side!r}D))"
        ))
    axes = sorted(range(dims), key=lambda i: -len(cuts[i]))
    order = [_bin(F.col("features")[i], cuts[i]) for i in axes[:SORT_AXES]]
    placed = with_global_rank(placed, [*order, "cell", "features", "pid"], "place")
    placed = placed.withColumn("block", F.expr(f"(place * {count}) div {max(rows, 1)}")).drop("place")
    members = F.sort_array(F.collect_list(F.struct("name", "pid", "weight", "features")))
    blocks = (
        placed.repartition(count, "block")
        .groupBy("block")
        .agg(
            members.alias("members"),
            F.expr(f"array({', '.join(f'min(features[{i}])' for i in range(dims))})").alias("low"),
            F.expr(f"array({', '.join(f'max(features[{i}])' for i in range(dims))})").alias("high"),
            F.when(F.min("cell") == F.max("cell"), F.min("cell")).alias("cell"),
        )
        .select(
            "block",
            F.col("members.pid").alias("pids"),
            F.col("members.weight").alias("weights"),
            F.flatten("members.features").alias("coordinates"),
            "low", "high", "cell",
        )
    )
    return Layout(materialize(blocks, "blocks"), count, dims, axes[:SEARCH_AXES], cuts)


def _grid_shift(cuts: list[float], side: float) -> float:
    """Where to start a grid so that its lines part the fewest quantiles: a line
    through a crowd would split it over many cells."""
    def cost(shift: float) -> tuple:
        cells = [math.floor((c - shift) / side) for c in cuts]
        parted = sum(a != b for a, b in zip(cells, cells[1:]))
        room = sum(min((c - shift) % side, (shift - c) % side) for c in cuts)
        return parted, -room

    return min((side * step / 16 for step in range(16)), key=cost)


def _bin(value: Column, cuts: list[float]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value))


def near_pairs(layout: Layout, radius: Column, both_ways: bool) -> DataFrame:
    """Pairs ``(a, b)`` of blocks whose boxes are within ``radius`` of block a.

    A box is listed under the quantile bins it covers on the two most varied
    axes, at most 64 x 64; blocks sharing a bin meet in an equi-join. A pair is
    kept only in the first bin both cover, so none comes twice. Without
    ``both_ways`` a pair is listed once, with a <= b.
    """
    left = layout.blocks.select(
        F.col("block").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"),
        F.col("cell").alias("a_cell"), radius.alias("radius"),
    )
    right = layout.blocks.select(
        F.col("block").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"),
        F.col("cell").alias("b_cell"),
    )
    keys, once = [], F.lit(True)
    for n, axis in enumerate(layout.axes):
        cuts = layout.cuts[axis]
        left = left.withColumn(f"a_from{n}", _bin(F.col("a_low")[axis] - F.col("radius"), cuts)).withColumn(
            f"bin{n}",
            F.explode(F.sequence(f"a_from{n}", _bin(F.col("a_high")[axis] + F.col("radius"), cuts))),
        )
        right = right.withColumn(f"b_from{n}", _bin(F.col("b_low")[axis], cuts)).withColumn(
            f"bin{n}", F.explode(F.sequence(f"b_from{n}", _bin(F.col("b_high")[axis], cuts)))
        )
        keys.append(f"bin{n}")
        once = once & (F.col(f"bin{n}") == F.greatest(f"a_from{n}", f"b_from{n}"))
    if not keys:  # a table without points has no axes
        left, right, keys = left.withColumn("bin", F.lit(0)), right.withColumn("bin", F.lit(0)), ["bin"]
    apart = F.expr(" + ".join([
        "0.0D",
        *[f"pow(greatest(0.0D, b_low[{i}] - a_high[{i}], a_low[{i}] - b_high[{i}]), 2)" for i in range(layout.dims)],
    ]))
    pairs = left.join(right, keys).filter(once)
    if not both_ways:
        pairs = pairs.filter("a <= b")
    reach = F.col("radius") * F.col("radius") * (1 + ROUNDING)
    return pairs.filter(apart <= reach).select("a", "b", "a_cell", "b_cell")


def compare(pairs: DataFrame, blocks: DataFrame, columns: list[str], kernel: Callable, schema: str) -> DataFrame:
    """Run ``kernel`` on the points of each pair of blocks.

    ``columns`` of both blocks arrive as ``a_<column>`` and ``b_<column>``, beside
    all columns of ``pairs``, which is stored. The points are shuffled once.
    """
    count, largest = blocks.agg(F.count("*"), F.max(F.size("pids"))).first()
    tasks = task_count(pairs, pairs.count(), (largest or 0) ** 2)
    # Few files hold all blocks, and each block leaves its task once per pair.
    dealt = blocks.repartition(max(count, 1), "block")
    left = dealt.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = dealt.select(F.col("block").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    joined = pairs.join(left, "a").repartition(tasks, "a", "b").join(
        pairs.select("a", "b").join(right, "b").repartition(tasks, "a", "b"), ["a", "b"]
    )
    # Spark shuffles for a join into its default number of partitions at least.
    return joined.coalesce(tasks).mapInPandas(kernel, schema)


def marked(blocks: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """``blocks`` with ``column`` of ``rows`` ``(block, place, column)`` as an array
    in the order of the block's points."""
    in_order = rows.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("place", column))).alias("members")
    )
    return blocks.join(in_order.select("block", F.col(f"members.{column}").alias(column)), "block")


def task_count(df: DataFrame, comparisons: int, distances: int) -> int:
    """Tasks for so many block comparisons of so many distances each."""
    few = min(comparisons / COMPARISONS_PER_TASK, 2 * df.sparkSession.sparkContext.defaultParallelism)
    many = min(comparisons * distances / DISTANCES_PER_TASK, comparisons)
    return max(1, min(math.ceil(max(few, many)), MOST_TASKS))


def spread_out(df: DataFrame, comparisons: int, distances: int) -> DataFrame:
    """``df`` over enough tasks for so many block comparisons."""
    tasks = task_count(df, comparisons, distances)
    return df.repartition(tasks) if tasks > 1 else df


def cell_side(eps: float, dims: int) -> float:
    """Side of a cube in which any two points are within ``eps``."""
    return eps / math.sqrt(max(dims, 1)) * (1 - ROUNDING)
