"""The knee of a k-distance curve, as a clustering radius.

Kneedle (Satopää, Albrecht, Irwin and Raghavan, 2011) with sensitivity 1, for a
convex increasing curve.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.functions.stats import exact_medians

STRETCH_ROWS = 65_536


@dataclass(frozen=True)
class Radius:
    """A clustering radius: ``source`` is ``override`` or ``auto``; ``knee_index``
    is the place on the curve, None without a knee."""

    eps: float
    source: str
    knee_index: int | None


def difference_curve(curve: DataFrame, rows: int, low: float, high: float) -> DataFrame:
    """The curve mirrored to a concave one, less the diagonal, with its extrema.

    Positions are cut into stretches that overlap by one row on each side, so
    neighbours are found without one window over the whole curve.
    """
    mirrored = curve.select(
        (F.lit(rows - 1) - F.col("place")).alias("step"),
        (1 - (F.col("k_distance") - low) / (high - low)).alias("height"),
    ).select("step", (F.col("height") - F.col("step") / F.lit(rows - 1)).alias("rise"))
    stretch = F.expr(f"step div {STRETCH_ROWS}")
    seen_from = F.array_distinct(F.array(*[
        F.expr(f"greatest(step + {shift}, 0) div {STRETCH_ROWS}") for shift in (-1, 0, 1)
    ]))
    beside = Window.partitionBy("stretch").orderBy("step")
    before, after = F.lag("rise").over(beside), F.lead("rise").over(beside)
    return (
        mirrored.withColumn("stretch", F.explode(seen_from))
        .withColumns({"before": before, "after": after})
        .filter(F.col("stretch") == stretch)
        .withColumns({
            "is_top": (F.col("rise") >= F.coalesce("before", "rise")) & (F.col("rise") >= F.coalesce("after", "rise")),
            "is_dip": (F.col("rise") <= F.coalesce("before", "rise")) & (F.col("rise") <= F.coalesce("after", "rise")),
        })
    )


def knee_place(curve: DataFrame) -> int | None:
    """Place of the knee on a stored curve ``(place, k_distance)``.

    Each local top sets a threshold one mean step below itself, each dip resets
    it to 0; the first point whose successor falls below it gives the knee.
    """
    shape = curve.agg(F.count("*").alias("rows"), F.min("k_distance"), F.max("k_distance")).first()
    rows, low, high = shape
    if rows < 2 or high <= low:
        return None
    marked = difference_curve(curve, rows, low, high).select(
        "stretch", "step", "after",
        F.when(F.col("is_top"), F.col("step")).alias("top"),
        F.when(F.col("is_dip"), 0.0)
        .when(F.col("is_top"), F.col("rise") - F.lit(1.0) / F.lit(rows - 1))
        .alias("threshold"),
    )
    so_far = Window.partitionBy("stretch").orderBy("step")
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # One row per stretch of 65 536 points.
    carried = (
        marked.groupBy("stretch")
        .agg(
            F.max_by("top", F.when(F.col("top").isNotNull(), F.col("step"))).alias("end_top"),
            F.max_by("threshold", F.when(F.col("threshold").isNotNull(), F.col("step"))).alias("end_threshold"),
        )
        .select(
            "stretch",
            F.last("end_top", ignorenulls=True).over(earlier).alias("carried_top"),
            F.last("end_threshold", ignorenulls=True).over(earlier).alias("carried_threshold"),
        )
    )
    followed = marked.withColumns({
        "top": F.last("top", ignorenulls=True).over(so_far),
        "threshold": F.last("threshold", ignorenulls=True).over(so_far),
    }).join(carried, "stretch")
    top = F.coalesce("top", "carried_top")
    threshold = F.coalesce("threshold", "carried_threshold")
    found = (
        followed.filter(top.isNotNull() & (F.col("after") < threshold))
        .agg(F.min_by(top, F.col("step")).alias("top"))
        .first()["top"]
    )
    return None if found is None else rows - 1 - found


def recommend_eps(curve: DataFrame, override: float | None = None) -> Radius:
    """An explicit radius, else the curve's knee, else its median."""
    if override is not None:
        return Radius(float(override), "override", None)
    place = knee_place(curve)
    if place is None:
        return Radius(exact_medians(curve, ["k_distance"])["k_distance"], "auto", None)
    value = curve.filter(F.col("place") == place).first()["k_distance"]
    return Radius(value, "auto", place)
