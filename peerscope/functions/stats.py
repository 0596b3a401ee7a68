"""Exact medians and scaling that hold for any number of rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The factor that makes the MAD comparable to a standard
# deviation, and the width below which a column counts as constant.
MAD_FACTOR = 1.4826
FLAT = 1e-9

# How many parts a range is cut into at each pass of a search for a rank.
RANGE_PARTS = 4096
# The approximate quantiles around a middle are off by one rank in so many.
BRACKET_ACCURACY = 10_000


@dataclass(frozen=True)
class _Search:
    """The values ``[low, high]`` of a column that should hold its ``ranks``, ``before`` of which come earlier, if known."""

    column: int
    ranks: tuple[int, ...]
    low: float
    high: float
    before: int | None = None


def exact_medians(
    df: DataFrame, columns: list[str], parts: int = RANGE_PARTS, accuracy: int = BRACKET_ACCURACY
) -> dict[str, float | None]:
    """The interpolated median of each column over its values that are neither null nor NaN.

    The first pass takes approximate quantiles just below and above each middle. The
    second counts what is below them and, in ``parts`` of the range between, what is
    inside; the part that holds the middle is cut again until all its values are
    equal. That makes two passes for up to some ten million different values near
    each other, and one more for each ``parts`` times as many. Middles outside their
    quantiles are looked for on the side that the counts name. Counts combine before the
    shuffle: a task sends at most ``parts`` + 1 rows for each middle, whatever the
    number or the distribution of the values.
    """
    clean = df.selectExpr(*[f"nanvl(CAST({c} AS DOUBLE), CAST(NULL AS DOUBLE)) AS c{i}" for i, c in enumerate(columns)])
    near = f"array({max(0.0, 0.5 - 2 / accuracy)}D, {min(1.0, 0.5 + 2 / accuracy)}D), {accuracy}"
    shape = clean.selectExpr(*[
        f"struct(count(c{i}) AS count, min(c{i}) AS min, max(c{i}) AS max, percentile_approx(c{i}, {near}) AS near) AS c{i}"
        for i in range(len(columns))
    ]).first()
    searches = [
        _Search(i, tuple(sorted({(shape[i]["count"] - 1) // 2, shape[i]["count"] // 2})), *shape[i]["near"])
        for i in range(len(columns)) if shape[i]["count"]
    ]
    found: dict[int, list[float]] = {}
    while searches:
        searches = [
            after for s, counted in zip(searches, _counted(clean, searches, parts))
            for after in _narrowed(s, counted, shape[s.column], found)
        ]
    return {c: sum(found[i]) / len(found[i]) if i in found else None for i, c in enumerate(columns)}


def _counted(clean: DataFrame, searches: list[_Search], parts: int) -> list[list]:
    """Rows, lowest and highest value of each part of each search, in order; part -1 is all below. One pass for all."""
    entries = []
    for i, s in enumerate(searches):
        value = F.col(f"c{s.column}")
        # Rounding is monotone, so no value lands in a part before a lower one.
        part = F.lit(0) if s.low == s.high else F.least(
            F.floor((value / 2 - s.low / 2) / (s.high / 2 - s.low / 2) * parts).cast("int"), F.lit(parts - 1)
        )
        inside = F.when(value.between(s.low, s.high), part)
        if s.before is None:
            inside = F.when(value < s.low, F.lit(-1)).otherwise(inside)
        entries.append(F.when(inside.isNotNull(), F.struct(F.lit(i).alias("search"), inside.alias("part"), value.alias("value"))))
    counted = (
        clean.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("entry"))
        .groupBy("entry.search", "entry.part")
        .agg(F.count("*").alias("rows"), F.min("entry.value").alias("low"), F.max("entry.value").alias("high"))
    )
    # At most ``parts`` + 1 rows for each search reach the driver.
    by_search: list[list] = [[] for _ in searches]
    for row in counted.collect():
        by_search[row["search"]].append(row)
    return [sorted(rows, key=lambda r: r["part"]) for rows in by_search]


def _narrowed(search: _Search, counted: list, shape, found: dict[int, list[float]]) -> list[_Search]:
    """What is still to be searched for the ranks of ``search``; values that are settled go to ``found``."""
    after: dict[tuple, list[int]] = {}
    for rank in search.ranks:
        before = search.before or 0
        for row in counted:
            if before + row["rows"] > rank:
                if row["low"] == row["high"]:
                    found.setdefault(search.column, []).append(row["low"])
                else:
                    after.setdefault((row["low"], row["high"], before), []).append(rank)
                break
            before += row["rows"]
        else:
            after.setdefault((search.high, shape["max"], None), []).append(rank)
    return [_Search(search.column, tuple(ranks), low, high, before) for (low, high, before), ranks in after.items()]


@dataclass(frozen=True)
class Scale:
    """Centre and width of one column; width 0 marks a constant column."""

    centre: float
    width: float

    def apply(self, column: str) -> Column:
        """Scaled log1p of ``column``."""
        if self.width <= 0:
            return F.lit(0.0)
        return F.expr(f"({log_of(column)} - ({self.centre!r}D)) / ({self.width!r}D)")


def log_of(column: str) -> str:
    return f"log1p(CAST({column} AS DOUBLE))"


def _logs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.selectExpr(*[f"{log_of(c)} AS {c}" for c in columns])


def _moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    """Count, mean and population standard deviation."""
    row = df.selectExpr(
        *[f"struct(count({c}) AS count, avg({c}) AS avg, stddev_pop({c}) AS std) AS {c}" for c in columns]
    ).first()
    return {c: (row[c]["count"], row[c]["avg"] or 0.0, row[c]["std"] or 0.0) for c in columns}


@dataclass(frozen=True)
class Spread:
    """Location and spread of one column on the log1p scale."""

    median: float
    mad: float
    std: float


def log_spread(df: DataFrame, columns: list[str]) -> dict[str, Spread]:
    """Median, MAD and population standard deviation of log1p of each column."""
    logs = _logs(df, columns)
    moments = _moments(logs, columns)
    medians = exact_medians(logs, columns)
    present = [c for c in columns if medians[c] is not None]
    if not present:
        return {c: Spread(0.0, 0.0, 0.0) for c in columns}
    distances = logs.selectExpr(*[f"abs({c} - ({medians[c]!r}D)) AS {c}" for c in present])
    mads = exact_medians(distances, present)
    return {
        c: Spread(medians[c], mads[c], moments[c][2]) if c in present else Spread(0.0, 0.0, 0.0)
        for c in columns
    }


def robust_scales(df: DataFrame, columns: list[str]) -> dict[str, Scale]:
    """Median and scaled MAD of log1p; the standard deviation where the MAD is 0."""
    scales = {}
    for name, spread in log_spread(df, columns).items():
        width = MAD_FACTOR * spread.mad
        if width <= FLAT:
            width = spread.std
        scales[name] = Scale(spread.median, width if width > FLAT else 0.0)
    return scales


def standard_scales(df: DataFrame, columns: list[str]) -> dict[str, Scale]:
    """Mean and population standard deviation of log1p."""
    logs = _logs(df, columns)
    scales = {}
    for name, (_, mean, std) in _moments(logs, columns).items():
        # A constant column may show a rounding-size deviation.
        constant = std <= 10 * math.ulp(1.0) * max(1.0, abs(mean))
        scales[name] = Scale(mean, 0.0 if constant else std)
    return scales
