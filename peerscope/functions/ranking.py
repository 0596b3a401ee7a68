"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.session import materialize

# monotonically_increasing_id keeps the partition above bit 33 and the row
# within the partition below it.
ROW_BITS = 33


def with_global_rank(df: DataFrame, order_by: list, name: str) -> DataFrame:
    """``df`` with ``name``: 0-based position in the order of ``order_by``.

    One range shuffle sorts the rows. A position is then the row's place in
    its partition plus the size of the partitions before it; only those sizes,
    one row per partition, meet in one task. ``order_by`` should end in a key,
    so that equal values spread over partitions.
    """
    ordered = materialize(
        df.orderBy(*order_by).withColumn("_place", F.monotonically_increasing_id()), "ranked"
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    partition = F.shiftright("_place", ROW_BITS)
    sizes = ordered.groupBy(partition.alias("_partition")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        ordered.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")
        .withColumn(name, F.col("_offset") + place)
        .drop("_partition", "_place", "_offset")
    )
