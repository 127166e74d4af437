"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquill.session import materialize


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """``df`` with ``name`` = 1, 2, 3, ... in ``order``, which must decide between any two rows.

    Rows are range-partitioned and sorted, so each knows its place within its partition. The partition sizes (one row
    per partition, never per data row) add up to the offsets. The sorted rows are written in between, because sizes and
    rows must come from the same range split, also when an executor is lost.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_place", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per range partition: the bound that makes this broadcast safe.
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + within + 1).alias(name)
    )
