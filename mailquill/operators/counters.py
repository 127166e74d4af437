"""Counts per stage of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_counters(**stages: DataFrame | int) -> DataFrame:
    """``stage, n``: one row per named frame, counted by the executors. Hand in written frames, not long chains.

    A number stands for a stage that was counted already; the first stage with a frame gives the session.
    """
    spark = next(frame for frame in stages.values() if isinstance(frame, DataFrame)).sparkSession
    counts = [
        (spark.range(1).select(F.lit(frame).cast("long").alias("n")) if isinstance(frame, int) else frame.agg(F.count(F.lit(1)).alias("n")))
        .select(F.lit(stage).alias("stage"), "n")
        for stage, frame in stages.items()
    ]
    return reduce(DataFrame.unionByName, counts)
