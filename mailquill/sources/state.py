"""Run state: the last arrival read and the newest mail date seen, as an append-only table of one row per run.

The table is the run log of ``sources.runs``; rows of runs that read no mail tell nothing about these.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquill.schema import LOG_SCHEMA, STATE_SCHEMA


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """One row ``run_no, last_run, last_arrival`` of the latest run that read mail or was set by hand; all NULL without one."""
    try:
        runs = spark.read.schema(LOG_SCHEMA).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        runs = spark.createDataFrame([], LOG_SCHEMA)
    runs = runs.where(F.col("kind").isNull() | F.col("kind").isin("fetch", "since"))
    latest = runs.agg(F.max_by(F.struct("run_no", "last_run", "last_arrival"), "run_no").alias("latest"))
    return latest.select("latest.*")


def advance_watermark(mail: DataFrame, state: DataFrame) -> DataFrame:
    """State after ``mail``: newest date and last arrival of all fetched mails, whether or not they held anything new.

    The date only tells a user how far the mails reach; the next run goes by arrival, so neither an undated mail nor one
    that came late is passed over. What the mails do not tell stays. ``mail`` shrinks to one row on the executors.
    """
    arrival = F.max("arrival") if "arrival" in mail.columns else F.lit(None).cast("long")
    seen = mail.agg(F.max("date").alias("newest"), arrival.cast("long").alias("arrived"))
    both = seen.unionByName(state, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("newest", "arrived", *STATE_SCHEMA.names)])
    return both.select(
        (F.coalesce("run_no", F.lit(0)) + 1).cast("long").alias("run_no"),
        F.greatest(F.nullif("newest", F.lit(0.0)), "last_run").alias("last_run"),
        F.coalesce("arrived", "last_arrival").alias("last_arrival"),
    )


def set_watermark(state: DataFrame, value: float) -> DataFrame:
    """State with a date bound set by hand. It may lie before the old one; the next run goes by it and not by arrival."""
    return state.select(
        (F.coalesce("run_no", F.lit(0)) + 1).cast("long").alias("run_no"),
        F.lit(float(value)).alias("last_run"),
        F.lit(None).cast("long").alias("last_arrival"),
    )


def write_state(state: DataFrame, path: str) -> None:
    state.write.mode("append").parquet(path)
