"""Updates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_updates(updates: DataFrame, key: str, cols: list[str], version: Column | None = None) -> DataFrame:
    """One update per key, NULL keys dropped.

    With ``version`` each column takes its newest value that is not NULL; without it one whole row is taken, the same
    one on every run. Both are plain aggregates, combined before the shuffle.
    """
    keyed = updates.where(F.col(key).isNotNull())
    if version is None:
        picked = keyed.groupBy(key).agg(F.max(F.struct(*cols)).alias("_row"))
        return picked.select(key, *[F.col("_row")[name].alias(name) for name in cols])
    newest = [F.max_by(name, F.when(F.col(name).isNotNull(), version)).alias(name) for name in cols]
    return keyed.groupBy(key).agg(*newest)


def merge_updates(
    df: DataFrame, updates: DataFrame, key: str, cols: list[str], version: Column | None = None
) -> DataFrame:
    """``df`` with ``cols`` taken from the update of the same key.

    A NULL update never replaces a value, updates of unknown keys are ignored and nothing is inserted.
    """
    fresh = unique_updates(updates, key, cols, version).select(
        F.col(key), *[F.col(name).alias(f"_new_{name}") for name in cols]
    )
    joined = df.join(fresh, key, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{name}"), F.col(name)).alias(name) if name in cols else F.col(name)
            for name in df.columns
        ]
    )
