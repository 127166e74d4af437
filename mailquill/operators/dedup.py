"""Keep-first deduplication and the check against everything stored before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_mail_first() -> list[Column]:
    """Arrival order of articles: newest mail first, then the place inside the mail."""
    return [
        F.col("email_date").desc_nulls_last(),
        F.col("email_id").asc_nulls_last(),
        F.col("position").asc_nulls_last(),
    ]


def dedup_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per ``key`` in ``order``.

    ``row_number = 1`` is planned with a partial group limit below the shuffle: every map task sends at most one row per
    key, so a key that holds a third of all rows still reaches its reducer as one row per map task.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def only_new(batch: DataFrame, store: DataFrame, key: str = "hash") -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet. Only the key column of the store is read.

    No broadcast hint: Spark broadcasts the stored keys when their size on disk allows and sorts and merges otherwise. A
    batch fresh from ``dedup_first`` is already partitioned by the key, and so is a store written with
    ``sources.store.save_bucketed``; then neither side moves again.
    """
    return batch.join(store.select(key), key, "left_anti")


#: So many keys are worth asking for by value.
FEW_KEYS = 1000


def only_new_probe(batch: DataFrame, store: DataFrame, key: str = "hash", few: int = 0) -> DataFrame:
    """``only_new`` for a store far larger than the batch.

    The store is first cut down to the keys that occur in the batch. Up to ``few`` of them are asked for by value: that reaches the
    files, of which buckets, statistics and Bloom filters rule out most; what they let through is compared key by key. More are
    joined: where Spark can broadcast them, the store is only scanned, never shuffled; the second join then handles at most batch-many
    keys. Hand in a written batch: it is read several times, and only its size on disk lets Spark decide for a broadcast before it starts.
    """
    wanted = batch.select(key).where(F.col(key).isNotNull()).distinct()
    values = [row[key] for row in wanted.limit(few + 1).collect()] if few else None
    if values is not None and len(values) <= few:
        seen = store.select(key).where(F.col(key).isin(values))
    else:
        seen = store.select(key).join(wanted, key, "left_semi")
    return batch.join(seen, key, "left_anti")


def restrict_to(df: DataFrame, hashes: DataFrame | None, key: str = "hash") -> DataFrame:
    """Rows whose key is among ``hashes``; all rows when ``hashes`` is None."""
    if hashes is None:
        return df
    return df.join(hashes.select(key).distinct(), key, "left_semi")
