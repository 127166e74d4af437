"""Bring rows to the stored article columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquill.functions.text import title_hash
from mailquill.schema import ARTICLE_SCHEMA


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", title_hash(F.col("title")))


def with_missing_columns(df: DataFrame) -> DataFrame:
    """Stored columns that ``df`` lacks are added as NULL; stored columns come first, in stored order."""
    known = [
        F.col(field.name).cast(field.dataType).alias(field.name)
        if field.name in df.columns
        else F.lit(None).cast(field.dataType).alias(field.name)
        for field in ARTICLE_SCHEMA
    ]
    others = [name for name in df.columns if name not in ARTICLE_SCHEMA.names]
    return df.select(*known, *others)


def stamp(hashed: DataFrame, added_at: str) -> DataFrame:
    """Exactly the stored columns of rows that have their hash, all stamped with the load time."""
    return with_missing_columns(hashed.withColumn("added_at", F.lit(added_at))).select(*ARTICLE_SCHEMA.names)


def schema_align(df: DataFrame, added_at: str) -> DataFrame:
    """Exactly the stored columns, with the hash of the title. A batch without titles gives no rows."""
    if "title" not in df.columns:
        return stamp(df.where(F.lit(False)), added_at)
    return stamp(with_hash(df), added_at)
