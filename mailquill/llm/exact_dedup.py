"""Exact duplicates: a 128-bit hash groups, bytes decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquill.session import materialize

#: Tasks over which the copies of one text are spread before their bytes are compared.
SALTS = 16


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and the text's SHA-256.

    The smallest id of equal texts stays, or with ``largest`` the largest. A NULL text is an empty one. A NULL id is a
    document of its own that stays only where its group has no other id. Of rows that repeat both id and text one stays.
    Other columns of ``docs`` are ignored. An empty table gives no rows.

    Only hashes and ids are shuffled for the grouping. Of groups of two or more the texts meet the hash in ``SALTS`` parts, so a text
    that a third of all rows hold lies in as many tasks; each combines its copies, by the bytes themselves, and sends one on.
    """
    best = F.max if largest else F.min
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("hash"))
    rows = materialize(texts.select("id", "hash", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "hashes")

    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), best("id").alias("keep"))
    repeated = materialize(groups.where("size > 1"), "repeated")
    salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    parts = repeated.select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    same_bytes = (
        texts.withColumn("salt", salt)
        .join(parts.hint("merge"), ["hash", "salt"])  # never broadcast: its rows are SALTS times what Spark estimates
        .groupBy("hash", "text")
        .agg(F.count(F.lit(1)).alias("size"), best("id").alias("keep"))
        .select("hash", "size", "keep", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    )
    classes = materialize(same_bytes, "classes")

    # Rows alike in id and text are told apart by a running number; all others are single here.
    single = rows.groupBy("hash", "sha", "id").agg(F.count(F.lit(1)).alias("times"))
    found = single.join(classes, ["hash", "sha"], "left")
    copies = found.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return copies.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        ((F.col("copy") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
