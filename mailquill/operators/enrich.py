"""Attach page text to the articles worth it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquill.functions.maintext import readable_text
from mailquill.functions.scoring import HIGH, MEDIUM
from mailquill.functions.text import PAGE_TEXT_LIMIT, snippet
from mailquill.operators.dedup import dedup_first
from mailquill.session import materialize

# Fixed values.
NO_TEXT = "Could not retrieve full text."
FAILED = "Error retrieving full text: "
FAILED_LIMIT = 100


def enrichment_candidates(df: DataFrame, high: str = HIGH, medium: str = MEDIUM) -> DataFrame:
    """High and medium rows without page text; the column is added first where it is absent."""
    if "full_text_summary" not in df.columns:
        df = df.withColumn("full_text_summary", F.lit(None).cast("string"))
    return df.where(F.col("full_text_summary").isNull() & F.col("score").isin(high, medium))


def page_texts(
    pages: DataFrame, links: DataFrame, text_length: int = PAGE_TEXT_LIMIT, failure_length: int = FAILED_LIMIT
) -> DataFrame:
    """``url, text`` for the linked pages: the newest copy (highest ``page_id``) of each URL, cut to its printed length.

    Which copy it is, is settled on the two narrow columns, combined before the shuffle, so a URL that was crawled very
    often weighs nothing. Links and copies are written, so that Spark knows their true size: a few of them are broadcast
    and no page moves, very many are joined by URL and ``page_id`` together, which spreads the copies. Text is extracted
    from those pages only, and after that just short rows move. Pages without an article block go to Python for their main one.
    """
    wanted = materialize(links.select(F.col("link").alias("url")).where("url IS NOT NULL").distinct(), "links")
    # Inner, not semi: a semi join would be pushed below the aggregate, and the copies would be shuffled one by one.
    newest = materialize(pages.groupBy("url").agg(F.max("page_id").alias("page_id")).join(wanted, "url"), "copies")
    linked = pages.join(newest, ["url", "page_id"], "left_semi")
    failed = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    found = linked.select("url", failed.alias("failed"), readable_text(F.col("html")).alias("whole")).select(
        "url",
        F.coalesce(
            F.concat(F.lit(FAILED), F.substring("failed", 1, failure_length)), snippet(F.col("whole"), text_length), F.lit(NO_TEXT)
        ).alias("text"),
    )
    return dedup_first(found, "url", [F.col("text").asc()])


def enrich_from_pages(
    candidates: DataFrame, pages: DataFrame, text_length: int = PAGE_TEXT_LIMIT, failure_length: int = FAILED_LIMIT
) -> DataFrame:
    """``full_text_summary`` from crawled ``pages(page_id, url, html[, error])`` by link.

    Rows without a link keep NULL. They get a join key of their own, else all of them would meet in one task. The short
    texts are written first: each is extracted once, Spark knows their true size, and the join reads plain shuffles on
    both sides, which is what adaptive skew handling needs to split a link that many rows share.
    """
    texts = materialize(page_texts(pages, candidates, text_length, failure_length), "page_texts")
    spread = F.concat(F.lit("\u0000"), F.xxhash64("hash", "link").cast("string"))
    keyed = candidates.withColumn("_url", F.coalesce("link", spread))
    joined = keyed.join(texts, keyed["_url"] == texts["url"], "left")
    found = F.when(F.col("link").isNotNull(), F.coalesce("text", F.lit(NO_TEXT)))
    return joined.select(
        *[
            found.alias(name) if name == "full_text_summary" else F.col(name)
            for name in candidates.columns
        ]
    )
