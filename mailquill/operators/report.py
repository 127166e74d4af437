"""Select, order and render the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquill.functions.scoring import HIGH, LOW, MEDIUM
from mailquill.functions.text import REPORT_TEXT_LIMIT, readable, report_snippet
from mailquill.operators.dedup import restrict_to
from mailquill.operators.ranking import number_rows

# The wording of the report.
SCORE_LINE = "- **Score**: "
REASON_LINE = "- **Reason**: "
SUMMARY_LINE = "- **Scholar Summary**: "
SNIPPET_LINE = "- **Full Text Snippet**: "
DATE_LINE = "- **Email Date**: "
HIGH_HEADING = "## High Relevance"
MEDIUM_HEADING = "## Medium Relevance"
CLOSING_LINE = "Report generated on: "
EMPTY_REPORT = "No articles to report."


def tier_filter(df: DataFrame, high: str = HIGH, medium: str = MEDIUM) -> DataFrame:
    """Rows of the two upper tiers. A frame without scores passes unfiltered."""
    if "score" not in df.columns:
        return df
    return df.where(F.col("score").isin(high, medium))


def tier_rank(score: Column, high: str = HIGH, medium: str = MEDIUM) -> Column:
    """1, 2, 3 for high, medium, low; NULL for any other label."""
    return F.when(score == high, 1).when(score == medium, 2).when(score == LOW, 3)


def report_order() -> list[Column]:
    return [F.col("rank").asc_nulls_last(), F.col("email_date").desc_nulls_last(), F.col("hash").asc()]


def order_report(df: DataFrame, high: str = HIGH, medium: str = MEDIUM) -> DataFrame:
    """Rows sorted by tier, then newest first, with the hash as the last word. A distributed sort."""
    return df.withColumn("rank", tier_rank(F.col("score"), high, medium)).orderBy(*report_order())


def number_report(df: DataFrame, high: str = HIGH, medium: str = MEDIUM) -> DataFrame:
    """``order_report`` with the order kept in the columns ``rank`` and ``row_no``."""
    return number_rows(df.withColumn("rank", tier_rank(F.col("score"), high, medium)), report_order())


def articles_for_report(
    df: DataFrame, hashes: DataFrame | None = None, high: str = HIGH, medium: str = MEDIUM
) -> DataFrame:
    return restrict_to(tier_filter(df, high, medium), hashes)


def _line(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label), value))


def report_block(
    title="title", link="link", score="score", reason="reason", snippet_length: int = REPORT_TEXT_LIMIT
) -> Column:
    """Markdown of one article. Lines without content are left out; nothing is escaped."""
    empty = F.lit("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### ["), F.coalesce(title, empty), F.lit("]("), F.coalesce(link, empty), F.lit(")")),
        F.concat(F.lit(SCORE_LINE), F.coalesce(score, empty)),
        F.concat(F.lit(REASON_LINE), F.coalesce(reason, empty)),
        _line(SUMMARY_LINE, F.col("summary")),
        _line(SNIPPET_LINE, report_snippet(F.col("full_text_summary"), snippet_length)),
        F.concat(F.lit(DATE_LINE), readable(F.col("email_date"))),
    )


def report_document(
    numbered: DataFrame,
    run_date: str,
    run_time: str,
    title: str = "Digest Report",
    high: str = HIGH,
    medium: str = MEDIUM,
    snippet_length: int = REPORT_TEXT_LIMIT,
) -> DataFrame:
    """The report as rows ``section_no, row_no, block``, to be read in that order.

    A report over a large store has no size limit, so it is never one string in one task.
    """
    blocks = numbered.where(F.col("score").isin(high, medium)).select(
        tier_rank(F.col("score"), high, medium).alias("section_no"),
        F.col("row_no").cast("long").alias("row_no"),
        report_block(snippet_length=snippet_length).alias("block"),
    )
    frame = [
        (0, f"# {title} - {run_date}"),
        (1, HIGH_HEADING),
        (2, MEDIUM_HEADING),
        (3, f"{CLOSING_LINE}{run_time}"),
    ]

    def rows(entries) -> Column:
        return F.array(
            *[
                F.struct(F.lit(number).alias("section_no"), F.lit(0).cast("long").alias("row_no"), F.lit(text).alias("block"))
                for number, text in entries
            ]
        )

    headings = (
        numbered.agg(F.count(F.lit(1)).alias("articles"))
        .select(F.inline(F.when(F.col("articles") > 0, rows(frame)).otherwise(rows([(0, EMPTY_REPORT)]))))
    )
    return headings.unionByName(blocks)
