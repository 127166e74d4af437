import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mailquill.functions.text import readable, report_snippet, snippet
from mailquill.operators.enrich import enrich_from_pages, enrichment_candidates, page_texts
from mailquill.operators.ranking import number_rows
from mailquill.operators.report import (
    articles_for_report,
    number_report,
    order_report,
    report_block,
    report_document,
    tier_filter,
)
from mailquill.schema import ARTICLE_SCHEMA
from mailquill.session import shared_folder
from mailquill.sources.report import write_report


def article(key, score, date, summary="S", text=None):
    return (key, f"T {key}", f"l/{key}", summary, "e", date, score, "why", text, "now")


SAMPLE = [
    article("h1", "High", 1000.0, text="Snippet 1"),
    article("h2", "Medium", 900.0),
    article("h3", "Low", 800.0),
    article("h4", "High", 950.0, summary=""),
    article("h5", "Medium", 850.0, text=""),
    article("h6", "Medium", None),
    article("h7", "Error", 2000.0),
    article("h8", None, 2000.0),
]


@pytest.fixture
def stored(spark):
    return spark.createDataFrame(SAMPLE, ARTICLE_SCHEMA)


def test_order(spark, stored):
    ordered = [row.hash for row in order_report(articles_for_report(stored)).collect()]
    assert ordered == ["h1", "h4", "h2", "h5", "h6"]
    numbered = number_report(stored).orderBy("row_no").collect()
    assert [(row.hash, row.rank) for row in numbered] == [
        ("h1", 1), ("h4", 1), ("h2", 2), ("h5", 2), ("h6", 2), ("h3", 3), ("h7", None), ("h8", None),
    ]
    assert [row.row_no for row in numbered] == list(range(1, 9))


def test_filters(spark, stored):
    wanted = spark.createDataFrame([("h1",), ("h3",), ("h5",)], "hash string")
    assert {row.hash for row in articles_for_report(stored, wanted).collect()} == {"h1", "h5"}
    assert tier_filter(stored.drop("score")).count() == 8
    assert {row.hash for row in tier_filter(stored, "Low", "Error").collect()} == {"h3", "h7"}
    assert {row.hash for row in enrichment_candidates(stored).collect()} == {"h2", "h4", "h6"}
    assert enrichment_candidates(stored.drop("full_text_summary")).count() == 5


def test_block(spark, stored):
    blocks = {row.hash: row.block for row in stored.select("hash", report_block().alias("block")).collect()}
    assert blocks["h1"] == (
        "### [T h1](l/h1)\n- **Score**: High\n- **Reason**: why\n- **Scholar Summary**: S\n"
        "- **Full Text Snippet**: Snippet 1\n- **Email Date**: 1970-01-01 00:16"
    )
    assert blocks["h4"] == (
        "### [T h4](l/h4)\n- **Score**: High\n- **Reason**: why\n- **Email Date**: 1970-01-01 00:15"
    )
    assert blocks["h6"].endswith("- **Scholar Summary**: S\n- **Email Date**: N/A")


def test_document_and_files(spark, stored):
    document = report_document(number_report(articles_for_report(stored)), "2024-03-01", "2024-03-01 08:30:00")
    rows = document.orderBy("section_no", "row_no").collect()
    assert [(row.section_no, row.row_no) for row in rows] == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 3), (2, 4), (2, 5), (3, 0)]
    folder = shared_folder(spark, "reports")
    path = write_report(document, folder, datetime(2024, 3, 1, 8, 30, 5))
    assert path == f"{folder}/digest_report_20240301_083005.md"
    text = "".join(part.read_text() for part in sorted(Path(path).glob("part=*/part-*")))
    small = write_report(document, folder, datetime(2024, 3, 2), rows_per_part=2)
    parts = sorted(Path(small).glob("part=*/part-*"))
    assert len(parts) == 3 and "".join(part.read_text() for part in parts) == text
    assert write_report(document, folder, datetime(2024, 3, 2)) == small and len(list(Path(small).glob("part=*"))) == 1
    assert text == "\n\n".join(row.block for row in rows) + "\n\n"
    assert text.startswith("# Digest Report - 2024-03-01\n\n## High Relevance\n\n### [T h1]")


def test_empty_document(spark, stored):
    document = report_document(number_report(stored.where("false")), "d", "t")
    assert [tuple(row) for row in document.collect()] == [(0, 0, "No articles to report.")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a\nb", "a b"),
        ("x" * 255, "x" * 255),
        ("x" * 256, "x" * 247 + "..."),
        ("w " * 200, ("w " * 200)[:247].rsplit(" ", 1)[0] + "..."),
        ("é " * 200, ("é " * 200)[:247].rsplit(" ", 1)[0] + "..."),
        (None, None),
    ],
)
def test_report_snippet(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(report_snippet(F.col("t"))).first()[0] == expected


def test_scalars(spark):
    frame = spark.createDataFrame([("\U0001f600" * 1001, 1704067260.9), ("a" * 1000, None)], "t string, d double")
    rows = frame.select(snippet(F.col("t")), readable(F.col("d"))).collect()
    assert tuple(rows[0]) == ("\U0001f600" * 1000 + "...", "2024-01-01 00:01")
    assert tuple(rows[1]) == ("a" * 1000, "N/A")


def test_numbering_against_brute_force(spark):
    random.seed(5)
    rows = [(random.choice([None, 1.0, 1.0, 2.0, random.random()]), f"k{at:04d}") for at in range(3000)]
    frame = spark.createDataFrame(rows, "v double, k string").repartition(7)
    numbered = number_rows(frame, [F.col("v").desc_nulls_last(), F.col("k").asc()]).collect()
    expected = sorted(rows, key=lambda row: (row[0] is None, -(row[0] or 0), row[1]))
    assert [(row.v, row.k) for row in sorted(numbered, key=lambda row: row.row_no)] == expected
    assert sorted(row.row_no for row in numbered) == list(range(1, 3001))


def test_numbering_many_range_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
        numbered = number_rows(frame, [F.col("v").asc()]).collect()
        assert sorted((row.v, row.row_no) for row in numbered) == [(at, at + 1) for at in range(1000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


PAGES = [
    (1, "l/old", "<body><article>old</article></body>", None),
    (2, "l/old", "<body><article>new</article></body>", None),
    (3, "l/empty", "<body></body>", None),
    (4, "l/failed", "", "E" * 150),
    (5, "l/long", "<article>" + "y" * 1500 + "</article>", None),
    (6, "l/unused", "<article>z</article>", None),
]


def test_enrichment(spark):
    links = ["l/old", "l/empty", "l/failed", "l/long", "l/missing", None, None]
    rows = [(f"h{at}", "T", link, "", "e", 1.0, "High", "", None, "") for at, link in enumerate(links)]
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, error string")
    enriched = enrich_from_pages(spark.createDataFrame(rows, ARTICLE_SCHEMA), pages)
    assert enriched.columns == ARTICLE_SCHEMA.names
    assert {row.hash: row.full_text_summary for row in enriched.collect()} == {
        "h0": "new",
        "h1": "Could not retrieve full text.",
        "h2": "Error retrieving full text: " + "E" * 100,
        "h3": "y" * 1000 + "...",
        "h4": "Could not retrieve full text.",
        "h5": None,
        "h6": None,
    }


SKEW_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@pytest.fixture
def shuffled_joins(spark):
    """No broadcasts, and thresholds at which test data counts as skewed."""
    before = {name: spark.conf.get(name, None) for name in SKEW_SETTINGS}
    for name, value in SKEW_SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_shared_link_and_missing_links_are_split(spark, shuffled_joins):
    """A third of the rows share one link and a third have none. No row may be lost, and the join must be split."""
    link = F.when(F.col("id") % 3 == 0, "l/old").when(F.col("id") % 3 == 1, F.concat(F.lit("x/"), "id"))
    rows = (
        spark.range(90000)
        .repartition(8)
        .select(
            F.sha2(F.col("id").cast("string"), 256).alias("hash"),
            link.alias("link"),
            F.lit(None).cast("string").alias("full_text_summary"),
        )
    )
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, error string")
    enriched = enrich_from_pages(rows, pages)
    found = enriched.collect()
    counts = {}
    for row in found:
        counts[row.full_text_summary] = counts.get(row.full_text_summary, 0) + 1
    assert counts == {"new": 30000, "Could not retrieve full text.": 30000, None: 30000}
    plan = enriched._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan


def test_page_crawled_very_often(spark, shuffled_joins):
    """A third of all pages are copies of one URL: they meet in no join and no aggregate row by row."""
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p/"), "id")).alias("url"),
        F.concat(F.lit("<article>"), "id", F.lit("</article>")).alias("html"),
    )
    rows = spark.createDataFrame([("a", "hot", None), ("b", "p/1", None)], "hash string, link string, full_text_summary string")
    texts = page_texts(pages, rows)
    assert {tuple(row) for row in texts.collect()} == {("hot", "2997"), ("p/1", "1")}
    plan = page_texts(pages, rows)._jdf.queryExecution().executedPlan().toString()
    pages_shuffle = plan[: plan.index("AS html")].rsplit("Exchange", 1)[1].splitlines()[0]
    assert "hashpartitioning(url" in pages_shuffle and "page_id" in pages_shuffle
