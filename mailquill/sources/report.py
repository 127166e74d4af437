"""Write a report as text files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_folder(base: str, moment: datetime) -> str:
    return f"{base}_{moment:%Y%m%d_%H%M%S}.md"


def write_report(
    document: DataFrame, folder: str, moment: datetime, base: str = "digest_report", rows_per_part: int = 100_000
) -> str:
    """Write ``document(section_no, row_no, block)`` as text parts; read in the order of their paths they are the report.

    A part's folder is named by the block of row numbers it holds, padded, so names sort at any count; a section's heading
    goes with its first row. Rows are dealt out by that name: large reports stay distributed, and nothing is sampled for a
    sort. A report of the same moment is replaced, so a repeated run leaves one.
    """
    path = f"{folder}/{report_folder(base, moment)}"
    rows = document.where("row_no > 0").groupBy("section_no").agg(F.min("row_no").alias("first"), F.max("row_no").alias("last"))
    found = sorted((row["section_no"], row["first"], row["last"]) for row in rows.collect())  # one per section
    place = F.lit(found[-1][2] if found else 0)
    for section, first, _ in reversed(found):
        place = F.when(F.col("section_no") <= section, first).otherwise(place)
    block = F.floor(F.when(F.col("row_no") > 0, F.col("row_no")).otherwise(place) / rows_per_part)
    (
        document.withColumn("part", F.format_string("%015d", block))
        .repartition("part")
        .sortWithinPartitions("part", "section_no", "row_no")
        .select("part", F.concat("block", F.lit("\n")).alias("value"))
        .write.mode("overwrite")
        .partitionBy("part")
        .text(path)
    )
    return path
