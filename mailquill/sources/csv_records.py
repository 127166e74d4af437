"""CSV files with line breaks in cells, read in many tasks however large a file is.

Whether a line break ends a record depends on the quotes before it, back to the beginning of the file. Each byte range that Spark
reads as lines counts its quotes, and its records under both assumptions, that it begins inside a quoted cell or outside. One
row for each range is then added up along the file, which settles the assumption and numbers the records of every range. Only
the lines of records that span several are brought together.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquill.operators.align import with_missing_columns

_COUNTED = "file string, block bigint, value string, quotes bigint, quotes_before bigint, even bigint, odd bigint, line bigint"


def _count_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running counts within each range: quotes before the line, and lines that begin after an even or an odd number of them."""
    last, totals = None, (0, 0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        quotes = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        out = np.empty((4, len(keys)), np.int64)
        for first, end in zip(edges, edges[1:]):
            if keys[first] != last:
                last, totals = keys[first], (0, 0, 0, 0)
            own = quotes[first:end]
            before = totals[0] + np.cumsum(own) - own
            begins_even = before % 2 == 0
            out[:, first:end] = before, totals[1] + np.cumsum(begins_even), totals[2] + np.cumsum(~begins_even), totals[3] + np.arange(end - first)
            totals = before[-1] + own[-1], out[1, end - 1], out[2, end - 1], totals[3] + end - first
        counts = [pa.array(row) for row in (quotes, *out)]
        names = ["file", "block", "value", "quotes", "quotes_before", "even", "odd", "line"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=names)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``record`` (number from 1) and ``text`` of every record, without the line break that ends it.

    Quotes inside a quoted cell are doubled, and a cell with a quote is quoted, as by the common rules of CSV. Blank lines between
    records are no records but keep their number.
    """
    raw = spark.read.text(path, lineSep="\n")
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # A range's lines come in their order, in one task.
    counted = lines.mapInArrow(_count_along, _COUNTED)
    blocks = counted.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max("even").alias("even"), F.max("odd").alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = blocks.withColumn("open", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    begun = F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("odd"))
    opened = opened.select("file", "block", "open", F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("records_before"))
    # One row for each byte range: the bound that makes this broadcast safe.
    placed = counted.join(F.broadcast(opened), ["file", "block"])
    before = (F.col("open") + F.col("quotes_before")) % 2
    record = F.col("records_before") + F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("odd"))
    placed = placed.select("file", "block", "line", "value", record.alias("record"), ((before == 0) & (F.col("quotes") % 2 == 0)).alias("whole"))
    single = placed.where("whole").select("file", "record", F.col("value").alias("text"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    spanning = placed.where("NOT whole").groupBy("file", "record").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("text"))
    return single.unionByName(spanning).select("file", "record", F.regexp_replace("text", r"\r\z", "").alias("text"))


def read_csv(spark: SparkSession, path: str, null_value: str) -> DataFrame:
    """Rows of CSV files with a header each, all columns as text, by the names in the file's own header.

    An empty cell is NULL, a quoted empty one is empty text. Files may have different columns or orders; what one lacks is NULL.
    """
    records = csv_records(spark, path)
    options = {"quote": '"', "escape": '"', "nullValue": null_value, "multiLine": "true", "mode": "PERMISSIVE"}
    first = records.groupBy("file").agg(F.min_by("text", "record").alias("text"), F.min("record").alias("record")).collect()  # one for each file
    headers: dict[tuple[str, ...], list[tuple[str, int]]] = {}
    for row in first:
        names = next(csv.reader(io.StringIO(row["text"], newline="")))
        headers.setdefault(tuple(names), []).append((row["file"], row["record"]))
    frames = []
    for names, files in headers.items():
        schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
        some = records.where(F.col("file").isin([file for file, _ in files])) if len(headers) > 1 else records
        place = F.struct("file", "record")
        some = some.where(~place.isin([F.struct(F.lit(file), F.lit(number).cast("bigint")) for file, number in files]))
        rows = some.where(F.col("text") != "").select(F.from_csv("text", schema, options).alias("row")).select("row.*")
        frames.append(rows if len(headers) == 1 else with_missing_columns(rows))
    return reduce(DataFrame.unionByName, frames)
