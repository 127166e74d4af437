"""SimHash near duplicates by meeting in the middle.

Two fingerprints that differ in up to three bits meet half-way: split the 64 bits into three blocks and leave out one that
holds a difference; at most two bits of the rest differ, so a variant exists within one bit of both. Every distinct
fingerprint emits, for each block left out, the rest and its 42 or 43 variants with one bit turned; rows are shuffled on
those variants and colliding pairs are verified. Emitting radius two on all 64 bits instead would take 2,081 variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquill.llm.common import fresh, row_place
from mailquill.llm.components import components
from mailquill.session import materialize

BLOCKS = ((0, 21), (21, 43), (43, 64))  # bits from, to
RADIUS = 3
SLICE = 1 << 16


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def simhash(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint; 0 for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and 0x20, 0x09-0x0D only
    if not words:
        return 0
    shingles = zip(*[islice(words, k, None) for k in range(shingle_words)])
    n = len(words) - shingle_words + 1
    if n < 1:
        shingles, n = iter([words]), 1
    ones, rest = np.zeros(64, np.int64), n
    while rest > 0:
        size = min(rest, SLICE)
        joined = map(b" ".join, islice(shingles, size))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), "<u8", size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        rest -= size
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle_words: int = 3, seed: int = 42) -> Column:
    """SimHash of a whole text as a signed long. NULL counts as empty."""

    @F.pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([simhash(x, shingle_words, seed) for x in batch], dtype="int64")

    return hashed(text)


def _variants(fp: Column) -> Column:
    """Array of (variant, left-out bits). The number of the block fills its place in the variant."""
    out = []
    for number, (low, high) in enumerate(BLOCKS):
        block = ((1 << (high - low)) - 1) << low
        rest = fp.bitwiseAND(F.lit(signed(~block & (2**64 - 1)))).bitwiseOR(F.lit(signed((number + 1) << low)))
        left_out = fp.bitwiseAND(F.lit(signed(block)))
        turned = [0] + [1 << bit for bit in range(64) if not low <= bit < high]
        out += [F.struct(rest.bitwiseXOR(F.lit(signed(bit))).alias("variant"), left_out.alias("left_out")) for bit in turned]
    return F.array(*out)


def near_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` that join all ``fp`` within ``radius`` bits, directly or through other links, and no others.

    ``fingerprints`` holds distinct values of ``fp``. No pair inside a dense group is written: fingerprints that share a
    variant and the bits left out differ by two at most and are linked to the smallest of them; only pairs of variants'
    members that are still in different components are compared one by one.
    """
    if not 2 <= radius <= 3:
        raise ValueError("variants within one bit meet for a radius of 2 or 3")
    # Few bytes become many rows, so tasks are dealt out by number; the joins' smaller sides have no bound, so all are merge joins.
    tasks = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted = fingerprints.repartition(tasks, "fp").select("fp", F.explode(_variants(F.col("fp"))).alias("v")).select("fp", "v.variant", "v.left_out")
    shared = emitted.groupBy("variant").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    shared = materialize(shared.select("variant"), "shared")
    met = materialize(emitted.join(shared.hint("merge"), "variant"), "met")

    hubs = met.groupBy("variant", "left_out").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub < top")
    stars = met.join(hubs.hint("merge"), ["variant", "left_out"]).where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    stars = materialize(stars.distinct(), "stars")

    joined = materialize(components(stars), "stars-joined")
    placed = met.join(joined, met["fp"] == joined["node"], "left").select(
        "variant", "fp", F.coalesce("component", "fp").alias("component")
    )
    placed = materialize(placed, "placed")
    open_ = placed.groupBy("variant").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = materialize(open_.where("low < high").select("variant"), "open")
    rest = materialize(placed.join(open_.hint("merge"), "variant").distinct(), "compare")
    other = rest.select("variant", F.col("fp").alias("fp_b"), F.col("component").alias("component_b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= radius
    pairs = rest.join(other.hint("merge"), "variant").where((F.col("component") < F.col("component_b")) & near)
    return stars.unionAll(pairs.select(F.col("fp").alias("a"), F.col("fp_b").alias("b")).distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = RADIUS
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest reachable id).

    NULL texts count as empty; all texts without a word share fingerprint zero and link like others. Exact copies share a
    fingerprint and are one node. A NULL id belongs to its component and is never the smallest unless it has only such.
    Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle_words).alias("fp"))
    rows = materialize(rows, "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    labelled = _labelled(nodes, radius)
    first = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = materialize(labelled.join(first, "component").select("fp", "component_id"), "component-ids")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(ids.hint("merge"), "fp").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def _labelled(nodes: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``first`` and ``component`` of the distinct fingerprints ``nodes``."""
    found = components(near_links(nodes.select("fp"), radius))
    joined = nodes.join(found, nodes["fp"] == found["node"], "left")
    return materialize(joined.select("fp", "first", F.coalesce("component", "fp").alias("component")), "labelled")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = RADIUS
) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``; columns as before.

    It is the one with the smallest id (NULL last), then by hash of id and text, and of rows that repeat both any one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = docs.select(F.col(id_col).alias("id"), row_place(F.col(id_col), text).alias("place"), fingerprint(text, shingle_words).alias("fp"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "place")
    nodes = materialize(prints.groupBy("fp").agg(F.min(order).alias("first")), "nodes")
    place, no = fresh(docs, "row_place"), fresh(docs, "row_no")
    first = _labelled(nodes, radius).groupBy("component").agg(F.min("first").alias("first"))
    kept = materialize(first.select(F.col("first.place").alias(place)), "kept")
    marked = docs.withColumn(place, row_place(F.col(id_col), text))
    # Planned with a group limit below the shuffle: a task sends one row of those that repeat id and text.
    single = marked.withColumn(no, F.row_number().over(Window.partitionBy(place).orderBy(place))).where(F.col(no) == 1)
    return single.join(kept.hint("merge"), place, "left_semi").select(docs.columns)
