"""Scalar expressions over titles, summaries and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths and fillers of the printed report.
PAGE_TEXT_LIMIT = 1000
REPORT_TEXT_LIMIT = 250
REPORT_TEXT_LEEWAY = 5
NO_DATE = "N/A"


def title_hash(title: Column) -> Column:
    """Article key: SHA-256 of the lower-cased title, in hex. The title is not trimmed."""
    return F.sha2(F.lower(title), 256)


def score_text(title: Column, summary: Column) -> Column:
    empty = F.lit("")
    return F.lower(F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(summary, empty)))


def snippet(text: Column, limit: int = PAGE_TEXT_LIMIT) -> Column:
    """The first ``limit`` characters and ``...`` where the text is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def report_snippet(text: Column, limit: int = REPORT_TEXT_LIMIT) -> Column:
    """One line, cut back to a whole word. Text up to ``limit`` plus a small leeway stays whole."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    head = F.regexp_replace(F.substring(line, 1, limit - 3), r" [^ ]*\z", "")
    return F.when(F.length(line) <= limit + REPORT_TEXT_LEEWAY, line).otherwise(F.concat(head, F.lit("...")))


def readable(epoch: Column) -> Column:
    """Epoch seconds to ``yyyy-MM-dd HH:mm`` in the session zone."""
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"), F.lit(NO_DATE))


def epoch_seconds(moment: Column, kind: str) -> Column:
    """Timestamps to float seconds; numbers are only widened. ``kind`` is the type name from the schema."""
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(moment.cast("timestamp")) / F.lit(1e6)
    return moment.cast("double")


def since_bound(text: Column) -> Column:
    """A start bound typed by a user: float seconds, else an ISO date or date-time; NULL means rejected."""
    value = F.trim(text)
    is_number = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    shape = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2}(?:[.,]\d{1,6})?))?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    day, hour, minute, second, zone = (F.regexp_extract(value, shape, group) for group in range(1, 6))

    def given(part: Column) -> Column:
        return F.when(part == "", "00").otherwise(F.replace(part, F.lit(","), F.lit(".")))

    clock = F.concat_ws(":", given(hour), given(minute), given(second))
    moment = F.unix_micros(F.concat(day, F.lit("T"), clock, zone).try_cast("timestamp")) / F.lit(1e6)
    return F.when(is_number, value.try_cast("double")).when(value.rlike(shape), moment)


def header_date(header: Column) -> Column:
    """Mail ``Date`` header to epoch seconds; ``Z``, ``GMT`` and ``UT`` are zone zero.

    A bad or missing date is NULL and the mail is kept.
    """
    plain = F.trim(F.regexp_replace(F.split_part(header, F.lit(" ("), F.lit(1)), r"\s+", " "))
    # Spark has no weekday letter for parsing, so the name is checked and left out.
    shape = (
        r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun), "
        r"(\d{1,2} [a-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2}) (?:([+-]\d{2}):?(\d{2})|Z|GMT|UT)$"
    )
    parts = [F.regexp_extract(plain, shape, group) for group in (1, 2, 3)]
    zone = F.coalesce(F.nullif(F.concat(parts[1], parts[2]), F.lit("")), F.lit("+0000"))
    normal = F.concat(parts[0], F.lit(" "), zone)
    return F.unix_timestamp(F.try_to_timestamp(normal, F.lit("d MMM yyyy H:m:s Z"))).cast("double")
