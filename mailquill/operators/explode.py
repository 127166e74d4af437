"""Alert mails to article rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquill.functions.markup import (
    ATTRIBUTES,
    attribute,
    cut_at,
    IN_ATTRIBUTE,
    decode_entities,
    has_class,
    hide_invisible,
    sibling_div,
    visible_text,
)

# The marks of an article in an alert mail.
TITLE_CLASS = "gse_alrt_title"
SUMMARY_CLASS = "gse_alrt_sni"

ANCHOR = rf"(?s)<[aA](?=[\s>/])({ATTRIBUTES})(?:>(.*?)(?:</[aA]\s*+>|\z)|\z)"


def explode_alerts(mail: DataFrame) -> DataFrame:
    """One row per article: ``email_id, email_date, position, title, link, summary``.

    An article is an ``h3`` heading with a title anchor; its summary is the first marked ``div`` beside the heading and
    before the next one. ``position`` is the number of the heading in its mail, from 0. Rows need a title and a link.

    A narrow map without shuffle. Each step is a named column, so later ones reuse it instead of parsing again, and the
    last check sits in the generator: as a filter it would be pushed below the projection and parse everything twice.
    """
    segments = mail.select(
        F.col("id").alias("email_id"),
        F.col("date").alias("email_date"),
        F.posexplode(cut_at(hide_invisible(F.col("body_html")), r"<[hH]3(?=[\s>/])")).alias("nth", "segment"),
    ).where((F.col("nth") > 0) & F.contains("segment", F.lit(TITLE_CLASS)))
    halves = segments.select(
        "email_id",
        "email_date",
        (F.col("nth") - 1).alias("position"),
        "segment",
        F.regexp_extract("segment", r"(?s)^.*?(?:</[hH]3\s*>|\z)", 0).alias("heading"),
    )
    anchors = halves.select(
        "email_id",
        "email_date",
        "position",
        F.col("segment").substr(F.length("heading") + F.lit(1), F.length("segment")).alias("beside"),
        F.get(
            F.filter(
                F.regexp_extract_all("heading", F.lit(ANCHOR), F.lit(0)),
                lambda tag: has_class(tag, "a", TITLE_CLASS),
            ),
            F.lit(0),
        ).alias("anchor"),
    )
    articles = anchors.select(
        "email_id",
        "email_date",
        "position",
        attribute(F.regexp_extract("anchor", ANCHOR, 1), "href").alias("href"),
        F.regexp_extract("anchor", ANCHOR, 2).alias("inside"),
        sibling_div(F.col("beside"), SUMMARY_CLASS).alias("below"),
    ).select(
        "email_id",
        "email_date",
        "position",
        visible_text(F.col("inside"), "").alias("title"),
        decode_entities(F.col("href"), IN_ATTRIBUTE).alias("link"),
        visible_text(F.col("below"), "").alias("summary"),
    )
    complete = F.filter(
        F.array(F.struct("title", "link", "summary")), lambda found: (found["title"] != "") & (found["link"] != "")
    )
    return articles.select("email_id", "email_date", "position", F.inline(complete))
