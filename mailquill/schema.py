"""Explicit schemas: nothing in this package is inferred from data."""

from pyspark.sql import types as T

MAIL_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("date", T.DoubleType()),
        T.StructField("body_html", T.StringType()),
    ]
)

# The ten stored columns, in their stored order.
ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("email_id", T.StringType()),
        T.StructField("email_date", T.DoubleType()),
        T.StructField("score", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("full_text_summary", T.StringType()),
        T.StructField("added_at", T.StringType()),
    ]
)

STATE_SCHEMA = T.StructType(
    [
        T.StructField("run_no", T.LongType()),
        T.StructField("last_run", T.DoubleType()),
        T.StructField("last_arrival", T.LongType()),
    ]
)

# A row of the run log: the state after the run, and what kind of run it was. ``replaces`` names the runs that a compaction took in.
LOG_SCHEMA = T.StructType(
    [
        *STATE_SCHEMA,
        T.StructField("kind", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("replaces", T.ArrayType(T.LongType())),
        T.StructField("buckets", T.IntegerType()),
    ]
)

DELIVERY_SCHEMA = T.StructType([T.StructField("delivery", T.StringType()), T.StructField("arrival", T.LongType())])
