"""Alert mails: incremental scan and decoding of raw messages."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquill.functions.text import header_date
from mailquill.operators.ranking import number_rows
from mailquill.schema import DELIVERY_SCHEMA, MAIL_SCHEMA
from mailquill.sources.runs import Snapshot

DAY = 86400
#: Beside the mails, in a folder that Spark's readers of the mails pass over: one row for each delivery written to its end.
CLOSED = "_closed"


def write_mail(mail: DataFrame, path: str, arrival: int) -> str:
    """Append a delivery to a table partitioned by arrival, delivery and UTC day, so that a scan skips whole folders.

    ``arrival`` is any number, such as the second at which the delivery is written; several deliveries may share one. Each
    call is a delivery of its own, closed when all of it is written: runs read closed deliveries, each of them once, in
    whatever order they close. One that failed is never read and can be written again. Returns the delivery's name.

    Mails without a date are in the NULL day. Rows are rebalanced by day, so that a folder gets
    few files of a good size; adaptive execution splits a day that is too large for one task.
    """
    delivery = uuid.uuid4().hex
    day = F.floor(F.col("date") / DAY).cast("int")
    named = {"arrival": F.lit(arrival).cast("long"), "delivery": F.lit(delivery), "mail_day": day}
    dated = mail.withColumns(named).hint("rebalance", "mail_day")
    dated.write.mode("append").partitionBy("arrival", "delivery", "mail_day").parquet(path)
    close_delivery(mail.sparkSession, path, delivery, arrival)
    return delivery


def close_delivery(spark: SparkSession, path: str, delivery: str, arrival: int) -> None:
    spark.createDataFrame([(delivery, arrival)], DELIVERY_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{CLOSED}")


def closed_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """``delivery, arrival`` of the deliveries that are written to their end."""
    try:
        return spark.read.schema(DELIVERY_SCHEMA).parquet(f"{path}/{CLOSED}").distinct()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DELIVERY_SCHEMA)


def consumed_deliveries(spark: SparkSession, root: str, seen: Snapshot) -> DataFrame:
    """``delivery`` of all that the committed runs of a snapshot have read."""
    schema = T.StructType([DELIVERY_SCHEMA["delivery"], T.StructField("run_no", T.LongType())])
    try:
        consumed = spark.read.schema(schema).parquet(f"{root}/consumed")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        consumed = spark.createDataFrame([], schema)
    return consumed.where(F.col("run_no").isin([number for number, _ in seen.committed])).select("delivery")


def unread_deliveries(spark: SparkSession, root: str, seen: Snapshot) -> list[str]:
    """Closed deliveries below ``root/mail`` that no committed run has read: one name for each delivery, not for each mail."""
    closed = closed_deliveries(spark, f"{root}/mail").select("delivery")
    left = closed.join(consumed_deliveries(spark, root, seen), "delivery", "left_anti")
    return sorted(row["delivery"] for row in left.collect())


def write_consumed(spark: SparkSession, deliveries: list[str], root: str, run_no: int) -> None:
    schema = T.StructType([DELIVERY_SCHEMA["delivery"]])
    rows = spark.createDataFrame([(name,) for name in deliveries], schema).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{root}/consumed/run_no={run_no}")


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    folders = [T.StructField("arrival", T.LongType()), T.StructField("delivery", T.StringType()), T.StructField("mail_day", T.IntegerType())]
    return spark.read.schema(T.StructType([*MAIL_SCHEMA, *folders])).parquet(path)


def scan_mail(
    mail: DataFrame, sender: str, since: float | None = None, after: int | None = None, deliveries: list[str] | None = None
) -> DataFrame:
    """Mails of one sender that arrived later than ``after`` and are dated later than the whole second of ``since``.

    Either bound may be left out; a date bound of 0 is none. Undated mails pass every date bound. Senders are compared
    without case. With ``deliveries`` only mails of these count. The predicates reach the files: folders of other
    arrivals, deliveries and days are pruned, and the date is pushed to Parquet.
    """
    chosen = mail.where(F.lower("sender") == sender.lower())
    if deliveries is not None:
        chosen = chosen.where(F.col("delivery").isin(deliveries))
    if after is not None:
        chosen = chosen.where(F.col("arrival") > after)
    if since:
        bound = int(since)
        chosen = chosen.where(F.col("date").isNull() | (F.col("date") > F.lit(float(bound))))
        if "mail_day" in mail.columns:
            chosen = chosen.where(F.col("mail_day").isNull() | (F.col("mail_day") >= F.lit(bound // DAY)))
    return chosen.drop("mail_day", "delivery")


def newest_first(mail: DataFrame) -> DataFrame:
    """Mails with their place ``row_no`` in the order newest first, undated mails last."""
    return number_rows(mail, [F.col("date").desc_nulls_last(), F.col("id").asc()])


def _message_parts():
    """The function goes to the workers by value, so they need not have this package."""

    def parts(data: bytes | None) -> tuple[str | None, str, str | None, str]:
        import email
        from email.utils import parseaddr

        def clean(value):
            return value.encode("utf-8", "surrogateescape").decode("utf-8", "ignore")

        found = {"sender": None, "subject": "", "date_header": None}
        body = ""
        if data is None:
            return *found.values(), body
        message = email.message_from_bytes(bytes(data))
        for name, value in message.raw_items():
            field = {"from": "sender", "subject": "subject", "date": "date_header"}.get(name.lower())
            if field:
                found[field] = clean(str(value))
        if found["sender"] is not None:
            found["sender"] = parseaddr(found["sender"])[1].lower()
        for part in message.walk() if message.is_multipart() else [message]:
            attached = message.is_multipart() and "attachment" in str(part.get("Content-Disposition"))
            if part.get_content_type() == "text/html" and not attached:
                body = (part.get_payload(decode=True) or b"").decode("utf-8", "ignore")
                break
        return *found.values(), body

    return parts


def decode_mail(raw_mail: DataFrame) -> DataFrame:
    """``raw_mail(id, snippet, raw)`` with base64url messages to the columns of ``MAIL_SCHEMA``.

    The last subject counts. The body is the first HTML part that is not attached; bytes that are no UTF-8 are dropped.
    Only the walk through the MIME parts runs in Python, mail by mail over the one column it needs. It is no Arrow function:
    an Arrow batch holds as many whole mails as the session allows rows, 10,000 by default, and a worker each of its copies.
    A message that is no base64 gives a row without content, and a bad date gives NULL, so one bad mail never stops a run;
    ``decoding_problems`` counts both.
    """
    fields = "sender string, subject string, date_header string, body_html string"
    decode = F.udf(_message_parts(), fields, useArrow=False)
    data = F.try_to_binary(F.translate("raw", "-_", "+/"), F.lit("base64"))
    opened = raw_mail.select("id", "snippet", decode(data).alias("parts"))
    return opened.select(
        "id",
        F.col("parts.sender").alias("sender"),
        "snippet",
        F.col("parts.subject").alias("subject"),
        header_date(F.col("parts.date_header")).alias("date"),
        F.col("parts.body_html").alias("body_html"),
    )


def decoding_problems(raw_mail: DataFrame, mail: DataFrame) -> DataFrame:
    """``problem, n``: messages that are no base64, and decoded mails without a date."""
    data = F.try_to_binary(F.translate("raw", "-_", "+/"), F.lit("base64"))
    broken = raw_mail.agg(F.count_if(data.isNull()).alias("n")).select(F.lit("undecodable").alias("problem"), "n")
    return broken.unionAll(mail.agg(F.count_if(F.col("date").isNull()).alias("n")).select(F.lit("undated"), "n"))
