import base64

import pytest
from pyspark.sql import functions as F

from mailquill.functions.text import header_date, since_bound
from mailquill.schema import MAIL_SCHEMA, STATE_SCHEMA
from mailquill.sources import mail as mail_source
from mailquill.sources import state as run_state
from mailquill.session import shared_folder


def coded(message: bytes) -> str:
    return base64.urlsafe_b64encode(message).decode()


def decoded(spark, message: bytes):
    raw = spark.createDataFrame([("m", "snip", coded(message))], "id string, snippet string, raw string")
    return mail_source.decode_mail(raw).first()


HEAD = b"From: Alerts <Alerts@Example.org>\r\nSubject: s\r\nDate: Mon, 1 Jan 2024 00:00:10 +0000\r\n"
ALTERNATIVE = HEAD + b'Content-Type: multipart/mixed; boundary="x"\r\n\r\n'


def test_single_html_part(spark):
    row = decoded(spark, HEAD + b"Content-Type: text/html\r\n\r\n<p>hi</p>")
    assert (row.id, row.sender, row.snippet, row.subject, row.date, row.body_html) == (
        "m", "alerts@example.org", "snip", "s", 1704067210.0, "<p>hi</p>",
    )


def test_single_text_part_has_no_body(spark):
    assert decoded(spark, HEAD + b"Content-Type: text/plain\r\n\r\nhi").body_html == ""


def test_first_html_part_counts(spark):
    parts = (
        b"--x\r\nContent-Type: text/plain\r\n\r\nplain\r\n"
        b"--x\r\nContent-Type: text/html\r\nContent-Disposition: attachment; filename=a.html\r\n\r\nattached\r\n"
        b"--x\r\nContent-Type: text/html\r\n\r\nfirst\r\n--x\r\nContent-Type: text/html\r\n\r\nsecond\r\n--x--"
    )
    assert decoded(spark, ALTERNATIVE + parts).body_html == "first"


def test_attached_html_only(spark):
    part = b"--x\r\nContent-Type: text/html\r\nContent-Disposition: attachment\r\n\r\nattached\r\n--x--"
    assert decoded(spark, ALTERNATIVE + part).body_html == ""


def test_transfer_encoding_and_bad_bytes(spark):
    quoted = HEAD + b"Content-Type: text/html\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nCaf=C3=A9=\r\n!=FF"
    assert decoded(spark, quoted).body_html == "Café!"
    latin = HEAD + b"Content-Type: text/html; charset=latin-1\r\nContent-Transfer-Encoding: 8bit\r\n\r\na\xe9b"
    assert decoded(spark, latin).body_html == "ab"


def test_whole_mails_do_not_go_to_python_in_arrow_batches(spark, capsys):
    """An Arrow batch holds 10,000 rows by default, whatever their size."""
    raw = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("").alias("snippet"), F.lit(coded(HEAD + b"\r\nx")).alias("raw"))
    mails = mail_source.decode_mail(raw)
    mails.explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out
    assert mails.count() == 3


def test_last_subject_counts(spark):
    assert decoded(spark, b"SUBJECT: one\r\n" + HEAD + b"subject: two\r\n\r\n").subject == "two"


def test_broken_messages_stay_as_rows(spark):
    raw = spark.createDataFrame(
        [("bad", "", "%%%"), ("null", "", None), ("plain", "", coded(b"Date: soon\r\n\r\nx").rstrip("="))],
        "id string, snippet string, raw string",
    )
    rows = {row.id: row for row in mail_source.decode_mail(raw).collect()}
    assert set(rows) == {"bad", "null", "plain"}
    assert all(row.body_html == "" and row.date is None for row in rows.values())


@pytest.mark.parametrize(
    "header, expected",
    [
        ("Mon, 1 Jan 2024 00:00:10 +0000", 1704067210.0),
        ("Mon, 01 Jan 2024 02:00:10 +0200 (CEST)", 1704067210.0),
        ("  mon, 01 jan 2024 02:00:10 +02:00 ", 1704067210.0),
        ("Mon,\r\n 1 Jan 2024 00:00:10 -0130", 1704072610.0),
        ("1 Jan 2024 00:00:10 +0000", None),
        ("Mon, 1 Jan 2024 00:00:10 GMT", 1704067210.0),
        ("Mon, 1 Jan 2024 00:00:10 Z", 1704067210.0),
        ("Mon, 1 Jan 2024 00:00:10 UT", 1704067210.0),
        ("Mon, 1 Jan 2024 00:00:10 EST", None),
        ("Mon, 31 Feb 2024 00:00:10 +0000", None),
        ("soon", None),
        (None, None),
    ],
)
def test_header_date(spark, header, expected):
    frame = spark.createDataFrame([(header,)], "h string")
    assert frame.select(header_date(F.col("h"))).first()[0] == expected


@pytest.mark.parametrize(
    "typed, expected",
    [
        ("1696140000", 1696140000.0),
        (" 1.5e3 ", 1500.0),
        ("-2.5", -2.5),
        ("2023-10-01", 1696118400.0),
        ("2023-10-01T10:00:00", 1696154400.0),
        ("2023-10-01 10:00:00.25", 1696154400.25),
        ("2023-10-01T10:00:00+02:00", 1696147200.0),
        ("2023-10-01T10:00Z", 1696154400.0),
        ("2023-13-01", None),
        ("2023-1-1", None),
        ("1d", None),
        ("NaN", None),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_since_bound(spark, typed, expected):
    frame = spark.createDataFrame([(typed,)], "t string")
    assert frame.select(since_bound(F.col("t"))).first()[0] == expected


MAILS = [
    ("a", "x@e", "", "", 100.0, ""),
    ("b", "x@e", "", "", 100.9, ""),
    ("c", "x@e", "", "", 86500.0, ""),
    ("d", "y@e", "", "", 86500.0, ""),
    ("e", "x@e", "", "", None, ""),
]


def test_scan_bound_and_pushdown(spark):
    path = shared_folder(spark, "mail")
    mail_source.write_mail(spark.createDataFrame(MAILS, MAIL_SCHEMA), path, 5)
    mail = mail_source.read_mail(spark, path)
    ids = lambda frame: sorted(row.id for row in frame.collect())
    assert ids(mail_source.scan_mail(mail, "x@e")) == ["a", "b", "c", "e"]
    assert ids(mail_source.scan_mail(mail, "x@e", 0)) == ["a", "b", "c", "e"]
    assert ids(mail_source.scan_mail(mail, "X@E", 100.95)) == ["b", "c", "e"]
    late = mail_source.scan_mail(mail, "x@e", 86400.5).select("id")
    assert ids(late) == ["c", "e"]
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(date,86400.0)" in plan and "mail_day" in plan.split("PartitionFilters")[1][:120]
    assert "body_html" not in plan
    old = ("old", "X@e", "", "", 50.0, "")
    mail_source.write_mail(spark.createDataFrame([old, ("none", "x@e", "", "", None, "")], MAIL_SCHEMA), path, 6)
    mail = mail_source.read_mail(spark, path)
    arrived = mail_source.scan_mail(mail, "x@e", after=5)
    assert ids(arrived) == ["none", "old"]
    assert "arrival" in arrived._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]
    assert ids(mail_source.scan_mail(mail, "x@e", after=6)) == []


def test_decoding_problems(spark):
    good = base64.urlsafe_b64encode(b"From: a@b\nDate: never\n\nx").decode()
    raw = spark.createDataFrame([("1", "", good), ("2", "", "%%%"), ("3", "", None)], "id string, snippet string, raw string")
    found = mail_source.decoding_problems(raw, mail_source.decode_mail(raw))
    assert {row.problem: row.n for row in found.collect()} == {"undecodable": 2, "undated": 3}


def test_newest_first(spark):
    rows = mail_source.newest_first(spark.createDataFrame(MAILS, MAIL_SCHEMA)).orderBy("row_no").collect()
    assert [(row.row_no, row.id) for row in rows] == [(1, "c"), (2, "d"), (3, "b"), (4, "a"), (5, "e")]


def test_state(spark):
    path = shared_folder(spark, "state")
    mail = spark.createDataFrame(MAILS, MAIL_SCHEMA).withColumn("arrival", F.lit(5).cast("long"))
    nothing = mail.where("false")
    assert tuple(run_state.read_state(spark, path).first()) == (None, None, None)
    run_state.write_state(run_state.advance_watermark(mail, run_state.read_state(spark, path)), path)
    assert tuple(run_state.read_state(spark, path).first()) == (1, 86500.0, 5)
    run_state.write_state(run_state.advance_watermark(nothing, run_state.read_state(spark, path)), path)
    assert tuple(run_state.read_state(spark, path).first()) == (2, 86500.0, 5)
    run_state.write_state(run_state.set_watermark(run_state.read_state(spark, path), 7), path)
    assert tuple(run_state.read_state(spark, path).first()) == (3, 7.0, None)
    empty = spark.createDataFrame([(1, None, None)], STATE_SCHEMA)
    assert run_state.advance_watermark(nothing, empty).first().last_run is None
