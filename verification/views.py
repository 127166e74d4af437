"""Alert mails, stores and updates derived from the whole test tables by Spark.

``articles`` makes one article of each document: its first line is the title, all other lines the summary. Articles of
one language and twenty neighbouring ids share a mail. ``labels`` tells which articles are stored already.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquill.functions.scoring import WordRules
from mailquill.operators.align import schema_align, with_hash
from mailquill.operators.dedup import dedup_first, newest_mail_first
from mailquill.session import materialize

SENDER = "alerts@example.org"
OTHER_SENDER = "newsletter@example.org"
STORED_AT = "2024-02-01T00:00:00"
RUN_TIME = "2024-03-01 08:30:00"
SINCE = 1704070800.75
RULES = WordRules(high=("Nicht", "attion", "pour"), medium=("thanedble", "eren"), low=("anly", "mentoi"))
EXCLUDE = ("Erhe", "avec", "sich")


_written: dict[tuple[str, str, str], DataFrame] | None = None


def keep_written() -> None:
    """From now on each view is written once and read from its files, so that timings leave out how it is made."""
    global _written
    _written = {}


def kept(make):
    @wraps(make)
    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _written is None:
            return make(spark, sf_dir)
        key = spark.sparkContext.applicationId, sf_dir, make.__name__
        if key not in _written:
            _written[key] = materialize(make(spark, sf_dir), make.__name__)
        return _written[key]

    return view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mail_group(id_col: str):
    """Articles of neighbouring ids share a mail."""
    return F.floor(F.col(id_col) / 20)


def beside(rows: DataFrame, narrow: DataFrame, id_col: str, how: str) -> DataFrame:
    """``rows`` joined with a narrow table on ``doc_id = id_col``, by their ``mail_group``: what is dealt by group stays there.

    The narrow rows of a group come as one array, from which each row takes those of its id.
    """
    columns = [name for name in narrow.columns if name != id_col]
    groups = narrow.where(F.col(id_col).isNotNull()).groupBy(mail_group(id_col).alias("mail_group")).agg(F.collect_list(F.struct(*narrow.columns)).alias("_all"))
    joined = rows.join(groups, "mail_group", how)
    own = F.filter("_all", lambda one: one[id_col] == F.col("doc_id"))
    explode = F.explode_outer if how == "left" else F.explode
    found = joined.select(*rows.columns, explode(own).alias("_own"))
    return found.select(*rows.columns, *[F.col(f"_own.{name}").alias(name) for name in columns])


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``articles`` with their ``mail_group``. Whole texts are shuffled once, by the group; pages come to them, and so do mails."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    lines = F.split("text", "\n")
    own_link = F.concat(
        F.lit("https://example.org/doc/"),
        F.col("doc_id").cast("string"),
        F.lit("?src="),
        F.col("source"),
        F.lit("&lang="),
        F.col("lang"),
    )
    place = Window.partitionBy("lang", "mail_group").orderBy("doc_id")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", mail_group("doc_id").alias("mail_group"))
    return (
        beside(documents, pages, "page_id", "left")
        .select(
            "doc_id",
            "lang",
            "mail_group",
            F.concat(F.lit("e-"), F.col("lang"), F.lit("-"), F.col("mail_group").cast("string")).alias("email_id"),
            (F.lit(1704067200) + F.col("mail_group") * 3600).cast("double").alias("email_date"),
            (F.row_number().over(place) - 1).alias("position"),
            F.trim(lines[0]).alias("title"),
            F.coalesce("url", own_link).alias("link"),
            F.transform(F.slice(lines, 2, F.size(lines)), lambda line: F.trim(line)).alias("parts"),
        )
        .withColumn("summary", F.array_join("parts", ""))
    )


@kept
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).drop("mail_group")


@kept
def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hash(articles(spark, sf_dir))


def with_labels(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    known = beside(placed(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id", how)
    return with_hash(known.drop("mail_group"))


@kept
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with labels, first of each title, labels alongside."""
    known = with_labels(spark, sf_dir, "inner")
    return dedup_first(known, "hash", newest_mail_first())


@kept
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles, first of each title, with NULLs where there is no label."""
    known = with_labels(spark, sf_dir, "left")
    return dedup_first(known, "hash", newest_mail_first())


@kept
def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the articles that counts as stored before."""
    return schema_align(labelled(spark, sf_dir), STORED_AT)


@kept
def whole_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_align(judged(spark, sf_dir), STORED_AT)


def label_score():
    tier = F.when(F.col("toxic") == 1, "Low").when(F.col("quality") == 1, "High")
    return tier.when(F.col("quality") == 0, "Medium")


@kept
def scored_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = judged(spark, sf_dir).withColumns(
        {
            "score": label_score(),
            "reason": F.when(F.col("quality").isNotNull(), F.concat(F.lit("label of "), F.col("doc_id").cast("string"))),
            "full_text_summary": F.when(F.col("quality") == 1, F.col("summary")),
        }
    )
    return schema_align(scored, STORED_AT)


@kept
def half_scored_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store with older scores for the toxic labels only."""
    scored = judged(spark, sf_dir).withColumns(
        {"score": F.when(F.col("toxic") == 1, "Medium"), "reason": F.when(F.col("toxic") == 1, "old")}
    )
    return schema_align(scored, STORED_AT)


@kept
def score_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates by hash; rows with quality 0 carry NULLs that must not replace anything."""
    return judged(spark, sf_dir).select(
        "hash",
        F.when(F.col("quality") == 1, label_score()).alias("score"),
        F.when(F.col("quality") == 1, F.concat(F.lit("label of "), F.col("doc_id").cast("string"))).alias("reason"),
    )


def escaped(text):
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


@kept
def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert mails of at most twenty articles. Each begins with an empty heading and one inside a comment."""
    summary = F.array_join(F.transform("parts", escaped), "<br>")
    block = F.concat(
        F.lit('\n<h3 style="font-weight:normal">\n<span>[HTML]</span> <a href="'),
        escaped(F.col("link")),
        F.lit('" class="big gse_alrt_title" style="font-size:17px">\n'),
        escaped(F.col("title")),
        F.lit('\n</a></h3>\n<div style="color:#006621">A Author, 2024</div><DIV class=\'gse_alrt_sni\'>\n'),
        summary,
        F.lit("\n<!-- end --></DIV><br>"),
    )
    return (
        placed(spark, sf_dir)
        .groupBy("lang", "mail_group", "email_id", "email_date")
        .agg(F.array_sort(F.collect_list(F.struct("position", block.alias("block")))).alias("blocks"))
        .select(
            F.col("email_id").alias("id"),
            F.when(F.col("lang") == "es", OTHER_SENDER).otherwise(SENDER).alias("sender"),
            F.concat(F.lit("New articles "), F.col("lang")).alias("snippet"),
            F.concat(F.lit("Alert "), F.col("email_id")).alias("subject"),
            F.col("email_date").alias("date"),
            F.concat(
                F.lit("<html><style>.gse_alrt_title{color:red}</style><body><h3></h3><!-- <h3>off</h3> --><h3>News</h3>"),
                F.array_join(F.transform("blocks", lambda b: b["block"]), ""),
                F.lit("</body></html>"),
            ).alias("body_html"),
        )
    )


@kept
def raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mail`` as base64url messages: two subjects, a zone two hours ahead, a text part and an encoded HTML part."""
    line = "\r\n"
    message = F.concat(
        F.lit("From: Alert Service <"),
        F.col("sender"),
        F.lit(f">{line}Subject: first{line}Subject: "),
        F.col("subject"),
        F.lit(f"{line}Date: "),
        F.date_format(F.timestamp_seconds(F.col("date") + 7200), "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit(f' +0200 (CEST){line}MIME-Version: 1.0{line}Content-Type: multipart/alternative; boundary="cut"{line}{line}'),
        F.lit(f"--cut{line}Content-Type: text/plain; charset=utf-8{line}{line}plain{line}"),
        F.lit(f"--cut{line}Content-Type: text/html; charset=utf-8{line}Content-Transfer-Encoding: base64{line}{line}"),
        F.base64(F.encode("body_html", "UTF-8")),
        F.lit(f"{line}--cut--{line}"),
    )
    coded = F.translate(F.base64(F.encode(message, "UTF-8")), "+/\r\n", "-_")
    return mail(spark, sf_dir).select("id", "snippet", coded.alias("raw"))


@kept
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies per label: some fenced, some without a field, some cut off, some no JSON."""
    quality, toxic = F.col("quality"), F.col("toxic")
    score = F.concat(F.lit('{"score": "'), label_score(), F.lit('"'))
    reason = F.concat(F.lit('"reason": "label of '), F.col("doc_id").cast("string"))
    whole = F.concat(score, F.lit(", "), reason, F.lit('"}'))
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
        .select(
            "doc_id",
            F.when((quality == 0) & (toxic == 1), F.concat(F.lit("Sorry: "), whole))
            .when((quality == 0) & (F.col("lang") == "en"), F.concat(score, F.lit("}")))
            .when(quality == 0, F.concat(score, F.lit(", "), reason))
            .when(toxic == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
            .otherwise(whole)
            .alias("reply"),
        )
    )


@kept
def linked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles once per title as enrichment candidates; Spanish ones have no link."""
    first = dedup_first(hashed(spark, sf_dir), "hash", newest_mail_first())
    linked = first.withColumn("link", F.when(F.col("lang") != "es", F.col("link"))).withColumn("score", F.lit("High"))
    return schema_align(linked, STORED_AT)


@kept
def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with a failure message for some hosts."""
    failed = F.contains("url", F.lit("casino"))
    message = F.concat(F.lit("robots rule of this host forbids to read the page at "), F.col("url"), F.lit(" "), F.col("url"))
    return table(spark, sf_dir, "pages").withColumn("error", F.when(failed, message))


@kept
def typed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users might type as a start bound, from every event."""
    moment = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == "view", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == "signup", F.date_format(moment, "yyyy-MM-dd"))
        .when(kind == "purchase", F.unix_timestamp(moment).cast("string"))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("typed"))
