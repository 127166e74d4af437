"""The commands over one root folder: ``mail``, ``articles``, ``scores``, ``texts``, ``consumed``, ``state`` and ``reports`` below it.

Every one of them, and a stream (``streaming.ingest.start_run_ingest``), is a run in the log of ``sources.runs``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquill.functions.scoring import ERROR
from mailquill.functions.text import since_bound
from mailquill.operators.score import score_articles
from mailquill.plans.digest import DigestSettings, number_reported, render, run_digest
from mailquill.session import intermediate_data, materialize
from mailquill.sources import mail as mail_source
from mailquill.sources import runs
from mailquill.sources import state as run_state  # noqa: F401
from mailquill.sources import store as article_store
from mailquill.sources.report import write_report

REPORT_TIME = "%Y-%m-%d %H:%M:%S"


def parse_since(spark: SparkSession, typed: str) -> float:
    bound = spark.range(1).select(since_bound(F.lit(typed))).first()[0]
    if bound is None:
        raise ValueError(f"neither seconds nor an ISO date: {typed!r}")
    return bound


def set_since(spark: SparkSession, root: str, typed: str | None = None) -> float:
    """Set the start bound of the next run by hand; without a value it is now."""
    bound = parse_since(spark, typed) if typed else datetime.now(timezone.utc).timestamp()
    number = runs.reserve(spark, root)
    runs.commit(spark, root, number, runs.SINCE, runs.snapshot(spark, root), {"last_run": float(bound)})
    return bound


@dataclass(frozen=True)
class Fetched:
    """What a run did: the report's path, None if there was nothing to report, and rows by stage."""

    report: str | None
    counts: dict[str, int]


def fetch(
    spark: SparkSession,
    root: str,
    settings: DigestSettings,
    pages: DataFrame | None = None,
    since: str | None = None,
) -> Fetched:
    """Process the deliveries that no run has read yet, store what is new and write its report.

    A bound typed as ``since``, or set by ``set_since`` after the last run, goes by the mails' dates instead, over all closed
    deliveries; those not read before count as read afterwards, too. A delivery that closes while the run goes on is left to the
    next one.

    The run writes articles, page texts, report and what it read under a number of its own and its row of the log last. Until
    that row is there the run has not happened, for any command. Articles are stored together with their scores.
    """
    with intermediate_data(spark):
        number = runs.reserve(spark, root)
        seen = runs.snapshot(spark, root)
        last_run, by_hand = runs.bound(spark, root)
        unread = mail_source.unread_deliveries(spark, root, seen)
        mails = mail_source.read_mail(spark, f"{root}/mail")
        if since or by_hand:
            bound = parse_since(spark, since) if since else last_run
            mails = mails.join(mail_source.closed_deliveries(spark, f"{root}/mail").select("delivery"), "delivery", "left_semi")
            settings = replace(settings, since=bound, after=None, deliveries=None)
        else:
            settings = replace(settings, since=None, after=None, deliveries=unread)

        def write(scored: DataFrame) -> DataFrame:
            article_store.write_run(scored, f"{root}/articles", number)
            return article_store.read_run(spark, f"{root}/articles", number)

        run = run_digest(mails, article_store.stored_in(spark, root, seen), replace(settings, keep_parsed=True), pages, write)
        if pages is not None:
            article_store.append_texts(run.enriched, root, number)
        path = _written(run.report, root, settings)
        mail_source.write_consumed(spark, unread, root, number)
        read = run.facts()
        counts = {row["stage"]: row["n"] for row in run.counters().collect()}  # one row per stage
        counts["undated"] = read["undated"]
        newest = [date for date in (read["newest"] or None, last_run) if date is not None]
        state = {"last_run": max(newest, default=None), "last_arrival": read["arrived"]}
        runs.commit(spark, root, number, runs.FETCH, seen, state)
    return Fetched(path, counts)


def score_pending(spark: SparkSession, root: str, settings: DigestSettings, again: tuple[str, ...] = (ERROR,)) -> int:
    """Score what is stored without a score, or with one of ``again``; returns how many rows that were.

    The scores are a run of their own: their version is its number, and its row of the log comes last.
    """
    with intermediate_data(spark):
        number = runs.reserve(spark, root)
        seen = runs.snapshot(spark, root)
        pending = article_store.current_with_scores(spark, root, lambda score: score.isNull() | score.isin(*again), seen)
        scored = score_articles(pending, settings.scorer, settings.rules, settings.exclude, settings.partitions, settings.calls)
        scored = materialize(scored.select("hash", "score", "reason"), "pending")
        article_store.append_scores(scored, root, number)
        n = scored.count()
        runs.commit(spark, root, number, runs.SCORE, seen)
    return n


def compact(spark: SparkSession, root: str, buckets: int | None = None) -> int:
    """Fold scores and page texts into the articles, as a run that takes the place of all before it; returns its number.

    With ``buckets`` the articles are clustered by hash into so many sorted files: later scores, texts and probes join them where
    they lie, and only what is new moves. A bucket should fit a task, some 100 to 200 MB of files, and there should be
    ``spark.sql.shuffle.partitions`` of them at least: Spark prefers moving all rows to joining in fewer tasks than that.
    What was read and the start bound stay as they are. A run that goes on meanwhile is not lost: it is none of those replaced.
    The replaced folders stay until ``runs.remove_unused``.
    """
    with intermediate_data(spark):
        number = runs.reserve(spark, root)
        seen = runs.snapshot(spark, root)
        current = article_store.current_articles(spark, root, seen)
        if buckets:
            article_store.write_clustered(current, root, number, buckets)
        else:
            article_store.write_run(current, f"{root}/articles", number)
        runs.commit(spark, root, number, runs.COMPACT, seen, replaces=seen.numbers, buckets=buckets)
    return number


def report(spark: SparkSession, root: str, settings: DigestSettings) -> str | None:
    """Write a report of all stored high and medium articles."""
    with intermediate_data(spark):
        wanted = article_store.current_with_scores(spark, root, lambda score: score.isin(settings.high, settings.medium))
        return _written(number_reported(wanted, settings), root, settings)


def _written(numbered: DataFrame, root: str, settings: DigestSettings) -> str | None:
    if numbered.isEmpty():
        return None
    moment = datetime.strptime(settings.run_time, REPORT_TIME)
    return write_report(render(numbered, settings), f"{root}/reports", moment)
