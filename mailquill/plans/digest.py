"""The two commands of the engine: a digest of new mail, and a report over everything stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mailquill.functions.scoring import HIGH, MEDIUM, WordRules
from mailquill.functions.text import PAGE_TEXT_LIMIT, REPORT_TEXT_LIMIT
from mailquill.operators.align import stamp, with_hash
from mailquill.operators.counters import run_counters
from mailquill.operators.dedup import FEW_KEYS, dedup_first, newest_mail_first, only_new_probe
from mailquill.operators.enrich import FAILED_LIMIT, enrich_from_pages, enrichment_candidates
from mailquill.operators.explode import explode_alerts
from mailquill.operators.report import articles_for_report, number_report, report_document
from mailquill.operators.score import Calls, score_articles, scored_only
from mailquill.session import materialize
from mailquill.sources.mail import scan_mail


@dataclass(frozen=True)
class DigestSettings:
    sender: str
    run_time: str
    since: float | None = None
    after: int | None = None
    deliveries: list[str] | None = None
    high: str = HIGH
    medium: str = MEDIUM
    rules: WordRules = field(default_factory=WordRules)
    exclude: tuple[str, ...] = ()
    scorer: object = None
    partitions: int | None = None
    calls: Calls = Calls()
    title: str = "Digest Report"
    text_length: int = PAGE_TEXT_LIMIT
    failure_length: int = FAILED_LIMIT
    snippet_length: int = REPORT_TEXT_LIMIT
    keep_parsed: bool = False


@dataclass(frozen=True)
class DigestRun:
    """Frames of one run. ``scored``, ``enriched`` and, if kept, ``parsed`` are written tables; every new row is scored."""

    mails: DataFrame
    parsed: DataFrame
    new: DataFrame
    scored: DataFrame
    enriched: DataFrame
    report: DataFrame
    read: Observation | None = None

    def facts(self) -> dict:
        """Number of mails ``n``, of ``undated`` ones, newest date and last arrival, noted while the mails were parsed.

        Run with ``keep_parsed``. Mails are read, counted, parsed and written in one stage without a shuffle, in which each
        task counts once.
        """
        return self.read.get

    def counters(self) -> DataFrame:
        """Rows per stage. Run with ``keep_parsed``, else the mails are parsed a second time to be counted.

        The other stages are written tables, whose row counts Spark takes from the files' footers.
        """
        return run_counters(
            mails=self.mails if self.read is None else self.facts()["n"],
            parsed=self.parsed,
            new=self.new,
            scored=scored_only(self.scored),
            enriched=self.enriched,
            reported=self.report,
        )


def mail_facts(mails: DataFrame) -> list[Column]:
    arrival = F.max("arrival") if "arrival" in mails.columns else F.max(F.lit(None).cast("long"))
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("date").isNull()).alias("undated"),
        F.max("date").alias("newest"), arrival.alias("arrived"),
    ]


def new_articles(
    parsed: DataFrame, store: DataFrame, added_at: str, probe_folder: str | None = None, few: int = 0
) -> DataFrame:
    """Parsed articles to stored rows: hashed, first of each title, not stored before; up to ``few`` titles are looked up by value.

    The first rows are written, over ``probe_folder`` if there is one, and probe the store: by their true size Spark
    decides whether to broadcast their hashes, and then the store is scanned and not shuffled.
    """
    first = dedup_first(with_hash(parsed), "hash", newest_mail_first())
    return stamp(only_new_probe(materialize(first, "first", probe_folder), store, few=few), added_at)


def run_digest(
    mail: DataFrame,
    store: DataFrame,
    settings: DigestSettings,
    pages: DataFrame | None = None,
    write: Callable[[DataFrame], DataFrame] | None = None,
) -> DigestRun:
    """Scan, explode, deduplicate, score and, given ``pages``, enrich; the report holds this run's articles only.

    Scores are written before anything reads them, so a scorer is called once per article however often an executor is
    lost later. ``write`` writes them where they are to stay and gives them back; without it they are an intermediate table.
    """
    mails = scan_mail(mail, settings.sender, settings.since, settings.after, settings.deliveries)
    read = None
    if settings.keep_parsed:
        read = Observation("mails")
        parsed = materialize(explode_alerts(mails.observe(read, *mail_facts(mails))), "parsed")
    else:
        parsed = explode_alerts(mails)
    new = new_articles(parsed, store, settings.run_time, few=FEW_KEYS)
    scored = score_articles(new, settings.scorer, settings.rules, settings.exclude, settings.partitions, settings.calls)
    scored = write(scored) if write else materialize(scored, "scored")
    enriched = enrichment_candidates(scored, settings.high, settings.medium)
    if pages is not None:
        # New articles have no text yet, so the candidates are all that will be reported.
        enriched = enrich_from_pages(enriched, pages, settings.text_length, settings.failure_length)
        enriched = materialize(enriched, "enriched")
        report = number_reported(enriched, settings)
    else:
        enriched = enriched.where(F.lit(False))
        report = number_reported(scored, settings)
    return DigestRun(mails, parsed, scored, scored, enriched, report, read)


def digest(
    mail: DataFrame, store: DataFrame, settings: DigestSettings, pages: DataFrame | None = None
) -> DataFrame:
    """Markdown rows of the digest of new mail."""
    report = run_digest(mail, store, settings, pages).report
    return render(report, settings)


def render(report: DataFrame, settings: DigestSettings) -> DataFrame:
    return report_document(
        report,
        settings.run_time[:10],
        settings.run_time,
        settings.title,
        settings.high,
        settings.medium,
        settings.snippet_length,
    )


def number_reported(store: DataFrame, settings: DigestSettings) -> DataFrame:
    reported = articles_for_report(store, None, settings.high, settings.medium)
    return number_report(reported, settings.high, settings.medium)


def report_from_store(store: DataFrame, settings: DigestSettings) -> DataFrame:
    """Markdown rows over all stored high and medium articles."""
    return render(number_reported(store, settings), settings)
