"""One Spark query per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquill.functions import scoring, text
from mailquill.functions.maintext import readable_text
from mailquill.functions.markup import page_text
from mailquill.operators import dedup, enrich, report, score
from mailquill.operators.align import schema_align
from mailquill.operators.explode import explode_alerts
from mailquill.operators.merge import merge_updates
from mailquill.operators.ranking import number_rows
from mailquill.plans import digest, jobs
from mailquill.schema import STATE_SCHEMA
from mailquill.session import materialize, shared_folder
from mailquill.sources import mail as mail_source
from mailquill.sources import runs
from mailquill.sources import state as run_state
from mailquill.sources import store as article_store
from mailquill.sources.report import write_report
from mailquill.streaming.ingest import start_ingest, start_run_ingest
from verification import views as v

PROMPT = 'Is this one for our reading list? Braces stay: {{}}.'
SETTINGS = digest.DigestSettings(sender=v.SENDER, run_time=v.RUN_TIME, rules=v.RULES, exclude=v.EXCLUDE)


def mail_incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "mail")
    mail_source.write_mail(v.mail(spark, sf_dir), path, 1)
    scanned = mail_source.scan_mail(mail_source.read_mail(spark, path), v.SENDER.title(), v.SINCE)
    return scanned.select("id", "sender", "subject", "date")


def mail_newest_first(spark, sf_dir):
    return mail_source.newest_first(v.mail(spark, sf_dir).select("id", "date"))


def mail_mime_decode(spark, sf_dir):
    return mail_source.decode_mail(v.raw_mail(spark, sf_dir))


def mail_date_parse(spark, sf_dir):
    moment = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    clock = F.date_format(moment, "dd MMM yyyy HH:mm:ss")
    header = (
        F.when(kind == "click", F.concat(F.date_format(moment, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)")))
        .when(kind == "view", F.concat(F.date_format(moment, "EEE, "), clock, F.lit(" -0530")))
        .when(kind == "purchase", F.concat(F.date_format(moment, "EEE,  "), clock, F.lit(" +02:00")))
        .when(kind == "signup", clock)
        .otherwise(F.col("props"))
    )
    events = v.table(spark, sf_dir, "events").select("event_id", header.alias("header"))
    return events.select("event_id", "header", text.header_date(F.col("header")).alias("date"))


def store_load(spark, sf_dir):
    path = shared_folder(spark, "store.csv")
    known = ["title", "summary", "hash", "email_date", "email_id", "added_at"]
    article_store.write_csv_store(v.whole_store(spark, sf_dir).select(*known), path)
    return article_store.load_store(spark, path, "csv")


def store_legacy_hash(spark, sf_dir):
    partly = v.whole_store(spark, sf_dir).withColumn(
        "hash", F.when(~F.startswith("email_id", F.lit("e-fr")), F.col("hash"))
    )
    return article_store.with_legacy_hash(partly).select("hash", "title")


def _fresh(spark, sf_dir, store):
    parsed = v.articles(spark, sf_dir)
    return digest.new_articles(parsed, store, v.RUN_TIME)


def store_append(spark, sf_dir):
    path = shared_folder(spark, "store")
    article_store.append_articles(v.store(spark, sf_dir), path)
    article_store.append_articles(_fresh(spark, sf_dir, article_store.load_store(spark, path)), path)
    return article_store.load_store(spark, path)


def insert_if_absent(spark, sf_dir):
    path = shared_folder(spark, "table")
    article_store.append_articles(v.store(spark, sf_dir), path)
    rows = dedup.dedup_first(v.hashed(spark, sf_dir), "hash", dedup.newest_mail_first())
    article_store.insert_if_absent(spark, schema_align(rows, v.RUN_TIME), path)
    return article_store.load_store(spark, path).select("hash", "title", "link", "added_at")


def epoch_normalise(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    kinds = dict(events.dtypes)
    return events.select(
        "event_id",
        text.epoch_seconds(F.col("ts"), kinds["ts"]).alias("seconds"),
        text.epoch_seconds(F.col("user_id"), kinds["user_id"]).alias("number"),
    )


def watermark_advance(spark, sf_dir):
    before = spark.createDataFrame([(7, v.SINCE, 3)], STATE_SCHEMA)
    arrived = v.mail(spark, sf_dir).withColumn("arrival", F.length("id").cast("long"))
    return run_state.advance_watermark(arrived, before)


def since_parse(spark, sf_dir):
    return v.typed_bounds(spark, sf_dir).select("event_id", text.since_bound(F.col("typed")).alias("since"))


def alert_html_explode(spark, sf_dir):
    return explode_alerts(v.mail(spark, sf_dir)).select("email_id", "position", "title", "link", "summary")


def article_lineage(spark, sf_dir):
    return explode_alerts(v.mail(spark, sf_dir)).select("email_id", "email_date", "title")


def title_hash(spark, sf_dir):
    return v.articles(spark, sf_dir).select("doc_id", text.title_hash(F.col("title")).alias("hash"))


def align(spark, sf_dir):
    return schema_align(v.articles(spark, sf_dir), v.STORED_AT)


def enrichment_candidates(spark, sf_dir):
    return enrich.enrichment_candidates(v.scored_store(spark, sf_dir)).select("hash", "score", "link")


def scored_only(spark, sf_dir):
    return score.scored_only(v.half_scored_store(spark, sf_dir)).select("hash", "score", "reason")


def report_tier_filter(spark, sf_dir):
    return report.tier_filter(v.scored_store(spark, sf_dir)).select("hash", "score")


def batch_dedup_first(spark, sf_dir):
    first = dedup.dedup_first(v.hashed(spark, sf_dir), "hash", dedup.newest_mail_first())
    return first.select("hash", "doc_id", "email_id", "position", "title", "link", "summary")


def new_vs_store_anti(spark, sf_dir):
    first = dedup.dedup_first(v.hashed(spark, sf_dir), "hash", dedup.newest_mail_first())
    return dedup.only_new(first, v.store(spark, sf_dir)).select("hash", "doc_id", "title")


def new_vs_store_probe(spark, sf_dir):
    first = materialize(dedup.dedup_first(v.hashed(spark, sf_dir), "hash", dedup.newest_mail_first()))
    return dedup.only_new_probe(first, v.store(spark, sf_dir)).select("hash", "doc_id", "title")


def score_merge(spark, sf_dir):
    merged = merge_updates(
        v.half_scored_store(spark, sf_dir), v.score_updates(spark, sf_dir), "hash", ["score", "reason"]
    )
    return merged.select("hash", "title", "score", "reason")


def score_upsert(spark, sf_dir):
    root = shared_folder(spark, "root")
    article_store.append_articles(v.whole_store(spark, sf_dir), f"{root}/articles")
    article_store.append_scores(score.scored_only(v.half_scored_store(spark, sf_dir)), root, 1)
    article_store.append_scores(v.score_updates(spark, sf_dir), root, 2)
    return article_store.current_articles(spark, root).select("hash", "title", "score", "reason")


def enrichment_upsert(spark, sf_dir):
    root = shared_folder(spark, "root")
    article_store.append_articles(v.scored_store(spark, sf_dir), f"{root}/articles")
    texts = v.judged(spark, sf_dir).select(
        "hash", F.when(F.col("toxic") == 1, F.col("title")).alias("full_text_summary")
    )
    article_store.append_texts(texts, root, 1)
    return article_store.current_articles(spark, root).select("hash", "score", "full_text_summary")


def report_hash_filter(spark, sf_dir):
    hashes = v.hashed(spark, sf_dir).where("lang = 'en'").select("hash")
    return report.articles_for_report(v.scored_store(spark, sf_dir), hashes).select("hash", "score", "title")


def page_enrichment(spark, sf_dir):
    enriched = enrich.enrich_from_pages(v.linked_candidates(spark, sf_dir), v.crawled_pages(spark, sf_dir))
    return enriched.select("hash", "link", "full_text_summary")


def run_counters(spark, sf_dir):
    settings = replace(SETTINGS, keep_parsed=True)
    run = digest.run_digest(v.mail(spark, sf_dir), v.store(spark, sf_dir), settings, v.crawled_pages(spark, sf_dir))
    return run.counters()


def report_order(spark, sf_dir):
    numbered = report.number_report(v.scored_store(spark, sf_dir))
    return numbered.select("hash", "score", "email_date", "rank", "row_no")


def score_text(spark, sf_dir):
    return v.articles(spark, sf_dir).select("doc_id", text.score_text(F.col("title"), F.col("summary")).alias("text"))


def keyword_exclude(spark, sf_dir):
    whole = text.score_text(F.col("title"), F.col("summary"))
    return v.articles(spark, sf_dir).select(
        "doc_id",
        scoring.excluded_by(whole, v.EXCLUDE).alias("keyword"),
        scoring.exclusion_reason(whole, v.EXCLUDE).alias("reason"),
    )


def rule_score(spark, sf_dir):
    return score.score_by_rules(v.articles(spark, sf_dir), v.RULES).select("doc_id", "score", "reason")


def prompt_render(spark, sf_dir):
    prompt = scoring.render_prompt(F.col("title"), F.col("summary"), PROMPT)
    return v.articles(spark, sf_dir).select("doc_id", prompt.alias("prompt"))


def response_parse(spark, sf_dir):
    return v.replies(spark, sf_dir).select(
        "doc_id", scoring.parse_reply(F.col("reply")).alias("verdict")
    ).select("doc_id", "verdict.score", "verdict.reason")


def page_text_query(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"))


def page_main_text(spark, sf_dir):
    """The same pages with the name of their article taken away, so that only density tells it from what is around it."""
    unnamed = F.regexp_replace("html", "<(/?)article>", "<$1div>")
    return v.table(spark, sf_dir, "pages").select("page_id", readable_text(unnamed).alias("text"))


def snippet_1000(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def date_readable(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    seconds = text.epoch_seconds(F.col("ts"), dict(events.dtypes)["ts"])
    known = F.when(F.col("event_type") != "error", seconds)
    return events.select("event_id", text.readable(known).alias("readable"))


def report_snippet_250(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", text.report_snippet(F.col("text")).alias("snippet"))


def report_block(spark, sf_dir):
    return v.scored_store(spark, sf_dir).select("hash", report.report_block().alias("block"))


def report_document(spark, sf_dir):
    reported = report.articles_for_report(v.scored_store(spark, sf_dir))
    return digest.render(report.number_report(reported), SETTINGS)


def report_write(spark, sf_dir):
    folder = shared_folder(spark, "reports")
    path = write_report(report_document(spark, sf_dir), folder, datetime(2024, 3, 1, 8, 30))
    return _report_lines(spark, path)


def _report_lines(spark, path):
    parts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = parts.select("file", F.posexplode(F.split(F.expr("left(value, length(value) - 1)"), "\n")).alias("pos", "line"))
    return number_rows(lines, [F.col("file"), F.col("pos")], "line_no").select("line_no", "line")


def word_scorer():
    """The word rules again, as a batch scorer of a user's own."""
    high = tuple(word.lower() for word in v.RULES.high)
    medium = tuple(word.lower() for word in v.RULES.medium)
    low = tuple(word.lower() for word in v.RULES.low)

    def make():
        def judge(title, summary):
            whole = f"{title} {summary}".lower()
            for words, verdict in ((low, "Low"), (high, "High"), (medium, "Medium")):
                if any(word in whole for word in words):
                    return verdict
            return "Low"

        def scorer(titles, summaries):
            scores = [judge(title, summary) for title, summary in zip(titles, summaries)]
            return scores, [f"judged {one}" for one in scores]

        return scorer

    return make


def pluggable_score(spark, sf_dir):
    scorer = score.choose_scorer("words:small", {"words": lambda model: word_scorer()})
    first = dedup.dedup_first(v.hashed(spark, sf_dir), "hash", dedup.newest_mail_first())
    scored = score.score_articles(first.select("hash", "doc_id", "title", "summary"), scorer, exclude=v.EXCLUDE, partitions=8)
    return scored.select("hash", "doc_id", "score", "reason")


def concurrent_score(spark, sf_dir):
    """The same with eight calls side by side in each of two tasks or more, of which some fail at first."""
    scorer = score.choose_scorer("words:small", {"words": lambda model: failing_at_first(word_scorer())})
    first = dedup.dedup_first(v.hashed(spark, sf_dir), "hash", dedup.newest_mail_first())
    calls = score.Calls(workers=8, rows=5, retries=1, pause=0.001)
    scored = score.score_articles(first.select("hash", "doc_id", "title", "summary"), scorer, exclude=v.EXCLUDE, partitions=2, calls=calls)
    return scored.select("hash", "doc_id", "score", "reason")


def failing_at_first(make_scorer):
    def make():
        scorer, seen = make_scorer(), set()

        def scored(titles, summaries):
            place = tuple(titles)
            if len(place[0]) % 3 == 0 and place not in seen:
                seen.add(place)
                raise OSError("busy")
            return scorer(titles, summaries)

        return scored

    return make


def keyword_list(spark, sf_dir):
    """Exclusion by all longer words of the benchmark, in their order by length and letters, as one list."""
    words = v.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).where("length(word) >= 9").distinct()
    listed = [row["word"] for row in words.collect()]  # a setting of the run: the list is a parameter, not data of the rows
    listed = sorted(listed, key=lambda word: (-len(word), word.encode()))
    whole = text.score_text(F.col("title"), F.col("summary"))
    return v.articles(spark, sf_dir).select("doc_id", scoring.excluded_by(whole, listed).alias("keyword"))


#: Bytes of document text whose mails are dealt to one file of a stream's source.
SOURCE_FILE = 512_000_000


def source_files(spark, sf_dir):
    """Four files, or more of them, so that none grows with the documents."""
    size = v.table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, -(-size // SOURCE_FILE))


def stream_ingest(spark, sf_dir):
    source, store, checkpoint = (shared_folder(spark, name) for name in ("source", "store", "checkpoint"))
    v.mail(spark, sf_dir).repartition(source_files(spark, sf_dir), "id").write.parquet(source)
    stream = start_ingest(spark, source, store, checkpoint, v.SENDER, v.RUN_TIME, files_per_batch=2)
    stream.awaitTermination()
    return article_store.load_store(spark, store).select("hash")


def digest_end_to_end(spark, sf_dir):
    return digest.digest(v.mail(spark, sf_dir), v.store(spark, sf_dir), SETTINGS, v.crawled_pages(spark, sf_dir))


def digest_rerun(spark, sf_dir):
    """A run over a folder in which an unfinished attempt left other articles and texts."""
    root = shared_folder(spark, "root")
    mail_source.write_mail(v.mail(spark, sf_dir), f"{root}/mail", 1)
    article_store.append_articles(v.store(spark, sf_dir), f"{root}/articles")
    article_store.write_run(v.whole_store(spark, sf_dir), f"{root}/articles", 1)
    article_store.append_texts(v.whole_store(spark, sf_dir).withColumn("full_text_summary", F.col("title")), root, 1)
    return _report_lines(spark, jobs.fetch(spark, root, SETTINGS, v.crawled_pages(spark, sf_dir)).report)


def digest_after_crash(spark, sf_dir):
    """A run over a folder in which another one failed half-way, and scores were completed in between."""
    root = shared_folder(spark, "root")
    mail_source.write_mail(v.mail(spark, sf_dir), f"{root}/mail", 1)
    article_store.append_articles(v.store(spark, sf_dir), f"{root}/articles")
    number = runs.reserve(spark, root)
    article_store.write_run(v.whole_store(spark, sf_dir), f"{root}/articles", number)
    article_store.append_texts(v.whole_store(spark, sf_dir).withColumn("full_text_summary", F.col("title")), root, number)
    jobs.score_pending(spark, root, SETTINGS)
    return _report_lines(spark, jobs.fetch(spark, root, SETTINGS, v.crawled_pages(spark, sf_dir)).report)


def _mail_part(number: int, of: int):
    """A part of the mails by the number in their id."""
    return F.element_at(F.split("id", "-"), -1).cast("long") % of == number


def shared_root(spark, sf_dir):
    """What a stream, a run and the stream again have stored below one root."""
    root, source, checkpoint = (shared_folder(spark, name) for name in ("root", "source", "checkpoint"))
    mails = materialize(v.mail(spark, sf_dir), "mails")  # made once for its three parts

    def stream(number):
        mails.where(_mail_part(number, 3)).write.mode("append").parquet(source)
        start_run_ingest(spark, source, root, checkpoint, SETTINGS).awaitTermination()

    stream(0)
    mail_source.write_mail(mails.where(_mail_part(1, 3)), f"{root}/mail", 1)
    jobs.fetch(spark, root, SETTINGS)
    stream(2)
    stored = article_store.current_articles(spark, root)
    return stored.select("hash", "title", "link", "summary", "email_id", "score", "reason")


def late_deliveries(spark, sf_dir):
    """Which run stored each article, of deliveries that close out of order and share numbers."""
    root = shared_folder(spark, "root")
    mails = materialize(v.mail(spark, sf_dir), "mails")  # made once for its four parts
    for part, arrival in ((2, 7), (0, 5), (1, 7), (3, 1)):
        mail_source.write_mail(mails.where(_mail_part(part, 4)), f"{root}/mail", arrival)
        if part:
            jobs.fetch(spark, root, SETTINGS)
    return spark.read.parquet(f"{root}/articles").select("hash", F.col("run_no").cast("long").alias("run_no"))


def store_compact(spark, sf_dir):
    root = shared_folder(spark, "root")
    article_store.append_articles(v.half_scored_store(spark, sf_dir), f"{root}/articles")
    jobs.score_pending(spark, root, SETTINGS)
    jobs.compact(spark, root)
    runs.remove_unused(spark, root)
    return article_store.current_articles(spark, root).select("hash", "score", "reason")


def store_clustered(spark, sf_dir):
    """Scores and texts over articles that lie clustered by hash, and more articles stored after that."""
    root = shared_folder(spark, "root")
    article_store.append_articles(v.half_scored_store(spark, sf_dir), f"{root}/articles")
    jobs.compact(spark, root, buckets=8)
    jobs.score_pending(spark, root, SETTINGS)
    mail_source.write_mail(v.mail(spark, sf_dir), f"{root}/mail", 1)
    jobs.fetch(spark, root, SETTINGS)
    return article_store.current_articles(spark, root).select("hash", "score", "reason")


def score_pending(spark, sf_dir):
    root = shared_folder(spark, "root")
    article_store.append_articles(v.half_scored_store(spark, sf_dir), f"{root}/articles")
    jobs.score_pending(spark, root, SETTINGS)
    return article_store.current_articles(spark, root).select("hash", "score", "reason")


def report_from_store(spark, sf_dir):
    return digest.report_from_store(v.scored_store(spark, sf_dir), SETTINGS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mail_incremental_scan": mail_incremental_scan,
    "mail_newest_first": mail_newest_first,
    "mail_mime_decode": mail_mime_decode,
    "mail_date_parse": mail_date_parse,
    "store_load": store_load,
    "store_legacy_hash": store_legacy_hash,
    "store_append": store_append,
    "insert_if_absent": insert_if_absent,
    "epoch_normalise": epoch_normalise,
    "watermark_advance": watermark_advance,
    "since_parse": since_parse,
    "report_write": report_write,
    "alert_html_explode": alert_html_explode,
    "article_lineage": article_lineage,
    "title_hash": title_hash,
    "schema_align": align,
    "enrichment_candidates": enrichment_candidates,
    "scored_only": scored_only,
    "report_tier_filter": report_tier_filter,
    "batch_dedup_first": batch_dedup_first,
    "new_vs_store_anti": new_vs_store_anti,
    "new_vs_store_probe": new_vs_store_probe,
    "score_merge": score_merge,
    "score_upsert": score_upsert,
    "enrichment_upsert": enrichment_upsert,
    "report_hash_filter": report_hash_filter,
    "page_enrichment": page_enrichment,
    "run_counters": run_counters,
    "report_order": report_order,
    "score_text": score_text,
    "keyword_exclude": keyword_exclude,
    "rule_score": rule_score,
    "prompt_render": prompt_render,
    "response_parse": response_parse,
    "page_text": page_text_query,
    "page_main_text": page_main_text,
    "snippet_1000": snippet_1000,
    "date_readable": date_readable,
    "report_snippet_250": report_snippet_250,
    "report_block": report_block,
    "report_document": report_document,
    "pluggable_score": pluggable_score,
    "concurrent_score": concurrent_score,
    "keyword_list": keyword_list,
    "stream_ingest": stream_ingest,
    "digest_end_to_end": digest_end_to_end,
    "digest_rerun": digest_rerun,
    "digest_after_crash": digest_after_crash,
    "shared_root": shared_root,
    "late_deliveries": late_deliveries,
    "store_compact": store_compact,
    "store_clustered": store_clustered,
    "score_pending": score_pending,
    "report_from_store": report_from_store,
}
