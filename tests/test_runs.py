import pytest
from pyspark.sql import functions as F

from mailquill.operators.align import with_missing_columns
from mailquill.operators.enrich import page_texts
from mailquill.operators.score import scored_only
from mailquill.plans import jobs
from mailquill.plans.digest import DigestSettings, digest, report_from_store, run_digest
from mailquill.schema import ARTICLE_SCHEMA, MAIL_SCHEMA
from mailquill.session import shared_folder
from mailquill.sources.mail import write_mail
from mailquill.sources.state import read_state
from mailquill.sources.store import current_articles, load_store
from mailquill.streaming.ingest import compact_batches, start_ingest, store_batch
from verification import views as v

ARTICLE = '<h3><a class="gse_alrt_title" href="{link}">{title}</a></h3><div class="gse_alrt_sni">{summary}</div>'


def mail(spark, *mails):
    rows = [
        (key, sender, "", "", date, "".join(ARTICLE.format(link=l, title=t, summary=s) for t, l, s in articles))
        for key, sender, date, articles in mails
    ]
    return spark.createDataFrame(rows, MAIL_SCHEMA)


FIRST = (
    ("m1", "x@e", 100.0, [("Catalyst A", "u/a", "s"), ("Review B", "u/b", "s")]),
    ("m2", "x@e", 200.0, [("CATALYST a", "u/a2", "newer"), ("Battery C", "u/c", "s")]),
    ("m3", "y@e", 300.0, [("Catalyst of another sender", "u/d", "s")]),
)
SETTINGS = DigestSettings(sender="x@e", run_time="2024-03-01 08:30:00")


def test_run(spark):
    pages = spark.createDataFrame([(1, "u/a2", "<article>full</article>")], "page_id long, url string, html string")
    store = spark.createDataFrame([], ARTICLE_SCHEMA)
    run = run_digest(mail(spark, *FIRST), store, SETTINGS, pages)
    assert {row.stage: row.n for row in run.counters().collect()} == {
        "mails": 2, "parsed": 4, "new": 3, "scored": 3, "enriched": 2, "reported": 2,
    }
    report = [(r.row_no, r.title, r.full_text_summary) for r in run.report.orderBy("row_no").collect()]
    assert report == [(1, "CATALYST a", "full"), (2, "Review B", "Could not retrieve full text.")]
    again = run_digest(mail(spark, *FIRST), run.scored, SETTINGS)
    assert again.new.count() == 0
    assert [row.block for row in digest(mail(spark, *FIRST), run.scored, SETTINGS).collect()] == ["No articles to report."]
    late = run_digest(mail(spark, *FIRST), store, DigestSettings("x@e", "t", since=150.5, high="Top"))
    assert {row.title for row in late.new.collect()} == {"CATALYST a", "Battery C"}
    assert report_from_store(run.scored, SETTINGS).count() == 6


def test_scores_are_written_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def scorer(titles, summaries):
            calls.add(len(titles))
            return ["High"] * len(titles), ["r"] * len(titles)

        return scorer

    settings = DigestSettings("x@e", "t", scorer=make, partitions=2)
    run = run_digest(mail(spark, *FIRST), spark.createDataFrame([], ARTICLE_SCHEMA), settings)
    assert scored_only(run.scored).count() == 3 and run.report.count() == 3
    assert run.counters().count() == 6
    assert calls.value == 3


def hashes(spark, store):
    return sorted(row.hash for row in load_store(spark, store).collect())


def test_stream_resumes_and_replays(spark):
    source, store, checkpoint = (shared_folder(spark, name) for name in ("source", "store", "checkpoint"))

    def ingest():
        start_ingest(spark, source, store, checkpoint, "x@e", "now", files_per_batch=1).awaitTermination()
        return hashes(spark, store)

    mail(spark, *FIRST).repartition(2).write.parquet(source)
    once = ingest()
    assert len(once) == len(set(once)) == 3
    assert ingest() == once
    more = mail(spark, ("m4", "x@e", 50.0, [("Catalyst A", "u", "s"), ("Late D", "u/d", "s")]))
    more.write.mode("append").parquet(source)
    grown = ingest()
    assert len(grown) == 4 and set(once) < set(grown)
    last = spark.read.parquet(store).agg(F.max("batch_id")).first()[0]
    store_batch(more, last, store, "now", shared_folder(spark, "work"))
    store_batch(more, last, store, "now", shared_folder(spark, "work"))
    assert hashes(spark, store) == grown


def test_stream_equals_batch(spark, sf_dir):
    source, store, checkpoint = (shared_folder(spark, name) for name in ("source", "store", "checkpoint"))
    mails = v.mail(spark, sf_dir)
    mails.repartition(3, "id").write.parquet(source)
    start_ingest(spark, source, store, checkpoint, v.SENDER, "now", files_per_batch=1).awaitTermination()
    run = run_digest(mails, spark.createDataFrame([], ARTICLE_SCHEMA), DigestSettings(v.SENDER, "now"))
    assert hashes(spark, store) == sorted(row.hash for row in run.new.select("hash").collect())


def test_jobs_over_one_root(spark):
    root = shared_folder(spark, "root")
    pages = spark.createDataFrame([(1, "u/a2", "<article>full</article>")], "page_id long, url string, html string")
    write_mail(mail(spark, *FIRST), f"{root}/mail", 1)
    first = jobs.fetch(spark, root, SETTINGS, pages)
    path = first.report
    assert first.counts == {
        "mails": 2, "parsed": 4, "new": 3, "scored": 3, "enriched": 2, "reported": 2, "undated": 0,
    }
    assert path == f"{root}/reports/digest_report_20240301_083000.md"
    lines = [row.value for row in spark.read.text(path).collect()]
    assert lines[0] == "# Digest Report - 2024-03-01" and "- **Full Text Snippet**: full" in lines
    assert read_state(spark, f"{root}/state").first().last_run == 200.0

    later = DigestSettings(sender="x@e", run_time="2024-03-02 00:00:00")
    assert jobs.fetch(spark, root, later).report is None
    write_mail(mail(spark, ("m5", "X@e", 250.0, [("Catalyst A", "u", ""), ("DFT E", "u/e", "")])), f"{root}/mail", 2)
    assert jobs.fetch(spark, root, later).report is not None
    stored = {row.title: (row.score, row.full_text_summary) for row in current_articles(spark, root).collect()}
    assert stored == {
        "CATALYST a": ("High", "full"),
        "Review B": ("Medium", "Could not retrieve full text."),
        "Battery C": ("Low", None),
        "DFT E": ("High", None),
    }
    assert read_state(spark, f"{root}/state").first().last_run == 250.0
    odd = mail(spark, ("m6", "x@e", None, [("DFT undated", "u", "")]), ("m7", "x@e", 10.0, [("DFT late", "u", "")]))
    write_mail(odd, f"{root}/mail", 3)
    assert jobs.fetch(spark, root, later).counts["new"] == 2
    assert read_state(spark, f"{root}/state").first().last_run == 250.0
    assert jobs.set_since(spark, root, "1970-01-01 00:00:50") == 50.0
    assert read_state(spark, f"{root}/state").first().last_run == 50.0
    with pytest.raises(ValueError):
        jobs.fetch(spark, root, later, since="soon")
    whole = DigestSettings(sender="x@e", run_time="2024-03-03 00:00:00")
    text = "\n".join(row.value for row in spark.read.text(jobs.report(spark, root, whole)).collect())
    assert text.count("### [") == 5 and text.index("DFT E") < text.index("CATALYST a") < text.index("Review B")


STEPS = ["write_run", "append_texts", "write_report", "write_state"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_a_run_that_stops_is_repeated_whole(spark, monkeypatch, step, after):
    pages = spark.createDataFrame([(1, "u/a2", "<article>full</article>")], "page_id long, url string, html string")
    modules = {"write_run": jobs.article_store, "append_texts": jobs.article_store, "write_report": jobs, "write_state": jobs.run_state}
    root = shared_folder(spark, "root")
    write_mail(mail(spark, *FIRST), f"{root}/mail", 1)
    real = getattr(modules[step], step)

    def stops(*args):
        if after and step != "write_state":
            real(*args)
        raise OSError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(modules[step], step, stops)
        with pytest.raises(OSError):
            jobs.fetch(spark, root, SETTINGS, pages)
    again = jobs.fetch(spark, root, SETTINGS, pages)
    stored = sorted((r.title, r.score, r.full_text_summary) for r in current_articles(spark, root).where("score <> 'Low'").collect())
    assert stored == [("CATALYST a", "High", "full"), ("Review B", "Medium", "Could not retrieve full text.")]
    assert current_articles(spark, root).count() == 3
    assert spark.read.text(again.report).where("value LIKE '### [%'").count() == 2
    assert again.counts["new"] == 3


def test_pending_scores(spark):
    root = shared_folder(spark, "root")
    columns = "hash string, title string, link string, summary string, score string, reason string"
    rows = [("1", "dft x", "u", "s", None, None), ("2", "battery", "u", "s", "Error", "e"), ("3", "dft", "u", "s", "Low", "kept")]
    jobs.article_store.append_articles(with_missing_columns(spark.createDataFrame(rows, columns)), f"{root}/articles")
    assert jobs.score_pending(spark, root, SETTINGS) == 2
    assert {r.hash: r.score for r in current_articles(spark, root).collect()} == {"1": "High", "2": "Low", "3": "Low"}
    assert jobs.score_pending(spark, root, SETTINGS) == 0


def test_stream_is_compacted_scored_and_reported(spark):
    root, source, checkpoint = (shared_folder(spark, name) for name in ("root", "source", "checkpoint"))
    mails = mail(spark, *[(f"m{n}", "X@e", float(n), [(f"DFT {n}", "u", "s"), ("Battery", "u", "s")]) for n in range(6)])
    mails.repartition(6, "id").write.parquet(source)
    start_ingest(spark, source, f"{root}/articles", checkpoint, "x@e", "now", files_per_batch=1).awaitTermination()
    before = hashes(spark, f"{root}/articles")
    assert len(before) == 7
    compact_batches(spark, f"{root}/articles", f"{root}-2/articles")
    assert hashes(spark, f"{root}-2/articles") == before
    assert spark.read.parquet(f"{root}-2/articles").select("batch_id").distinct().count() == 2
    mail(spark, ("m9", "x@e", 9.0, [("DFT 9", "u", "s"), ("DFT 1", "u", "s")])).write.mode("append").parquet(source)
    start_ingest(spark, source, f"{root}-2/articles", checkpoint, "x@e", "now", files_per_batch=1).awaitTermination()
    assert len(hashes(spark, f"{root}-2/articles")) == 8
    assert jobs.score_pending(spark, f"{root}-2", SETTINGS) == 8
    assert jobs.score_pending(spark, f"{root}-2", SETTINGS) == 0
    written = spark.read.text(jobs.report(spark, f"{root}-2", SETTINGS))
    assert written.where("value LIKE '### [%'").count() == 7


def test_few_links_move_no_page(spark):
    pages = shared_folder(spark, "pages")
    html = F.concat(F.lit("<article>"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20), F.lit("</article>"))
    made = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("u/"), "id").alias("url"), html.alias("html"))
    made.repartition(4).write.parquet(pages)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        links = spark.createDataFrame([("u/5",)], "link string")
        found = page_texts(spark.read.parquet(pages), links)
        assert found.count() == 1
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "html" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
