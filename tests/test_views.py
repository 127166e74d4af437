"""How much the test queries' inputs move and write, and that they stay the same."""

from pyspark.sql import functions as F

from mailquill.plans import jobs
from mailquill.session import shared_folder
from mailquill.sources import store as article_store
from verification import registry, views


def test_narrow_tables_join_beside_the_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (25, "c"), (39, "d"), (None, "e"), (1000, "f")], "doc_id bigint, text string")
    narrow = spark.createDataFrame([(1, "x"), (1, "y"), (25, None), (None, "n"), (38, "z")], "page_id bigint, url string")
    grouped = rows.withColumn("mail_group", views.mail_group("doc_id"))
    for how in ("left", "inner"):
        found = views.beside(grouped, narrow, "page_id", how).select("doc_id", "text", "url")
        plain = rows.join(narrow, F.col("doc_id") == F.col("page_id"), how).select("doc_id", "text", "url")
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_texts_of_mails_are_shuffled_once(spark, sf_dir, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        views.mail(spark, sf_dir).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2  # the documents and the pages


def test_joins_with_an_absent_table_move_nothing(spark, sf_dir, capsys):
    root = shared_folder(spark, "root")
    article_store.append_articles(views.store(spark, sf_dir), f"{root}/articles")
    article_store.current_articles(spark, root).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_files_of_a_source_grow_with_the_texts(spark, sf_dir, monkeypatch):
    assert registry.source_files(spark, sf_dir) == 4
    monkeypatch.setattr(registry, "SOURCE_FILE", 50_000)
    size = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert registry.source_files(spark, sf_dir) == -(-size // 50_000) > 4


def test_a_run_writes_its_articles_once(spark, sf_dir, monkeypatch):
    """Scored articles are written where they are to stay, and not to an intermediate table before."""
    from mailquill.plans import digest

    names = []
    whole = digest.materialize
    monkeypatch.setattr(digest, "materialize", lambda frame, name="cut", path=None: names.append(name) or whole(frame, name, path))
    root = shared_folder(spark, "root")
    registry.mail_source.write_mail(views.mail(spark, sf_dir), f"{root}/mail", 1)
    found = jobs.fetch(spark, root, registry.SETTINGS)
    assert found.counts["scored"] == article_store.current_articles(spark, root).count() > 0
    assert "parsed" in names and "scored" not in names


def test_scores_of_pending_articles_are_written_without_their_texts(spark, sf_dir, monkeypatch):
    columns = []
    whole = jobs.materialize
    monkeypatch.setattr(jobs, "materialize", lambda frame, *rest: columns.append(frame.columns) or whole(frame, *rest))
    root = shared_folder(spark, "root")
    article_store.append_articles(views.half_scored_store(spark, sf_dir), f"{root}/articles")
    assert jobs.score_pending(spark, root, registry.SETTINGS) > 0
    assert columns == [["hash", "score", "reason"]]
