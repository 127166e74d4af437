import hashlib

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mailquill.operators.align import schema_align
from mailquill.operators.dedup import dedup_first, newest_mail_first, only_new, only_new_probe, restrict_to
from mailquill.operators.merge import merge_updates
from mailquill.plans.digest import new_articles
from mailquill.schema import ARTICLE_SCHEMA
from mailquill.session import shared_folder
from mailquill.sources import store as article_store

PARSED = "email_id string, email_date double, position int, title string, link string, summary string"


def key(title):
    return hashlib.sha256(title.lower().encode()).hexdigest()


def batch_one(spark):
    return spark.createDataFrame(
        [("e1", 10.0, 0, "One", "l/1", "s1"), ("e2", 11.0, 0, "Two: b", "l/2", "s2"), ("e3", 12.0, 0, "Three", "l/3", "")],
        PARSED,
    )


def batch_two(spark):
    return spark.createDataFrame(
        [("e4", 13.0, 0, "ONE", "l/1new", "s1 again"), ("e5", 14.0, 0, "Four", "l/4", "s4")], PARSED
    )


def test_two_batches_leave_four_rows(spark):
    path = shared_folder(spark, "store")
    for number, batch in enumerate((batch_one(spark), batch_two(spark), batch_two(spark))):
        article_store.append_articles(
            new_articles(batch, article_store.load_store(spark, path), f"run {number}"), path
        )
    rows = {row.title: row for row in article_store.load_store(spark, path).collect()}
    assert {title: (row.link, row.added_at) for title, row in rows.items()} == {
        "One": ("l/1", "run 0"),
        "Two: b": ("l/2", "run 0"),
        "Three": ("l/3", "run 0"),
        "Four": ("l/4", "run 1"),
    }
    assert all(row.hash == key(title) for title, row in rows.items())


def test_newest_mail_wins_then_id_then_position(spark):
    rows = [
        ("a", 1.0, 0, "T", "old", ""),
        ("c", 2.0, 0, "t", "later id", ""),
        ("b", 2.0, 1, "T", "second place", ""),
        ("b", 2.0, 0, "t", "wanted", ""),
        ("0", None, 0, "T", "undated", ""),
    ]
    frame = spark.createDataFrame(rows, PARSED)
    kept = new_articles(frame, spark.createDataFrame([], ARTICLE_SCHEMA), "now").collect()
    assert [row.link for row in kept] == ["wanted"]


def test_title_is_not_trimmed(spark):
    frame = spark.createDataFrame([("a", 1.0, 0, "T", "x", ""), ("a", 1.0, 1, "T ", "y", "")], PARSED)
    assert new_articles(frame, spark.createDataFrame([], ARTICLE_SCHEMA), "now").count() == 2


def test_align(spark):
    rows = schema_align(spark.createDataFrame([("T", 1)], "title string, other int"), "now")
    assert rows.columns == ARTICLE_SCHEMA.names
    assert rows.first().asDict() == {**dict.fromkeys(ARTICLE_SCHEMA.names), "title": "T", "hash": key("T"), "added_at": "now"}
    untitled = schema_align(spark.createDataFrame([("x",)], "link string"), "now")
    assert untitled.columns == ARTICLE_SCHEMA.names and untitled.count() == 0


def test_csv_round_trip(spark):
    path = shared_folder(spark, "store.csv")
    rows = [("h1", 'say "x", ok\\', "", " s\nt ", 1.5), ("h2", "NA", None, "", None)]
    article_store.write_csv_store(
        spark.createDataFrame(rows, "hash string, title string, link string, summary string, email_date double"), path
    )
    loaded = article_store.load_store(spark, path, "csv")
    assert loaded.columns == ARTICLE_SCHEMA.names
    back = loaded.select("hash", "title", "link", "summary", "email_date").orderBy("hash").collect()
    assert [tuple(row) for row in back] == rows


def test_absent_store_is_empty_and_broken_store_fails(spark, tmp_path):
    for fmt in ("parquet", "csv"):
        empty = article_store.load_store(spark, f"{tmp_path}/none", fmt)
        assert empty.columns == ARTICLE_SCHEMA.names and empty.count() == 0
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    with pytest.raises((PySparkException, Py4JJavaError)):
        article_store.load_store(spark, str(broken)).count()


def test_legacy_hash(spark):
    partly = spark.createDataFrame([(None, "T"), ("kept", "U")], "hash string, title string")
    assert {tuple(row) for row in article_store.with_legacy_hash(partly).collect()} == {(key("T"), "T"), ("kept", "U")}
    assert article_store.with_legacy_hash(partly.drop("hash")).count() == 2
    assert article_store.with_legacy_hash(partly.select(F.lit(1).alias("link"))).count() == 0


def test_insert_if_absent_ignores_conflicts(spark):
    path = shared_folder(spark, "table")
    first = schema_align(batch_one(spark), "first")
    article_store.insert_if_absent(spark, first.unionByName(first), path)
    article_store.insert_if_absent(spark, schema_align(batch_two(spark), "second"), path)
    rows = article_store.load_store(spark, path).collect()
    assert sorted((row.title, row.added_at) for row in rows) == [
        ("Four", "second"), ("One", "first"), ("Three", "first"), ("Two: b", "first"),
    ]


def test_merge_keeps_values_over_nulls(spark):
    store = spark.createDataFrame(
        [("a", "High", "r"), ("b", None, None), ("c", "Low", "r")], "hash string, score string, reason string"
    )
    updates = spark.createDataFrame(
        [("a", None, "new"), ("b", "Low", None), ("unknown", "High", "x"), (None, "High", "x"), ("b", "Low", None)],
        "hash string, score string, reason string",
    )
    merged = merge_updates(store, updates, "hash", ["score", "reason"])
    assert merged.columns == store.columns
    assert {tuple(row) for row in merged.collect()} == {("a", "High", "new"), ("b", "Low", None), ("c", "Low", "r")}


def test_versions_of_updates(spark):
    root = shared_folder(spark, "root")
    article_store.append_articles(schema_align(batch_one(spark), "now"), f"{root}/articles")
    assert article_store.current_articles(spark, root).where("score IS NOT NULL").count() == 0
    scores = "hash string, score string, reason string"
    article_store.append_scores(spark.createDataFrame([(key("One"), "High", "r1")], scores), root, 1)
    article_store.append_scores(
        spark.createDataFrame([(key("One"), "Low", None), (key("Three"), "Medium", "r")], scores), root, 2
    )
    texts = spark.createDataFrame([(key("One"), "text")], "hash string, full_text_summary string")
    article_store.append_texts(texts, root, 3)
    expected = {("One", "Low", "r1", "text"), ("Two: b", None, None, None), ("Three", "Medium", "r", None)}
    picked = ["title", "score", "reason", "full_text_summary"]
    assert {tuple(row) for row in article_store.current_articles(spark, root).select(picked).collect()} == expected
    new_root = shared_folder(spark, "compacted")
    article_store.compact(spark, root, new_root)
    assert {tuple(row) for row in article_store.current_articles(spark, new_root).select(picked).collect()} == expected


def hot_batch(spark, rows=3000):
    """A third of all rows share one title."""
    return spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hash"),
        F.col("id").alias("email_date").cast("double"),
        F.col("id").cast("string").alias("email_id"),
        F.lit(0).alias("position"),
    )


def test_hot_title_is_cut_before_the_shuffle(spark):
    first = dedup_first(hot_batch(spark).repartition(8), "hash", newest_mail_first())
    plan = first._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.index(", Final"), plan.index(", Partial")
    assert "Exchange hashpartitioning(hash" in plan[final:partial]
    rows = {row.hash: row.email_date for row in first.collect()}
    assert len(rows) == 2001 and rows["hot"] == 2997.0


def test_probe_equals_plain_anti_join(spark):
    first = dedup_first(hot_batch(spark), "hash", newest_mail_first())
    store = spark.createDataFrame([("hot",), ("hot",), ("1",), ("absent",), (None,)], "hash string")
    plain = {row.hash for row in only_new(first, store).collect()}
    assert plain == {row.hash for row in only_new_probe(first, store).collect()}
    assert len(plain) == 1999 and not plain & {"hot", "1"}


def test_a_bucketed_store_does_not_move(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = shared_folder(spark, "bucketed")
        article_store.save_bucketed(schema_align(batch_one(spark), "now"), "bucketed_store", path, 8)
        stored = spark.table("bucketed_store")
        fresh = new_articles(batch_two(spark), stored, "now")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        # Only the written batch moves: its distinct hashes, and its rows for the check against what was found.
        assert plan.count("Exchange") == 2 and "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert [row.title for row in fresh.collect()] == ["Four"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_restrict(spark):
    frame = spark.createDataFrame([("a",), ("b",)], "hash string")
    wanted = spark.createDataFrame([("a",), ("a",), ("c",)], "hash string")
    assert restrict_to(frame, None).count() == 2
    assert [row.hash for row in restrict_to(frame, wanted).collect()] == ["a"]


def scanned_rows(frame):
    """Rows that the scans of a plan have let through, after it ran."""
    frame.collect()
    plan, rows = frame._jdf.queryExecution().executedPlan(), 0
    leaves = [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while leaves:
        node = leaves.pop()
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage", "AQEShuffleRead")):
            node = node.plan() if hasattr(node, "plan") and "QueryStage" in node.nodeName() else node
        if node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        leaves += [children.apply(k) for k in range(children.size())]
    return rows


@pytest.mark.parametrize("clustered", [False, True])
def test_a_probe_by_value_skips_files(spark, clustered):
    from mailquill.operators.align import with_missing_columns
    from mailquill.sources import runs

    root = shared_folder(spark, "root")
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").cast("string").alias("title"))
    rows = with_missing_columns(rows)
    if clustered:
        number = runs.reserve(spark, root)
        article_store.write_clustered(rows, root, number, 16)
        runs.commit(spark, root, number, runs.COMPACT, runs.snapshot(spark, root), buckets=16)
        store = article_store.stored_in(spark, root, runs.snapshot(spark, root))
    else:
        article_store.append_articles(rows.repartition(16, "title"), f"{root}/articles")
        store = article_store.load_store(spark, f"{root}/articles")
    wanted = [hashlib.sha256(str(n).encode()).hexdigest() for n in (5, 77)] + ["f" * 64, "0" * 64, None]
    batch = spark.createDataFrame([(value,) for value in wanted], "hash string")
    few = store.select("hash").where(F.col("hash").isin(wanted[:-1]))
    assert 2 <= scanned_rows(few) < 10_000  # a file holds 1,250 rows
    found = only_new_probe(batch, store, few=10)
    assert sorted(row.hash or "" for row in found.collect()) == ["", "0" * 64, "f" * 64]
    many = only_new_probe(batch, store, few=2)
    assert sorted(row.hash or "" for row in many.collect()) == ["", "0" * 64, "f" * 64]
