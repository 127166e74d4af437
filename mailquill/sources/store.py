"""The article store: append-only Parquet tables keyed by hash, and CSV stores from elsewhere.

Scores and page texts are appended to tables of their own and joined in by a view, so an update costs its own size and
not a rewrite of the store. ``compact`` folds them in when that pays. Below a root folder with a run log
(``sources.runs``) only folders of committed runs are read.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquill.functions.text import title_hash
from mailquill.operators.align import with_missing_columns
from mailquill.operators.dedup import only_new
from mailquill.operators.merge import merge_updates
from mailquill.schema import ARTICLE_SCHEMA
from mailquill.session import materialize
from mailquill.sources.csv_records import read_csv
from mailquill.sources.runs import Snapshot, snapshot

# A text that no cell holds: Spark tells empty cells from quoted empty ones only when some other text means NULL.
CSV_NULL = "\\N"

#: Parquet's Bloom filters of the key, as large as the keys of a row group need: a probe by value skips the others.
KEY_FILTERS = {"parquet.bloom.filter.enabled#hash": "true", "parquet.bloom.filter.adaptive.enabled": "true"}

RUN = T.StructField("run_no", T.LongType())
VERSION = T.StructField("version", T.LongType())
SCORES_SCHEMA = T.StructType([ARTICLE_SCHEMA["hash"], ARTICLE_SCHEMA["score"], ARTICLE_SCHEMA["reason"], VERSION])
TEXTS_SCHEMA = T.StructType([ARTICLE_SCHEMA["hash"], ARTICLE_SCHEMA["full_text_summary"], VERSION])


def _empty_if_absent(spark: SparkSession, schema: T.StructType, read) -> DataFrame:
    """An absent path is an empty table, of which Spark knows that, so joins with it move nothing.

    Any other problem fails the job instead of hiding the store.
    """
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema]
        return spark.range(1).where(F.lit(False)).select(*nothing)


def load_store(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored articles with all known columns; those that the files lack are NULL.

    CSV columns are matched by the names in the header and read as text, so a title such as ``NA`` stays a title. An empty
    cell is NULL, a quoted empty cell is empty text. A large file is read by many tasks, line breaks in its cells or not.
    """
    if fmt == "parquet":
        return stored_before(spark, path)
    stored = _empty_if_absent(spark, ARTICLE_SCHEMA, lambda: read_csv(spark, path, CSV_NULL))
    if "email_date" in stored.columns:
        stored = stored.withColumn("email_date", F.col("email_date").try_cast("double"))
    return with_missing_columns(stored)


def stored_before(spark: SparkSession, path: str, run_no: int | None = None) -> DataFrame:
    """Stored articles, or those of the runs before ``run_no``. Files outside of a run folder belong to no run."""
    schema = T.StructType([*ARTICLE_SCHEMA, RUN])
    stored = _empty_if_absent(spark, schema, lambda: spark.read.schema(schema).parquet(path))
    if run_no is not None:
        stored = stored.where(F.col("run_no").isNull() | (F.col("run_no") < run_no))
    return stored.select(*ARTICLE_SCHEMA.names)


def write_csv_store(articles: DataFrame, path: str) -> None:
    articles.write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def with_legacy_hash(stored: DataFrame) -> DataFrame:
    """Rows stored without a hash get it from the title; a store with neither column counts as empty."""
    if "title" not in stored.columns:
        return stored if "hash" in stored.columns else with_missing_columns(stored.where(F.lit(False)))
    made = title_hash(F.col("title"))
    return stored.withColumn("hash", F.coalesce("hash", made) if "hash" in stored.columns else made)


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows in one frame."""
    return store.unionByName(new, allowMissingColumns=True)


def stored_in(spark: SparkSession, root: str, seen: Snapshot) -> DataFrame:
    """Articles of the runs of a snapshot, as they were stored."""
    base, later = _stored_parts(spark, root, seen)
    return later if base is None else base.unionByName(later)


def _stored_parts(spark: SparkSession, root: str, seen: Snapshot) -> tuple[DataFrame | None, DataFrame]:
    """Articles that a compaction has clustered by hash, if there was one, and those of all other runs."""
    schema = T.StructType([*ARTICLE_SCHEMA, RUN])
    stored = _empty_if_absent(spark, schema, lambda: spark.read.schema(schema).parquet(f"{root}/articles"))
    later = stored.where(seen.holds(F.col("run_no")))
    if seen.base is None:
        return None, later.select(*ARTICLE_SCHEMA.names)
    number, buckets = seen.base
    later = later.where(F.coalesce("run_no", F.lit(0)) != number).select(*ARTICLE_SCHEMA.names)
    return _clustered(spark, f"{root}/articles/run_no={number}", buckets), later


def _table_name(path: str) -> str:
    return f"mailquill_clustered_{hashlib.md5(path.encode()).hexdigest()}"


def _clustered(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A folder of clustered articles as Spark's bucketed table; the session's catalog only holds where and how it lies."""
    columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in ARTICLE_SCHEMA)
    name, place = _table_name(path), path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS "
        f"LOCATION '{place}'"
    )
    return spark.table(name)


def write_clustered(articles: DataFrame, root: str, number: int, buckets: int) -> None:
    """Write a run's articles clustered by hash, one sorted file for each bucket; updates then join them where they lie."""
    path = f"{root}/articles/run_no={number}"
    spark, name = articles.sparkSession, _table_name(path)
    rows = articles.select(*ARTICLE_SCHEMA.names).repartition(buckets, "hash")
    rows.write.mode("overwrite").options(**KEY_FILTERS).bucketBy(buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; readers name them again, with the number of buckets in the log


def append_articles(new: DataFrame, path: str, run_no: int = 0) -> None:
    """Add rows to the folder of a run, 0 outside of runs."""
    new.select(*ARTICLE_SCHEMA.names).write.mode("append").options(**KEY_FILTERS).parquet(f"{path}/run_no={run_no}")


def write_run(new: DataFrame, path: str, run_no: int) -> None:
    """Write a run's rows over those that an earlier, unfinished attempt may have left."""
    new.select(*ARTICLE_SCHEMA.names).write.mode("overwrite").options(**KEY_FILTERS).parquet(f"{path}/run_no={run_no}")


def read_run(spark: SparkSession, path: str, run_no: int) -> DataFrame:
    return spark.read.schema(ARTICLE_SCHEMA).parquet(f"{path}/run_no={run_no}")


def absent_rows(rows: DataFrame, target: DataFrame, key: str = "hash") -> DataFrame:
    """The rows whose key the target does not hold, one per key."""
    ranked = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_row"))
    single = ranked.select(key, "_row.*").select(*rows.columns)
    return only_new(single, target, key)


def insert_if_absent(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Insert by primary key and ignore conflicts. The write commits as a whole or not at all."""
    append_articles(absent_rows(rows, load_store(spark, path)), path)


def save_bucketed(articles: DataFrame, table: str, path: str, buckets: int) -> None:
    """Write the store bucketed and sorted by hash, so that joins on the hash leave it where it is.

    The rows are brought to their bucket first, else every task would open a file in every bucket.
    """
    (
        articles.repartition(buckets, "hash")
        .write.bucketBy(buckets, "hash")
        .sortBy("hash")
        .option("path", path)
        .saveAsTable(table)
    )


def append_scores(scores: DataFrame, root: str, version: int) -> None:
    """Add score updates; ``version`` grows from run to run, and a repeated one replaces itself."""
    scores.select("hash", "score", "reason").write.mode("overwrite").parquet(f"{root}/scores/version={version}")


def append_texts(texts: DataFrame, root: str, version: int) -> None:
    texts.select("hash", "full_text_summary").write.mode("overwrite").parquet(f"{root}/texts/version={version}")


def _scores(spark: SparkSession, root: str, seen: Snapshot) -> DataFrame:
    scores = _empty_if_absent(spark, SCORES_SCHEMA, lambda: spark.read.schema(SCORES_SCHEMA).parquet(f"{root}/scores"))
    return scores.where(seen.holds(F.col("version")))


def _texts(spark: SparkSession, root: str, seen: Snapshot) -> DataFrame:
    texts = _empty_if_absent(spark, TEXTS_SCHEMA, lambda: spark.read.schema(TEXTS_SCHEMA).parquet(f"{root}/texts"))
    return texts.where(seen.holds(F.col("version")))


def _merged(articles: DataFrame, scores: DataFrame, texts: DataFrame) -> DataFrame:
    scored = merge_updates(articles, scores, "hash", ["score", "reason"], F.col("version"))
    return merge_updates(scored, texts, "hash", ["full_text_summary"], F.col("version"))


def current_articles(spark: SparkSession, root: str, seen: Snapshot | None = None) -> DataFrame:
    """The store as of now, or as a snapshot saw it: articles with their newest scores and page texts."""
    seen = seen or snapshot(spark, root)
    base, later = _stored_parts(spark, root, seen)
    scores, texts = _scores(spark, root, seen), _texts(spark, root, seen)
    merged = _merged(later, scores, texts)
    # Updates move to the clustered articles; these stay where they are.
    return merged if base is None else _merged(base, scores, texts).unionByName(merged)


def current_with_scores(spark: SparkSession, root: str, wanted, seen: Snapshot | None = None) -> DataFrame:
    """The rows of ``current_articles`` whose newest score fulfils ``wanted``, a function of the score column.

    Which rows these are is settled on hashes and scores alone and written. Whole rows are then fetched by those hashes:
    where they are few, Spark broadcasts them and no article moves before it is chosen.
    """
    seen = seen or snapshot(spark, root)
    articles, scores = stored_in(spark, root, seen), _scores(spark, root, seen)
    narrow = merge_updates(articles.select("hash", "score"), scores.select("hash", "score", "version"), "hash", ["score"], F.col("version"))
    hashes = materialize(narrow.where(wanted(F.col("score"))).select("hash").distinct(), "chosen")
    chosen = [table.join(hashes, "hash", "left_semi") for table in (articles, scores, _texts(spark, root, seen))]
    return _merged(*chosen).where(wanted(F.col("score")))


def compact(spark: SparkSession, root: str, new_root: str) -> None:
    """Write the current state as plain articles to a new root without a log; ``jobs.compact`` does it in place.

    The old root stays until the caller switches.
    """
    append_articles(current_articles(spark, root), f"{new_root}/articles")
