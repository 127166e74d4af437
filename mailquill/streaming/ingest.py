"""Mail files as a stream: each new file is read once, parsed, and its new articles are stored."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mailquill.operators.dedup import FEW_KEYS
from mailquill.operators.explode import explode_alerts
from mailquill.operators.score import score_articles
from mailquill.plans.digest import DigestSettings, new_articles
from mailquill.schema import ARTICLE_SCHEMA, MAIL_SCHEMA
from mailquill.session import intermediate_data, shared_folder
from mailquill.sources import runs
from mailquill.sources import store as article_store

STORED_SCHEMA = T.StructType([*ARTICLE_SCHEMA, T.StructField("batch_id", T.LongType())])


def stored_articles(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(STORED_SCHEMA).parquet(store)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED_SCHEMA)


def store_batch(mail: DataFrame, batch_id: int, store: str, added_at: str, work: str) -> None:
    """Store the new articles of one batch in a folder of its own.

    A batch that is replayed after a failure looks only at earlier batches and overwrites its own folder, so it stores
    the same rows again and not twice. The store is probed with the batch, which is written to
    ``work`` over the one before: the store grows without end, a batch does not.
    """
    earlier = stored_articles(mail.sparkSession, store).where(F.col("batch_id") < batch_id)
    new = new_articles(explode_alerts(mail), earlier, added_at, work)
    new.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


def compact_batches(spark: SparkSession, store: str, new_store: str) -> None:
    """Write a stopped stream's store to a new one: all closed batches in one folder, the last one in its own.

    The last batch may still be replayed and must stay apart. The stream goes on with ``new_store`` and its old checkpoint;
    the old store stays until the caller switches.
    """
    stored = stored_articles(spark, store)
    last = stored.agg(F.max("batch_id").alias("last")).first()["last"]
    if last is not None:
        closed = stored.where(F.col("batch_id") < last).drop("batch_id")
        closed.write.mode("overwrite").parquet(f"{new_store}/batch_id=-1")
        open_ = stored.where(F.col("batch_id") == last).drop("batch_id")
        open_.write.mode("overwrite").parquet(f"{new_store}/batch_id={last}")


def start_ingest(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    sender: str,
    added_at: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Ingest every file in ``source`` that was not read before, then stop. The checkpoint is the run state.

    Deduplication is against the store and not in stream state: a title from long ago must still be dropped, and stream
    state would have to hold every title ever seen. Articles stored before the stream began belong in a folder
    ``batch_id=-1`` of the store, which belongs to this stream alone; ``start_run_ingest`` shares one with the commands.
    """
    work = shared_folder(spark, "first")
    mail = (
        spark.readStream.schema(MAIL_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .where(F.lower("sender") == sender.lower())
    )
    return (
        mail.writeStream.foreachBatch(lambda batch, batch_id: store_batch(batch, batch_id, store, added_at, work))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: A batch that another run overtook is looked at again against what that run stored, so many times.
ATTEMPTS = 5


def store_run(mail: DataFrame, batch_id: int, root: str, settings: DigestSettings, stream: str) -> int | None:
    """Store the new articles of one batch, scored, as a run of the root's log; returns its number.

    The log tells whether a batch of a stream was stored: one that Spark replays after a failure is stored once, and None is returned
    for it. It is compared with all that commands and streams have committed below the root.
    """
    spark = mail.sparkSession
    if runs.has_batch(spark, root, stream, batch_id):
        return None
    for attempt in range(ATTEMPTS):
        with intermediate_data(spark):
            number = runs.reserve(spark, root)
            seen = runs.snapshot(spark, root)
            new = new_articles(explode_alerts(mail), article_store.stored_in(spark, root, seen), settings.run_time, few=FEW_KEYS)
            scored = score_articles(new, settings.scorer, settings.rules, settings.exclude, settings.partitions, settings.calls)
            article_store.write_run(scored, f"{root}/articles", number)
            try:
                runs.commit(spark, root, number, runs.STREAM, seen, stream=stream, batch_id=batch_id)
                return number
            except runs.RunConflict:
                if attempt == ATTEMPTS - 1:
                    raise
    return None


def start_run_ingest(
    spark: SparkSession, source: str, root: str, checkpoint: str, settings: DigestSettings, files_per_batch: int = 1000
) -> StreamingQuery:
    """Ingest every file in ``source`` that was not read before into the articles below ``root``, then stop.

    The commands of ``plans.jobs`` and any number of streams, each with a checkpoint of its own, can take turns over one root.
    ``source`` is a folder of the stream's own and not the root's ``mail``, whose deliveries ``jobs.fetch`` reads.
    """
    mail = (
        spark.readStream.schema(MAIL_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .where(F.lower("sender") == settings.sender.lower())
    )
    # The query's id is written in its checkpoint when it first starts; batch numbers are counted for it.
    return (
        mail.writeStream.foreachBatch(
            lambda batch, batch_id: store_run(batch, batch_id, root, settings, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
