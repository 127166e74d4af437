"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_RUN: ContextVar[str | None] = ContextVar("run", default=None)

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small Arrow batches keep one batch of whole mails well inside a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor can reach, below one folder of the running job or application.

    The cluster names its place in ``spark.checkpoint.dir``. A machine-local folder is used only where that is unset and
    the master is ``local`` or ``local[...]``, where one machine is all there is.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.gettempdir()
    run = _RUN.get() or spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/mailquill-{run}/{name}-{uuid.uuid4().hex}"


@contextmanager
def intermediate_data(spark: SparkSession):
    """Intermediate tables of the job inside go to a folder of their own, which is removed at the end.

    Frames that read them must be written or collected before.
    """
    token = _RUN.set(uuid.uuid4().hex)
    folder = shared_folder(spark, "end").rsplit("/", 1)[0]
    try:
        yield
    finally:
        _RUN.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: With it Spark removes an execution's shuffle files at its end and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str = "cut", path: str | None = None) -> DataFrame:
    """Write ``df`` to a new shared folder, or over ``path``, and read it back.

    The files survive lost executors, later readers prune columns in them, and their size on disk gives the planner real
    statistics for its broadcast decisions. The shuffle files that led to them are of no more use and go at once.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark, name)
    with _setting(spark, CLEANUP, "true"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
