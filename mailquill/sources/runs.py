"""The run log of a root folder, shared by every command and stream that writes below it.

A run reserves a number, writes articles, scores, texts and what it consumed into folders of that number, and commits by one row
of ``state``. Readers take the log as a snapshot and see the folders of committed runs only. What a failed run left is never
seen, whichever command comes next, since its number is never given again.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquill.schema import LOG_SCHEMA, STATE_SCHEMA
from mailquill.sources import state as run_state

FETCH, SCORE, SINCE, STREAM, COMPACT = "fetch", "score", "since", "stream", "compact"
#: Runs that store articles; two that did not see each other may have stored the same ones.
STORING = (FETCH, STREAM)


class RunConflict(RuntimeError):
    """Another run committed meanwhile what this one did not look at. Nothing is committed; run it again."""


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """One row for each committed run."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/state")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


@dataclass(frozen=True)
class Snapshot:
    """The runs whose folders count. ``numbers`` is None where no run was ever begun: then all that is there counts.

    ``committed`` holds number and kind of every run, ``replaced`` the numbers that a compaction took in; 0 stands for what was
    written outside of runs. That is one number for each run, not for each row. ``base`` is the run and the number of buckets of the
    articles that the last compaction has clustered by hash.
    """

    committed: tuple[tuple[int, str], ...]
    replaced: frozenset[int]
    begun: bool
    base: tuple[int, int] | None = None

    @property
    def numbers(self) -> list[int] | None:
        return sorted({0, *(n for n, _ in self.committed)} - self.replaced) if self.begun else None

    def holds(self, number: Column) -> Column:
        """Condition on the folder's number, for pruning. Files outside of a run's folder are of run 0."""
        if self.numbers is None:
            return F.lit(True)
        return F.coalesce(number, F.lit(0)).isin(self.numbers) if 0 in self.numbers else number.isin(self.numbers)


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    place, files = _file_system(spark, f"{root}/state")
    rows = read_log(spark, root).select("run_no", "kind", "replaces", "buckets").collect()  # one for each run
    replaced = frozenset(n for row in rows for n in row["replaces"] or ())
    bases = [(row["run_no"], row["buckets"]) for row in rows if row["buckets"] and row["run_no"] not in replaced]
    committed = tuple((row["run_no"], row["kind"] or FETCH) for row in rows)
    return Snapshot(committed, replaced, bool(rows) or files.exists(place), max(bases, default=None))


def reserve(spark: SparkSession, root: str) -> int:
    """A number that no other run below ``root`` gets, whether or not this one is ever committed."""
    number = (read_log(spark, root).agg(F.max("run_no")).first()[0] or 0) + 1
    while True:
        place, files = _file_system(spark, f"{root}/state/_numbers/{number}")
        try:
            if files.createNewFile(place):
                return number
        except Py4JJavaError as problem:
            if "FileAlreadyExists" not in problem.java_exception.getClass().getName():
                raise
        number += 1


def commit(
    spark: SparkSession, root: str, number: int, kind: str, seen: Snapshot, state: dict | None = None,
    stream: str | None = None, batch_id: int | None = None, replaces: list[int] | None = None, buckets: int | None = None,
) -> None:
    """Append the run's row. Before that, nobody sees the run; after it, everybody does.

    A run that stores articles must have seen all others that do, and a compaction all others of its kind; else ``RunConflict``.
    The check and the row are two steps, so two commits in the same instant pass it; runs that overlap longer are told.
    """
    now = snapshot(spark, root)
    new = {kind for number, kind in now.committed if (number, kind) not in set(seen.committed)}
    if kind in STORING and new & set(STORING) or kind == COMPACT and COMPACT in new:
        raise RunConflict(f"run {number} ({kind}) did not see a run that was committed meanwhile")
    row = {"run_no": number, "kind": kind, "stream": stream, "batch_id": batch_id, "replaces": replaces, "buckets": buckets, **(state or {})}
    run_state.write_state(spark.createDataFrame([tuple(row.get(name) for name in LOG_SCHEMA.names)], LOG_SCHEMA), f"{root}/state")


def has_batch(spark: SparkSession, root: str, stream: str, batch_id: int) -> bool:
    """Whether a batch of a stream is committed already; after a failure Spark gives the last one again."""
    return not read_log(spark, root).where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).isEmpty()


def bound(spark: SparkSession, root: str) -> tuple[float | None, bool]:
    """Date of the newest mail seen, or a bound set by hand, and whether it is the latter and no mail was fetched since."""
    rows = read_log(spark, root).where(F.col("kind").isNull() | F.col("kind").isin(FETCH, SINCE))
    last = rows.agg(F.max_by(F.struct(*STATE_SCHEMA.names, "kind"), "run_no").alias("last")).first()["last"]
    if last is None:
        return None, False
    by_hand = last["kind"] == SINCE or last["kind"] is None and last["last_arrival"] is None
    return last["last_run"], by_hand and last["last_run"] is not None


def unused_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders of runs that were replaced, or begun and not committed. A run that is going on is one of these."""
    keep = snapshot(spark, root).numbers
    found = []
    for table in ("articles/run_no", "scores/version", "texts/version", "consumed/run_no"):
        place, files = _file_system(spark, f"{root}/{table.split('/')[0]}")
        for status in files.listStatus(place) if keep is not None and files.exists(place) else ():
            name, _, number = status.getPath().getName().partition("=")
            # What was consumed stays consumed when articles are compacted.
            known = {n for n, _ in snapshot(spark, root).committed} if table.startswith("consumed") else set(keep)
            if name == table.split("/")[1] and number.isdigit() and int(number) not in known:
                found.append(f"{root}/{table.split('/')[0]}/{name}={number}")
    return sorted(found)


def remove_unused(spark: SparkSession, root: str) -> list[str]:
    """Delete ``unused_folders``; only while no run goes on and nobody reads an older snapshot."""
    folders = unused_folders(spark, root)
    for folder in folders:
        place, files = _file_system(spark, folder)
        files.delete(place, True)
    return folders
