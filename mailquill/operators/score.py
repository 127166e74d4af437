"""Score articles: keyword exclusion first, then word rules or a scorer of the user's own."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquill.functions.scoring import ERROR, LOW, WordRules, exclusion_reason, rule_score
from mailquill.functions.text import score_text
from mailquill.session import materialize

# (titles, summaries) -> (scores, reasons), all of one length
BatchScorer = Callable[[pd.Series, pd.Series], tuple[Sequence[str], Sequence[str]]]

DEFAULT_PROVIDER = "openai"


def score_by_rules(df: DataFrame, rules: WordRules = WordRules(), exclude: Sequence[str] = ()) -> DataFrame:
    """``score`` and ``reason`` as native columns, in one pass without shuffle."""
    texts = df.withColumn("_text", score_text(F.col("title"), F.col("summary")))
    judged = texts.withColumn("_why", exclusion_reason(F.col("_text"), list(exclude))).withColumn(
        "_verdict", rule_score(F.col("_text"), rules)
    )
    return judged.select(
        *[name for name in df.columns if name not in ("score", "reason")],
        F.when(F.col("_why").isNotNull(), F.lit(LOW)).otherwise(F.col("_verdict.score")).alias("score"),
        F.coalesce("_why", "_verdict.reason").alias("reason"),
    )


@dataclass(frozen=True)
class Calls:
    """How a scorer is called inside a task: ``workers`` calls side by side, each on up to ``rows`` rows (default: evenly).

    A call that fails is repeated ``retries`` times, after ``pause`` seconds and twice as long each time.
    """

    workers: int = 1
    rows: int | None = None
    retries: int = 0
    pause: float = 1.0


def _guarded(make_scorer: Callable[[], BatchScorer], calls: Calls = Calls()):
    """Arrow-batched scoring of the rows that need it.

    The scorer is made once per task, or once for each of its workers. Calls of a batch run side by side and their results are put
    back by place. When a call fails for good, it is repeated row by row and only the failing rows become errors.
    """

    def score_batches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = threading.local()

        def call(titles: pd.Series, summaries: pd.Series) -> tuple[list, list]:
            if not hasattr(own, "scorer"):
                own.scorer = make_scorer()
            for attempt in range(calls.retries + 1):
                try:
                    scores, reasons = (list(part) for part in own.scorer(titles, summaries))
                    if len(scores) != len(titles) or len(reasons) != len(titles):
                        raise ValueError("the scorer must return one score and one reason per row")
                    return scores, reasons
                except Exception:
                    if attempt == calls.retries:
                        raise
                    time.sleep(calls.pause * 2**attempt)
            raise AssertionError

        def score(part: tuple[pd.Series, pd.Series]) -> tuple[list, list]:
            titles, summaries = part
            try:
                return call(titles, summaries)
            except Exception as problem:
                if len(titles) == 1:
                    return ["Error"], [str(problem)]
            single = [score((titles.iloc[at : at + 1], summaries.iloc[at : at + 1])) for at in range(len(titles))]
            return [scores[0] for scores, _ in single], [reasons[0] for _, reasons in single]

        # The pool belongs to the task; only one Arrow batch and its calls are held at a time.
        pool = ThreadPoolExecutor(calls.workers) if calls.workers > 1 else None
        try:
            for titles, summaries, wanted in batches:
                out = pd.DataFrame({"score": None, "reason": None}, index=titles.index, dtype="object")
                mask = wanted.astype(bool)
                if mask.any():
                    some_titles, some_summaries = titles[mask].fillna(""), summaries[mask].fillna("")
                    rows = calls.rows or -(-len(some_titles) // calls.workers)
                    parts = [
                        (some_titles.iloc[at : at + rows], some_summaries.iloc[at : at + rows])
                        for at in range(0, len(some_titles), rows)
                    ]
                    found = list(pool.map(score, parts) if pool else map(score, parts))
                    for name, column in zip(("score", "reason"), zip(*found)):
                        values = [value for part in column for value in part]
                        out.loc[mask, name] = pd.Series(values, index=some_titles.index, dtype="object")
                yield out
        finally:
            if pool:
                pool.shutdown(wait=True, cancel_futures=True)

    return score_batches


#: Texts that one task scores, on the average.
TASK_BYTES = 256_000_000


def score_with(
    df: DataFrame,
    make_scorer: Callable[[], BatchScorer],
    exclude: Sequence[str] = (),
    partitions: int | None = None,
    calls: Calls = Calls(),
) -> DataFrame:
    """``score`` and ``reason`` from a scorer of the user's own.

    Excluded rows pass through the same batches, but the scorer never sees them: a Python function under ``CASE WHEN``
    would be called for every row. ``partitions`` sets how many tasks there are, and ``calls`` how many calls of each run side by
    side, on which a slow remote model depends; the scorer is made once for each worker and not shared. The rows are written before
    they are dealt out: where their texts are more than ``TASK_BYTES`` a task, there are more tasks, and calls in flight are bounded by
    the cores times ``calls.workers``. Write the result (see ``session.materialize``) before using it twice, or the scorer is called
    again.
    """
    if partitions is not None:
        by = ["hash"] if "hash" in df.columns else []
        df = materialize(df, "unscored")
        size = df.agg(F.sum(F.coalesce(F.octet_length("title"), F.lit(0)) + F.coalesce(F.octet_length("summary"), F.lit(0)))).first()[0]
        df = df.repartition(max(partitions, -(-(size or 0) // TASK_BYTES)), *by)
    call = F.pandas_udf(_guarded(make_scorer, calls), "score string, reason string").asNondeterministic()
    why = exclusion_reason(score_text(F.col("title"), F.col("summary")), list(exclude))
    judged = df.withColumn("_why", why).withColumn("_verdict", call("title", "summary", F.col("_why").isNull()))
    return judged.select(
        *[name for name in df.columns if name not in ("score", "reason")],
        F.when(F.col("_why").isNotNull(), F.lit(LOW))
        .otherwise(F.coalesce("_verdict.score", F.lit(ERROR)))
        .alias("score"),
        F.coalesce("_why", "_verdict.reason").alias("reason"),
    )


def choose_scorer(
    identifier: str, providers: dict[str, Callable[[str], Callable[[], BatchScorer]]]
) -> Callable[[], BatchScorer] | None:
    """Scorer for ``provider:model``; without a colon the default provider is meant. None: use the word rules."""
    provider, colon, model = identifier.partition(":")
    if not colon:
        provider, model = DEFAULT_PROVIDER, identifier
    make = providers.get(provider.lower())
    if make is None:
        return None
    try:
        return make(model)
    except (ValueError, ImportError):
        return None


def score_articles(
    df: DataFrame,
    scorer: Callable[[], BatchScorer] | None = None,
    rules: WordRules = WordRules(),
    exclude: Sequence[str] = (),
    partitions: int | None = None,
    calls: Calls = Calls(),
) -> DataFrame:
    if scorer is None:
        return score_by_rules(df, rules, exclude)
    return score_with(df, scorer, exclude, partitions, calls)


def scored_only(df: DataFrame) -> DataFrame:
    """Rows that have a score. ``Error`` is a score."""
    return df.where(F.col("score").isNotNull())
