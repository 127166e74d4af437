"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; ``lower`` would also fold other letters."""
    return F.translate(text, UPPER, UPPER.lower())


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a row without an id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def row_place(row_id: Column, text: Column) -> Column:
    """16 bytes that name a row by id (or its lack) and text. Rows that repeat both are one place."""
    own = F.coalesce(F.concat(F.lit("i"), row_id.cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(own, F.lit("/"), F.md5(text.cast("binary"))).cast("binary")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_sample(df: DataFrame, by: str, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows at most of each value of ``by``, always the same ones: a fraction by hash of ``key``.

    Only for fitting classifiers. The values of ``by`` are classes and few, so their counts come to the driver.
    """
    counts = {row[by]: row["count"] for row in df.groupBy(by).count().collect() if row[by] is not None}
    if not counts:
        return df.limit(0)
    shares = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, bound / n))])
    place = F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(F.col(by).isNotNull() & (place < shares[F.col(by)]))


#: Texts that a Python worker holds at once beside the batch it got.
SLICE = 256


def slices(batch: pd.Series, characters: int | None = None) -> Iterable[list[str]]:
    """The texts of a batch, few or so many characters at a time, with NULL as empty."""
    part, size = [], 0
    for text in batch:
        part.append(text or "")
        size += len(part[-1])
        if size >= characters if characters else len(part) == SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


class RecentTable:
    """A task's table of distinct words, each worked out once while it is in use.

    ``fill`` gives the values of new words. Two generations of at most ``limit`` words (or one slice's) bound the memory:
    a full one becomes the old one, from which words move over when they come again, and the former old one is dropped.
    """

    def __init__(self, fill: Callable[[list[str]], Iterable], limit: int = 250_000):
        self.fill, self.limit, self.young, self.old = fill, limit, {}, {}

    def of(self, words: set[str]) -> dict:
        """A table that holds all of ``words``."""
        new = words.difference(self.young)
        if new and len(self.young) + len(new) > self.limit:
            self.young, self.old, new = {}, self.young, words
        unknown = []
        for word in new:
            if word in self.old:
                self.young[word] = self.old[word]
            else:
                unknown.append(word)
        self.young.update(zip(unknown, self.fill(unknown)))
        return self.young
