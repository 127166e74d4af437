"""Long keyword lists: one automaton finds all of them in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _lowered(words: list[str]) -> list[str]:
    """As Spark lower-cases texts; Python differs from it in a few letters beyond ASCII."""
    if all(word.isascii() for word in words):
        return [word.lower() for word in words]
    rows = SparkSession.active().createDataFrame(list(enumerate(words)), "no long, word string")
    return [row["word"] for row in rows.select("no", F.lower("word").alias("word")).orderBy("no").collect()]


def first_keyword(text: Column, keywords) -> Column:
    """First keyword, in list order, that occurs in the lower-cased ``text``; NULL when none does, or no text.

    An Aho-Corasick automaton, built once for a Python worker's task, meets each character once whatever the length of the list;
    of the keywords that it reports the one with the smallest place in the list is taken. Only the texts go to Python.
    """
    words = [word for word in keywords if word is not None]
    lowered = _lowered(words)
    places: dict[str, int] = {}
    for place, word in enumerate(lowered):
        places.setdefault(word, place)
    always = places.pop("", len(words))  # an empty keyword is in every text

    @F.pandas_udf("string")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, place in places.items():
            automaton.add_word(word, place)
        automaton.make_automaton()

        def search(value):
            if value is None:
                return None
            place = min((place for _, place in automaton.iter(value)), default=always) if places else always
            place = min(place, always)
            return words[place] if place < len(words) else None

        for batch in batches:
            yield pd.Series([search(value) for value in batch], dtype="object")

    return first(text)
