"""License notices by an exact set-similarity join, in DataFrame expressions only.

Templates are sets of words, and so is every line of a text and every window over its words. Words are ordered by the number of lines that hold them, rarest
first. A line can hold the needed share of a template only if it holds one of the template's first words in that order
(prefix), has enough template words (length) and enough of them left behind the place where both meet (position). Lines
that pass meet templates in a join on those words and are then verified, so every line over the threshold is found. Windows
are taken to the join in blocks that each hold many of them.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquill.session import materialize

# Phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# The wording of public license notices, by label.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
CONTAINMENT = 0.9
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of all templates together; they are planned into the query and their counts come to the driver.
MOST_WORDS = 20_000


def template_words(text: str) -> list[str]:
    return [word for word in dict.fromkeys(re.split(GAPS, text.lower())) if word]


def _folded(text: Column) -> Column:
    """Equal to a lower-cased A-Z for every comparison with ASCII words, at a fraction of the cost of ``translate``.

    Other letters may be folded as well, but none becomes an ASCII word: of those that lower-case to ASCII letters, the
    Kelvin sign is replaced before, and a dotted capital I keeps its dot as a letter of its own.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5")))


def _spaced(folded: Column) -> Column:
    """Words with one space before, between and after; the text is one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), folded, F.lit(" ")), GAPS, " ")


def _n_words(spaced: Column) -> Column:
    return (F.size(F.split(spaced, " ", -1)) - 2).cast("bigint")


def phrase_places(spaced: Column, phrases: dict[str, str]) -> list[Column]:
    """Columns ``n_words``, ``n_base``, ``first_word``, ``last_word`` and ``base`` (array of labels, NULLs between)."""
    n_words = _n_words(spaced)
    found = {phrase: spaced.contains(f" {phrase} ") for phrase in phrases}
    # A look-ahead keeps the space that two neighbouring places share.
    places = [F.when(found[p], F.regexp_count(spaced, F.lit(f"(?= {p} )"))).otherwise(0).cast("bigint") for p in phrases]
    first = [F.when(found[p], _n_words(F.concat(F.substring_index(spaced, f" {p} ", 1), F.lit(" ")))) for p in phrases]
    last = [
        F.when(found[p], n_words - len(p.split()) - _n_words(F.concat(F.lit(" "), F.substring_index(spaced, f" {p} ", -1))))
        for p in phrases
    ]
    nulls = [F.lit(None).cast("bigint")] * 2  # greatest and least take two values or more
    return [
        n_words.alias("n_words"),
        sum(places[1:], places[0]).alias("n_base"),
        F.least(*first, *nulls).alias("first_word"),
        F.greatest(*last, *nulls).alias("last_word"),
        F.array(*[F.when(found[p], F.lit(label)) for p, label in phrases.items()]).alias("base"),
    ]


def _held_words(folded: Column, words: list[str]) -> Column:
    """For each line the template words that it holds."""
    known = F.array(*[F.lit(word) for word in words])
    return F.transform(F.split(folded, "\n", -1), lambda line: F.array_intersect(known, F.split(line, GAPS)))


def _n_template_words(text: str) -> int:
    return len([word for word in re.split(GAPS, text.lower()) if word])


def longest_span(templates: tuple[tuple[str, str], ...]) -> int:
    """Words of the longest window; a template of n words is sought in any 2 n words that follow each other."""
    return max(2 * _n_template_words(text) for _, text in templates)


def _word_blocks(spaced: Column, lines: Column, templates: tuple[tuple[str, str], ...], containment: float, words: list[str]) -> Column:
    """Array of struct(``words``, ``held``): stretches of words whatever the lines, each of which overlaps half of the next.

    Every window of a template lies whole in one of them. Texts that do not hold the needed share of any template anywhere, by
    the template words of their ``lines``, have none.
    """
    sets = [(template_words(text), math.ceil(round(containment * len(template_words(text)), 9))) for _, text in templates]
    entries = F.array(*[F.struct(F.array(*map(F.lit, own)).alias("own"), F.lit(least).alias("least")) for own, least in sets])
    stride = longest_span(templates)
    known = F.array(*map(F.lit, words))
    held = F.array_distinct(F.flatten(lines))
    likely = F.transform(F.array(held), lambda whole: F.exists(entries, lambda t: F.size(F.array_intersect(t["own"], whole)) >= t["least"]))[0]

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words), F.lit(stride))
        blocks = F.transform(starts, lambda i: F.slice(words, i, 2 * stride))
        return F.transform(blocks, lambda own: F.struct(own.alias("words"), F.array_intersect(known, own).alias("held")))

    # A one-element array binds an expression to a name, so that it is worked out once.
    return F.when(likely, F.transform(F.array(F.split(F.trim(spaced), " ", -1)), cut)[0])


def _held_by_a_window(words: Column, own: Column, span: Column, stride: int) -> Column:
    """The most distinct words of ``own`` that one of the windows beginning in the first half of a block holds."""
    starts = F.filter(F.sequence(F.lit(1), F.least(F.size(words), F.lit(stride))), lambda i: F.array_contains(own, words[i - 1]))
    return F.coalesce(F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(own, F.slice(words, i, span))))), F.lit(0))


def global_order(lines: DataFrame, templates: tuple[tuple[str, str], ...]) -> list[str]:
    """All template words by the number of ``lines`` that hold them, rarest first."""
    words = sorted({word for _, text in templates for word in template_words(text)})
    held = lines.select(F.explode("held").alias("word"))
    frequency = {row["word"]: row["count"] for row in held.groupBy("word").count().collect()}  # one row per template word
    return sorted(words, key=lambda word: (frequency.get(word, 0), word))


def similar_lines(lines: DataFrame, templates: tuple[tuple[str, str], ...], containment: float, order: list[str]) -> DataFrame:
    """``label`` and ``contained`` for every row of ``lines`` whose ``held`` words are at least the share ``containment``
    of a template's distinct words, with the words ``own`` and the ``span`` of that template; other columns stay. ``order`` is that
    of ``global_order``; any one gives the same rows. A line may be returned once for each word of its prefix.
    """
    rank = {word: at for at, word in enumerate(order)}
    index = []
    for label, text in templates:
        own = sorted(template_words(text), key=rank.__getitem__)
        least, span = math.ceil(round(containment * len(own), 9)), 2 * _n_template_words(text)
        index += [(word, label, own, at, least, span) for at, word in enumerate(own[: len(own) - least + 1])]
    needed = min(row[4] for row in index)
    entries = [
        F.struct(
            F.lit(word).alias("word"),
            F.lit(label).alias("label"),
            F.array(*[F.lit(x) for x in own]).alias("own"),
            F.lit(i).alias("i"),
            F.lit(least).alias("least"),
            F.lit(span).alias("span"),
        )
        for word, label, own, i, least, span in index
    ]
    prefixes = lines.sparkSession.range(1).select(F.inline(F.array(*entries)))

    # array_intersect keeps the order of its first argument, so a line's words come rarest first.
    ranked = lines.where(F.size("held") >= needed).withColumn("n", F.size("held"))
    ranked = ranked.withColumn("held", F.array_intersect(F.array(*[F.lit(word) for word in order]), "held"))
    rows = ranked.select("*", F.posexplode(F.expr(f"slice(held, 1, n - {needed} + 1)")).alias("j", "word"))
    # The index has at most one row per template word: the bound that makes this broadcast safe.
    met = rows.join(F.broadcast(prefixes), "word").where(
        (F.col("n") >= F.col("least"))
        & (F.col("j") <= F.col("n") - F.col("least"))
        & (F.least(F.size("own") - F.col("i"), F.col("n") - F.col("j")) >= F.col("least"))
    )
    shared = met.withColumn("shared", F.size(F.array_intersect("held", "own"))).where("shared >= least")
    return shared.withColumn("contained", F.col("shared") / F.size("own")).select(*lines.columns, "label", "contained", "own", "least", "span")


def similar_windows(blocks: DataFrame, templates: tuple[tuple[str, str], ...], containment: float, order: list[str]) -> DataFrame:
    """``label`` and ``contained`` for every window of a template's ``span`` words that holds the needed share of it.

    ``blocks`` go through the same filters as lines do, since a block holds what a window in it holds; what passes is verified window
    by window in the same stage.
    """
    met = similar_lines(blocks, templates, containment, order)
    shared = met.withColumn("shared", _held_by_a_window(F.col("words"), F.col("own"), F.col("span"), longest_span(templates)))
    shared = shared.where("shared >= least").withColumn("contained", F.col("shared") / F.size("own"))
    return shared.select(*[c for c in blocks.columns if c not in ("words", "held")], "label", "contained")


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    wrapped: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: places of the phrases, labels and a score.

    ``n_words``, ``n_base`` (places where the words of a phrase stand one after the other, all counted), ``first_word`` and
    ``last_word`` (smallest and largest start, else NULL), ``base_labels``, ``labels`` (with those of similar lines), both
    sorted and joined by commas and empty if there are none, ``score``: 1 with a phrase, else the largest containment at or
    over the threshold, else 0. With ``wrapped`` labels and score also count notices that go over line ends: any words that follow
    each other, twice as many as the template has, are a block like a line. NULL counts as an empty text. Only A-Z are folded. Rows that repeat id and text get equal
    results, a NULL id is a value like others, other columns are ignored, an empty table gives no rows.
    """
    words = sorted({word for _, text in templates for word in template_words(text)})
    if not all(template_words(text) for _, text in templates) or not 1 <= len(words) <= MOST_WORDS:
        raise ValueError(f"templates need words, {MOST_WORDS} distinct ones together at most")
    if not all(text.isascii() for text in [*words, *phrases]):
        raise ValueError("phrases and templates must be ASCII")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary"))).alias("key")
    folded = docs.select(F.col(id_col).alias("id"), key, _folded(text).alias("folded"))
    spaced = folded.select("id", "key", "folded", _spaced(F.col("folded")).alias("spaced"))
    places = phrase_places(F.col("spaced"), phrases)
    scan = spaced.select("id", "key", "spaced", *places, _held_words(F.col("folded"), words).alias("lines"))
    if wrapped:
        scan = scan.withColumn("blocks", _word_blocks(F.col("spaced"), F.col("lines"), templates, containment, words))
    base = materialize(scan.drop("spaced"), "scan")

    lines = base.select("id", "key", F.explode("lines").alias("held"))
    order = global_order(lines, templates)
    found = similar_lines(lines, templates, containment, order).select("id", "key", "label", "contained")
    if wrapped:
        blocks = base.select("id", "key", F.explode("blocks").alias("b")).select("id", "key", "b.*")
        found = found.unionByName(similar_windows(blocks, templates, containment, order))
    hits = found.groupBy("id", "key").agg(F.max("contained").alias("contained"), F.collect_set("label").alias("more"))
    hits = materialize(hits, "license-lines").select(F.col("id").alias("id_"), F.col("key").alias("key_"), "contained", "more")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_"))
    both = base.drop("lines", "blocks").join(hits, same, "left")
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), ",")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        names(F.col("base")).alias("base_labels"),
        names(F.concat("base", more)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
