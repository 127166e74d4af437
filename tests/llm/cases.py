"""Rows that every operator must take: NULLs, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score string, removed string, hash string"

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
LINES = "first line of words here\nsecond line of words\nthird one\nfourth line, too\nfifth\nsixth line of this text\nthe end."

TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "two words"),
    (6, LONG),
    (7, LINES),
    (8, LINES),
    (8, LINES),
    (9, LINES + "\nand one more."),
    (None, LINES),
    (None, None),
    (10, "Ünïcödé ΣΑΣ İstanbul ﬁ     é 😀"),
    (11, "x" * 300_000),
    (12, LONG.upper()),
    (13, "!!! ??? 123"),
]


def rows(texts=TEXTS):
    return [(i, text, None, "s", None, "own", None, "x", "y") for i, text in texts]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def by_id(found, key="doc_id"):
    out = {}
    for row in found.collect():
        out.setdefault(row[key], []).append(row)
    return out
