import numpy as np
import pandas as pd
import pytest
from cases import TEXTS, frame
from pyspark.sql import functions as F

from mailquill.llm import language_id
from mailquill.llm.common import in_fold


def plain_subwords(text):
    """Subwords of three and four bytes: spaces stand for all but letters, and only at the ends."""
    raw = b" " + text.lower().encode() + b" "
    raw = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in raw)
    out = []
    for size in language_id.SIZES:
        parts = [raw[i : i + size] for i in range(len(raw) - size + 1)]
        out += [part for part in parts if b" " not in part[1:-1]]
    return out


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_subwords(monkeypatch, size):
    whole = {text: len(plain_subwords(text)) for text in ("", "a", "ab cd, efg", "Über älter", "x" * 100, " . ", "abc " * 50)}
    reference = {text: sorted(np.concatenate([[], *language_id.subwords(text, 1 << 15)]).tolist()) for text in whole}
    monkeypatch.setattr(language_id, "SLICE", size)
    for text, n in whole.items():
        found = sorted(np.concatenate([[], *language_id.subwords(text, 1 << 15)]).tolist())
        assert len(found) == n
        assert found == reference[text]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = language_id.fit(docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", "lang"))
    assert model.languages == ("de", "en", "es", "fr")
    held = docs.where(held_out)
    found = held.select("lang", language_id.predict(held, model).alias("p")).select("lang", "p.*").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.97
    assert found["score"].between(0, 1).all()
    sure = found[found["accepted"]]
    assert (sure["lang"] == sure["lang_pred"]).mean() >= 0.98 and len(sure) > 0.8 * len(found)


def test_cases(spark):
    rows = [(str(n), f"the quick brown fox {n}", "aa") for n in range(30)] + [(str(n + 50), f"ßü größer äöü {n}", "bb") for n in range(30)]
    known = spark.createDataFrame([*rows, ("x", None, "aa"), (None, "the dog", "aa"), ("y", "zzz", None)], "id string, text string, lang string")
    model = language_id.fit(known)
    docs = frame(spark, TEXTS + [(300, "größer"), (301, "quick fox"), (302, "12 !? 4"), (303, "½ ²")])
    found = docs.select("doc_id", "text", language_id.predict(docs, model).alias("p")).select("doc_id", "text", "p.*").collect()
    assert len(found) == len(TEXTS) + 4
    for row in found:
        letters = any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] == "und") == (not letters)
        assert letters or (row["score"], row["accepted"]) == (0.0, False)
    assert {row["doc_id"]: row["lang_pred"] for row in found if row["doc_id"] in (300, 301)} == {300: "bb", 301: "aa"}


def test_same_model_from_any_order():
    text = {"aa": "the quick brown fox", "bb": "größer schöner weiter"}
    rows = [(lang, n % 5 == 0, *next(language_id.examples(f"{text[lang]} {n}", 1 << 15))) for n in range(20) for lang in text]
    table = pd.DataFrame(rows, columns=["lang", "apart", "held", "shares"])
    one = language_id.train(table, language_id.Training())
    two = language_id.train(table.sample(frac=1, random_state=3), language_id.Training())
    assert np.array_equal(one.weights, two.weights) and one.temperature == two.temperature


def test_nothing_to_learn_from(spark):
    known = spark.createDataFrame([], "id bigint, text string, lang string")
    assert language_id.fit(known) is None
    docs = frame(spark)
    found = docs.select(language_id.predict(docs, None).alias("p")).select("p.*").distinct().collect()
    assert [tuple(row) for row in found] == [("und", 0.0, False)]
