import numpy as np
import pytest
from cases import TEXTS, frame
from pyspark.sql import functions as F

from mailquill.llm import toxicity
from mailquill.llm.common import in_fold

LEXICON = toxicity.Lexicon({"grum": 2.0, "bla ": 1.0})


def features(text):
    return dict(zip(toxicity.FEATURES, toxicity.Scorer(LEXICON).features([text])[0]))


def test_lexicon_reads_beginnings_and_words():
    assert LEXICON.weight("grumble") == LEXICON.weight("grum") == 2.0
    assert LEXICON.weight("bla") == 1.0 and LEXICON.weight("blab") == LEXICON.weight("gru") == 0.0


@pytest.mark.parametrize(
    "text, plain, weak, threats, targeted",
    [
        ("nothing here", 0, 0, 0, 0),
        ("a grumble", 2.0, 0, 0, 0),
        ("you grumble", 4.0, 0, 0, 1),
        ("grumble, you", 2.0, 0, 0, 0),
        ("grumble like you", 4.0, 0, 0, 1),
        ("grumble grumble", 2.0 + 3.0, 0, 0, 0),
        ("not a grumble", 0, 0.6, 0, 0),
        ("not one two three grumble", 2.0, 0, 0, 0),
        ("he said grumble", 0, 1.0, 0, 0),
        ('the word "grumble" stands', 0, 1.0, 0, 0),
        ("i will kill you", 0, 0, 2.0, 1),
        ("i will not kill you", 0, 0.3, 0, 0),
        ("kill the process", 0, 0, 0, 0),
        ("GRUMBLE. you", 2.0, 0, 0, 0),
    ],
)
def test_clauses(text, plain, weak, threats, targeted):
    found = features(text)
    want = {"plain": plain, "weak": weak, "threats": threats, "targeted": targeted}
    assert {name: found[name] for name in want} == pytest.approx({name: np.log1p(x) for name, x in want.items()})


def test_composition_equals_one_after_the_other():
    machines = [
        toxicity.Transducer((False,), toxicity.insult_run),
        toxicity.Transducer((0,), toxicity.threat),
        toxicity.Transducer((0,), toxicity.negation),
        toxicity.Transducer((False, False), toxicity.reported),
        toxicity.Transducer((False, False), toxicity.target, lambda state: 2.0 if all(state) else 1.0),
    ]
    draw = np.random.default_rng(1)
    for _ in range(300):
        word = draw.choice(list("oitmMnrq"), size=draw.integers(0, 12))
        states, weights, outs = [m.start for m in machines], [], []
        for symbol in word:
            weight = 1.0
            for k, machine in enumerate(machines):
                states[k], symbol, more = machine.step(states[k], symbol)
                weight *= more
            weights.append(weight)
            outs.append(symbol)
        state, found = 0, []
        for symbol in word:
            state, out, weight = toxicity.TABLE[state, str(symbol)]
            found.append((out, weight))
        assert found == list(zip(outs, weights))
        assert toxicity.ENDS[state] == machines[-1].end(states[-1])


def test_held_out_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    held_out = in_fold(F.col("id"), 4, 2)
    model = toxicity.fit(docs, labels.where(~held_out))
    held = docs.where(held_out)
    found = held.select("id", toxicity.score(held, model).alias("score")).join(labels, "id").toPandas()
    assert found["score"].between(0, 1).all()
    toxic = found["toxic"] == 1
    ranks = found["score"].rank()
    n = toxic.sum()
    assert (ranks[toxic].sum() - n * (n + 1) / 2) / (n * (~toxic).sum()) > 0.93
    predicted = found["score"] >= 0.3
    assert toxic[predicted].mean() > 0.85 and predicted[toxic].mean() > 0.85


def test_cases_and_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([], "id bigint, toxic int")
    docs = frame(spark, TEXTS + [(300, "you stupid idiot"), (301, "a calm text")])
    known = docs.select(F.col("doc_id").alias("id"), "text")
    model = toxicity.fit(known, labels)
    found = docs.select("doc_id", "text", toxicity.score(docs, model).alias("x")).collect()
    assert len(found) == len(TEXTS) + 2
    low = {row["x"] for row in found if row["doc_id"] != 300}
    assert len(low) == 1 and max(low) < 0.3
    assert next(row["x"] for row in found if row["doc_id"] == 300) > 0.5
    assert frame(spark, []).select(toxicity.score(docs, model)).collect() == []


def test_odd_labels(spark):
    texts = [(n, f"plain text number {n} of many" + (" snarfle now" if n % 4 == 0 else "")) for n in range(200)]
    docs = frame(spark, texts + [(None, "snarfle"), (500, None)]).select(F.col("doc_id").alias("id"), "text", F.lit(9).alias("toxic"))
    marks = [(n, int(n % 4 == 0)) for n in range(200)] + [(3, None), (None, 1), (4, 0), (4, 1), (7, 5), (500, 0)]
    labels = spark.createDataFrame(marks, "id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.lexicon.weight("snarfle") > 2 and model.lexicon.weight("plain") == 0
    found = docs.select("id", "text", toxicity.score(docs, model).alias("x")).collect()
    assert all((row["x"] >= 0.3) == ("snarfle" in (row["text"] or "")) for row in found)
