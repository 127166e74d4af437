import pytest
from pyspark.sql import functions as F

from mailquill.functions.scoring import excluded_by, parse_reply, render_prompt
from mailquill.operators.score import choose_scorer, score_articles, score_by_rules, score_with, scored_only

SAMPLE = [
    ("h1", "A Single-Atom Catalyst", "shows CO2RR by DFT"),
    ("h2", "Review of Battery Technologies", "solid state. No DFT."),
    ("h3", "Biomass for energy", "no catalyst"),
    ("h4", "Penguins", "no mention of catalysts"),
    ("h5", "Frontier", "networks and dft"),
    ("h6", "A review", None),
    ("h7", None, None),
]
SCHEMA = "hash string, title string, summary string"


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    """Else each of two tasks reads half of any table."""
    from mailquill.operators import score

    rows = spark.range(100).select(F.col("id").cast("string").alias("hash"), F.lit("a").alias("title"), F.lit("b").alias("summary"))
    scorer = lambda: lambda titles, summaries: (["High"] * len(titles), ["why"] * len(titles))
    assert score_with(rows, scorer, partitions=2).rdd.getNumPartitions() == 2
    monkeypatch.setattr(score, "TASK_BYTES", 50)
    assert score_with(rows, scorer, partitions=2).rdd.getNumPartitions() == 4
    assert score_with(rows, scorer, partitions=20).where("score = 'High'").count() == 100


def test_rules(spark):
    scored = score_by_rules(spark.createDataFrame(SAMPLE, SCHEMA))
    assert {row.hash: row.score for row in scored.collect()} == {
        "h1": "High", "h2": "Low", "h3": "Low", "h4": "High", "h5": "High", "h6": "Medium", "h7": "Low",
    }


def test_exclusion_wins_and_keeps_list_order(spark):
    scored = score_by_rules(spark.createDataFrame(SAMPLE, SCHEMA), exclude=["PENGUIN", "Catalyst"])
    rows = {row.hash: (row.score, row.reason) for row in scored.collect()}
    assert rows["h4"] == ("Low", "Auto-excluded by keyword: PENGUIN")
    assert rows["h1"] == ("Low", "Auto-excluded by keyword: Catalyst")
    assert rows["h5"][0] == "High"


def test_long_keyword_list_equals_short_one(spark):
    frame = spark.createDataFrame([("x w7 w70 w3",), ("none",), ("W59",)], "t string").select(F.lower("t").alias("t"))
    words = [f"W{n}" for n in range(59, -1, -1)]
    long = [row[0] for row in frame.select(excluded_by(F.col("t"), words)).collect()]
    short = [
        row[0]
        for row in frame.select(
            F.coalesce(*[excluded_by(F.col("t"), words[at : at + 20]) for at in range(0, 60, 20)])
        ).collect()
    ]
    assert long == short == ["W7", None, "W59"]


def test_prompt(spark):
    frame = spark.createDataFrame(SAMPLE, SCHEMA).where("hash IN ('h6', 'h7')").orderBy("hash")
    prompt = render_prompt(F.col("title"), F.col("summary"), 'Say {{"score"}} of {title}.', "as JSON")
    assert [row[0] for row in frame.select(prompt).collect()] == [
        'Say {"score"} of A review.\nas JSON\nArticle Title: A review\nArticle Summary: ',
        'Say {"score"} of .\nas JSON\nArticle Title: \nArticle Summary: ',
    ]


@pytest.mark.parametrize(
    "reply, expected",
    [
        ('{"score": "High", "reason": "r"}', ("High", "r")),
        ('\n```json\n{"reason": "a \\"b\\"\\n", "score": "Low"}\n``` ', ("Low", 'a "b"\n')),
        ('Here it is: ```{"score": "High", "reason": "r"}```', ("High", "r")),
        ('{"score": "High", "reason": "r"} and more', ("High", "r")),
        ('{"score": "High", "reason": "cut o', ("High", "cut o")),
        ('{"score": "High", "reason": "r"', ("High", "r")),
        ('{"score": "High"}', ("Error", "'reason'")),
        ('{"score": "High", "rea', ("Error", "'reason'")),
        ('{"reason": "r"}', ("Error", "'score'")),
        ("no idea", ("Error", "Invalid json output: no idea")),
        ('Answer: {"score": "High", "reason": "r"}', ("Error", 'Invalid json output: Answer: {"score": "High", "reason": "r"}')),
        ("", ("Error", "Invalid json output: ")),
        (None, ("Error", "Invalid json output: ")),
    ],
)
def test_reply(spark, reply, expected):
    frame = spark.createDataFrame([(reply,)], "r string")
    assert tuple(frame.select(parse_reply(F.col("r")).alias("v")).select("v.*").first()) == expected


def test_long_reply(spark):
    reason = "x" * 200000
    frame = spark.createDataFrame([('{"score": "High", "reason": "' + reason + '", "more": "y',)], "r string")
    row = frame.select(parse_reply(F.col("r")).alias("v")).select("v.*").first()
    assert (row.score, len(row.reason)) == ("High", 200000)


def test_own_scorer_errors_stay_in_their_row(spark):
    def failing():
        def scorer(titles, summaries):
            if any("Biomass" in title for title in titles):
                raise ValueError("model is down")
            reasons = [f"{title}/{summary}/{len(titles)}" for title, summary in zip(titles, summaries)]
            return ["High"] * len(titles), reasons

        return scorer

    scored = score_with(spark.createDataFrame(SAMPLE, SCHEMA), failing, exclude=["penguin"], partitions=1)
    rows = {row.hash: (row.score, row.reason) for row in scored.collect()}
    assert rows["h3"] == ("Error", "model is down")
    assert rows["h4"] == ("Low", "Auto-excluded by keyword: penguin")
    assert rows["h6"] == ("High", "A review//1") and rows["h7"] == ("High", "//1")
    assert scored_only(scored).count() == 7


def test_scorer_never_sees_excluded_rows(spark):
    def counting():
        def scorer(titles, summaries):
            assert not any("Penguin" in title for title in titles)
            return ["Low"] * len(titles), [str(len(titles))] * len(titles)

        return scorer

    scored = score_with(spark.createDataFrame(SAMPLE, SCHEMA), counting, exclude=["penguin"], partitions=1)
    rows = {row.hash: row.reason for row in scored.collect()}
    assert rows["h1"] == "6" and rows["h4"].startswith("Auto-excluded")


def test_wrong_length_is_an_error(spark):
    scored = score_with(spark.createDataFrame(SAMPLE, SCHEMA), lambda: lambda titles, summaries: ([], []))
    assert {row.score for row in scored.collect()} == {"Error"}


def test_choice_of_scorer(spark):
    def needs_key(model):
        raise ValueError("no key")

    providers = {"openai": lambda model: ("openai", model), "broken": needs_key}
    assert choose_scorer("gpt", providers) == ("openai", "gpt")
    assert choose_scorer("OpenAI:a:b", providers) == ("openai", "a:b")
    assert choose_scorer("other:x", providers) is None
    assert choose_scorer("broken:x", providers) is None
    frame = spark.createDataFrame(SAMPLE, SCHEMA)
    assert score_articles(frame).where("score = 'High'").count() == 3


@pytest.mark.parametrize("words", [["A", "a", "bb"], ["b", "", "a"], ["İx", "ΣΑΣ", "ß", "ﬁ"], [f"w{n}" for n in range(500)], ["abc", "bc", "c", None]])
def test_automaton_equals_plain_search(spark, words):
    import random

    from mailquill.functions.keywords import first_keyword

    draw = random.Random(1)
    letters = ["a", "b", "c", "w1", "w12", "İx", "ΣΑΣ σας", "ß", "SS", "ﬁ", " ", "W499 "]
    texts = [(n, "".join(draw.choice(letters) for _ in range(draw.randint(0, 9)))) for n in range(300)] + [(300, None), (301, "")]
    frame = spark.createDataFrame(texts, "n int, t string").select("n", F.lower("t").alias("t"))
    known = [word for word in words if word is not None]
    found = frame.select("n", first_keyword(F.col("t"), words).alias("one"), excluded_by(F.col("t"), known[:100]).alias("two")).collect()
    assert all(row["one"] == row["two"] for row in found if row["two"] is not None or len(known) <= 100)
    assert len({row["one"] for row in found}) > 1


def test_a_long_list_costs_no_more_than_a_short_one(spark):
    import time

    texts = spark.range(4000).select(F.concat_ws(" ", *[F.sha2((F.col("id") + n).cast("string"), 256) for n in range(30)]).alias("t")).cache()
    texts.count()

    def seconds(n):
        column = excluded_by(F.col("t"), [f"keyword{k}" for k in range(n)])
        texts.select(column).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        texts.select(column).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    assert seconds(20_000) < 3 * seconds(101) + 1


def test_calls_side_by_side_in_one_task(spark):
    import threading
    import time

    from mailquill.operators.score import Calls

    def make():
        def scorer(titles, summaries):
            time.sleep(0.05 * len(titles))
            return [title.upper() for title in titles], [threading.current_thread().name] * len(titles)

        return scorer

    frame = spark.range(160).select(F.col("id").cast("string").alias("hash"), F.format_string("t%d", "id").alias("title"), F.lit("").alias("summary")).coalesce(1)
    seconds, found = {}, {}
    for workers in (1, 8):
        for _ in range(2):  # the first run starts the Python worker
            began = time.perf_counter()
            found[workers] = score_with(frame, make, calls=Calls(workers=workers)).collect()
            seconds[workers] = time.perf_counter() - began
    assert {(row.title.upper(), row.score) for row in found[8]} == {(f"T{n}", f"T{n}") for n in range(160)}
    assert len({row.reason for row in found[8]}) == 8
    assert seconds[1] > 8 and seconds[8] < seconds[1] / 4


def test_failing_calls_are_repeated_and_then_errors(spark):
    from mailquill.operators.score import Calls

    def make():
        tries = {}

        def scorer(titles, summaries):
            place = tuple(titles)
            tries[place] = tries.get(place, 0) + 1
            if "t7" in place or tries[place] < 3:
                raise OSError(f"busy {len(place)}")
            return ["High"] * len(titles), [str(tries[place])] * len(titles)

        return scorer

    frame = spark.range(30).select(F.format_string("t%d", "id").alias("title"), F.lit("").alias("summary")).coalesce(1)
    rows = score_with(frame, make, calls=Calls(workers=3, rows=10, retries=2, pause=0.001)).collect()
    assert {row.title for row in rows if row.score == "Error"} == {"t7"}
    assert [row.reason for row in rows if row.title == "t7"] == ["busy 1"]
    assert [row.reason for row in rows if row.title == "t25"] == ["3"]
