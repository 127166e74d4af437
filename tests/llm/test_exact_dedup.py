import hashlib
from collections import Counter, defaultdict

import pytest
from cases import TEXTS, frame

from mailquill.llm.exact_dedup import exact_duplicates


@pytest.mark.parametrize("largest", [False, True])
def test_like_a_plain_grouping(spark, largest):
    groups = defaultdict(list)
    for doc_id, text in TEXTS:
        groups[text or ""].append(doc_id)
    pick = max if largest else min
    keep = {text: pick([i for i in ids if i is not None], default=None) for text, ids in groups.items()}
    want = Counter()
    for text, ids in groups.items():
        sha, stays = hashlib.sha256(text.encode()).hexdigest(), True
        for doc_id in ids:
            kept = doc_id == keep[text] and stays
            stays = stays and not kept
            want[doc_id, keep[text], len(ids), kept, sha] += 1
    assert Counter(tuple(row) for row in exact_duplicates(frame(spark), largest=largest).collect()) == want


def test_empty_table(spark):
    assert exact_duplicates(frame(spark, [])).collect() == []


def test_hot_group(spark):
    texts = [(i, "same" if i % 3 else f"own {i}") for i in range(900)]
    found = exact_duplicates(frame(spark, texts)).collect()
    assert sum(row["kept"] for row in found) == 301
    assert {row["keep_id"] for row in found if row["group_size"] > 1} == {1}


def test_copies_are_combined_before_the_last_shuffle_without_broadcasts(spark, monkeypatch):
    """The join on parts of a hash, then partial counts by the bytes, then the exchange on hash and bytes."""
    from mailquill.llm import exact_dedup

    plans = []
    real = exact_dedup.materialize

    def noted(df, name="cut", path=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, path)

    monkeypatch.setattr(exact_dedup, "materialize", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [(i, "same" if i % 3 else f"own {i}") for i in range(300)]
        assert sum(row["kept"] for row in exact_duplicates(frame(spark, texts)).collect()) == 101
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = dict(plans)["classes"]
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    places = [next(k for k, line in enumerate(lines) if mark in line) for mark in ("Exchange hashpartitioning(hash", "partial_count", "SortMergeJoin", "salt")]
    assert "text" in lines[places[0]] and places[0] < places[1] < places[2]
    assert sum("Exchange hashpartitioning(hash" in line and "salt" in line for line in lines) == 2
