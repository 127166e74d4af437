import math
import random
from collections import Counter

import numpy as np
import pytest

from mailquill.llm import hard_negatives
from mailquill.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, row string, anchor int"


def plain(rows):
    """Rows (id, vector, label) -> the result, pair by pair."""
    taken = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        taken.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = Counter()
    rank = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    for k, (anchor, a, label) in enumerate(taken):
        if anchor is None or anchor % 50:
            continue
        scores = [(sum(x * y for x, y in zip(a, b)), other, own, j) for j, (other, b, own) in enumerate(taken)]
        for ps, positive, _, _ in rank(s for s in scores if s[2] == label and s[3] != k)[:5]:
            window = rank(s for s in scores if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps)
            for place, (ns, negative, _, _) in enumerate(window[:3]):
                out[anchor, positive, place + 1, negative, ps, ns] += 1
    return out


def mined(spark, rows):
    table = spark.createDataFrame([(*row, "s", "r", 1) for row in rows], SCHEMA).repartition(3)
    label = F.col("label").cast("bigint")
    vectors = table.select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        hard_negatives.scaled(F.col("embedding")).alias("vector"), "score", "row", "anchor",
    )
    return Counter(map(tuple, hard_negatives.mine_hard_negatives(vectors, F.col("id") % 50 == 0).collect()))


def clusters(seed, n, dims, spread, skew=False):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, dims))
    rows = []
    for i in range(n):
        v = centres[draw.integers(4)] + spread * draw.normal(size=dims)
        if skew:
            v *= 0.8 ** np.arange(dims)
        v /= np.linalg.norm(v)
        rows.append((int(i * 5), [float(x) for x in v], int(draw.integers(3))))
    return rows


@pytest.mark.parametrize("seed,n,dims,spread,skew", [(1, 300, 20, 0.4, False), (2, 260, 64, 2.0, False), (3, 300, 33, 0.7, True), (4, 200, 2, 0.5, False)])
def test_like_all_pairs(spark, monkeypatch, seed, n, dims, spread, skew):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    rows = clusters(seed, n, dims, spread, skew)
    want = plain(rows)
    assert want
    assert mined(spark, rows) == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 32)
    draw = random.Random(1)
    rows = clusters(5, 120, 6, 0.5)
    rows += [(None, rows[3][1], 1), (None, rows[4][1], 2), (50, rows[10][1], 0), (50, rows[11][1], 1), (100, rows[20][1], 2)]
    rows += [(7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * 6, 1), (10, [float("inf")] * 6, 1), (11, rows[0][1], None)]
    rows += [(12, [], 1), (13, [0.5], 2), (14, [0.5] * 9, 1), (150, [0.0] * 6, 1), (200, [-0.3] * 6, 2)]
    rows += [(1000 + draw.randrange(40), rows[30][1], draw.randrange(3)) for _ in range(80)]  # ties
    assert mined(spark, rows) == plain(rows)


def test_scores_over_the_index_equal_the_product():
    draw = np.random.default_rng(7)
    for _ in range(60):
        dims = int(draw.integers(1, 70))
        rows = np.floor(draw.normal(size=(50, dims)) * draw.choice([3, 60]) * 0.9 ** np.arange(dims))
        anchors = np.floor(draw.normal(size=(9, int(draw.integers(1, 70)))) * 40)
        n = max(dims, anchors.shape[1])
        want = np.pad(anchors, ((0, 0), (0, n - anchors.shape[1]))) @ np.pad(rows, ((0, 0), (0, n - dims))).T
        least = np.quantile(want, draw.random(), axis=1) if draw.random() < 0.8 else np.full(9, -np.inf)
        wanted = draw.random((9, 50)) < 0.8
        block = hard_negatives.Block(rows, np.zeros(50), np.arange(50), np.arange(50))
        got = block.scores(anchors, least, wanted)
        assert np.array_equal(got, np.where(wanted & (want >= least[:, None]), want, -np.inf))


def test_too_large_vectors_are_an_error(spark):
    with pytest.raises(ValueError, match="norm"):
        mined(spark, [(0, [1e9], 1), (1, [1.0], 1)])


def test_empty_table(spark):
    assert mined(spark, []) == Counter()


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(map(tuple, QUERIES["op11_hard_negatives"](spark, folder).collect())) == plain(rows)
