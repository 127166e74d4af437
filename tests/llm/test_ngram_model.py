import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from cases import TEXTS, frame
from pyspark.sql import functions as F

from mailquill.llm import ngram_model

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def discounts(counts):
    n = Counter(counts)
    if not all(n[k] for k in (1, 2, 3, 4)):
        return [0, 0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    raw = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
    return [0, *(value if 0 < value < k else 0.5 for k, value in enumerate(raw, 1))]


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        self.word, self.pair = Counter(), Counter()
        for text in texts:
            own = words(text)
            self.word.update(own)
            self.pair.update(zip(["<s>", *own], own))
        self.kinds = Counter(word for _, word in self.pair)
        self.d, self.e = discounts(self.pair.values()), discounts(self.kinds.values())
        self.context, self.back = Counter(), Counter()
        for (before, _), n in self.pair.items():
            self.context[before] += n
            self.back[before] += self.d[min(n, 3)]
        rest = sum(self.e[min(k, 3)] for k in self.kinds.values()) / len(self.pair) if self.pair else 1
        self.unseen = rest / (len(self.word) + 1)

    def chance(self, before, word):
        kinds = self.kinds[word]
        low = ((kinds - self.e[min(kinds, 3)]) / len(self.pair) if kinds else 0) + self.unseen
        if not self.context[before]:
            return low
        n = self.pair[before, word]
        return ((n - self.d[min(n, 3)]) + self.back[before] * low) / self.context[before]

    def score(self, text):
        own = words(text)
        total, distinct = sum(self.word.values()), len(self.word)
        base = sum(math.log10((self.word[w] + 1) / (total + distinct + 1)) for w in own)
        score = sum(math.log10(self.chance(*pair)) for pair in zip(["<s>", *own], own))
        return len(own), sum(self.word[w] > 0 for w in own), base, score


def scored(spark, model, texts):
    docs = frame(spark, texts)
    rows = docs.select("text", ngram_model.score_texts(docs, model).alias("s")).select("text", "s.*").collect()
    assert len(rows) == len(texts)
    return rows


ZIPF = [(n, " ".join(f"v{int(1 / (0.002 + (n * k % 997) / 997))}" for k in range(1, 200))) for n in range(20, 60)]


def test_like_dictionaries(spark):
    texts = TEXTS + ZIPF
    train = [text for n, text in texts if n is None or n % 3]
    plain = Plain(train)
    model = ngram_model.fit(frame(spark, texts).where("doc_id IS NULL OR doc_id % 3 <> 0").select("text"))
    assert (model.tokens, model.words) == (sum(plain.word.values()), len(plain.word))
    for row in scored(spark, model, texts):
        n, known, base, score = plain.score(row["text"])
        assert (row["n_tokens"], row["n_known"]) == (n, known)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["score"] == pytest.approx(score, rel=1e-9)


def chance(model, before, token):
    """Of one token after others, as the difference of two scores."""
    score = lambda own: ngram_model.score_block(model, np.array(own, np.uint64), np.array([len(own)]))["score"][0]
    return 10 ** (score([*before, token]) - (score(before) if before else 0.0))


def test_chances_sum_to_one(spark):
    model = ngram_model.fit(frame(spark, ZIPF).select("text"))
    own = sorted({w for _, text in ZIPF for w in words(text)[:-1]})
    tokens = [ngram_model.word_hashes()[w.encode()] for w in [*own, "unknown"]]
    for before in ([], tokens[:1], tokens[5:6], tokens[-1:]):
        assert sum(chance(model, before, token) for token in [*tokens, ngram_model.END]) == pytest.approx(1.0, abs=1e-9)


def test_nothing_to_learn_from(spark):
    model = ngram_model.fit(frame(spark, []).select("text"))
    rows = scored(spark, model, [(1, None), (2, "a b")])
    assert {(row["n_known"], row["base_score"], row["score"]) for row in rows} == {(0, 0.0, 0.0)}
    assert frame(spark, []).select(ngram_model.score_texts(frame(spark), model)).collect() == []


def test_blocks_hold_whole_texts(monkeypatch):
    whole = next(ngram_model.blocks(pd.Series([text for _, text in TEXTS])))
    monkeypatch.setattr(ngram_model, "BLOCK", 50)
    parts = list(ngram_model.blocks(pd.Series([text for _, text in TEXTS])))
    assert len(parts) > 3
    assert np.concatenate([hashes for hashes, _ in parts]).tolist() == whole[0].tolist()
    assert np.concatenate([np.diff([0, *ends]) for _, ends in parts]).tolist() == np.diff([0, *whole[1]]).tolist()


def test_repeated_writers_leave_whole_files(tmp_path):
    path = str(tmp_path / "x")
    ngram_model.store(path, np.arange(5), "<u8")
    ngram_model.store(path, np.arange(7), "<u8")
    assert ngram_model.mapped(path, "<u8").tolist() == list(range(7))
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def test_only_mounted_folders():
    with pytest.raises(RuntimeError):
        ngram_model.local_path("hdfs://host/dir")
    assert ngram_model.local_path("file:///a%20b") == "/a b"


def test_held_out_texts_are_less_surprising_than_by_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    model = ngram_model.fit(docs.where(train).select("text"))
    held = docs.where(~train)
    sums = held.select(ngram_model.score_texts(held, model).alias("s")).agg(F.sum("s.score"), F.sum("s.base_score")).first()
    assert sums[1] < sums[0] < 0


def test_counts_of_any_size_are_kept(tmp_path):
    for counts in ([0, 255], [256], [70_000, 1], [2**32 - 1], [2**32 + 5, 3], []):
        path = str(tmp_path / f"c{len(list(tmp_path.iterdir()))}")
        ngram_model.store_counts(path, np.array(counts, np.int64))
        assert ngram_model.mapped_counts(path).astype(np.int64).tolist() == counts


def test_shards_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_model, "SHARD_CHARACTERS", 500)
    texts = TEXTS[:6] + ZIPF
    model = ngram_model.fit(frame(spark, texts).select("text"))
    assert 1 << model.bits >= sum(len(text or "") for _, text in texts) / 500
    plain = Plain([text for _, text in texts])
    for row in scored(spark, model, ZIPF[:5]):
        assert row["score"] == pytest.approx(plain.score(row["text"])[3], rel=1e-9)


def test_few_files_are_open_at_once(monkeypatch, tmp_path):
    import os

    before = len(os.listdir("/proc/self/fd"))
    for n in range(3 * ngram_model.OPEN_FILES):
        ngram_model.store(str(tmp_path / f"f{n}"), np.arange(3), "<u8")
        assert ngram_model.mapped(str(tmp_path / f"f{n}"), "<u8")[2] == 2
    assert len(os.listdir("/proc/self/fd")) < before + ngram_model.OPEN_FILES + 20
