import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, frame
from tokenizers import Tokenizer

from mailquill.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    """Best fit decreasing, one by one."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [(gap, at) for at, gap in enumerate(gaps) if gap >= length]
        if fitting:
            gaps[min(fitting)[1]] -= length
        else:
            gaps.append(capacity - length)
    return len(gaps)


def check_sequences(rows, capacity):
    sequences = defaultdict(list)
    for row in rows:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


@pytest.mark.parametrize("seed", range(40))
def test_rounds_equal_one_by_one(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 16, 50])
    lengths = [draw.choice([draw.randint(1, capacity), draw.randint(1, 1 + capacity // 4)]) for _ in range(draw.randint(0, 150))]
    rounds = packing.best_fit_rounds(Counter(lengths), capacity)
    placed = []
    for first, count, sequence, each, offset, length in rounds:
        for k in range(count):
            placed.append((first + k, {"sequence_id": sequence + k // each, "offset": offset + k % each * length, "length": length}))
    assert [rank for rank, _ in sorted(placed, key=lambda p: p[0])] == list(range(len(lengths)))
    assert Counter(row["length"] for _, row in placed) == Counter(lengths)
    assert check_sequences([row for _, row in placed], capacity) == plain_best_fit(lengths, capacity)


def test_pieces_and_sequences(spark):
    tokenizer = Tokenizer.from_file(FILE)
    want = Counter()
    for doc_id, text in TEXTS:
        ids = np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece in range(math.ceil(len(ids) / 64)):
            own = ids[64 * piece : 64 * piece + 64]
            want[doc_id, piece, 64 * piece, len(own), zlib.crc32(own.tobytes())] += 1
    found = packing.pack_digest(frame(spark), FILE, capacity=64).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    assert check_sequences(found, 64) <= math.ceil(1.02 * sum(r["length"] for r in found) / 64)
    whole = packing.pack(frame(spark), FILE, capacity=64).collect()
    assert Counter(zlib.crc32(row["ids"]) for row in whole) == Counter(row["ids_crc32"] for row in found)


def test_words_like_the_tokenizer():
    tokenizer = Tokenizer.from_file(FILE)
    draw = random.Random(3)
    letters = " ab.,\n\tßžΣ😀\x00́'s<|endoftext|>0\x1c \x85İक़"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 14))) for _ in range(20_000)]
    texts += ["<|endoftext|>", "a <|startoftext|> b", "<|STARTOFTEXT|>"]
    words = packing.WordIds(FILE)
    words.table.limit = 500
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], words.encode(texts[at : at + 100])):
            assert ids == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_empty_table(spark):
    assert packing.pack_digest(frame(spark, []), FILE).collect() == []
