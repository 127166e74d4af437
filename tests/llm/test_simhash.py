import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import TEXTS, frame

from mailquill.llm import simhash
from mailquill.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(fingerprints, radius):
    values = np.array(sorted(set(fingerprints)), np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            root[find(i)] = find(int(j))
    return {int(value): find(i) for i, value in enumerate(values)}


def clusters(seed):
    draw = random.Random(seed)
    out = [0, 1, 2**64 - 1, 2**63]
    for _ in range(25):
        centre = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 50])):
            near = centre
            for _ in range(draw.randint(0, 9)):
                near ^= 1 << draw.randrange(64)
            out.append(near)
            if draw.random() < 0.3:
                centre = near
    return out


@pytest.mark.parametrize("radius", [2, 3])
def test_links_join_what_all_pairs_join(spark, radius):
    values = clusters(radius)
    want = defaultdict(set)
    for value, group in plain_groups(values, radius).items():
        want[group].add(simhash.signed(value))
    rows = [(simhash.signed(value),) for value in set(values)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp bigint"), radius)
    for a, b in links.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    label = {row["node"]: row["component"] for row in components(links).collect()}
    found = defaultdict(set)
    for (value,) in rows:
        found[label.get(value, value)].add(value)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_documents(spark):
    base = " ".join(f"word{n}" for n in range(400))
    texts = TEXTS + [(200 + n, base.replace(f"word{50 * n} ", f"other{n} ")) for n in range(1, 8)] + [(199, base), (198, base)]
    prints = [plain_fingerprint(text) for _, text in texts]
    groups = plain_groups(prints, 3)
    first = {}
    for (doc_id, _), value in zip(texts, prints):
        if doc_id is not None:
            first[groups[value]] = min(doc_id, first.get(groups[value], doc_id))
    want = Counter((doc_id, f"{value:016x}", first.get(groups[value])) for (doc_id, _), value in zip(texts, prints))
    docs = frame(spark, texts)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    stay = {}
    for (doc_id, text), value in zip(texts, prints):
        own = (f"i{doc_id}" if doc_id is not None else "n") + "/" + hashlib.md5((text or "").encode()).hexdigest()
        row = (doc_id is None, doc_id or 0, hashlib.md5(own.encode()).digest(), doc_id, text or "")
        stay[groups[value]] = min(row, stay.get(groups[value], row))
    assert Counter((row["doc_id"], row["text"] or "") for row in kept.collect()) == Counter(row[3:] for row in stay.values())


def test_a_table_loaded_twice_is_the_table(spark):
    texts = [(n, f"text number {n % 9} " + "word " * (n % 9)) for n in range(60)] + [(None, "no id here"), (None, "no id here")]
    once, twice = (simhash.keep_one(frame(spark, rows)).collect() for rows in (texts, texts + texts))
    assert Counter(map(tuple, once)) == Counter(map(tuple, twice))
    assert sum(row["text"] == "no id here" for row in once) == 1


def test_long_text_in_slices(monkeypatch):
    text = TEXTS[5][1]
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "SLICE", 1000)
    assert simhash.simhash(text) == whole == simhash.signed(plain_fingerprint(text))


def test_components_of_a_chain(spark):
    links = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b").unionAll(spark.range(1).selectExpr("500L", "500L"))
    assert {tuple(row) for row in components(links).collect()} == {(n, 0) for n in range(300)}


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.keep_one(frame(spark, [])).collect() == []
