import random
import re

from cases import TEXTS, frame
from pyspark.sql import functions as F

from mailquill.llm.quality import judge, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    repeats = None
    if many is not None:
        repeats = len({i + k for i, w in enumerate(windows) if w in many for k in range(8)})
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats


def test_counts_like_plain_ones():
    draw = random.Random(2)
    texts = [text for _, text in TEXTS]
    for _ in range(300):
        texts.append("".join(draw.choice(["a ", "b ", "\n", "c#", "é ", "\x1c", "\x0b", "a b c d e f g h "]) for _ in range(60)))
    for text in texts:
        want, found = base(text), judge(text)
        assert found[:4] == want[:4]
        if want[4] is not None:
            assert found[4] == want[4]
            assert found[5] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


CLEAN = " ".join(f"Plain word{i} follows another one here, and ends." for i in range(12))


def test_verdicts():
    junk = [
        CLEAN + "\n" + " | ".join(f"entry{i}" for i in range(120)),
        CLEAN + "\n" + " ".join(f"noise{i}$$$" for i in range(120)),
        CLEAN + "\n" + " ".join(f"LOUD{i}!!" for i in range(120)),
        CLEAN + "\n" + "".join(f"\nMenu entry {i}" for i in range(60)),
        CLEAN + "\n" + " ".join(f"x{i} x{i} x{i}" for i in range(60)),
    ]
    assert judge(CLEAN)[6]
    assert judge(CLEAN + "\nAll rights reserved.")[6]
    assert judge(CLEAN + "\nAll rights reserved.")[8] == CLEAN
    assert [judge(text)[6] for text in junk] == [False] * len(junk)
    assert not judge(None)[6] and not judge("")[6]


def test_in_spark(spark):
    found = frame(spark).select("text", quality(F.col("text"), cleaned=True).alias("q")).select("text", "q.*").collect()
    assert len(found) == len(TEXTS)
    for row in found:
        assert tuple(row)[1:] == judge(row["text"])
    assert frame(spark, []).select(quality(F.col("text"))).collect() == []


def test_boilerplate_of_four_languages():
    prose = "Ein Satz aus Worten, der lang genug ist, um zu bleiben, und noch einige Worte mehr hat, damit er zwanzig hat, oder mehr.\n"
    for phrase in ("Alle Rechte vorbehalten.", "Cliquez ici.", "Conditions d'utilisation.", "Política de privacidad.", "Privacy policy."):
        found = judge(prose * 2 + phrase)
        assert found[7] == len(phrase.split()) and found[8] == (prose * 2)[:-1]
