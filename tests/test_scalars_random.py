"""Random inputs, compared with what the standard library makes of them."""

import html
import random
import re
from datetime import datetime, timezone

from pyspark.sql import functions as F

from mailquill.functions.markup import decode_entities
from mailquill.functions.text import header_date, report_snippet, since_bound, snippet, title_hash


def outcome(spark, values, expression):
    frame = spark.createDataFrame(list(enumerate(values)), "n int, v string").repartition(4)
    return [row[1] for row in sorted(frame.select("n", expression(F.col("v"))).collect())]


def assert_same(values, found, expected):
    wrong = [(value, ours, theirs) for value, ours, theirs in zip(values, found, expected) if ours != theirs]
    assert not wrong, (len(wrong), wrong[:5])
    assert sum(value is not None for value in expected) > 300


def python_header_date(header):
    try:
        plain = re.sub(" (Z|GMT|UT)$", " +0000", header.split(" (")[0].strip())
        return datetime.strptime(plain, "%a, %d %b %Y %H:%M:%S %z").timestamp()
    except ValueError:
        return None


def test_header_dates(spark):
    pick = random.Random(1)
    zones = ["+0000", "-0700", "+05:30", "+1345", "GMT", "Z", "UT", "EST", "0200", "+02"]
    values = []
    for _ in range(3000):
        weekday = pick.choice(["Mon", "tue", "SUN", "Fri", "Xyz", "Monday"])
        month = pick.choice(["Jan", "feb", "MAR", "Sep", "Dec", "Foo"])
        day = pick.choice([str(pick.randint(0, 32)), f"{pick.randint(1, 31):02d}"])
        clock = f"{pick.randint(0, 24):02d}:{pick.randint(0, 60):02d}:{pick.randint(0, 59):02d}"
        space = pick.choice([" ", " ", "  ", "\n "])
        tail = pick.choice(["", " (CEST)", " (a) (b)", " ", " x"])
        values.append(f"{weekday}, {day} {month}{space}{pick.randint(1970, 2100)} {clock} {pick.choice(zones)}{tail}")
    assert_same(values, outcome(spark, values, header_date), [python_header_date(value) for value in values])


def python_since(typed):
    try:
        return float(typed)
    except ValueError:
        pass
    try:
        moment = datetime.fromisoformat(typed.replace(" ", "T"))
    except ValueError:
        return None
    return (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp()


def test_since_bounds(spark):
    pick = random.Random(2)
    values = []
    for _ in range(3000):
        day = f"{pick.randint(1990, 2050)}-{pick.randint(0, 13):02d}-{pick.randint(0, 32):02d}"
        clock = f"{pick.choice('T ')}{pick.randint(0, 24):02d}:{pick.randint(0, 60):02d}"
        second = f":{pick.randint(0, 60):02d}"
        fraction = pick.choice(["", ".5", ".125", ".000001"])
        zone = pick.choice(["", "", "Z", "+02:00", "-0530"])
        number = pick.choice([str(pick.randint(0, 2**31)), f"{pick.random() * 1e9:.3f}", "1e9", "-5", ".5", "7."])
        values.append(
            pick.choice([number, day, day + clock + zone, day + clock + second + zone, day + clock + second + fraction + zone, day[:7]])
        )
    values = [value for value in values if not re.search(r"[T ]24:", value)]  # end of day: new in the newest Python only
    assert_same(values, outcome(spark, values, since_bound), [python_since(value) for value in values])


def test_entities(spark):
    pick = random.Random(3)
    names = sorted(name for name in html.entities.html5 if name.endswith(";"))
    parts = ["a", " ", "&", ";", "#", "&amp;", "&lt;", "&#38;", "amp;", "lt;", "é"]
    values = []
    for _ in range(3000):
        chosen = []
        for _ in range(pick.randint(1, 8)):
            chosen.append(
                pick.choice(
                    [
                        pick.choice(parts),
                        "&" + pick.choice(names),
                        f"&#{pick.choice([pick.randint(0, 300), pick.randint(0, 0x110010)])};",
                        f"&#x{pick.randint(0, 0x3000):{pick.choice('xX')}};",
                    ]
                )
            )
        values.append("".join(chosen))

    def python_decoded(text):
        # The number references that the standard drops or replaces differ between parsers; they are not compared here.
        def one(found):
            whole = html.entities.html5.get(found[0][1:].rstrip(";") + ";", found[0])
            return html.unescape(found[0]) if found[0].startswith("&#") else whole

        return re.sub(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?", one, text)

    def comparable(text):
        numbers = [int(n) for n in re.findall(r"&#(\d+);?", text)] + [int(n, 16) for n in re.findall(r"&#[xX]([0-9a-fA-F]+);?", text)]
        dropped = [n for n in numbers if html.unescape(f"&#{n};") == "" or n in (13,) or 0x80 <= n < 0xA0]
        partial = re.search(r"&[A-Za-z][A-Za-z0-9]*;", text) and any(
            f"{name[1:]}" not in html.entities.html5 for name in re.findall(r"&[A-Za-z][A-Za-z0-9]*;", text)
        )
        return not dropped and not partial

    values = [value for value in values if comparable(value)]
    assert len(values) > 1500
    assert_same(values, outcome(spark, values, decode_entities), [python_decoded(value) for value in values])


def python_report_snippet(text):
    line = text.replace("\n", " ")
    return line if len(line) <= 255 else line[:247].rsplit(" ", 1)[0] + "..."


def test_snippets_and_hashes(spark):
    import hashlib

    pick = random.Random(4)
    alphabet = ["word", "é", "😀", "\n", " ", "  ", "x" * 30, "longer", "ẞ", "A"]
    values = ["".join(pick.choice(alphabet) + pick.choice(["", " "]) for _ in range(pick.randint(0, 400))) for _ in range(1500)]
    assert_same(values, outcome(spark, values, report_snippet), [python_report_snippet(value) for value in values])
    cut = [value[:1000] + "..." if len(value) > 1000 else value for value in values]
    assert_same(values, outcome(spark, values, snippet), cut)
    hashes = [hashlib.sha256(value.lower().encode()).hexdigest() for value in values]
    assert_same(values, outcome(spark, values, title_hash), hashes)
