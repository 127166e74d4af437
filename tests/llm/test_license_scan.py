import math
import re

import pytest
from cases import TEXTS, by_id, frame

from mailquill.llm import license_scan as scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text, templates=scan.TEMPLATES, share=scan.CONTAINMENT):
    words = WORD.findall(fold(text))
    places = []
    for phrase, label in scan.PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    lines = [set(WORD.findall(line)) for line in fold(text).split("\n")]
    held = []
    for label, template in templates:
        own = set(WORD.findall(template.lower()))
        held += [(len(own & line) / len(own), label) for line in lines if len(own & line) >= math.ceil(round(share * len(own), 9))]
    base = {label for _, label in places}
    return (
        len(words),
        len(places),
        min((i for i, _ in places), default=None),
        max((i for i, _ in places), default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | {label for _, label in held})),
        1.0 if places else max((x for x, _ in held), default=0.0),
    )


NOTICES = [
    (100, "Released under the MIT License."),
    (101, "cc by cc by cc by"),
    (102, "x\nLicensed under CC BY-NC 4.0.\ny MIT-License, mit license"),
    (103, "gnu general public\nlicense"),
    (104, "GNU GENERAL PUBLIC LICENSE apache license apache  license"),
    (105, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"),
    (106, scan.TEMPLATES[10][1].replace("hereby", "").replace("charge", "")),
    (107, "all rights reserved\n" * 500),
    (108, "This worK is licensed under the GNU General Public License, version 3"),
    (109, "İmit license ſapache license"),
    (110, "mit licenses, smit license, mit-license"),
    (100, "Released under the MIT License."),
    (None, "Released under the MIT License."),
]


def test_like_a_plain_scan(spark):
    texts = TEXTS + NOTICES
    found = by_id(scan.scan_licenses(frame(spark, texts)))
    want = {}
    for doc_id, text in texts:
        want.setdefault(doc_id, []).append(plain(text))
    order = lambda rows: sorted(rows, key=repr)
    assert {k: order([tuple(row)[1:] for row in rows]) for k, rows in found.items()} == {k: order(v) for k, v in want.items()}


@pytest.mark.parametrize("share", [0.3, 0.5, 0.75, 1.0])
def test_every_line_over_any_threshold(spark, share):
    templates = (("a", "one two three four five six"), ("b", "three four"), ("c", "six seven eight nine ten one two"))
    words = "one two three four five six seven eight nine ten".split()
    texts = [(n, "\n".join(" ".join(w for k, w in enumerate(words) if (n * 37 + line * 11) >> k & 1) for line in range(8))) for n in range(120)]
    found = by_id(scan.scan_licenses(frame(spark, texts), templates=templates, containment=share))
    for doc_id, text in texts:
        assert tuple(found[doc_id][0])[1:] == plain(text, templates, share)


def test_empty_table_and_bad_templates(spark):
    assert scan.scan_licenses(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        scan.scan_licenses(frame(spark), templates=(("a", "..."),))


def test_no_python_in_the_plan(spark):
    plan = scan.scan_licenses(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
