import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from mailquill.functions.maintext import AROUND, BLOCK_COST, BLOCKS, LINK_COST, PARTS, best_subtree, readable_text
from mailquill.functions.markup import page_text

PROSE = "Some words that make a sentence of a usual length, and then some more of them, until it has become a long one."
LINKS = "".join(f'<li><a href="/{n}">Entry {n}</a></li>' for n in range(12))


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><ul>{LINKS}</ul></nav><div id=x><h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><footer>{PROSE}</footer>",
        f"<ul>{LINKS}</ul><section><h2>Head<p>{PROSE}<p>Short.<p>{PROSE}</section><div>{LINKS}</div>",
        f"<table><tr><td><ul>{LINKS}</ul><td><h1>Head</h1><p>{PROSE}<p>Short.</p>{PROSE}</table><div>Imprint</div>",
        f"<div><div>{LINKS}</div><div>Share</div><div><div><h1>Head</h1><p>{PROSE}</p></div><p>Short.</p><div>{PROSE}</div></div></div><aside>{PROSE} {PROSE} {PROSE}</aside>",
    ],
)
def test_pages_without_article_lose_navigation(spark, body):
    found, whole = spark.createDataFrame([(page(body),)], "t string").select(readable_text(F.col("t")), page_text(F.col("t"))).first()
    assert found == f"Head {PROSE} Short. {PROSE}"
    assert "Entry 3" in whole


def test_an_article_still_wins_and_pages_of_links_stay_whole(spark):
    article = page(f"<div>{PROSE} {PROSE}</div><article>Little.</article>")
    links = page(f"<ul>{LINKS}</ul>")
    rows = spark.createDataFrame([(article,), (links,), ("",), (None,), ("plain words",), ("<div>" * 3 + "x",)], "t string").select(readable_text(F.col("t"))).collect()
    assert rows[0][0] == "Little." and rows[1][0].startswith("Entry 0 Entry 1")
    assert [row[0] for row in rows[2:]] == [None, None, "plain words", "x"]


def plain_worths(node, around=False, link=False, out=None):
    """Worth of each block of a well-formed tree, by recursion; inline elements belong to the block around them."""
    own = {"text": 0, "link": 0, "sum": 0}
    around = around or node.tag in AROUND

    def say(text, linked):
        n = len(" ".join((text or "").split()))
        own["text"] += n
        own["link"] += n if linked or around else 0

    def walk(element, linked):
        say(element.text, linked)
        for child in element:
            if child.tag in BLOCKS:
                own["sum"] += plain_worths(child, around, linked, out)
            else:
                walk(child, linked or child.tag == "a")
            say(child.tail, linked)

    walk(node, link)
    worth = own["sum"] + own["text"] - LINK_COST * own["link"]
    worth -= BLOCK_COST if own["text"] and node.tag not in PARTS else 0
    out.append((worth, node))
    return worth


def random_tree(draw, depth):
    kind = draw.choice(["div", "div", "section", "p", "ul", "nav", "main", "blockquote"]) if depth else "body"
    parts = []
    for _ in range(draw.randint(1, 4)):
        what = draw.random()
        if what < 0.45 and depth < 4 and kind != "p":
            parts.append(random_tree(draw, depth + 1))
        elif what < 0.6:
            parts.append(f"<a href='u'>{'link ' * draw.randint(1, 9)}</a>")
        elif what < 0.7:
            parts.append(f"<b>{'bold ' * draw.randint(1, 9)}</b>")
        else:
            parts.append(" word" * draw.choice([0, 2, 9, 30]) + " ")
    return f"<{kind}>{''.join(parts)}</{kind}>"


@pytest.mark.parametrize("seed", range(5))
def test_like_a_plain_tree(seed):
    draw = random.Random(seed)
    for _ in range(300):
        markup = random_tree(draw, 0)
        worths = []
        plain_worths(ET.fromstring(markup), out=worths)
        allowed = [(worth, node) for worth, node in worths if node.tag not in PARTS]
        best, place = max(worth for worth, _ in allowed), best_subtree(markup)
        if best <= 0:
            assert place is None
            continue
        text = " ".join(ET.fromstring(f"<x>{markup[place[0] : place[1]]}</x>").itertext()).split()
        assert text in [" ".join(node.itertext()).split() for worth, node in allowed if worth == best]


def test_broken_and_large_pages_take_linear_time():
    import time

    for piece in ("<div>", "</div>", "<a", "<p>x", "<", "</p><td>", "<div><p>words " * 2):
        began = time.perf_counter()
        best_subtree(piece * 100_000)
        assert time.perf_counter() - began < 5
