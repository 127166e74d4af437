"""The main block of a page by text and link density, for pages that do not name it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquill.functions.markup import article_block, hide_invisible, visible_text, whole_text

#: Elements that make a block of their own; others belong to the block around them.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A block of these ends where the next one of its kind begins.
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Parts of a text, which are never all of it.
PARTS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr thead tfoot figcaption summary pre".split())
#: Blocks that by their name surround a text; all that stands in them counts like a link.
AROUND = frozenset("nav footer aside menu form".split())
#: Characters that text in no such part must have to speak for its surroundings, and how often a character of a link counts.
BLOCK_COST, LINK_COST = 40, 4
_PART = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>?|<[^A-Za-z/][^>]*>?|</[^A-Za-z][^>]*>?")


class _Node:
    __slots__ = ("name", "start", "around", "text", "link", "sum")

    def __init__(self, name: str, start: int, around: bool = False):
        self.name, self.start, self.around, self.text, self.link, self.sum = name, start, around, 0, 0, 0


def best_subtree(markup: str) -> tuple[int, int] | None:
    """Where the markup inside the best block begins and ends; None if no block speaks for its surroundings.

    The text that stands in a block, but in no block inside of it, is worth its characters, white space counted once, less
    ``LINK_COST`` for each of them in a link, and ``BLOCK_COST`` where it is no paragraph, heading or the like. A block is worth what stands in it and in all inside of it.
    The worthiest block that is no mere part of a text wins, the innermost and first of equal ones. Long paragraphs thus draw in the short ones among them, and
    lists of links, notices and footers around them draw the line. One pass with a stack, linear in the markup.
    """
    best, links = (0, 0, 0), 0
    stack = [_Node("", 0)]

    def say(words: str) -> None:
        node = stack[-1]
        node.text += len(words)
        node.link += len(words) if links or node.around else 0

    def close(end: int) -> None:
        nonlocal best
        node = stack.pop()
        part = node.name in PARTS
        worth = node.sum + node.text - LINK_COST * node.link - (BLOCK_COST if node.text and not part else 0)
        if worth > best[0] and not part:
            best = worth, node.start, end
        if stack:
            stack[-1].sum += worth

    at = 0
    for found in _PART.finditer(markup):
        say(" ".join(markup[at : found.start()].split()))
        at = found.end()
        if not found[2]:
            continue
        name, closing = found[2].lower(), bool(found[1])
        if name == "a":
            links = max(0, links - 1) if closing else 1
        elif name in BLOCKS and closing:
            if any(node.name == name for node in stack[-64:]):
                while stack[-1].name != name:
                    close(found.start())
                close(found.start())
        elif name in BLOCKS and name != "hr":
            if stack[-1].name in ENDS_ITSELF.get(name, ()):
                close(found.start())
            stack.append(_Node(name, found.end(), stack[-1].around or name in AROUND))
    say(" ".join(markup[at:].split()))
    while stack:
        close(len(markup))
    return best[1:] if best[0] > 0 else None


def main_block(markup: Column) -> Column:
    """Markup of the best block, or NULL. Only this search runs in Python, and NULL costs it nothing."""

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def inner(page):
            place = best_subtree(page) if page else None
            return page[place[0] : place[1]] if place else None

        for batch in batches:
            yield pd.Series([inner(page) for page in batch], dtype="object")

    return found(markup)


def readable_text(page_html: Column) -> Column:
    """Readable text of a page: its article block, else the best block by density, else the body; NULL when none has text."""
    shown = hide_invisible(page_html)
    block = article_block(shown)
    article = visible_text(block, " ")
    dense = visible_text(F.coalesce(main_block(F.when(block == "", shown)), F.lit("")), " ")
    return F.when(article != "", article).when(dense != "", dense).otherwise(whole_text(shown))
