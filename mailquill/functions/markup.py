"""HTML as column expressions: attributes, entities, text nodes and balanced ``div`` blocks.

All of it runs in the JVM. Java recurses once per turn of a repeated group unless the repetition is possessive, and an
overflowing stack ends the executor. So every unbounded group here is possessive, every pattern that looks for an end
also takes the end of the text, and the work on one mail stays linear in its length however broken the mail is.
"""

from __future__ import annotations

import html.entities
import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquill.functions.bind import bind

# The inside of a tag: plain characters, or "=" with an optional quoted value that may hold ">".
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TAG = rf"<[/!?a-zA-Z]{ATTRIBUTES}(?:>|\z)"
ATTRIBUTE = r"""[^\s=/>"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++))?+"""
INVISIBLE = r"(?s)<(?:!--(?:.*?-->|.*+\z)|((?i:script|style))(?=[\s>/])[^>]*+(?:>(?:.*?</(?i:\1)\s*+>|.*+\z)|\z))"

# Characters that count as blank at the ends of a text node, control separators included.
BLANK = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The entities that make up nearly all of real alert mail, tried before the full table.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": "\u00a0",
    "&hellip;": "\u2026",
}
# Numbers need no semicolon. Names need theirs in attributes, where "&" also parts the fields of a link, but not in text.
NUMBER = r"#[0-9]++;?|#[xX][0-9a-fA-F]++;?"
IN_ATTRIBUTE = rf"(?:{NUMBER}|[A-Za-z][A-Za-z0-9]*+;)"
IN_TEXT = rf"(?:{NUMBER}|[A-Za-z][A-Za-z0-9]*+;?)"
OTHER = r"&(?!(?:amp|lt|gt|quot|#39|apos|nbsp|hellip);)"

REPLACEMENT = "\ufffd"

# Spark compiles the pattern of a split anew for every row, but keeps that of a replacement. So text is cut by putting
# this character at the cuts and splitting there. ``hide_invisible`` has replaced it before, as browsers do.
CUT = "\u0000"


@cache
def _entity_table() -> str:
    """Names without the semicolon; numbers 128 to 159, which mean Windows-1252 characters in web pages, as ``#128``."""
    table = {name[:-1]: value for name, value in html.entities.html5.items() if name.endswith(";")}
    for number in range(128, 160):
        table[f"#{number}"] = bytes([number]).decode("cp1252", "replace")
    return json.dumps(table)


def cut_at(text: Column, pattern: str, keep: str = "") -> Column:
    """Pieces of ``text`` between the matches of ``pattern``; ``keep`` stays in front of each piece but the first."""
    return F.split(F.regexp_replace(text, pattern, CUT + keep), CUT)


def _character(number: Column) -> Column:
    invalid = (number < 1) | (number > 0x10FFFF) | ((number >= 0xD800) & (number <= 0xDFFF))
    return F.when(invalid, F.lit(REPLACEMENT)).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    )


def _entity(name: Column) -> Column:
    """Character for the inside of one reference, NULL for an unknown name."""
    table = F.from_json(F.lit(_entity_table()), "map<string,string>")
    decimal = F.regexp_extract(name, "^#0*([0-9]*)$", 1)
    hexadecimal = F.regexp_extract(name, "^#[xX]0*([0-9a-fA-F]*)$", 1)
    beyond = F.lit(0x110000)  # more digits than any character has
    number = F.when(
        name.rlike("^#[xX]"),
        F.when(F.length(hexadecimal) > 8, beyond).otherwise(F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("long")),
    ).when(
        name.startswith("#"),
        F.when(F.length(decimal) > 10, beyond).otherwise(F.concat(F.lit("0"), decimal).cast("long")),
    )
    return bind(
        number,
        lambda number: F.coalesce(
            F.element_at(table, F.coalesce(F.concat(F.lit("#"), number.cast("string")), name)), _character(number)
        ),
    )


def _decode_all(text: Column, entity: str) -> Column:
    """All references. The text is cut before each ``&`` and every piece is looked at once."""

    def piece_text(piece: Column) -> Column:
        return bind(
            F.regexp_extract(piece, rf"^&{entity}", 0),
            lambda found: F.when(found == "", piece).otherwise(
                F.concat(
                    F.coalesce(_entity(F.regexp_extract(found, "^&([^;]*)", 1)), found),
                    piece.substr(F.length(found) + F.lit(1), F.length(piece)),
                )
            ),
        )

    return F.array_join(F.transform(cut_at(text, "&", "&"), piece_text), "")


def decode_entities(text: Column, form: str = IN_TEXT) -> Column:
    """Character references to characters, each once: ``&amp;lt;`` gives ``&lt;``. Unknown names stay as written.

    In text a name may lack its semicolon; pass ``IN_ATTRIBUTE`` for the values of attributes.

    Text with common references only takes plain replacements, with ``&amp;`` last: until then an escaped reference cannot
    be mistaken for a real one.
    """
    plain = text
    for entity, value in (COMMON_ENTITIES | {"&amp;": "&"}).items():
        plain = F.replace(plain, F.lit(entity), F.lit(value))
    decoded = F.when(text.rlike(OTHER + form), _decode_all(text, form)).otherwise(plain)
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def _attribute_list(attributes: Column) -> Column:
    return F.regexp_extract_all(attributes, F.lit(ATTRIBUTE), F.lit(0))


def attribute(attributes: Column, name: str) -> Column:
    """Value of an attribute as written, ``''`` when it is absent. Of repeated attributes the last one counts."""
    named = F.filter(_attribute_list(attributes), lambda one: one.rlike(rf"^(?i:{name})\s*+="))
    raw = F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))
    return bind(
        F.regexp_extract(raw, r"(?s)^[^=]*+=\s*+(.*)", 1),
        lambda value: F.when(value.rlike("^[\"']"), value.substr(F.lit(2), F.length(value) - F.lit(2))).otherwise(value),
    )


def has_class(tag: Column, name: str, token: str) -> Column:
    """Whether ``tag``, which may go on after its end, is a ``name`` tag with ``token`` among its classes."""
    attributes = F.regexp_extract(tag, rf"^<(?i:{name})(?=\s)({ATTRIBUTES})>", 1)
    listed = (
        rf"""(?s)^(?i:class)\s*+=\s*+(?:"(?:[^"]*\s)?{token}(?:\s[^"]*)?"|'(?:[^']*\s)?{token}(?:\s[^']*)?'|{token}$)"""
    )
    return F.contains(tag, F.lit(token)) & F.exists(_attribute_list(attributes), lambda one: one.rlike(listed))


def hide_invisible(markup: Column) -> Column:
    """Comments, scripts and styles out. A void tag stays in their place, so text nodes around them stay apart."""
    return F.regexp_replace(F.replace(markup, F.lit(CUT), F.lit(REPLACEMENT)), INVISIBLE, "<wbr>")


def visible_text(markup: Column, separator: str) -> Column:
    """Text nodes, each decoded and stripped, empty ones dropped, joined by ``separator``."""
    nodes = F.transform(cut_at(markup, TAG), lambda node: F.btrim(decode_entities(node), F.lit(BLANK)))
    return F.array_join(F.filter(nodes, lambda node: node != "") if separator else nodes, separator)


def sibling_div(markup: Column, token: str) -> Column:
    """Markup of the first ``div`` of class ``token`` that is not nested in another ``div``; ``''`` if there is none.

    The markup is cut before every ``div`` tag and folded with a depth counter: inner blocks of the wanted ``div`` are
    kept, equally named blocks deeper down are not taken, and the search ends where the parent closes.
    """
    pieces = cut_at(markup, r"<(?=/?[dD][iI][vV][\s>/])", "<")
    # phase 0: looking, 1: inside, 2: done; the wanted pieces are first..first + size - 1
    start = F.struct(*[F.lit(value).alias(name) for name, value in (("depth", 0), ("phase", 0), ("first", 1), ("size", 0))])

    def step(state: Column, piece: Column) -> Column:
        turn = F.when(piece.rlike(r"(?i)^<div[\s>/]"), 1).when(piece.rlike(r"(?i)^</div[\s>/]"), -1).otherwise(0)

        def moved(depth: Column) -> Column:
            wanted = (state["phase"] == 0) & (state["depth"] == 0) & has_class(piece, "div", token)
            return F.struct(
                depth.alias("depth"),
                F.when(wanted, 1)
                .when((state["phase"] == 1) & (depth <= 0), 2)
                .when((state["phase"] == 0) & (depth < 0), 2)
                .otherwise(state["phase"])
                .alias("phase"),
            )

        return bind(
            bind(state["depth"] + turn, moved),
            lambda now: F.struct(
                now["depth"].alias("depth"),
                now["phase"].alias("phase"),
                (state["first"] + F.when(now["phase"] == 0, 1).otherwise(0)).alias("first"),
                (state["size"] + F.when(now["phase"] == 1, 1).otherwise(0)).alias("size"),
            ),
        )

    def found(pieces: Column) -> Column:
        return bind(
            F.aggregate(pieces, start, step),
            lambda state: F.array_join(F.slice(pieces, state["first"], state["size"]), ""),
        )

    return F.when(F.contains(markup, F.lit(token)), bind(pieces, found)).otherwise(F.lit(""))


def article_block(shown: Column) -> Column:
    """Markup of the first article; empty if there is none."""
    return F.regexp_extract(shown, rf"(?s)<(?i:article)(?=[\s>]){ATTRIBUTES}(?:>(.*?)(?:</(?i:article)\s*+>|\z)|\z)", 1)


def whole_text(shown: Column) -> Column:
    """Text of the body, or of all there is; NULL if there is none."""
    body = F.regexp_extract(shown, rf"(?s)<(?i:body)(?=[\s>]){ATTRIBUTES}(?:>(.*+)|\z)", 1)
    return F.nullif(visible_text(bind(body, lambda inner: F.when(inner != "", inner).otherwise(shown)), " "), F.lit(""))


def page_text(page_html: Column) -> Column:
    """Readable text of a web page: the main article block, else the whole body; NULL when neither has text.

    ``maintext.readable_text`` looks for the main block of pages without an article, too.
    """

    def readable(shown: Column) -> Column:
        return bind(visible_text(article_block(shown), " "), lambda main: F.when(main != "", main).otherwise(whole_text(shown)))

    return bind(hide_invisible(page_html), readable)
