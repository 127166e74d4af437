"""Scoring expressions: keyword exclusion, word rules, model prompts and model replies."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquill.functions.bind import bind
from mailquill.functions.keywords import first_keyword

# Tiers, word lists and reasons of the built-in rules.
HIGH, MEDIUM, LOW, ERROR = "High", "Medium", "Low", "Error"
HIGH_WORDS = ("catalyst", "dft", "single-atom", "co2rr")
MEDIUM_WORDS = ("review",)
LOW_WORDS = ("battery", "biomass")
HIGH_REASON = "Mock reason: Contains primary keywords."
MEDIUM_REASON = "Mock reason: Appears to be a review article."
LOW_REASON = "Mock reason: Contains exclusion keywords (mock)."
DEFAULT_REASON = "Mock reason: Default low relevance."
EXCLUDED_REASON = "Auto-excluded by keyword: "

SCORE_FIELDS = "score string, reason string"

FORMAT_INSTRUCTIONS = (
    'Return one JSON object with two string fields: "score" (High, Medium, or Low) and "reason" (a brief reason).'
)


@dataclass(frozen=True)
class WordRules:
    high: tuple[str, ...] = HIGH_WORDS
    medium: tuple[str, ...] = MEDIUM_WORDS
    low: tuple[str, ...] = LOW_WORDS


def _contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lower(F.lit(word)))
    return hit


#: A list is searched word by word up to this length, and by an automaton beyond; both find the same keyword.
SHORT_LIST = 100


def excluded_by(text: Column, keywords) -> Column:
    """First keyword, in list order, that occurs in the lower-cased ``text``; NULL when none does."""
    hit = F.lit(None).cast("string")
    if not keywords:
        return hit
    if len(keywords) > SHORT_LIST:
        return first_keyword(text, keywords)
    # One array of constants keeps the generated code small, however many words there are.
    pairs = [F.struct(F.lit(word).alias("word"), F.lower(F.lit(word)).alias("lower")) for word in keywords]
    return F.get(F.filter(F.array(*pairs), lambda pair: F.contains(text, pair["lower"])), F.lit(0))["word"]


def exclusion_reason(text: Column, keywords) -> Column:
    return F.concat(F.lit(EXCLUDED_REASON), excluded_by(text, keywords))


def rule_score(text: Column, rules: WordRules = WordRules()) -> Column:
    """``struct<score,reason>`` by words in the lower-cased ``text``. A low word overrides every other."""

    def verdict(score: str, reason: str) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))

    return (
        F.when(_contains_any(text, rules.low), verdict(LOW, LOW_REASON))
        .when(_contains_any(text, rules.high), verdict(HIGH, HIGH_REASON))
        .when(_contains_any(text, rules.medium), verdict(MEDIUM, MEDIUM_REASON))
        .otherwise(verdict(LOW, DEFAULT_REASON))
    )


def render_prompt(
    title: Column, summary: Column, template: str, format_instructions: str = FORMAT_INSTRUCTIONS
) -> Column:
    """Prompt text per article. ``{{`` and ``}}`` in the template stand for braces; ``{title}``, ``{summary}`` and
    ``{format_instructions}`` are filled in."""
    fields = {
        "title": F.coalesce(title, F.lit("")),
        "summary": F.coalesce(summary, F.lit("")),
        "format_instructions": F.lit(format_instructions),
    }
    whole = template + "\n{format_instructions}\nArticle Title: {title}\nArticle Summary: {summary}"
    parts = []
    for literal, field, _, _ in Formatter().parse(whole):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(fields[field])
    return F.concat(*parts)


def parse_reply(reply: Column) -> Column:
    """Model reply to ``struct<score,reason>``.

    The reply may be bare JSON or stand in a code fence, and an object that was cut off inside its last value is closed.
    What cannot be read, or lacks a field, becomes an ``Error`` row, so a bad reply never stops a run.
    """
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?(.*)", 1)
    bare = F.btrim(F.when(F.contains(reply, F.lit("```")), fenced).otherwise(reply), F.lit(" \n\r\t`"))

    def read(text: Column) -> Column:
        return bind(
            F.from_json(text, SCORE_FIELDS),
            lambda parsed: F.when(parsed["score"].isNotNull() | parsed["reason"].isNotNull(), parsed),
        )

    def closed(body: Column) -> Column:
        last_pair = F.regexp_extract(body, r'(?s)^(\{.*"[^"]*"\s*:\s*"(?:[^"\\]++|\\.)*+")\s*,', 1)
        return F.when(
            body.startswith("{"),
            F.coalesce(
                read(body),
                read(F.concat(body, F.lit("}"))),
                read(F.concat(body, F.lit('"}'))),
                read(F.concat(last_pair, F.lit("}"))),
            ),
        )

    def judged(parsed: Column) -> Column:
        problem = (
            F.when(parsed.isNull(), F.concat(F.lit("Invalid json output: "), F.coalesce(reply, F.lit(""))))
            .when(parsed["score"].isNull(), F.lit("'score'"))
            .when(parsed["reason"].isNull(), F.lit("'reason'"))
        )
        return F.struct(
            F.when(parsed["reason"].isNull(), F.lit(ERROR)).otherwise(F.coalesce(parsed["score"], F.lit(ERROR))).alias("score"),
            F.coalesce(problem, parsed["reason"]).alias("reason"),
        )

    return bind(bind(bare, closed), judged)
