"""Line-first cleaning: judge lines, remove the failing ones, then reject texts that lost too much."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquill.llm.common import slices

SYMBOLS = "#*$%&|<>"
#: Phrases of pages rather than of prose, in English, German, French and Spanish; a short line holding one is boilerplate.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "sign up",
    "subscribe to",
    "terms of use",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "hier klicken",
    "nutzungsbedingungen",
    "zurück nach oben",
    "accepter les cookies",
    "cliquez ici",
    "conditions d'utilisation",
    "politique de confidentialité",
    "retour en haut",
    "tous droits réservés",
    "aceptar cookies",
    "haga clic aquí",
    "política de privacidad",
    "términos de uso",
    "todos los derechos reservados",
    "volver arriba",
)
RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lost_words bigint"
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; shares are of the words of a line, or for ``max_lost`` of the text."""

    min_words: int = 20
    window: int = 8
    max_repeated_percent: int = 30
    marks_per_word: float = 0.3  # symbol characters, as in hash and dollar noise
    bars_per_word: float = 0.12  # navigation: entries between bars
    shouts_per_word: float = 0.3  # runs of exclamation marks
    repeats_per_word: float = 0.3  # words equal to the word before
    open_line_words: int = 3  # a line of at most so many words without a final mark is a heading or a menu entry
    boilerplate_words: int = 20
    max_lost: float = 0.5


RULES = QualityRules()
FINAL = (b".", b"!", b"?", b":", b";", b",", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode())


def line_fails(line: bytes, words: list[bytes], rules: QualityRules = RULES) -> str | None:
    """Name of the first rule that a line with words fails, else None."""
    n = len(words)
    if line.count(b"|") >= rules.bars_per_word * n:
        return "navigation"
    if sum(line.count(mark) for mark in (b"#", b"*", b"$", b"%", b"&")) >= rules.marks_per_word * n:
        return "symbols"
    if line.count(b"!!") >= rules.shouts_per_word * n:
        return "shouting"
    if sum(map(eq, words, words[1:])) >= rules.repeats_per_word * n:
        return "repetition"
    if n <= rules.boilerplate_words:
        lower = line.lower()
        if any(phrase.encode() in lower for phrase in BOILERPLATE):
            return "boilerplate"
        if n <= rules.open_line_words and not line.rstrip().endswith(FINAL):
            return "punctuation"
    return None


def repeated_words(words: list, window: int) -> int:
    """Words inside windows of ``window`` words that are found twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    suspect = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    seen: dict[tuple, int] = {}  # equal hashes only nominate; equal words decide
    found = np.zeros(len(words) + 1, np.int64)
    for at in suspect.tolist():
        first = seen.setdefault(tuple(words[at : at + window]), at)
        if first != at:
            for start in (first, at):
                found[start] += 1
                found[start + window] -= 1
    return int((np.cumsum(found) > 0).sum())


def judge(text: str | None, rules: QualityRules = RULES) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # on bytes: space and 0x09 to 0x0D only
    n = len(words)
    chars = len((text or "").translate(SPACES)) if text else 0
    symbols = sum(raw.count(mark.encode()) for mark in SYMBOLS)
    seen, twice, lost, kept_lines = set(), 0, 0, []
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            twice += line in seen
            seen.add(line)
            if line_fails(line, own, rules):
                lost += len(own)
                continue
        kept_lines.append(line)
    repeats = repeated_words(words, rules.window)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeated_percent * n
    kept = not failed and lost <= rules.max_lost * n
    return n, chars, symbols, twice, repeats, failed, kept, lost, b"\n".join(kept_lines).decode("utf-8", "surrogatepass")


SPACES = {code: None for code in (0x20, *range(0x09, 0x0E))}


def quality(text: Column, rules: QualityRules = RULES, cleaned: bool = False) -> Column:
    """Struct of counts and verdicts of every whole text, with ``cleaned`` also the text without failing lines.

    NULL and empty texts have no words, fail ``min_words`` and are not kept. A text is kept unless it fails the base
    rules (too few words, too many words in repeated windows) or loses more than ``max_lost`` of its words with the
    lines that fail a line rule. Lines without a word never fail and stay.
    """
    schema = f"{RESULT}, cleaned string" if cleaned else RESULT
    names = [part.split()[0] for part in schema.split(",")]

    @F.pandas_udf(schema)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts in slices(batch):
                yield pd.DataFrame([judge(x, rules)[: len(names)] for x in texts], columns=names)

    return judged(text)
