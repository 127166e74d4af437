"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as a few classes: insult, threat, target, modal, negation, report, quotation mark. Five small transducers
work on a clause: insults weigh more in a row, a threat needs a modal before it, negation and reported speech turn what
follows into a weaker symbol, and a target anywhere in the clause adds to what is left. They are composed once into a single
machine; a clause's weight is that of its path. A text is scored by the clauses that match, not by words.

Function words are fixed values. Which words insult is learned: word beginnings, and whole words, that stand in labelled
toxic texts far more often than in others. A logistic regression turns the weights of matched clauses into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquill.llm.common import RecentTable, bounded_sample, slices
from mailquill.session import materialize

# Function words of English, German, French and Spanish, and English words of threats and insults.
TARGETS = """you your yours yourself u ur he she him her they them their these those people
du dich dir dein deine ihr euch sie ihn tu te toi ton ta vous votre ils elles tus usted ustedes ellos""".split()
MODALS = "will shall going gonna should must ought want wanna werde wirst sollte vais vas devrait voy debería".split()
NEGATIONS = "not no never nor without isn aren wasn don doesn didn nicht kein keine nie ne pas jamais nunca jamás ni".split()
REPORTS = """said says say called calls wrote writes claimed claims told quoted reported according
sagte sagt nannte laut dit disait selon appelé dijo dice según llamó""".split()
THREATS = "kill hurt murder destroy stab shoot strangle beat burn hang töten tuer matar".split()
INSULTS = """idiot idiots moron morons stupid loser losers pathetic worthless disgusting scum trash clown clowns
dumb filthy vermin imbecile""".split()
PRIOR = 3.0  # weight of the listed insults, as log odds
OTHER, INSULT, THREAT, TARGET, MODAL, NEGATION, REPORT, QUOTE = "oitmMnrq"
WEAK = "w"  # a negated or reported insult or threat
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, MODAL, NEGATION, REPORT, QUOTE, WEAK)
CLAUSE_END = re.compile(r"[.,;:!?()\n|]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Transducer:
    """Sequential transducer: ``step`` gives next state, output and factor of a symbol, ``end`` a factor for the last state."""

    start: tuple
    step: Callable[[tuple, str], tuple[tuple, str, float]]
    end: Callable[[tuple], float] = lambda state: 1.0


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Feed the output of ``first`` to ``second``; factors multiply."""

    def step(state: tuple, symbol: str) -> tuple[tuple, str, float]:
        a, out, weight = first.step(state[0], symbol)
        b, out, more = second.step(state[1], out)
        return (a, b), out, weight * more

    return Transducer((first.start, second.start), step, lambda state: first.end(state[0]) * second.end(state[1]))


def insult_run(state: tuple, symbol: str):
    """A second insult in a row weighs half as much again."""
    return (symbol == INSULT,), symbol, 1.5 if state[0] and symbol == INSULT else 1.0


def threat(state: tuple, symbol: str):
    """A threat is one after a modal, up to three words before; else the word is like any other."""
    left = 3 if symbol == MODAL else max(state[0] - 1, 0)
    return (left,), OTHER if symbol == THREAT and not state[0] else symbol, 1.0


def negation(state: tuple, symbol: str):
    """Reaches over the next three words."""
    left = 3 if symbol == NEGATION else max(state[0] - 1, 0)
    weak = state[0] and symbol in (INSULT, THREAT)
    return (left,), WEAK if weak else symbol, 0.3 if weak else 1.0


def reported(state: tuple, symbol: str):
    """Reaches to the end of the clause after a verb of saying, and over quotations."""
    verb, quoted = state
    state = verb or symbol == REPORT, quoted != (symbol == QUOTE)
    weak = (verb or quoted) and symbol in (INSULT, THREAT)
    return state, WEAK if weak else symbol, 0.5 if weak else 1.0


def target(state: tuple, symbol: str):
    """Remembers a target and what is left of insults; both together double the clause."""
    return (state[0] or symbol == TARGET, state[1] or symbol in (INSULT, THREAT)), symbol, 1.0


def grammar() -> Transducer:
    machine = Transducer((False,), insult_run)
    for step, start in ((threat, (0,)), (negation, (0,)), (reported, (False, False))):
        machine = compose(machine, Transducer(start, step))
    return compose(machine, Transducer((False, False), target, lambda state: 2.0 if all(state) else 1.0))


def compiled(machine: Transducer) -> tuple[dict, dict]:
    """The machine as tables over all states that can be reached; state 0 is the start."""
    numbers, table, ends, todo = {machine.start: 0}, {}, {}, [machine.start]
    while todo:
        state = todo.pop()
        ends[numbers[state]] = machine.end(state)
        for symbol in SYMBOLS:
            after, out, weight = machine.step(state, symbol)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            table[numbers[state], symbol] = numbers[after], out, weight
    return table, ends


TABLE, ENDS = compiled(grammar())
FEATURES = ("strongest", "plain", "weak", "threats", "targeted", "clauses")


@dataclass(frozen=True)
class Lexicon:
    """Class of a word and weight of an insult. ``starts`` holds word beginnings, a whole word with a space behind it."""

    starts: dict[str, float] = field(default_factory=dict)
    shortest: int = 3
    longest: int = 7

    def weight(self, word: str) -> float:
        parts = [word[:n] for n in range(self.shortest, min(self.longest, len(word)) + 1)]
        return max((self.starts.get(part, 0.0) for part in [*parts, word + " "]), default=0.0)

    def read(self, word: str) -> tuple[str, float]:
        if word in FIXED:
            return FIXED[word], 1.0
        weight = max(self.weight(word), PRIOR if word in LISTED else 0.0)
        return (INSULT, weight) if weight > 0 else (OTHER, 0.0)


LISTED = frozenset(INSULTS)
FIXED = {
    word: symbol
    for words, symbol in (
        (TARGETS, TARGET), (MODALS, MODAL), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), ('"“”„«»', QUOTE)
    )
    for word in words
}


def clause_scores(clause: str, read: dict[str, tuple[str, float]]) -> tuple[float, float, float, bool]:
    """Weights of plain insults, of weakened symbols and of threats on the clause's path, and whether it has a target."""
    state, plain, weak, threats, factor = 0, 0.0, 0.0, 0.0, 1.0
    for token in TOKEN.findall(clause):
        symbol, lexical = read[token]
        state, out, weight = TABLE[state, symbol]
        if out == INSULT:
            plain += lexical * weight
        elif out == THREAT:
            threats += weight
        elif out == WEAK:
            weak += (lexical if symbol == INSULT else 1.0) * weight
        factor = ENDS[state]
    return plain * factor, weak, threats * factor, factor > 1


class Scorer:
    """Features of texts; each task keeps a table of the words it has read."""

    def __init__(self, lexicon: Lexicon):
        self.table = RecentTable(lambda words: [lexicon.read(word) for word in words])

    def features(self, texts: list[str]) -> list[tuple[float, ...]]:
        lowered = [text.lower() for text in texts]
        words = [LETTERS.findall(text) for text in lowered]
        read = self.table.of(set('"“”„«»').union(*words))
        return [
            self.of_text(text, read) if any(read[w][0] in (INSULT, THREAT) for w in own) else (0.0,) * len(FEATURES)
            for text, own in zip(lowered, map(set, words))
        ]

    def of_text(self, text: str, read: dict) -> tuple[float, ...]:
        strongest = plain = weak = threats = targeted = clauses = 0.0
        for clause in CLAUSE_END.split(text):
            p, w, t, aimed = clause_scores(clause, read)
            if p or w or t:
                strongest = max(strongest, p)
                plain, weak, threats, clauses = plain + p, weak + w, threats + t, clauses + 1
                targeted += aimed
        return strongest, *(math.log1p(x) for x in (plain, weak, threats, targeted, clauses))


@dataclass(frozen=True)
class Training:
    """``rows_per_label`` bounds the sample: about so many texts of each label are used, always the same ones."""

    rows_per_label: int = 5000
    least_texts: int = 3
    least_odds: float = 2.0
    most_words: int = 5000  # word beginnings that are kept, the most telling first


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((features - self.centre) / self.scale @ self.weights + self.bias, -30, 30)))


def learn_lexicon(sample: DataFrame, rows: dict[int, int], training: Training) -> Lexicon:
    """Word beginnings by their log odds between labelled texts, as far as chance does not explain them."""
    lexicon = Lexicon()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(LETTERS.findall((text or "").lower()))
                starts = {w[:n] for w in words for n in range(lexicon.shortest, min(lexicon.longest, len(w)) + 1)}
                for start in starts.union(w + " " for w in words):
                    counts.setdefault(start, [0, 0])[toxic] += 1
            yield pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["start", "clean", "toxic"])

    counts = sample.select("text", "toxic").mapInPandas(counted, "start string, clean bigint, toxic bigint")
    counts = counts.groupBy("start").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    often = counts.where(F.col("toxic") >= training.least_texts)
    a, b, of_a, of_b = F.col("toxic"), F.col("clean"), F.lit(float(rows[1])), F.lit(float(rows[0]))
    odds = F.log((a + 0.5) / (of_a + 1)) - F.log((b + 0.5) / (of_b + 1))
    share = (a + b) / (of_a + of_b)
    # Likelihood ratio of the two shares against a common one; a candidate must stand out among all candidates.
    ratio = 2 * (a * F.log(a / (of_a * share)) + F.when(b > 0, b * F.log(b / (of_b * share))).otherwise(0.0))
    # Written once: its number and its best rows are both asked for.
    often = materialize(often.select("start", "toxic", odds.alias("odds"), ratio.alias("ratio")), "word-beginnings")
    candidates = often.count()
    telling = often.where((F.col("odds") >= training.least_odds) & (F.col("ratio") >= 2 * math.log(max(candidates, 2))))
    best = telling.orderBy(F.desc("ratio"), "start").limit(training.most_words).collect()
    # A beginning that is told nearly always by one longer beginning, or word, gives way to that one.
    texts = {row["start"]: row["toxic"] for row in best}
    wide = {start[:n] for start, k in texts.items() for n in range(1, len(start)) if k >= 0.9 * texts.get(start[:n], math.inf)}
    return Lexicon({row["start"]: row["odds"] for row in best if row["start"] not in wide})


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    design = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge @ beta
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> ToxicityModel:
    """Learn from ``labels`` (``id``, ``toxic`` 0 or 1) of ``docs`` (``id``, ``text``).

    Of labels that repeat an id the largest counts. With no labelled text of one kind, only the listed words count and
    every text scores by a fixed bias.
    """
    known = labels.where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    # The balance is that of the rows that exist, each as often as its text does.
    known = materialize(docs.select("id").join(known, "id"), "labelled-rows")
    marks = bounded_sample(known.distinct(), "toxic", F.col("id"), training.rows_per_label)
    # At most twice rows_per_label ids and flags: the bound that makes this broadcast safe.
    sample = docs.select("id", "text").join(F.broadcast(marks), "id").select("text", "toxic")
    rows = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    shares = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    n = len(FEATURES)
    if not rows.get(0) or not rows.get(1):
        start = np.zeros(n)
        start[0] = 1.0
        return ToxicityModel(Lexicon(), np.zeros(n), np.ones(n), start, -PRIOR)
    lexicon = learn_lexicon(sample, rows, training)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        for batch in batches:
            found = [x for texts in slices(batch["text"]) for x in scorer.features(texts)]
            counts = Counter(zip(found, batch["toxic"]))
            yield pd.DataFrame([(list(x), toxic, times) for (x, toxic), times in counts.items()], columns=["x", "toxic", "n"])

    found = sample.mapInPandas(featured, "x array<double>, toxic int, n bigint").toPandas()
    x, y = np.array(found["x"].to_list()), found["toxic"].to_numpy()
    order = np.lexsort((y, *x.T))
    x, y, times = x[order], y[order], found["n"].to_numpy()[order]
    weight = times * np.where(y == 1, shares[1] / rows[1], shares[0] / rows[0])  # undo the sample's balance
    weight = weight * times.sum() / weight.sum()
    centre, scale = np.average(x, axis=0, weights=weight), None
    scale = np.sqrt(np.average((x - centre) ** 2, axis=0, weights=weight))
    scale[scale == 0] = 1.0
    return ToxicityModel(lexicon, centre, scale, *_regression((x - centre) / scale, y, weight))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """Probability, 0 to 1, that a whole text is toxic. NULL and empty texts have no clause and score by the bias alone."""
    # The lexicon is bounded by Training.most_words.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value.lexicon)
        for batch in batches:
            for texts in slices(batch):
                yield pd.Series(shared.value.scores(np.array(scorer.features(texts))))

    return scored(F.col(text_col))
