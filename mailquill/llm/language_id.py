"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

Subwords are runs of three and four bytes inside a word with a space on either side. Their embeddings are averaged over the
whole text and classified. Both layers are trained together by stochastic gradient descent on a bounded sample; afterwards
they are multiplied out, so that a text costs one look-up and one sum per subword. A temperature is fitted on rows kept
apart from training, and then the smallest confidence at which accepted rows reach the wanted precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquill.llm.common import bounded_sample

UNDETERMINED = "und"
SIZES = (3, 4)  # bytes of a subword
#: Bytes of a text that a task looks at together; whole texts count, whatever their length.
SLICE = 1 << 20
SPACE = 32
LETTERS = np.full(256, SPACE, np.uint8)  # ASCII letters and all bytes of other characters stay, the rest is space
LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Training:
    """``rows_per_language`` bounds the sample: about so many rows of each language are fetched, always the same ones."""

    rows_per_language: int = 600
    buckets: int = 1 << 15
    dimensions: int = 16
    epochs: int = 5
    rate: float = 0.1
    precision: float = 0.99
    seed: int = 7


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # subword bucket x language: embedding times output layer
    bias: np.ndarray
    temperature: float
    threshold: float  # confidence below which a prediction is not accepted


def subwords(text: str | None, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all subwords of a text, slice by slice."""
    raw = (text or "").lower().encode("utf-8", "replace")
    most = max(SIZES)
    for at in range(0, len(raw) + 2, SLICE):  # one byte of space before and after
        part = raw[max(at - 1, 0) : at - 1 + SLICE + most - 1]
        part = (b" " if at == 0 else b"") + part + b" " * (at - 1 + SLICE + most - 1 > len(raw))
        codes = LETTERS[np.frombuffer(part, np.uint8)]
        inside = codes != SPACE
        wide = codes.astype(np.uint32)
        for size in SIZES:
            n = min(len(codes) - size + 1, SLICE)
            if n <= 0:
                continue
            keep, mixed = np.ones(n, bool), np.full(n, size, np.uint32)
            for k in range(size):
                mixed = mixed * np.uint32(0x01000193) ^ wide[k : k + n]
                if 0 < k < size - 1:
                    keep &= inside[k : k + n]
            yield ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(8))[keep] % np.uint32(buckets)


def examples(text: str, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares: of the whole text and, so that short texts are known, of its middle line and of
    four words from the middle of that line.
    """
    lines = [line for line in text.split("\n") if line.strip()]
    if not lines:
        return
    words = lines[len(lines) // 2].split()
    for part in dict.fromkeys((text, " ".join(words), " ".join(words[len(words) // 2 :][:4]))):
        counts = sum((np.bincount(found, minlength=buckets) for found in subwords(part, buckets)), np.zeros(buckets, np.int64))
        held = np.flatnonzero(counts)
        if len(held):
            yield held.astype(np.int32), (counts[held] / counts.sum()).astype(np.float32)


def fetch_examples(rows: DataFrame, training: Training) -> pd.DataFrame:
    """``lang``, ``apart``, ``held``, ``shares`` of the sample of ``id``, ``text``, ``lang``; text stays on the executors."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (lang, apart, held, shares)
                for lang, text, apart in zip(batch["lang"], batch["text"], batch["apart"])
                for held, shares in examples(text, training.buckets)
            ]
            yield pd.DataFrame(found, columns=["lang", "apart", "held", "shares"])

    sample = bounded_sample(rows, "lang", F.col("id"), training.rows_per_language)
    apart = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("apart")), F.lit(5)) == 0
    sample = sample.select("lang", "text", apart.alias("apart"))
    schema = "lang string, apart boolean, held array<int>, shares array<float>"
    return sample.mapInPandas(features, schema).toPandas()


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def train(found: pd.DataFrame, training: Training) -> LanguageModel | None:
    """None if there is nothing to learn from."""
    languages = tuple(sorted(found["lang"].unique()))
    if not languages:
        return None
    order = np.random.default_rng(training.seed)
    found = found.sort_values("lang", kind="stable").reset_index(drop=True)
    classes = found["lang"].map({lang: at for at, lang in enumerate(languages)}).to_numpy()
    held, shares = [np.asarray(x) for x in found["held"]], [np.asarray(x) for x in found["shares"]]
    # Rows that arrive in another order must not change the model.
    rank = sorted(range(len(found)), key=lambda row: (classes[row], len(held[row]), held[row].tobytes(), shares[row].tobytes()))
    learn = [row for row in rank if not found["apart"][row]] or rank
    apart = [row for row in rank if found["apart"][row]] or rank

    embedding = order.uniform(-1, 1, (training.buckets, training.dimensions)).astype(np.float32) / training.dimensions
    output = np.zeros((training.dimensions, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    weight = len(learn) / (len(languages) * np.maximum(np.bincount(classes[learn], minlength=len(languages)), 1))
    # Every parameter's step shrinks with the gradients it has had, so frequent and rare subwords learn alike.
    had, had_output = np.full_like(embedding, 1e-8), np.full_like(output, 1e-8)
    for _ in range(training.epochs):
        for row in order.permutation(learn):
            average = shares[row] @ embedding[held[row]]
            error = _softmax(average @ output + bias)
            error[classes[row]] -= 1
            error *= np.float32(min(weight[classes[row]], 5.0))
            slope, slope_output = np.outer(shares[row], output @ error), np.outer(average, error)
            had[held[row]] += slope**2
            embedding[held[row]] -= training.rate * slope / np.sqrt(had[held[row]])
            had_output += slope_output**2
            output -= training.rate * slope_output / np.sqrt(had_output)
            bias -= np.float32(0.01) * error
    weights = embedding @ output

    scores = np.stack([shares[row] @ weights[held[row]] + bias for row in apart])
    truth = classes[apart]
    loss = lambda t: -np.log(np.maximum(_softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.002, 20, 81), key=loss))
    sure = _softmax(scores / temperature)
    confidence, right = sure.max(axis=1), sure.argmax(axis=1) == truth
    down = np.argsort(-confidence, kind="stable")
    precise = np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= training.precision
    threshold = float(confidence[down][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return LanguageModel(languages, weights.astype(np.float32), bias, temperature, threshold)


def fit(rows: DataFrame, training: Training = Training()) -> LanguageModel | None:
    """Learn from ``id``, ``text``, ``lang``; rows without text or lang teach nothing. The id only draws the sample."""
    return train(fetch_examples(rows.where("text IS NOT NULL AND lang IS NOT NULL"), training), training)


def classify(model: LanguageModel, text: str | None) -> tuple[str, float]:
    total, n = np.zeros(len(model.languages)), 0
    for found in subwords(text, len(model.weights)):
        total += model.weights[found].sum(axis=0, dtype=np.float64)
        n += len(found)
    chances = _softmax((total / max(n, 1) + model.bias) / model.temperature)
    best = int(chances.argmax())
    return model.languages[best], float(chances[best])


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> Column:
    """Struct of ``lang_pred``, ``score`` and ``accepted`` for every whole text.

    A text that is NULL, empty or without a letter gets ``und``, score 0 and is not accepted; so does every text without a
    model. All others get the likeliest learned language with its calibrated probability, accepted from the threshold on.
    """
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    none = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    if model is None:
        return none
    # As large as buckets x languages, whatever the number of documents.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def classified(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts, letters in batches:
            found = [classify(model, x) if ok else (UNDETERMINED, 0.0) for x, ok in zip(texts, letters)]
            frame = pd.DataFrame(found, columns=["lang_pred", "score"])
            frame["accepted"] = letters.to_numpy() & (frame["score"] >= model.threshold)
            yield frame

    return classified(F.col(text_col), has_letter)
