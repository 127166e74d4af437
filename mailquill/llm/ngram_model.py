"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers that score.

Tokens are hashed to 64 bits; the sorted hashes of all training tokens are the vocabulary, and a token's place in it is its
id. Pairs of ids are counted in a second pass. Both counts are combined in every task and sent as sorted arrays, one row per
task and shard; shards follow the leading bits of a hash, so they are even however frequent a word is. A shard is merged by
one task, which writes it as plain little-endian arrays into the shared folder, under a name of its own first and then
renamed, so that a repeated task does no harm. Workers map these files and search them; the page cache holds what they touch,
and neither driver nor worker loads a whole table. Nothing is pruned: all tokens and pairs of the training texts count.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquill.session import materialize, shared_folder

SEED = 20
#: Values that stand for the start and the end of a text.
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of a task's cache of word hashes before it is emptied.
CACHE_WORDS = 300_000
#: Tokens that a task counts or scores at once; bounds its memory and changes no result.
BLOCK = 1 << 20
#: Ids of one file of the table by id.
ID_BLOCK = 1 << 16
#: Kinds of whole numbers in which counts are stored, the smallest that holds all of a shard's.
COUNTS = ("<u1", "<u2", "<u4", "<i8")
#: Characters of the training texts for each shard, so that a task holds a bounded part of the tables when it merges one.
SHARD_CHARACTERS = 1 << 26
PARTIAL = "shard int, keys array<bigint>, counts array<bigint>"
STATISTICS = ("context", "n1", "n2", "n3", "n4", "more", "kinds")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text and of its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and 0x20, 0x09-0x0D only
    table = word_hashes()
    found = np.empty(len(words) + 1, np.uint64)
    found[:-1] = np.fromiter([table[word] for word in words], np.uint64, len(words))
    found[-1] = END
    return found


def blocks(batch: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of whole texts one after the other, and where each text ends."""
    block, size = [], 0
    for text in batch:
        block.append(tokens(text))
        size += len(block[-1])
        if size >= BLOCK:
            yield np.concatenate(block), np.cumsum([len(x) for x in block])
            block, size = [], 0
    if block:
        yield np.concatenate(block), np.cumsum([len(x) for x in block])


def before(ids: np.ndarray, ends: np.ndarray, start) -> np.ndarray:
    """What stands before each token; ``start`` before the first of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.concatenate([[0], ends[:-1]])] = start
    return out


def pair_shard(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return leading(mixed ^ (mixed >> np.uint64(32)), bits)


def leading(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def by_shard(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """One row per shard for entries sorted by shard."""
    numbers, first = np.unique(shards, return_index=True)
    return pd.DataFrame(
        {"shard": numbers.astype(np.int32), "keys": np.split(keys.view(np.int64), first[1:]), "counts": np.split(counts, first[1:])}
    )


def merged(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a shard, ascending, with the sums of their counts."""
    keys = np.concatenate(frame["keys"].to_list()).astype(np.int64).view(np.uint64)
    counts = np.concatenate(frame["counts"].to_list())
    order = np.argsort(keys, kind="stable")
    keys, first = np.unique(keys[order], return_index=True)
    return keys, np.add.reduceat(counts[order], first)


def local_path(url: str) -> str:
    parts = urlparse(url)
    if parts.scheme not in ("", "file"):
        raise RuntimeError(f"workers map the model's files, so {url} must be a mounted folder that all of them share")
    return unquote(parts.path)


def store(path: str, values: np.ndarray, kind: str) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    values.astype(kind).tofile(own)
    os.replace(own, path)


def store_counts(path: str, counts: np.ndarray) -> None:
    """Counts in as many bytes as the largest of them needs; the file's name tells."""
    kind = next(kind for kind in COUNTS if counts.max(initial=0) <= np.iinfo(kind).max)
    store(f"{path}.{kind[1:]}", counts, kind)


#: Files that a worker keeps open; others are mapped again when they are needed.
OPEN_FILES = 400


@lru_cache(maxsize=OPEN_FILES)
def mapped(path: str, kind: str) -> np.ndarray:
    """A mapped file; nothing for a shard that no token fell into."""
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, kind)


@lru_cache(maxsize=1 << 16)
def kind_of_counts(path: str) -> str:
    return next((kind for kind in COUNTS if os.path.exists(f"{path}.{kind[1:]}")), COUNTS[-1])


def mapped_counts(path: str) -> np.ndarray:
    kind = kind_of_counts(path)
    return mapped(f"{path}.{kind[1:]}", kind)


@dataclass(frozen=True)
class Model:
    """The folder of the tables and the few numbers that belong to all of them."""

    folder: str
    bits: int  # of a hash that name its shard
    first_ids: tuple[int, ...]  # of each shard of the vocabulary
    tokens: int = 0
    words: int = 0
    discounts: tuple[float, ...] = (0.5, 0.5, 0.5)
    unseen: float = 1.0  # lower-order probability of a token without a count

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 if unknown) and counts of ascending distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for shard, own in slices(leading(hashes, self.bits)):
            keys = mapped(f"{self.folder}/words-{shard}.keys", "<u8")
            at, known = search(keys, hashes[own])
            ids[own] = np.where(known, at + self.first_ids[shard], -1)
            counts[own][known] = mapped_counts(f"{self.folder}/words-{shard}.counts")[at[known]]
        return ids, counts

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of pairs of known ids."""
        shards = pair_shard(keys, self.bits)
        order = np.lexsort((keys, shards))
        counts = np.zeros(len(keys), np.int64)
        for shard, own in slices(shards[order]):
            at, known = search(mapped(f"{self.folder}/pairs-{shard}.keys", "<u8"), keys[order[own]])
            counts[order[own][known]] = mapped_counts(f"{self.folder}/pairs-{shard}.counts")[at[known]]
        return counts

    def by_id(self, ids: np.ndarray, name: str) -> np.ndarray:
        """Values of ascending ids; 0 for -1."""
        values = np.zeros(len(ids))
        for block, own in slices(ids // ID_BLOCK):
            if block >= 0:
                values[own] = mapped(f"{self.folder}/ids-{block}.{name}", "<f8")[ids[own] % ID_BLOCK]
        return values


def slices(numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of an ascending array."""
    values, first = np.unique(numbers, return_index=True)
    last = [*first[1:].tolist(), len(numbers)]
    for value, a, b in zip(values.tolist(), first.tolist(), last):
        yield value, slice(a, b)


def search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    known = at < len(keys)
    known[known] = keys[at[known]] == wanted[known]
    return at, known


def _mapped_frames(texts: DataFrame, count: Callable[[np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for hashes, ends in blocks(batch.iloc[:, 0]):
                yield count(hashes, ends)

    return texts.mapInPandas(partial, PARTIAL)


def _vocabulary(texts: DataFrame, folder: str, bits: int) -> Model:
    def count(hashes: np.ndarray, _: np.ndarray) -> pd.DataFrame:
        keys, counts = np.unique(np.append(hashes, START), return_counts=True)
        counts[keys == START] -= 1  # START has an id and no count
        return by_shard(leading(keys, bits), keys, counts.astype(np.int64))

    def write(shard: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(frame)
        store(f"{folder}/words-{shard[0]}.keys", keys, "<u8")
        store_counts(f"{folder}/words-{shard[0]}.counts", counts)
        return pd.DataFrame({"shard": [shard[0]], "ids": [len(keys)], "n": [counts.sum()], "words": [(counts > 0).sum()]})

    sizes = _mapped_frames(texts, count).groupBy("shard").applyInPandas(write, "shard int, ids bigint, n bigint, words bigint")
    rows = sizes.collect()  # one per shard
    per_shard = np.zeros(1 << bits, np.int64)
    for row in rows:
        per_shard[row["shard"]] = row["ids"]
    if per_shard.sum() >= 1 << 32:
        raise ValueError("ids have 32 bits")
    first = tuple((np.cumsum(per_shard) - per_shard).tolist())
    return Model(folder, bits, first, sum(row["n"] for row in rows), sum(row["words"] for row in rows))


def _statistics(texts: DataFrame, model: Model) -> DataFrame:
    """Writes the pairs; returns for each id what Kneser-Ney needs of it as a context and as a word."""

    def count(hashes: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        distinct, inverse = np.unique(np.append(hashes, START), return_inverse=True)
        ids = model.ids(distinct)[0].astype(np.uint64)
        all_ids = ids[inverse[:-1]]
        keys = (before(all_ids, ends, ids[inverse[-1]]) << np.uint64(32)) | all_ids
        keys, counts = np.unique(keys, return_counts=True)
        shards = pair_shard(keys, model.bits)
        order = np.argsort(shards, kind="stable")
        return by_shard(shards[order], keys[order], counts[order].astype(np.int64))

    def write(shard: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(frame)
        store(f"{model.folder}/pairs-{shard[0]}.keys", keys, "<u8")
        store_counts(f"{model.folder}/pairs-{shard[0]}.counts", counts)
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        contexts, first = np.unique(context, return_index=True)  # keys ascend, so contexts stand together
        add = lambda values: np.add.reduceat(values.astype(np.int64), first)
        levels = {name: add(counts == k) for k, name in enumerate(STATISTICS[1:5], 1)}
        as_context = pd.DataFrame({"id": contexts, "context": add(counts), **levels, "more": add(counts > 4), "kinds": 0})
        words, kinds = np.unique(word, return_counts=True)
        as_word = pd.DataFrame({"id": words, **dict.fromkeys(STATISTICS[:-1], 0), "kinds": kinds})
        return pd.concat([as_context, as_word], ignore_index=True)

    schema = "id bigint, " + ", ".join(f"{name} bigint" for name in STATISTICS)
    partial = _mapped_frames(texts, count).groupBy("shard").applyInPandas(write, schema)
    return partial.groupBy("id").agg(*[F.sum(name).alias(name) for name in STATISTICS])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams seen one to four times.

    0.5 stands for one that is undefined or, as small or odd counts can make it, not between 0 and the count it lowers;
    every context thus keeps something back for unseen words.
    """
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(value if 0 < value < most else 0.5 for most, value in enumerate(raw, 1))


def discounted(counts: np.ndarray, of: tuple[float, ...]) -> np.ndarray:
    return np.where(counts > 0, counts - np.asarray([0.0, *of])[np.minimum(counts, 3)], 0.0)


def fit(texts: DataFrame) -> Model:
    """Learn from every row of ``texts``, a frame with one column; NULL is an empty text.

    The number of shards follows the size of the texts, and ``spark.sql.shuffle.partitions`` where these are small. Driver and
    executors must see the shared folder as files.
    """
    spark = texts.sparkSession
    characters = texts.agg(F.sum(F.length(texts.columns[0]).cast("bigint"))).first()[0] or 0
    folder = local_path(shared_folder(spark, "ngrams"))
    os.makedirs(folder, exist_ok=True)
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-characters // SHARD_CHARACTERS))
    bits = max(1, (shards - 1).bit_length())
    model = _vocabulary(texts, folder, bits)
    statistics = materialize(_statistics(texts, model), "statistics")

    kind = F.when(F.col("kinds") > 4, 5).otherwise(F.col("kinds"))
    levels = [F.count_if(kind == k).alias(f"w{k}") for k in range(1, 6)]
    total = statistics.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in STATISTICS], *levels).first()
    of_pairs = discounts(*(total[name] for name in STATISTICS[1:5]))
    of_words = discounts(*(total[f"w{k}"] for k in range(1, 5)))
    pairs = total["kinds"]
    kept_back = of_words[0] * total["w1"] + of_words[1] * total["w2"] + of_words[2] * (total["w3"] + total["w4"] + total["w5"])
    unseen = (kept_back / pairs if pairs else 1.0) / (model.words + 1)  # spread over all words and one for the unknown

    def write(block: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at = (frame["id"] % ID_BLOCK).to_numpy()
        context = frame["context"].to_numpy()
        back = of_pairs[0] * frame["n1"] + of_pairs[1] * frame["n2"] + of_pairs[2] * (frame["n3"] + frame["n4"] + frame["more"])
        found = {
            "context": context,
            "back": back.to_numpy() / np.maximum(context, 1),
            "low": discounted(frame["kinds"].to_numpy(), of_words) / pairs + unseen,
        }
        for name, values in found.items():
            dense = np.zeros(ID_BLOCK)
            dense[at] = values
            store(f"{folder}/ids-{block[0]}.{name}", dense, "<f8")
        return pd.DataFrame({"block": [block[0]]})

    numbered = statistics.withColumn("block", F.floor(F.col("id") / ID_BLOCK))
    numbered.groupBy("block").applyInPandas(write, "block bigint").agg(F.count(F.lit(1))).collect()
    return Model(folder, bits, model.first_ids, model.tokens, model.words, of_pairs, unseen)


def score_block(model: Model, hashes: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    distinct, inverse = np.unique(np.append(hashes, START), return_inverse=True)
    ids, counts = model.ids(distinct)
    order = np.argsort(ids, kind="stable")  # hash order is id order but for the unknown
    values = {}
    for name in ("context", "back", "low"):
        values[name] = np.zeros(len(ids))
        values[name][order] = model.by_id(ids[order], name)
    low = np.where(values["low"] > 0, values["low"], model.unseen)
    here, start = inverse[:-1], inverse[-1]
    prior = before(here, ends, start)
    seen = np.zeros(len(here), np.int64)
    both = (ids[here] >= 0) & (ids[prior] >= 0)
    keys = (ids[prior[both]].astype(np.uint64) << np.uint64(32)) | ids[here[both]].astype(np.uint64)
    pairs, place = np.unique(keys, return_inverse=True)
    seen[both] = model.pairs(pairs)[place]
    context = values["context"][prior]
    chance = np.where(
        context > 0, discounted(seen, model.discounts) / np.maximum(context, 1) + values["back"][prior] * low[here], low[here]
    )
    first = np.concatenate([[0], ends[:-1]])
    known = counts[here]
    return pd.DataFrame(
        {
            "n_tokens": np.diff(np.concatenate([[0], ends])),
            "n_known": np.add.reduceat((known > 0).astype(np.int64), first),
            "base_score": np.add.reduceat(np.log10((known + 1) / (model.tokens + model.words + 1)), first),
            "score": np.add.reduceat(np.log10(chance), first),
        }
    )


def score_texts(docs: DataFrame, model: Model, text_col: str = "text"):
    """Column with a struct of ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of the whole text.

    ``score`` is the model's log10 probability of the text with its end, ``base_score`` that of add-one word counts. NULL is
    an empty text, whose only token is the end. Without any training text every token has probability 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names and a few numbers

    @F.pandas_udf("n_tokens bigint, n_known bigint, base_score double, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [score_block(shared.value, *block) for block in blocks(batch)]
            yield pd.concat(parts, ignore_index=True)

    return scored(F.col(text_col))
