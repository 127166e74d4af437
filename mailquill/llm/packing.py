"""Best-fit packing of tokenised documents into sequences of fixed length.

Lengths are whole numbers up to the capacity, so documents of one length, and sequences with one gap, are alike. The rounds
therefore work on runs: a run of documents is a length with an interval of ranks, a run of sequences a gap with an interval
of numbers. Documents are range-sorted and ranked by Spark, once; each round matches a run with its successor, the smallest
gap that holds it, serves competing documents by rank, and updates the gaps. Runs are bounded by the capacity, whatever the
number of documents; the decisions go back to the documents by rank, in place.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailquill.llm.common import RecentTable, slices
from mailquill.operators.ranking import number_rows
from mailquill.session import materialize

#: Characters that a task encodes at once; a longer text is one slice of its own.
SLICE = 1 << 22
#: Words of a generation of a task's table.
TABLE_WORDS = 400_000
#: White space to some and not to others; a text that holds one goes to the tokenizer as a whole.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Fixed value: how the word tokenizer cuts a normalised text into parts.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words that the tokenizer gets as one text.
JOINED = 1000


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, by way of the distinct white-space words of each task."""

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends_word[number] = token.endswith("</w>")
        self.table = RecentTable(self.fill, TABLE_WORDS)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def parts(self, word: str) -> int:
        """How many words the tokenizer makes of one without white space. Letters may become more in its normal form."""
        if word.isalpha():
            return 1
        return len(PARTS.findall(word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)))

    def fill(self, words: list[str]) -> list[bytes]:
        """Ids of many words as one text, cut apart again by the marked last tokens of their parts."""
        # "<" may begin a special token, and white space beyond ASCII is still inside a word here.
        plain = [word for word in words if word and "<" not in word and (word.isascii() or word.split() == [word])]
        found: dict[str, bytes] = {}
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            parts = [self.parts(word) for word in some]
            ids = self.ids(" ".join(some))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if sum(parts) == len(ends) and all(parts):  # parts are never counted too high, so none is too low either
                bounds = [0, *(4 * ends[np.cumsum(parts) - 1]).tolist()]
                raw = ids.tobytes()
                found.update(zip(some, [raw[a:b] for a, b in zip(bounds, bounds[1:])]))
        return [found[word] if word in found else self.ids(word).tobytes() for word in words]

    def simpler(self, text: str) -> str:
        """A text with the same ids, its A-Z folded: not where a special token or a composed letter might depend on them."""
        if "<|" in text:
            return text
        if text.isascii():
            return text.lower()
        folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        normal = unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", folded)
        return folded if normal else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Words are coded by their place among the distinct ones; ids are put back by position, all texts at once."""
        whole = [any(x in text for x in SEPARATORS) for text in texts]
        simple = ["" if odd else self.simpler(text) for odd, text in zip(whole, texts)]
        # The tokenizer cuts between letters and marks itself.
        apart = pc.replace_substring_regex(pa.array(simple, pa.large_string()), "([a-z])([.,])([ \n])", r"\1 \2\3")
        split = pc.ascii_split_whitespace(apart)
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        table = self.table.of(set(words))
        found = [table[word] for word in words]
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, n = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(ends[-1]) + np.repeat(starts[place] - ends[:-1], n)]
        bounds = ends[split.offsets.to_numpy()]
        return [
            self.ids(text).tobytes() if odd else ids[a:b].tobytes()
            for odd, text, a, b in zip(whole, texts, bounds[:-1], bounds[1:])
        ]


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, ``piece``, ``start``, ``length`` and ``ids`` as bytes.

    With ``digest`` the CRC-32 of those bytes, ``ids_crc32``, stands in place of ``ids``. A document is its ids and then
    ``end_id``, so an empty or NULL text is one token. The tokenizer must drop white space, fold case, mark the last token of
    a word and never join words across white space, as the word tokenizer here does. Only documents longer than the capacity
    are cut.
    """
    last, kind = ("ids_crc32", "bigint") if digest else ("ids", "binary")

    @F.pandas_udf(f"tokens bigint, pieces array<{kind}>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, width, end = word_ids(tokenizer_file), 4 * capacity, np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for texts in slices(batch, characters=SLICE):
                whole = [ids + end for ids in encoder.encode(texts)]
                pieces = [[ids[at : at + width] for at in range(0, len(ids), width)] for ids in whole]
                if digest:
                    pieces = [[zlib.crc32(piece) for piece in own] for own in pieces]
                yield pd.DataFrame({"tokens": [len(ids) // 4 for ids in whole], "pieces": pieces})

    cut_up = docs.select(F.col(id_col).alias("id"), cut(F.col(text_col)).alias("c"))
    pieces = cut_up.select("id", "c.tokens", F.posexplode("c.pieces").alias("piece", last))
    start = F.col("piece").cast("bigint") * capacity
    length = F.least(F.lit(capacity), F.col("tokens") - start)
    return pieces.select(F.col("id").alias(id_col), "piece", start.alias("start"), length.alias("length"), last)


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds over runs of documents, longest first: (first rank, count, first sequence, per sequence, offset, length).

    Ranks and sequences count from 0. In a round the run at hand meets its successor, the smallest gap that holds it. The
    lowest ranks are served first; a sequence takes as many of the run as fit, as it would one by one, since its own gap
    then stays the tightest. What finds no gap opens new sequences.
    """
    gaps: list[int] = []  # gaps with open sequences, ascending
    runs: dict[int, deque[tuple[int, int]]] = {}  # gap -> intervals (first sequence, count)
    rounds, rank, opened = [], 0, 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in runs:
                runs[gap] = deque()
                insort(gaps, gap)
            runs[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, count = runs[gap].popleft()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:
                gap, first, count = capacity, opened, -(-todo // (capacity // length))
                opened += count
            each = gap // length
            full = min(count, todo // each)
            if full:
                rounds.append((rank, full * each, first, each, capacity - gap, length))
                leave(gap - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            rest = count - full
            if rest and todo:  # fewer than fill one sequence are left
                rounds.append((rank, todo, first + full, todo, capacity - gap, length))
                leave(gap - todo * length, first + full, 1)
                leave(gap, first + full + 1, rest - 1)
                rank, todo = rank + todo, 0
            else:
                leave(gap, first + full, rest)
    return rounds


def best_fit(pieces: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best fit decreasing, gapless from 0 in each sequence.

    ``keys`` and the length decide the order; rows alike in all of them are interchangeable. An empty table stays empty.
    Lengths are 1 to ``capacity``. Sizes come to the driver as one count per length, at most ``capacity`` of them.
    """
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    rounds = np.asarray(best_fit_rounds(counts, capacity), np.int64).reshape(-1, 6)
    shared = pieces.sparkSession.sparkContext.broadcast(rounds)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def placed(ranks: pd.Series) -> pd.DataFrame:
        first, _, sequence, each, offset, length = shared.value[np.searchsorted(shared.value[:, 0], ranks, "right") - 1].T
        within = ranks.to_numpy() - first
        return pd.DataFrame({"sequence_id": sequence + within // each, "offset": offset + within % each * length})

    ranked = number_rows(pieces, [F.desc("length"), *[F.col(key) for key in keys]], "_rank")
    at = ranked.withColumn("_at", placed(F.col("_rank") - 1))
    return at.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack(
    docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids`` (binary), ``sequence_id``, ``offset``."""
    pieces = token_pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col)
    stored = materialize(pieces, "pieces")
    return best_fit(stored, capacity, [id_col, "piece"])


def pack_digest(
    docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """As ``pack`` with ``ids_crc32`` in place of the ids, so that no token moves through the sort."""
    stored = materialize(token_pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col, digest=True), "pieces")
    return best_fit(stored, capacity, [id_col, "piece"])
