"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, ``LEAST`` words and ``EXPONENT`` periods at least, that cannot be extended.
For a period in (L, 2 L] it holds an aligned block of L words, a dyadic one, that occurs again q words later. So each block asks where
it occurs in the window of L starts beyond its neighbour: the suffixes that begin with the block are an interval of the suffix
array, and a wavelet tree over the array gives the next place in an interval after a given one. Occurrences in such a window
form a progression. One or two of them are candidate periods; three or more have the block's own period as
difference, and then only the ends of the two stretches with that period can tell a longer one. Candidates are extended by
the classes of equal blocks, which sorting the suffixes by doubling has left for every length.

Many texts go through the arrays at once; ranks belong to a text, so nothing is found across two of them. Suffixes whose first
words are found once in a text have no block to ask about and leave the sorting early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquill.llm.common import slices

#: Fixed by the search: shorter runs or fewer periods need not hold an aligned block twice.
LEAST, EXPONENT, BLOCK = 24, 3, 8
#: Characters of the texts that go through the arrays at once, or one longer text.
SLICE = 1 << 20
_FOUND = "n_words bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string"


class WaveletTree:
    """Of numbers below ``bound``, as a matrix: at every bit from the highest the zeros go before the ones."""

    def __init__(self, numbers: np.ndarray, bound: int):
        self.bits = range(max(1, bound.bit_length()) - 1, -1, -1)
        self.zeros, self.n_zeros = [], []
        for bit in self.bits:
            one = (numbers >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            self.n_zeros.append(self.zeros[-1][-1])
            numbers = np.concatenate([numbers[~one], numbers[one]])

    def less(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many numbers of the places [low, high) are less."""
        count = np.zeros(len(low), np.int64)
        for bit, zeros, n_zeros in zip(self.bits, self.zeros, self.n_zeros):
            left, right = zeros[low], zeros[high]
            one = (than >> bit & 1).astype(bool)
            count += np.where(one, right - left, 0)
            low, high = np.where(one, n_zeros + low - left, left), np.where(one, n_zeros + high - right, right)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest number, from 0, of the places [low, high)."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros, n_zeros in zip(self.bits, self.zeros, self.n_zeros):
            left, right = zeros[low], zeros[high]
            one = n >= right - left
            found |= one.astype(np.int64) << bit
            n = np.where(one, n - (right - left), n)
            low, high = np.where(one, n_zeros + low - left, left), np.where(one, n_zeros + high - right, right)
        return found


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted key where each group begins, and its size."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


class Suffixes:
    """The suffixes of several texts of word numbers, sorted by doubling while one of their beginnings is found again.

    For L = 1, 2, 4, ..., ``begin[L][place]`` names the class of suffixes of a text that share their first L words, -1 where there
    is one only. From ``BLOCK`` on a class is the interval [begin, end) of ``array``. Nothing begins at the last place, the
    number of words.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, longest: int):
        self.n, self.begin, self.end = len(words), {}, {}
        places, key, length = np.arange(self.n), text * (int(words.max(initial=0)) + 1) + words, 1
        while True:
            order = np.argsort(key, kind="stable")
            first, size = _groups(key[order])
            again = size > 1
            places, size = places[order[np.repeat(again, size)]], size[again]
            begin = np.repeat(np.cumsum(size) - size, size)
            self._note(length, places, begin, np.repeat(size, size))
            if length == BLOCK:
                break
            second = self.begin[length][np.minimum(places + length, self.n)]
            places, key = places[second >= 0], (begin * (self.n + 1) + second)[second >= 0]
            length *= 2
        self.array = places.copy()
        while len(places) and 2 * length * EXPONENT <= longest:
            # Members of a class stay in its interval, in the order of what follows; those followed by a single one go first.
            second = self.begin[length][np.minimum(places + length, self.n)]
            key = begin * (self.n + 2) + second + 1
            order = np.argsort(key, kind="stable")
            places, begin, second, key = places[order], begin[order], second[order], key[order]
            first, size = _groups(begin)
            slot = begin + np.arange(len(begin)) - np.repeat(first, size)
            self.array[slot] = places
            first, size = _groups(key)
            begin, size = np.repeat(slot[first], size), np.repeat(size, size)
            again = (second >= 0) & (size > 1)
            places, begin, size = places[again], begin[again], size[again]
            length *= 2
            self._note(length, places, begin, size)

    def _note(self, length: int, places: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.begin[length], self.end[length] = (np.full(self.n + 1, -1, np.int64) for _ in range(2))
        self.begin[length][places], self.end[length][places] = begin, begin + size

    def alike_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on are those from ``j`` on, in the same text."""
        return self._alike(i, j, lambda at, length: at, 1)

    def alike_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._alike(i, j, lambda at, length: np.where(at >= length, at - length, self.n), -1)

    def _alike(self, i: np.ndarray, j: np.ndarray, block, step: int) -> np.ndarray:
        total = np.zeros(len(i), np.int64)
        lengths = sorted(self.begin, reverse=True)
        for length in lengths:
            begin, open_ = self.begin[length], np.arange(len(i))
            while len(open_):
                a, b = (np.minimum(block(x[open_] + step * total[open_], length), self.n) for x in (i, j))
                open_ = open_[(begin[a] >= 0) & (begin[a] == begin[b])]
                total[open_] += length
                if length < lengths[0]:  # a shorter block can follow a longer one once only
                    break
        return total


def _candidates(suffixes: Suffixes, starts: np.ndarray, tree: WaveletTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and distances at which a run may have its period; ``starts`` is where the text of each word begins."""
    for length in [length for length in suffixes.begin if length >= BLOCK]:
        begin, end = suffixes.begin[length], suffixes.end[length]
        block = np.flatnonzero(begin[:-1] >= 0)
        block = block[(block - starts[block]) % length == 0]
        for window in (0, 1) if length == BLOCK else (1,):
            low, high = begin[block], end[block]
            skipped = tree.less(low, high, block + window * length + 1)
            count = tree.less(low, high, block + (window + 1) * length + 1) - skipped
            found = count > 0
            at, low, high, skipped, count = block[found], low[found], high[found], skipped[found], count[found]
            one = tree.nth(low, high, skipped)
            few = count <= 2
            yield at[few], (one - at)[few]
            several = count > 1
            two = tree.nth(low[several], high[several], skipped[several] + 1)
            at, one, few = at[several], one[several], few[several]
            yield at[few], (two - at)[few]
            at, one, own = at[~few], one[~few], (two - one)[~few]
            yield at, own  # where the block and its occurrences lie in one stretch
            bounds = []
            for place in (at, one):
                bounds.append(place - suffixes.alike_before(place, place + own))
                bounds.append(place + own + suffixes.alike_after(place, place + own))
            for distance in (bounds[2] - bounds[0], bounds[3] - bounds[1]):
                yield at[distance > 0], distance[distance > 0]


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text of word numbers its runs, one row of start, length and period each, by start and period."""
    sizes = np.array([len(text) for text in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    suffixes = Suffixes(np.concatenate([*texts, np.empty(0, np.int64)]), owner, int(sizes.max(initial=0)))
    runs = np.empty((0, 3), np.int64)
    if len(suffixes.array):
        tree = WaveletTree(suffixes.array, suffixes.n + 1)
        place, period = (np.concatenate(part) for part in zip(*_candidates(suffixes, starts[owner], tree)))
        first = place - suffixes.alike_before(place, place + period)
        length = place + period + suffixes.alike_after(place, place + period) - first
        long_enough = length >= np.maximum(LEAST, EXPONENT * period)
        runs = np.unique(np.stack([first, length, period], axis=1)[long_enough], axis=0)
        if len(runs):  # multiples of a period give the same stretch; the smallest comes first
            runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])]
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text = owner[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    return [runs[a:b] - [start, 0, 0] for a, b, start in zip(bounds[:-1], bounds[1:], starts)]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those of runs after their first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[place] for place in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(text: Column) -> Column:
    """Struct of ``n_words``, ``runs`` (array of struct ``start``, ``length``, ``period``, by start and period) and ``collapsed``.

    Words are what stands between white space of ASCII, and numbered from 0. ``collapsed`` is the words joined by one space,
    without those that a run holds after its first period. NULL, empty and blank texts have no word and no run.
    """

    @F.pandas_udf(_FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for texts in slices(batch, SLICE):
                words = [text.encode("utf-8", "surrogatepass").split() for text in texts]
                sizes = [len(own) for own in words]
                numbers = pa.array([word for own in words for word in own], pa.large_binary()).dictionary_encode()
                numbers = numbers.indices.to_numpy().astype(np.int64)
                runs = find_runs(np.split(numbers, np.cumsum(sizes)[:-1]))
                for own, found in zip(words, runs):
                    rows.append((len(own), *found.T, _collapsed(own, found).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    parts = found(text)
    zipped = F.arrays_zip(parts["starts"].alias("start"), parts["lengths"].alias("length"), parts["periods"].alias("period"))
    return F.struct(parts["n_words"].alias("n_words"), zipped.alias("runs"), parts["collapsed"].alias("collapsed"))
