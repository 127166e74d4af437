"""SentencePiece ids by a table of distinct marked words.

No piece of the model continues past a whitespace marker, so a text's ids are those of its marked words one after the
other. ``word_table`` collects the distinct marked words of all texts: each task sends its own once, Spark combines them, and
each is segmented once with the library. The table lies in the shared folder as arrays sorted by hash, in shards that workers map.
Texts are then split, their words looked up, and ids put back by position; only distinct words of tasks ever move.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquill.llm.common import RecentTable, slices
from mailquill.llm.ngram_model import leading, local_path, mapped, search, store
from mailquill.llm.ngram_model import slices as runs
from mailquill.session import materialize, shared_folder

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Words that a task keeps at hand; bounds a worker's memory and changes no result.
TABLE_WORDS = 250_000
#: Characters of the texts that are split at once, and words of the table for each shard.
SLICE, SHARD_WORDS, SEED = 1 << 20, 1 << 18, 4
RESULT = "ids string, n_tokens bigint, decoded string"


class Pieces:
    """Ids and decoded text of single marked words."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        if self.model.encode(" a") != self.model.encode(f"{MARK}a") or self.model.decode(self.model.encode("  a ")) != "  a ":
            raise ValueError("this model changes or joins white space; words cannot be segmented one by one")

        self.pieces = pieces

    def segment(self, chunks: list[str]) -> list[tuple[str, str]]:
        """Of marked words their ids, as decimals each followed by a comma, and their decoded text."""
        # The library marks the start of a text itself. Decoding drops that mark again.
        coded, out = self.model.encode([chunk[1:].replace(MARK, " ") for chunk in chunks], num_threads=1), []
        for chunk, ids in zip(chunks, coded):
            if len(chunk) == 1:
                out.append((f"{self.model.piece_to_id(MARK)},", " "))
                continue
            # Pieces that spell the word decode to it; bytes and unknown characters are left to the library.
            spelt = "".join([self.pieces[i] for i in ids]) == chunk
            out.append(("".join([f"{i}," for i in ids]), chunk.replace(MARK, " ") if spelt else " " + self.model.decode(ids)))
        return out


@lru_cache(maxsize=2)
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


def plain(text: str) -> bool:
    """Whether the marked words of a text are what stands between its spaces."""
    return bool(text) and not ("  " in text or MARK in text or text[0] == " " or text[-1] == " ")


def split(texts: list[str]) -> tuple[list[bool], list[str], np.ndarray, np.ndarray]:
    """Which texts are plain; the distinct marked words of all, their places in the texts and where each text ends."""
    simple = [plain(text) for text in texts]
    words = pc.split_pattern(pa.array([text for text, own in zip(texts, simple) if own], pa.large_string()), " ")
    odd = [CHUNK.findall(MARK + text.replace(" ", MARK)) if text and not own else [] for text, own in zip(texts, simple)]
    coded = words.flatten().dictionary_encode()
    distinct = [MARK + word for word in coded.dictionary.to_pylist()]
    known = {word: n for n, word in enumerate(distinct)}
    places, sizes, at = [], np.zeros(len(texts), np.int64), 0
    indices, offsets = coded.indices.to_numpy().astype(np.int64), words.offsets.to_numpy()
    for n, (own, chunks) in enumerate(zip(simple, odd)):
        if own:
            part = indices[offsets[at] : offsets[at + 1]]
            at += 1
        else:
            part = np.array([known.setdefault(word, len(known)) for word in chunks], np.int64)
        places.append(part)
        sizes[n] = len(part)
    return simple, list(known), np.concatenate([*places, np.empty(0, np.int64)]), np.cumsum(sizes)


@dataclass(frozen=True)
class WordTable:
    """The folder of the table and the bits of a hash that name a shard."""

    folder: str
    bits: int

    def find(self, words: list[str]) -> dict[str, tuple[str, str]]:
        """Those of the words that the table has, told by their bytes and not by their hash alone."""
        raw = [word.encode("utf-8", "surrogatepass") for word in words]
        hashes = np.fromiter((xxhash.xxh64_intdigest(word, SEED) for word in raw), np.uint64, len(raw))
        order, found = np.argsort(hashes, kind="stable"), {}
        hashes = hashes[order]
        for shard, own in runs(leading(hashes, self.bits)):
            keys, ends, blob = (mapped(f"{self.folder}/{shard}.{name}", kind) for name, kind in (("keys", "<u8"), ("ends", "<u8"), ("blob", "u1")))
            at, known = search(keys, hashes[own])
            places, numbers, bytes_of = at[known], order[own][known].tolist(), memoryview(blob)
            first_of = np.where(places > 0, ends[np.maximum(3 * places - 1, 0)], 0)  # only the entries asked for are touched
            cuts = zip(places.tolist(), numbers, first_of.tolist(), *(ends[3 * places + k].tolist() for k in range(3)))
            for place, n, first, a, b, c in cuts:
                while bytes_of[first:a] != raw[n] and place + 1 < len(keys) and keys[place + 1] == keys[place]:
                    place += 1  # another word of the same hash
                    first, a, b, c = ends[3 * place - 1 : 3 * place + 3].tolist()
                if bytes_of[first:a] == raw[n]:
                    text = str(bytes_of[b:c], "utf-8", "surrogatepass") if c > b else words[n].replace(MARK, " ")
                    found[words[n]] = str(bytes_of[a:b], "ascii"), text
        return found


def word_table(docs: DataFrame, model_file: str, text_col: str = "text") -> WordTable:
    """Segment every distinct marked word of all texts once. NULL and empty texts have none.

    Driver and executors must see the shared folder as files.
    """
    spark = docs.sparkSession

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for texts in slices(batch.column(0).to_pylist(), SLICE):
                new = set(split(texts)[1]).difference(seen)
                if len(seen) + len(new) > TABLE_WORDS:
                    seen = set()
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string()).cast(pa.binary())], names=["word"])

    words = materialize(docs.select(text_col).mapInArrow(distinct, "word binary").distinct(), "words")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // SHARD_WORDS))
    bits = max(1, (shards - 1).bit_length())
    folder = local_path(shared_folder(spark, "marked-words"))
    os.makedirs(folder, exist_ok=True)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = np.fromiter((xxhash.xxh64_intdigest(word, SEED) for word in batch["word"]), np.uint64, len(batch))
            yield pd.DataFrame({"shard": leading(hashes, bits).astype(np.int32), "hash": hashes.view(np.int64), "word": batch["word"]})

    def write(shard: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = pieces_of(model_file)
        keys = frame["hash"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.lexsort((np.arange(len(keys)), keys))
        raw = [bytes(word) for word in frame["word"].iloc[order]]
        chunks = [word.decode("utf-8", "surrogatepass") for word in raw]
        parts = []
        for word, chunk, (ids, text) in zip(raw, chunks, own.segment(chunks)):
            # The decoded text is the word itself as a rule, and then left out.
            parts += (word, ids.encode(), b"" if text == chunk.replace(MARK, " ") else text.encode("utf-8", "surrogatepass"))
        store(f"{folder}/{shard[0]}.keys", keys[order], "<u8")
        store(f"{folder}/{shard[0]}.ends", np.cumsum([len(part) for part in parts]), "<u8")
        store(f"{folder}/{shard[0]}.blob", np.frombuffer(b"".join(parts), np.uint8), "u1")
        return pd.DataFrame({"shard": [shard[0]], "n": [len(raw)]})

    keyed = words.mapInPandas(numbered, "shard int, hash bigint, word binary")
    keyed.groupBy("shard").applyInPandas(write, "shard int, n bigint").agg(F.sum("n")).collect()
    return WordTable(folder, bits)


class Encoder:
    """A worker's encoder: words at hand, then the shared table, then the library for words that no table has."""

    def __init__(self, model_file: str, table: WordTable | None):
        self.pieces, self.table, self.recent = pieces_of(model_file), table, RecentTable(self.fill, TABLE_WORDS)

    def fill(self, words: list[str]) -> list[tuple[str, str]]:
        found = self.table.find(words) if self.table else {}
        new = [word for word in words if word not in found] if found else words
        found.update(zip(new, self.pieces.segment(new)) if new else ())
        return [found[word] for word in words]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, int, bytes]]:
        """Ids joined by commas, their number and the decoded text, in UTF-8, for each text."""
        _, distinct, places, ends = split(texts)
        table = self.recent.of(set(distinct))
        found = [table[word] for word in distinct]
        counts = np.array([ids.count(",") for ids, _ in found], np.int64)[places]
        bounds = np.concatenate([[0], ends])
        joined = []
        for k in (0, 1):
            # What is put back by position lies in one buffer, of which a text's words are a part.
            by_place = pa.array([entry[k] for entry in found], pa.large_string()).take(pa.array(places))
            data = by_place.buffers()[2].to_pybytes() if len(places) else b""
            cuts = np.frombuffer(by_place.buffers()[1], np.int64)[bounds] if len(places) else np.zeros_like(bounds)
            joined.append([data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
        before = np.concatenate([[0], np.cumsum(counts)])
        for ids, n, decoded in zip(joined[0], np.diff(before[bounds]).tolist(), joined[1]):
            yield ids[:-1], n, decoded[1:]


@lru_cache(maxsize=2)
def encoder(model_file: str, table: WordTable | None) -> Encoder:
    return Encoder(model_file, table)


def encode_decode(text: Column, model_file: str, table: WordTable | None = None) -> Column:
    """Struct of ``ids`` (decimals joined by commas), ``n_tokens`` and ``decoded`` of a text.

    NULL and empty texts have no ids and decode to the empty text. Texts are never cut, whatever their length. With a ``table``
    its words are not segmented again; without one, or for other words, each task does so for itself.
    """

    @F.pandas_udf(RESULT)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(model_file, table)
        for batch in batches:
            rows = [(ids.decode(), n, text.decode()) for texts in slices(batch, SLICE) for ids, n, text in own.encode(texts)]
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "decoded"])

    return pieces(text)


def encode_digest(text: Column, model_file: str, table: WordTable | None = None) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; keeps ids and texts inside the Python worker."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(model_file, table)
        for batch in batches:
            rows = [
                (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                for texts in slices(batch, SLICE)
                for ids, n, decoded in own.encode(texts)
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)
