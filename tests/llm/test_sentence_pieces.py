import hashlib
import random

import public_tokenizers
import sentencepiece
from cases import TEXTS, frame
from pyspark.sql import functions as F

from mailquill.llm import sentence_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n):
    draw = random.Random(5)
    letters = " ▁ab\n\téßž😀\x00́'.<s>0　​ﬁ"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_like_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = TEXTS + [(100 + n, text) for n, text in enumerate(odd_texts(3000))]
    found = frame(spark, texts).select("doc_id", "text", sentence_pieces.encode_decode(F.col("text"), MODEL).alias("p"))
    found = found.select("doc_id", "text", "p.*").collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(row["text"] or "")
        assert row["ids"] == ",".join(map(str, ids)), row["text"][:40]
        assert row["n_tokens"] == len(ids)
        assert row["decoded"] == library.decode(ids)


def test_digest(spark):
    for row in (
        frame(spark).select("text", sentence_pieces.encode_digest(F.col("text"), MODEL).alias("p")).select("text", "p.*").collect()
    ):
        if not row["text"]:
            assert row["n_tokens"] == 0 and row["ids_sha256"] == row["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
        elif row["text"] == "word":
            assert row["decoded_sha256"] == hashlib.sha256(b"word").hexdigest()


def test_table_that_is_emptied(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "TABLE_WORDS", 5)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = sentence_pieces.Encoder(MODEL, None)
    texts = odd_texts(300)
    for at in range(0, 300, 7):
        for text, row in zip(texts[at : at + 7], own.encode(texts[at : at + 7])):
            ids = library.encode(text)
            assert row == (",".join(map(str, ids)).encode(), len(ids), library.decode(ids).encode())


def test_every_word_of_all_texts_is_segmented_once(spark, monkeypatch):
    texts = TEXTS + [(100 + n, text) for n, text in enumerate(odd_texts(800))]
    docs = frame(spark, texts)
    table = sentence_pieces.word_table(docs, MODEL)
    words = set(sentence_pieces.split([text or "" for _, text in texts])[1])
    assert set(table.find(sorted(words))) == words
    assert table.find(["▁nowhere", "▁"]).keys() <= {"▁"}
    own = sentence_pieces.Encoder(MODEL, table)
    monkeypatch.setattr(own.pieces, "segment", None)  # all words come from the table
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text, row in zip([text or "" for _, text in texts], own.encode([text or "" for _, text in texts])):
        ids = library.encode(text)
        assert row == (",".join(map(str, ids)).encode(), len(ids), library.decode(ids).encode())


def test_words_of_one_hash_are_told_apart(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sentence_pieces.xxhash, "xxh64_intdigest", lambda word, seed: 7)
    words = [f"▁w{n}" for n in range(9)]
    own, folder = sentence_pieces.Pieces(MODEL), str(tmp_path)
    parts = [part.encode() for word, entry in zip(words, own.segment(words)) for part in (word, *entry)]
    sentence_pieces.store(f"{folder}/0.keys", sentence_pieces.np.full(9, 7), "<u8")
    sentence_pieces.store(f"{folder}/0.ends", sentence_pieces.np.cumsum([len(part) for part in parts]), "<u8")
    sentence_pieces.store(f"{folder}/0.blob", sentence_pieces.np.frombuffer(b"".join(parts), "u1"), "u1")
    found = sentence_pieces.WordTable(folder, 1).find([*words, "▁other"])
    assert found == dict(zip(words, own.segment(words)))


def test_query_like_the_library(spark, sf_dir):
    from mailquill.llm.queries import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_sentence_pieces"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]])
        assert tuple(row)[1:] == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(),
        )


def test_empty_table(spark):
    assert frame(spark, []).select(sentence_pieces.encode_digest(F.col("text"), MODEL)).collect() == []
    table = sentence_pieces.word_table(frame(spark, []), MODEL)
    assert table.find(["▁a"]) == {}
