from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankloom.llm import sentence_pieces, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = list("aAbB's'llveredt 19 .,!<|>\n\t\x1c\x1f\x85 　éÉßΣσςİıſKﬁ½Ⅷ٣你好🙂🏽é̈ ​▁\x00") + ["<|endoftext|>", "<|startoftext|>", "'re", "</s>", "<0x41>", "the  "]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(3_000)]
    out += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return [*out, "", "x" * 40_000, "word " * 20_000, "ab" * 300 + " " * 500, out[0]]


def test_word_counts_equal_the_library(texts):
    library, own = Tokenizer.from_file(WORDS), token_counts.WordBpe(WORDS)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.count(t) for t in texts] == want


def test_forgetful_memory_gives_the_same():
    double = token_counts.Remembered(lambda k: 2 * k, size=3)
    assert [double[i % 7] for i in range(40)] == [2 * (i % 7) for i in range(40)]
    assert len(double) <= 3 and len(double.older) <= 3


def test_piece_ids_equal_the_library(texts, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 500)
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentence_pieces.PieceModel(PIECES)
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        ids, wrong = own.encode(part)
        assert wrong == 0
        assert ids == [sentence_pieces.pack(i) for i in library.encode(part, add_eos=True)]


def test_one_by_one_and_side_by_side_merges_agree(texts):
    own = sentence_pieces.PieceModel(PIECES)
    short = [f"▁{w}" for t in texts[3_000:3_020] for w in t.split() if w.isalpha() and w.isascii()]
    assert own.merge_many(short) == [own.merge(s) for s in short]


def test_tables_with_odd_rows(spark):
    rows = [(1, "Hello world", 9, "x"), (None, None, 9, "x"), (2, "", 9, "x"), (1, "Hello world", 9, "x"), (3, "é " * 9_000, 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    counts = sorted((r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, WORDS).collect())
    assert counts == [(0, 0), (0, 0), (11, 2), (11, 2), (27_000, 9_000)]
    coded = sentence_pieces.encode_decode(docs, PIECES).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r, (_, text, *_) in zip(coded, rows, strict=True):
        assert list(r["ids"]) == library.encode(text or "", add_eos=True)
        assert r["decoded"] == (text or "") and r["disagreements"] == 0
    assert token_counts.count_tokens(docs.limit(0), WORDS).count() == 0
    assert sentence_pieces.encode_decode(docs.limit(0), PIECES).count() == 0
