from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import language_id
from rankloom.llm.language_id import STRETCH, Languages
from rankloom.llm.queries import QUERIES


def parsed(symbols: bytes, corpus: bytes) -> int:
    """Greedy longest matches, ended at stretches."""
    n = 0
    for a in range(0, len(symbols), STRETCH):
        part, i = symbols[a : a + STRETCH], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i : i + k + 1] in corpus:
                k += 1
            n, i = n + 1, i + k
    return n


def test_phrases_against_plain_search(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect()
    own = Languages(tuple(sorted((r["lang"], r["text"][:400]) for r in rows[:60])))
    by = {}
    for lang, text in sorted((r["lang"], r["text"][:400]) for r in rows[:60]):
        by[lang] = f"{by.get(lang, '')} {text}"
    texts = [own.symbols(r["text"][:1_500]) for r in rows[60:80]] + [own.symbols("你好 ab"), own.symbols("")]
    want = [[parsed(bytes(t), bytes(own.symbols(by[lang]))) for lang in own.names] for t in texts]
    assert own.phrases(texts).tolist() == want


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op10_language_id"](spark, folder).join(docs, "doc_id").where("held_out")
    row = found.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert row["n"] > 2_000 and row["right"] > 0.99
    assert found.where("score < 0 or score > 1").count() == 0


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat " * 5, "en") for i in range(20)] + [(100 + i, "der hund lief durch den wald " * 5, "de") for i in range(20)]
    rows += [(200, None, None), (201, "", "en"), (202, "12 34 !?", "en"), (None, "the cat", None), (203, "the cat sat " * 20_000, None), (203, "the cat", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"guess": F.lit(1), "score": F.lit("clash")})
    got = {}
    for r in language_id.identify(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert all(got[i] == [("und", 0.0)] for i in (200, 201, 202))
    assert got[3][0][0] == "en" and got[103][0][0] == "de" and got[None][0][0] in ("en", "xx")
    assert {p for p, _ in got[203]} <= {"en", "xx"}
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_ties_go_to_the_first_name():
    own = Languages((("b", "abc abc"), ("a", "abc abc")))
    assert own.guess(["abc"])[0].lang == "a"
    assert np.isclose(own.guess(["abc"])[0].score, 0.0)


def made_up(rng, letters, n_words):
    """A language: texts of random words out of a vocabulary of its own."""
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(120)]
    return lambda: " ".join(rng.choice(vocabulary) for _ in range(n_words))


def test_as_much_is_learned_of_each_of_seventy_languages(spark):
    rng = random.Random(5)
    spoken = {f"l{i:02}": made_up(rng, "abcdefghijklmnopqrstuvwxyz", 60) for i in range(70)}
    docs = spark.createDataFrame([(i, speak(), lang) for i, (lang, speak) in enumerate([*spoken.items()] * 12)], "doc_id long, text string, lang string")
    found = language_id.identify(docs, sample_texts=8, sample_chars=200).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100 and all(r["lang"] == r["lang_pred"] for r in found)
    texts = language_id.training_texts(docs, sample_texts=8, sample_chars=200)
    few = Languages(tuple(t for t in texts if t[0] < "l03"))
    many = Languages(tuple(texts))
    assert many.bits[:3].tolist() == few.bits.tolist() and len(many.names) == 70
    same = [spoken["l00"](), spoken["l02"]()]
    one, all_ = few.phrases([few.symbols(t) for t in same]), many.phrases([many.symbols(t) for t in same])
    assert one.tolist() == all_[:, :3].tolist()


@pytest.mark.parametrize("first", [0x4E00, 0xAC00])
def test_languages_of_one_large_script(first):
    """Three languages that share 2,000 letters."""
    rng = random.Random(first)
    letters = [chr(first + i) for i in range(2_000)]
    spoken = {name: made_up(rng, letters, 40) for name in ("a", "b", "c")}
    own = Languages(tuple((name, speak()) for name, speak in spoken.items() for _ in range(20)))
    assert own.width > 500
    for name, speak in spoken.items():
        assert {g.lang for g in own.guess([speak() for _ in range(10)])} == {name}


def test_guesses_against_plain_search():
    rng = random.Random(8)
    spoken = {name: made_up(rng, "abcdefghi", 50) for name in "pqrs"}
    sample = {name: " ".join(speak() for _ in range(6)) for name, speak in spoken.items()}
    own = Languages(tuple(sample.items()))
    texts = [rng.choice([*spoken.values()])() + " " + rng.choice([*spoken.values()])() for _ in range(60)]
    for text, guess in zip(texts, own.guess(texts), strict=True):
        symbols = bytes(own.symbols(text))
        bits = {n: parsed(symbols, bytes(own.symbols(sample[n]))) * np.log2(len(own.symbols(sample[n])) + 1) for n in "pqrs"}
        best = min("pqrs", key=bits.get)
        assert guess.lang == best
        assert guess.score == pytest.approx(1 - bits[best] / min(v for n, v in bits.items() if n != best))
