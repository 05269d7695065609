from __future__ import annotations

import random

import numpy as np

from rankloom.llm import decontamination
from rankloom.llm.fm_index import FmIndex, suffix_order
from tests.llm import brute

LETTERS = ["a", "B", "c", "Éa", "x1"]


def words(rng, n):
    return rng.choice([" ", ". ", "\n"]).join(rng.choice(LETTERS) for _ in range(n))


def test_suffix_order_and_index_against_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        text = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 60))])
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        index = FmIndex(text)
        width = rng.randint(1, 4)
        patterns = np.array([[rng.randint(0, 4) for _ in range(width)] for _ in range(10)])
        for pattern, start, end in zip(patterns, *index.search(patterns), strict=True):
            want = [i for i in range(len(text) - width + 1) if text[i : i + width].tolist() == pattern.tolist()]
            assert sorted(index.locate(np.arange(start, end)).tolist()) == want


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 40)
    monkeypatch.setattr(decontamination, "LOCATED", 7)
    rng = random.Random(2)
    items = [(rng.choice([i, None, 0]), rng.choice([words(rng, rng.randint(1, 20)), None, "", "..."])) for i in range(12)]
    known = [t for _, t in items if t]
    texts = [rng.choice([words(rng, rng.randint(0, 60)), None, "", f"{words(rng, 5)} {rng.choice(known)} {words(rng, 4)}"]) for _ in range(80)]
    texts += [texts[0], "z " * 30_000 + known[0]]
    for block in (4_000_000, 30):  # one pass, and many
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
            {n: decontamination.F.lit("clash") for n in ("hits", "n_words", "items")}
        )
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        found = decontamination.find_contamination(docs, benchmark).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found] == brute.contamination(texts, items)
        for r in found:
            assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
            assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontamination.find_contamination(docs.limit(0), benchmark).count() == 0
    found = decontamination.find_contamination(docs, benchmark.limit(0)).orderBy("n_words").collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in found] == [(0, 0, False), (2, 0, False)]
