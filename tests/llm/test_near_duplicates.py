from __future__ import annotations

import random

import numpy as np
import pytest

from rankloom.llm import simhash
from tests.llm import brute


def crowd(rng, n):
    centres, out = [rng.getrandbits(64) for _ in range(5)], set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 8)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_trie_join_against_all_pairs():
    rng = random.Random(5)
    for _ in range(20):
        prints = crowd(rng, 150)
        assert simhash.trie_join(np.array(prints, np.uint64), 0, 4).tolist() == brute.smallest_linked(prints)


@pytest.mark.parametrize("rows", [8, 4_096])
def test_links_and_components_with_crowded_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "TRIE_ROWS", rows)
    prints = crowd(random.Random(6), 200)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(3 * i + 1, p) for i, p in enumerate(signed)], "node long, fp long")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(df)).collect()}
    want = {3 * i + 1: 3 * c + 1 for i, c in enumerate(brute.smallest_linked(prints))}
    assert {n: got.get(n, n) for n in want} == want


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_documents_against_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghijklm") + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    texts = base + [t.upper() for t in base[:10]] + [f"{t} z9" for t in base] + [None, "", " \t", "É x\x85y", "a " * 60_000, base[3]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    schema = "doc_id long, text string, fp string, fingerprint int, node int"
    docs = spark.createDataFrame([(i, t, "clash", 0, 0) for i, t in zip(ids, texts, strict=True)], schema)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    rows = sorted(zip(ids, map(brute.fingerprint, texts), strict=True))
    first = brute.smallest_linked([p for _, p in rows])
    assert got == [(i, f"{p:016x}", rows[c][0]) for (i, p), c in zip(rows, first, strict=True)]


def test_rows_without_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "A b c"), (4, "A b c"), (None, "other text")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
