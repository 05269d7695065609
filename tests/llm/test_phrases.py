from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import phrases
from tests.llm import brute


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 60)) for _ in range(n))


@pytest.mark.parametrize("shard", [2_500, 8_000_000])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 2 * shard)
    rng = random.Random(4)
    shared = [words(rng, n) for n in (20, 21, 19, 35, 60)] + ["x " * 45, "a b " * 30]
    rows = [(None, words(rng, 30)), (5, None), (6, ""), (7, shared[3]), (7, shared[3]), (7, shared[4]), (None, shared[3]), (-3, shared[4])]
    for _ in range(90):
        start = rng.choice(["", words(rng, rng.randint(0, 40)) + " "])
        rows.append((rng.randint(-50, 300), f"{start}{rng.choice(shared)}{rng.choice(' \n\t')}{words(rng, rng.randint(0, 30))} {rng.choice([*shared, ''])}"))
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, shard string, kept int")
    got = {}
    for r in phrases.remove_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept"]))
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert {k: sorted(v) for k, v in got.items()} == brute.without_repeats(rows)


def test_nothing_to_do(spark):
    docs = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    assert phrases.remove_repeats(docs.limit(0)).count() == 0
    assert [r["kept"] for r in phrases.remove_repeats(docs).collect()] == ["few words"]


def test_shards_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = phrases.remove_repeats(docs)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2


def test_crowded_ids_are_dealt_out_in_the_order_of_texts(spark, monkeypatch):
    """A third of all rows without an id, many of them equal, and an id with as many rows."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", 3_000)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 6_000)
    monkeypatch.setattr(phrases, "RANGE_BYTES", 5)
    rng = random.Random(9)
    shared = [words(rng, n) for n in (20, 28, 45)]
    rows = []
    for i in range(240):
        name = (None, 11, i)[i % 3]
        own = f"{words(rng, rng.randint(0, 15))} {rng.choice(shared)} {words(rng, rng.randint(0, 15))} {rng.choice(shared)}"
        rows.append((name, shared[2] if i % 4 == 0 else own))
    rows += [(None, None), (None, ""), (11, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in phrases.remove_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept"]))
    assert {k: sorted(v) for k, v in got.items()} == brute.without_repeats(rows)


def test_no_shard_holds_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 2_000)
    docs = spark.createDataFrame([(None if i % 2 else i, b"same words " * 5) for i in range(600)], "doc_id long, text binary")
    sizes = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    dealt = phrases.in_shards(docs, sizes, 17)
    assert dealt.count() == 600
    # 18 rows of either half on average.
    assert dealt.where("doc_id IS NULL").groupBy("shard").count().agg(F.max("count")).first()[0] < 45
    assert dealt.where("doc_id IS NULL").select("rank").distinct().count() == 1
    assert dealt.where("doc_id IS NOT NULL AND rank <> 0").isEmpty()


def test_places_come_from_the_automaton_alone(monkeypatch):
    passage = " ".join(f"w{i}" for i in range(30)).encode()
    texts = [b"a b c " + passage, passage + b" d", b"nothing of it " * 9]
    table = pa.table({"doc_id": [1, 2, 3], "text": texts, "rank": [0, 0, 0], "shard": [0, 0, 0]})
    key = (pa.scalar(0),)
    named = phrases._name_anchors(1)(key, table)
    replies = phrases.recurring_anchors(named)
    found = phrases._locate_windows(1)(key, table, replies)
    assert len(np.frombuffer(b"".join(found["later"].to_pylist()), np.uint32)) >= 11
    monkeypatch.setattr(phrases, "occurrences", lambda symbols, places: np.zeros(0, np.int64))
    assert not any(found for found in phrases._locate_windows(1)(key, table, replies)["later"].to_pylist())


def test_the_automaton_finds_all_places_of_a_phrase():
    symbols = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 6, 7, 9], np.int32)
    assert phrases.occurrences(symbols, np.array([0, 0])).tolist() == [0, 9]


@pytest.mark.parametrize("shards", [1, 5_000])
def test_values_of_shards(shards):
    rng = np.random.default_rng(3)
    shard, values = rng.integers(0, shards, 3_000), rng.integers(0, 99, 3_000)
    got = {s: v.tolist() for s, v in phrases.by_shard(shard, values)}
    assert got == {int(s): values[shard == s].tolist() for s in np.unique(shard)}
    assert list(phrases.by_shard(shard[:0], values[:0])) == []
