from __future__ import annotations

import collections
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from rankloom.llm import pitman_yor as model
from tests.llm.brute import FOLD, space_words

SCHEMA = "doc_id long, text string"


def tokens(text):
    return [*space_words((text or "").translate(FOLD)), None]


def brute_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by definition."""
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count = collections.Counter(t for (_, text), h in zip(rows, out, strict=True) if not h for t in tokens(text))
    total = sum(count.values())
    return [
        (i, h, len(tokens(t)), sum(w in count for w in tokens(t)), total, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in tokens(t)))
        for (i, t), h in zip(rows, out, strict=True)
    ]


def corpus(n, seed=0):
    """Texts in which half of the words determine the next one."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        word, text = 0, []
        for _ in range(rng.integers(0, 60)):
            word = (word * 7 + 3) % 50 if rng.random() < 0.5 else int(50 * rng.random() ** 2)
            text.append(("w", "W")[rng.integers(2)] + str(word))
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("batch_bytes", [1 << 20, 4_000])
def test_counts_base_and_gain(spark, batch_bytes):
    rows = corpus(300)
    got = sorted(map(tuple, model.score(spark.createDataFrame(rows, SCHEMA), batch_bytes=batch_bytes).collect()))
    want = brute_base(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    held = [g for g in got if g[1]]
    # Known successors are worth over a tenth of a digit per token on texts never learned from.
    assert sum(g[6] - g[5] for g in held) > 0.1 * sum(g[2] for g in held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\x0b\n"), (None, "a b a"), (None, None), (4, "é É  x"), (5, "a " * 30_000), *[(6, "same text")] * 40, (7, "unknown")]
    given = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("batch", "held_out", "trains", "score")})
    got = model.score(given, batch_bytes=3_000).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(brute_base(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)


def test_nothing_to_learn_and_empty_table(spark):
    assert model.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    got = sorted(map(tuple, model.score(held, held=F.lit(True)).collect()))
    assert got == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]


def grouped(tables, column):
    whole = pa.concat_tables(tables)
    for value in sorted(set(whole[column].to_pylist())):
        yield value, whole.filter(pc.equal(whole[column], value))


def answered(texts, trains, batches, crowded):
    """All moves in one process: (answers, batches of texts)."""
    parts = [pa.table({"text": pa.array(texts[b::batches], pa.binary()), "trains": pa.array(trains[b::batches], pa.int32())}) for b in range(batches)]
    key = lambda v: (pa.scalar(v),)
    questions = [model._ask(crowded)(key(b), t) for b, t in enumerate(parts)]
    tables = [model._seat(crowded)(key(s), t) for s, t in grouped(questions, "shard")]
    parents = pa.concat_tables(model.merge_parents(key(d), t) for d, t in grouped(tables, "dest"))
    totals = np.sum([s for s in parents["stats"].to_pylist() if s], axis=0).tolist()
    parents = parents.filter(pc.greater_equal(parents["shard"], 0))
    parents = parents.set_column(4, "stats", pa.array([totals] * len(parents), pa.list_(pa.float64())))
    by_shard = dict(grouped([parents], "shard"))
    return [model._answer(crowded)(key(s), t, by_shard[s]) for s, t in grouped(questions, "shard")], parts


@pytest.mark.parametrize("shards,hot", [(1, False), (5, False), (5, True)])
def test_probabilities_sum_to_one(shards, hot):
    """Over all known words, the end and one unknown word, after any word."""
    rows = [t.lower() for _, t in corpus(120, 4)]
    words = sorted({w for t in rows for w in t.split()})
    after = "w3"
    probe = " ".join(x for w in [*words, "never"] for x in (after, w)) + f" {after}"
    ids = model.WordIds()
    context = int(ids[after.encode()])
    crowded = model.Crowded({context: 3} if hot else {}, shards)
    answers, parts = answered([t.encode() for t in [*rows, probe]], [1] * len(rows) + [0], 3, crowded)
    total = 0.0
    batch = next(b for b, t in enumerate(parts) if probe.encode() in t["text"].to_pylist())
    own = model.Batch(parts[batch]["text"].to_pylist(), crowded)
    mine = dict(grouped(answers, "batch"))[batch].sort_by("shard")
    scores = np.empty(len(own.pairs))
    scores[own.dealt] = model.from_fixed_point(b"".join(mine["scores"].to_pylist()))
    # The batch has one unknown word, so its pairs after the context are all there are.
    chosen = own.pairs.names[own.pairs.first] == context
    assert chosen.sum() == len(words) + 2
    total = (10.0 ** scores[chosen]).sum()
    assert abs(total - 1) < 1e-4


def test_gibbs_steps_keep_their_distribution():
    """Tables of four customers against all partitions, weighted by definition."""
    d, weight, n = 0.6, 0.9, 40_000
    rng = np.random.default_rng(1)
    seats = np.zeros((n, 30), np.int64)
    seats[:, 0] = 4
    for _ in range(25):
        tables = model.reseated(np.full(n, 4), np.full(n, weight), seats, d, rng)
    assert (seats.sum(axis=1) == 4).all() and (seats >= 0).all()
    exact = collections.Counter()
    for labels in itertools.product(range(4), repeat=4):
        sizes = list(collections.Counter(labels).values())
        if list(dict.fromkeys(labels)) == list(range(len(sizes))):
            exact[len(sizes)] += weight ** len(sizes) * math.prod(math.gamma(s - d) / math.gamma(1 - d) for s in sizes)
    total = sum(exact.values())
    for t in range(1, 5):
        assert abs((tables == t).mean() - exact[t] / total) < 0.015


def test_pairs_in_exact_order():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 5, 4_000).astype(np.uint64)
    # Words that differ in their lowest bits only.
    w = (rng.integers(0, 3, 4_000) + (1 << 55) * rng.integers(0, 2, 4_000)).astype(np.uint64)
    pairs = model.Pairs(v, w)
    want = sorted(set(zip(v.tolist(), w.tolist(), strict=True)))
    assert list(zip(pairs.names[pairs.first].tolist(), pairs.second.tolist(), strict=True)) == want
    assert [want[i] for i in pairs.of] == list(zip(v.tolist(), w.tolist(), strict=True))
    assert pairs.sums(np.ones(4_000, np.int64)).sum() == 4_000
    assert (model.unpacked(model.packed(w)) == w).all()


def _exact_tables(customers, weight, d):
    """Chances of 1, 2, ... tables: generalized Stirling numbers times powers of the weight."""
    row = [1.0]
    for n in range(1, customers):
        row = [((row[t] * (n - d * (t + 1)) if t < n else 0) + (row[t - 1] if t else 0)) / n for t in range(n + 1)]
    chances = np.log(row) + np.log(weight) * np.arange(1, len(row) + 1)
    chances = np.exp(chances - chances.max())
    return chances / chances.sum()


@pytest.mark.parametrize("enumerated", [256, 3])
@pytest.mark.parametrize(("customers", "weight", "d"), [(4, 0.3, 0.75), (40, 0.6, 0.75), (40, 3.0, 0.5), (200, 6.0, 0.75), (200, 40.0, 0.75)])
def test_sweeps_keep_exact_chances(monkeypatch, customers, weight, d, enumerated):
    """Both with enumerated chances and with seatings offered."""
    monkeypatch.setattr(model, "ENUMERATED", enumerated)
    model.log_stirling.cache_clear()
    n, rng = 30_000, np.random.default_rng(8)
    sittings = model.Sittings(np.full(n, customers), d)
    for _ in range(20):
        tables = sittings.sweep(np.full(n, weight), rng)
    found = np.bincount(tables, minlength=customers + 1)[1:] / n
    model.log_stirling.cache_clear()
    assert np.abs(found - _exact_tables(customers, weight, d)).max() < 0.02


def test_every_customer_of_a_large_dish_is_seated_again():
    """A few sweeps give frequent pairs their many tables; single steps left them at four at most."""
    tables = model.Sittings(np.full(200, 1_000_000), 0.75)
    weight, rng = np.full(200, 30.0), np.random.default_rng(5)
    for _ in range(model.STEPS):
        found = tables.sweep(weight, rng)
    assert 35 < found.mean() < 45


@pytest.mark.parametrize("weight", [100.0, 800.0, 4_000.0])
def test_large_dishes_leave_their_first_table(weight):
    """Whatever the weight of a table, a sweep moves a fair part of the large dishes."""
    dishes, rng = model.Sittings(np.full(100, 10_000), 0.75), np.random.default_rng(6)
    assert (dishes.sweep(np.full(100, weight), rng) > 1).mean() > 0.3
