from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from rankloom.llm import filter_audit
from tests.llm.brute import space_words

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def failed(text: str, copied: bool) -> str:
    words = space_words(text)
    tests = {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": copied,
    }
    return "".join(k for k, v in tests.items() if v)


def brute(docs, labels):
    """All steps of all orders, document by document."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, t, lang in docs:
        copied = i is not None and first[t or ""] < i
        parts.setdefault(lang or "", []).append((failed(t or "", copied), i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        shapley, found = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                redundant = sum(f in r[0] for r in rows) - len(gone)
                alone = sum(r[0] == f for r in rows)
                found.append((f, part, "".join(order), step, len(left), len(gone), redundant, alone, sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*r[1:], shapley[r[0]]) for r in found]
    return sorted(out)


def odd_documents():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "ÄÖ Straße 東京 \x0b x", "A" * 40_000, "one | two"]
    for _ in range(60):
        words = [rng.choice(["a", "B", "cc", "Dd"]) + (str(rng.randrange(200)) if rng.random() < 0.9 else "") for _ in range(rng.choice([3, 99, 100, 150]))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words) + rng.choice(["", "#", " &"]))
    texts += rng.choices(texts, k=40)
    docs = [(rng.choice([None, *range(80)]), t, rng.choice([None, "", "en", "de"])) for t in texts]
    docs += [docs[10]] * 3
    labels = [(rng.choice([None, *range(90)]), rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1])) for _ in range(70)]
    return docs, labels


def test_against_brute_force(spark):
    docs, labels = odd_documents()
    given = spark.createDataFrame(docs, DOCS).withColumns({n: F.lit("clash") for n in ("part", "mask", "digest", "n", "first")})
    got = filter_audit.audit(given, spark.createDataFrame(labels, LABELS).withColumn("good", F.lit("clash"))).collect()
    assert sorted(map(tuple, got)) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], DOCS), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one) == 120


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "x", "en"), (2, "xy", "en"), (3, "xy", "en"), (4, "z", "en")], DOCS)
    labels = spark.createDataFrame([(2, 1, 0)], LABELS)
    got = filter_audit.audit(docs, labels, {"x": F.col("text").contains("x")}, "c").orderBy("filter_order", "step").collect()
    assert [(r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]) for r in got] == [
        ("cx", 1, 3, 1, 0, 0, 0, 1),
        ("cx", 2, 1, 2, 1, 2, 1, 5),
        ("xc", 1, 1, 3, 0, 2, 1, 5),
        ("xc", 2, 1, 0, 1, 0, 0, 1),
    ]


def test_swaps_visit_every_order():
    for n in range(6):
        order, met = list(range(n)), set()
        for swap in (None, *filter_audit.adjacent_swaps(n)):
            if swap is not None:
                order[swap], order[swap + 1] = order[swap + 1], order[swap]
            met.add(tuple(order))
        assert len(met) == math.factorial(n)


def test_diagram_stays_canonical():
    """After any swap the reachable nodes are those of a diagram built in that order."""
    rng = random.Random(5)
    weights = {m: (rng.randint(1, 3), 0, 0) for m in rng.sample(range(32), 14)}
    diagram = filter_audit.Diagram(weights, 5)

    def shape(d, node):
        return d.total[node] if d.var[node] is None else (d.var[node], shape(d, d.low[node]), shape(d, d.high[node]))

    def reachable(d):
        seen, todo = set(), [d.root]
        while todo:
            node = todo.pop()
            if node not in seen and d.var[node] is not None:
                seen.add(node)
                todo += [d.low[node], d.high[node]]
        return seen

    for swap in filter_audit.adjacent_swaps(5):
        diagram.swap(swap)
        place = {v: i for i, v in enumerate(diagram.order)}
        renamed = {sum(1 << place[v] for v in range(5) if m >> v & 1): w for m, w in weights.items()}
        fresh = filter_audit.Diagram(renamed, 5)
        fresh.var = [v if v is None else diagram.order[v] for v in fresh.var]
        assert shape(diagram, diagram.root) == shape(fresh, fresh.root)
        assert len(reachable(diagram)) == len(reachable(fresh))
