from __future__ import annotations

import random
import re

from rankloom.llm import secret_scan
from rankloom.llm.secret_scan import RULES, Scanner, trigram_query

PARTS = ["password", "PassWD", "secret", "ſecret", "toKen", "api_key", "apikey", "API_", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGH123"]
PARTS += ["deadbeef" * 4, "é", "x", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890123456", "eyJhb.eyJab." + "c" * 20, "\n"]


def plain(text):
    return sorted(
        (m.start(), k, m.end()) for k, r in enumerate(RULES) for m in re.finditer(r.pattern, text, re.ASCII) if len(m[r.group]) >= r.least
    )


def test_scan_equals_plain_search():
    rng, own = random.Random(2), Scanner(RULES)
    for _ in range(300):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        assert own.scan([t.encode() for t in texts]) == [plain(t) for t in texts]


def test_queries_are_what_matches_must_hold():
    assert trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert trigram_query("[0-9a-f]+") is True
    assert trigram_query("ab|cde") is True  # one side is too short for a trigram
    assert trigram_query("abc|bcd") == ("or", (b"abc", b"bcd"))
    assert trigram_query("x(?:abc)?y+") is not None


def test_failing_match_is_used_up(spark):
    # The first match has a short value and ends inside what another start would need.
    docs = spark.createDataFrame([(1, "token=secret=abcdefghij"), (2, None), (None, ""), (3, "é AKIA" + "A" * 12)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.find_secrets(docs.withColumn("spans", docs["doc_id"])).collect()}
    assert got == {1: [("assign", 0, 23)], 2: [], None: [], 3: [("access", 2, 18)]}
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0


def test_long_text_and_shards(monkeypatch, spark):
    monkeypatch.setattr(secret_scan, "SHARD_BYTES", 50)
    texts = ["x " * 50_000 + "password: hunter2hunter2", *["AKIA" + "B" * 16] * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [len(r["spans"]) for r in secret_scan.find_secrets(docs).orderBy("doc_id").collect()]
    assert got == [1] * 21
