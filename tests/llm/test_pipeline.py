from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, contaminated, empty and foreign texts, no personal data."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(8)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)] for lang, letters in (("en", "etaoinshr"), ("de", "enisratdhuäö"))}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    items = [(i, prose("en", 30)) for i in range(5)]
    rows = [(i, prose(("en", "de")[i % 2], rng.randint(40, 200)), ("en", "de")[i % 2]) for i in range(150)]
    rows += [(150 + i, rows[i][1], "en") for i in range(20)]
    rows += [(170 + i, rows[i][1] + f" extra{i}", "en") for i in range(20)]
    rows += [(190 + i, f"{prose('en', 20)} {items[i % 5][1]} {prose('en', 20)}", "en") for i in range(10)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "1234 !!", "en"), (203, "你好世界" * 20, None), (204, rows[0][1], None), (204, rows[0][1], None)]
    docs = spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_against_brute_force(spark, folder):
    path, rows, items = folder
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and r[0] != 203]
    left = sorted({(i, t) for i, t, _ in left})
    first = brute.smallest_linked([brute.fingerprint(t) for _, t in left])
    left = [r for k, r in enumerate(left) if first[k] == k]
    left = [r for r, c in zip(left, brute.contamination([t for _, t in left], items), strict=True) if not c[3]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in left:
        ids = library.encode(t, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert sum(r["disagreements"] for r in got) == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_take_odd_tables(spark, folder, name, stage):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    extra = docs.withColumns({n: F.lit("clash") for n in ("guess", "hits", "fingerprint", "component_id", "fp", "done", "node")})
    assert stage(spark, extra, path).columns == extra.columns
    assert stage(spark, docs.limit(0), path).count() == 0
    nulls = docs.select(*(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in NAMES)).limit(3)
    assert stage(spark, nulls.unionAll(docs.limit(5)), path).columns == NAMES
    assert stage(spark, nulls, path).count() <= 3


def test_rows_without_ids_in_near_duplicates(spark, folder):
    path, _, _ = folder
    rows = [(None, "a b c d e", "en", "s", 9), (None, "a b c d e", "en", "s", 9), (4, "x y z", "en", "s", 5), (None, "X y z", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, path).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("4", "x y z"), ("None", "a b c d e")]


def test_repeated_and_missing_ids_in_near_duplicates(spark, folder):
    path, rows, _ = folder
    x, near, a, b = rows[0][1], f"{rows[0][1]} extra0", rows[2][1], rows[4][1]
    far = [brute.fingerprint(t) for t in (x, near, a, b)]
    assert brute.smallest_linked(far) == [0, 0, 2, 3]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given, want in (
        ([(3, x), (5, near), (5, b)], [(3, x), (5, b)]),
        ([(5, a), (5, near), (7, x)], [(5, a), (5, near)]),
        ([(None, x), (None, near), (None, a), (9, b)], [(None, min(x, near)), (None, a), (9, b)]),
        ([(None, x), (7, near), (8, near)], [(7, near)]),
        ([(7, near), (7, x)], [(7, min(x, near))]),
    ):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], schema)
        got = corpus_pipeline.drop_near_duplicates(spark, docs, path).collect()
        assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t) for i, t in want)


def test_personal_data_and_length(spark, folder):
    path, _, _ = folder
    docs = spark.createDataFrame([(1, "at 1.2.3.4 now", "en", "s", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    row = corpus_pipeline.pseudonymise(spark, docs, path).first()
    assert "1.2.3.4" not in row["text"] and row["n_chars"] == len(row["text"])
