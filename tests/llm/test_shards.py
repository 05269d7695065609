from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.llm import sharding
from rankloom.llm.oracles import sharding_sql

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("limit", [20_000, 300_000, 10**9])
def test_against_sql(spark, limit):
    got = sharding.assign(spark.read.parquet(f"{FOLDER}/documents.parquet"), limit).toPandas()
    con = duckdb.connect()
    con.sql(f"create view documents as from '{FOLDER}/documents.parquet'")
    want = con.sql(sharding_sql(limit)).df()
    columns = ["doc_id", "n_bytes", "shard", "depth"]
    assert got[columns].sort_values("doc_id").values.tolist() == want[columns].sort_values("doc_id").values.tolist()
    sizes = got.groupby("shard")["n_bytes"].agg(["sum", "count"])
    assert ((sizes["sum"] <= limit) | (sizes["count"] == 1)).all()
    # A shard exists only because its parent was too large.
    for shard in sizes.index:
        if shard:
            assert got.loc[got["shard"].str.startswith(shard[:-1]), "n_bytes"].sum() > limit


def test_hot_id_equal_rows_and_odd_rows(spark):
    many = [(7, f"text {i:04d}") for i in range(300)] + [(8, "same text")] * 300 + [(None, None), (9, ""), (10, "x" * 5_000)]
    docs = spark.createDataFrame(many, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.assign(docs, 900).toPandas()
    assert len(got) == len(many)
    sizes = got.groupby("shard")["n_bytes"].agg(["sum", "count"])
    assert ((sizes["sum"] <= 900) | (sizes["count"] == 1)).all()
    assert sorted(got["n_bytes"]) == sorted(len(t or "") for _, t in many)
    assert sharding.assign(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out", 300_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count()
    assert back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).where("n > 300000").count() == 0


def test_written_shards_keep_every_row_and_column(spark, tmp_path):
    rows = [(None, "no id", "x"), (3, "twin", "y"), (3, "twin", "y"), (3, "other", None), (4, None, "z"), *[(9, "same " * 40, "w")] * 30]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    name = sharding.write_shards(docs, f"{tmp_path}/out", 900)
    assert name == "_shard"
    back = spark.read.schema(f"doc_id long, text string, shard string, {name} string").parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.drop(name).collect())) == sorted(map(str, docs.collect()))
    sizes = back.groupBy(name).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).collect()
    assert all(s["bytes"] is None or s["bytes"] <= 900 or s["n"] == 1 for s in sizes) and len(sizes) > 5
    assert sharding.write_shards(docs.limit(0), f"{tmp_path}/none") == "_shard"
