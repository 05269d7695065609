from __future__ import annotations

import json
import pathlib
import threading

import pytest
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.operators import manifest
from rankloom.sources import readers, staging, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_ratings_are_typed(spark, tmp_path):
    path = write(tmp_path / "r.csv", "userId,movieId,rating,timestamp\n1,10,4.5,1000\n2,11,0.5,2000\n")
    df = readers.load_ratings(spark, path)
    assert df.dtypes == [("userId", "int"), ("movieId", "int"), ("rating", "float"), ("timestamp", "bigint")]
    assert [tuple(r) for r in df.orderBy("userId").collect()] == [(1, 10, 4.5, 1000), (2, 11, 0.5, 2000)]
    assert readers.csv_row_count(spark, path) == 2


def test_malformed_id_stops_the_job(spark, tmp_path):
    path = write(tmp_path / "r.csv", "userId,movieId,rating,timestamp\nx,10,4.5,1000\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.load_ratings(spark, path).collect()


def test_malformed_rows_can_be_kept_aside(spark, tmp_path):
    path = write(tmp_path / "r.csv", "userId,movieId,rating,timestamp\nx,10,4.5,1000\n1,2,3.0,4\n")
    df = readers.load_ratings(spark, path, keep_corrupt=True)
    bad = [r for r in df.collect() if r[readers.CORRUPT_COLUMN] is not None]
    assert [(r["userId"], r[readers.CORRUPT_COLUMN]) for r in bad] == [(None, "x,10,4.5,1000")]


def test_quoted_titles(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'movieId,title,genres\n1,"A ""B"", C (1995)",Drama|War\n')
    assert readers.load_items(spark, path).first()["title"] == 'A "B", C (1995)'


def test_tags_links_and_inferred(spark, tmp_path):
    tags = write(tmp_path / "t.csv", "userId,movieId,tag,timestamp\n1,2,fun,3\n")
    links = write(tmp_path / "l.csv", "movieId,imdbId,tmdbId\n1,0114709,862\n")
    assert readers.load_tags(spark, tags).first()["tag"] == "fun"
    assert readers.load_links(spark, links).first()["imdbId"] == "0114709"
    assert dict(readers.read_csv_inferred(spark, tags).dtypes)["userId"] == "int"


def test_write_counts_in_the_same_pass(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "a").otherwise("b"))
    counts = writers.write_table(df, path, partition_by=["split"], counts={"n_a": F.count_if(F.col("split") == "a")})
    assert counts == {"n_a": 7}
    assert spark.read.parquet(path).where("split = 'b'").count() == 3


def test_manifest_is_one_json_record(spark, tmp_path):
    path = tmp_path / "m"
    writers.write_manifest(spark, str(path), {"n": 3, "split_strategy": "temporal_per_user"})
    (part,) = path.glob("part-*.json")
    assert json.loads(part.read_text()) == {"n": 3, "split_strategy": "temporal_per_user"}


def test_interactions_need_their_columns(spark, tmp_path):
    path = str(tmp_path / "i")
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError, match="user_idx"):
        readers.load_interactions(spark, path)


def test_stage_goes_to_the_session_folder(spark):
    staged = staging.stage(spark.range(5), "probe")
    assert staged.count() == 5
    root = spark.conf.get("spark.checkpoint.dir")
    assert all(root in f for f in staged.inputFiles())


def test_scope_removes_its_tables(spark):
    kept = staging.stage(spark.range(3), "kept")
    with staging.scope(spark):
        a, b = staging.stage_all(a=spark.range(4), b=spark.range(5))
        assert (a.count(), b.count()) == (4, 5)
        files = [f.removeprefix("file://") for f in a.inputFiles() + b.inputFiles()]
        assert all(pathlib.Path(f).exists() for f in files)
    assert not any(pathlib.Path(f).exists() for f in files)
    assert kept.count() == 3


def test_scopes_of_jobs_side_by_side(spark):
    """A job that ends first must not delete what the other still reads."""
    ready, done = threading.Event(), threading.Event()

    def short():
        with staging.scope(spark):
            staging.stage(spark.range(2), "short")
            ready.wait(60)
        done.set()

    worker = threading.Thread(target=short)
    with staging.scope(spark):
        worker.start()
        own = staging.stage(spark.range(3), "own")
        ready.set()
        done.wait(60)
        assert own.count() == 3
    worker.join()


def test_broadcast_only_when_small(spark):
    staged = staging.stage(spark.range(50), "probe")
    heavy = staging.broadcast_if_small(staged, max_bytes=100)
    assert "strategy=broadcast" not in spark.range(10).join(heavy, "id")._jdf.queryExecution().analyzed().toString()
    joined = lambda limit: spark.range(10).join(staging.broadcast_if_small(staged, limit), "id")
    assert "strategy=broadcast" in joined(50)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in joined(49)._jdf.queryExecution().analyzed().toString()


def test_conform_casts_and_orders(spark):
    df = spark.createDataFrame([(1.0, 2, 3, "x")], "label float, item_idx int, user_idx int, extra string")
    assert schemas.conform(df, schemas.LABELLED).columns == ["user_idx", "item_idx", "label"]
    with pytest.raises(ValueError, match="label"):
        schemas.conform(df.drop("label"), schemas.LABELLED)


def test_file_manifest(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.range(0, 100, 1, 4).write.parquet(path)
    rows = manifest.file_manifest(spark.read.parquet(path)).collect()
    assert len(rows) == 4
    assert sum(r["n_rows"] for r in rows) == 100
    assert all(r["n_bytes"] > 0 for r in rows)
