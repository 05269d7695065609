"""Queries that write the given tables to the shared folder, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.catalog import parameters as P
from rankloom.catalog.queries import CONFIG, QUERIES, Query, _factor_tables, _kept, rounded
from rankloom.operators import indexing, models, runs
from rankloom.plans import feature_plan
from rankloom.sources import binding, quarantine, readers
from rankloom.sources.staging import stage, stage_root


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def fresh(spark: SparkSession) -> str:
    return f"{stage_root(spark)}/rankloom/stored-{uuid.uuid4().hex}"


def _as_csv(df: DataFrame) -> str:
    path = fresh(df.sparkSession)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@query
def csv_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """All ratings through a CSV file and the typed reader."""
    return readers.load_ratings(spark, _as_csv(binding.ratings(spark, folder).select(*schemas.RATINGS.names)))


@query
def csv_items(spark: SparkSession, folder: str) -> DataFrame:
    """All items through a CSV file; titles get quotes and commas on the way."""
    quoted = F.concat(F.lit('"'), "title", F.lit('", the one'))
    return readers.load_items(spark, _as_csv(binding.items(spark, folder).withColumn("title", quoted)))


@query
def csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Columns and guessed types of the ratings' CSV file, with the records it has."""
    path = _as_csv(binding.ratings(spark, folder).select(*schemas.RATINGS.names))
    rows = [(n, t, readers.csv_row_count(spark, path)) for n, t in readers.read_csv_inferred(spark, path).dtypes]
    return spark.createDataFrame(rows, "column string, type string, n_rows bigint")


def _damaged(ratings: DataFrame) -> DataFrame:
    """Lines of ratings; by line number some lack a field, some have an id that is none."""
    user = F.when(F.col("line_no") == 3, F.concat(F.lit("x"), "userId")).otherwise(F.col("userId").cast("string"))
    time = F.when(F.col("line_no") == 4, F.lit("late")).otherwise(F.col("timestamp").cast("string"))
    whole = F.concat_ws(",", user, F.col("movieId").cast("string"), F.col("rating").cast("string"), time)
    short = F.concat_ws(",", user, F.col("movieId").cast("string"))
    return ratings.select(F.when(F.col("line_no") == 2, short).otherwise(whole).alias("line"))


def _records(spark: SparkSession, ratings: DataFrame) -> quarantine.Records:
    path = fresh(spark)
    # About a third of the bytes; a file has the lines of one task.
    _damaged(ratings).write.option("compression", "gzip").text(path)
    return quarantine.read_records(spark, path, schemas.RATINGS, header=False)


@query
def quarantine_report(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, binding.ratings(spark, folder)).report()


@query
def quarantined_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, binding.ratings(spark, folder)).bad


def _written(spark: SparkSession, folder: str) -> str:
    path = fresh(spark)
    ratings, items = stage(binding.ratings(spark, folder), "bound"), binding.items(spark, folder)
    feature_plan.run(ratings, items, path, CONFIG, quarantined=_records(spark, ratings).bad, staged=True)
    return path


@query
def written_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The feature job's JSON manifest, read back; its record lies in one file."""
    path = f"{_written(spark, folder)}/feature_manifest"
    counts = ("train_count", "val_count", "test_count", "n_users", "n_items", "n_raw_ratings", "n_quarantined")
    record = spark.read.json(path).select(*counts, "split_strategy", F.col("_metadata.file_name").alias("file"))
    return record.groupBy(*counts, "split_strategy").agg(F.count_distinct("file").alias("n_files"))


@query
def written_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out interactions of the feature job, from their own folder."""
    test = readers.load_interactions(spark, f"{_written(spark, folder)}/interactions", "test")
    return rounded(test.select("user_idx", "item_idx", "timestamp", "split", "user_avg_rating", "item_rating_count"))


@query
def written_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline distributions that the feature job leaves for drift reports."""
    return rounded(spark.read.parquet(f"{_written(spark, folder)}/baseline_distributions"))


@query
def saved_model_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a factor model that was saved and loaded."""
    interactions, _, _ = indexing.remap_ids(stage(_kept(spark, folder), "kept"))
    path = fresh(spark)
    models.FactorModel(*_factor_tables(interactions), P.MF_INTERCEPT, P.MF_DIM).save(path)
    return rounded(models.FactorModel.load(spark, path).score(interactions.select("user_idx", "item_idx")))


@query
def stored_run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Last values of a run log that every step was written to twice, from driver-side numbers."""
    path, log = fresh(spark), binding.run_metrics(spark, folder)
    # One row per metric.
    values = {r["metric"]: r["n"] for r in log.groupBy("metric").agg(F.count("*").alias("n")).collect()}
    for step in (1, 2, 2):
        runs.write_step(runs.metric_rows(spark, "counts", "none", {k: v * step for k, v in values.items()}, step), path)
    return runs.training_curves(runs.read_log(spark, path))
