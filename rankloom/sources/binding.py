"""Ratings, items and run tables seen through a retail star schema.

Customers act as users, parts as items and order lines as ratings, so any data set
in that layout can be pushed through every operator without a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.time import epoch_seconds

TIE_COLUMNS = ("order_key", "line_no")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """One rating per order line: quantity in steps of five maps to 0.5 ... 5.0 stars.

    Columns are computed before the join, so that what moves is as narrow as a rating.
    """
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    given = lines.select(
        F.col("l_partkey").cast("int").alias("movieId"),
        (F.ceil(F.col("l_quantity") / 5) * 0.5).cast("float").alias("rating"),
        epoch_seconds(F.col("l_shipdate")).alias("timestamp"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
    )
    placed = orders.select(F.col("o_custkey").cast("int").alias("userId"), "o_orderkey")
    names = ("userId", "movieId", "rating", "timestamp", *TIE_COLUMNS)
    return given.join(placed, F.col("order_key") == F.col("o_orderkey")).select(*names)


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as items; the words of the name and the type serve as genres."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("movieId"),
        F.col("p_name").alias("title"),
        F.concat_ws("|", F.replace("p_name", F.lit(" "), F.lit("|")), "p_type").alias("genres"),
    )


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Training log: every event is one logged metric value of the run named by its user."""
    # Which event type stands for which metric.
    metric = (
        F.when(F.col("event_type") == "view", "NDCG@10")
        .when(F.col("event_type") == "click", "HR@10")
        .when(F.col("event_type") == "signup", "Coverage@10")
        .when(F.col("event_type") == "purchase", "epoch_val_loss")
        .otherwise("epoch_loss")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.when(F.col("user_id") % 2 == 0, "mf").otherwise("ncf").alias("model_type"),
        metric.alias("metric"),
        "value",
        F.col("event_id").alias("step"),
    )


def model_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Registry log: every event registers a version of its user's run in some stage."""
    stage = (
        F.when(F.col("event_type") == "purchase", "Production")
        .when(F.col("event_type") == "error", "Archived")
        .otherwise("None")
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("version"),
        F.col("user_id").cast("string").alias("run_id"),
        stage.alias("stage"),
    )
