"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.catalog import QUERIES
from rankloom.catalog import parameters as P
from rankloom.config import FeatureConfig
from rankloom.operators import models
from rankloom.operators.indexing import index_bounds
from rankloom.operators.sampling import eval_candidates, labelled_splits
from rankloom.plans import feature_plan
from rankloom.sources import binding
from rankloom.sources.staging import stage

HEADLINE = (
    "quality_summary",
    "cold_start_filter",
    "user_features",
    "item_features",
    "temporal_split",
    "enriched_interactions",
    "negative_samples",
    "labelled_splits",
    "training_batches",
    "eval_candidates",
    "mf_score",
    "binary_metrics",
    "ranking_report",
    "coverage_at_k",
    "drift_report",
    "promotion_gate",
    "run_leaderboard",
)


def staged_jobs(spark: SparkSession, folder: str, scratch: str) -> dict[str, Callable[[], object]]:
    """Jobs that start from staged interactions, so that they are timed alone, and the
    feature job with all its outputs written."""
    ratings, items = binding.ratings(spark, folder), binding.items(spark, folder)
    config = FeatureConfig(P.MIN_USER, P.MIN_ITEM, tie_columns=binding.TIE_COLUMNS)
    interactions = stage(feature_plan.build(ratings, items, config).interactions, "bench")
    bounds = index_bounds(interactions).first()
    n_users, n_items = bounds["n_users"], bounds["n_items"]
    labelled = stage(labelled_splits(interactions, n_items), "labelled")

    def write(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    train = labelled.where("split = 'train'")
    return {
        "sampling_alone": lambda: write(labelled_splits(interactions, n_items)),
        "candidates_alone": lambda: write(eval_candidates(interactions, n_items)),
        "mf_fit_alone": lambda: models.fit_mf(train, n_users, n_items, dim=64, max_iter=4),
        "feature_job_written": lambda: feature_plan.run(ratings, items, f"{scratch}/features", config),
    }


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="rankloom-bench-") as scratch:
        measure(scratch)


def measure(scratch: str) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first job pays for JVM start-up and class loading.
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_custkey").count().write.format("noop").mode(
        "overwrite"
    ).save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    for name, job in staged_jobs(spark, folder, scratch).items():
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
