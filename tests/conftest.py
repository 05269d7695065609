from __future__ import annotations

import pathlib
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

RATINGS = "userId int, movieId int, rating float, timestamp bigint"
PAIRS = "user_idx int, item_idx int"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("rankloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def random_ratings(spark):
    """720 ratings: 36 users of very unequal size, 45 items, tied times and repeated rows."""
    rng = np.random.default_rng(910)
    users = (36 * rng.random(700) ** 2).astype(int) * 3 + 2
    rows = [
        (int(u), int(m) * 7 + 1, float(r) / 2, 1_200_000_000 + 43_200 * int(t))
        for u, m, r, t in zip(users, rng.integers(0, 45, 700), rng.integers(1, 11, 700), rng.integers(0, 2_000, 700), strict=True)
    ]
    return spark.createDataFrame(rows + rows[:20], RATINGS)


@pytest.fixture(scope="session")
def small_items(spark):
    words = ["Noir", "War|Western", "Musical", "Crime|Noir|War", "Western", None, ""]
    rows = [(7 * i + 1, f"Item no. {i}", words[i % 7]) for i in range(44)]
    return spark.createDataFrame(rows, "movieId int, title string, genres string")


def plan_text(df) -> str:
    """The physical plan before execution."""
    return df._jdf.queryExecution().executedPlan().toString()
