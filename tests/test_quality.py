from __future__ import annotations

import pytest

from rankloom.operators import quality
from tests.conftest import RATINGS

DAY_2000, DAY_1990 = 946_684_800, 631_152_000


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(
        [
            (1, 1, 4.0, DAY_2000),
            (1, 1, 3.0, DAY_2000),
            (None, 2, 5.0, DAY_2000),
            (2, None, 0.0, DAY_2000),
            (2, 99, 5.5, DAY_1990),
            (3, 99, 2.5, None),
        ],
        RATINGS,
    )


def test_summary(dirty):
    row = quality.summary(dirty).first().asDict()
    assert row == {
        "total_ratings": 6,
        "ratings_null_count": 2,
        "ratings_out_of_range": 2,
        "min_rating": 0.0,
        "max_rating": 5.5,
        "total_users": 3,
        "total_movies": 3,
    }
    with pytest.raises(ValueError, match="without a user, item or rating"):
        quality.enforce(row)


def test_enforce(random_ratings):
    row = quality.summary(random_ratings).first().asDict()
    quality.enforce(row, min_rows=720)
    with pytest.raises(ValueError, match="at least 721"):
        quality.enforce(row, min_rows=721)


def test_duplicates(dirty):
    assert [tuple(r) for r in quality.duplicates(dirty).collect()] == [(1, 1, DAY_2000, 2)]


def test_orphans(spark, dirty):
    items = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "movieId int, title string, genres string")
    assert [tuple(r) for r in quality.orphans(dirty, items).collect()] == [(99, 2)]
    assert tuple(quality.orphan_summary(dirty, items).first()) == (1, 2)


def test_years(dirty):
    assert quality.outside_years(dirty).count() == 2
    assert {tuple(r) for r in quality.year_histogram(dirty).collect()} == {
        (2000, 4, True),
        (1990, 1, False),
        (None, 1, None),
    }


def test_empty_input(spark):
    row = quality.summary(spark.createDataFrame([], RATINGS)).first()
    assert (row["total_ratings"], row["total_users"], row["min_rating"]) == (0, 0, None)


def test_missing_rating_and_item_floor(spark):
    ratings = spark.createDataFrame([(1, 1, None, DAY_2000)], RATINGS)
    with pytest.raises(ValueError, match="without a user, item or rating"):
        quality.enforce(quality.summary(ratings).first().asDict())
    items = spark.createDataFrame([(1, "a", "x")], "movieId int, title string, genres string")
    assert quality.enforce_items(items) == 1
    with pytest.raises(ValueError, match="at least 2"):
        quality.enforce_items(items, min_rows=2)
