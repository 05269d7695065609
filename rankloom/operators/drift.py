"""Population stability between a baseline and current feature values.

Both inputs are long tables (feature, value). Everything works on counts per
distinct value, so a feature with many rows but few values is small after the
map-side combine, and quantiles come from prefix sums instead of one sorted group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import MONITORED_FEATURES, NEXT_STEPS, PSI_BINS, PSI_FAIL, PSI_WARN
from rankloom.operators.ordering import CELL_ROWS, prefix_sums, range_cells
from rankloom.sources.staging import stage_all


def value_counts(values: DataFrame) -> DataFrame:
    """(feature, value, n): the state of a side. States of parts (days, files) of a table add
    up by :func:`merged` to the state of the whole; every report reads states alone."""
    return values.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several."""
    return reduce(DataFrame.unionByName, states).groupBy("feature", "value").agg(F.sum("n").alias("n"))


def _state(side: DataFrame) -> DataFrame:
    return side if "n" in side.columns else value_counts(side)


def quantile_edges(counts: DataFrame, bins: int = PSI_BINS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(feature, edges): the distinct values of the ``bins + 1`` even quantiles, ascending.

    Quantiles interpolate linearly between order statistics. Rank q (n - 1) / bins is
    taken apart in integers, so no rounding decides which two values it lies between.
    """
    cut = range_cells(counts, ["feature", "value"], cell_rows)
    # One row per monitored feature.
    totals = F.broadcast(counts.groupBy("feature").agg(F.sum("n").alias("_total")))
    ordered = prefix_sums(cut, "value", ["n"], F.col("_cell"), ["feature"]).join(totals, "feature")

    def at(rank):
        inside = (rank >= F.col("n_before")) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(inside, F.col("value")))

    last = F.col("_total") - 1
    picks, edges = [], []
    for q in range(bins + 1):
        low = F.floor(last * q / F.lit(bins)) if q < bins else last
        picks += [
            at(low).alias(f"_lo{q}"),
            at(F.least(low + 1, last)).alias(f"_hi{q}"),
            F.max((last * q - low * bins) / F.lit(float(bins))).alias(f"_w{q}"),
        ]
        lo, hi, weight = (F.col(f"_{p}{q}") for p in ("lo", "hi", "w"))
        edges.append(lo + (hi - lo) * weight)
    stats = ordered.groupBy("feature").agg(*picks)
    return stats.select("feature", F.array_sort(F.array_distinct(F.array(*edges))).alias("edges"))


def psi(expected: DataFrame, actual: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """(feature, psi) for the features both sides have. A side is a table (feature, value) or
    the state of one.

    Bins are closed on the left, the last one on both sides. Values outside the
    baseline's range count in the totals but in no bin. Shares are smoothed by one
    per bin. A baseline with fewer than two distinct edges has PSI 0.
    """
    before, now = expected, actual
    if not {"n"} <= set(before.columns) & set(now.columns):
        before, now = stage_all(before=_state(before), now=_state(now))
    edges = F.broadcast(quantile_edges(before, bins))
    both = before.select("feature", "value", F.col("n").alias("_e"), F.lit(0).cast("bigint").alias("_a")).unionByName(
        now.select("feature", "value", F.lit(0).cast("bigint").alias("_e"), F.col("n").alias("_a"))
    )
    reached = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    closed = F.col("value") <= F.element_at("edges", -1)
    n_bins = F.size("edges") - 1
    binned = (
        both.join(edges, "feature")
        .withColumn("_bin", F.when(closed, F.least(reached, n_bins)).otherwise(0))
        .groupBy("feature", "_bin")
        .agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    )
    # From here on at most bins + 1 rows per feature.
    totals = binned.groupBy("feature").agg(F.sum("_e").alias("_ne"), F.sum("_a").alias("_na"))
    frame = edges.select(
        "feature", n_bins.alias("_k"), F.explode(F.sequence(F.lit(1), F.greatest(n_bins, F.lit(1)))).alias("_bin")
    )
    filled = (
        frame.join(totals.where("_ne > 0 AND _na > 0"), "feature")
        .join(binned, ["feature", "_bin"], "left")
        .fillna(0, ["_e", "_a"])
    )
    share_e = (F.col("_e") + 1) / (F.col("_ne") + F.col("_k"))
    share_a = (F.col("_a") + 1) / (F.col("_na") + F.col("_k"))
    term = F.when(F.col("_k") < 1, 0.0).otherwise((share_a - share_e) * F.ln(share_a / share_e))
    return filled.groupBy("feature").agg(F.sum(term).alias("psi"))


def moments(counts: DataFrame, prefix: str) -> DataFrame:
    """Mean and population deviation per feature of a state; squares are taken about the mean."""
    mean = counts.groupBy("feature").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias(f"{prefix}_mean"))
    away = F.col("value") - F.col(f"{prefix}_mean")
    # One row per monitored feature.
    around = counts.join(F.broadcast(mean), "feature").groupBy("feature")
    deviation = F.sqrt(F.sum(F.col("n") * away * away) / F.sum("n"))
    return around.agg(F.first(f"{prefix}_mean").alias(f"{prefix}_mean"), deviation.alias(f"{prefix}_std"))


def drift_report(
    baseline: DataFrame,
    current: DataFrame,
    features: Sequence[str] = MONITORED_FEATURES,
    threshold: float = PSI_FAIL,
    bins: int = PSI_BINS,
) -> DataFrame:
    """The report of two tables (feature, value), each read once."""
    names = list(features)
    watched = [value_counts(df.where(F.col("feature").isin(names))) for df in (baseline, current)]
    return report_of_states(*stage_all(before=watched[0], now=watched[1]), features, threshold, bins)


def report_of_states(
    before: DataFrame,
    now: DataFrame,
    features: Sequence[str] = MONITORED_FEATURES,
    threshold: float = PSI_FAIL,
    bins: int = PSI_BINS,
) -> DataFrame:
    """One row per monitored feature; a feature missing on a side is skipped and passes."""
    names = list(features)
    watched = before.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    before, now = (df.where(F.col("feature").isin(names)) for df in (before, now))
    joined = (
        watched.join(moments(before, "expected"), "feature", "left")
        .join(moments(now, "actual"), "feature", "left")
        .join(psi(before, now, bins), "feature", "left")
    )
    missing = F.col("psi").isNull()
    status = (
        F.when(missing, "SKIP")
        .when(F.col("psi") < PSI_WARN, "PASS")
        .when(F.col("psi") < PSI_FAIL, "WARNING")
        .otherwise("FAIL")
    )
    message = F.when(F.col("expected_mean").isNull(), "no baseline values").when(
        F.col("actual_mean").isNull(), "no current values"
    )

    def shown(name: str):
        return F.when(~missing, F.round(name, 4)).alias(name)

    return joined.select(
        "feature",
        F.round("psi", 4).alias("psi"),
        status.alias("status"),
        (missing | (F.col("psi") < threshold)).alias("passed"),
        *[shown(f"{side}_{stat}") for stat in ("mean", "std") for side in ("expected", "actual")],
        message.alias("message"),
    )


def drift_gate(report: DataFrame) -> DataFrame:
    """One row: did every feature pass, and which branch follows. No rows at all pass."""
    passed = F.coalesce(F.bool_and("passed"), F.lit(True))
    return report.agg(
        passed.alias("all_passed"),
        F.count_if("passed").alias("n_passed"),
        F.count("*").alias("n_features"),
    ).withColumn("next_step", F.when(F.col("all_passed"), NEXT_STEPS[0]).otherwise(NEXT_STEPS[1]))
