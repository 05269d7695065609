"""Drift check and promotion decision for a candidate run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import PROMOTION_METRIC, PSI_FAIL
from rankloom.operators.drift import drift_gate, drift_report
from rankloom.operators.runs import promotion_gate


def decide(
    baseline: DataFrame,
    current: DataFrame,
    candidates: DataFrame,
    production: DataFrame,
    threshold: float = PSI_FAIL,
    metric: str = PROMOTION_METRIC,
) -> DataFrame:
    """One row per candidate run: promoted only when features are stable and it is better."""
    gate = drift_gate(drift_report(baseline, current, threshold=threshold)).select("all_passed")
    decided = promotion_gate(candidates, production, metric)
    stable = F.coalesce(gate.scalar(), F.lit(True))
    return (
        decided.withColumn("drift_passed", stable)
        .withColumn("reason", F.when(F.col("drift_passed"), F.col("reason")).otherwise("feature drift"))
        .withColumn("promoted", F.col("promoted") & F.col("drift_passed"))
    )
