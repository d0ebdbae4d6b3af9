"""Run health: which collection runs are too poor to judge listings by."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import RunHealth


def run_counts(observations: DataFrame) -> DataFrame:
    """Per-run counts; everything combines before the shuffle."""
    status = F.col("observation_status")
    return observations.groupBy("dataset_id", "source_key", "run_id").agg(
        F.min("observed_at").alias("started_at"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~status.isin("source_error", "blocked", "unknown")).alias("valid"),
        F.count_if(status == "source_error").alias("errors"),
        F.count_if(status == "blocked").alias("blocked"),
    )


def assess(counts: DataFrame, rules: RunHealth = RunHealth()) -> DataFrame:
    """Rates, reasons and the degraded flag of each run.

    The valid ratio compares with the previous full-market run of the same source;
    targeted runs (coverage_mode) neither use nor serve as that comparison.  The
    window runs over one row per run, not over observations.
    """
    df = counts
    if "coverage_mode" not in df.columns:
        df = df.withColumn("coverage_mode", F.lit("full_market"))
    full = F.col("coverage_mode") == "full_market"
    by_source = Window.partitionBy("dataset_id", "source_key").orderBy("started_at", "run_id")
    earlier = by_source.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.when(full, F.last(F.when(full, F.col("valid")), ignorenulls=True).over(earlier))
    total = F.nullif(F.greatest(F.col("total"), F.lit(0)), F.lit(0))
    df = df.withColumns({
        "previous_valid": previous,
        "error_rate": F.coalesce(F.col("errors") / total, F.lit(0.0)),
        "blocked_rate": F.coalesce(F.col("blocked") / total, F.lit(0.0)),
    })
    df = df.withColumn("valid_ratio", F.when(
        F.col("previous_valid") > 0, F.col("valid") / F.nullif(F.col("previous_valid"), F.lit(0))))
    reasons = F.filter(F.array(
        F.when(F.col("valid_ratio") < rules.min_valid_ratio, F.lit("valid_observation_drop")),
        F.when(F.col("error_rate") > rules.max_error_rate, F.lit("source_error_spike")),
        F.when(F.col("blocked_rate") > rules.max_blocked_rate, F.lit("blocked_spike")),
    ), lambda r: r.isNotNull())
    return df.withColumns({
        "reasons": reasons, "degraded": F.size(reasons) > 0, "rule_version": F.lit(rules.version)})


def mark_degraded(observations: DataFrame, health: DataFrame) -> DataFrame:
    """Flag observations of degraded runs.

    Only the ids of degraded runs travel to the join; AQE decides how.
    """
    bad = health.filter("degraded").select("run_id", F.lit(True).alias("__bad")).distinct()
    return (
        observations.drop("run_degraded").join(bad, "run_id", "left")
        .withColumn("run_degraded", F.coalesce(F.col("__bad"), F.lit(False))).drop("__bad")
    )
