"""Source catalogue views and the gate every collection run must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.constants import IMPORT_ACCESS_MODES

SAFE_COLUMNS = ("id", "key", "display_name", "access_mode", "compliance_status",
                "automation_allowed", "capabilities", "review_expires_at")


def source_catalogue(sources: DataFrame) -> DataFrame:
    """Non-sensitive projection of all sources, by key."""
    return sources.select(*[c for c in SAFE_COLUMNS if c in sources.columns]).orderBy("key")


def import_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(
        (F.col("compliance_status") == "approved")
        & F.col("access_mode").isin(*IMPORT_ACCESS_MODES)
    ).select("id", "key", "display_name", "access_mode")


def browser_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("access_mode") == "browser_automation").select(
        "id", "key", "display_name", "compliance_status")


def missing_capabilities(declared: Column, requested: Column) -> Column:
    return F.array_except(requested, declared)


def gate_reason(now: Column, automated: Column, requested: Column) -> Column:
    """Why a source may not run, NULL when it may.  Checked in order."""
    expiry = F.col("review_expires_at").try_cast("timestamp")
    none_declared = F.array().cast("array<string>")
    return (
        F.when(~F.col("compliance_status").eqNullSafe(F.lit("approved")), "not_approved")
        .when(automated & ~F.coalesce(F.col("automation_allowed"), F.lit(False)),
              "automation_not_allowed")
        .when(F.col("review_expires_at").isNotNull() & expiry.isNull(), "invalid_review_expiry")
        .when(expiry < now, "review_expired")
        .when(F.size(missing_capabilities(
            F.coalesce(F.col("capabilities"), none_declared), requested)) > 0,
            "capability_not_declared")
    )


def gated_runs(runs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Runs joined with their source and the gate's verdict.

    ``runs`` has run_id, source_id, automated, requested_capabilities.
    """
    joined = runs.join(sources.withColumnRenamed("id", "source_id"), "source_id")
    reason = gate_reason(now, F.col("automated"), F.coalesce(
        F.col("requested_capabilities"), F.array().cast("array<string>")))
    return joined.withColumn("refusal", reason).withColumn(
        "allowed", F.col("refusal").isNull())


def due_schedules(schedules: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Enabled schedules of runnable sources whose cadence has elapsed."""
    runnable = sources.filter(
        (F.col("compliance_status") == "approved") & F.col("automation_allowed")
    ).select(F.col("id").alias("source_id"))
    elapsed = F.col("last_enqueued_at").isNull() | (
        F.col("last_enqueued_at") < now - F.make_dt_interval(mins=F.col("cadence_minutes")))
    return schedules.filter(F.col("enabled") & elapsed).join(runnable, "source_id", "left_semi")
