"""Listing life cycle: a fold over time, written as running values.

Misses since the last active sighting form an island.  Inside an island every
quantity the rules look at only grows (miss count, elapsed time, run changes,
high-confidence evidence), so the status is a running maximum of the level each
miss reaches on its own: 1 first miss, 2 suspected, 3 confirmed.  An active row
reactivates exactly when the level just before it was 2 or 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import LifecycleRules
from tidewatch.constants import EXPLANATIONS, NON_QUALIFYING_STATUSES
from tidewatch.operators.scans import Scan, by_key, micros, running

HOUR_MICROS = 3_600_000_000
STATUS_OF_LEVEL = {1: "first_miss", 2: "suspected_inactive", 3: "confirmed_inactive"}
CONFIDENCE_OF_LEVEL = {1: "low", 2: "medium", 3: "high"}
STATE_COLUMNS = (
    "status", "confidence", "consecutive_misses", "last_seen_active_at", "last_observed_at",
    "first_miss_at", "suspected_inactive_at", "confirmed_inactive_at", "reactivated_at",
    "miss_sequence_start_at", "last_miss_run_id", "distinct_miss_runs",
    "high_confidence_in_sequence", "transition_sequence",
)
_ORDER = ["__at", "snapshot_id"]


def lifecycle_rows(
    observations: DataFrame,
    rules: LifecycleRules = LifecycleRules(),
    prior_state: DataFrame | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """State after, and event raised by, every observation.

    Needs listing_id, snapshot_id, run_id, observed_at, observation_status;
    optional high_confidence_not_found, run_degraded.  ``prior_state`` (one row
    per listing, STATE_COLUMNS) resumes from an earlier batch.
    """
    df = observations
    for flag in ("high_confidence_not_found", "run_degraded"):
        if flag not in df.columns:
            df = df.withColumn(flag, F.lit(False))
    status = F.col("observation_status")
    degraded = F.coalesce(F.col("run_degraded"), F.lit(False))
    counted = status == "not_found"
    if rules.count_unavailable:
        counted = counted | (status == "unavailable")
    direct = F.lit(True) if rules.direct_not_found_is_high_confidence else F.coalesce(
        F.col("high_confidence_not_found"), F.lit(False))
    df = df.withColumns({
        "__at": micros("observed_at"),
        "__active": ~degraded & (status == "active"),
        "__miss": ~degraded & counted,
        "__strong": ~degraded & (status == "not_found") & direct,
        "__error": ~degraded & (status == "source_error"),
        "__seed": F.lit(False),
    })
    if prior_state is not None:
        df = df.unionByName(_seed_rows(prior_state, df), allowMissingColumns=True)

    def body(part: DataFrame, segment: str | None) -> DataFrame:
        return _fold(part, rules, segment, prior_state is not None)

    if sized_by is not None:
        sized_by = sized_by.withColumn("__at", micros("observed_at"))
    return by_key(df, ["listing_id"], _ORDER, body, sized_by)


def _seed_rows(prior: DataFrame, like: DataFrame) -> DataFrame:
    """One pseudo-row per known listing, ahead of all its new observations."""
    # Only listings seen in this batch are resumed.
    current = like.select("listing_id").distinct()
    return prior.join(current, "listing_id", "left_semi").select(
        "listing_id",
        F.lit(-(2**62)).cast("long").alias("__at"),
        F.lit(False).alias("__active"), F.lit(False).alias("__miss"),
        F.lit(False).alias("__strong"), F.lit(False).alias("__error"),
        F.lit(True).alias("__seed"),
        *[F.col(c).alias(f"__s_{c}") for c in STATE_COLUMNS],
    )


def _fold(df: DataFrame, rules: LifecycleRules, segment: str | None, seeded: bool) -> DataFrame:
    key = ["listing_id"]
    rv = rules.version
    seed, miss, active = F.col("__seed"), F.col("__miss"), F.col("__active")

    def start_from(state: str, value: Column) -> Column:
        return F.when(seed, F.col(f"__s_{state}")).otherwise(value) if seeded else value

    at = F.col("__at")
    seen = F.col("observed_at")
    df = running(df, key, _ORDER, [
        Scan("__m", "sum", start_from("consecutive_misses", miss.cast("long"))),
        Scan("__start", "first", start_from("miss_sequence_start_at", F.when(miss, seen))),
        Scan("__prev_run", "last", start_from("last_miss_run_id", F.when(miss, F.col("run_id"))),
             before=True),
        Scan("__hc", "max", start_from("high_confidence_in_sequence", F.col("__strong"))),
    ], reset="__active", segment=segment)

    new_run = miss & ~F.col("run_id").eqNullSafe(F.col("__prev_run"))
    df = running(df, key, _ORDER, [
        Scan("__runs", "sum", start_from("distinct_miss_runs", new_run.cast("long"))),
    ], reset="__active", segment=segment)

    elapsed = at - micros("__start")
    confirmed = (
        (F.col("__m") >= rules.confirmed_min_misses)
        & (elapsed >= rules.confirmed_min_days * 24 * HOUR_MICROS)
        & F.col("__hc") & (F.col("observation_status") == "not_found")
    )
    suspected = (
        (F.col("__m") >= rules.suspected_min_misses)
        & (elapsed >= rules.suspected_min_hours * HOUR_MICROS)
        & (F.col("__runs") >= rules.suspected_min_runs)
    )
    reached = F.when(miss, F.when(confirmed, 3).when(suspected, 2).otherwise(1))
    if seeded:
        known = F.when(F.col("__s_status") == "confirmed_inactive", 3).when(
            F.col("__s_status") == "suspected_inactive", 2).when(
            F.col("__s_status") == "first_miss", 1)
        reached = F.when(seed, known).otherwise(reached)
    df = df.withColumn("__reached", reached)
    df = running(df, key, _ORDER, [
        Scan("__level", "max", F.col("__reached")),
        Scan("__level_before", "max", F.col("__reached"), before=True),
    ], reset="__active", segment=segment)

    df = df.withColumn("__closed", F.when(
        miss | active | seed, F.coalesce(F.col("__level"), F.lit(0))))
    df = running(df, key, _ORDER, [Scan("__last_level", "last", F.col("__closed"), before=True)],
                 segment=segment)

    level, before = F.col("__level"), F.coalesce(F.col("__level_before"), F.lit(0))
    back = active & (F.coalesce(F.col("__last_level"), F.lit(0)) >= 2)
    event = (
        F.when(back, "reactivated")
        .when(miss & (level == 3) & (before < 3), "confirmed_inactive")
        .when(miss & (level == 2) & (before < 2), "suspected_inactive")
        .when(miss & (level == 1) & (before < 1), "first_miss")
        .when(F.col("__error"), "source_error_observed")
    )
    own = F.when(back, "reactivated").when(active, "active")
    conf = F.when(active, "high")
    for n, name in STATUS_OF_LEVEL.items():
        own = own.when(miss & (level == n), name)
        conf = conf.when(miss & (level == n), CONFIDENCE_OF_LEVEL[n])
    df = df.withColumns({"event_type": event, "__own": own, "__conf": conf})

    kind = F.col("event_type")
    counts = kind.isin("reactivated", "confirmed_inactive", "suspected_inactive")
    if seeded:
        df = df.withColumn("__own", F.when(seed, F.col("__s_status")).otherwise(F.col("__own")))

    def latest(name: str, op: str, value: Column, state: str | None = None) -> Scan:
        return Scan(name, op, start_from(state or name, value))

    df = running(df, key, _ORDER, [
        Scan("status", "last", F.col("__own")),
        Scan("previous_status", "last", F.col("__own"), before=True),
        latest("confidence", "last", F.col("__conf")),
        Scan("transition_sequence", "sum",
             start_from("transition_sequence", F.coalesce(counts.cast("long"), F.lit(0)))),
        Scan("first_observed_at", "first",
             start_from("last_seen_active_at", seen)),
        latest("last_observed_at", "max", seen),
        latest("last_seen_active_at", "last", F.when(active, seen)),
        latest("first_miss_at", "min", F.when(miss, seen)),
        latest("suspected_inactive_at", "last", F.when(kind == "suspected_inactive", seen)),
        latest("confirmed_inactive_at", "last", F.when(kind == "confirmed_inactive", seen)),
        latest("reactivated_at", "last", F.when(kind == "reactivated", seen)),
    ], segment=segment)

    listing = F.col("listing_id").cast("string")
    by_snapshot, by_run = F.col("snapshot_id").cast("string"), F.col("run_id").cast("string")
    sequence = F.col("transition_sequence").cast("string")
    dedupe = (
        F.when(kind == "first_miss",
               F.concat_ws(":", F.lit("listing_first_miss"), listing, by_snapshot, F.lit(rv)))
        .when(kind == "suspected_inactive",
              F.concat_ws(":", F.lit("listing_suspected_inactive"), listing, sequence, F.lit(rv)))
        .when(kind == "confirmed_inactive",
              F.concat_ws(":", F.lit("listing_confirmed_inactive"), listing, sequence, F.lit(rv)))
        .when(kind == "reactivated",
              F.concat_ws(":", F.lit("listing_reactivated"), listing, by_snapshot, F.lit(rv)))
        .when(kind == "source_error_observed",
              F.concat_ws(":", F.lit("source_error"), listing, by_run, F.lit(rv)))
    )
    in_sequence = F.col("__m") > 0
    df = df.withColumns({
        "status": F.coalesce(F.col("status"), F.lit("active")),
        "previous_status": F.coalesce(F.col("previous_status"), F.lit("active")),
        "confidence": F.coalesce(F.col("confidence"), F.lit("low")),
        "last_seen_active_at": F.coalesce(F.col("last_seen_active_at"), F.col("first_observed_at")),
        "consecutive_misses": F.col("__m"),
        "miss_sequence_start_at": F.when(in_sequence, F.col("__start")),
        "distinct_miss_runs": F.col("__runs"),
        "last_miss_run_id": F.when(in_sequence, F.when(miss, F.col("run_id")).otherwise(
            F.col("__prev_run"))),
        "high_confidence_in_sequence": F.coalesce(F.col("__hc"), F.lit(False)),
        "dedupe_key": dedupe,
        "event_confidence": F.when(kind == "source_error_observed", "low").when(
            kind.isNotNull(), F.col("__conf")),
        "rule_version": F.lit(rv),
    })
    internal = [c for c in df.columns if c.startswith("__") and c != segment]
    return df.filter(~seed).drop("first_observed_at", *internal)


def lifecycle_events(rows: DataFrame, rules: LifecycleRules = LifecycleRules()) -> DataFrame:
    """The evidence-backed events among the folded rows."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "suspected_inactive", F.format_string(
            EXPLANATIONS["suspected_inactive"].format(misses="%d", hours=_plain(
                rules.suspected_min_hours), runs="%d"),
            F.col("consecutive_misses"), F.col("distinct_miss_runs")))
        .when(kind == "confirmed_inactive",
              EXPLANATIONS["confirmed_inactive"].format(days=_plain(rules.confirmed_min_days)))
    )
    for name in ("first_miss", "reactivated", "source_error_observed"):
        text = text.when(kind == name, EXPLANATIONS[name])
    return rows.filter(kind.isNotNull()).select(
        "listing_id", "event_type", F.col("observed_at").alias("event_at"),
        F.col("event_confidence").alias("confidence"), "dedupe_key", "previous_status",
        F.col("status").alias("current_status"), "snapshot_id", "run_id",
        text.alias("explanation"), "rule_version",
    )


def _plain(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else str(value)


def lifecycle_state(rows: DataFrame) -> DataFrame:
    """State after the last observation of every listing."""
    latest = F.max_by(F.struct(*STATE_COLUMNS), F.struct("observed_at", "snapshot_id"))
    return rows.groupBy("listing_id").agg(latest.alias("s")).select("listing_id", "s.*")


def observation_classes(df: DataFrame) -> DataFrame:
    """Mark source failures, search absences and rows that never count as a miss."""
    status = F.col("observation_status")
    return df.withColumns({
        "is_source_failure": status.isin("blocked", "source_error"),
        "is_search_absence": status == "search_not_observed",
        "is_non_qualifying": status.isin(*NON_QUALIFYING_STATUSES),
    })
