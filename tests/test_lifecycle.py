"""The windowed life cycle against a row-by-row restatement of its rules."""

import datetime as dt
import random

import pytest

from tidewatch.config import LifecycleRules
from tidewatch.operators.lifecycle import lifecycle_events, lifecycle_rows, lifecycle_state

START = dt.datetime(2026, 1, 1)
SCHEMA = (
    "listing_id string, snapshot_id string, run_id string, observed_at timestamp, "
    "observation_status string, high_confidence_not_found boolean, run_degraded boolean"
)


def fold(rows, rules):
    """One listing, in order; yields (snapshot, status, misses, seq, event, previous)."""
    status, misses, start, runs, last_run, strong, seq = "active", 0, None, 0, None, False, 0
    for _, snap, run, at, obs, high, degraded in rows:
        event, before = None, status
        if not degraded:
            if obs == "source_error":
                event = "source_error_observed"
            elif obs == "active":
                status = "active"
                if before in ("suspected_inactive", "confirmed_inactive"):
                    status, event, seq = "reactivated", "reactivated", seq + 1
                misses, start, runs, last_run, strong = 0, None, 0, None, False
            elif obs == "not_found" or (obs == "unavailable" and rules.count_unavailable):
                misses += 1
                start = start or at
                runs += run != last_run
                last_run = run
                strong = strong or (obs == "not_found" and high)
                hours = (at - start).total_seconds() / 3600
                gone = (misses >= rules.confirmed_min_misses
                        and hours >= rules.confirmed_min_days * 24
                        and strong and obs == "not_found")
                maybe = (misses >= rules.suspected_min_misses
                         and hours >= rules.suspected_min_hours
                         and runs >= rules.suspected_min_runs)
                if gone and before != "confirmed_inactive":
                    status, event, seq = "confirmed_inactive", "confirmed_inactive", seq + 1
                elif maybe and before not in ("suspected_inactive", "confirmed_inactive"):
                    status, event, seq = "suspected_inactive", "suspected_inactive", seq + 1
                elif before in ("active", "reactivated"):
                    status, event = "first_miss", "first_miss"
        yield snap, status, misses, seq, event, before


def random_rows(seed, listings=60, longest=30):
    rng = random.Random(seed)
    rows = []
    for n in range(listings):
        at = START
        for i in range(rng.randint(1, longest)):
            at += dt.timedelta(hours=rng.choice([0, 6, 24, 60, 100]))
            rows.append((
                f"l{n}", f"s{n:03d}-{i:03d}", f"r{i // rng.choice([1, 2])}", at,
                rng.choice(["active", "not_found", "not_found", "not_found", "unavailable",
                            "blocked", "source_error", "unknown"]),
                rng.random() < 0.5, rng.random() < 0.1,
            ))
    return rows


def compare(spark, rules, seed):
    rows = random_rows(seed)
    expected = {}
    for listing in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == listing), key=lambda r: (r[3], r[1]))
        for snap, *rest in fold(mine, rules):
            expected[snap] = tuple(rest)
    shuffled = rows[:]
    random.Random(7).shuffle(shuffled)
    got = {
        r.snapshot_id: (r.status, r.consecutive_misses, r.transition_sequence, r.event_type,
                        r.previous_status)
        for r in lifecycle_rows(spark.createDataFrame(shuffled, SCHEMA), rules).collect()
    }
    assert got == expected
    return rows


@pytest.mark.parametrize("rules", [
    LifecycleRules(),
    LifecycleRules(version="t2", suspected_min_misses=1, suspected_min_hours=0,
                   suspected_min_runs=1, confirmed_min_misses=2, confirmed_min_days=2),
    LifecycleRules(version="t3", count_unavailable=False, confirmed_min_days=1),
])
def test_fold_parity(spark, rules):
    compare(spark, rules, seed=11)


def test_fold_parity_when_every_listing_is_hot(spark, small_groups):
    compare(spark, LifecycleRules(), seed=5)


@pytest.mark.parametrize("hot", [False, True])
def test_resume_from_prior_state(spark, hot):
    rows = [r for r in random_rows(23) if True]
    half = START + dt.timedelta(days=12)
    whole = spark.createDataFrame(rows, SCHEMA)
    first = whole.filter(whole.observed_at < half)
    rest = whole.filter(whole.observed_at >= half)
    if hot:
        spark.conf.set("spark.tidewatch.maxRowsPerGroup", "6")
    try:
        state = lifecycle_state(lifecycle_rows(first))
        resumed = lifecycle_rows(rest, prior_state=state)
        columns = ["snapshot_id", "status", "previous_status", "consecutive_misses",
                   "transition_sequence", "event_type", "dedupe_key", "first_miss_at",
                   "last_seen_active_at", "confidence", "distinct_miss_runs"]
        got = {r[0]: r for r in resumed.select(*columns).collect()}
        full = lifecycle_rows(whole).filter(whole.observed_at >= half)
        assert got == {r[0]: r for r in full.select(*columns).collect()}
    finally:
        spark.conf.unset("spark.tidewatch.maxRowsPerGroup")


def test_events_carry_keys_and_text(spark):
    day = dt.timedelta(days=1)
    rows = [
        ("a", "s1", "r1", START, "active", False, False),
        ("a", "s2", "r2", START + 2 * day, "not_found", True, False),
        ("a", "s3", "r3", START + 4 * day, "not_found", True, False),
        ("a", "s4", "r4", START + 11 * day, "not_found", True, False),
        ("a", "s5", "r5", START + 14 * day, "active", False, False),
        ("b", "t1", "r1", START, "source_error", False, False),
    ]
    events = {e.dedupe_key: e for e in
              lifecycle_events(lifecycle_rows(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(events) == {
        "listing_first_miss:a:s2:lifecycle-state:v1",
        "listing_suspected_inactive:a:1:lifecycle-state:v1",
        "listing_confirmed_inactive:a:2:lifecycle-state:v1",
        "listing_reactivated:a:s5:lifecycle-state:v1",
        "source_error:b:r1:lifecycle-state:v1",
    }
    suspected = events["listing_suspected_inactive:a:1:lifecycle-state:v1"]
    assert suspected.explanation.startswith("The listing returned 2 qualifying misses across")
    assert suspected.previous_status == "first_miss"
    assert events["listing_reactivated:a:s5:lifecycle-state:v1"].previous_status == \
        "confirmed_inactive"


def test_ranges_are_even_for_bursts_outliers_and_nulls(spark):
    from pyspark.sql import functions as F

    from tidewatch.operators import scans

    n = F.col("id")
    # One early outlier, then 19 999 rows within two minutes, for one key.
    burst = spark.range(20_000).select(
        F.lit("hot").alias("k"), F.when(n == 0, 0).otherwise(10**15 + n % 120).alias("at"), n.alias("seq"))
    cut = scans.even_segments(burst, ["k"], ["at", "seq"], 40)
    sizes = [r[1] for r in cut.groupBy(scans.SEGMENT).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 40
    left = spark.range(20_000).select(F.when(n % 10 == 0, n % 7).alias("k"), n.alias("v"))
    right = spark.range(5).select(n.alias("k"), (n * 10).alias("w"))
    spread = left.withColumn("s", scans._spread_nulls(left, ["k"]))
    assert spread.filter("k is null").groupBy("s").count().agg(F.max("count")).first()[0] < 40
    for how in ("left", "left_semi", "left_anti", "inner"):
        def rows(df):
            return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)

        assert rows(scans.lookup(left, right, ["k"], how)) == rows(left.join(right, ["k"], how))
