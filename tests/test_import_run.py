"""The golden timeline and invalid rows, through the whole import run."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from tidewatch.config import LifecycleRules
from tidewatch.operators import validation
from tidewatch.operators.lifecycle import STATE_COLUMNS, lifecycle_rows, lifecycle_state
from tidewatch.plans.import_run import Policy, Store, listing_states, run_import
from tidewatch.plans.reprocess import reprocess_events, rules_version
from tidewatch.sources.csv_files import read_csv

HEADER = (
    "source_key,external_id,source_url,title,observed_at,observation_status,region,latitude,"
    "longitude,rating,review_count,observed_price_amount,observed_price_currency,"
    "observed_price_unit,bedrooms,bathrooms,guest_capacity,is_superhost,host_external_id,"
    "official_website,business_whatsapp,direct_booking_url,canonical_property_key"
).split(",")

DAYS = ("2025-03-03", "2025-03-05", "2025-03-07", "2025-03-14", "2025-03-17")
# (listing, run) of rows that are no active observation, and rows there are none of.
OTHER = {(2, 1): "not_found", (2, 2): "not_found", (2, 3): "not_found",
         (4, 1): "search_not_observed", (5, 1): "source_error"}
ABSENT = {(7, 0), *((n, 4) for n in (1, 3, 4, 5, 6, 7))}
CHANNELS = {(2, 4), *((6, run) for run in range(1, 5)), *((n, run) for n in (1, 3) for run in range(5))}


def observed(n, run):
    """What listing n shows in a run: reviews always grow, ratings hardly move, listing 1
    gets a tenth dearer after the first run."""
    status = OTHER.get((n, run), "active")
    if status != "active":
        return status, "", "", ""
    price = 640_000 + 90_000 * n
    return status, f"{4.1 + 0.1 * n + 0.01 * run:.2f}", 30 * n + 4 * run, price * 11 // 10 if (
        n == 1 and run) else price


TIMELINE = {day: {n: observed(n, run) for n in range(1, 8) if (n, run) not in ABSENT}
            for run, day in enumerate(DAYS)}
CODE_EVENTS = {
    "2025-03-03": {(n, "listing_created") for n in range(1, 7)},
    "2025-03-05": {(1, "price_changed"), (1, "review_count_changed"), (2, "listing_first_miss"),
                   (3, "review_count_changed"), (5, "source_error"),
                   (6, "review_count_changed"), (7, "listing_created")},
    "2025-03-07": {(2, "listing_suspected_inactive"), (1, "review_count_changed"),
                   (3, "review_count_changed"), (6, "review_count_changed"),
                   (7, "review_count_changed")},
    "2025-03-14": {(n, "review_count_changed") for n in (1, 3, 4, 5, 6, 7)},
    "2025-03-17": {(2, "listing_reactivated")},
}
EXTRA_SPEC_EVENTS = {
    "2025-03-05": {(6, "direct_channel_added")},
    "2025-03-07": {(4, "review_count_changed"), (5, "review_count_changed")},
    "2025-03-14": {(2, "listing_confirmed_inactive")},
    "2025-03-17": {(2, "review_count_changed"), (2, "direct_channel_added")},
}


def timeline_csv(day):
    out = io.StringIO()
    writer = csv.DictWriter(out, HEADER, restval="")
    writer.writeheader()
    for n, (status, rating, reviews, price) in TIMELINE[day].items():
        shop = f"https://stay{n}.example" if (n, DAYS.index(day)) in CHANNELS else ""
        writer.writerow({
            "source_key": "feed", "external_id": f"lst-{n}",
            "source_url": f"https://feed.example/item/{n}", "title": f"Stay {n}",
            "observed_at": f"{day}T00:00:00Z", "observation_status": status,
            "latitude": -8.4 - n / 50, "longitude": 115.1 + n / 40, "rating": rating,
            "review_count": reviews, "observed_price_amount": price,
            "observed_price_currency": "IDR" if price else "",
            "observed_price_unit": "night" if price else "", "bedrooms": n, "bathrooms": 1,
            "guest_capacity": 2 * n, "is_superhost": "false", "host_external_id": f"h{n}",
            "official_website": shop, "business_whatsapp": f"+62 800 {n}" if shop else "",
            "direct_booking_url": shop and f"{shop}/reserve", "canonical_property_key": f"stay-{n}",
        })
    return out.getvalue()


def replay(spark, tmp_path, policy):
    store = Store(str(tmp_path / "store"), buckets=2)
    per_day = {}
    for day in TIMELINE:
        file = tmp_path / f"{day}.csv"
        file.write_text(timeline_csv(day))
        before = store.read(spark, "events")
        keys = set() if before is None else {r[0] for r in before.select("dedupe_key").collect()}
        for _ in range(2 if day == DAYS[1] and policy == Policy() else 1):  # the second pass is a replay
            run_import(spark, read_csv(spark, str(file)), store, "d1", f"run-{day}",
                       ["feed"], policy)
        names = store.read(spark, "listings").select("listing_id", "external_id")
        rows = store.read(spark, "events").join(names, "listing_id").collect()
        assert len({r.dedupe_key for r in rows}) == len(rows)
        assert all(r.dataset_id == "d1" and r.property_id for r in rows)
        per_day[day] = sorted((int(r.external_id[-1]), r.event_type)
                              for r in rows if r.dedupe_key not in keys)
        assert store.read(spark, "evidence").count() == len(rows)
    return store, per_day


def test_timeline_default_policy(spark, tmp_path):
    store, per_day = replay(spark, tmp_path, Policy())
    assert per_day == {d: sorted(e) for d, e in CODE_EVENTS.items()}
    state = listing_states(spark, store).filter("external_id = 'lst-2'").head()
    assert (state.status, state.consecutive_misses, state.transition_sequence) == (
        "reactivated", 0, 2)


def test_timeline_full_policy(spark, tmp_path):
    policy = Policy(
        lifecycle=LifecycleRules(direct_not_found_is_high_confidence=True),
        predecessor="field", blank_means_null_when_active=True)
    store, per_day = replay(spark, tmp_path, policy)
    assert per_day == {d: sorted(e | EXTRA_SPEC_EVENTS.get(d, set()))
                       for d, e in CODE_EVENTS.items()}
    state = listing_states(spark, store).filter("external_id = 'lst-2'").head()
    assert (state.status, state.transition_sequence) == ("reactivated", 3)


def test_a_late_run_gives_the_states_of_event_time_order(spark, tmp_path):
    """Runs come in the order 1, 3, 2; the store ends like a batch over all of its snapshots."""
    store = Store(str(tmp_path / "store"), buckets=2)
    for day in (DAYS[0], DAYS[2], DAYS[1]):
        file = tmp_path / f"{day}.csv"
        file.write_text(timeline_csv(day))
        run_import(spark, read_csv(spark, str(file)), store, "d1", f"run-{day}", ["feed"])
    history = store.read(spark, "snapshots").withColumn("run_degraded", F.lit(False))
    columns = ["listing_id", *STATE_COLUMNS]
    expected = lifecycle_state(lifecycle_rows(history)).select(*columns).collect()
    assert sorted(store.read(spark, "states").select(*columns).collect()) == sorted(expected)
    kept = store.read(spark, "states").select("listing_id", F.size("heads").alias("n")).collect()
    assert {r.n for r in kept} == {1}
    # The stored events stay; all of them once more under another rule version.
    stored = sorted(r[0] for r in store.read(spark, "events").select("dedupe_key").collect())
    rules = Policy(lifecycle=LifecycleRules(version="lifecycle-state:v2", suspected_min_misses=1, suspected_min_hours=0,
                                            suspected_min_runs=1))
    versions = reprocess_events(spark, store, rules, "ana", "2025-04-01", "one miss is enough")
    again = versions.read(rules_version(rules)).join(
        store.read(spark, "listings").select("listing_id", "external_id"), "listing_id").collect()
    assert {(r.external_id, r.event_type) for r in again if "inactive" in r.event_type} == {
        ("lst-2", "listing_suspected_inactive")}
    assert sum(r.event_type == "listing_created" for r in again) == 7
    assert sorted(r[0] for r in store.read(spark, "events").select("dedupe_key").collect()) == stored


INVALID = """source_key,external_id,observed_at,observation_status,latitude,longitude,rating,review_count
feed,,yesterday,active,-8.4,115.3,3.9,4
feed,w2,2025-03-03T00:00:00Z,active,-8.4,115.3,5.6,4
feed,w3,2025-03-03T00:00:00Z,active,-8.4,115.3,3.9,-7
feed,w4,2025-03-03T00:00:00Z,gone,-8.4,115.3,3.9,4
feed,w5,2025-03-03T00:00:00Z,active,95,190,3.9,4
stranger,w6,2025-03-03T00:00:00Z,active,-8.4,115.3,3.9,4
"""


def test_invalid_rows(spark, tmp_path):
    file = tmp_path / "bad.csv"
    file.write_text("﻿" + INVALID)
    done = validation.process_import(read_csv(spark, str(file)), ["feed"])
    found = [(r.row_number, r.code) for r in
             validation.rejection_rows(done).orderBy("row_number", "position").collect()]
    assert found == [
        (1, "missing_external_id"), (1, "invalid_timestamp"), (2, "rating_out_of_range"),
        (3, "negative_review_count"), (4, "invalid_status"), (5, "invalid_coordinates"),
        (6, "unknown_source")]
    metrics = validation.import_metrics(done).head()
    assert (metrics.total, metrics.accepted, metrics.rejected, metrics.duplicates) == (6, 0, 7, 0)
    assert metrics.status == "completed_with_errors"


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_and_conflicts(spark, tmp_path, hot):
    lines = ["source_key,external_id,observed_at,observation_status,title"]
    for n in range(40):
        lines.append(f"feed,same,2025-03-03,active,{'A' if n % 3 == 0 else 'B'}")
    lines.append('feed,other,2025-03-03,active,"two\nlines, ""quoted"""')
    file = tmp_path / "dup.csv"
    file.write_text("\n".join(lines))
    if hot:
        spark.conf.set("spark.tidewatch.maxRowsPerGroup", "6")
    try:
        raw = read_csv(spark, str(file))
        done = validation.process_import(raw, ["feed"])
        counts = {r.outcome: r["count"] for r in done.groupBy("outcome").count().collect()}
        assert counts == {"accepted": 2, "duplicate": 13, "conflict": 26}
        first = done.filter("outcome = 'accepted'").orderBy("row_number").collect()
        assert [r.row_number for r in first] == [1, 41]
        assert first[1].row.title == 'two\nlines, "quoted"'
    finally:
        spark.conf.unset("spark.tidewatch.maxRowsPerGroup")


def test_missing_headers(spark, tmp_path):
    file = tmp_path / "h.csv"
    file.write_text("source_key,title\na,b\n")
    with pytest.raises(ValueError, match="external_id, observed_at, observation_status"):
        read_csv(spark, str(file))


def test_row_numbers_follow_file_order(spark, tmp_path):
    file = tmp_path / "big.csv"
    body = "\n".join(f"s,{n},2026-01-01,active" for n in range(5000))
    file.write_text("source_key,external_id,observed_at,observation_status\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = read_csv(spark, str(file))
        assert table.rdd.getNumPartitions() > 2
        wrong = table.filter(F.col("external_id").cast("long") + 1 != F.col("row_number"))
        assert wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
