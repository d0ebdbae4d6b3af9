"""The stream gives the batch's rows, and replays add nothing."""

import datetime as dt

from pyspark.sql import functions as F

from test_lifecycle import SCHEMA, random_rows

from tidewatch.operators.lifecycle import lifecycle_rows
from tidewatch.streaming import observations as stream

COLUMNS = ("snapshot_id", "status", "previous_status", "consecutive_misses",
           "transition_sequence", "event_type", "dedupe_key")


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch(spark, tmp_path):
    rows = random_rows(31, listings=25, longest=16)
    whole = spark.createDataFrame(rows, SCHEMA)
    times = sorted(r[3] for r in rows)
    cuts = [times[0], times[len(times) // 2], None]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in zip(cuts, cuts[1:]):
        part = whole.filter(whole.observed_at >= low)
        if high is not None:
            part = part.filter(part.observed_at < high)
        part.coalesce(1).write.mode("append").parquet(folder)
        for again in ("cp", f"cp-{high}"):  # a new checkpoint is a replay from the start
            live = stream.observation_files(spark, folder, files_per_batch=1)
            run(stream.write_lifecycle(live, out, str(tmp_path / again)))
    got = {r[0]: tuple(r) for r in spark.read.parquet(f"{out}/rows").select(*COLUMNS).collect()}
    want = {r[0]: tuple(r) for r in lifecycle_rows(whole).select(*COLUMNS).collect()}
    assert got == want
    keys = sorted({v[-1] for v in want.values() if v[-1]})
    # One stream goes on; the others start anew and bring every row again.
    for checkpoint in ("e", "e", "f", "g"):
        run(stream.write_events(stream.event_rows(spark, out), out, str(tmp_path / checkpoint)))
        stored = stream.event_table(spark, out).read().select("dedupe_key").collect()
        assert sorted(r[0] for r in stored) == keys


def test_events_that_are_late_or_repeated(spark, tmp_path):
    folder, out = str(tmp_path / "rows"), str(tmp_path / "out")
    schema = "dedupe_key string, event_type string, observed_at timestamp"
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2025, 1, 1)
    for part, stored in (([("a", "x", new), ("a", "x", new), ("b", "x", new)], 2), ([("c", "x", old), ("a", "x", old)], 3),
                         ([("b", "x", new)], 3)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        live = stream.observation_files(spark, folder, spark.read.parquet(folder).schema)
        run(stream.write_events(live, out, str(tmp_path / "cp"), remembered="0 seconds"))
        assert stream.event_table(spark, out).read().count() == stored


def test_a_batch_reads_the_states_of_its_own_buckets(spark, tmp_path, monkeypatch):
    table = stream.state_table(spark, str(tmp_path))
    table._asked = 32
    table.upsert(spark.range(400).select(F.col("id").cast("string").alias("listing_id"), F.lit(1).alias("v")))
    some = spark.createDataFrame([("7",), ("8",)], "listing_id string")
    assert len(table.groups_for(some)) <= 2
    assert sorted(r[0] for r in table.rows_for(some).collect()) == ["7", "8"]


RUN_SCHEMA = ("dataset_id string, source_key string, run_id string, listing_id string, "
              "snapshot_id string, observed_at timestamp, observation_status string")


def observed(source, run_id, start, n, status="active", every=20):
    return [("d", source, run_id, f"l{k}", f"{source}{run_id}{k}", start + dt.timedelta(minutes=every * k), status)
            for k in range(n)]


def test_run_health_inside_the_stream(spark, tmp_path):
    """Runs over midnight, two sources, a run of failures, a lone run, late rows."""
    night = dt.datetime(2025, 3, 3, 23, 0)
    day = dt.timedelta(days=1)
    beat = lambda at: [("d", s, None, None, None, at, None) for s in "ab"]
    first = observed("a", "r1", night, 9)
    parts = [
        first[:4], first[4:] + observed("b", "r1", night, 40),
        observed("a", "r2", night + 2 * day, 2) + observed("b", "r2", night + 2 * day, 38)
        + observed("b", "r2", night + 2 * day + dt.timedelta(hours=13), 2, "source_error"),
        observed("a", "r1", night, 5),  # two days late: the watermark has passed them
        observed("b", "r3", night + 4 * day, 30, "blocked") + observed("b", "r3", night + 4 * day, 10),
        beat(night + 9 * day), observed("a", "r2", night + 9 * day + dt.timedelta(minutes=1), 3),  # judged before
        beat(night + 19 * day),
    ]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        frame = spark.createDataFrame(part, RUN_SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(folder)
        live = stream.observation_files(spark, folder, frame.schema, files_per_batch=1)
        run(stream.write_run_health(live, out, str(tmp_path / "cp")))
    got = sorted(((r.source_key, r.run_id), r.total, r.valid, r.degraded, list(r.reasons))
                 for r in spark.read.parquet(out).collect())
    assert got == [
        (("a", "r1"), 9, 9, False, []), (("a", "r2"), 2, 2, True, ["valid_observation_drop"]),
        (("b", "r1"), 40, 40, False, []), (("b", "r2"), 40, 38, False, []),
        (("b", "r3"), 40, 10, True, ["valid_observation_drop", "blocked_spike"])]
