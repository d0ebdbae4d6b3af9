"""Keyed tables: what is read, what is rewritten, and what a repeated commit does."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.sinks.keyed import KeyedTable, bloom_of, may_hold


def rows(spark, run, listings, extra=0):
    return spark.range(listings).select(
        F.col("id").cast("string").alias("listing_id"), F.lit(f"run-{run:03d}").alias("run_id"),
        (F.col("id") * 10 + extra).alias("value"))


def test_bloom():
    rng = np.random.default_rng(1)
    keys = rng.integers(-2**63, 2**63, 20_000)
    bloom = bloom_of(keys)
    assert all(may_hold(bloom, keys[k:k + 1]) for k in range(0, 20_000, 97))
    others = rng.integers(-2**63, 2**63, 20_000)
    assert sum(may_hold(bloom, others[k:k + 1]) for k in range(0, 20_000)) < 10
    assert may_hold(bloom, np.r_[others[:1000], keys[:1]]) and not may_hold(bloom, keys[:0])


def test_append_reads_only_groups_that_may_hold_a_key(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["listing_id", "run_id"], ["listing_id"], buckets=4)
    for run in range(8):
        table.append(rows(spark, run, 50))
    assert table.read().count() == 400
    assert table.groups_for(rows(spark, 99, 50)) == []  # no range overlaps
    # Within the ranges, but absent: the filters deny it.
    between = rows(spark, 5, 50).withColumn("run_id", F.lit("run-005x"))
    wide = between.unionByName(rows(spark, 3, 1).withColumn("run_id", F.lit("run-000a")))
    assert len(table.groups_for(wide)) <= 2
    # A replay finds the groups of its own run, and adds nothing.
    assert {g.number for g in table.groups_for(rows(spark, 7, 50))} == {7}
    table.append(rows(spark, 7, 60, extra=1))
    assert table.read().count() == 410
    assert table.read().filter("run_id = 'run-007' and value % 10 = 1").count() == 10


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["listing_id"], buckets=16, blooms=False)
    table.upsert(rows(spark, 0, 200))
    first = {g.bucket: g.id for g in table.groups()}
    change = rows(spark, 1, 200, extra=5).filter("listing_id in ('3', '77')").unionByName(
        spark.createDataFrame([("new", "run-001", 1)], "listing_id string, run_id string, value long"))
    table.upsert(change)
    second = {g.bucket: g.id for g in table.groups()}
    touched = {r[0] for r in change.select(table.bucket()).distinct().collect()}
    assert {b for b in second if second[b] != first.get(b)} == touched
    got = {r.listing_id: r.value for r in table.read().collect()}
    assert got == {**{str(k): 10 * k for k in range(200)}, "3": 35, "77": 775, "new": 1}
    # As it was before.
    assert table.read(before=1).count() == 200


@pytest.mark.parametrize("kind", ["append", "upsert"])
def test_a_repeated_commit_sees_the_table_before_it(spark, tmp_path, kind):
    table = KeyedTable(spark, str(tmp_path / "t"), ["listing_id"], buckets=4)
    commit = getattr(table, kind)
    assert commit(rows(spark, 0, 10), tag="a") == 0
    assert commit(rows(spark, 1, 12), tag="b") == 1
    assert commit(rows(spark, 2, 0), tag="c") == 2  # empty
    assert commit(rows(spark, 3, 14), tag="b") == 1
    assert {r.run_id for r in table.read(before=2).collect()} == (
        {"run-003"} if kind == "upsert" else {"run-000", "run-003"})
    assert table.number_for("c") == 2 and table.number_for("d") == 3


def test_merge_compaction_and_vacuum(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["listing_id"], buckets=4)

    def add(stored, new):
        both = stored.unionByName(new)
        return both.groupBy("listing_id").agg(F.max("run_id").alias("run_id"), F.sum("value").alias("value"))

    rng, expected = random.Random(2), {}
    for run in range(6):
        some = rows(spark, run, rng.randint(1, 30), extra=run)
        for r in some.collect():
            expected[r.listing_id] = expected.get(r.listing_id, 0) + r.value
        table.upsert(some, add)
    assert {r.listing_id: r.value for r in table.read().collect()} == expected
    log = KeyedTable(spark, str(tmp_path / "log"), ["listing_id", "run_id"], buckets=2)
    for run in range(5):
        log.append(rows(spark, run, 8))
    before = sorted(map(tuple, log.read().collect()))
    log.compact(most=3)
    log.vacuum()
    assert len(log.groups()) == 2 and sorted(map(tuple, log.read().collect())) == before
    assert log.only_new(rows(spark, 3, 9)).count() == 1
    assert sorted(map(tuple, log.rows_for(rows(spark, 3, 2)).collect())) == [
        ("0", "run-003", 0), ("1", "run-003", 10)]


def test_an_empty_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["listing_id"])
    assert table.read() is None and table.groups() == [] and table.rows_for(rows(spark, 0, 3)) is None
    assert table.only_new(rows(spark, 0, 3)).count() == 3
    table.append(rows(spark, 0, 0))
    assert table.read() is None
