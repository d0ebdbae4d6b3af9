"""Deriving rows anew under other rules, beside what older rules derived.

Derived rows lie in one partition per rule version, and with them the keys the version was run
for, also those that gave no row.  A rerun overwrites the partitions of its own version only and
is otherwise safe to repeat; rows of other versions are not touched.  An audit row says who ran
which version why, and readers take all versions, one, or for each key the first of a list
of versions that covers it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import diffs, health, lifecycle
from tidewatch.operators.scans import lookup
from tidewatch.plans.import_run import Policy, Store, run_events
from tidewatch.sinks.keyed import KeyedTable

VERSION = "rule_version"


class Versions:
    """Rows derived per ``key`` under several rule versions."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.audit = KeyedTable(spark, f"{self.path}/audit", ["audit_id"], buckets=4)

    def _put(self, df: DataFrame, name: str, version: str) -> None:
        df.withColumn(VERSION, F.lit(version)).write.partitionBy(VERSION).mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")

    def put(self, version: str, rows: DataFrame, keys: DataFrame, actor: str, at: str, reason: str) -> None:
        """Write a version: its rows, the keys it was run for, and an audit row at the end."""
        # Keys without rows get a row of nulls, so that even an empty rerun overwrites the partition.
        covered = keys.select(self.key).distinct()
        bare = covered.join(rows.select(self.key).distinct(), self.key, "left_anti")
        self._put(rows.drop(VERSION).withColumn("__row", F.lit(True)).unionByName(
            bare, allowMissingColumns=True), "rows", version)
        self._put(covered, "keys", version)
        counts = self.spark.read.parquet(f"{self.path}/keys").filter(F.col(VERSION) == version).agg(
            F.count(F.lit(1)).alias("keys"))
        entry = counts.select(
            F.sha2(F.concat_ws("\u0001", F.lit(version), F.lit(actor), F.lit(at)), 256).alias("audit_id"),
            F.lit("rules.reprocess").alias("action"), F.lit(version).alias(VERSION), F.lit(actor).alias("actor"),
            F.lit(at).cast("timestamp").alias("created_at"), F.lit(reason).alias("reason"), "keys")
        self.audit.append(entry)

    def read(self, version: str | None = None) -> DataFrame:
        """The rows of one version, or of all."""
        rows = self.spark.read.parquet(f"{self.path}/rows").filter("__row").drop("__row")
        return rows if version is None else rows.filter(F.col(VERSION) == version)

    def current(self, preferred: Sequence[str]) -> DataFrame:
        """For each key the rows of the first version in ``preferred`` that was run for it."""
        ranks = F.element_at(F.create_map(*[F.lit(x) for pair in enumerate(preferred) for x in reversed(pair)]),
                             F.col(VERSION))
        asked = F.col(VERSION).isin(list(preferred))
        chosen = self.spark.read.parquet(f"{self.path}/keys").filter(asked).groupBy(self.key).agg(
            F.min(ranks).alias("__rank"))
        return lookup(self.read().filter(asked), chosen, [self.key], "inner").filter(
            ranks == F.col("__rank")).drop("__rank")


def rules_version(policy: Policy) -> str:
    return f"{policy.materiality.version},{policy.lifecycle.version}"


def reprocess_events(spark: SparkSession, store: Store, policy: Policy, actor: str, at: str, reason: str) -> Versions:
    """All events of a store's snapshots under other rules, as a version beside the stored events."""
    history = store.read(spark, "snapshots").drop("run_degraded")
    if policy.assess_health:
        history = health.mark_degraded(history, health.assess(health.run_counts(history), policy.health))
    else:
        history = history.withColumn("run_degraded", F.lit(False))
    versions = Versions(spark, f"{store.root}/reprocessed_events", "listing_id")
    version = rules_version(policy)
    # Written down between steps: each plan stays small, and a lost executor repeats one step.
    stage = f"{store.root}/_stage/reprocess"

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{stage}/{name}")
        return spark.read.schema(df.schema).parquet(f"{stage}/{name}")

    changes = staged(diffs.field_diffs(diffs.with_previous(history, policy.predecessor), policy.materiality), "diffs")
    rows = staged(lifecycle.lifecycle_rows(history, policy.lifecycle), "rows")
    found = run_events(history, changes, rows, None, policy).withColumnRenamed(VERSION, "event_rule_version")
    versions.put(version, staged(found, "events"), history.select("listing_id"), actor, at, reason)
    return versions
