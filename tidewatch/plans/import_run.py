"""One import run from raw rows to events, each stage one DataFrame.

scan -> validate -> de-duplicate -> resolve -> snapshots -> predecessors -> diffs
     -> events + life cycle -> append

A run is replayable: every table is keyed, stored rows are left out before the
expensive stages, and all ids and event keys derive from content.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.config import Coverage, LifecycleRules, Materiality, RunHealth
from tidewatch.constants import IMPORT_PARSER_VERSION, SNAPSHOT_FIELDS
from tidewatch.operators import diffs, events, health, lifecycle, resolution, snapshots, validation
from tidewatch.operators.catalogue import latest_snapshots
from tidewatch.session import cut_lineage
from tidewatch.sinks.keyed import KeyedTable


@dataclass(frozen=True)
class Policy:
    """Rule sets and the behaviours that may be chosen per deployment."""

    materiality: Materiality = Materiality()
    lifecycle: LifecycleRules = LifecycleRules()
    health: RunHealth = RunHealth()
    coverage: Coverage = Coverage()
    predecessor: str = "snapshot"  # or "field"
    blank_means_null_when_active: bool = False
    assess_health: bool = False


@dataclass
class Store:
    """The tables of one dataset folder: append-only by key, and the states by listing."""

    root: str
    buckets: int = 64
    keys: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "rejections": ("run_id", "row_number", "position"),
        "import_metrics": ("run_id",),
        "runs": ("run_id", "dataset_id", "source_key"),
        "listings": ("listing_id",),
        "properties": ("property_id",),
        "aliases": ("dataset_id", "alias"),
        "snapshots": ("listing_id", "run_id"),
        "diffs": ("run_id", "snapshot_id", "field_name", "rule_version"),
        "events": ("dedupe_key",),
        "evidence": ("event_id",),
        "states": ("listing_id",),
    })

    def table(self, spark: SparkSession, name: str) -> KeyedTable:
        keys = self.keys[name]
        # A listing's snapshots share a bucket; its state is replaced, so needs no filter.
        return KeyedTable(spark, f"{self.root}/{name}", keys, keys[:1] if name == "snapshots" else None,
                          self.buckets, blooms=name != "states")

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        return self.table(spark, name).read()

    def append(self, **tables: DataFrame) -> None:
        """Insert into several tables at once: they are independent, and none fills the cluster."""
        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(lambda n: self.table(tables[n].sparkSession, n).append(tables[n]), tables))


def snapshots_of(accepted: DataFrame, dataset_id: str, run_id: str, policy: Policy) -> DataFrame:
    """Accepted rows as snapshots with deterministic ids."""
    keyed = resolution.listing_keys(accepted, dataset_id)
    seen = snapshots.observations_from_import(keyed, policy.blank_means_null_when_active)
    seen = seen.withColumns({
        "run_id": F.lit(run_id), "parser_version": F.lit(IMPORT_PARSER_VERSION),
        "snapshot_id": F.sha2(F.concat_ws("\u0001", "listing_id", F.lit(run_id)), 256),
    })
    return snapshots.build_snapshots(seen)


def heads(history: DataFrame, policy: Policy) -> DataFrame:
    """The snapshots that later ones are compared with: per listing and parser the newest of a
    healthy run, in field mode for each field the newest that collected it.  As many as there
    are fields at most, so a listing's heads stay small whatever its history."""
    healthy = ~F.coalesce(F.col("run_degraded"), F.lit(False))
    at = F.struct("observed_at", "snapshot_id")
    if policy.predecessor == "snapshot":
        conditions = [healthy]
    else:
        conditions = [healthy & F.coalesce(F.col("field_presence").getItem(name), F.lit(False))
                      for name, _ in SNAPSHOT_FIELDS]
    named = history.groupBy("listing_id", "parser_version").agg(F.array_distinct(F.array_compact(F.array(*[
        F.max(F.when(c, at)) for c in conditions]))).alias("ats"))
    chosen = named.select("listing_id", F.explode("ats.snapshot_id").alias("snapshot_id"))
    return history.join(chosen, ["listing_id", "snapshot_id"], "left_semi").select(*history.columns)


def new_states(history: DataFrame, rows: DataFrame, policy: Policy) -> DataFrame:
    """What a later run needs to go on: life-cycle state, time, heads and latest snapshot, one row
    per listing of ``rows``.  ``history`` holds the former heads and the new snapshots."""
    history = history.drop("is_fresh")
    columns = sorted(history.columns)
    kept = heads(history, policy).groupBy("listing_id").agg(
        F.collect_list(F.struct(*columns)).alias("heads"))
    latest = latest_snapshots(history).withColumnRenamed("last_observed_at", "latest_at")
    return lifecycle.lifecycle_state(rows).join(kept, "listing_id", "left").join(latest, "listing_id")


def run_events(fresh: DataFrame, changes: DataFrame, rows: DataFrame, known: DataFrame | None,
               policy: Policy) -> DataFrame:
    """The events of the ``fresh`` snapshots, their ``changes`` and their life-cycle ``rows``."""
    return events.all_events(
        events.creation_events(fresh, known, policy.materiality),
        events.field_events(changes),
        events.transition_events(rows, policy.lifecycle))


def continued(spark: SparkSession, store: Store, built: DataFrame, policy: Policy,
              counts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(history, life-cycle rows) of the run's listings; the run's own rows are ``is_fresh``.

    A listing whose new snapshots are all later than its state goes on from the state: one row
    is read, whatever its history.  The others (late files, a broken run done again) are folded
    anew from their stored snapshots, read from their buckets only.
    """
    built = built.withColumn("is_fresh", F.lit(True))
    old = F.lit(False).alias("is_fresh")
    ids = built.select("listing_id").distinct()
    prior = store.table(spark, "states").rows_for(ids)
    assessed = health.assess(counts, policy.health) if counts is not None else None

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("run_degraded", F.lit(False)) if assessed is None else (
            health.mark_degraded(df, assessed))

    if prior is None:
        fresh = marked(built)
        return fresh, lifecycle.lifecycle_rows(fresh, policy.lifecycle)
    first = built.groupBy("listing_id").agg(F.min("observed_at").alias("first_at"))
    late = first.join(prior.select("listing_id", "latest_at"), "listing_id").filter(
        F.col("first_at") <= F.col("latest_at")).select("listing_id")
    if assessed is not None:  # a run between older ones may change how later ones are judged
        runs = Window.partitionBy("dataset_id", "source_key").orderBy(F.desc("started_at"), F.desc("run_id"))
        newest = counts.withColumn("n", F.row_number().over(runs)).filter("n = 1").select("run_id").distinct()
        between = built.select("run_id").distinct().join(newest, "run_id", "left_anti")
        late = late.unionByName(ids.join(F.broadcast(between.limit(1)), F.lit(True), "left_semi")).distinct()
    late = cut_lineage(late)
    fresh = marked(built)
    if late.isEmpty():
        on_time, again = fresh, None
    else:
        on_time = fresh.join(late, "listing_id", "left_anti")
        prior = prior.join(late, "listing_id", "left_anti")
        snapshots_table = store.table(spark, "snapshots")
        stored = snapshots_table.read(buckets=snapshots_table.touched(
            late.withColumn("run_id", F.lit(None).cast("string"))))
        again = built.join(late, "listing_id", "left_semi")
        if stored is not None:
            again = again.unionByName(stored.join(late, "listing_id", "left_semi").select("*", old),
                                      allowMissingColumns=True)
        again = marked(again)
    rows = lifecycle.lifecycle_rows(on_time, policy.lifecycle, prior_state=prior)
    history = on_time.unionByName(prior.select(F.explode("heads").alias("h")).select("h.*", old),
                                  allowMissingColumns=True)
    if again is not None:
        rows = rows.unionByName(lifecycle.lifecycle_rows(again, policy.lifecycle), allowMissingColumns=True)
        history = history.unionByName(again, allowMissingColumns=True)
    return history, rows


def run_import(spark: SparkSession, raw: DataFrame, store: Store, dataset_id: str, run_id: str,
               approved_sources, policy: Policy = Policy()) -> None:
    """Import one batch of raw rows (text columns, row_number) into the store.

    Stage results that several later stages need are read back from their table
    instead of being recomputed.
    """
    stage = f"{store.root}/_stage/{run_id}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{stage}/{name}")
        return spark.read.schema(df.schema).parquet(f"{stage}/{name}")

    classified = staged(validation.process_import(raw, approved_sources, policy.coverage), "classified")
    tag = F.lit(run_id).alias("run_id")
    store.append(rejections=validation.rejection_rows(classified).select("*", tag),
                 import_metrics=validation.import_metrics(classified).select("*", tag))

    accepted = validation.accepted_rows(classified)
    built = store.table(spark, "snapshots").only_new(
        snapshots.one_per_run(snapshots_of(accepted, dataset_id, run_id, policy)))
    built = staged(built.drop("row_number", "source_url", "region", "canonical_property_key"), "snapshots")

    keyed = resolution.listing_keys(accepted, dataset_id)
    listings = store.table(spark, "listings")
    known = listings.rows_for(built.select("listing_id"))
    fresh = resolution.new_listings(keyed, known)
    wanted = fresh.filter(F.col("canonical_property_key").isNotNull()).select(
        "dataset_id", F.col("canonical_property_key").alias("alias"))
    aliases = store.table(spark, "aliases").rows_for(wanted)
    if aliases is None:
        aliases = spark.createDataFrame([], "dataset_id string, alias string, property_id string")
    resolved = staged(resolution.resolve_properties(fresh, aliases), "listings")

    counts = None
    if policy.assess_health:
        counts = health.run_counts(built)
        stored_counts = store.read(spark, "runs")
        if stored_counts is not None:
            counts = counts.unionByName(stored_counts.select(*counts.columns)).groupBy(
                "dataset_id", "source_key", "run_id").agg(
                F.min("started_at").alias("started_at"),
                *[F.sum(c).alias(c) for c in ("total", "valid", "errors", "blocked")])
        counts = staged(counts, "runs")
    history, rows = continued(spark, store, built, policy, counts)
    rows, history = staged(rows, "rows"), staged(history, "history")
    paired = diffs.with_previous(history, policy.predecessor).filter("is_fresh")
    changes = staged(diffs.field_diffs(paired, policy.materiality), "diffs")
    found = staged(run_events(history.filter("is_fresh"), changes, rows.filter("is_fresh"), known, policy), "events")
    owners = resolved.select("listing_id", "property_id")
    if known is not None:
        owners = owners.unionByName(known.select("listing_id", "property_id")).dropDuplicates(["listing_id"])
    properties = resolution.new_properties(resolved)
    store.append(
        diffs=changes, evidence=events.evidence_table(found),
        events=events.event_table(found, dataset_id, owners), properties=properties,
        aliases=resolution.new_aliases(properties),
        listings=resolved.withColumn("first_seen_at", F.col("observed_at")))
    store.table(spark, "states").upsert(new_states(history, rows, policy))
    # Snapshots last: their presence marks the run as done, so a broken run is redone whole; what
    # it left in the states makes its listings late, and they are folded anew.
    store.append(snapshots=built.withColumn("observed_date", F.to_date("observed_at")))
    if counts is not None:
        store.table(spark, "runs").upsert(counts.filter(F.col("run_id") == run_id))


def listing_states(spark: SparkSession, store: Store) -> DataFrame:
    """Current life-cycle projection of every listing, as its last run left it."""
    owner = store.read(spark, "listings").select("listing_id", "property_id", "external_id")
    return owner.join(store.read(spark, "states").drop("heads", "latest_at"), "listing_id")
