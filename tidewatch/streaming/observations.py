"""Observation streams: file source, life cycle with stored state, event sink, run health.

Life-cycle batches are folded by the same DataFrame operators as a batch job, from a keyed table of
states: a batch reads and rewrites the buckets of its own listings, so it costs the same
however many batches came before.  Events are de-duplicated in the stream by a watermark on
their arrival and then by key in the sink, so a replayed or late file adds nothing.  Run health is
judged inside the stream: a run's counts are state, and a timer closes the run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.config import LifecycleRules, RunHealth
from tidewatch.operators.lifecycle import lifecycle_rows, lifecycle_state
from tidewatch.sinks.keyed import KeyedTable

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("listing_id", T.StringType()),
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("observation_status", T.StringType()),
    T.StructField("high_confidence_not_found", T.BooleanType()),
    T.StructField("run_degraded", T.BooleanType()),
])


def observation_files(spark: SparkSession, path: str, schema: T.StructType = OBSERVATION_SCHEMA,
                      files_per_batch: int = 100) -> DataFrame:
    """A folder of parquet observation files as a stream."""
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_batch).parquet(path)


# --- life cycle and events ----------------------------------------------------------

def state_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/states", ["listing_id"], blooms=False)


def event_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/events", ["dedupe_key"])


def write_lifecycle(observations: DataFrame, path: str, checkpoint: str,
                    rules: LifecycleRules = LifecycleRules()):
    """Life-cycle rows under ``path``/rows and the states of touched listings in ``path``/states.

    Batches must arrive in event-time order; inside one batch any order works.  A batch that is run
    again sees the states before its own commit and overwrites its rows.
    """
    def sink(batch: DataFrame, number: int) -> None:
        spark, tag = batch.sparkSession, f"batch-{number}"
        states = state_table(spark, path)
        prior = states.rows_for(batch.select("listing_id"), before=states.number_for(tag))
        target = f"{path}/rows/batch={number}"
        lifecycle_rows(batch, rules, prior_state=prior).write.mode("overwrite").parquet(target)
        states.upsert(lifecycle_state(spark.read.parquet(target)), tag=tag)

    return observations.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def event_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_lifecycle`` that raise an event, as a stream."""
    schema = spark.read.parquet(f"{path}/rows").schema
    return spark.readStream.schema(schema).parquet(f"{path}/rows").filter(F.col("event_type").isNotNull())


def write_events(events: DataFrame, path: str, checkpoint: str, remembered: str = "1 hour"):
    """Each dedupe_key once, under ``path``/events.

    State keeps the keys that arrived within ``remembered``.  Arrival is the time of the batch, which only
    grows, so no row is too late for the watermark however old the event is; keys that came
    before that are found in the table.
    """
    arrived = events.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", remembered)
    once = arrived.dropDuplicatesWithinWatermark(["dedupe_key"]).drop("arrived_at")

    def sink(batch: DataFrame, number: int) -> None:
        event_table(batch.sparkSession, path).append(batch, tag=f"batch-{number}")

    return once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


# --- run health -----------------------------------------------------------------

RUN_KEYS = ["dataset_id", "source_key"]
PARTIAL = ("dataset_id string, source_key string, run_id string, first_at timestamp, last_at timestamp, "
           "total long, valid long, errors long, blocked long")
RUN_STATE = ("first_at timestamp, last_at timestamp, total long, valid long, errors long, blocked long, "
             "closed boolean")
HEALTH = ("dataset_id string, source_key string, run_id string, started_at timestamp, total long, valid long, "
          "errors long, blocked long, previous_valid long, reasons array<string>, degraded boolean")
REMEMBERED = dt.timedelta(days=30)  # how long a judged run is known, to leave its late rows out
COUNTS = ("total", "valid", "errors", "blocked")


def partial_counts(observations: DataFrame) -> DataFrame:
    """Counts per run of each Arrow batch, without a shuffle: what meets in the state of one source
    is a few rows per task, not its observations.  A row without run_id is a heartbeat of its source
    and moves time on."""
    def body(batches):
        for batch in batches:
            status = batch.column("observation_status")
            of = lambda *names: pc.cast(pc.fill_null(pc.is_in(status, pa.array(names)), False), pa.int64())
            run = batch.column("run_id")
            here = pc.cast(pc.is_valid(run), pa.int64())
            bad = of("source_error", "blocked", "unknown")
            table = pa.table({
                **{k: batch.column(k) for k in (*RUN_KEYS, "run_id")}, "at": batch.column("observed_at"),
                "total": here, "valid": pc.subtract(here, pc.multiply(here, bad)), "errors": of("source_error"),
                "blocked": of("blocked")})
            found = table.group_by([*RUN_KEYS, "run_id"]).aggregate(
                [("at", "min"), ("at", "max"), *[(c, "sum") for c in COUNTS]])
            names = [*RUN_KEYS, "run_id", "at_min", "at_max", *[f"{c}_sum" for c in COUNTS]]
            yield from found.select(names).rename_columns(
                [f.split()[0] for f in PARTIAL.split(", ")]).to_batches()

    return observations.select(*[F.col(k).cast("string") for k in (*RUN_KEYS, "run_id")], "observed_at",
                               "observation_status").mapInArrow(body, PARTIAL)


class RunHealthProcessor(StatefulProcessor):
    """Counts of the open runs of one source; judges a run when ``quiet`` has passed since its last row.

    A run is compared with the full run that started before it, so closed runs wait until all that
    started earlier are closed too.  Rows of a run that was judged already are not counted again.
    """

    def __init__(self, rules: RunHealth, quiet: dt.timedelta):
        self.rules, self.quiet = rules, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run_id string", RUN_STATE)
        self.judged = handle.getMapState("judged", "run_id string", "last_at timestamp")
        self.previous = handle.getValueState("previous", "valid long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.run_id is None or self.judged.containsKey((r.run_id,)):
                    continue
                first, last, counts = r.first_at, r.last_at, [int(getattr(r, c)) for c in COUNTS]
                if self.runs.containsKey((r.run_id,)):
                    had = self.runs.getValue((r.run_id,))
                    first, last = min(first, pd.Timestamp(had[0])), max(last, pd.Timestamp(had[1]))
                    counts = [a + int(b) for a, b in zip(counts, had[2:6])]
                self.runs.updateValue((r.run_id,), (first, last, *counts, False))
                self.handle.registerTimer(_millis(last + self.quiet))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for run_id, _, state in sorted(
                ((k[0], v[0], v) for k, v in self.runs.iterator()), key=lambda e: (e[1], e[0])):
            if _millis(pd.Timestamp(state[1]) + self.quiet) > now:
                break  # a run that started earlier is still open
            out.append((*key, run_id, state[0], *map(int, state[2:6]), *self._judge(state)))
            self.runs.removeKey((run_id,))
            self.judged.updateValue((run_id,), (state[1],))
            self.previous.update((int(state[3]),))
        for run_id, last in [(k[0], v[0]) for k, v in self.judged.iterator()]:
            if _millis(pd.Timestamp(last) + REMEMBERED) < now:
                self.judged.removeKey((run_id,))
        columns = [f.split()[0] for f in HEALTH.split(", ")]
        if out:
            yield pd.DataFrame(out, columns=columns)

    def _judge(self, state) -> tuple[int | None, list[str], bool]:
        total, valid, errors, blocked = map(int, state[2:6])
        previous = int(self.previous.get()[0]) if self.previous.exists() else None
        reasons = []
        if previous and valid / previous < self.rules.min_valid_ratio:
            reasons.append("valid_observation_drop")
        if total and errors / total > self.rules.max_error_rate:
            reasons.append("source_error_spike")
        if total and blocked / total > self.rules.max_blocked_rate:
            reasons.append("blocked_spike")
        return previous, reasons, bool(reasons)

    def close(self) -> None:
        pass


def _millis(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


def health_stream(observations: DataFrame, rules: RunHealth = RunHealth(), quiet: dt.timedelta = dt.timedelta(hours=6),
                  delay: str = "0 seconds") -> DataFrame:
    """Health of each run as soon as it is closed: a stream of HEALTH rows in append mode.

    Needs the RocksDB state store.  Rows later than the watermark allows are left out, as are rows of
    runs that were judged.
    """
    counted = partial_counts(observations).withWatermark("last_at", delay)
    return counted.groupBy(*RUN_KEYS).transformWithStateInPandas(
        statefulProcessor=RunHealthProcessor(rules, quiet), outputStructType=HEALTH,
        outputMode="append", timeMode="eventtime")


def write_run_health(observations: DataFrame, path: str, checkpoint: str, rules: RunHealth = RunHealth(),
                     quiet: dt.timedelta = dt.timedelta(hours=6), delay: str = "0 seconds"):
    """Append the health rows to parquet files under ``path``."""
    observations.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return health_stream(observations, rules, quiet, delay).writeStream.format("parquet").outputMode(
        "append").option("path", path).option("checkpointLocation", checkpoint)
