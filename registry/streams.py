"""The given events as a stream of several micro-batches; twins are the batch results."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from registry import query
from registry.lifecycle import HEALTH_SQL, fold_sql
from registry.tables import OBS_SQL
from tidewatch.session import checkpoint_dir
from tidewatch.streaming import observations as streams

LEAST_BATCHES, BATCH_ROWS = 3, 5_000_000


def _folder(t) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def _streamed(t, start, folder, heartbeat=False):
    """Hand the observations to the stream range of time by range of time; every range is
    written by many tasks, is one batch, and goes on from the checkpoint of those before."""
    rows = t.observations.withColumns({"dataset_id": F.lit("d1"), "source_key": F.lit("events")})
    low, high, n = rows.agg(F.min("observed_at"), F.max("observed_at"), F.count(F.lit(1))).first()
    batches = max(LEAST_BATCHES, -(-n // BATCH_ROWS)) if n else 0
    for k in range(batches):
        at = F.floor((F.unix_micros("observed_at") - F.unix_micros(F.lit(low)))
                     * batches / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1))
        rows.filter(at == k).write.mode("append").option("maxRecordsPerFile", BATCH_ROWS).parquet(f"{folder}/in")
        _run(start(_stream(t, folder, rows)))
    if heartbeat and n:  # the source is silent for long, which closes its last run
        last = t.spark.createDataFrame([("d1", "events", high + dt.timedelta(days=30))],
                                       "dataset_id string, source_key string, observed_at timestamp")
        last.select(*[(F.col(c) if c in last.columns else F.lit(None)).cast(kind).alias(c) for c, kind in rows.dtypes]
                    ).write.mode("append").parquet(f"{folder}/in")
        _run(start(_stream(t, folder, rows)))


def _stream(t, folder, rows):
    return streams.observation_files(t.spark, f"{folder}/in", rows.schema, files_per_batch=1_000_000)


def _lifecycle(t, folder):
    _streamed(t, lambda s: streams.write_lifecycle(s, f"{folder}/out", f"{folder}/checkpoint"), folder)


@query("stream_lifecycle", "WITH " + fold_sql(OBS_SQL)
       + "SELECT snapshot_id, status, previous_status, CAST(m AS BIGINT) AS consecutive_misses, seq AS transition_sequence FROM life")
def stream_lifecycle(t):
    folder = _folder(t)
    _lifecycle(t, folder)
    return t.spark.read.parquet(f"{folder}/out/rows").select(
        "snapshot_id", "status", "previous_status", "consecutive_misses", "transition_sequence")


@query("stream_events", "WITH " + fold_sql(OBS_SQL)
       + "SELECT DISTINCT dedupe_key, event_type, listing_id FROM transitions")
def stream_events(t):
    folder = _folder(t)
    _lifecycle(t, folder)
    out = f"{folder}/out"
    for again in ("events-checkpoint", "events-replayed"):  # a new checkpoint replays all rows
        _run(streams.write_events(streams.event_rows(t.spark, out), out, f"{folder}/{again}"))
    return streams.event_table(t.spark, out).read().select("dedupe_key", "event_type", "listing_id")


@query("stream_run_health", f"""WITH {OBS_SQL}, {HEALTH_SQL}
SELECT run_id, CAST(total AS BIGINT) AS total, CAST(valid AS BIGINT) AS valid, reasons,
  reasons <> '' AS degraded FROM health""")
def stream_run_health(t):
    folder = _folder(t)
    _streamed(t, lambda s: streams.write_run_health(s, f"{folder}/out", f"{folder}/checkpoint"), folder, heartbeat=True)
    return t.spark.read.parquet(f"{folder}/out").select(
        "run_id", "total", "valid", F.array_join("reasons", ",").alias("reasons"), "degraded")
