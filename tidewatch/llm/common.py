"""Helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs read columns of a plain
    table, so a lost executor costs no recomputation of what lies before."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Have Spark cut Arrow batches at BATCH_BYTES, unless the session asks for less: both
    sides hold whole batches, and texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def forget_pieces() -> None:
    """Give up the token tables this reused worker holds; other operators need the room."""
    tokens = sys.modules.get("tidewatch.llm.tokens")
    if tokens is not None:
        tokens.encoders.clear()


def give_back() -> None:
    """Return what a task has freed to the system: reused workers would keep it, and their sum
    grows from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not the GNU library


def returning(body: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``body`` for mapInArrow, giving memory back when the task's rows are out."""
    def run(batches):
        try:
            yield from body(batches)
        finally:
            give_back()

    return run


ROWS = 256  # texts that are Python objects at once


def slices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def arrow_map(df: DataFrame, body: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
              schema: str, rows: int | None = None) -> DataFrame:
    """Run ``body`` on each Arrow batch, or on slices of ``rows`` rows of it.  Spark bounds a
    batch by rows and by bytes; slices keep few of its texts as Python objects."""

    def run(batches):
        forget_pieces()
        for batch in batches:
            if batch.num_rows:
                for part in slices(batch, rows or batch.num_rows):
                    yield from body(part)

    return small_batches(df).mapInArrow(returning(run), schema)


def arrow_fold(df: DataFrame, body: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """Run ``body`` once for all batches of a task, for sums of a fixed size."""
    def run(batches):
        forget_pieces()
        yield from body(batches)

    return small_batches(df).mapInArrow(returning(run), schema)


def same_key(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of key columns, left name to right name."""
    condition = F.lit(True)
    for a, b in keys.items():
        condition = condition & left[a].eqNullSafe(right[b])
    return condition
