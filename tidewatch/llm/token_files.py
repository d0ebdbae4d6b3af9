"""Token ids in ORC files.

Texts are dealt into ranges of doc_id, sorted, encoded and written as ORC: integers are
run-length encoded by the writer, each stripe has row indexes with minima and maxima, and
doc_id has a Bloom filter, so a reader of some documents skips files, stripes and row groups by
metadata and readers of everything take stripes in parallel.  Each row keeps its place
within its range; the place in the whole is that plus the sums of the ranges before, one
number per range.

Defined cases: null text is empty and leaves the end id alone; a null doc_id sorts first;
rows that repeat a doc_id are told apart by a hash of their text, and equal rows keep any
order, which changes nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import returning, slices, small_batches, table_path, whole_text
from tidewatch.llm.tokens import encoder, tokenizer_file

END = 1
ROWS = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
OPTIONS = {
    "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(32 << 20), "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))

    def run(batches):
        flat, part, at = encoder(json.value).flat, TaskContext.get().partitionId(), 0
        for batch in (part for whole in batches for part in slices(whole)):
            ids, stops = flat(batch.column("text").to_pylist())
            ids = np.insert(ids, stops[1:], end).astype(np.int32)
            sizes = np.diff(stops) + 1
            stops = np.cumsum(sizes)
            # A list column holds at most 2**31 ids; Spark's batch is far below that.
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part), pa.int32()), batch.column("doc_id"),
                 pa.array(stops - sizes + at, pa.int64()), pa.array(sizes), lists],
                ["part", "doc_id", "local_start", "n_tokens", "ids"])
            at += int(stops[-1]) if len(stops) else 0

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(returning(run), ROWS).write.options(**OPTIONS).orc(path)
    json.destroy()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("ids")
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            stops = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))))
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(stops[:-1], stops[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("local_start"),
                 pa.array(np.diff(stops), pa.int64()), pa.array(crc, pa.int64())],
                ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = small_batches(read_tokens(spark, path))
    # One row per range: sums of the ranges before.
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = files.select("part", "doc_id", "local_start", "ids").mapInArrow(
        returning(run), "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def tokens_in_files(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = END) -> DataFrame:
    path = path or table_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end)
    return token_digests(docs.sparkSession, path)
