"""Packing documents into sequences of a fixed window.

Documents are encoded once.  Whole windows of a document are sequences by themselves; what
is left of each, shorter than a window, is packed.  The histogram of those lengths has
window - 1 cells whatever the corpus, so it is solved on the driver: all combinations of two
or three lengths that fill the window are the columns of a non-negative least squares
problem, coordinate descent finds how often to use each, and the counts are rounded
within what the histogram holds.  Pieces are matched to combinations in Spark by their
rank among pieces of their length.  Residual pieces are laid end to end, greedily filling one
window after the other and cut where a window ends, so only the last one may be padded.

Defined cases: null text is empty, and a document without ids is its end id alone; repeated
rows and rows without doc_id are packed like any other, each by itself; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import returning, slices, small_batches, stored, whole_text
from tidewatch.llm.tokens import encoder, tokenizer_file

WINDOW, END = 1024, 0
TOLERANCE = 1e-6  # least move of the solver, as a share of all pieces

PIECES = ("part int, local long, doc_id long, start long, length long, ids_crc32 long, "
          "doc_tokens long, ids binary")


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Whole windows and remainders of every document, as a stored table.  ``local`` counts the
    pieces of a length within the task ``part``; only remainders keep their ids."""
    spark = docs.sparkSession
    json = spark.sparkContext.broadcast(tokenizer_file(tokenizer))  # one vocabulary file
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches):
        encode, part, seen = encoder(json.value).encode, TaskContext.get().partitionId(), {}
        for batch in (part for whole in batches for part in slices(whole)):
            columns = [[] for _ in names]
            texts = batch.column("text").to_pylist()
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids += np.array([end], "<u4").tobytes()
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[start * 4:(start + window) * 4]
                    n = len(piece) // 4
                    local = seen.get(n, 0)
                    seen[n] = local + 1
                    row = (part, local, doc, start, n, zlib.crc32(piece), total,
                           None if n == window else piece)
                    for column, value in zip(columns, row):
                        column.append(value)
            types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names)

    made = stored(small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        whole_text().alias("text")).mapInArrow(returning(run), PIECES), "pieces")
    json.destroy()
    return made


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (a >= b >= c, c may be 0) that add up to the window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = True
    a = np.arange(1, window)[:, None]
    b = np.arange(1, window)[None, :]
    c = window - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    at = np.argwhere(fits) + 1
    rows = np.column_stack([at, window - at.sum(1)])
    return rows[have[rows].all(axis=1)]


def repeats(histogram: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Non-negative least squares: min |A x - histogram|, x >= 0, by coordinate descent on
    the coordinate whose move lowers the objective most, until no coordinate would move by half
    a piece or ``TOLERANCE`` of all pieces.  A counts lengths in combinations.

    A move changes at most three lengths, so only the combinations that hold one of them are
    looked at again."""
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    left = histogram.astype(float)
    left[0] = 0
    real = (rows > 0).astype(float)
    same_ab, same_bc = rows[:, 0] == rows[:, 1], (rows[:, 1] == rows[:, 2]) & (rows[:, 2] > 0)
    norm = real.sum(1) + 2.0 * same_ab + 2.0 * same_bc + 2.0 * (same_ab & same_bc)
    order = np.argsort(rows.T.ravel(), kind="stable")
    bounds = np.searchsorted(rows.T.ravel()[order], np.arange(len(histogram) + 1))
    holding = [order[a:b] % len(rows) for a, b in zip(bounds[:-1], bounds[1:])]
    root, least = np.sqrt(norm), max(0.5, TOLERANCE * float(left.sum()))
    move = np.maximum(left[rows].sum(1) / norm, -x)
    gain = np.abs(move) * root
    while True:
        j = int(np.argmax(gain))
        if abs(move[j]) < least:
            return x
        x[j] += move[j]
        np.subtract.at(left, rows[j], move[j] * real[j])
        again = np.concatenate([holding[v] for v in set(rows[j].tolist()) if v])
        move[again] = np.maximum(left[rows[again]].sum(1) / norm[again], -x[again])
        gain[again] = np.abs(move[again]) * root[again]


def plan(histogram: np.ndarray, window: int = WINDOW):
    """(slots, first residual sequence): slots are rows (length, from, to, sequence, offset,
    residual position or -1): the piece with a rank in [from, to) goes to ``sequence`` plus
    its rank less ``from``, or for residuals to a place on the line of residual windows."""
    rows = combinations(np.flatnonzero(histogram), window)
    x = repeats(histogram, rows)
    used = np.zeros(window + 1, np.int64)
    slots, sequence = [], 0
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        lengths = [int(v) for v in rows[j] if v]
        times = min(int(x[j] + 0.5), *(int(histogram[v] - used[v]) // lengths.count(v) for v in lengths))
        if times <= 0:
            continue
        offset = 0
        for v in lengths:
            slots.append((v, int(used[v]), int(used[v]) + times, sequence, offset, -1))
            used[v] += times
            offset += v
        sequence += times
    position = 0
    for v in range(window - 1, 0, -1):
        if histogram[v] > used[v]:
            slots.append((v, int(used[v]), int(histogram[v]), 0, 0, position))
            position += v * int(histogram[v] - used[v])
    return slots, sequence, position


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    made = pieces(docs, tokenizer, window, end)
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most window rows
        histogram[length] = n
    whole, histogram[window] = int(histogram[window]), 0
    slots, combined, line = plan(histogram, window)
    line_windows = -(-line // window)
    # Whole windows come last: they are slots of their own, one sequence each.
    slots.append((window, 0, whole, combined + line_windows, 0, -1))
    table = spark.createDataFrame(slots, "length long, lo long, hi long, seq long, off long, line long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    # The slot table has at most three rows per combination and one per length.
    placed = ranked.join(F.broadcast(table), "length").filter("rank >= lo and rank < hi")
    at = F.when(F.col("line") >= 0, F.col("line") + (F.col("rank") - F.col("lo")) * F.col("length"))
    placed = placed.withColumn("at", at).withColumn("room", F.lit(window) - F.col("at") % window)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sequence = F.when(F.col("line") < 0, F.col("seq") + F.col("rank") - F.col("lo")).otherwise(
        F.lit(combined) + F.floor(F.col("at") / window)).cast("long")
    offset = F.when(F.col("line") < 0, F.col("off")).otherwise(F.col("at") % window)
    crossing = (F.col("line") >= 0) & (F.col("room") < F.col("length"))
    laid = placed.withColumns({"sequence_id": sequence, "offset": offset})
    kept = laid.filter(~crossing).select(*columns)

    def halves(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cut, rest = row["room"] * 4, dict(row)
                out.append({**row, "length": row["room"], "ids_crc32": zlib.crc32(row["ids"][:cut])})
                rest["start"] += row["room"]
                rest["length"] -= row["room"]
                out.append({**rest, "ids_crc32": zlib.crc32(row["ids"][cut:]), "offset": 0,
                            "sequence_id": row["sequence_id"] + 1})
            yield pa.RecordBatch.from_pydict(
                {c: pa.array([r[c] for r in out], pa.int64()) for c in columns})

    cut = laid.filter(crossing).select(*columns, "room", "ids").mapInArrow(
        halves, ", ".join(f"{c} long" for c in columns))
    return kept.union(cut)
