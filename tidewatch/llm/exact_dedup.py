"""Exact de-duplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes meets a condition, so equal
passages cut alike wherever they stand.  A chunk is named by a 128-bit hash, and the
naming is verified on the corpus: all distinct chunk contents meet once, grouped by
(name, content), and a name with two contents makes the whole naming be done again with
the next seed.  With a verified naming two texts are equal exactly when their ordered
lists of names are, so documents are compared by short recipes and long texts never move
whole; chunk contents move once, after each task has merged its own repeats.

Defined cases: null text is the empty text, whose recipe is empty; the doc_id of the row
that stays is the least non-null one (null if the group has none); rows that repeat both
id and text are in one group and all carry ``kept``; an empty table gives no rows; other
columns of the input are never looked at.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ROWS, SPACE, arrow_map, same_key, stored, whole_text

WINDOW_STEPS = 5  # doublings: the rolling hash sees 2**5 bytes
AVERAGE = 2048  # bytes of a chunk, a power of two
LONGEST = 65536

RECIPE = "doc_id long, text_sha256 string, recipe binary"


def _roll(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes that end at each position (fewer at the start)."""
    value = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    value ^= value >> np.uint32(15)
    for step in range(WINDOW_STEPS):
        width = 1 << step
        factor = np.uint32(pow(0x01000193, width, 1 << 32))
        longer = value.copy()
        longer[width:] += value[:-width] * factor if len(value) > width else 0
        value = longer
    return value


def cuts(data: bytes, average: int = AVERAGE, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of one text; they depend on its content only."""
    if not data:
        return []
    rolled = _roll(np.frombuffer(data, np.uint8))
    mixed = rolled ^ (rolled >> np.uint32(13))
    ends = np.flatnonzero((mixed & np.uint32(average - 1)) == 0) + 1
    out, last = [], 0
    for end in [*ends.tolist(), len(data)]:
        while end - last > longest:
            last += longest
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def chunk_name(chunk: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed=seed)


def _normal(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.regexp_replace(whole_text(), SPACE, " ").alias("text"))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pc.cast(batch.column("text"), pa.binary()).to_pylist()


def chunks(texts: DataFrame, seed: int, name=chunk_name) -> DataFrame:
    """Distinct (name, content) of each batch."""

    def body(batch):
        found = set()
        for data in _texts(batch):
            last = 0
            for end in cuts(data):
                found.add(data[last:end])
                last = end
        content = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name(c, seed) for c in content], pa.binary()),
             pa.array(content, pa.binary())], ["name", "content"])

    return arrow_map(texts, body, "name binary, content binary", ROWS)


def recipes(texts: DataFrame, seed: int, name=chunk_name) -> DataFrame:
    """(doc_id, text_sha256, recipe): the names of a text's chunks in order, joined."""

    def body(batch):
        data = _texts(batch)
        made = []
        for text in data:
            ends = cuts(text)
            made.append(b"".join(name(text[a:b], seed) for a, b in zip([0, *ends], ends)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"),
             pa.array([hashlib.sha256(t).hexdigest() for t in data], pa.string()),
             pa.array(made, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return arrow_map(texts, body, RECIPE, ROWS)


def is_verified(texts: DataFrame, seed: int, name=chunk_name) -> bool:
    """No name stands for two contents.  Contents meet in the shuffle, nothing is collected."""
    distinct = chunks(texts, seed, name).distinct()
    return distinct.groupBy("name").count().filter("count > 1").isEmpty()


def deduplicate(docs: DataFrame, name=chunk_name) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = _normal(docs)
    seed = next(s for s in itertools.count() if is_verified(texts, s, name))
    # Names have one length, so joined lists are equal exactly when the lists are.
    listed = stored(recipes(texts, seed, name), "recipes")
    groups = listed.groupBy(F.col("recipe").alias("group_recipe")).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A recipe shared by a third of all rows is one skewed key of this join, which AQE splits.
    return listed.join(groups, same_key(listed, groups, {"recipe": "group_recipe"})).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
