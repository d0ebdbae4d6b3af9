"""Substring de-duplication over sliding spans of sentences.

A text is cut into sentences, and these into clauses after every word whose hash is the least
of some ``WINDOW`` words in a row of the sentence, so a clause begins at a place that only the
words around it choose.  From the begin of every sentence and clause a span runs on over the
sentences that follow until it has ``LEAST`` words, and is named by a 128-bit hash of them.
Of any ``WINDOW`` + ``LEAST`` words that two texts share, ``WINDOW`` at most lie before a begin
that both texts have, so both have that span, wherever the passage begins and ends and
whatever stands around it; and nothing goes that is not part of ``LEAST`` repeated words.

Spans meet by name over the whole corpus.  The first occurrence, by doc_id, then text, then
place, stays; the words that any other occurrence covers are removed, with the white space
after them.

The spans of a text are stored as one row, so texts are cut once.  A count over the first
64 bits, combined before the shuffle, leaves only spans that may repeat for the join on
whole names.  Both aggregates are stored before they are joined: AQE splits a name in a third of
all texts in a join of two tables, but not where an aggregate shares the join's exchange.

Defined cases: null text is empty and stays empty; texts with fewer words than a span has none
and stay whole; rows that repeat id and text are one occurrence and get the same answer; a
null doc_id sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ROWS, arrow_map, same_key, stored, whole_text

LEAST, WINDOW = 40, 8

_STOP = re.compile(r"[.!?][^\w\s]*\s+|\n\s*")
_WORD = re.compile(r"\S+")


def begins(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, where each begins and at last the end of the text, words that begin a sentence or
    clause)."""
    found = list(_WORD.finditer(text))
    words = [m.group() for m in found]
    at = np.array([m.start() for m in found] + [len(text)], np.int64)
    n = len(words)
    if not n:
        return words, at, np.zeros(0, np.int64)
    sentence = np.searchsorted(np.array([m.end() for m in _STOP.finditer(text)], np.int64), at[:-1], "right")
    first = np.concatenate(([True], sentence[1:] != sentence[:-1]))
    if n >= WINDOW:
        hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint32)
        windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
        whole = np.flatnonzero(sentence[:n - WINDOW + 1] == sentence[WINDOW - 1:])
        # The least hash of each window, the last one of equals; the clause begins after it.
        least = whole + WINDOW - 1 - np.argmin(windows[whole, ::-1], axis=1)
        first[least[least + 1 < n] + 1] = True
    return words, at, np.flatnonzero(first)


def spans(text: str, least: int = LEAST) -> list[tuple[int, int, bytes]]:
    """(begin, end, name) of every span, in code points; a span ends where the next word begins."""
    words, at, first = begins(text)
    return [(int(at[i]), int(at[i + least]), xxhash.xxh3_128_digest(
        " ".join(words[i:i + least]).encode("utf-8", "surrogatepass")))
        for i in first[first + least <= len(words)]]


def span_table(docs: DataFrame) -> DataFrame:
    """One row per text: doc_id, text_key, begins, sizes and both halves of the names."""

    def body(batch):
        columns = [[], [], [], []]
        for text in batch.column("text").to_pylist():
            made = spans(text)
            name = np.frombuffer(b"".join(s[2] for s in made), "<i8").reshape(-1, 2)
            for column, values in zip(columns, (
                    [s[0] for s in made], [s[1] - s[0] for s in made], name[:, 0], name[:, 1])):
                column.append(values)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"),
             *[pa.array(c, t) for c, t in zip(columns, (ints, ints, longs, longs))]],
            ["doc_id", "text_key", "begins", "sizes", "high", "low"])

    return arrow_map(docs, body, "doc_id long, text_key long, begins array<int>, sizes array<int>, "
                                 "high array<long>, low array<long>", ROWS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, begin, size): spans that are not the first of their name."""
    table = stored(span_table(docs), "spans")
    each = table.select("doc_id", "text_key", F.inline(F.arrays_zip(
        "high", "low", F.col("begins").alias("begin"), F.col("sizes").alias("size"))))
    often = table.select(F.explode("high").alias("high")).groupBy("high").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("high")
    likely = stored(each.join(stored(often, "frequent-spans"), "high"), "likely-spans")
    place = F.struct("doc_id", "text_key", "begin")
    firsts = likely.groupBy("high", "low").agg(F.min(place).alias("kept"), F.max(place).alias("last"))
    firsts = stored(firsts.filter(~F.col("kept").eqNullSafe(F.col("last"))).select(
        "high", "low", "kept"), "first-spans")
    return likely.join(firsts, ["high", "low"]).filter(~place.eqNullSafe(F.col("kept"))).select(
        "doc_id", "text_key", "begin", "size")


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges (begin, size) as (begin, end) that neither meet nor overlap."""
    holes: list[list[int]] = []
    for begin, size in sorted(ranges):
        if holes and begin <= holes[-1][1]:
            holes[-1][1] = max(holes[-1][1], begin + size)
        else:
            holes.append([begin, begin + size])
    return holes


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_removed (sentences and clauses that begin in removed
    words), removed (start:end in code points, comma-joined), clean_text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    gone = repeated_spans(texts).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("begin", "size")).alias("gone")).select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "gone")
    joined = texts.join(gone, same_key(texts, gone, {"text_key": "gone_key", "doc_id": "gone_id"}),
                        "left").select("doc_id", "text", "gone")

    def body(batch):
        rows = {"doc_id": batch.column("doc_id"), "n_removed": [], "removed": [], "clean_text": []}
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            holes = merged([(g["begin"], g["size"]) for g in gone or ()])
            n = 0
            if holes:
                _, at, first = begins(text)
                n = sum(int(((at[first] >= a) & (at[first] < b)).sum()) for a, b in holes)
            rows["n_removed"].append(n)
            rows["removed"].append(",".join(f"{a}:{b}" for a, b in holes))
            rows["clean_text"].append("".join(
                text[a:b] for (a, b) in zip([0, *(h[1] for h in holes)],
                                            [*(h[0] for h in holes), len(text)])))
        yield pa.RecordBatch.from_arrays(
            [rows["doc_id"], pa.array(rows["n_removed"], pa.int64()),
             pa.array(rows["removed"], pa.string()), pa.array(rows["clean_text"], pa.string())],
            list(rows))

    return arrow_map(joined, body, "doc_id long, n_removed long, removed string, clean_text string", ROWS)
