"""Ranked lexical search, hybrid of term-at-a-time and document-at-a-time.

One pass over whole texts writes a forward index: for each document its length and its
counts of the query terms.  Corpus statistics (N, L, df) are aggregates of that table.  Each
task then turns batches of the index into segments, lists of postings per term in document
order, and answers every query on a segment:

* *Term at a time*: the short lists (terms in at most SHORT of the documents) are added up
  into accumulators, one sorted list of (document, sum).
* *Document at a time*: the accumulators count as one more iterator whose bound is their
  greatest sum.  Iterators are ordered by bound.  While the bounds of the least ones add up
  to less than the tenth best score so far, these cannot lift a document by themselves, so
  only documents of the others are visited, window by window; in the skipped lists their
  places are found by binary search, greatest bound first, and a document is given up as
  soon as what it can still gain is too little.  Sums of the accumulators are lower bounds of
  scores, so they set the first threshold.

Skipping uses exact bounds and never drops a tie, so results equal those of scoring all.
Each task keeps ten documents per query; those of all tasks meet in two rounds, first
within even parts of the tasks, so no group grows with the corpus.

Queries are read in blocks of about BLOCK_TERMS terms, chosen by a hash and counted; a block's
terms and their statistics are what is broadcast.

Defined cases: null texts have no terms; a query without terms has no result; query rows equal
in id and text are one query, other rows are queries of their own; repeated document rows are
documents of their own and equal in rank order, null ids last; tables may be empty; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import ROWS, arrow_fold, arrow_map, stored

TOP = 10
SHORT = 1 / 16  # share of the documents up to which a term's list is a short one
WINDOW = 2048  # documents of a segment visited at a time
BLOCK_TERMS = 200_000
PARTS = 64  # groups of tasks whose best documents meet first
NO_ID = np.iinfo(np.int64).max  # stands for a null id inside a task; ids are compared with it last

# Bytes below 0x80 that belong to no term become spaces, A-Z become a-z; split() does the rest.
_TERM = bytearray(b" " * 128) + bytearray(range(128, 256))
for _byte in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _TERM[_byte] = _byte
for _byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TERM[_byte] = _byte + 32
TERM_TABLE = bytes(_TERM)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_TABLE).split()


@dataclass(frozen=True)
class Query:
    """``terms`` are (term number, repeats)."""

    number: int
    terms: tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Statistics:
    documents: int
    length: int
    weights: np.ndarray  # by term number
    short: np.ndarray    # by term number: its list is a short one


# --- the index ---------------------------------------------------------------

def forward_index(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): only query terms are listed, n counts all terms."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def body(batch):
        look = known.value.get
        sizes, at, terms, counts = [], [0], [], []
        for text in pc.cast(batch.column("text"), pa.binary()).to_pylist():
            found = terms_of(text) if text else []
            sizes.append(len(found))
            tally = Counter(map(look, found))
            tally.pop(None, None)
            terms.extend(tally.keys())
            counts.extend(tally.values())
            at.append(len(terms))
        at = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
             pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
            ["doc_id", "n", "terms", "counts"])

    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    index = stored(arrow_map(view, body, "doc_id long, n long, terms array<int>, counts array<long>",
                             ROWS), "forward-index")
    known.destroy()
    return index


def statistics(index: DataFrame, terms: int) -> Statistics:
    """N, L and one weight per query term: as many numbers as the block of queries has terms."""
    total = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = np.zeros(terms, np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[row["term"]] = row["count"]
    weights = [math.floor(1000 * math.log((2 * total.N + 2) / (2 * int(d) + 1))) for d in df]
    return Statistics(total.N, total.L, np.array(weights, np.int64), df <= SHORT * total.N)


# --- one segment ------------------------------------------------------------

class Segment:
    """Postings of one batch: per term its documents in order and what it adds to their scores."""

    def __init__(self, batch: pa.RecordBatch, facts: Statistics):
        ids = batch.column("doc_id")
        self.doc_ids = pc.fill_null(ids, int(NO_ID)).to_numpy(zero_copy_only=False)
        self.is_null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        lists = batch.column("terms")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        docs = np.repeat(np.arange(batch.num_rows), sizes)
        terms = lists.flatten().to_numpy(zero_copy_only=False)
        tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        m = 100 - 75 + (75 * n * facts.documents) // max(facts.length, 1)
        adds = facts.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        order = np.argsort(terms, kind="stable")
        terms, self.docs, self.adds = terms[order], docs[order], adds[order]
        names, starts = np.unique(terms, return_index=True)
        self.places = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(terms)])))
        self.rows = batch.num_rows

    def list_of(self, term: int, repeats: int) -> tuple[np.ndarray, np.ndarray] | None:
        if term not in self.places:
            return None
        a, b = self.places[term]
        return self.docs[a:b], self.adds[a:b] * repeats


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the sum of several lists as one list."""
    docs, where = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, where, np.concatenate([s for _, s in lists]))
    return docs, sums


def tenth(sums: np.ndarray, top: int) -> int:
    """A lower bound of the last score that counts: 0 while there are fewer."""
    return int(np.partition(sums, len(sums) - top)[len(sums) - top]) if len(sums) >= top else 0


class Best:
    """The best documents of one query so far, worst first.  Equal scores: least id first, nulls last."""

    def __init__(self, top: int = TOP):
        self.top, self.heap = top, []

    @property
    def threshold(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        if len(scores) > self.top:  # within one window only its best can stay
            keep = np.lexsort((ids, nulls, -scores))[: self.top]
            scores, ids, nulls = scores[keep], ids[keep], nulls[keep]
        for score, doc, null in zip(scores.tolist(), ids.tolist(), nulls.tolist()):
            entry = (score, not null, -doc)
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def search(segment: Segment, query: Query, short: np.ndarray, best: Best, window: int = WINDOW) -> int:
    """Add the segment's documents to the query's best; returns how many were scored in full."""
    few, iterators = [], []
    for term, repeats in query.terms:
        postings = segment.list_of(term, repeats)
        if postings is not None:
            (few if short[term] else iterators).append(postings)
    lower = 0
    if few:
        summed = accumulate(few)
        lower = tenth(summed[1], best.top)
        iterators.append(summed)
    if not iterators:
        return 0
    bounds = np.array([int(adds.max()) for _, adds in iterators])
    order = np.argsort(bounds, kind="stable")
    iterators, bounds = [iterators[k] for k in order], bounds[order]
    below = np.cumsum(bounds)  # what the least k + 1 iterators can add together
    cuts = np.arange(0, segment.rows + window, window)
    ends = [np.searchsorted(docs, cuts) for docs, _ in iterators]
    scored = 0
    for step in range(len(cuts) - 1):
        floor = max(best.threshold, lower)
        first = int(np.searchsorted(below, floor, side="left"))  # iterators before it never suffice
        if first == len(iterators):
            return scored  # not even all of them together
        base = cuts[step]
        sums = np.zeros(window, np.int64)
        seen = np.zeros(window, bool)
        for k in range(first, len(iterators)):
            a, b = ends[k][step], ends[k][step + 1]
            at = iterators[k][0][a:b] - base
            sums[at] += iterators[k][1][a:b]
            seen[at] = True
        at = np.flatnonzero(seen)
        got = sums[at]
        for k in range(first - 1, -1, -1):
            going = got + below[k] >= floor
            at, got = at[going], got[going]
            docs, adds = iterators[k]
            a, b = ends[k][step], ends[k][step + 1]
            if not len(at) or a == b:
                continue
            place = a + np.searchsorted(docs[a:b], at + base)
            held = (place < b) & (docs[np.minimum(place, b - 1)] == at + base)
            got = got + np.where(held, adds[np.minimum(place, b - 1)], 0)
        going = got >= floor
        at, got = at[going] + base, got[going]
        scored += len(at)
        best.offer(got, segment.doc_ids[at], segment.is_null[at])
    return scored


# --- all queries ------------------------------------------------------------

def best_of_tasks(index: DataFrame, queries: list[Query], facts: Statistics, top: int) -> DataFrame:
    """(query, doc_id, score, part): each task's best."""
    shared = index.sparkSession.sparkContext.broadcast((queries, facts))

    def body(batches):
        asked, stats = shared.value
        best = {q.number: Best(top) for q in asked}
        for batch in batches:
            if batch.num_rows:
                segment = Segment(batch, stats)
                for query in asked:
                    search(segment, query, stats.short, best[query.number])
        rows = [(number, -doc if known else None, score)
                for number, found in best.items() for score, known, doc in found.heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64())], ["query", "doc_id", "score"])

    found = stored(arrow_fold(index, body, "query int, doc_id long, score long").withColumn(
        "part", F.spark_partition_id() % PARTS), "best-of-tasks")
    shared.destroy()
    return found


def merged(found: DataFrame, top: int) -> DataFrame:
    """The best of all tasks, with their rank."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    within = F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))
    some = found.withColumn("rank", within).filter(F.col("rank") <= top)
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return some.withColumn("rank", ranked).filter(F.col("rank") <= top)


def query_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS):
    """Lists of (item_id, terms of the text), each of about ``block_terms`` terms."""
    counted = stored(items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
                     .withColumn("size", F.coalesce(F.length("text"), F.lit(0)) + 1), "queries")
    # A text has at most half as many terms as characters, and one.
    blocks = -(-(counted.agg(F.sum("size")).first()[0] or 0) // (2 * block_terms))
    for k in range(blocks):
        rows = counted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if rows:
            yield [(r.item_id, terms_of((r.text or "").encode())) for r in rows]


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per item its best documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    answers = []
    for block in query_blocks(items, block_terms):
        words: dict[bytes, int] = {}
        queries = []
        for number, (_, found) in enumerate(block):
            tally = Counter(words.setdefault(w, len(words)) for w in found)
            queries.append(Query(number, tuple(tally.items())))
        index = forward_index(docs, words)
        facts = statistics(index, len(words))
        best = merged(best_of_tasks(index, queries, facts, top), top)
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)],
                                      f"query int, item_id {id_type}")
        # Both sides of this join are bounded by the block.
        answers.append(best.join(F.broadcast(names), "query").select(
            "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not answers:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
