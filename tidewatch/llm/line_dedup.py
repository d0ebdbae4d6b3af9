"""Line de-duplication by probing sharded minimal perfect hash tables.

A line's key is hashed to 128 bits.  Spark counts for each hash the documents that hold it.
Hashes of at least MEMBER_DOCS documents are dealt by their leading bits into shards of about
SHARD_KEYS, and one task per shard builds a minimal perfect hash over them: levels of bits, a
hash sits in the first level where no other falls on its bit, and the number of bits set
before it is its place in two plain arrays, a 64-bit fingerprint and a document count.  A hash of
a single document, by far the most common kind, is in no array; it meets some place of its
shard, where the fingerprint tells it apart (the chance that any of 10^12 such lines slips through is
below 10^-6).

Documents probe the arrays, lines are never joined.  While all arrays together have at most
BROADCAST_BYTES (their exact size is counted), they are broadcast, and whole texts pass through
one map.  Beyond that, each document sends its distinct hashes of 16 bytes to the shards: a
task meets the arrays of one shard and streams probes past them; a shard with many probes is cut into
(shard, salt) cells of about CELL_PROBES, so a line that a third of all documents hold lands in
many tasks.  What they find goes back to the documents by (doc_id, 128-bit hash of the text).

Defined cases: null and empty texts are one empty line, which has no key and stays; keys are
compared as bytes, so composed and decomposed letters differ; each row is a document of its own,
also where ids or texts repeat or ids are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ROWS, arrow_fold, arrow_map, slices, small_batches, stored

MIN_DOCS = 10
MEMBER_DOCS = 2
SHARD_KEYS = 1 << 18
GAMMA = 2.0  # bits of a level per hash it is offered
BROADCAST_BYTES = 32 << 20
CELL_PROBES = 1 << 20
BROADCAST_SHARDS = 500_000
STRIPPED = b" \t\n\x0b\x0c\r"

HASH = np.dtype([("high", "<u8"), ("low", "<u8")])


# --- lines and their hashes -----------------------------------------------------

def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = text.split(b"\n")
    return lines, [line.strip(STRIPPED).lower() for line in lines]


def hash_keys(keys: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) for k in keys]), HASH)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]


def document_counts(docs: DataFrame) -> DataFrame:
    """(high, low, documents) of every distinct line hash; repeats of a batch merge before they move."""

    def body(batch):
        tally: Counter[bytes] = Counter()
        for text in _texts(batch):
            tally.update(set(line_keys(text)[1]))
        del tally[b""]
        hashes = hash_keys(list(tally))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes[half].astype(np.uint64).view(np.int64)) for half in HASH.names]
            + [pa.array(list(tally.values()), pa.int64())], ["high", "low", "n"])

    found = arrow_map(docs.select(F.col("text").cast("string")), body, "high long, low long, n long", 8 * ROWS)
    return found.groupBy("high", "low").agg(F.sum("n").alias("documents"))


# --- one shard --------------------------------------------------------------

def _spot(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each hash in a level, from both halves and the level."""
    mixed = high + low * np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    return (mixed % np.uint64(size)).astype(np.int64)


class Shard:
    """A minimal perfect hash with the fingerprints and counts it indexes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.words, self.prints, self.counts = sizes, words, prints, counts
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones  # bits set before each word
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> Shard:
        sizes, levels = [], []
        rest = np.arange(len(high))
        while len(rest):
            size = -(-max(64, int(GAMMA * len(rest))) // 64) * 64
            at = _spot(high[rest], low[rest], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        shard = cls(np.array(sizes, np.int64), bits.view("<u8"), np.zeros(len(high), "<u8"),
                    np.zeros(len(high), "<u4"))
        place = shard.places(high, low)
        shard.prints[place] = low
        shard.counts[place] = np.minimum(counts, 2**32 - 1)
        return shard

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Place of each hash: a bijection for members, anything or -1 for others."""
        place = np.full(len(high), -1, np.int64)
        rest = np.arange(len(high))
        for level, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            if not len(rest):
                break
            at = start + _spot(high[rest], low[rest], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            held = (word >> bit) & np.uint64(1) == 1
            lower = word & ((np.uint64(1) << bit) - np.uint64(1))
            place[rest[held]] = (self.before[at >> 6] + np.bitwise_count(lower))[held]
            rest = rest[~held]
        return place

    def probe(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Documents that hold each hash; 0 for hashes that are no members."""
        place = self.places(high, low)
        if not len(self.prints):
            return np.zeros(len(high), np.int64)
        found = (place >= 0) & (self.prints[place] == low)
        return np.where(found, self.counts[place], 0).astype(np.int64)

    def row(self) -> list[bytes]:
        return [a.tobytes() for a in (self.sizes, self.words, self.prints, self.counts)]

    @classmethod
    def from_row(cls, sizes: bytes, words: bytes, prints: bytes, counts: bytes) -> Shard:
        return cls(*(np.frombuffer(b, t) for b, t in zip((sizes, words, prints, counts), ("<i8", "<u8", "<u8", "<u4"))))


SHARD_ROW = "shard int, sizes binary, words binary, prints binary, counts binary"
ARRAYS = ("sizes", "words", "prints", "counts")


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high >> np.uint64(32)).astype(np.int64) * shards >> 32


def _shard_column(shards: int):
    return F.shiftright(F.shiftrightunsigned("high", 32) * shards, 32).cast("int")


def build_shards(members: DataFrame, shards: int) -> DataFrame:
    """One row of arrays per shard.  A task holds one shard's hashes at a time."""

    def body(batches):
        current, parts = None, []

        def done():
            high, low, n = (np.concatenate(c) for c in zip(*parts))
            row = Shard.build(high.view("<u8"), low.view("<u8"), n).row()
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), *[pa.array([a], pa.binary()) for a in row]],
                ["shard", *ARRAYS])

        for batch in batches:
            names = batch.column("shard").to_numpy(zero_copy_only=False)
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low", "documents")]
            edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if parts and names[a] != current:
                    yield done()
                    parts = []
                current = int(names[a])
                parts.append([c[a:b] for c in columns])
        if parts:
            yield done()

    dealt = members.withColumn("shard", _shard_column(shards)).repartition(shards, "shard")
    return arrow_fold(dealt.sortWithinPartitions("shard"), body, SHARD_ROW)


# --- probing ----------------------------------------------------------------

def probe_all(tables: dict[int, Shard], shards: int, hashes: np.ndarray) -> np.ndarray:
    high, low = np.ascontiguousarray(hashes["high"]), np.ascontiguousarray(hashes["low"])
    which = shard_of(high, shards)
    counts = np.zeros(len(hashes), np.int64)
    for shard in np.unique(which).tolist():
        if shard in tables:
            mine = np.flatnonzero(which == shard)
            counts[mine] = tables[shard].probe(high[mine], low[mine])
    return counts


KEPT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def _kept(batch: pa.RecordBatch, lines: list[list[bytes]], often: Iterator[bool], with_text: bool):
    """Rows of ``KEPT``; ``often`` says of each line in turn whether it goes."""
    texts, dropped = [], []
    for some in lines:
        stay = [line for line in some if not next(often)]
        texts.append(b"\n".join(stay))
        dropped.append(len(some) - len(stay))
    columns = [batch.column("doc_id"), pa.array([len(s) for s in lines], pa.int64()),
               pa.array(dropped, pa.int64()),
               pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
    if with_text:
        columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in KEPT.split(", ")][: len(columns)])


def _schema(with_text: bool) -> str:
    return KEPT if with_text else KEPT.rsplit(", ", 1)[0]


def drop_by_broadcast(docs: DataFrame, tables: DataFrame, shards: int, min_docs: int,
                      with_text: bool) -> DataFrame:
    rows = {r.shard: [bytes(r[a]) for a in ARRAYS] for r in tables.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    opened: dict[int, Shard] = {}

    def body(batch):
        if not opened:
            opened.update((k, Shard.from_row(*row)) for k, row in shared.value.items())
        lines, keys = zip(*map(line_keys, _texts(batch)))
        flat = [k for some in keys for k in some]
        counts = probe_all(opened, shards, hash_keys(flat))
        often = [n >= min_docs and bool(k) for n, k in zip(counts.tolist(), flat)]
        yield _kept(batch, lines, iter(often), with_text)

    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return arrow_map(view, body, _schema(with_text), ROWS)


def cells(members: DataFrame, shards: int) -> DataFrame:
    """(shard, salts): into how many cells each shard's probes are dealt, from exact counts."""
    probes = members.groupBy(_shard_column(shards).alias("shard")).agg(F.sum("documents").alias("n"))
    return probes.select("shard", F.ceil(F.col("n") / CELL_PROBES).cast("int").alias("salts"))


def drop_by_shuffle(docs: DataFrame, tables: DataFrame, members: DataFrame, shards: int,
                    min_docs: int, with_text: bool) -> DataFrame:
    """As ``drop_by_broadcast`` for arrays of any size."""
    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"),
                       F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_md5"))

    def send(batch):
        ids, marks = batch.column("doc_id"), batch.column("text_md5")
        owner, where, packed = [], [], []
        sent = set()
        keys_of = zip(ids.to_pylist(), marks.to_pylist())
        for k, (text, key) in enumerate(zip(_texts(batch), keys_of)):
            if key in sent:
                continue
            sent.add(key)
            hashes = hash_keys(list({key for key in line_keys(text)[1] if key}))
            which = shard_of(hashes["high"], shards)
            order = np.argsort(which, kind="stable")
            names, starts = np.unique(which[order], return_index=True)
            for name, part in zip(names.tolist(), np.split(hashes[order], starts[1:])):
                owner.append(k)
                where.append(name)
                packed.append(part.tobytes())
        owner = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.take(owner), marks.take(owner), pa.array(where, pa.int32()), pa.array(packed, pa.binary())],
            ["doc_id", "text_md5", "shard", "hashes"])

    probes = arrow_map(view, send, "doc_id long, text_md5 string, shard int, hashes binary", ROWS)
    salted = stored(cells(members, shards), "line-cells")
    if shards <= BROADCAST_SHARDS:  # one row of two numbers each
        salted = F.broadcast(salted)
    probes = probes.join(salted, "shard").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "text_md5"), F.col("salts"))).drop("salts")
    copies = tables.join(salted, "shard").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - F.lit(1).cast("long")))).drop("salts")
    met = copies.unionByName(probes, allowMissingColumns=True)

    def meet(batches):
        table = None
        for batch in batches:
            for part in slices(batch):
                found = []
                for row in part.to_pylist():
                    if row["sizes"] is not None:
                        table = Shard.from_row(*(row[a] for a in ARRAYS))
                        continue
                    hashes = np.frombuffer(row["hashes"], HASH)
                    n = table.probe(np.ascontiguousarray(hashes["high"]), np.ascontiguousarray(hashes["low"]))
                    if (n >= min_docs).any():
                        found.append((row["doc_id"], row["text_md5"], hashes[n >= min_docs].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
                     pa.array([f[2] for f in found], pa.binary())], ["doc_id", "text_md5", "often"])

    spread = met.repartition("shard", "salt").sortWithinPartitions(
        "shard", "salt", F.col("sizes").isNull())
    hits = small_batches(spread).mapInArrow(meet, "doc_id long, text_md5 string, often binary")
    # Equal rows send equal probes, so distinct hits of a key are its hits.
    hits = stored(hits.groupBy("doc_id", "text_md5").agg(F.collect_set("often").alias("often")), "line-hits")
    hits = hits.withColumnsRenamed({"doc_id": "hit_id", "text_md5": "hit_md5"})
    joined = view.join(hits, view["doc_id"].eqNullSafe(hits["hit_id"])
                       & (view["text_md5"] == hits["hit_md5"]), "left").select("doc_id", "text", "often")

    def drop(batch):
        lines, often = [], []
        for text, hit in zip(_texts(batch), batch.column("often").to_pylist()):
            some, keys = line_keys(text)
            lines.append(some)
            gone = {part[i:i + 16] for part in hit or () for i in range(0, len(part), 16)}
            often.extend(bool(k) and bool(gone) and xxhash.xxh3_128_digest(k) in gone for k in keys)
        yield _kept(batch, lines, iter(often), with_text)

    return arrow_map(joined, drop, _schema(with_text), ROWS)


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, with_text: bool = True,
                        broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Documents without the lines that at least ``min_docs`` documents hold.

    One row per document: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept_text.
    """
    least = min(MEMBER_DOCS, min_docs)
    members = stored(document_counts(docs).filter(F.col("documents") >= least), "line-counts")
    shards = max(1, -(-members.count() // shard_keys))
    tables = stored(build_shards(members, shards), "line-shards")
    size = tables.agg(F.sum(sum((F.octet_length(a) for a in ARRAYS), F.lit(0)))).first()[0] or 0
    if size <= broadcast_bytes:
        return drop_by_broadcast(docs, tables, shards, min_docs, with_text)
    return drop_by_shuffle(docs, tables, members, shards, min_docs, with_text)
