"""Keyed tables: rows dealt into buckets by key, read and rewritten only where a key may be.

A commit writes its rows as ``data/<id>/__bucket=<n>`` and then a manifest, the whole list of live
file groups; that list is what readers see, so a broken commit leaves nothing behind.  A group
(one bucket of one commit) has the least and greatest value of each key column in the manifest
and, in an *append* table, a Bloom filter of its keys beside the data.

* ``append`` inserts keys that are absent.  Groups whose value ranges miss the new rows, or whose
  Bloom filter denies all new keys of their bucket, are not read.
* ``upsert`` reads the buckets of the new rows, merges, and writes these buckets only.
* Commits are numbered and may carry a tag; a commit of a known tag replaces that commit and sees the
  table as it was before it, so a failed micro-batch is simply done again (and so are those after it).

The manifest has one row per live group, about as many as Spark lists files for the table; it is
kept on the driver as a file listing is.  ``keep`` manifests stay readable, ``vacuum`` deletes
groups none of them names.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
KEEP = 20
BITS_PER_KEY, PROBES = 24, 9  # about one false hit in 100 000 keys
BUCKET, HASH = "__bucket", "__hash"


class Group(NamedTuple):
    """One bucket of one commit."""

    number: int
    id: str
    bucket: int
    rows: int
    low: list[str | None]
    high: list[str | None]


# --- Bloom filters ---------------------------------------------------------------

def _spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each 64-bit hash, one row per probe."""
    h = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    step = (h * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(bits) for k in range(PROBES)])


def bloom_of(hashes: np.ndarray) -> bytes:
    bits = -(-max(64, BITS_PER_KEY * len(hashes)) // 8) * 8
    held = np.zeros(bits, bool)
    held[_spots(hashes, bits).ravel()] = True
    return np.packbits(held, bitorder="little").tobytes()


def may_hold(bloom: bytes, hashes: np.ndarray) -> bool:
    """False only if none of the hashes is in the filter."""
    words = np.frombuffer(bloom, np.uint8)
    open_ = hashes
    for probe in range(PROBES):
        at = _spots(open_, 8 * len(words))[probe]
        open_ = open_[(words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        if not len(open_):
            return False
    return True


def _by_bucket(batches, columns):
    """(bucket, columns) of each run of rows with one bucket; rows come sorted by bucket."""
    for batch in batches:
        names = batch.column(BUCKET).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield int(names[a]), [batch.column(c).slice(a, b - a) for c in columns]


def _blooms(batches):
    """One filter per bucket."""
    def row(bucket, parts):
        bits = bloom_of(np.concatenate(parts))
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([bits], pa.binary())],
                                          ["bucket", "bits"])

    current, parts = None, []
    for bucket, (hashes,) in _by_bucket(batches, [HASH]):
        if parts and bucket != current:
            yield row(current, parts)
            parts = []
        current = bucket
        parts.append(hashes.to_numpy(zero_copy_only=False))
    if parts:
        yield row(current, parts)


def _hits(batches):
    """Groups that may hold a key: a bucket's filters come first, then its keys."""
    current, filters, found = None, {}, []
    for bucket, (ids, bits, hashes) in _by_bucket(batches, ["id", "bits", HASH]):
        if bucket != current:
            current, filters = bucket, {}
        rows = hashes.is_null().to_pylist()
        split = rows.index(False) if False in rows else len(rows)
        filters.update(zip(ids.slice(0, split).to_pylist(), bits.slice(0, split).to_pylist()))
        keys = hashes.slice(split).to_numpy(zero_copy_only=False).astype(np.int64)
        for name in [n for n, b in filters.items() if len(keys) and may_hold(b, keys)]:
            found.append((name, bucket))
            del filters[name]
    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                      pa.array([f[1] for f in found], pa.int32())], ["id", "bucket"])


# --- the table ------------------------------------------------------------------

class KeyedTable:
    """``bucket_by`` names the key columns that choose the bucket (all keys unless given)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str],
                 bucket_by: Sequence[str] | None = None, buckets: int = BUCKETS, blooms: bool = True):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.bucket_by, self.blooms, self._asked = list(bucket_by or keys), blooms, buckets
        self._known: dict[int, dict] = {}

    # Files.
    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def _folder(self, group: Group) -> str:
        return f"{self.path}/data/{group.id}/{BUCKET}={group.bucket}"

    # The manifest: how many buckets, the kept commits, the live groups.
    def commits(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifest") if n[0].isdigit()]

    def _manifest(self, number: int | None) -> dict:
        if number is None:
            return {"buckets": self._asked, "commits": [], "groups": []}
        if number not in self._known:
            fs, p = self._at(f"manifest/{number:012d}.json")
            stream = fs.open(p)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self._known[number] = json.loads(text)
        return self._known[number]

    def _put_manifest(self, number: int, content: dict) -> None:
        """Written aside and renamed, so readers see a whole manifest or none."""
        fs, aside = self._at(f"manifest/_{uuid.uuid4().hex}")
        _, place = self._at(f"manifest/{number:012d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        fs.delete(place, False)
        if not fs.rename(aside, place):
            raise OSError(f"cannot put {place} in place")
        self._known[number] = content

    def _newest(self, before: int | None = None) -> int | None:
        return max((n for n in self.commits() if before is None or n < before), default=None)

    def groups(self, before: int | None = None) -> list[Group]:
        """Live groups, of the newest commit or of the newest before a number."""
        return [Group(*g) for g in self._manifest(self._newest(before))["groups"]]

    def number_for(self, tag: str | None) -> int:
        """The number of the commit with this tag, or the next one."""
        newest = self._newest()
        known = [n for n, t in self._manifest(newest)["commits"] if tag is not None and t == tag]
        return max(known) if known else 0 if newest is None else newest + 1

    def buckets(self) -> int:
        return self._manifest(self._newest())["buckets"]

    # Keys.
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.bucket_by]),
                      F.lit(self.buckets())).cast("int").alias(BUCKET)

    def _hash(self) -> Column:
        return F.xxhash64(F.lit(7), *[F.col(k).cast("string") for k in self.keys]).alias(HASH)

    # Reading.
    def _read(self, groups: Sequence[Group]) -> DataFrame | None:
        if not groups:
            return None
        # Older groups may lack columns that came later.
        ids = {g.id for g in groups}
        reader = self.spark.read.option("mergeSchema", str(len(ids) > 1).lower())
        return reader.parquet(*[self._folder(g) for g in groups])

    def read(self, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None while it has no rows."""
        return self._read([g for g in self.groups(before) if buckets is None or g.bucket in set(buckets)])

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets of the keys of ``df``."""
        return [r[0] for r in df.select(self.bucket()).distinct().collect()]

    def groups_for(self, df: DataFrame, before: int | None = None) -> list[Group]:
        """Groups that may hold a key of ``df``."""
        groups = self.groups(before)
        if not groups:
            return []
        text = [F.col(k).cast("string") for k in self.keys]
        ranges = df.select(self.bucket(), *[c.alias(f"k{i}") for i, c in enumerate(text)]).groupBy(BUCKET).agg(
            F.array(*[F.min(f"k{i}") for i in range(len(text))]).alias("low"),
            F.array(*[F.max(f"k{i}") for i in range(len(text))]).alias("high")).collect()
        wanted = {r[BUCKET]: r for r in ranges}

        def overlap(g: Group) -> bool:
            r = wanted.get(g.bucket)
            return r is not None and all(
                None in (a, b, c, d) or (a <= d and c <= b)
                for a, b, c, d in zip(g.low, g.high, r.low, r.high))

        groups = [g for g in groups if overlap(g)]
        if not groups or not self.blooms:
            return groups
        named = self.spark.createDataFrame([(g.id, g.bucket) for g in groups], f"id string, {BUCKET} int")
        filters = self.spark.read.parquet(*[f"{self.path}/bloom/{i}" for i in {g.id for g in groups}])
        filters = filters.withColumnRenamed("bucket", BUCKET).join(named, ["id", BUCKET])
        keys = df.select(self.bucket(), self._hash()).distinct()
        met = filters.unionByName(keys, allowMissingColumns=True).repartition(BUCKET).sortWithinPartitions(
            BUCKET, F.col(HASH).isNotNull())
        hits = {tuple(r) for r in met.select(BUCKET, "id", "bits", HASH).mapInArrow(
            _hits, "id string, bucket int").collect()}
        return [g for g in groups if (g.id, g.bucket) in hits]

    def rows_for(self, df: DataFrame, before: int | None = None) -> DataFrame | None:
        """Stored rows whose keys occur in ``df``, read from the groups that may hold them."""
        stored = self._read(self.groups_for(df, before))
        return None if stored is None else stored.join(df.select(*self.keys).distinct(), self.keys, "left_semi")

    def only_new(self, df: DataFrame, before: int | None = None) -> DataFrame:
        """One row per key that is not stored.  Duplicates combine before the shuffle."""
        unique = df.dropDuplicates(self.keys)
        stored = self._read(self.groups_for(df, before))
        return unique if stored is None else unique.join(stored.select(*self.keys), self.keys, "left_anti")

    # Writing.
    def _write(self, df: DataFrame, tag: str | None, number: int, kept: list[Group]) -> None:
        name, buckets, before = uuid.uuid4().hex, self.buckets(), self._manifest(self._newest(number))
        folder = f"{self.path}/data/{name}"
        # Rows of a file lie in key order, so readers skip row groups by their statistics.
        df.withColumn(BUCKET, self.bucket()).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys).write.partitionBy(
            BUCKET).parquet(folder)
        groups = []
        if any(n.startswith(BUCKET) for n in self._names(f"data/{name}")):
            written = self.spark.read.parquet(folder)
            text = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(self.keys)]
            names = [t.alias(f"k{i}") for i, t in enumerate(text)]
            low, high = (F.array(*[f(f"k{i}") for i in range(len(names))]) for f in (F.min, F.max))
            facts = written.select(BUCKET, *names).groupBy(BUCKET).agg(
                F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high")).collect()
            groups = [Group(number, name, r[BUCKET], r.n, r.low, r.high) for r in facts]
            if self.blooms:
                written.select(F.col(BUCKET).cast("int"), self._hash()).repartition(BUCKET).sortWithinPartitions(
                    BUCKET).mapInArrow(_blooms, "bucket int, bits binary").withColumn("id", F.lit(name)).write.parquet(
                    f"{self.path}/bloom/{name}")
        self._put_manifest(number, {
            "buckets": buckets, "commits": [(number, tag), *before["commits"][:KEEP - 1]],
            "groups": [*groups, *kept]})
        for old in self.commits()[:-KEEP]:
            self._delete(f"manifest/{old:012d}.json")

    def append(self, df: DataFrame, tag: str | None = None) -> int:
        """Insert if absent; returns the commit's number."""
        number = self.number_for(tag)
        self._write(self.only_new(df, number), tag, number, self.groups(number))
        return number

    def upsert(self, df: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
               tag: str | None = None) -> int:
        """Put one row per key of ``df`` in place of the stored one; ``merge`` (stored rows of the
        touched buckets, new rows) may combine them instead and must return all rows to keep."""
        number = self.number_for(tag)
        touched = set(self.touched(df))
        groups = self.groups(number)
        stored = self._read([g for g in groups if g.bucket in touched])
        if stored is not None and merge is not None:
            df = merge(stored, df)
        elif stored is not None:
            df = df.unionByName(stored.join(df.select(*self.keys), self.keys, "left_anti"), allowMissingColumns=True)
        self._write(df, tag, number, [g for g in groups if g.bucket not in touched])
        return number

    def compact(self, most: int = 16) -> None:
        """Write the buckets that consist of more than ``most`` groups as one group each."""
        groups = self.groups()
        count: dict[int, int] = {}
        for g in groups:
            count[g.bucket] = count.get(g.bucket, 0) + 1
        full = {b for b, n in count.items() if n > most}
        if full:
            stored = self._read([g for g in groups if g.bucket in full])
            self._write(stored, None, self.number_for(None), [g for g in groups if g.bucket not in full])

    def vacuum(self) -> None:
        """Delete data that no readable manifest names."""
        live = {(g[1], g[2]) for n in self.commits() for g in self._manifest(n)["groups"]}
        for name in self._names("data"):
            for part in self._names(f"data/{name}"):
                if part.startswith(BUCKET) and (name, int(part.split("=")[1])) not in live:
                    self._delete(f"data/{name}/{part}")
            if name not in {i for i, _ in live}:
                self._delete(f"data/{name}")
                self._delete(f"bloom/{name}")
