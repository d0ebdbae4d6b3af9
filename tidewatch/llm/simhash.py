"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints at ``REACH`` or fewer differing bits are linked.  The 64 bits are dealt into
m groups, correlated bits together, so that what is alike in most texts is spent in few
groups and the others tell texts apart.  If group g is searched with radius t_g (-1: not at
all) and the radii add up to REACH - m + 1, every link is met in some group.  A dynamic
programme picks the radii, and the search over m the number of groups, with the least
probes plus estimated candidates; the estimates come from value counts over all
fingerprints and steer only the cost.  Each distinct fingerprint probes the index of group
values and candidates are verified bit by bit.

A fingerprint that would meet more than ``CROWD`` candidates (a large family of near
copies) is not probed but linked exactly through midpoints: two fingerprints are at two or
fewer bits just when some value is at one or none from both, so each writes its 65 near
values and those that share one are joined to the least of them.  Both ways are complete,
so the work stays linear whatever the size of a family.

Defined cases: null and wordless texts have fingerprint zero and link like any other;
fewer than three words are one shingle; equal fingerprints are one node, so copies are never
expanded into pairs; component_id is the least non-null doc_id reachable (null if none);
repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import ROWS, arrow_fold, arrow_map, same_key, stored, whole_text
from tidewatch.llm.components import components

BITS, REACH, WORDS, CROWD, BLOCK = 64, 2, 3, 65, 8

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(data: bytes) -> int:
    """SimHash of one text in UTF-8."""
    words = data.translate(_LOWER).split()  # bytes split at exactly \x20 \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= WORDS:
        return _hash(line)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], stop[:-1] + 1))[: len(words) - WORDS + 1]
    stop = stop[WORDS - 1:]
    hashes = np.fromiter((_hash(line[a:b]) for a, b in zip(start.tolist(), stop.tolist())),
                         np.uint64, len(stop))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):  # bounds memory for very long texts
        part = hashes[i:i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def body(batch):
        texts = pc.cast(batch.column("text"), pa.binary()).to_pylist()
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())],
                                         ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                 whole_text().alias("text")), body, "doc_id long, fp long", ROWS)


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(fps: DataFrame, count, cells: int) -> np.ndarray:
    """Counts of a fixed number of cells over all fingerprints, added up by Spark."""

    def body(batches):
        n = np.zeros(cells, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += count(_bits(batch))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())],
                                         ["cell", "n"])

    out = np.zeros(cells)
    for row in arrow_fold(fps, body, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[row[0]] = row[1]
    return out


def correlated_groups(fps: DataFrame, m: int, together: np.ndarray, total: int) -> list[list[int]]:
    """Deal the bits into m groups of near equal size, correlated bits together."""
    p = np.diag(together) / total
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs(together / total - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = len(left) // (m - g)
        seed = max(sorted(left), key=lambda b: sum(alike[b, x] for x in left))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: sum(alike[b, x] for x in group))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _distances() -> np.ndarray:
    v = np.arange(1 << BLOCK)
    return np.array([bin(x).count("1") for x in range(1 << BLOCK)])[v[:, None] ^ v[None, :]]


def estimates(fps: DataFrame, groups: list[list[int]], total: int) -> list[list[float]]:
    """Expected candidates of a probe in each group at radius 0..REACH.

    Value counts of blocks of 8 bits give each block's exact distance distribution over all
    pairs; those of a group's blocks are convolved.
    """
    blocks = [g[i:i + BLOCK] for g in groups for i in range(0, len(g), BLOCK)]
    size = 1 << BLOCK

    def count(bits):
        weights = 1 << np.arange(BLOCK)
        return np.concatenate([
            np.bincount(bits[:, b].astype(np.int64) @ weights[: len(b)], minlength=size)
            for b in blocks])

    counts = _summed(fps, count, size * len(blocks)).reshape(len(blocks), size) / total
    apart, out, at = _distances(), [], 0
    for g in groups:
        spread = np.array([1.0])
        for _ in range(0, len(g), BLOCK):
            both = np.outer(counts[at], counts[at])
            own = np.array([both[apart == d].sum() for d in range(REACH + 1)])
            spread = np.convolve(spread, own)[: REACH + 1]
            at += 1
        out.append((np.cumsum(spread) * total).tolist())
    return out


def _ball(width: int, radius: int) -> int:
    return sum(len(list(combinations(range(width), r))) for r in range(radius + 1))


def allocate(widths: list[int], expected: list[list[float]], reach: int = REACH):
    """(cost, radii): the radii, adding up to reach - m + 1, with the least probes plus
    expected candidates.  ``best[s]`` is the cheapest way to use s + groups so far."""
    best = {0: (0.0, ())}
    for width, candidates in zip(widths, expected):
        step = {}
        for used, (cost, radii) in best.items():
            for r in range(-1, reach + 1):
                c = cost + (0 if r < 0 else _ball(width, r) + candidates[r])
                if used + r + 1 <= reach + 1 and c < step.get(used + r + 1, (np.inf,))[0]:
                    step[used + r + 1] = (c, (*radii, r))
        best = step
    return best[reach + 1]


def plan(fps: DataFrame) -> tuple[list[list[int]], tuple[int, ...]]:
    """Groups of bits and their radii, with the least cost over one to REACH + 1 groups."""
    total = max(fps.count(), 1)
    together = _summed(fps, lambda bits: (bits.T.astype(np.float32) @ bits).astype(np.int64).ravel(),
                       BITS * BITS).reshape(BITS, BITS)
    options = []
    for m in range(1, REACH + 2):
        groups = correlated_groups(fps, m, together, total)
        cost, radii = allocate([len(g) for g in groups], estimates(fps, groups, total))
        options.append((cost, m, groups, radii))
    _, _, groups, radii = min(options)
    return groups, radii


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(fps: DataFrame, groups: list[list[int]], radii: tuple[int, ...],
          crowd: int = CROWD) -> DataFrame:
    """(u, v) that connect all linked distinct fingerprints; not every link is listed."""
    used = [(i, g, r) for i, (g, r) in enumerate(zip(groups, radii)) if r >= 0]
    index = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key"))
        for i, g, _ in used])).alias("at")).select("fp", "at.part", "at.key")
    flips = fps.sparkSession.createDataFrame(
        [(i, _mask(c)) for i, g, r in used for d in range(r + 1) for c in combinations(g, d)],
        "part int, flip long")  # at most 2081 rows
    probes = index.join(F.broadcast(flips), "part").select(
        "fp", "part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    buckets = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    sized = probes.join(buckets, ["part", "key"])
    load = F.sum("n").over(Window.partitionBy("fp"))  # a fingerprint has at most 2081 probes
    sized = stored(sized.withColumn("crowded", load > crowd).drop("n"), "probes")
    found = sized.filter(~F.col("crowded")).join(
        index.withColumnRenamed("fp", "other"), ["part", "key"]).filter(
        (F.col("fp") != F.col("other"))
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= REACH)).select(
        F.col("fp").alias("u"), F.col("other").alias("v"))
    near = sized.filter("crowded").select("fp").distinct().select("fp", F.explode(F.array(
        F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS)])).alias("z"))
    # At most 65 fingerprints are within one bit of a value.
    least = F.min("fp").over(Window.partitionBy("z"))
    stars = near.select(F.col("fp").alias("u"), least.alias("v")).filter("u <> v").distinct()
    return found.union(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    marked = stored(fingerprints(docs), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    fps = nodes.select("fp")
    groups, radii = plan(fps)
    parts = components(links(fps, groups, radii))
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = named.join(ids, "component").select(F.col("fp").alias("class_fp"), "component_id")
    return marked.join(classes, same_key(marked, classes, {"fp": "class_fp"})).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
