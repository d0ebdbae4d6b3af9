"""Collections: grid, discoveries, checksums against brute force."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.operators import market


def fnv(lines):
    state = 0xCBF29CE484222325
    for unit in "\n".join(sorted(lines)).encode("utf-16-le").hex(" ", 2).split():
        low, high = int(unit[:2], 16), int(unit[2:], 16)
        state = ((state ^ low) * 0x100000001B3) % 2**64
        if high:
            state = ((state ^ high) * 0x100000001B3) % 2**64
    return f"{state:016x}"


def test_fnv_checksum_equals_sequential_hash(spark):
    rng = random.Random(3)
    markets = {"big": [f"{n}|4.{n % 10}|{rng.randint(0, 99)}|é{n}|日本" for n in range(400)],
               "small": ["1|4.5|3||IDR"], "pair": ["b|", "a|"]}
    rows = [(k, line) for k, lines in markets.items() for line in lines]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "collection_id string, fingerprint string")
    got = {r.collection_id: r.checksum for r in market.fnv_checksum(df, 5).collect()}
    assert got == {k: fnv(lines) for k, lines in markets.items()}


def test_checksum_ignores_order_and_sees_changes(spark):
    rows = [("c", f"{n}|x") for n in range(50)]
    of = lambda r: market.multiset_checksum(spark.createDataFrame(
        r, "g string, fingerprint string"), ["g"]).head().checksum
    assert of(rows) == of(rows[::-1]) != of(rows[:-1] + [("c", "49|y")])


def test_area_plan(spark):
    areas = market.market_areas(spark)
    cells = market.plan_cells(areas, ["ubud", "nowhere", "canggu"]).collect()
    assert [c.area_key for c in cells] == ["ubud"] * 9 + ["canggu"] * 4
    ubud = cells[0]
    assert (ubud.south, ubud.west, ubud.zoom) == (-8.537, 115.233, 14)
    assert len(market.plan_cells(areas, []).collect()) == 0


def test_discoveries_fill_gaps_and_keep_cells(spark):
    rows = [("a", "c1", 1, None, 4.0), ("a", "c2", 2, "Title", 5.0), ("a", "c1", 3, "Later", None),
            ("b", "c2", 4, "", None)]
    df = spark.createDataFrame(rows, "source_listing_id string, cell_id string, seq long, title string, rating double")
    got = {r.source_listing_id: r for r in market.dedupe_discoveries(df, ("title", "rating")).collect()}
    assert (got["a"].title, got["a"].rating, got["a"].discovery_count) == ("Title", 4.0, 3)
    assert got["a"].discovery_cell_ids == ["c1", "c2"]
    assert got["b"].title is None


def test_verification_stops_at_first_block(spark):
    listings = spark.createDataFrame([("v", str(n), n) for n in range(5)],
                                     "collection_id string, source_listing_id string, seq int")
    visits = spark.createDataFrame(
        [("v", "0", "ok", "collected"), ("v", "1", "no_results", None), ("v", "2", "captcha", None),
         ("v", "3", "ok", "collected")],
        "collection_id string, source_listing_id string, state string, observed_status string")
    verified = market.verify_listings(listings, visits)
    assert [(r.seq, r.status) for r in verified.orderBy("seq").collect()] == [
        (0, "active"), (1, "unavailable"), (2, "blocked")]
    summary = market.verification_summary(verified).head()
    assert (summary.verified, summary.final_state, summary.manual_action_reason) == (
        3, "manual_action_required", "captcha")


def test_quality_status(spark):
    cases = {(0, 0, 0, 0): "failed", (4, 4, 0, 0): "complete", (4, 1, 0, 0): "degraded",
             (4, 3, 1, 0): "partial", (4, 4, 0, 1): "partial", (4, 2, 2, 0): "degraded"}
    df = spark.createDataFrame(list(cases), "p int, c int, f int, e int")
    got = {tuple(r[:4]): r.q for r in df.withColumn("q", market.quality_status(
        F.col("p"), F.col("c"), F.col("f"), F.col("e"))).collect()}
    assert got == cases


def test_fnv_states_from_known_starts_and_groups_over_batches(spark, monkeypatch):
    """Groups inside a task are hashed at once, whatever the slices they fall into."""
    rng = np.random.default_rng(5)
    sizes = np.array([0, 1, 700, 0, 3, 40, 0])
    data = rng.integers(0, 256, sizes.sum()).astype(np.uint8)
    states = rng.integers(0, 2**63, len(sizes)).astype(np.uint64)
    expected, at = [], 0
    for size, state in zip(sizes.tolist(), states.tolist()):
        for byte in data[at:at + size].tolist():
            state = ((state ^ byte) * 0x100000001B3) % 2**64
        at += size
        expected.append(state)
    with np.errstate(over="ignore"):
        assert market._end_states(data, sizes, states).tolist() == expected

    lines = {f"g{g}": [f"{n * 7 % 31}|{g}" if g % 3 else ("" if n == 0 else f"日{n}é") for n in range(g % 5 * 9 + 1)]
             for g in range(60)}
    rows = sorted((k, line) for k, some in lines.items() for line in some)
    lanes = []
    monkeypatch.setattr(market, "_KNOWN_ROWS", 7)
    effects = market._row_effects
    monkeypatch.setattr(market, "_row_effects", lambda some, lead: lanes.extend(some) or effects(some, lead))
    for cuts in ([0, len(rows)], [0, 1, 2, 60, 61, 400, len(rows)]):
        lanes.clear()
        pieces = []
        for a, b in zip(cuts, cuts[1:]):
            table = pa.table({"collection_id": [r[0] for r in rows[a:b]], "fingerprint": [r[1] for r in rows[a:b]]})
            pieces += [r for out in market._summaries(iter(table.to_batches(max_chunksize=50))) for r in out.to_pylist()]
        assert len(lanes) < len(rows) / 2  # only the first group of each task is hashed for 256 starts
        assert sum(p["checksum"] is None for p in pieces) <= 2 * (len(cuts) - 1)
        pieces.sort(key=lambda p: (p["collection_id"], p["first"] or ""))
        got = {r["collection_id"]: r["checksum"] for out in market._chained(
            pa.Table.from_pylist(pieces, pa.schema([("collection_id", pa.string()), ("first", pa.string()), (
                "checksum", pa.string()), ("scale", pa.binary()), ("shift", pa.binary())])).to_batches())
            for r in out.to_pylist()}
        assert got == {k: fnv(some) for k, some in lines.items()}


def test_equal_points_and_cells_meet_once(spark):
    """What is compared does not grow with copies; every point still gets every cell that holds it."""
    spot = F.col("id") % 7
    points = spark.range(700).select(F.col("id").alias("point_id"), (spot / 10).alias("latitude"),
                                     F.when(spot != 3, spot / 20).alias("longitude"))
    box = F.col("id") % 5
    cells = spark.range(50).select(
        F.col("id").alias("cell_id"), (box / 10 - 0.02).alias("south"), (box / 10 + 0.11).alias("north"),
        (box / 20 - 0.01).alias("west"), (box / 20 + 0.05).alias("east"))
    found = market.assign_cells(points, cells)
    expected = {(p.point_id, c.cell_id) for p in points.collect() for c in cells.collect()
                if p.longitude is not None and c.south <= p.latitude < c.north and c.west <= p.longitude < c.east}
    got = found.select("point_id", "cell_id").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected and len(expected) >= 4000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    tiles = [line for line in plan.splitlines() if "Join" in line and "__tx" in line]
    assert len(tiles) == 1 and plan.count("Aggregate [") == 2
