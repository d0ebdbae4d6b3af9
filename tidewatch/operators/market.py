"""Market collections: search grid, discoveries, coverage, snapshots, verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Planner
from tidewatch.functions.places import round_half_up
from tidewatch.functions.text import num_text
from tidewatch.operators.scans import lookup
from tidewatch.sources.pages import is_blocking, manual_action_reason

CARD_FIELDS = (
    "canonical_url", "title", "area", "rating", "review_count", "displayed_price", "currency",
    "guest_capacity", "bedrooms", "image_url", "latitude", "longitude",
)

# Search areas (key, name, centre, half spans in degrees, zoom).
BALI_AREAS = (
    ("canggu", "Canggu", -8.648, 115.138, 0.02, 0.02, 14),
    ("berawa", "Berawa", -8.66, 115.142, 0.015, 0.015, 15),
    ("pererenan", "Pererenan", -8.647, 115.121, 0.015, 0.015, 15),
    ("seminyak", "Seminyak", -8.69, 115.162, 0.02, 0.02, 14),
    ("umalas", "Umalas", -8.671, 115.153, 0.015, 0.015, 15),
    ("ubud", "Ubud", -8.507, 115.263, 0.03, 0.03, 14),
    ("sanur", "Sanur", -8.688, 115.262, 0.025, 0.02, 14),
    ("jimbaran", "Jimbaran", -8.79, 115.163, 0.025, 0.025, 14),
    ("nusa_dua", "Nusa Dua", -8.803, 115.228, 0.025, 0.025, 14),
    ("uluwatu", "Uluwatu", -8.829, 115.087, 0.03, 0.03, 14),
    ("bingin", "Bingin", -8.807, 115.113, 0.012, 0.012, 15),
    ("balangan", "Balangan", -8.79, 115.122, 0.012, 0.012, 15),
    ("amed", "Amed", -8.339, 115.66, 0.03, 0.04, 14),
    ("candidasa", "Candidasa", -8.511, 115.568, 0.025, 0.03, 14),
    ("sidemen", "Sidemen", -8.449, 115.443, 0.03, 0.03, 14),
    ("lovina", "Lovina", -8.158, 115.026, 0.03, 0.05, 14),
    ("tabanan", "Tabanan", -8.537, 115.125, 0.04, 0.04, 13),
)


# --- search grid -------------------------------------------------------------

def centred_box(lat: Column, lng: Column, lat_half: Column, lng_half: Column) -> dict[str, Column]:
    return {
        "north": round_half_up(lat + lat_half, 6), "south": round_half_up(lat - lat_half, 6),
        "east": round_half_up(lng + lng_half, 6), "west": round_half_up(lng - lng_half, 6),
    }


def market_areas(spark: SparkSession, areas: Sequence[tuple] = BALI_AREAS) -> DataFrame:
    raw = spark.createDataFrame(
        [(i, *a) for i, a in enumerate(areas)],
        "area_order int, area_key string, name string, lat double, lng double, "
        "lat_half double, lng_half double, zoom int")
    box = centred_box(F.col("lat"), F.col("lng"), F.col("lat_half"), F.col("lng_half"))
    return raw.withColumns(box).drop("lat", "lng", "lat_half", "lng_half")


def subdivide(areas: DataFrame, rules: Planner = Planner()) -> DataFrame:
    """Cells of every area (north, south, east, west), row by row from the south-west."""
    def parts(span: Column) -> Column:
        wanted = F.ceil(span / F.lit(rules.max_span))
        return F.least(F.greatest(wanted, F.lit(1)), F.lit(rules.max_divisions)).cast("int")

    df = areas.withColumns({
        "__lat": F.abs(F.col("north") - F.col("south")),
        "__lng": F.abs(F.col("east") - F.col("west")),
        "__south": F.least("north", "south"), "__west": F.least("east", "west"),
    }).withColumns({"__rows": parts(F.col("__lat")), "__cols": parts(F.col("__lng"))})
    df = df.withColumn("grid_row", F.explode(F.sequence(F.lit(0), F.col("__rows") - 1)))
    df = df.withColumn("grid_col", F.explode(F.sequence(F.lit(0), F.col("__cols") - 1)))
    tall, wide = F.col("__lat") / F.col("__rows"), F.col("__lng") / F.col("__cols")
    south = F.col("__south") + F.col("grid_row") * tall
    west = F.col("__west") + F.col("grid_col") * wide
    return df.withColumns({
        "south": round_half_up(south, 6), "north": round_half_up(south + tall, 6),
        "west": round_half_up(west, 6), "east": round_half_up(west + wide, 6),
    }).drop("__lat", "__lng", "__south", "__west", "__rows", "__cols")


def plan_cells(areas: DataFrame, selected: Sequence[str], rules: Planner = Planner()) -> DataFrame:
    """Cells of the selected areas in selection order; unknown keys are ignored."""
    chosen = F.array(*[F.lit(k) for k in selected]) if selected else F.array().cast("array<string>")
    position = F.array_position(chosen, F.col("area_key"))
    picked = areas.withColumn("selection", position).filter(F.col("selection") > 0)
    return subdivide(picked, rules).orderBy("selection", "grid_row", "grid_col")


def assign_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Cell of every point: south <= lat < north and west <= lng < east.

    Spots (points at one place) and boxes (cells with the same bounds) meet once, on a coarse
    tile (an equi-join), then the exact bounds decide.  A box is copied to the few tiles it
    overlaps, never to all spots.  Only pairs that hold are opened to their points and cells,
    so no more pairs are made than there are results.
    """
    tile = 0.05
    place, bounds = ["latitude", "longitude"], ["south", "north", "west", "east"]
    spread = lambda low, high: F.explode(F.sequence(
        F.floor(F.col(low) / tile), F.floor(F.col(high) / tile)))
    tiled = cells.select(*bounds).distinct().withColumn("__ty", spread("south", "north")).withColumn(
        "__tx", spread("west", "east"))
    placed = points.select(*place).distinct().withColumns({
        "__ty": F.floor(F.col("latitude") / tile), "__tx": F.floor(F.col("longitude") / tile)})
    inside = (
        (F.col("latitude") >= F.col("south")) & (F.col("latitude") < F.col("north"))
        & (F.col("longitude") >= F.col("west")) & (F.col("longitude") < F.col("east")))
    met = placed.join(tiled, ["__ty", "__tx"]).filter(inside).drop("__ty", "__tx")
    return points.join(met, place).join(cells, bounds).select(*points.columns, *cells.columns)


# --- discoveries -------------------------------------------------------------

def passes_filters(min_rating: float | None, min_reviews: int | None) -> Column:
    """A card fails only on a value it shows."""
    ok = F.lit(True)
    if min_rating is not None:
        ok = ok & (F.col("rating").isNull() | (F.col("rating") >= min_rating))
    if min_reviews is not None:
        ok = ok & (F.col("review_count").isNull() | (F.col("review_count") >= min_reviews))
    return ok


def within_cap(discoveries: DataFrame, max_listings: int | None) -> DataFrame:
    """Keep the first ``max_listings`` listings ever seen, with all their discoveries."""
    if max_listings is None:
        return discoveries
    seen = discoveries.groupBy("source_listing_id").agg(F.min("seq").alias("__seq"))
    kept = seen.orderBy("__seq", "source_listing_id").limit(max_listings)
    return discoveries.join(kept.select("source_listing_id"), "source_listing_id", "left_semi")


def dedupe_discoveries(discoveries: DataFrame, fields: Sequence[str] = CARD_FIELDS) -> DataFrame:
    """One row per listing: first non-empty value of each field, its cells, its count.

    ``seq`` orders discoveries.  Aggregated per (listing, cell) first, so a listing
    found very often shrinks before it meets the final group, whose list holds at
    most one entry per planned cell.
    """
    def held(c: str) -> Column:
        return F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""),
                      F.struct("seq", F.col(c).alias("value")))

    per_cell = discoveries.groupBy("source_listing_id", "cell_id").agg(
        F.min("seq").alias("__seq"), F.count(F.lit(1)).alias("__n"),
        *[F.min(held(c)).alias(c) for c in fields])
    cells = F.array_sort(F.collect_list(F.struct("__seq", "cell_id")))
    return per_cell.groupBy("source_listing_id").agg(
        F.min("__seq").alias("first_seq"), F.sum("__n").alias("discovery_count"),
        cells.alias("__cells"), *[F.min(c).alias(c) for c in fields],
    ).withColumns({
        "discovery_cell_ids": F.transform("__cells", lambda c: c["cell_id"]),
        **{c: F.col(c)["value"] for c in fields},
    }).drop("__cells")


def discovery_metrics(unique: DataFrame) -> DataFrame:
    return unique.agg(
        F.coalesce(F.sum("discovery_count"), F.lit(0)).alias("total_discoveries"),
        F.count(F.lit(1)).alias("unique_listings"),
    ).withColumn("duplicate_discoveries", F.greatest(
        F.lit(0), F.col("total_discoveries") - F.col("unique_listings")))


def cell_discoveries(kept: DataFrame) -> DataFrame:
    """Cards kept per cell, counted before the listing cap."""
    return kept.groupBy("cell_id").agg(F.count(F.lit(1)).alias("listings_discovered"))


def upsert_observations(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Merge new unique listings into stored ones, keyed (collection, listing).

    Cells unite, counts add, and only a missing title, rating or review count is
    filled; every other stored field stays.
    """
    keys = ["collection_id", "source_listing_id"]
    new = found.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in found.columns if c not in keys])
    old_there = F.col("discovery_count").isNotNull()
    merged = stored.join(new, keys, "full_outer")
    fill = {"title", "rating", "review_count"}
    out = {}
    for c in stored.columns:
        if c in keys:
            continue
        fresh = F.col(f"__n_{c}") if c in found.columns else F.lit(None)
        if c == "discovery_cell_ids":
            nothing = F.array().cast(stored.schema[c].dataType)
            out[c] = F.array_distinct(F.concat(
                F.coalesce(F.col(c), nothing), F.coalesce(fresh, nothing)))
        elif c == "discovery_count":
            out[c] = F.coalesce(F.col(c), F.lit(0)) + F.coalesce(fresh, F.lit(0))
        elif c in fill:
            out[c] = F.coalesce(F.col(c), fresh)
        else:
            out[c] = F.when(old_there, F.col(c)).otherwise(fresh)
    return merged.select(*keys, *[v.alias(c) for c, v in out.items()])


def mark_details(observations: DataFrame, details: DataFrame) -> DataFrame:
    """Record the detail outcome (observed_status, detail) of each observation visited."""
    keys = ["collection_id", "source_listing_id"]
    found = details.select(*keys, F.coalesce("observed_status", F.lit("error")).alias("__status"),
                           F.col("detail").alias("__detail"))
    visited = F.col("__status").isNotNull()
    return observations.join(found, keys, "left").withColumns({
        "detail_collected": F.when(visited, F.col("__status") == "collected").otherwise(
            F.col("detail_collected")),
        "detail_observed_status": F.coalesce("__status", "detail_observed_status"),
        "detail": F.when(visited, F.col("__detail")).otherwise(F.col("detail")),
    }).drop("__status", "__detail")


def detail_progress(observations: DataFrame) -> DataFrame:
    status = F.col("detail_observed_status")
    return observations.groupBy("collection_id").agg(
        F.count_if("detail_collected").alias("detail_pages_completed"),
        F.coalesce(F.bool_or(~F.col("detail_collected")), F.lit(False)).alias("details_pending"),
        F.count_if(status.isNotNull() & (status != "collected")).alias("detail_warnings"))


# --- snapshot header ---------------------------------------------------------

def coverage_ratio(completed: Column, planned: Column) -> Column:
    ratio = completed / F.nullif(planned, F.lit(0))
    return F.when(planned <= 0, F.lit(0.0)).otherwise(
        F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))


def percent(ratio: Column) -> Column:
    return F.floor(ratio * 100 + 0.5).cast("int")


def quality_status(planned: Column, completed: Column, failed: Column, errors: Column) -> Column:
    return (
        F.when((planned <= 0) | (completed <= 0), "failed")
        .when((completed >= planned) & (failed == 0) & (errors == 0), "complete")
        .when((coverage_ratio(completed, planned) < 0.5) | (failed >= completed), "degraded")
        .otherwise("partial")
    )


def cell_coverage(cells: DataFrame) -> DataFrame:
    status = F.col("status")
    return cells.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status.isin("failed", "manual_action_required")).alias("failed"))


def finalise(collections: DataFrame, cells: DataFrame, observations: DataFrame) -> DataFrame:
    """Outcome of each collection; ``creates_snapshot`` tells which get a header.

    ``collections``: collection_id, blocked, errors, warnings, details_required.
    """
    seen = observations.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("unique_listings"),
        F.coalesce(F.bool_or(~F.col("detail_collected")), F.lit(False)).alias("__pending"))
    df = collections.join(cell_coverage(cells), "collection_id", "left").join(
        seen, "collection_id", "left").fillna(
        0, ["planned", "completed", "failed", "unique_listings"]).fillna(False, ["__pending"])
    planned, completed = F.col("planned"), F.col("completed")
    pending = F.col("details_required") & F.col("__pending")
    raw = quality_status(planned, completed, F.col("failed"), F.col("errors"))
    gaps = F.col("blocked") | pending | (completed < planned)
    df = df.withColumn("quality_status", F.when(gaps & (raw == "complete"), "partial").otherwise(raw))
    quality = F.col("quality_status")
    return df.withColumns({
        "search_cell_coverage": coverage_ratio(completed, planned),
        "completion_percentage": percent(coverage_ratio(completed, planned)),
        "creates_snapshot": completed > 0,
        "final_state": F.when(F.col("blocked"), "manual_action_required").when(
            quality == "failed", "failed").when(quality == "complete", "completed").otherwise(
            "partial"),
    }).drop("__pending")


def listing_fingerprint() -> Column:
    empty = F.lit("")
    return F.concat_ws(
        "|", "source_listing_id", F.coalesce(num_text("rating"), empty),
        F.coalesce(num_text("review_count"), empty),
        F.coalesce(F.col("displayed_price"), empty), F.coalesce(F.col("currency"), empty))


def multiset_checksum(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Order-free checksum of the ``fingerprint`` column per group.

    Sums four 48-bit slices of each row's sha256: combines map-side, so one group
    may hold any share of the rows.
    """
    digest = F.sha2("fingerprint", 256)
    slices = [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)"))
              for i in range(4)]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("listings"),
        *[s.alias(f"__s{i}") for i, s in enumerate(slices)],
    ).withColumn("checksum", F.sha2(F.concat_ws(
        ":", F.col("listings").cast("string"),
        *[F.col(f"__s{i}").cast("string") for i in range(4)]), 256)
    ).drop(*[f"__s{i}" for i in range(4)])


# 64-bit FNV-1a over the sorted fingerprints joined with newlines.
_FNV_START = np.uint64(0xCBF29CE484222325)
_FNV_PRIME = np.uint64(0x100000001B3)
_FNV_INVERSE = np.uint64(pow(0x100000001B3, -1, 2**64))
_LOW_PRIME = np.uint8(0xB3)
_ROWS = 2048  # texts hashed side by side for every state they may start from
_KNOWN_ROWS = 8192  # texts hashed at once from known states
_PIECE = "collection_id string, first string, checksum string, scale binary, shift binary"


def _absorb(units: Sequence[int], lanes: np.ndarray) -> np.ndarray:
    for unit in units:
        lanes = (lanes ^ np.uint64(unit & 0xFF)) * _FNV_PRIME
        if unit >> 8:
            lanes = (lanes ^ np.uint64(unit >> 8)) * _FNV_PRIME
    return lanes


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")


def _row_effects(texts: list[str], leading: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, shift[256]) of every text, with a line break before it where ``leading``.

    A step xors into the low byte and multiplies, so the effect of a text on state x is
    x * scale + shift[low byte of x].  All texts advance together, one code unit a turn.
    """
    units = [_units(("\n" if lead else "") + text) for text, lead in zip(texts, leading)]
    sizes = np.array([len(u) for u in units])
    order = np.argsort(-sizes, kind="stable")
    grid = np.zeros((len(units), sizes.max(initial=0)), "<u2")
    for at, k in enumerate(order):
        grid[at, :sizes[k]] = units[k]
    lows = np.arange(256, dtype=np.uint64)
    lanes = np.tile(lows, (len(units), 1))
    scale = np.ones(len(units), np.uint64)
    for j in range(grid.shape[1]):
        n = int((sizes[order] > j).sum())  # longest first, so the open ones lead
        unit = grid[:n, j].astype(np.uint64)
        lanes[:n] = (lanes[:n] ^ (unit & np.uint64(0xFF))[:, None]) * _FNV_PRIME
        scale[:n] *= _FNV_PRIME
        wide = np.flatnonzero(unit >> np.uint64(8))
        if len(wide):
            lanes[wide] = (lanes[wide] ^ (unit[wide] >> np.uint64(8))[:, None]) * _FNV_PRIME
            scale[wide] *= _FNV_PRIME
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return scale[back], (lanes - lows * scale[:, None])[back]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What is hashed of all texts, back to back, and how many bytes each has: the low byte of
    every UTF-16 unit and, unless it is zero, the high byte."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    if not len(data) or data.max() < 0x80:
        return data, np.diff(ends)
    found = []
    for text in texts.to_pylist():
        pairs = _units(text).view(np.uint8)
        found.append(pairs[(np.arange(len(pairs)) % 2 == 0) | (pairs > 0)])
    return np.concatenate(found), np.array([len(f) for f in found])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2 ** 64."""
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))])


def _end_states(data: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The states after each stretch of ``sizes`` bytes of ``data``, each from its own state.

    A step is x -> (x ^ byte) * prime = (x + d) * prime, where d depends on the low byte of x only.
    Bit j of the next low byte is bit j of x ^ byte, turned over where the bits below carry into
    it, so the low bytes come bit by bit as running parities; the rest is a sum of d times powers.
    """
    used = np.flatnonzero(sizes)
    if not len(used):
        return states
    n, begin = sizes[used], np.cumsum(sizes[used]) - sizes[used]
    start = states[used]
    low = np.zeros(len(data), np.uint8)
    for j in range(8):
        mixed = (low ^ data) & np.uint8((1 << j) - 1)
        turn = ((data >> np.uint8(j)) ^ ((mixed * _LOW_PRIME) >> np.uint8(j))) & np.uint8(1)
        before = np.bitwise_xor.accumulate(turn) ^ turn
        first = before[begin] ^ ((start >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)
        low |= (before ^ np.repeat(first, n)) << np.uint8(j)
    d = ((low ^ data).astype(np.int64) - low).view(np.uint64)
    sums = np.add.reduceat(d * _powers(_FNV_INVERSE, len(data))[:-1], begin)
    power = _powers(_FNV_PRIME, len(data))
    out = states.copy()
    out[used] = start * power[n] + sums * power[begin + n]
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of the groups that begin and end in this run of sorted rows; of the first group,
    which may have begun before, its effect on any state; of the last, which may go on, the state
    it is left in, as an effect that is the same for all."""
    names = ["collection_id", "first", "checksum", "scale", "shift"]
    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()]
    lows = np.arange(256, dtype=np.uint64)
    began, open_start = False, True  # has any row come; may the group at hand have begun before
    group, first, state = None, None, _FNV_START
    lanes, scale = lows, np.uint64(1)

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def piece() -> pa.RecordBatch:
        s, to = (scale, lanes - lows * scale) if open_start else (np.uint64(0), np.full(256, state))
        return rows([group], [first], [None], [s.tobytes()], [to.astype("<u8").tobytes()])

    with np.errstate(over="ignore"):
        for whole in batches:
            for at in range(0, whole.num_rows, _KNOWN_ROWS):
                batch = whole.slice(at, _KNOWN_ROWS)
                owners, texts = batch.column("collection_id"), batch.column("fingerprint")
                codes = owners.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
                goes_on = began and owners[0].as_py() == group
                if not began:
                    group, first, began, goes_on = owners[0].as_py(), texts[0].as_py(), True, True
                    fresh = True
                else:
                    fresh = False
                if goes_on and open_start:
                    n = int(starts[1]) if len(starts) > 1 else batch.num_rows
                    for k in range(0, n, _ROWS):
                        some = texts.slice(k, min(_ROWS, n - k)).to_pylist()
                        leading = np.ones(len(some), bool)
                        leading[0] = not (fresh and k == 0)
                        for s, shift in zip(*_row_effects(some, leading)):
                            lanes, scale = lanes * s + shift[lanes & np.uint64(0xFF)], scale * s
                    if n == batch.num_rows:
                        continue
                    texts, owners, starts = texts.slice(n), owners.slice(n), starts[1:] - n
                    goes_on = False
                if not goes_on:
                    # The group at hand has ended.
                    yield piece() if open_start else rows([group], [first], [f"{int(state):016x}"], [None], [None])
                    open_start = False
                data, sizes = _bytes_of(texts)
                leading = np.ones(len(texts), np.int64)
                leading[starts if not goes_on else starts[1:]] = 0
                joined = np.full(int(sizes.sum() + leading.sum()), 10, np.uint8)
                joined[np.arange(len(data)) + np.repeat(np.cumsum(leading), sizes)] = data
                states = np.full(len(starts), _FNV_START)
                if goes_on:
                    states[0] = state
                states = _end_states(joined, np.add.reduceat(sizes + leading, starts), states)
                heads = owners.take(pa.array(starts)).to_pylist()
                done = len(starts) - 1
                if done:
                    yield rows(heads[:-1], [None] * done, [f"{int(x):016x}" for x in states[:-1]],
                               [None] * done, [None] * done)
                if done or not goes_on:
                    group, first = heads[-1], texts[int(starts[-1])].as_py()
                state = states[-1]
        if began:
            yield piece()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups' checksums as they are; the pieces of all others composed in order."""
    names, group, state = ["collection_id", "checksum"], None, None

    def rows(ids: Sequence, sums: Sequence) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sums, pa.string())], names)

    with np.errstate(over="ignore"):
        for batch in batches:
            cut = batch.column("checksum").is_null()
            plain = batch.filter(cut.cast(pa.int8()).to_numpy(zero_copy_only=False) == 0)
            yield plain.select(names)
            for row in batch.filter(cut).to_pylist():
                if state is not None and row["collection_id"] == group:
                    state = _absorb([10], state)
                else:
                    if state is not None:
                        yield rows([group], [f"{int(state[0]):016x}"])
                    group, state = row["collection_id"], np.array([_FNV_START], dtype=np.uint64)
                scale, shift = np.frombuffer(row["scale"], "<u8"), np.frombuffer(row["shift"], "<u8")
                state = state * scale + shift[int(state[0] & np.uint64(0xFF))]
        if state is not None:
            yield rows([group], [f"{int(state[0]):016x}"])


def fnv_checksum(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """64-bit FNV-1a checksum of each collection's sorted fingerprints.

    The hash is sequential, yet a range-partitioned sort lets every task hash its own
    run: groups that lie whole in it are done there, and of the two at its ends one 2 KB summary
    each is chained afterwards.  Fingerprints sort by code point.
    """
    sorted_rows = rows.select(F.col("collection_id").cast("string"), "fingerprint")
    order = ["collection_id", "fingerprint"]
    spread = (sorted_rows.repartitionByRange(*order) if partitions is None
              else sorted_rows.repartitionByRange(partitions, *order))
    pieces = spread.sortWithinPartitions(*order).mapInArrow(_summaries, _PIECE)
    return pieces.repartition("collection_id").sortWithinPartitions("collection_id", "first").mapInArrow(
        _chained, "collection_id string, checksum string")


# --- verification ------------------------------------------------------------

def verification_status(state: Column, observed: Column) -> Column:
    """Outcome of visiting one listing page; trouble never means the listing is gone."""
    return (
        F.when((state == "ok") & (observed == "collected"), "active")
        .when((state == "ok") & (observed == "not_found"), "not_found")
        .when(state.isin("ok", "no_results"), "unavailable")
        .when(state.isin("login_challenge", "account_verification"), "login_required")
        .when(state.isin("captcha", "access_denied", "blocked"), "blocked")
        .when(state == "navigation_error", "source_error")
        .otherwise("unknown")
    )


def verify_listings(listings: DataFrame, visits: DataFrame) -> DataFrame:
    """Verification rows of a previous snapshot's listings.

    ``listings``: collection_id, source_listing_id, seq (visiting order).  ``visits``:
    collection_id, source_listing_id, state, observed_status.  A listing without a visit is a navigation
    error.  Nothing after the first blocking page of a collection is verified.
    """
    keys = ["collection_id", "source_listing_id"]
    df = listings.join(visits.select(*keys, "state", "observed_status"), keys, "left")
    df = df.withColumn("state", F.coalesce("state", F.lit("navigation_error")))
    df = df.withColumn("blocking", is_blocking("state"))
    stop = df.filter("blocking").groupBy("collection_id").agg(F.min("seq").alias("__stop"))
    return lookup(df, stop, ["collection_id"]).filter(
        F.col("__stop").isNull() | (F.col("seq") <= F.col("__stop"))
    ).drop("__stop").withColumn(
        "status", verification_status(F.col("state"), F.col("observed_status")))


def verification_summary(verified: DataFrame) -> DataFrame:
    stopped_by = F.max_by("state", F.when(F.col("blocking"), F.col("seq")))
    return verified.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("verified"), F.bool_or("blocking").alias("blocked"),
        stopped_by.alias("__state"),
    ).withColumns({
        "final_state": F.when(F.col("blocked"), "manual_action_required").otherwise("completed"),
        "manual_action_reason": manual_action_reason("__state"),
    }).drop("__state")


def observation_rows(unique: DataFrame, collection_id: str) -> DataFrame:
    """Deduplicated cards as stored observations of one collection."""
    return unique.withColumns({
        "collection_id": F.lit(collection_id),
        "detail_collected": F.lit(False),
        "detail_observed_status": F.lit(None).cast("string"),
        "detail": F.lit(None).cast("string"),
    })


def snapshot_listings(observations: DataFrame, snapshot_id: Column) -> DataFrame:
    """Immutable rows of a market snapshot."""
    return observations.select(
        snapshot_id.alias("snapshot_id"), "source_listing_id",
        F.col("canonical_url").alias("source_url"), "title", "area", "rating", "review_count",
        "displayed_price", "currency", "guest_capacity", "bedrooms", "latitude", "longitude",
        "detail")


def compare_snapshots(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Listings of two market snapshots side by side: only_previous, only_current, changed, same."""
    before = previous.select("source_listing_id", listing_fingerprint().alias("__before"))
    after = current.select("source_listing_id", listing_fingerprint().alias("__after"))
    return before.join(after, "source_listing_id", "full_outer").select(
        "source_listing_id",
        F.when(F.col("__after").isNull(), "only_previous")
        .when(F.col("__before").isNull(), "only_current")
        .when(F.col("__before") != F.col("__after"), "changed").otherwise("unchanged")
        .alias("change"))


def comparison_totals(compared: DataFrame) -> DataFrame:
    change = F.col("change")
    return compared.agg(
        F.count_if(change != "only_current").alias("previous_total"),
        F.count_if(change != "only_previous").alias("current_total"),
        F.count_if(change.isin("changed", "unchanged")).alias("in_both"),
        F.count_if(change == "only_previous").alias("only_previous"),
        F.count_if(change == "only_current").alias("only_current"),
        F.count_if(change == "changed").alias("changed"),
        F.count_if(change == "unchanged").alias("unchanged"))
