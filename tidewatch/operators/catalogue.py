"""Catalogue queries: filtered lists, keyset pages, look-ups, overview figures."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.places import round_coordinate

DEFAULT_PAGE, MAX_PAGE = 25, 100


# --- paging ------------------------------------------------------------------

@dataclass(frozen=True)
class Cursor:
    sort_value: str
    id: str

    def encode(self) -> str:
        doc = json.dumps({"sortValue": self.sort_value, "id": self.id}, separators=(",", ":"))
        return base64.urlsafe_b64encode(doc.encode()).decode().rstrip("=")

    @staticmethod
    def decode(text: str) -> Cursor:
        try:
            padded = text + "=" * (-len(text) % 4)
            doc = json.loads(base64.urlsafe_b64decode(padded.encode()).decode())
        except (binascii.Error, ValueError) as error:
            raise ValueError("cursor is not valid base64url json") from error
        if not isinstance(doc, dict) or not all(
                isinstance(doc.get(k), str) for k in ("sortValue", "id")):
            raise ValueError("cursor payload is malformed")
        return Cursor(doc["sortValue"], doc["id"])


def page_size(requested: float | None, default: int = DEFAULT_PAGE, most: int = MAX_PAGE) -> int:
    return min(max(1, int(default if requested is None else requested)), most)


def keyset_page(df: DataFrame, sort: str, key: str, limit: int,
                after: Cursor | None = None) -> DataFrame:
    """The next ``limit`` + 1 rows, newest first; the extra row tells there is more.

    Descending on (sort, key), NULL sort values last; those cannot be reached past a
    cursor.  The plan is one TakeOrderedAndProject.
    """
    if after is not None:
        value = F.lit(after.sort_value).cast(df.schema[sort].dataType)
        last = F.lit(after.id).cast(df.schema[key].dataType)
        df = df.filter((F.col(sort) < value) | ((F.col(sort) == value) & (F.col(key) < last)))
    return df.orderBy(F.desc_nulls_last(sort), F.desc(key)).limit(limit + 1)


def fetch_page(df: DataFrame, sort: str, key: str, limit: int | None = None,
               cursor: str | None = None) -> tuple[list, str | None]:
    """One page of rows (at most 100) and the cursor of the next, if any."""
    size = page_size(limit)
    rows = keyset_page(df, sort, key, size, Cursor.decode(cursor) if cursor else None).collect()
    page = rows[:size]
    more = len(rows) > size and page[-1][sort] is not None
    following = Cursor(str(page[-1][sort]), str(page[-1][key])).encode() if more else None
    return page, following


# --- lists -------------------------------------------------------------------

def properties_of(properties: DataFrame, dataset_id, region_id=None, status=None) -> DataFrame:
    df = properties.filter(F.col("dataset_id") == dataset_id)
    if region_id is not None:
        df = df.filter(F.col("region_id") == region_id)
    if status is not None:
        df = df.filter(F.col("lifecycle_status") == status)
    return df


def with_region_name(properties: DataFrame, regions: DataFrame) -> DataFrame:
    names = regions.select("region_id", F.col("name").alias("region_name"))
    return properties.join(names, "region_id", "left")


def review_state(state: str) -> Column:
    reviewed, dismissed = F.col("is_reviewed"), F.col("dismissed_at").isNotNull()
    match state:
        case "pending":
            return ~reviewed & ~dismissed
        case "reviewed":
            return reviewed
        case "dismissed":
            return dismissed
    raise ValueError(f"unknown review state {state!r}")


def events_of(events: DataFrame, dataset_id, event_type=None, property_id=None,
              review: str | None = None) -> DataFrame:
    df = events.filter(F.col("dataset_id") == dataset_id)
    if event_type is not None:
        df = df.filter(F.col("event_type") == event_type)
    if property_id is not None:
        df = df.filter(F.col("property_id") == property_id)
    return df if review is None else df.filter(review_state(review))


def with_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Events with their evidence rows beside them, one row per evidence item.

    A flat join: an event keeps any number of items without being gathered.
    """
    return events.join(evidence, "event_id", "left")


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def leads_of(leads: DataFrame, organization_id, stage=None) -> DataFrame:
    df = leads.filter(F.col("organization_id") == organization_id)
    if stage is not None:
        df = df.filter(F.col("stage") == stage)
    return df.orderBy(F.desc("created_at"), "lead_id")


def reports_of(reports: DataFrame, organization_id, dataset_id) -> DataFrame:
    return reports.filter(
        (F.col("organization_id") == organization_id) & (F.col("dataset_id") == dataset_id)
    ).orderBy(F.desc("created_at"))


def create_leads(requests: DataFrame, leads: DataFrame) -> DataFrame:
    """Idempotent per (organisation, property): the existing lead, or a new one.

    Several requests for one key make one lead (the earliest request).
    """
    keys = ["organization_id", "property_id"]
    rest = [c for c in requests.columns if c not in keys]
    first = requests.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct("requested_at", "source_event_id")).alias("f")
    ).select(*keys, "f.*")
    known = leads.select(*keys, "lead_id")
    made = F.sha2(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys]), 256)
    return first.join(known, keys, "left").withColumns({
        "created": F.col("lead_id").isNull(),
        "lead_id": F.coalesce(F.col("lead_id").cast("string"), made),
    })


def map_points(properties: DataFrame) -> DataFrame:
    """Properties with both coordinates, rounded for display."""
    return properties.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    ).withColumns({
        "latitude": round_coordinate("latitude"), "longitude": round_coordinate("longitude")})


def map_clusters(points: DataFrame, cell_degrees: float) -> DataFrame:
    """Point counts per grid cell and status; halve the cell size per zoom step."""
    return points.groupBy(
        F.floor(F.col("latitude") / cell_degrees).alias("cell_lat"),
        F.floor(F.col("longitude") / cell_degrees).alias("cell_lng"),
        "lifecycle_status",
    ).agg(F.count(F.lit(1)).alias("points"))


def newest(df: DataFrame, sort: str, limit: int, tie: str) -> DataFrame:
    """The newest ``limit`` rows (50 snapshots, imports or collections; 500 observations)."""
    return df.orderBy(F.desc(sort), F.desc(tie)).limit(limit)


def timeline(events: DataFrame, evidence: DataFrame, property_id) -> DataFrame:
    """All events of a property, newest first, with evidence."""
    mine = events.filter(F.col("property_id") == property_id)
    return with_evidence(mine, evidence).orderBy(F.desc("event_at"), "event_id")


# --- figures -----------------------------------------------------------------

def dataset_overview(properties: DataFrame, events: DataFrame) -> DataFrame:
    """Property totals by status and event totals, per dataset."""
    status = F.col("lifecycle_status")
    figures = properties.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("properties"),
        F.count_if(status == "active").alias("active"),
        F.count_if(status == "suspected_inactive").alias("suspected"),
        F.count_if(status == "confirmed_inactive").alias("confirmed"))
    totals = events.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("events"))
    return figures.join(totals, "dataset_id", "left").fillna(0, ["events"])


def watchlist_sizes(watchlists: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("watchlist_id").agg(F.count(F.lit(1)).alias("items"))
    return watchlists.join(counts, "watchlist_id", "left").fillna(0, ["items"])


def property_status(listings: DataFrame) -> DataFrame:
    """Property life cycle from its listings: active when any is, else the latest one's."""
    live = F.col("status").isin("active", "reactivated")
    return listings.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if(live).alias("active_listings"),
        F.max_by("status", F.struct("last_observed_at", "listing_id")).alias("__latest"),
        F.min("first_seen_at").alias("first_observed_at"),
        F.max("last_observed_at").alias("last_observed_at"),
    ).withColumn("lifecycle_status", F.when(F.col("active_listings") > 0, "active").otherwise(
        F.col("__latest"))).drop("__latest")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot id, title and status per listing; combines map-side."""
    facts = F.struct("snapshot_id", "title", "observation_status", "observed_at")
    return snapshots.groupBy("listing_id").agg(
        F.max_by(facts, F.struct("observed_at", "snapshot_id")).alias("s")).select(
        "listing_id", F.col("s.snapshot_id").alias("latest_snapshot_id"),
        F.col("s.title").alias("current_title"),
        F.col("s.observation_status").alias("current_observation_status"),
        F.col("s.observed_at").alias("last_observed_at"))


# --- search and hierarchy ----------------------------------------------------

def global_search(needle: str, **tables: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """Case-insensitive search: name=(table, id column, text columns), one union."""
    found = None
    for kind, (df, key, columns) in tables.items():
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))),
                                   F.lit(needle.lower()))
        part = df.filter(hit).select(
            F.lit(kind).alias("entity"), F.col(key).cast("string").alias("id"),
            F.col(columns[0]).cast("string").alias("label"))
        found = part if found is None else found.unionByName(part)
    return found


def region_closure(regions: DataFrame, max_depth: int = 16) -> DataFrame:
    """(ancestor_id, region_id) pairs including each region itself.

    Regions form an administrative tree a few levels deep; a deeper or cyclic
    tree raises instead of being cut short.
    """
    parent = regions.select(F.col("region_id").alias("__id"), F.col("parent_id").alias("__up"))
    level = regions.select("region_id", F.col("region_id").alias("ancestor_id"))
    closure = level
    for _ in range(max_depth):
        level = level.join(parent, level.ancestor_id == parent["__id"]).filter(
            F.col("__up").isNotNull()).select("region_id", F.col("__up").alias("ancestor_id"))
        if level.isEmpty():
            return closure
        closure = closure.unionByName(level)
    raise ValueError("region tree is cyclic or too deep")
