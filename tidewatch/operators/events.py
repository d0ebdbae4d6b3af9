"""Evidence-backed, de-duplicated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import LifecycleRules, Materiality
from tidewatch.constants import CHANNEL_FIELDS, EVENT_TYPES, EXPLANATIONS
from tidewatch.operators.lifecycle import lifecycle_events

_FIELD_EVENTS = {
    "price": "price_changed",
    "rating": "rating_changed",
    "review_count": "review_count_changed",
    "host_external_id": "host_changed",
}
# Extra events of an extended rule version: field -> (event type, stored as is).
EXTENDED_FIELD_EVENTS = {
    "title": "title_changed",
    "photos": "photos_changed",
    "amenities": "amenities_changed",
    "is_superhost": "superhost_changed",
    "location": "location_changed",
}
EVENT_COLUMNS = (
    "listing_id", "event_type", "event_at", "confidence", "dedupe_key", "summary",
    "previous_value", "current_value", "rule_version", "evidence_type",
    "previous_snapshot_id", "current_snapshot_id", "run_id", "metadata",
)


def _mapped(c: Column, position: int) -> Column:
    pairs = []
    for name, target in EVENT_TYPES.items():
        pairs += [F.lit(name), F.lit(target[position])]
    return F.coalesce(F.create_map(*pairs).getItem(c), c)


def stored_type(c: Column | str) -> Column:
    return _mapped(F.col(c) if isinstance(c, str) else c, 0)


def event_title(c: Column | str) -> Column:
    return _mapped(F.col(c) if isinstance(c, str) else c, 1)


def field_event_type(extended: bool = False) -> Column:
    """Event type of a material difference, NULL when it raises none."""
    field, change = F.col("field_name"), F.col("change_kind")
    channel = field.isin(*CHANNEL_FIELDS)
    kind = F.when(channel & (change == "added"), "direct_channel_added")
    for name, event in _FIELD_EVENTS.items():
        kind = kind.when(field == name, event)
    if extended:
        kind = kind.when(channel & (change == "removed"), "direct_channel_removed")
        for name, event in EXTENDED_FIELD_EVENTS.items():
            kind = kind.when(field == name, event)
    return kind


def dedupe_hash(listing: Column, kind: Column, run: Column, version: Column) -> Column:
    return F.sha2(F.concat_ws("|", listing.cast("string"), kind, run.cast("string"), version), 256)


def field_events(diffs: DataFrame, extended: bool = False) -> DataFrame:
    """Material differences as events, one per dedupe key (first in field order).

    ``extended`` adds removed channels and content changes; use it under a rule
    version of its own.
    """
    kind = field_event_type(extended)
    text = F.when(F.col("event_type") == "direct_channel_added", F.format_string(
        EXPLANATIONS["direct_channel_added"].format(field="%s"), F.col("field_name")))
    for name in _FIELD_EVENTS.values():
        text = text.when(F.col("event_type") == name, EXPLANATIONS[name])
    events = (
        diffs.filter("is_material").withColumn("event_type", kind)
        .filter(F.col("event_type").isNotNull())
        .withColumn("dedupe_key", dedupe_hash(
            F.col("listing_id"), F.col("event_type"), F.col("run_id"), F.col("rule_version")))
        .select(
            "dedupe_key", "field_order", "listing_id", "event_type",
            F.col("observed_at").alias("event_at"), F.lit("high").alias("confidence"),
            text.otherwise("Observed field change.").alias("summary"),
            "previous_value", "current_value", "rule_version",
            F.lit("diff").alias("evidence_type"), "previous_snapshot_id",
            F.col("snapshot_id").alias("current_snapshot_id"), "run_id",
            F.to_json(F.struct(F.col("field_name").alias("field"))).alias("metadata"))
    )
    rest = [c for c in events.columns if c != "dedupe_key"]
    first = F.min_by(F.struct(*rest), F.struct("event_at", "field_order", "current_snapshot_id"))
    return events.groupBy("dedupe_key").agg(first.alias("e")).select("dedupe_key", "e.*").select(
        *EVENT_COLUMNS)


def creation_events(snapshots: DataFrame, existing: DataFrame | None = None,
                    rules: Materiality = Materiality()) -> DataFrame:
    """listing_created for listings not known before: an aggregate, no window."""
    first = F.min_by(F.struct("observed_at", "snapshot_id", "run_id"),
                     F.struct("observed_at", "snapshot_id"))
    created = snapshots.groupBy("listing_id").agg(first.alias("f"))
    if existing is not None:
        created = created.join(existing.select("listing_id"), "listing_id", "left_anti")
    day = F.date_format(F.col("f.observed_at"), "yyyy-MM-dd")
    return created.select(
        "listing_id", F.lit("listing_created").alias("event_type"),
        F.col("f.observed_at").alias("event_at"), F.lit("high").alias("confidence"),
        F.concat_ws(":", F.lit("listing_created"), F.col("listing_id").cast("string"), day,
                    F.lit(rules.version)).alias("dedupe_key"),
        F.lit(EXPLANATIONS["listing_created"]).alias("summary"),
        F.lit(None).cast("string").alias("previous_value"),
        F.lit(None).cast("string").alias("current_value"),
        F.lit(rules.version).alias("rule_version"), F.lit("snapshot").alias("evidence_type"),
        F.lit(None).cast(snapshots.schema["snapshot_id"].dataType).alias("previous_snapshot_id"),
        F.col("f.snapshot_id").alias("current_snapshot_id"), F.col("f.run_id").alias("run_id"),
        F.lit("{}").alias("metadata"),
    ).select(*EVENT_COLUMNS)


def transition_events(rows: DataFrame, rules: LifecycleRules = LifecycleRules()) -> DataFrame:
    """Life-cycle transitions in the common event shape."""
    snapshot_type = rows.schema["snapshot_id"].dataType
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return lifecycle_events(rows, rules).select(
        "listing_id", "event_type", "event_at", "confidence", "dedupe_key",
        F.col("explanation").alias("summary"), quoted("previous_status").alias("previous_value"),
        quoted("current_status").alias("current_value"), "rule_version",
        F.lit("lifecycle").alias("evidence_type"),
        F.lit(None).cast(snapshot_type).alias("previous_snapshot_id"),
        F.col("snapshot_id").alias("current_snapshot_id"), "run_id",
        F.to_json(F.struct(F.col("confidence"), F.col("rule_version").alias("ruleVersion")))
        .alias("metadata"),
    ).select(*EVENT_COLUMNS)


def all_events(created: DataFrame, changed: DataFrame, transitions: DataFrame) -> DataFrame:
    """Union of the three streams with stored type, title and a deterministic id."""
    return created.unionByName(changed).unionByName(transitions).withColumns({
        "event_id": F.md5("dedupe_key"),
        "engine_event_type": F.col("event_type"),
        "title": event_title("event_type"),
        "event_type": stored_type("event_type"),
    })


def event_table(events: DataFrame, dataset_id: str, owners: DataFrame) -> DataFrame:
    """Events as stored, with their dataset and the property that owns the listing
    (``owners``: listing_id, property_id, at most one row per listing)."""
    owned = events.join(owners.select("listing_id", "property_id"), "listing_id", "left")
    return owned.withColumn("dataset_id", F.lit(dataset_id)).select(
        "event_id", "dataset_id", "property_id", "listing_id", "event_type", "event_at", "confidence", "title", "summary",
        "previous_value", "current_value", "rule_version", "dedupe_key")


def evidence_table(events: DataFrame) -> DataFrame:
    """Exactly one evidence row per event."""
    return events.select(
        "event_id", "previous_snapshot_id", "current_snapshot_id", "run_id", "evidence_type",
        F.col("summary").alias("explanation"), "metadata")


def apply_reviews(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Attach the latest review and the latest dismissal; events are never deleted.

    ``reviews`` has event_id, action (reviewed/dismissed), actor, at, note.  An action
    only counts for an event of its own dataset when both sides name one.
    """
    keys = ["event_id"]
    if "dataset_id" in events.columns and "dataset_id" in reviews.columns:
        keys = ["event_id", "dataset_id"]

    def last(action: str) -> Column:
        mine = F.col("action") == action
        return F.max_by(F.struct("at", "actor", "note"), F.when(mine, F.struct("at", "actor")))

    latest = reviews.groupBy(*keys).agg(
        last("reviewed").alias("r"), last("dismissed").alias("d"))
    return events.join(latest, keys, "left").withColumns({
        "is_reviewed": F.col("r").isNotNull(),
        "reviewed_at": F.col("r.at"), "reviewed_by": F.col("r.actor"),
        "dismissed_at": F.col("d.at"), "dismissal_reason": F.col("d.note"),
    }).drop("r", "d")


def review_audit(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """One audit row per review action on an existing event."""
    known = reviews.join(events.select("event_id"), "event_id", "left_semi")
    return known.select(
        F.col("actor").alias("actor_user_id"),
        F.concat(F.lit("event."), F.col("action")).alias("action"),
        F.lit("event").alias("target_type"), F.col("event_id").cast("string").alias("target_id"),
        F.col("at").alias("created_at"),
        F.when(F.col("note").isNotNull(), F.to_json(F.struct("note"))).otherwise("{}")
        .alias("metadata"))
