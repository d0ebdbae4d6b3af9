"""Comparable predecessors and field-by-field differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Materiality
from tidewatch.constants import SNAPSHOT_FIELDS
from tidewatch.functions.text import num_text, parse_number
from tidewatch.operators.scans import Scan, by_key, micros, running

EPSILON = 1e-9
IDS = ("listing_id", "snapshot_id", "run_id", "observed_at")


def _json_text(c: Column) -> Column:
    """JSON form of a text value (a one-element array without its brackets)."""
    encoded = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(encoded, 2, F.length(encoded) - 2))


def _comparable(name: str, kind: str) -> Column:
    """(present, key, number, stored) of one field of a snapshot row."""
    number = F.lit(None).cast("double")
    if name in ("title", "description", "photos"):
        key = F.col(f"{name}_hash")
        stored = _json_text(key)
    elif kind == "set":
        key, stored = F.col("amenities_hash"), F.to_json("amenities")
    elif kind == "location":
        both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        lat, lng = num_text("latitude"), num_text("longitude")
        key = F.when(both, F.concat(lat, F.lit(","), lng))
        stored = F.when(both, F.concat(
            F.lit('{"latitude":'), lat, F.lit(',"longitude":'), lng, F.lit("}")))
    elif kind == "scalar_number":
        number = F.col(name).cast("double")
        key = stored = num_text(number)
    elif kind == "money":
        amount = F.col("price_amount").cast("string")
        key = F.when(amount.isNotNull(), F.concat_ws("|", "price_currency", "price_unit"))
        number = parse_number(amount)
        stored = F.when(amount.isNotNull(), F.concat(
            F.lit('{"amount":"'), amount, F.lit('","currency":"'), F.col("price_currency"),
            F.lit('","unit":"'), F.col("price_unit"), F.lit('"}')))
    elif kind == "boolean":
        key = stored = F.col(name).cast("string")
    else:
        key = F.col(name)
        stored = _json_text(key)
    present = F.coalesce(F.col("field_presence").getItem(name), F.lit(False))
    return F.struct(present.alias("present"), key.alias("key"), number.alias("number"),
                    stored.alias("stored"))


def _registry() -> Column:
    return F.struct(*[_comparable(n, k).alias(n) for n, k in SNAPSHOT_FIELDS])


def with_previous(
    snapshots: DataFrame,
    mode: str = "snapshot",
    parser_groups: dict[str, str] | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Attach the comparable predecessor of every snapshot.

    ``snapshot`` mode takes the latest strictly earlier snapshot of the listing with
    a compatible parser and a healthy run; ``field`` mode takes it per field, asking
    also that the field was collected.  A running maximum, so no self-join.
    ``parser_groups`` maps parser versions that may be compared to one group name.
    """
    df = snapshots
    if "run_degraded" not in df.columns:
        df = df.withColumn("run_degraded", F.lit(False))
    group = F.col("parser_version")
    for version, name in (parser_groups or {}).items():
        group = F.when(F.col("parser_version") == version, F.lit(name)).otherwise(group)
    df = df.withColumns({
        "__at": micros("observed_at"), "parser_group": group, "__now": _registry()})
    healthy = ~F.coalesce(F.col("run_degraded"), F.lit(False))
    if mode == "snapshot":
        candidate = F.struct("__at", "snapshot_id", F.col("__now").alias("fields"))
        scans = [Scan("__prev", "max", F.when(healthy, candidate), earlier=True)]
    elif mode == "field":
        scans = []
        for name, _ in SNAPSHOT_FIELDS:
            value = F.col("__now")[name]
            candidate = F.struct("__at", "snapshot_id", value.alias("value"))
            scans.append(Scan(f"__prev_{name}", "max",
                              F.when(healthy & value["present"], candidate), earlier=True))
    else:
        raise ValueError(f"unknown mode {mode!r}")

    def body(part: DataFrame, segment: str | None) -> DataFrame:
        return running(part, ["listing_id", "parser_group"], ["__at", "snapshot_id"], scans,
                       segment=segment)

    if sized_by is not None:
        sized_by = sized_by.withColumn("__at", micros("observed_at"))
    return by_key(df, ["listing_id"], ["__at"], body, sized_by)


def field_diffs(
    paired: DataFrame, rules: Materiality = Materiality(), rules_table: DataFrame | None = None
) -> DataFrame:
    """One row per changed field.  Rows multiply only after unchanged fields are dropped.

    ``rules_table`` (source_key, version, price_percent, price_absolute, rating,
    review_count; at most one row per source) overrides ``rules`` per source.
    """
    limits = {
        "version": F.lit(rules.version),
        "price_percent": F.lit(float(rules.price_percent)),
        "price_absolute": F.lit(rules.price_absolute).cast("double"),
        "rating": F.lit(float(rules.rating)),
        "review_count": F.lit(float(rules.review_count)),
    }
    if rules_table is not None:
        named = rules_table.select(
            "source_key", *[F.col(c).alias(f"__rule_{c}") for c in limits])
        paired = paired.join(named, "source_key", "left")
        limits = {c: F.coalesce(F.col(f"__rule_{c}"), v) for c, v in limits.items()}

    per_field = "__prev" not in paired.columns
    found = []
    for i, (name, kind) in enumerate(SNAPSHOT_FIELDS):
        if per_field:
            before, previous_id = F.col(f"__prev_{name}")["value"], F.col(
                f"__prev_{name}")["snapshot_id"]
        else:
            before, previous_id = F.col("__prev")["fields"][name], F.col("__prev")["snapshot_id"]
        found.append(_diff(i, name, kind, before, F.col("__now")[name], previous_id, limits))
    changes = F.filter(F.array(*found), lambda d: d.isNotNull())
    ids = [c for c in (*IDS, "dataset_id", "source_key", "property_id") if c in paired.columns]
    return (
        paired.select(*ids, limits["version"].alias("rule_version"), changes.alias("__d"))
        .filter(F.size("__d") > 0)
        .select(*ids, "rule_version", F.explode("__d").alias("d"))
        .select(*ids, "d.*", "rule_version")
    )


def _diff(order: int, name: str, kind: str, before: Column, now: Column, previous_id: Column,
          limits: dict[str, Column]) -> Column:
    compared = F.coalesce(before["present"] & now["present"], F.lit(False))
    was_absent, is_absent = before["key"].isNull(), now["key"].isNull()
    gained_or_lost = F.when(was_absent, "added").when(is_absent, "removed")
    none = F.lit(None).cast("double")
    if kind in ("scalar_number", "money"):
        delta = now["number"] - before["number"]
        percent = F.when(before["number"] != 0, delta / F.nullif(before["number"], F.lit(0.0)))
        change = gained_or_lost.when(delta > 0, "increased").when(delta < 0, "decreased")
        both = ~was_absent & ~is_absent
        if kind == "money":
            compared = compared & ~(both & (before["key"] != now["key"]))
            large = F.coalesce(F.abs(percent) + EPSILON >= limits["price_percent"], F.lit(False)) | (
                F.coalesce(F.abs(delta) + EPSILON >= limits["price_absolute"], F.lit(False)))
            material = F.when(both, large).otherwise(F.lit(True))
        else:
            if name == "rating":
                large = F.abs(delta) + EPSILON >= limits["rating"]
            elif name == "review_count":
                large = delta + EPSILON >= limits["review_count"]
            else:
                large = F.lit(True)
            material = F.when(both, large).otherwise(F.lit(False))
        changed = (was_absent != is_absent) | (both & F.coalesce(delta != 0, F.lit(False)))
        deltas = [F.when(both, delta), F.when(both, percent)]
    else:
        change = gained_or_lost.otherwise("changed")
        changed = ~before["key"].eqNullSafe(now["key"])
        material, deltas = F.lit(True), [none, none]
    return F.when(compared & changed, F.struct(
        previous_id.alias("previous_snapshot_id"),
        F.lit(order).alias("field_order"),
        F.lit(name).alias("field_name"),
        F.lit(kind).alias("field_kind"),
        change.alias("change_kind"),
        before["stored"].alias("previous_value"),
        now["stored"].alias("current_value"),
        deltas[0].alias("absolute_delta"),
        deltas[1].alias("percent_delta"),
        material.alias("is_material"),
    ))


def diff_list(diffs: DataFrame, snapshot: str) -> DataFrame:
    """Differences of one snapshot: material first, then by field name."""
    return diffs.filter(F.col("snapshot_id") == snapshot).orderBy(
        F.desc("is_material"), "field_name")


def diff_summary(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n_diffs"),
        F.count_if("is_material").alias("n_material"))
