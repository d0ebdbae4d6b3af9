"""Figures over snapshots, runs and events: trends, summaries, daily views, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.constants import CONFIDENCES
from tidewatch.operators.scans import Scan, by_key, running
from tidewatch.session import cut_lineage


def overview_kpis(events: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """New, reactivated and changed listings, last healthy run and its age, per dataset."""
    kind = F.col("event_type")
    changes = ("price_changed", "rating_changed", "review_count_changed", "host_changed",
               "direct_channel_added")
    counted = events.groupBy("dataset_id").agg(
        F.count_if(kind == "listing_created").alias("new_listings"),
        F.count_if(kind == "listing_reactivated").alias("reactivated"),
        F.count_if(kind.isin(*changes)).alias("material_changes"))
    runs = health.filter(~F.col("degraded")).groupBy("dataset_id").agg(
        F.max("started_at").alias("last_successful_run"))
    age = (F.unix_micros(now) - F.unix_micros("last_successful_run")) / F.lit(3_600_000_000.0)
    return counted.join(runs, "dataset_id", "left").withColumn("freshness_hours", age)


def active_trend(snapshots: DataFrame, region: str = "region") -> DataFrame:
    """Active listings per day and region, with a total line per day (region NULL).

    Counts once per (day, region, listing), then sums; a listing has one region a day.
    """
    daily = snapshots.filter(F.col("observation_status") == "active").select(
        F.to_date("observed_at").alias("day"), F.col(region).alias("region"), "listing_id"
    ).distinct().groupBy("day", "region").agg(F.count(F.lit(1)).alias("active_listings"))
    total = daily.groupBy("day").agg(F.sum("active_listings").alias("active_listings"))
    return daily.unionByName(total.withColumn("region", F.lit(None).cast("string")))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per group from value counts, so equal values combine first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(
        *keys, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))

    def body(part: DataFrame, segment: str | None) -> DataFrame:
        return running(part, keys, ["__value"], [Scan("__cum", "sum", F.col("__n"))],
                       segment=segment)

    cumulative = by_key(counts, keys, ["__value"], body)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    lower = F.floor((F.col("__total") - 1) / 2)
    upper = F.floor(F.col("__total") / 2)
    at = lambda index: F.min(F.when(F.col("__cum") > index, F.col("__value")))
    return cumulative.join(totals, list(keys)).groupBy(*keys).agg(
        ((at(lower) + at(upper)) / 2).alias(name))


def area_table(snapshots: DataFrame, region: str = "region") -> DataFrame:
    """Per region: listings, active listings, median price and rating of active rows."""
    df = snapshots.withColumn("region", F.col(region))
    active = df.filter(F.col("observation_status") == "active")
    base = df.groupBy("region").agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if(F.col("observation_status") == "active").alias("active"))
    price = exact_median(active.withColumn("__p", F.col("price_amount").try_cast("double")),
                         ["region"], "__p", "median_price")
    rating = exact_median(active, ["region"], "rating", "median_rating")
    return base.join(price, "region", "left").join(rating, "region", "left").withColumn(
        "coverage", F.col("active") / F.col("listings"))


def run_summary(snapshots: DataFrame, events: DataFrame, rejections: DataFrame | None = None) -> DataFrame:
    """Per run: observations by outcome, events by kind, rejected rows, duration."""
    status, kind = F.col("observation_status"), F.col("event_type")
    seen = snapshots.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("observed"),
        F.count_if(status == "active").alias("active"),
        F.count_if(status.isin("source_error", "blocked")).alias("errors"),
        ((F.unix_micros(F.max("observed_at")) - F.unix_micros(F.min("observed_at")))
         / F.lit(1_000_000.0)).alias("duration_seconds"))
    raised = events.groupBy("run_id").agg(
        F.count_if(kind == "listing_created").alias("new"),
        F.count_if(kind.endswith("_changed")).alias("changed"),
        F.count_if(kind == "listing_suspected_inactive").alias("suspected"),
        F.count_if(kind == "listing_confirmed_inactive").alias("confirmed"))
    out = seen.join(raised, "run_id", "left")
    counts = ["new", "changed", "suspected", "confirmed"]
    if rejections is not None:
        out = out.join(rejections.groupBy("run_id").agg(
            F.count_distinct("row_number").alias("rejected")), "run_id", "left")
        counts.append("rejected")
    return out.fillna(0, counts)


def event_counts_daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("event_at").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("events"))


def region_summary(snapshots: DataFrame, region: str = "region") -> DataFrame:
    """Per region and day: snapshots, active share, average price and rating."""
    active = F.col("observation_status") == "active"
    return snapshots.groupBy(F.col(region).alias("region"),
                             F.to_date("observed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.count_if(active).alias("active"),
        F.avg(F.when(active, F.col("price_amount").try_cast("double"))).alias("average_price"),
        F.avg(F.when(active, F.col("rating"))).alias("average_rating"))


def overview_daily(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """Per dataset and day: snapshots, listings, active listings, events."""
    seen = snapshots.groupBy("dataset_id", F.to_date("observed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.count_if(F.col("observation_status") == "active").alias("active"))
    raised = events.groupBy("dataset_id", F.to_date("event_at").alias("day")).agg(
        F.count(F.lit(1)).alias("events"))
    return seen.join(raised, ["dataset_id", "day"], "full_outer").fillna(
        0, ["snapshots", "active", "events"])


def import_health(metrics: DataFrame) -> DataFrame:
    """Rejected share of each import's rows."""
    return metrics.withColumn("rejection_rate", F.coalesce(
        F.col("rejected") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))


def confidence_rank(c: Column) -> Column:
    names = F.array(*[F.lit(n) for n in CONFIDENCES])
    return F.array_position(names, c)


BROADCAST_RULES = 100_000
KIND = ["dataset_id", "event_type", "minimum_confidence", "watchlist_id"]


def _opened(rules: DataFrame) -> DataFrame:
    """Enabled rules, one row per event type."""
    return rules.filter("enabled").select(
        "rule_id", "dataset_id", "minimum_confidence", "watchlist_id",
        F.explode(F.array_distinct("event_types")).alias("event_type"))


def _matched(events: DataFrame, opened: DataFrame, items: DataFrame | None) -> DataFrame:
    """Every event with every opened rule it matches: type, confidence and scope."""
    sure = confidence_rank(F.col("confidence")) >= confidence_rank(F.col("minimum_confidence"))

    def few(table: DataFrame) -> bool:
        return table.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    general = opened.filter(F.col("watchlist_id").isNull())
    if few(general):
        general = F.broadcast(general)
    free = events.join(general, ["dataset_id", "event_type"]).filter(sure)
    if items is None:
        return free
    listed = opened.filter(F.col("watchlist_id").isNotNull()).join(
        items.select("watchlist_id", "property_id").distinct(), "watchlist_id")
    listed = F.broadcast(listed) if few(listed) else listed.hint("merge")
    scoped = events.join(listed, ["dataset_id", "event_type", "property_id"]).filter(sure)
    return free.unionByName(scoped.select(*free.columns))


def notifications(events: DataFrame, rules: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(rule, event) matches: type in the rule's list, confidence high enough, in scope.

    Rules are opened to one row per event type.  A rule with a watchlist is opened further
    to that list's properties, so it meets its events by property and nothing else.  Rules
    without one match every event of their type.  Both are broadcast while their counted
    number allows, so that no type's events are shuffled to one task.
    """
    return _matched(events, _opened(rules), items)


def notification_classes(events: DataFrame, rules: DataFrame,
                         items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The matches of ``notifications`` as pairs of an event and a kind of rule, and the rules of each kind.

    Opened rules equal in dataset, event type, minimum confidence and watchlist match the same events.
    They are one kind, with a number ``kind``; every event meets every kind.
    """
    opened = _opened(rules)
    kinds = cut_lineage(opened.select(*KIND).distinct().withColumn("kind", F.monotonically_increasing_id()))
    named = kinds.select("kind", *[F.col(c).alias(f"__{c}") for c in KIND])
    if kinds.count() <= BROADCAST_RULES:
        named = F.broadcast(named)
    same = F.lit(True)
    for c in KIND:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return _matched(events, kinds, items), opened.join(named, same).select("rule_id", "kind")


def notification_counts(events: DataFrame, rules: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Matches of ``notifications`` per rule (rule_id, hits), rules without one left out.

    Every event is matched with every kind of rule; a rule has the matches of its kinds.
    """
    pairs, members = notification_classes(events, rules, items)
    hits = cut_lineage(pairs.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
    if hits.count() <= BROADCAST_RULES:
        hits = F.broadcast(hits)
    return members.join(hits, "kind").groupBy("rule_id").agg(F.sum("n").alias("hits"))


def extra_degradations(observations: DataFrame, fields: Sequence[str],
                       min_region_ratio: float = 0.5, min_presence_ratio: float = 0.5) -> DataFrame:
    """Further signs of a poor run against the run before it, one row per finding.

    region_coverage_collapse: a region's observations fell below the ratio;
    required_field_disappeared: a field's share of presence did;
    parser_changed: the run used another parser version.
    """
    by_run = observations.groupBy("source_key", "run_id").agg(
        F.min("observed_at").alias("started_at"), F.count(F.lit(1)).alias("__n"),
        F.max("parser_version").alias("parser"),
        *[F.count_if(F.col("field_presence")[f]).alias(f"__f_{f}") for f in fields])
    along = Window.partitionBy("source_key").orderBy("started_at", "run_id")
    runs = by_run.withColumn("previous_run", F.lag("run_id").over(along)).withColumn(
        "__parser", F.lag("parser").over(along))
    changed = runs.filter(F.col("parser") != F.col("__parser")).select(
        "source_key", "run_id", F.lit("parser_changed").alias("reason"),
        F.col("parser").alias("subject"))
    lost = None
    for f in fields:
        share = F.col(f"__f_{f}") / F.col("__n")
        before = F.lag(share).over(along)
        part = by_run.withColumns({"__share": share, "__was": before}).filter(
            F.col("__share") < F.col("__was") * min_presence_ratio).select(
            "source_key", "run_id", F.lit("required_field_disappeared").alias("reason"),
            F.lit(f).alias("subject"))
        lost = part if lost is None else lost.unionByName(part)
    regions = observations.filter(F.col("region").isNotNull()).groupBy(
        "source_key", "run_id", "region").agg(F.count(F.lit(1)).alias("__c"))
    order = runs.select("source_key", "run_id", "previous_run").filter(
        F.col("previous_run").isNotNull())
    earlier = regions.select("source_key", F.col("run_id").alias("previous_run"), "region",
                             F.col("__c").alias("__was"))
    now = order.join(earlier, ["source_key", "previous_run"]).join(
        regions, ["source_key", "run_id", "region"], "left").fillna(0, ["__c"])
    collapsed = now.filter(F.col("__c") < F.col("__was") * min_region_ratio).select(
        "source_key", "run_id", F.lit("region_coverage_collapse").alias("reason"),
        F.col("region").alias("subject"))
    return changed.unionByName(lost).unionByName(collapsed)


def import_deltas(snapshots: DataFrame, diffs: DataFrame, events: DataFrame) -> DataFrame:
    """Per run: listings created, updated, unchanged, and events raised."""
    changed = diffs.select("snapshot_id").distinct().withColumn("__changed", F.lit(True))
    created = events.filter(F.col("event_type") == "listing_created").select(
        F.col("current_snapshot_id").alias("snapshot_id"), F.lit(True).alias("__created"))
    marked = snapshots.select("snapshot_id", "run_id").join(
        changed, "snapshot_id", "left").join(created, "snapshot_id", "left").fillna(
        False, ["__changed", "__created"])
    is_new, is_changed = F.col("__created"), F.col("__changed")
    deltas = marked.groupBy("run_id").agg(
        F.count_if(is_new).alias("created"),
        F.count_if(~is_new & is_changed).alias("updated"),
        F.count_if(~is_new & ~is_changed).alias("unchanged"))
    raised = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"))
    return deltas.join(raised, "run_id", "left").fillna(0, ["events"])


def rich_filter(properties: DataFrame, *, status: Sequence[str] = (), min_rating=None,
                max_rating=None, min_price=None, max_price=None, min_bedrooms=None,
                has_channel: bool | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Property list by ranges, presence and region subtree; predicates reach the scan."""
    df = properties
    if status:
        df = df.filter(F.col("lifecycle_status").isin(list(status)))
    for column, low, high in (("rating", min_rating, max_rating),
                              ("price", min_price, max_price),
                              ("bedrooms", min_bedrooms, None)):
        if low is not None:
            df = df.filter(F.col(column) >= low)
        if high is not None:
            df = df.filter(F.col(column) <= high)
    if has_channel is not None:
        channel = (F.col("official_website").isNotNull() | F.col("business_whatsapp").isNotNull()
                   | F.col("direct_booking_url").isNotNull())
        df = df.filter(channel if has_channel else ~channel)
    if regions is not None:
        df = df.join(regions.select("region_id"), "region_id", "left_semi")
    return df
