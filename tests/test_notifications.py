"""Notification counts against the pairs of rules and events they stand for."""

from collections import Counter

import duckdb

import registry
from tidewatch.operators import insights

FOLDER = "/root/testdata/sf0.001"
KINDS, SURE = ("price_changed", "listing_created", "source_error"), ("low", "medium", "high")


def tables(spark):
    events = [(1 + k % 2, KINDS[k % 3], SURE[k % 5 % 3], None if k % 11 == 0 else k % 7) for k in range(120)]
    rules = [(k, 1 + k % 2, [KINDS[k % 3], KINDS[k % 3], KINDS[(k + 1) % 3]][: 1 + k % 3], SURE[k % 3],
              None if k % 2 else k % 4, k % 13 != 0) for k in range(60)]
    items = [(k % 4, k % 9) for k in range(20)]
    return (spark.createDataFrame(events, "dataset_id int, event_type string, confidence string, property_id int"),
            spark.createDataFrame(rules, "rule_id int, dataset_id int, event_types array<string>, "
                                         "minimum_confidence string, watchlist_id int, enabled boolean"),
            spark.createDataFrame(items, "watchlist_id int, property_id int"))


def test_counts_are_those_of_the_pairs(spark):
    events, rules, items = tables(spark)
    for listed in (items, None):
        pairs = Counter(r.rule_id for r in insights.notifications(events, rules, listed).collect())
        got = {r.rule_id: r.hits for r in insights.notification_counts(events, rules, listed).collect()}
        assert got == dict(pairs) and len(got) > 10
    assert insights.notification_counts(events.limit(0), rules, items).count() == 0


def test_the_query_makes_no_pairs_and_says_what_its_sql_says(spark, monkeypatch):
    monkeypatch.setattr(insights, "notifications", None)
    registry.load()
    got = sorted(tuple(r) for r in registry.QUERIES["notifications"](spark, FOLDER).collect())
    duck = duckdb.connect()
    for table in ("events", "customer", "part"):
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    assert got == sorted(duck.execute(registry.SQL["notifications"]).fetchall()) and got


def test_every_event_is_matched_with_every_kind_of_rule(spark, monkeypatch):
    """Pairs of events and kinds, opened to the rules of a kind, are the pairs of events and rules."""
    events, rules, items = tables(spark)
    events = events.selectExpr("*", "monotonically_increasing_id() AS event_id").localCheckpoint()
    for limit in (100_000, 0):
        monkeypatch.setattr(insights, "BROADCAST_RULES", limit)
        for listed in (items, None):
            pairs, members = insights.notification_classes(events, rules, listed)
            opened = pairs.join(members, "kind").select("rule_id", "event_id", "event_type")
            whole = insights.notifications(events, rules, listed).select("rule_id", "event_id", "event_type")
            assert sorted(opened.collect()) == sorted(whole.collect())
            assert members.select("kind").distinct().count() < members.count()


def test_counts_come_from_the_matched_events(spark, monkeypatch):
    events, rules, items = tables(spark)
    seen, matched = [], insights._matched
    monkeypatch.setattr(insights, "_matched", lambda e, *rest: (seen.append(e.count()), matched(e, *rest))[1])
    assert insights.notification_counts(events, rules, items).count() > 10
    assert seen == [events.count()]
