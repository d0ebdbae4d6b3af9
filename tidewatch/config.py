"""Versioned rules. Every judged row carries the version it was judged under."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Materiality:
    version: str = "field-diff:v1"
    price_percent: float = 0.05
    price_absolute: float | None = None
    rating: float = 0.05
    review_count: float = 1


@dataclass(frozen=True)
class LifecycleRules:
    version: str = "lifecycle-state:v1"
    suspected_min_misses: int = 2
    suspected_min_hours: float = 24
    suspected_min_runs: int = 2
    confirmed_min_misses: int = 3
    confirmed_min_days: float = 7
    count_unavailable: bool = True
    # Policy switch: a direct not_found counts as high-confidence evidence.
    direct_not_found_is_high_confidence: bool = False


@dataclass(frozen=True)
class RunHealth:
    version: str = "run-health:v1"
    min_valid_ratio: float = 0.7
    max_error_rate: float = 0.15
    max_blocked_rate: float = 0.05


@dataclass(frozen=True)
class Coverage:
    lat_min: float = -9.2
    lat_max: float = -8.0
    lng_min: float = 114.4
    lng_max: float = 115.8


@dataclass(frozen=True)
class Planner:
    max_span: float = 0.03
    max_divisions: int = 8


def versioned(base, **overrides):
    """Override a rule set; a changed rule set must carry its own version."""
    known = {f.name for f in fields(base)}
    unknown = set(overrides) - known
    if unknown:
        raise ValueError(f"unknown rule(s): {', '.join(sorted(unknown))}")
    changed = {k: v for k, v in overrides.items() if getattr(base, k) != v}
    if changed and overrides.get("version", base.version) == base.version:
        raise ValueError("changed rules need a new version")
    return type(base)(**{**base.__dict__, **overrides})


def rules_from_json(text: str) -> tuple[Materiality, LifecycleRules, RunHealth]:
    """Read one source's rule file (percent thresholds are whole percents)."""
    doc = json.loads(text)
    version = doc["rule_version"]
    life, cover, mat = doc["lifecycle"], doc["coverage"], doc["materiality"]
    suspected, confirmed = life["suspected_inactive"], life["confirmed_inactive"]
    return (
        Materiality(
            version=version,
            price_percent=mat["price_percent"] / 100.0,
            rating=mat["rating_absolute"],
            review_count=mat["review_count_visible_increment"],
        ),
        LifecycleRules(
            version=version,
            suspected_min_misses=suspected["minimum_consecutive_qualifying_misses"],
            suspected_min_hours=suspected["minimum_elapsed_hours"],
            confirmed_min_misses=confirmed["minimum_consecutive_qualifying_misses"],
            confirmed_min_days=confirmed["minimum_elapsed_days"],
        ),
        RunHealth(
            version=version,
            min_valid_ratio=cover["minimum_ratio_for_healthy_full_run"],
            max_error_rate=cover["maximum_source_error_ratio"],
            max_blocked_rate=cover["maximum_blocked_ratio"],
        ),
    )
