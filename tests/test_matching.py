"""The similarity join over all properties against comparing every pair."""

import math
import random

import pytest

from tidewatch.operators import matching

SCHEMA = ("property_id long, dataset_id int, name string, latitude double, longitude double, "
          "official_website string, business_whatsapp string, bedrooms int")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def metres(a, b):
    (la, na), (lb, nb) = (map(math.radians, p) for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((nb - na) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def normal(name):
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (name or "").lower()).split())


def expected(rows, min_score, limit):
    out = []
    for r in rows:
        scored = []
        for o in rows:
            if o[0] == r[0] or o[1] != r[1]:
                continue
            a, b = normal(r[2]), normal(o[2])
            similar = 1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0
            away = None
            if None not in (*r[3:5], *o[3:5]):
                away = metres(r[3:5], o[3:5])
            score = similar if away is None else 0.7 * similar + 0.3 * max(0.0, 1 - away / 5000)
            if score >= min_score:
                scored.append((-score, o[0]))
        out += [(r[0], c, k + 1, round(-s, 9)) for k, (s, c) in enumerate(sorted(scored)[:limit])]
    return sorted(out)


def properties(seed):
    rng = random.Random(seed)
    stems = ["villa ubud", "casa del mar", "ab", "x", "", "Ménage", "rumah kecil di pantai", "villa ubed", "casa de mar"]
    corners = [(-8.5, 115.2), (0.0, 179.999), (0.0, -179.999), (89.99, 10.0), (89.99, -170.0), (-89.995, 0.0), (60.0, 25.0)]
    rows = []
    for k in range(160):
        name = list(rng.choice(stems) + rng.choice(["", " 1", " 22", "!"]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if name:
                name[rng.randrange(len(name))] = rng.choice("abcxyz ")
        lat, lng = rng.choice(corners)
        lat = max(-90.0, min(90.0, lat + rng.choice([0, 0.004, 0.02, 0.06]) * rng.uniform(-1, 1)))
        lng += rng.choice([0, 0.004, 0.02, 0.06]) * rng.uniform(-1, 1)
        place = rng.choice([(lat, lng), (lat, lng), (lat, lng), (None, lng), (None, None)])
        rows.append((k, rng.choice([1, 1, 2]), rng.choice(["".join(name), "".join(name), None]), *place,
                     rng.choice([None, "http://a.example/x", "https://www.A.example"]),
                     rng.choice([None, "+1 2", "12"]), rng.choice([None, 1, 2])))
    # One spot with more properties than a list offers, and exact ties.
    rows += [(1000 + k, 1, "Same Name", -8.0, 115.0, None, None, 1) for k in range(15)]
    return rows


@pytest.mark.parametrize("min_score, limit", [(0.8, 3), (0.72, 100), (0.5, 4), (0.95, 10)])
def test_all_candidates_are_those_of_all_pairs(spark, min_score, limit):
    rows = properties(round(min_score * 100))
    got = matching.all_candidates(spark.createDataFrame(rows, SCHEMA).repartition(3), min_score, limit)
    assert sorted((r.property_id, r.candidate_id, r.rank, round(r.score, 9)) for r in got.collect()) == expected(
        rows, min_score, limit)


def test_reasons_of_both_sides(spark):
    rows = [(1, 1, "Villa A", 1.0, 1.0, "http://x.example/1", "+1 23", 2),
            (2, 1, "villa a", 1.0, 1.0, "https://www.X.example/2", "1-23", 2),
            (3, 1, "Villa A.", 1.02, 1.0, None, "", None)]
    got = matching.candidates_with_reasons(spark.createDataFrame(rows, SCHEMA), 0.8, 5).collect()
    assert {(r.property_id, r.candidate_id): r.reasons for r in got} == {
        (1, 2): ["similar_name", "near", "same_domain", "same_phone", "same_bedrooms"],
        (2, 1): ["similar_name", "near", "same_domain", "same_phone", "same_bedrooms"],
        (1, 3): ["similar_name"], (2, 3): ["similar_name"], (3, 1): ["similar_name"], (3, 2): ["similar_name"]}


def test_scores_that_every_near_pair_reaches_are_refused(spark):
    with pytest.raises(ValueError):
        matching.all_candidates(spark.createDataFrame([], SCHEMA), 0.3)
    assert matching.all_candidates(spark.createDataFrame([], SCHEMA), 0.8).count() == 0


def test_few_names_at_many_places_are_those_of_all_pairs(spark, monkeypatch):
    """Names and places meet once each; ties at equal distance and full spots keep their order."""
    rng = random.Random(5)
    names = ["red bolt", "red rod", "old bolt", "cold bolt", "new gear", ""]
    rows = [(k, 1 + k % 2, rng.choice(names), *rng.choice([(-8.0 + k % 9 / 250, 115 + k % 7 / 90), (None, 115.0)]),
             None, None, 1) for k in range(300)]
    rows += [(500 + k, 1, "red bolt", -8.0, 115.0, None, None, 1) for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for min_score, limit in ((0.75, 4), (0.6, 7)):
        monkeypatch.setattr(matching, "FEW_NAMES", 64)
        # The tiles where every near pair of spots is made are not used.
        with monkeypatch.context() as m:
            m.setattr(matching, "spot_pairs", None)
            got = matching.all_candidates(df, min_score, limit).collect()
        assert sorted((r.property_id, r.candidate_id, r.rank, round(r.score, 9)) for r in got) == expected(
            rows, min_score, limit)
        monkeypatch.setattr(matching, "FEW_NAMES", 0)
        assert sorted(matching.all_candidates(df, min_score, limit).collect()) == sorted(got)


def test_only_counted_tables_are_broadcast(spark, monkeypatch):
    """Tables over their limits join by sorting, however small Spark takes them to be."""
    for limit in ("BROADCAST_GRAMS", "BROADCAST_ROWS", "BROADCAST_SPOTS"):
        monkeypatch.setattr(matching, limit, 0, raising=False)
    rows = properties(7)[:120]
    df = spark.createDataFrame(rows, SCHEMA)
    ran = spark._jsparkSession.sharedState().statusStore()
    for few in (0, 10_000):
        monkeypatch.setattr(matching, "FEW_NAMES", few)
        before = ran.executionsCount()
        got = matching.candidates_with_reasons(df, 0.75, 4).collect()
        after = ran.executionsCount()
        plans = [ran.executionsList().apply(i).physicalPlanDescription() for i in range(before, after)]
        assert any("SortMergeJoin" in p for p in plans)
        assert not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)
        assert sorted((r.property_id, r.candidate_id, r.rank, round(r.score, 9)) for r in got) == expected(rows, 0.75, 4)
