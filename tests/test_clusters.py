"""Radius clusters against the plain loop."""

import math
import random

import pytest
import xxhash

from tidewatch.operators import clusters


def ordered(node):
    value = xxhash.xxh64(node.to_bytes(8, "little", signed=True), seed=42).intdigest()
    return (value - (1 << 64) if value >> 63 else value, node)


def plain(points, zooms, radius):
    """{zoom: {opener: number of points}} by one loop per zoom."""
    by_place = {}
    for node, lat, lng in points:
        if None not in (node, lat, lng) and abs(lat) <= 90 and abs(lng) <= 180:
            by_place.setdefault((round(lat, 3), round(lng, 3)), []).append(node)
    level = []
    for (lat, lng), nodes in by_place.items():
        sine = math.sin(math.radians(max(-clusters.EDGE, min(clusters.EDGE, lat))))
        level.append((min(nodes), lng / 360 + 0.5,
                      0.5 - math.log((1 + sine) / (1 - sine)) / (4 * math.pi), len(nodes)))
    out = {}
    for zoom in range(clusters.TOP_ZOOM, min(zooms) - 1, -1):
        reach, made, taken = radius / (clusters.TILE * 2.0 ** zoom), [], set()
        level.sort(key=lambda n: ordered(n[0]))
        for node, x, y, _ in level:
            if node in taken:
                continue
            near = [n for n in level if n[0] not in taken and (n[1] - x) ** 2 + (n[2] - y) ** 2 <= reach ** 2]
            taken.update(n[0] for n in near)
            made.append((node, x, y, sum(n[3] for n in near)))
        level = made
        out[zoom] = {n[0]: n[3] for n in level}
    return {z: out[z] for z in zooms}


SCHEMA = "property_id long, latitude double, longitude double"


def test_clusters_equal_the_loop(spark):
    rng = random.Random(4)
    points = [(k, rng.gauss(-8.65, 0.05), rng.gauss(115.1, 0.05)) for k in range(500)]
    points += [(1000 + k, -8.5, 115.2) for k in range(40)]  # one crowded place
    points += [(2000 + k, -8.6, 115.0 + 0.001 * k) for k in range(60)]  # a chain of neighbours
    points += [(3000, 89.9, 10.0), (3001, -89.9, 10.0), (3002, None, 1.0), (None, 1.0, 1.0), (3003, 0.0, None),
               (3004, float("nan"), 1.0), (3005, 1.0, float("inf")), (3006, 95.0, 1.0)]
    zooms = (14, 12, 11)
    got = {z: {} for z in zooms}
    for r in clusters.radius_clusters(spark.createDataFrame(points, SCHEMA), zooms).collect():
        got[r.zoom][r.cluster_id] = r.points
    assert got == plain(points, zooms, clusters.RADIUS)
    assert all(sum(found.values()) == 602 for found in got.values())


def test_means_and_edges(spark):
    twin = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.0), (3, -40.0, 20.0)], SCHEMA)
    rows = {r.points: r for r in clusters.radius_clusters(twin, [14]).collect()}
    assert rows[2].cluster_id == 1 and abs(rows[2].latitude - 10) < 1e-9 and abs(rows[2].longitude - 20) < 1e-9
    assert clusters.radius_clusters(twin.limit(0), [14]).count() == 0
    for bad in ([], [15], [-1]):
        with pytest.raises(ValueError):
            clusters.radius_clusters(twin, bad)
