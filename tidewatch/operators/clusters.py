"""Map clusters by pixel radius, zoom by zoom.

On the highest zoom the points, rounded for display, are taken in the order of a hash of their
ids: a point that no cluster holds yet opens one and takes all free points within ``RADIUS``
pixels.  Each lower zoom does the same with the clusters of the zoom above.  That order would be
one long loop; here it runs in rounds: every place none of whose free neighbours comes before
it opens a cluster at once, its neighbours leave, and the rest goes on.  The result is that of
the loop, and with hashed order the rounds grow with the logarithm of the places.

Work is bounded wherever points crowd: points on one rounded place are counted first, and
clusters of a zoom open at least ``RADIUS`` apart, so each has a few neighbours on the next.
Places meet through cells of one radius and the eight around, so no tile is computed as a whole.

Longitudes do not wrap at the date line; latitudes beyond the Mercator square lie on its edge.
Points without an id or without two valid coordinates are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.places import round_coordinate, valid_point
from tidewatch.session import cut_lineage

TILE, RADIUS, TOP_ZOOM = 512, 50.0, 14
EDGE = 85.0511287798066  # latitude of the Mercator square's edge


def mercator(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Places on the unit square, north at 0."""
    sine = F.sin(F.radians(F.least(F.greatest(latitude, F.lit(-EDGE)), F.lit(EDGE))))
    return longitude / 360 + 0.5, F.lit(0.5) - F.log((1 + sine) / (1 - sine)) / (4 * math.pi)


def places(points: DataFrame, key: str = "property_id") -> DataFrame:
    """One node per rounded place: least id, position, number of points, sums of positions."""
    x, y = mercator(F.col("__lat").cast("double"), F.col("__lng").cast("double"))
    return points.filter(valid_point("latitude", "longitude")).select(
        F.col(key).cast("long").alias("node"), round_coordinate("latitude").alias("__lat"),
        round_coordinate("longitude").alias("__lng")).dropna().groupBy(
        "__lat", "__lng").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("points")).select(
        "node", x.alias("x"), y.alias("y"), "points",
        (x * F.col("points")).alias("sum_x"), (y * F.col("points")).alias("sum_y"))


def neighbours(level: DataFrame, radius: float) -> DataFrame:
    """(node, earlier, rank): pairs within the radius, the rank being that of the earlier one."""
    rank = F.struct(F.xxhash64("node"), "node").alias("rank")
    cells = level.select("node", "x", "y", rank, F.floor(F.col("x") / radius).alias("cx"),
                         F.floor(F.col("y") / radius).alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                       for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = cells.withColumn("d", F.explode(around)).select(
        F.col("node").alias("earlier"), F.col("x").alias("ox"), F.col("y").alias("oy"),
        F.col("rank").alias("other_rank"), (F.col("cx") + F.col("d.i")).alias("cx"),
        (F.col("cy") + F.col("d.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return cells.join(other, ["cx", "cy"]).filter(
        (F.col("other_rank") < F.col("rank")) & (dx * dx + dy * dy <= radius * radius)).select(
        "node", "earlier", F.col("other_rank").alias("rank"))


def openers(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes that open a cluster: those no earlier opener is near to."""
    free, near, found = nodes.select("node"), pairs.select("node", "earlier"), None
    while True:
        opened = cut_lineage(free.join(near, "node", "left_anti"))
        found = opened if found is None else found.unionByName(opened)
        taken = near.join(opened.select(F.col("node").alias("earlier")), "earlier", "left_semi").select("node")
        free = cut_lineage(free.join(opened.unionByName(taken), "node", "left_anti"))
        if free.isEmpty():
            return found
        near = near.join(free, "node", "left_semi").join(
            free.select(F.col("node").alias("earlier")), "earlier", "left_semi")
        near = cut_lineage(near.select("node", "earlier"))


def clustered(level: DataFrame, zoom: int, radius: float = RADIUS) -> DataFrame:
    """Clusters of one zoom from the places or clusters of the zoom above."""
    pairs = cut_lineage(neighbours(level, radius / (TILE * 2.0 ** zoom)))
    opened = openers(level, pairs).select(F.col("node").alias("earlier"))
    # The earliest opener near a node holds it.  A node that opens has none before it.
    owner = pairs.join(opened, "earlier").groupBy("node").agg(F.min_by("earlier", "rank").alias("owner"))
    held = level.join(owner, "node", "left").withColumn("owner", F.coalesce("owner", "node"))
    own = F.col("node") == F.col("owner")
    return held.groupBy("owner").agg(
        F.max(F.when(own, F.col("x"))).alias("x"), F.max(F.when(own, F.col("y"))).alias("y"),
        *[F.sum(c).alias(c) for c in ("points", "sum_x", "sum_y")]).withColumnRenamed("owner", "node")


def radius_clusters(points: DataFrame, zooms: Iterable[int], key: str = "property_id",
                    radius: float = RADIUS) -> DataFrame:
    """zoom, cluster_id (id of the point that opened it), points, and the mean place of its points
    as latitude and longitude, for each of ``zooms`` (0 to ``TOP_ZOOM``)."""
    wanted = set(zooms)
    if not wanted or not wanted <= set(range(TOP_ZOOM + 1)):
        raise ValueError(f"zooms from 0 to {TOP_ZOOM} are needed")
    level, out = cut_lineage(places(points, key)), None
    for zoom in range(TOP_ZOOM, min(wanted) - 1, -1):
        level = cut_lineage(clustered(level, zoom, radius))
        if zoom in wanted:
            mean_x, mean_y = F.col("sum_x") / F.col("points"), F.col("sum_y") / F.col("points")
            latitude = F.degrees(F.atan(F.sinh((0.5 - mean_y) * (2 * math.pi))))
            found = level.select(F.lit(zoom).alias("zoom"), F.col("node").alias("cluster_id"), "points",
                                 latitude.alias("latitude"), ((mean_x - 0.5) * 360).alias("longitude"))
            out = found if out is None else out.unionByName(found)
    return out
