"""Distances, boxes, polygons and the spatial join, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.7714
EDGE_TOLERANCE = 1e-10
Point = tuple[float, float]


def haversine_m(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    a = F.sin(F.radians(lat - lat0) / 2) ** 2 + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * F.sin(F.radians(lon - lon0) / 2) ** 2
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def within_radius(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    """At most `metres` away; rows without a place are outside. The latitude band prunes first."""
    band = metres / EARTH_RADIUS_M * 57.29577951308232 + 1e-9
    return F.coalesce(lat.between(lat0 - band, lat0 + band) & (haversine_m(lat, lon, lat0, lon0) <= metres), F.lit(False))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside or on the edge; a box with west > east crosses the date line."""
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return F.coalesce((lat >= south) & (lat <= north) & across, F.lit(False))


def unwrapped(ring: list[Point]) -> list[Point]:
    """(lon, lat) vertices without the closing one, longitudes free of jumps at the date line."""
    ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    out = ring[:1]
    for lon, lat in ring[1:]:
        before = out[-1][0]
        out.append((lon - 360 * round((lon - before) / 360), lat))
    return out


def in_polygon(lat: Column, lon: Column, ring: list[Point]) -> Column:
    """Even-odd rule, edges and vertices inside."""
    vertices = unwrapped(ring)
    middle = sum(x for x, _ in vertices) / len(vertices)
    x = lon - 360 * F.rint((lon - middle) / 360)
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        cross = (x - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        near = x.between(min(x1, x2) - EDGE_TOLERANCE, max(x1, x2) + EDGE_TOLERANCE) & lat.between(min(y1, y2) - EDGE_TOLERANCE, max(y1, y2) + EDGE_TOLERANCE)
        on_edge = on_edge | (near & (F.abs(cross) <= EDGE_TOLERANCE))
        if y1 != y2:
            low, high = min(y1, y2), max(y1, y2)
            at = (x2 - x1) * (lat - y1) / (y2 - y1) + x1
            crossings = crossings + F.when((lat > low) & (lat <= high) & (x < at), 1).otherwise(0)
    return F.coalesce(on_edge | (crossings % 2 == 1), F.lit(False))


def _meet(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two closed edges share a point: crossing, touching or lying on each other."""

    def side(p: Point, q: Point, r: Point) -> float:
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    apart = any(max(a[i], b[i]) < min(c[i], d[i]) or max(c[i], d[i]) < min(a[i], b[i]) for i in (0, 1))
    return not apart and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def polygon_problem(ring: list[Point]) -> str | None:
    """Why a ring is no usable polygon, or None: too_few_points, repeated_points, too_wide, self_intersection (edges that
    are no neighbours cross or touch), no_area."""
    v = unwrapped(ring)
    n = len(v)
    if len(set(v)) < 3:
        return "too_few_points"
    if len(set(v)) < n:
        return "repeated_points"
    if max(x for x, _ in v) - min(x for x, _ in v) > 180:
        return "too_wide"
    if any(_meet(v[i], v[(i + 1) % n], v[k], v[(k + 1) % n]) for i in range(n) for k in range(i + 2, n) if (k + 1) % n != i):
        return "self_intersection"
    area = sum(v[i][0] * v[(i + 1) % n][1] - v[(i + 1) % n][0] * v[i][1] for i in range(n))
    return None if abs(area) > 1e-12 else "no_area"


def in_ring(lat: Column, lon: Column, edges: Column) -> Column:
    """in_polygon for a column of edges (structs of x1, y1, x2, y2)."""

    def on(e: Column) -> Column:
        cross = (lon - e["x1"]) * (e["y2"] - e["y1"]) - (lat - e["y1"]) * (e["x2"] - e["x1"])
        near = lon.between(F.least(e["x1"], e["x2"]) - EDGE_TOLERANCE, F.greatest(e["x1"], e["x2"]) + EDGE_TOLERANCE) & lat.between(F.least(e["y1"], e["y2"]) - EDGE_TOLERANCE, F.greatest(e["y1"], e["y2"]) + EDGE_TOLERANCE)
        return near & (F.abs(cross) <= EDGE_TOLERANCE)

    def crossed(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.when((lat > F.least(e["y1"], e["y2"])) & (lat <= F.greatest(e["y1"], e["y2"])) & (lon < at), 1).otherwise(0)

    return F.exists(edges, on) | (F.aggregate(edges, F.lit(0), lambda n, e: n + crossed(e)) % 2 == 1)


def area_table(spark: SparkSession, areas: dict[str, list[Point]]) -> DataFrame:
    """area, edges of named rings."""
    rows = []
    for name, ring in areas.items():
        v = unwrapped(ring)
        rows.append((name, [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(v, v[1:] + v[:1], strict=True)]))
    return spark.createDataFrame(rows, "area string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def spatial_join(points: DataFrame, key: str, lat: str, lon: str, areas: DataFrame, cell: float = 0.25) -> DataFrame:
    """key, area, status for each point: matched, unmatched, ambiguous (several areas, as on a shared edge; area is
    null), missing_geometry or invalid_geometry. areas: area, edges (see area_table), as many as there are.

    Points meet the areas whose box touches their grid cell of `cell` degrees; the exact test follows. Longitudes are
    compared as they are: areas across the date line are given in both writings.
    """

    def bound(pick: Callable[[Column], Column], of: Callable[[Column], Column], step: int) -> Column:
        return (F.floor(of(F.transform("edges", pick)) / cell) + step).cast("long")  # a cell more on either side, for edges on a border

    columns = F.explode(F.sequence(bound(lambda e: e["x1"], F.array_min, -1), bound(lambda e: e["x1"], F.array_max, 1)))
    rows = F.explode(F.sequence(bound(lambda e: e["y1"], F.array_min, -1), bound(lambda e: e["y1"], F.array_max, 1)))
    boxes = areas.select("area", "edges", columns.alias("cx")).select("area", "edges", "cx", rows.alias("cy"))
    own = points.select(key, F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    sound = own.where(F.col("y").between(-90, 90) & F.col("x").between(-180, 180))
    placed = sound.withColumns({"px": F.floor(F.col("x") / cell), "py": F.floor(F.col("y") / cell)})
    hits = placed.join(boxes, (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy"))).where(in_ring(F.col("y"), F.col("x"), F.col("edges")))
    found = hits.groupBy(F.col(key).alias("hit_key")).agg(F.min("area").alias("area"), F.countDistinct("area").alias("n_areas"))
    status = (
        F.when(F.col("y").isNull() | F.col("x").isNull(), "missing_geometry").when(~(F.col("y").between(-90, 90) & F.col("x").between(-180, 180)), "invalid_geometry")
        .when(F.col("n_areas").isNull(), "unmatched").when(F.col("n_areas") == 1, "matched").otherwise("ambiguous")
    )
    out = own.join(found, F.col(key) == F.col("hit_key"), "left").withColumn("status", status)
    return out.select(key, F.when(F.col("status") == "matched", F.col("area")).alias("area"), "status")
