"""Points, boxes, rings and polylines as column expressions.

Points are ``lon``/``lat`` doubles, vertices are ``struct<lon,lat>`` and a ring
or line is an array of vertices. Everything here stays inside codegen except
the array folds, which are still JVM higher-order functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii and metres per degree used for each family of distances.
MEAN_EARTH_RADIUS_M = 6371008.8
SPHERE_RADIUS_M = 6371000.0
M_PER_DEG_LON = 111320.0
M_PER_DEG_LAT = 110540.0
DEG = math.pi / 180.0


def haversine_m(lon1, lat1, lon2, lat2, radius: float = MEAN_EARTH_RADIUS_M) -> Column:
    """Great-circle metres. ``radius`` differs by caller, so it is an argument."""
    lon1, lat1, lon2, lat2 = (_col(c) for c in (lon1, lat1, lon2, lat2))
    half_dlat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def planar_m(lon1, lat1, lon2, lat2) -> Column:
    """Equirectangular metres around the mean latitude of the two points."""
    lon1, lat1, lon2, lat2 = (_col(c) for c in (lon1, lat1, lon2, lat2))
    kx = F.lit(M_PER_DEG_LON) * F.cos((lat1 + lat2) / 2 * DEG)
    return F.hypot((lon2 - lon1) * kx, (lat2 - lat1) * M_PER_DEG_LAT)


def segment_distance_m(lon, lat, a_lon, a_lat, b_lon, b_lat) -> Column:
    """Distance from a point to a segment on a flat projection at the point."""
    lon, lat, a_lon, a_lat, b_lon, b_lat = (_col(c) for c in (lon, lat, a_lon, a_lat, b_lon, b_lat))
    kx = F.lit(M_PER_DEG_LON) * F.cos(lat * DEG)
    ax, ay = (a_lon - lon) * kx, (a_lat - lat) * M_PER_DEG_LAT
    dx, dy = (b_lon - a_lon) * kx, (b_lat - a_lat) * M_PER_DEG_LAT
    len2 = dx * dx + dy * dy
    along = -(ax * dx + ay * dy) / F.when(len2 > 0, len2)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    return F.hypot(ax + t * dx, ay + t * dy)


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing in degrees clockwise from north, in [0, 360)."""
    lon1, lat1, lon2, lat2 = (_col(c) for c in (lon1, lat1, lon2, lat2))
    phi1, phi2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dlon) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def point_in_ring(lon, lat, ring) -> Column:
    """Even-odd crossing test; the ring may or may not repeat its first vertex."""
    lon, lat, ring = _col(lon), _col(lat), _col(ring)
    rotated = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def crosses(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.when(straddles, b["lat"] - a["lat"])
        return straddles & F.coalesce(lon < at, F.lit(False))

    edges = F.zip_with(ring, rotated, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.size(F.filter(edges, crosses)) % 2 == 1


def point_in_polygons(lon, lat, outer_rings) -> Column:
    """Inside any outer ring of a multipolygon; holes are ignored on purpose."""
    return F.exists(_col(outer_rings), lambda ring: point_in_ring(lon, lat, ring))


def path_length_m(line, box: tuple[float, float, float, float] | None = None) -> Column:
    """Polyline length. With ``box``, a leg counts in full with both ends inside,
    half with one end inside, not at all otherwise."""
    line = _col(line)

    def leg(a: Column, b: Column) -> Column:
        metres = haversine_m(a["lon"], a["lat"], b["lon"], b["lat"])
        if box is None:
            return metres
        ends = in_box(a["lon"], a["lat"], *box).cast("int") + in_box(b["lon"], b["lat"], *box).cast("int")
        return metres * ends / 2

    legs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), leg)
    return F.when(F.size(line) > 1, F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x)).otherwise(0.0)


def ring_centroid(ring) -> Column:
    """Mean vertex with the closing vertex dropped, as ``struct<lon,lat>``."""
    ring = _col(ring)
    closed = (F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    open_ring = F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    n = F.greatest(F.lit(1), F.size(open_ring))

    def mean(field: str) -> Column:
        return F.aggregate(open_ring, F.lit(0.0), lambda acc, p: acc + p[field]) / n

    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def round_ring(ring, decimals: int) -> Column:
    """Coordinates of a ring rounded half-even."""
    return F.transform(
        _col(ring),
        lambda p: F.struct(F.bround(p["lon"], decimals).alias("lon"), F.bround(p["lat"], decimals).alias("lat")),
    )


def in_box(lon, lat, min_lon, min_lat, max_lon, max_lat) -> Column:
    return _col(lon).between(min_lon, max_lon) & _col(lat).between(min_lat, max_lat)


def box_struct(min_lon, min_lat, max_lon, max_lat) -> Column:
    return F.struct(
        _col(min_lon).alias("min_lon"),
        _col(min_lat).alias("min_lat"),
        _col(max_lon).alias("max_lon"),
        _col(max_lat).alias("max_lat"),
    )


def box_valid(box: Column) -> Column:
    """Ordered corners inside the globe; a swapped pair fails here."""
    return (
        (box["min_lon"] >= -180) & (box["min_lon"] < box["max_lon"]) & (box["max_lon"] <= 180)
        & (box["min_lat"] >= -90) & (box["min_lat"] < box["max_lat"]) & (box["max_lat"] <= 90)
    )


def box_width(box: Column) -> Column:
    return box["max_lon"] - box["min_lon"]


def box_height(box: Column) -> Column:
    return box["max_lat"] - box["min_lat"]


def box_area(box: Column) -> Column:
    return box_width(box) * box_height(box)


def box_center(box: Column) -> Column:
    return F.struct(
        ((box["min_lon"] + box["max_lon"]) / 2).alias("lon"), ((box["min_lat"] + box["max_lat"]) / 2).alias("lat")
    )


def box_id(box: Column) -> Column:
    """Five decimals is about a metre, so equal tiles get equal ids."""
    return F.format_string("%.5f_%.5f_%.5f_%.5f", box["min_lon"], box["min_lat"], box["max_lon"], box["max_lat"])


def box_lat_first(box: Column) -> Column:
    """``south,west,north,east`` text."""
    return F.concat_ws(",", box["min_lat"], box["min_lon"], box["max_lat"], box["max_lon"])


def box_size_km(box: Column) -> Column:
    """East-west and north-south kilometres through the middle of the box."""
    mid = (box["min_lat"] + box["max_lat"]) / 2
    return F.struct(
        (haversine_m(box["min_lon"], mid, box["max_lon"], mid) / 1000).alias("ew_km"),
        (haversine_m(box["min_lon"], box["min_lat"], box["min_lon"], box["max_lat"]) / 1000).alias("ns_km"),
    )


def box_quarters(box: Column) -> Column:
    """The four quarters of a box: SW, SE, NW, NE."""
    c = box_center(box)
    return F.array(
        box_struct(box["min_lon"], box["min_lat"], c["lon"], c["lat"]),
        box_struct(c["lon"], box["min_lat"], box["max_lon"], c["lat"]),
        box_struct(box["min_lon"], c["lat"], c["lon"], box["max_lat"]),
        box_struct(c["lon"], c["lat"], box["max_lon"], box["max_lat"]),
    )


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, (int, float)):
        return F.lit(float(c))
    return F.col(c)
