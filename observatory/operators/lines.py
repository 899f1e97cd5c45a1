"""Polylines: sampling, resampling, positions and headings along a line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from observatory.functions import geo

TRAIL_SAMPLE_M = 150.0
STRETCH_M = 500.0


def leg_lengths(lon: np.ndarray, lat: np.ndarray, radius: float) -> np.ndarray:
    """Metres between neighbouring vertices on a sphere."""
    y = np.radians(lat)
    chord = np.sin(np.diff(y) / 2) ** 2 + np.cos(y[:-1]) * np.cos(y[1:]) * np.sin(np.radians(np.diff(lon)) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(1.0, chord)))


def vertices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines of a batch, and longitudes and latitudes of all their vertices."""
    values = column.values
    return column.offsets.to_numpy(), *(values.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("lon", "lat"))


def legs(lines: DataFrame, key: str = "line", radius: float = geo.SPHERE_RADIUS_M, coords: str = "coords") -> DataFrame:
    """One row per leg with its start and end distance along the line.

    A line is one cell of one row; its running distance is one pass over the
    vertices of an Arrow batch, so a line of a million vertices costs a thousand
    times one of a thousand.
    """
    keep = [f for f in lines.schema.fields if f.name != coords]
    ddl = "leg int, ax double, ay double, bx double, by double, c0 double, c1 double"
    schema = T.StructType([*keep, *T._parse_datatype_string(ddl).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, lon, lat = vertices(batch[coords])
            if len(lon) < 2:
                continue
            m = leg_lengths(lon, lat, radius)
            first, last = offsets[:-1], np.maximum(offsets[1:] - 1, offsets[:-1])
            n = last - first
            at = [np.cumsum(m[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True) if b > a]
            if not at:
                continue
            row = np.repeat(np.arange(len(n)), n)
            leg = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            vertex, c1 = np.repeat(first, n) + leg, np.concatenate(at)
            c0 = np.where(leg == 0, 0.0, np.concatenate([[0.0], c1[:-1]]))
            kept = [batch[f.name].take(pa.array(row)) for f in keep]
            new = [leg.astype(np.int32), lon[vertex], lat[vertex], lon[vertex + 1], lat[vertex + 1], c0, c1]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, new)], names=schema.names)

    return lines.select(*[f.name for f in keep], coords).filter(F.size(coords) > 1).mapInArrow(run, schema)


def _along(at: Column) -> list[Column]:
    f = (at - F.col("c0")) / (F.col("c1") - F.col("c0"))
    return [
        (F.col("ax") + (F.col("bx") - F.col("ax")) * f).alias("lon"),
        (F.col("ay") + (F.col("by") - F.col("ay")) * f).alias("lat"),
    ]


def sample_lines(lines: DataFrame, step_m: float = TRAIL_SAMPLE_M, radius: float = geo.SPHERE_RADIUS_M) -> DataFrame:
    """A point every ``step_m`` along each line plus its first vertex.

    The samples of a leg are the multiples of the step inside it, so each leg
    finds its own without walking the line. Output keeps the line's columns and
    adds ``at_m``, ``lon``, ``lat``.
    """
    keep = [c for c in lines.columns if c != "coords"]
    first = lines.filter(F.size("coords") > 0).select(
        *keep, F.lit(0.0).alias("at_m"), F.get("coords", F.lit(0))["lon"].alias("lon"), F.get("coords", F.lit(0))["lat"].alias("lat")
    )
    seg = legs(lines, radius=radius).filter(F.col("c1") > F.col("c0"))
    k0 = F.floor(F.col("c0") / step_m) + 1
    k1 = F.floor(F.col("c1") / step_m)
    hit = seg.filter(k1 >= k0).withColumn("k", F.explode(F.sequence(k0, k1))).withColumn("at_m", F.col("k") * F.lit(step_m))
    return first.unionByName(hit.select(*keep, "at_m", *_along(F.col("at_m"))))


def resample(lines: DataFrame, step_m: float) -> DataFrame:
    """Even steps with their distance, and the last vertex at the full length."""
    keep = [c for c in lines.columns if c != "coords"]
    pts = sample_lines(lines, step_m)
    total = geo_length(F.col("coords"))
    last = F.get("coords", F.size("coords") - 1)
    end = lines.filter(F.size("coords") > 0).select(*keep, total.alias("at_m"), last["lon"].alias("lon"), last["lat"].alias("lat"))
    return pts.unionByName(end)


def geo_length(coords: Column, radius: float = geo.SPHERE_RADIUS_M) -> Column:
    """Length of a line on the sphere the line operators use."""
    steps = F.zip_with(
        F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))),
        F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))),
        lambda a, b: geo.haversine_m(a["lon"], a["lat"], b["lon"], b["lat"], radius),
    )
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def point_at(lines: DataFrame, wanted: DataFrame, key: str = "line") -> DataFrame:
    """Position at a distance along a line, clamped to its ends.

    ``wanted``: key, ``at_m``. A distance belongs to one leg. Legs are filed under
    every stretch of ``STRETCH_M`` that they touch and meet only the distances of
    that stretch, however long the line and however many distances it has.
    """
    seg = legs(lines, key).filter(F.col("c1") > F.col("c0"))
    ends = seg.groupBy(key).agg(F.max("c1").alias("total"))
    clamped = wanted.join(ends, key).withColumn("d", F.greatest(F.lit(0.0), F.least("at_m", "total")))
    clamped = clamped.withColumn("_s", F.floor(F.col("d") / STRETCH_M))
    seg = seg.withColumn("_s", F.explode(F.sequence(F.floor(F.col("c0") / STRETCH_M), F.floor(F.col("c1") / STRETCH_M))))
    hit = seg.join(clamped, [key, "_s"]).filter(
        (F.col("d") >= F.col("c0")) & ((F.col("d") < F.col("c1")) | ((F.col("c1") == F.col("total")) & (F.col("d") == F.col("total"))))
    )
    return hit.select(*wanted.columns, "total", *_along(F.col("d")))


def heading_at(lines: DataFrame, wanted: DataFrame, look_m: float, key: str = "line") -> DataFrame:
    """Heading of a line at a distance: toward a point ahead, in the last stretch from one behind."""
    totals = lines.select(key, geo_length(F.col("coords")).alias("_total"))
    w = wanted.join(totals, key)
    ahead = F.least(F.col("_total"), F.col("at_m") + look_m)
    forward = ahead - F.col("at_m") > 5
    ends = w.select(
        key, "at_m",
        F.when(forward, F.col("at_m")).otherwise(F.greatest(F.lit(0.0), F.col("at_m") - look_m)).alias("from_m"),
        F.when(forward, ahead).otherwise(F.col("_total")).alias("to_m"),
    )
    both = ends.select(key, F.col("at_m").alias("want"), F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("from_m").alias("m")), F.struct(F.lit(1).alias("i"), F.col("to_m").alias("m")))).alias("e"))
    placed = point_at(lines, both.select(key, "want", F.col("e.i").alias("i"), F.col("e.m").alias("at_m")), key)
    pairs = placed.groupBy(key, "want").agg(
        *[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("lon", "lat")]
    )
    return pairs.select(key, F.col("want").alias("at_m"), geo.bearing_deg("lon0", "lat0", "lon1", "lat1").alias("heading"))


def trail_pieces(edges: DataFrame) -> DataFrame:
    """Every piece of every named trail of a park, one row each (G9). A trail's
    pieces stay rows; nothing gathers them."""
    return edges.filter((F.col("kind") == 1) & F.col("name").isNotNull()).select("park", "name", "edge_id", "coords")


def _keep_mask(x: np.ndarray, y: np.ndarray, tol: float) -> np.ndarray:
    """Vertices a tolerance keeps: split each span at its farthest vertex."""
    keep = np.zeros(len(x), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(x) - 1)]
    while spans:
        i, j = spans.pop()
        if j - i < 2:
            continue
        dx, dy = x[j] - x[i], y[j] - y[i]
        px, py = x[i + 1 : j] - x[i], y[i + 1 : j] - y[i]
        len2 = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / len2, 0.0, 1.0) if len2 > 0 else 0.0
        off = np.hypot(px - t * dx, py - t * dy)
        at = int(off.argmax())
        if off[at] > tol:
            mid = i + 1 + at
            keep[mid] = True
            spans += [(i, mid), (mid, j)]
    return keep


def simplify(coords: Column, tol_m: float = 5.0) -> Column:
    """Douglas-Peucker on a flat projection at the first vertex.

    Recursive per line, so an Arrow-batched function over array values; the
    whole line is one cell of one row.
    """

    @F.pandas_udf("array<struct<lon:double,lat:double>>")
    def run(lines: pd.Series) -> pd.Series:
        out = []
        for line in lines:
            if line is None or len(line) <= 2:
                out.append(line)
                continue
            lon = np.array([p["lon"] for p in line])
            lat = np.array([p["lat"] for p in line])
            kx = geo.M_PER_DEG_LON * np.cos(np.radians(lat[0]))
            keep = _keep_mask(lon * kx, lat * geo.M_PER_DEG_LAT, tol_m)
            out.append([p for p, k in zip(line, keep, strict=True) if k])
        return pd.Series(out)

    return run(coords)
