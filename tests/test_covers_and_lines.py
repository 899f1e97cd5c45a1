"""Boundary and disc covers, and passes over lines, against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from observatory.operators import graph, lines, places, ranking, spatial

POINT = "struct<lon:double,lat:double>"


def crossed(lon, lat, ring):
    """Even-odd test, leg by leg."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (ay > lat) != (by > lat) and lon < ax + (lat - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def star(rng, lon, lat, n):
    """A ring with many dents, some legs flat and some upright."""
    out = []
    for i in range(n):
        r, t = rng.uniform(0.05, 0.2), 2 * math.pi * i / n
        out.append((round(lon + r * math.cos(t), rng.choice([1, 2, 6])), round(lat + r * math.sin(t), rng.choice([1, 2, 6]))))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_points_in_boundaries(spark, seed, monkeypatch):
    rng = random.Random(seed)
    parks = {"a": [star(rng, -110.0, 44.0, 40), star(rng, -109.5, 44.1, 9)], "b": [star(rng, 10.0, -3.0, 200)], "point": [[(1.0, 1.0)] * 3], "none": []}
    points = [(p, i, rng.uniform(-110.3, -109.2) if p == "a" else rng.uniform(9.7, 10.3), rng.uniform(43.7, 44.4) if p == "a" else rng.uniform(-3.3, -2.7)) for i in range(700) for p in "ab"]
    points += [(p, 1000 + i, *v) for p in "ab" for ring in parks[p] for i, v in enumerate(ring)] + [("point", 0, 1.0, 1.0), ("none", 0, 0.0, 0.0), ("other", 0, 0.0, 0.0), ("a", -1, None, 44.0), (None, -2, 1.0, 1.0)]
    frame = spark.createDataFrame(points, "park string, id int, lon double, lat double")
    rings = spark.createDataFrame([(p, [[{"lon": x, "lat": y} for x, y in r] for r in rs]) for p, rs in parks.items()], f"park string, rings array<array<{POINT}>>")
    boxes = places.boundary_boxes(rings)
    got = {(r.park, r.id, r.lon, r.lat): r.inside for r in places.inside(frame, boxes).collect()}
    assert len(got) == len(set(points))
    for (p, i, lon, lat), inside in got.items():
        want = lon is not None and any(crossed(lon, lat, r) for r in parks.get(p, []) if min(x for x, _ in r) <= lon)
        assert inside == want, (p, i, lon, lat)
    cover, _ = places.boundary_cover(boxes)
    tested = places._placed(frame.filter("id between 0 and 999 and park in ('a', 'b')"), boxes, cover).filter("_edge is not null").count()
    assert tested < 0.4 * 1400  # the rest is settled by its cell


def test_disc_cover_is_right(spark):
    rng = random.Random(2)
    samples = [(i, rng.uniform(-111, -110), rng.choice([0.0, 44.5, 70.0, -62.0]) + rng.uniform(0, 0.01), rng.choice([300.0, 500.0])) for i in range(30)]
    cover = spatial.disc_cover(spark.createDataFrame(samples, "place int, lon double, lat double, radius_m double"), ["place"], 500.0)
    near = [(i, lon + rng.uniform(-1, 1) * r / 90_000 / math.cos(math.radians(lat)), lat + rng.uniform(-1, 1) * r / 90_000) for i, lon, lat, r in samples for _ in range(60)]
    spots = spatial.with_bucket(spark.createDataFrame(near, "place int, x double, y double"), spatial.COVER_CELL_M, "x", "y")
    got = spots.join(cover, ["place", "_by", "_bx"], "left").select("place", "x", "y", "whole").collect()
    radius = {i: (lon, lat, r) for i, lon, lat, r in samples}
    kinds = set()
    for g in got:
        lon, lat, r = radius[g.place]
        y1, y2 = math.radians(lat), math.radians(g.y)
        d = 2 * 6371000.0 * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin(math.radians(g.x - lon) / 2) ** 2))
        kinds.add(g.whole)
        assert not (g.whole and d > r) and not (g.whole is None and d <= r)
    assert kinds == {True, False, None}


def test_a_line_of_a_million_vertices(spark):
    n = 1_000_000
    line = spark.range(1).select(F.lit(7).alias("line"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.named_struct(F.lit("lon"), i * 1e-5, F.lit("lat"), F.lit(0.0))).alias("coords"))
    got = lines.legs(line).agg(F.count("*").alias("n"), F.max("c1").alias("m"), F.max(F.col("c1") - F.col("c0")).alias("leg")).first()
    assert got.n == n - 1 and got.m == pytest.approx((n - 1) * 1e-5 * math.pi / 180 * 6371000.0) and got.leg == pytest.approx(1.11195, rel=1e-4)
    way = line.select(F.lit(1).cast("bigint").alias("id"), F.create_map(F.lit("highway"), F.lit("primary")).alias("tags"), F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")).alias("nodes"), F.col("coords").alias("geometry"))
    edges = graph.cut_edges(way, simplify_m=None).agg(F.count("*").alias("n"), F.min("length_m").alias("m"), F.sum(F.size("coords") - 1).alias("legs"), F.max("part").alias("part")).first()
    assert edges.legs == n - 1 and edges.part == edges.n - 1 and edges.n == math.ceil((n - 1) / 270)
    wanted = spark.createDataFrame([(7, float(m)) for m in (0, 555, 1_000_000, 10**9)], "line int, at_m double")
    placed = {r.at_m: r.lon for r in lines.point_at(line, wanted).collect()}
    assert placed[0.0] == 0.0 and placed[1_000_000.0] == pytest.approx(math.degrees(1_000_000 / 6371000.0)) and placed[10.0**9] == pytest.approx((n - 1) * 1e-5)


def test_pieces_equal_a_walk():
    rng = np.random.default_rng(5)
    for _ in range(60):
        m = rng.choice([0.0, 1.0, 40.0, 299.0, 300.0, 700.0], int(rng.integers(1, 400)))
        stops = sorted({int(x) for x in rng.integers(1, len(m) + 1, 3)} | {len(m)})
        want, start, run = [], 0, 0.0
        for i, step in enumerate(m.tolist(), 1):
            run += step
            if run >= 300 or i in stops:
                want.append((start, i, run))
                start, run = i, 0.0
        assert graph._pieces(m, stops, 300.0) == want


def test_configured_stops_are_landmarks(spark):
    lm = spark.createDataFrame(
        [("p", "n/1", "Norris Basin Museum", "attraction", 0.0, 0.0, 11, None, 5.0), ("p", "n/2", "Old Faithful", "geyser", 0.0, 0.0, 0, "u2", None), ("q", "n/3", "Far", "peak", 0.0, 0.0, 4, None, None)],
        "park string, id string, name string, kind string, lon double, lat double, rank int, url string, ele_m double",
    )
    tour = spark.createDataFrame(
        [("p", 0, "old faithful", None, None, "Old one"), ("p", 1, "Norris Basin", -1.0, 2.0, None), ("p", 2, "Norris", None, None, None), ("p", 3, "Quiet", -3.0, 4.0, None), ("p", 4, "qui", None, None, "Quiet place"), ("p", 5, "old", None, None, "Newer")],
        "park string, pos int, stop string, fb_lon double, fb_lat double, article string",
    )
    matched = ranking.match_tour(tour, lm)
    assert [(r.how, r.id) for r in matched.orderBy("pos").collect()] == [("exact", "n/2"), ("configured", "config/1"), ("prefix", "n/1"), ("configured", "config/3"), ("prefix", "config/3"), ("prefix", "n/2")]
    listed = {r.id: r for r in ranking.tour_landmarks(lm, matched, tour).collect()}
    wiki = "https://en.wikipedia.org/wiki/"
    assert {i: r.url for i, r in listed.items()} == {"n/1": None, "n/2": wiki + "Newer", "n/3": None, "config/1": wiki + "Norris_Basin", "config/3": wiki + "Quiet_place"}
    new = listed["config/1"]
    assert (new.park, new.name, new.kind, new.rank, new.lon, new.lat, new.ele_m) == ("p", "Norris Basin", "place", 14, -1.0, 2.0, None)
    # ids that no list has make room too
    many = spark.createDataFrame([("p", f"x{i}", f"x{i}", f"k{i}", 0.0, 0.0, 1, None, None) for i in range(9)], lm.schema)
    stops = spark.createDataFrame([("p", "gone/1"), ("p", "gone/2"), ("p", "x8"), ("p", "x8")], "park string, id string")
    kept = ranking.cap_by_kind(many, stops, per_kind=5, overall=2)
    assert {r.id for r in kept.collect()} == {"x0", "x1", "x2", "x3", "x4", "x8"} and kept.filter("is_stop").count() == 1
