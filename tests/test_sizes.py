"""Steps whose work must follow the input: repeated positions, equal rows and exact sums."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from observatory.operators import places, ranking, rollups, spatial
from observatory.plans import landed


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_mean_of_one_half_rounds_to_even_in_any_order(spark):
    """As doubles these add up to just under 942 in every order."""
    views = [287.47, 50.48, 57.11, 550.94]
    data = [("a", dt.date(1999, 5, 1), v) for v in views] + [("b", dt.date(1999, 5, 1), v) for v in reversed(views)]
    df = spark.createDataFrame(data, "cust string, month date, views double")
    assert rows(rollups.monthly_readers(df, ["cust"], "2000-03-15")) == [("a", 236), ("b", 236)]


def joined_rows(monkeypatch):
    """How many pairs each distance join holds."""
    counts = []
    join = spatial.distance_join

    def counted(left, right, *args, **kwargs):
        pairs = join(left, right, *args, **kwargs)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "distance_join", counted)
    return counts


def test_stops_and_images_at_one_position_meet_once(spark, monkeypatch):
    """Forty stops and two hundred images at two positions: four pairs at most a kind, and the first id wins."""
    counts = joined_rows(monkeypatch)
    stops = spark.createDataFrame([(i, 10.0, 50.0) for i in range(40)], "stop int, lon double, lat double")
    images = [(f"i{i:03d}", i % 50 == 49, None, 10.0 + 0.001 * (i % 2), 50.0) for i in range(200)]
    images = spark.createDataFrame(images, "image_id string, is_pano boolean, captured_at timestamp, lon double, lat double")
    got = rows(spatial.street_image(stops, images).select("stop", "image_id", "is_pano"))
    assert got == [(i, "i049", True) for i in range(40)]
    assert max(counts) <= 3


def test_things_at_one_position_meet_once(spark, monkeypatch):
    counts = joined_rows(monkeypatch)
    anchors = spark.createDataFrame([(i, 10.0, 50.0) for i in range(30)], "anchor int, lon double, lat double")
    kinds = ["camp", "stay", "trailhead", "viewpoint", "feature", "trail"]
    data = [(f"n{i:03d}", kinds[i % 6], 10.0, 50.0 + 0.001 * (i % 7 == 6), float(i % 11) if i % 6 == 5 else None) for i in range(300)]
    items = spark.createDataFrame(data, "id string, kind string, lon double, lat double, length_m double")
    got = rows(spatial.things_near(anchors, items).select("anchor", "grp", "rank", "id"))
    want = []
    for kind, grp, cap in zip(kinds, ("camp", "stay", "hike", "facilities", "features", "trails"), (6, 3, 6, 6, 6, 6), strict=True):
        order = sorted((r for r in data if r[1] == kind), key=lambda r: (-(r[4] or 0), r[3], r[0]))[:cap]
        want += [(a, grp, n, r[0]) for a in range(30) for n, r in enumerate(order, 1)]
    assert got == sorted(want)
    assert max(counts) <= 2 * 4 * 6


def test_places_at_one_position_are_one_site(spark):
    """Each site meets the sightings once; hits and the rollup still list every place."""
    day = dt.date(2024, 5, 1)
    seen = spark.createDataFrame([("p", 10.0 + 0.002 * (i % 4), 50.0, day, "ab"[i % 2]) for i in range(40)], "park string, lon double, lat double, observed_on date, scientific_name string")
    spots = [("p", f"n{i}", 10.0, 50.0, 250.0) for i in range(20)] + [("p", "far", 11.0, 50.0, 250.0)] + [("p", "trail", 10.0 + 0.002 * i, 50.0, 100.0) for i in range(3)]
    samples = spark.createDataFrame(spots, "park string, place string, lon double, lat double, radius_m double")
    members, hits = spatial.site_hits(seen, samples)
    assert members.count() == 22 and hits.select("site").distinct().count() == 2
    near = rows(spatial.place_hits(seen, samples))
    assert near == sorted([("p", f"n{i}", 5, s, 10) for i in range(20) for s in "ab"] + [("p", "trail", 5, "a", 20), ("p", "trail", 5, "b", 10)])
    pl = members.select("park", F.col("place").alias("id"))
    one, each = (places.place_rollup(pl, h, members=m).select("place", "n", "species", "months") for h, m in ((hits, members), (spatial.place_hits(seen, samples), None)))
    assert rows(one) == rows(each) and len(rows(one)) == 22


def test_the_first_photo_of_a_row_is_found_inside_the_row(spark):
    """As by a row per photo, but no plan holds these rows."""
    good, other = "https://static.inaturalist.org/photos/{}/medium.JPG", "https://elsewhere.org/photos/{}/medium.jpg"
    photos = [
        [(other.format(1), "cc0"), (good.format(2), None), (good.format(3), "cc-by-nc"), (good.format(4), "cc0")],
        [(good.format(5), "cc0")], [(other.format(6), "cc0")], [], None, [(None, "cc0"), None, (good.format(8), "cc0")], [(good.format(9), "cc-by-nc")],
    ]
    df = spark.createDataFrame([(i % 6, f"s{i}", p) for i, p in enumerate(photos)], "observation_id int, species string, photos array<struct<url:string,license_code:string>>")
    got = ranking.first_photo(ranking.first_of_row(df))
    want = ranking.first_photo(ranking.displayable_photos(df))
    assert got.columns == want.columns and rows(got) == rows(want) and len(rows(got)) == 3
    plan = ranking.first_of_row(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_landed_documents_are_files_of_one_folder(spark, monkeypatch, out_dir):
    monkeypatch.setattr(landed, "scratch_path", lambda *_: f"{out_dir}/ways")
    ways = landed.landed_ways(spark, "/root/testdata/sf0.001")
    names = [n for n in os.listdir(f"{out_dir}/ways") if not n.startswith((".", "_"))]
    assert len(names) > 1 and all(os.path.isfile(f"{out_dir}/ways/{n}") for n in names)
    ids = [r.id for r in ways.select("id").collect()]
    assert len(names) == len({i // 500 for i in ids}) and len(ids) == len(set(ids))
