from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from observatory.functions import geo, hexgrid, labels, names, stats, text, times


def value(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0][0]


def values(spark, items, fn, ddl="v string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, " + ddl)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def ring(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in pts])


def test_one_degree_of_latitude(spark):
    got = value(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert got == pytest.approx(111194.9, rel=1e-4)


def test_bearing_and_planar(spark):
    assert value(spark, geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(90.0)
    assert value(spark, geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0))) == pytest.approx(180.0)
    assert value(spark, geo.planar_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(110540.0)


def test_point_in_ring_even_odd_open_or_closed(spark):
    square = ring((0, 0), (4, 0), (4, 4), (0, 4))
    closed = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    for r in (square, closed):
        assert value(spark, geo.point_in_ring(F.lit(1.0), F.lit(1.0), r)) is True
        assert value(spark, geo.point_in_ring(F.lit(5.0), F.lit(1.0), r)) is False
    both = F.array(square, ring((10, 10), (12, 10), (12, 12), (10, 12)))
    assert value(spark, geo.point_in_polygons(F.lit(11.0), F.lit(11.0), both)) is True


def test_path_length_clips_by_half(spark):
    line = ring((0, 0), (0, 1), (0, 2))
    full = value(spark, geo.path_length_m(line))
    half = value(spark, geo.path_length_m(line, (-1.0, -1.0, 1.0, 1.0)))
    assert half == pytest.approx(full * 0.75, rel=1e-9)
    assert value(spark, geo.path_length_m(ring((0, 0)))) == 0.0


def test_segment_distance_clamps_to_ends(spark):
    d = geo.segment_distance_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(0.0))
    assert value(spark, d) == pytest.approx(111320.0)
    same = geo.segment_distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0))
    assert value(spark, same) == pytest.approx(110540.0)


def test_box_algebra(spark):
    box = geo.box_struct(-110.5, 44.5, -110.0, 45.0)
    assert value(spark, geo.box_id(box)) == "-110.50000_44.50000_-110.00000_45.00000"
    assert value(spark, geo.box_lat_first(box)) == "44.5,-110.5,45.0,-110.0"
    assert value(spark, geo.box_area(box)) == pytest.approx(0.25)
    assert value(spark, geo.box_valid(box)) is True
    assert value(spark, geo.box_valid(geo.box_struct(44.5, -110.5, 45.0, -110.0))) is False
    assert len(value(spark, geo.box_quarters(box))) == 4


def test_ring_centroid_drops_the_closing_vertex(spark):
    got = value(spark, geo.ring_centroid(ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))))
    assert (got.lon, got.lat) == (1.0, 1.0)


def test_cells_hold_their_centre_and_ring_neighbours(spark):
    c = hexgrid.cell_of(F.lit(-110.2), F.lit(44.7), 9)
    at = hexgrid.center(c)
    assert value(spark, hexgrid.cell_of(at["lon"], at["lat"], 9) == c) is True
    near = value(spark, hexgrid.disk(c, 1))
    assert len(near) == len(set(near)) == 7
    assert len(value(spark, hexgrid.disk(c, 2))) == 19
    assert value(spark, hexgrid.cell_res(c)) == 9
    corners = value(spark, hexgrid.boundary(c))
    assert len(corners) == 7 and corners[0] == corners[-1]
    assert value(spark, hexgrid.cell_of(F.lit(None).cast("double"), F.lit(1.0), 9)) == hexgrid.NO_CELL
    assert value(spark, hexgrid.cell_res(hexgrid.parent(c, 6))) == 6


def test_cell_edges_match_their_resolution():
    assert hexgrid.edge_m(9) == pytest.approx(174.4, abs=0.1)
    assert 3000 < hexgrid.edge_m(6) < 3400


def test_neighbouring_cells_are_one_step_apart(spark):
    c = hexgrid.cell_of(F.lit(-110.2), F.lit(44.7), 9)
    at = hexgrid.center(c)
    df = spark.range(1).select(F.explode(hexgrid.disk(c, 1)).alias("n"), at["lon"].alias("lon"), at["lat"].alias("lat"), c.alias("c"))
    other = hexgrid.center(F.col("n"))
    d = [r[0] for r in df.filter("n <> c").select(geo.haversine_m("lon", "lat", other["lon"], other["lat"])).collect()]
    assert len(d) == 6 and all(250 < x < 360 for x in d)


def test_wilson(spark):
    w = value(spark, stats.wilson(F.lit(9), F.lit(10)))
    assert 0.59 < w.lo < 0.60 and 0.98 < w.hi < 0.99
    assert value(spark, stats.wilson(F.lit(0), F.lit(0))) is None


def test_bands(spark):
    got = values(spark, [0.1, 0.2, 0.5, 0.79, 1.0, None], stats.band_of, "v double")
    assert got == ["out", "0.2-0.5", "0.5-0.8", "0.5-0.8", "0.8-1.0", "out"]
    assert values(spark, [0.55, 0.8, 0.2], stats.species_band_of, "v double") == ["s0.5-0.6", "s0.8-1.0", None]


@pytest.mark.parametrize(
    ("months", "label"),
    [
        ([0, 0, 0, 0, 5, 6, 5, 0, 0, 0, 0, 0], "Busiest May to Jul"),
        ([0, 0, 0, 0, 0, 9, 0, 0, 5, 4, 0, 0], "Busiest Jun, Sep, Oct"),
        ([5, 5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 5], "Busiest Dec to Feb"),
        ([5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 5, 5], "Busiest Nov to Jan"),
        ([0, 0, 0, 20, 0, 0, 0, 0, 0, 0, 0, 0], "Busiest Apr"),
        ([1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0], None),
    ],
)
def test_busiest(spark, months, label):
    col = F.array(*[F.lit(m).cast("bigint") for m in months])
    assert value(spark, stats.busiest_label(col)) == label


def test_canonical_species(spark):
    syn = {"Bos bison": "Bison bison", "Cervus elaphus": "Cervus canadensis"}
    raw = ["Bos bison bison", "Bison bison", "Cervus elaphus nelsoni", "Larus Xema sabini", "larus argentatus x", "Anas", "", None, "Canis  lupus  lupus"]
    want = ["Bison bison", "Bison bison", "Cervus canadensis", "Larus Xema sabini", "larus argentatus x", "Anas", None, None, "Canis lupus"]
    assert values(spark, raw, lambda c: names.canonical_species(c, syn)) == want


def test_labels_and_display(spark):
    raw = [
        "u;mammalia;artiodactyla;bovidae;bison;bison;american bison", "u;mammalia;artiodactyla;cervidae;;;", "blank",
        "u;no cv result;;;;;no cv result", None, "a;b",
    ]
    assert values(spark, raw, names.display_name) == ["american bison", "cervidae (family)", "blank", "unknown", "", "a;b"]
    assert values(spark, ["blank", "u;;;;;;human", "u;a;b;c;d;e;elk"], names.is_excluded) == [True, True, False]


def test_resolve_species(spark):
    def sci(label, score):
        return value(spark, names.resolve_species(F.lit(label), F.lit(score)))

    bison = "u;mammalia;artiodactyla;bovidae;bison;bison;american bison"
    assert sci(bison, 0.9).scientific_name == "Bison bison"
    assert sci(bison, 0.5).scientific_name == "Mammalia"
    assert sci("u;mammalia;c;canidae;canis;familiaris;domestic dog", 0.99).common_name == names.UNIDENTIFIED_COMMON
    assert sci("blank", 0.99).taxon_rank == "class"


def test_file_names_and_variants(spark):
    got = values(spark, ["/x/12.jpg", "12__yaw090.jpg", "a.b.png"], lambda c: names.image_and_variant(c))
    assert [(g.image_id, g.variant) for g in got] == [("12", "full"), ("12", "yaw090"), ("a.b", "full")]
    assert value(spark, names.variant_name(F.lit(450))) == "yaw090"
    assert values(spark, ["yaw090", "full"], names.variant_yaw) == [90.0, None]


def test_observer_key(spark):
    assert values(spark, ["Ann-Marie O'Neil 2", "ÉLAN", None, "--"], names.observer_key) == ["annmarieoneil2", "élan", "", ""]


def test_times(spark):
    got = values(spark, ["2024-06-01T10:00:00-06:00", "2024-06-01T10:00:00Z", "nope", None], times.instant_to_ntz)
    assert got == [dt.datetime(2024, 6, 1, 16), dt.datetime(2024, 6, 1, 10), None, None]
    none = F.lit(None).cast("int")
    day = values(spark, ["2024-06-01T23:30:00-06:00", "2024-06-01/2024-06-09", "2024-06", "junk text here"], lambda c: times.event_day(c, none, none, none))
    assert day == [dt.date(2024, 6, 2), dt.date(2024, 6, 1), None, None]
    assert value(spark, times.event_day(F.lit(None).cast("string"), F.lit(2020), F.lit(2), F.lit(3))) == dt.date(2020, 2, 3)


def test_short_park_names(spark):
    raw = ["Acadia National Park", "Denali National Park and Preserve", "Redwood National Parks", "National Park of Samoa", "Arch"]
    assert values(spark, raw, text.short_park) == ["Acadia", "Denali", "Redwood", "Samoa", "Arch"]


def test_slug_html_credit(spark):
    assert value(spark, text.slug(F.lit("Haleakalā – Crème  Park!"))) == "haleakal_creme_park"
    assert value(spark, text.strip_html(F.lit(" <b>a</b>\n  b "))) == "a b"
    c = value(spark, text.credit(F.lit("CC BY-SA 4.0"), F.lit("u"), F.lit("<i>" + "x" * 100 + "</i>")))
    assert c.license == "CC BY-SA 4.0" and len(c.artist) == 80 and c.artist.endswith("…")
    assert value(spark, text.credit(F.lit("GFDL"), F.lit("u"), F.lit("x"))) is None
    assert value(spark, text.credit(F.lit("PD-USGov"), F.lit("u"), F.lit(""))).artist == "unknown"


def test_photo_addresses(spark):
    raw = ["https://static.inaturalist.org/photos/12/medium.JPG", "https://other.org/photos/1/a.jpg", "x", None]
    got = values(spark, raw, text.parse_photo)
    assert (got[0].photo_id, got[0].ext, got[0].host) == (12, "jpg", 1)
    assert got[1:] == [None, None, None]


def test_elevation_bodies(spark):
    raw = ['{"value": "2345.6"}', '{"value": -1000000}', "Call failed.", '{"value": null}', '{"v": 1}', '{"value": -86}']
    assert values(spark, raw, text.parse_elevation) == [2345.6, None, None, None, None, -86.0]


def test_station_names(spark):
    raw = ["NORTH FORK RIVER NEAR SPRINGDALE, UT", "at THE lake"]
    assert values(spark, raw, text.title_case) == ["North Fork River near Springdale, UT", "At the Lake"]


def test_singular_and_words(spark):
    raw = ["wolves", "geese", "mice", "berries", "foxes", "finches", "elks", "moss", "bison"]
    assert values(spark, raw, text.singular) == ["wolf", "goose", "mouse", "berry", "fox", "finch", "elk", "moss", "bison"]


def test_intents_and_months(spark):
    q = F.lit("When is the best month to see elk in September?")
    assert value(spark, text.intents(q)) == ["when", "where"]
    assert value(spark, text.month_mentioned(q)) == 9
    assert value(spark, text.month_mentioned(F.lit("wolves by the river"))) is None


def test_citations(spark):
    a = F.lit("Seen 1,234 times [2]. In 2019 [2][7], 88 more and 4567 rest.")
    assert value(spark, text.cited_facts(a, F.lit(3))) == [2]
    assert value(spark, text.uncited_numbers(a, F.lit("1,234 sightings"))) == ["2019", "4567"]
    assert value(spark, text.declines(F.lit("The data doesn't say."))) is True


def test_texts(spark):
    assert value(spark, text.format_distance(F.lit(124.0))) == "100 m"
    assert value(spark, text.format_distance(F.lit(1234.0))) == "1.2 km"
    assert value(spark, text.format_km(F.lit(12345.0))) == "12 km"
    assert value(spark, text.format_time(F.lit(5460.0))) == "1 h 31 min"
    assert value(spark, text.to_fahrenheit(F.lit(20.0))) == 68
    assert value(spark, text.wiki_url(F.lit("en:Old Place"))) == "https://en.wikipedia.org/wiki/Old_Place"
    assert value(spark, text.wiki_title(F.lit("https://en.wikipedia.org/wiki/Old_Place%21"))) == "Old Place!"
    assert value(spark, text.place_stem(F.lit("Fairy Falls Trail"))) == "Fairy Falls"
    assert value(spark, text.place_stem(F.lit("Campsite"))) is None
    assert value(spark, text.place_stem(F.lit("4R1 trail"))) is None


def test_tag_rules(spark):
    def tags(**kv):
        return F.create_map(*[F.lit(x) for p in kv.items() for x in p])

    assert value(spark, labels.landmark_kind(tags(natural="geyser"))).kind == "geyser"
    assert value(spark, labels.landmark_kind(tags(natural="tree"))) is None
    assert value(spark, labels.landmark_kind(tags(tourism="viewpoint", natural="peak"))).kind == "peak"
    assert value(spark, labels.amenity_kind(tags(tourism="information", information="board"))) is None
    assert value(spark, labels.amenity_kind(tags(tourism="information", information="office"))).kind == "info"
    assert value(spark, labels.amenity_kind(tags(tourism="hotel"))).needs_name is True
    assert value(spark, names.default_name(tags(tourism="alpine_hut"), F.lit("stay"))) == "Alpine hut"
    assert value(spark, labels.highway_class(F.lit("track"))) == "trail"
