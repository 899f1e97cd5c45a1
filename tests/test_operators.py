from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from observatory.functions import hexgrid
from observatory.operators import (
    chains,
    dedupe,
    graph,
    lines,
    places,
    quality,
    ranking,
    report,
    rollups,
    sampling,
    search,
    segmented,
    spatial,
    suppress,
    tiling,
)
from observatory.sources import rules

R = 6371008.8


def hav(a, b, radius=R):
    (x1, y1), (x2, y2) = a, b
    p1, p2 = math.radians(y1), math.radians(y2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(h))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- segmented passes ------------------------------------------------------------


def test_segmented_passes_equal_plain_windows(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab") if rng.random() > 0.1 else None, rng.randrange(100), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t int, id int, v int").withColumn("seg", F.floor(F.col("t") / 7))
    out = segmented.running_total(
        segmented.previous_row(df, ["k"], "seg", ["t", "id"], ["id"]), ["k"], "seg", ["t", "id"], F.col("v")
    )
    got = {r.id: (r.prev.id if r.prev else None, r.total) for r in out.collect()}
    for key, group in itertools.groupby(sorted(data, key=lambda r: (str(r[0]), r[1], r[2])), key=lambda r: r[0]):
        total, prev = 0, None
        for _, _, i, v in group:
            total += v
            assert got[i] == (prev, total), key
            prev = i


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40, 1000)] + [("b", 5.0)], "k string, v double")
    got = {r.k: (r.n, r.max, r.p0, r.p1) for r in segmented.exact_percentiles(df, ["k"], "v", (0.5, 0.9), 25.0).collect()}
    assert got["a"] == (5, 1000.0, 30.0, pytest.approx(616.0))
    assert got["b"] == (1, 5.0, 5.0, 5.0)


# ---- chains --------------------------------------------------------------------------

LABEL = "u;mammalia;artiodactyla;cervidae;cervus;canadensis;elk"


def _box(img, seq, s, det, conf, label=LABEL, score=0.9, lon=-110.0, lat=44.9, cat="1"):
    us = None if s is None else s * 1_000_000
    at = None if s is None else dt.datetime(2024, 6, 1) + dt.timedelta(seconds=s)
    return (img, "v1", "full", det, cat, conf, 0.1, 0.1, 0.2, 0.2, label, score, "c", seq, us, at, lon, lat, 10.0, "ann", "CC", "u", 10, 10)


BOX_DDL = (
    "image_id string, model_version string, variant string, det_idx int, category string, conf double, bbox_x double, bbox_y double, "
    "bbox_w double, bbox_h double, prediction string, prediction_score double, corridor string, sequence_id string, ts_us bigint, "
    "captured_at timestamp_ntz, lon double, lat double, bearing double, creator_username string, license string, source_url string, width int, height int"
)


@pytest.fixture()
def seed(spark):
    """Two elk in one frame, one more 5 s later, another sequence much later."""
    data = [
        _box("i1", "s1", 0, 0, 0.9), _box("i1", "s1", 0, 1, 0.8), _box("i4", "s1", 5, 0, 0.7), _box("i2", "s2", 9000, 0, 0.6),
        _box("i3", "s1", 2, 0, 0.9, cat="2"),
    ]
    return spark.createDataFrame(data, BOX_DDL)


def test_individuals(seed):
    r = chains.cluster_detections(seed).collect()[0]
    assert (r.n_boxes, r.n_clusters, r.n_individuals, r.n_images) == (4, 2, 3, 3)
    assert r.duplicate_rate == pytest.approx(0.25)
    assert chains.cluster_detections(seed, gap_s=0).collect()[0].n_clusters == 3


def test_superseded_chains_count_less(seed):
    old = chains.cluster_detections_v1(seed).collect()[0]
    assert old.n_clusters == 2 < chains.cluster_detections(seed).collect()[0].n_individuals


def test_null_time_or_place_breaks_a_chain(spark):
    data = [_box("a", "s", 0, 0, 0.9), _box("b", "s", 1, 0, 0.9, lon=None), _box("c", "s", 2, 0, 0.9), _box("d", "s", None, 0, 0.9), _box("e", "s", None, 0, 0.9)]
    df = spark.createDataFrame(data, BOX_DDL)
    assert chains.cluster_detections(df).collect()[0].n_clusters == 5


def test_chains_cross_segments(spark):
    data = [_box(f"f{i:03d}", "s", i * 50, 0, 0.9) for i in range(100)]
    df = spark.createDataFrame(data, BOX_DDL).repartition(7)
    out = chains.mark_chains(df, ["sequence_id"], ["ts_us", "image_id"], segment_s=300.0)
    assert out.select("chain").distinct().count() == 1
    assert chains.mark_chains(df, ["sequence_id"], ["ts_us", "image_id"], gap_s=49, segment_s=300.0).select("chain").distinct().count() == 100


def test_detections_become_sightings(spark):
    human, blank = "u;;;;;;human", "blank"
    data = [
        _box("i1", "s1", 0, 0, 0.9), _box("i4", "s1", 5, 0, 0.95), _box("i5", "s1", 8, 0, 0.8, score=0.3),
        _box("i6", "s1", 9, 0, 0.9, label=human), _box("i7", "s1", 9, 0, 0.4), _box("i8", "s1", 9, 0, 0.9, label=blank),
    ]
    df = spark.createDataFrame(data, BOX_DDL)
    got = {r.scientific_name: r for r in chains.detections_to_sightings(df, F.lit("park")).collect()}
    assert set(got) == {"Cervus canadensis", "Mammalia"}
    assert got["Cervus canadensis"].sighting_id == "mapillary_cv:i4:full:0"
    assert got["Cervus canadensis"].chain_boxes == 2
    c = chains.box_filter_counts(df).collect()[0]
    assert (c.n_in, c.n_kept, c.dropped_conf, c.dropped_label) == (6, 3, 1, 2)


# ---- dedupe ------------------------------------------------------------------------------

DEDUPE_DDL = (
    "sighting_id string, source string, park string, scientific_name string, observed_on date, observed_at timestamp_ntz, "
    "lon double, lat double, observer string, duplicate_of string"
)


def brute_dedupe(data, dist_m, window_s):
    rank = {"inaturalist": 0, "gbif": 1, "mapillary_cv": 2}

    def norm(s):
        return "".join(ch for ch in (s or "").lower() if ch.isalnum())

    out = {}
    keyed = [r for r in data if r[6] is not None and r[4] is not None]
    for _, g in itertools.groupby(sorted(keyed, key=lambda r: (r[2], str(r[3]), r[4])), key=lambda r: (r[2], str(r[3]), r[4])):
        stay = []
        for r in sorted(g, key=lambda r: (rank.get(r[1], 9), "" if r[1] in rank else r[1], r[0])):
            hit = None
            for c in stay:
                if hav((r[6], r[7]), (c[6], c[7])) > dist_m:
                    continue
                who = norm(r[8]) and norm(r[8]) == norm(c[8])
                when = r[5] is not None and c[5] is not None and abs((r[5] - c[5]).total_seconds()) <= window_s
                if who or when:
                    hit = c
                    break
            if hit is not None and hit[1] != r[1]:
                out[r[0]] = hit[0]
            else:
                stay.append(r)
    return out


@pytest.mark.parametrize(("spread", "seed_no"), [(0.004, 1), (0.02, 2), (0.0005, 5)])
def test_dedupe_equals_the_greedy_pass(spark, spread, seed_no):
    rng = random.Random(seed_no)
    day = dt.date(2024, 6, 1)
    data = []
    for i in range(260):
        src = rng.choice(["inaturalist", "gbif", "mapillary_cv", "zoo", "club"])
        at = None if rng.random() < 0.2 else dt.datetime(2024, 6, 1) + dt.timedelta(seconds=rng.randrange(20000))
        data.append((
            f"{src}:{i:04d}", src, "p", rng.choice(["Bison bison", "Elk", None]), day, at,
            -110 + rng.random() * spread, 44.9 + rng.random() * spread, rng.choice([None, "Ann", "a n n", "Bob", "Cy"]), None,
        ))
    df = spark.createDataFrame(data, DEDUPE_DDL)
    got = {r.sighting_id: r.duplicate_of for r in dedupe.find_duplicates(df).collect()}
    assert got == brute_dedupe(data, 200.0, 3600.0)
    assert got


@pytest.mark.parametrize(("metres", "found"), [(210.0, 0), (190.0, 3000)])
def test_two_crowds_at_the_edge_of_reach(spark, metres, found):
    """Rows at one place and time are compared once, so crowds do not pair up row by row."""
    n, day = 3000, dt.date(2024, 6, 1)
    at, step = dt.datetime(2024, 6, 1, 9), metres / 111_195.08
    data = [(f"{s}:{i}", s, "p", "Elk", day, at, -110.0, 44.9 + k * step, None, None) for k, s in enumerate(["inaturalist", "gbif"]) for i in range(n)]
    got = dedupe.find_duplicates(spark.createDataFrame(data, DEDUPE_DDL)).collect()
    assert len(got) == found and {r.duplicate_of for r in got} <= {"inaturalist:0"}


def _crowds(n, metres, seed=3):
    """Two crowds of all different positions and times, their middles so far apart."""
    rng, day, step = random.Random(seed), dt.date(2024, 6, 1), metres / 111_195.08
    return [
        (f"{s}:{i:05d}", s, "p", "Elk", day, dt.datetime(2024, 6, 1, 9) + dt.timedelta(seconds=rng.randrange(3000)),
         -110.0 + rng.uniform(-3e-4, 3e-4), 44.9 + k * step + rng.uniform(-3e-4, 3e-4), None, None)
        for k, s in enumerate(["inaturalist", "gbif"]) for i in range(n)
    ]


@pytest.mark.parametrize("metres", [210.0, 250.0])
def test_crowds_of_different_positions(spark, monkeypatch, metres):
    """Cells at the edge of reach are split: the pairs compared grow with rows^1.5 (the ring at the edge), not with their square."""
    compared, real = [], dedupe._compared

    def counted(p, c, edge, *args):
        compared.append(edge.agg(F.sum(F.col("n_p") * F.col("n_c"))).first()[0] or 0)
        return real(p, c, edge, *args)

    monkeypatch.setattr(dedupe, "_compared", counted)
    sums = []
    for n in (400, 1600):
        compared.clear()
        data = _crowds(n, metres)
        found = {r.sighting_id: r.duplicate_of for r in dedupe.find_duplicates(spark.createDataFrame(data, DEDUPE_DDL)).collect()}
        sums.append(sum(compared))
        if n == 400:
            assert found == brute_dedupe(data, 200.0, 3600.0) and found
    assert sums[1] < 10 * max(sums[0], 400) and sums[1] < 1600 * 1600 / 4


def test_a_crowd_is_settled_by_its_best_rows(spark, monkeypatch):
    """Of a crowd that is spread over a day and several reaches, fine cells only see the few rows that none of the best is near."""
    rng, day, asked, real = random.Random(8), dt.date(2024, 6, 1), [], dedupe._best
    data = [
        (f"{s}:{i:05d}", s, "p", "Elk", day, None if i % 9 == 0 else dt.datetime(2024, 6, 1) + dt.timedelta(seconds=rng.randrange(86400)),
         -110.0 + rng.uniform(0, 0.01), 44.9 + rng.uniform(0, 0.01), rng.choice(["Ann", "a n n", "Bo", None]), None)
        for s in ("inaturalist", "gbif", "mapillary_cv") for i in range(400)
    ]
    monkeypatch.setattr(dedupe, "_best", lambda probe, *args: asked.append(probe.count()) or real(probe, *args))
    got = {r.sighting_id: r.duplicate_of for r in dedupe.find_duplicates(spark.createDataFrame(data, DEDUPE_DDL), 700.0, 43200.0).collect()}
    assert got == brute_dedupe(data, 700.0, 43200.0) and len(got) > 700
    assert sum(asked) < 160  # of 2 x 400 rows under two rules


def test_dedupe_marks_but_keeps(spark):
    day = dt.date(2024, 6, 1)
    data = [
        ("gbif:1", "gbif", "p", "Elk", day, None, -110.0, 44.9, "Ann B", None),
        ("inaturalist:1", "inaturalist", "p", "Elk", day, None, -110.0, 44.9001, "annb", None),
        ("gbif:2", "gbif", "p", "Elk", day, None, -110.5, 44.9, "Ann B", None),
    ]
    df = spark.createDataFrame(data, DEDUPE_DDL)
    marked = dedupe.mark_duplicates(df, dedupe.find_duplicates(df))
    assert marked.count() == 3
    assert rows(marked.filter("duplicate_of is not null").select("sighting_id", "duplicate_of")) == [("gbif:1", "inaturalist:1")]


# ---- rules, cells, names ------------------------------------------------------------------------

S_DDL = (
    "sighting_id string, source string, park string, confidence_basis string, taxon_id string, scientific_name string, common_name string, "
    "taxon_rank string, taxon_class string, observed_on date, lon double, lat double, coordinate_status string, duplicate_of string, raw_json string"
)


def _s(i, source="inaturalist", sci="Bison bison", common=None, lon=-110.0, status="open", flag=None, rank="species", day=dt.date(2020, 6, 1), dup=None):
    raw = '{"taxon_geoprivacy": %s}' % (f'"{flag}"' if flag else "null")
    basis = "model_predicted" if source == "mapillary_cv" else "human_verified"
    return (f"{source}:{i}", source, "p", basis, f"t{i}", sci, common, rank, "Mammalia", day, lon, 44.9, status, dup, raw)


def test_cells_and_suppression(spark):
    data = [
        _s(1), _s(2, "gbif", "Bos bison bison", day=dt.date(2018, 6, 1)), _s(3, sci="Canis lupus"), _s(4, sci="Ursus arctos horribilis"),
        _s(5, status="obscured"), _s(6, sci="Lontra canadensis", flag="obscured"), _s(7, dup="x"), _s(8, sci="Canis lupus occidentalis"),
    ]
    df = spark.createDataFrame(data, S_DDL)
    per = rollups.cell_species(df, rules.suppression_rules(spark), rules.DEFAULT_SYNONYMS)
    got = {r.species: r for r in per.collect()}
    assert set(got) == {"Bison bison", "Ursus arctos", "Lontra canadensis"}
    assert (got["Bison bison"]["count"], got["Bison bison"].y0, got["Bison bison"].y1) == (2, 2018, 2020)
    assert got["Ursus arctos"].res == 6 and got["Lontra canadensis"].res == 6 and got["Bison bison"].res == 9
    totals = rollups.cell_totals(per).collect()
    assert sum(r["count"] for r in totals) == 4
    assert all(r.ring[0] == r.ring[-1] for r in totals)


def test_auto_sensitive_needs_a_majority(spark):
    data = [_s(1, sci="A a", flag="obscured"), _s(2, sci="A a", flag="private"), _s(3, sci="B b", flag="obscured"), _s(4, sci="B b"), _s(5, sci="B b")]
    assert [r.scientific_name for r in suppress.auto_sensitive(spark.createDataFrame(data, S_DDL)).collect()] == ["A a"]


def test_rule_loader_refuses(spark):
    with pytest.raises(ValueError):
        rules.suppression_rules(spark, [{"name": "X", "action": "coarsen"}])
    with pytest.raises(ValueError):
        rules.suppression_rules(spark, [{"name": "X", "action": "hide"}])


def test_common_name_vote(spark):
    data = [
        _s(1, sci="Cervus canadensis", common="Wapiti"), _s(2, sci="Cervus canadensis", common="Wapiti", status="obscured"),
        _s(3, sci="Cervus canadensis nelsoni", common="American Elk"),
        *[_s(10 + i, "gbif", "Cervus elaphus", "Elk unknown") for i in range(5)], _s(20, "gbif", "Anas a", "Duck"),
    ]
    out = {r.species: r for r in rollups.pick_names(rollups.name_votes(spark.createDataFrame(data, S_DDL), rules.DEFAULT_SYNONYMS)).collect()}
    assert out["Cervus canadensis"].common_name == "Wapiti"
    assert out["Cervus canadensis"].other_names == ["American Elk", "Elk unknown"]
    assert out["Anas a"].common_name == "Duck"


def test_species_rollup(spark):
    data = [_s(1), _s(2, "gbif", "Bos bison", day=dt.date(2019, 1, 5)), _s(3, status="obscured"), _s(4, rank="genus", sci="Bison"), _s(5, "mapillary_cv", "Mammalia", rank="class")]
    out = {r.species: r for r in rollups.species_rollup(spark.createDataFrame(data, S_DDL), rules.DEFAULT_SYNONYMS).collect()}
    b = out["Bison bison"]
    assert (b.sightings, b.open_coordinates, b.obscured_coordinates, b.n_gbif, b.aliases) == (3, 2, 1, 1, ["Bos bison"])
    assert b.months[0] == 1 and b.months[5] == 2 and b.taxon_id == "t3"
    assert set(out) == {"Bison bison", "Mammalia"}


def test_species_and_cells_read_the_sightings_twice(spark, out_dir):
    """One pass for names, votes and rules, one for cells; and with shared facts the same rows as without."""
    data = [
        _s(1), _s(2, "gbif", "Bos bison"), _s(3, status="obscured", common="Buffalo"), _s(4, rank="genus", sci="Bison", common="Cattle"),
        _s(5, "mapillary_cv", "Mammalia", rank="class"), _s(6, "gbif", "Canis lupus", "Wolf"), _s(7, "gbif", None),
    ]
    path = f"{out_dir}/read-twice"
    spark.createDataFrame(data, S_DDL).write.parquet(path)
    rows, ruled = spark.read.parquet(path), rules.suppression_rules(spark)
    facts = rollups.name_facts(rows, rules.DEFAULT_SYNONYMS)
    species = rollups.species_rollup(rows, rules.DEFAULT_SYNONYMS, ruled, facts)
    cells = rollups.cell_species(rows, ruled, rules.DEFAULT_SYNONYMS, facts=facts)
    scans = lambda df: len({f for f in df.inputFiles() if "read-twice" in f})
    assert scans(species) == 0 and "read-twice" not in species._jdf.queryExecution().optimizedPlan().toString()
    index = rollups.species_index(species, cells)
    assert index._jdf.queryExecution().sparkPlan().toString().count("read-twice") == 1
    assert sorted(map(str, species.collect())) == sorted(map(str, rollups.species_rollup(rows, rules.DEFAULT_SYNONYMS, ruled).collect()))
    assert sorted(map(str, cells.collect())) == sorted(map(str, rollups.cell_species(rows, ruled, rules.DEFAULT_SYNONYMS).collect()))
    found = {r.species: r for r in species.collect()}
    assert set(found) == {"Bison bison", "Mammalia", "Canis lupus"} and found["Bison bison"].sightings == 3


def test_road_bias(spark):
    img = spark.createDataFrame([("c", -110.0, 44.9)], "corridor string, lon double, lat double")
    data = [_s(1), _s(2, lon=-110.05), _s(3, lon=-120.0)]
    boxes = spark.createDataFrame([("c", "p", -111.0, 44.0, -109.0, 45.0)], "corridor string, park string, min_lon double, min_lat double, max_lon double, max_lat double")
    out = rollups.road_bias(spark.createDataFrame(data, S_DDL), rollups.coverage_cells(img), boxes)
    r = out.filter("taxon_class = '(all)'").collect()[0]
    assert (r.n, r.covered, r.fraction_outside) == (2, 1, 0.5)


def test_climate(spark):
    data = [("p", dt.date(2023, 1, 1), 5.0, -7.0, 0.5, 4.0), ("p", dt.date(2023, 1, 2), 3.0, -9.0, 2.5, None), ("p", dt.date(2023, 1, 3), None, -9.0, None, 2.0)]
    df = spark.createDataFrame(data, "park string, date date, tmax double, tmin double, precip double, snow double")
    r = rollups.climate_normals(df, ["park"]).collect()[0]
    assert (r.tmax, r.tmin, r.precip_mm, r.snow_cm, r.wet_days) == (4.0, -8.0, 3.0, 6.0, 1.0)


# ---- samples -------------------------------------------------------------------------------------------


def greedy(cands, n, per_band):
    room = {b: per_band for b in ("0.2-0.5", "0.5-0.8", "0.8-1.0")}
    taken, out = set(), []
    for c in sorted(cands, key=lambda c: c[-1]):
        band = "0.2-0.5" if c[2] < 0.5 else "0.5-0.8" if c[2] < 0.8 else "0.8-1.0"
        if room[band] and c[0] not in taken:
            room[band] -= 1
            taken.add(c[0])
            out.append((c[0], c[1]))
            if len(out) == n:
                break
    return sorted(out)


@pytest.mark.parametrize("images", [8, 40, 4000])
def test_stratified_draw_equals_the_full_walk(spark, images):
    rng = random.Random(images)
    data = [(f"i{rng.randrange(images)}", d, rng.uniform(0.2, 1.0), f"{rng.random():.12f}") for d in range(900)]
    df = spark.createDataFrame([("c", i, "full", d, c, h) for i, d, c, h in data], "corridor string, image_id string, variant string, det_idx int, conf double, h string")
    got = sorted((r.image_id, r.det_idx) for r in sampling.sample_stratified(df, 30).collect())
    assert got == greedy(data, 30, 10)


def test_quota_is_not_back_filled(spark):
    data = [("c", f"i{i}", "full", 0, conf, f"{i:05d}") for i, conf in enumerate([0.3] * 50 + [0.6] * 20 + [0.9] * 6)]
    df = spark.createDataFrame(data, "corridor string, image_id string, variant string, det_idx int, conf double, h string")
    drawn = sampling.sample_stratified(df, 30)
    short = {r.band: (r.taken, r.short) for r in sampling.shortfalls(drawn, ["corridor"], ["0.2-0.5", "0.5-0.8", "0.8-1.0"], 10).collect()}
    assert short == {"0.2-0.5": (10, 0), "0.5-0.8": (10, 0), "0.8-1.0": (6, 4)}
    uniform = sampling.sample_uniform(df, 30)
    assert uniform.filter("band = '0.2-0.5'").count() > 10


def test_pending_downloads_are_stable_and_capped(spark):
    img = spark.createDataFrame([(f"i{i}", "c", f"s{i % 3}", False) for i in range(60)], "image_id string, corridor string, sequence_id string, is_pano boolean")
    dl = spark.createDataFrame([("i0", None), ("i1", "timeout")], "image_id string, error string")
    pick = sampling.pending_downloads(img, dl, 100, max_per_sequence=3)
    ids = rows(pick.select("image_id"))
    assert len(ids) == 9 and ("i0",) not in ids
    assert rows(sampling.pending_downloads(img.repartition(5), dl, 100, max_per_sequence=3).select("image_id")) == ids


# ---- ranking -------------------------------------------------------------------------------------------------


def test_cell_strip_adds_the_best_of_other_species(spark):
    data = [("p", 1, "bison", 50 - i, dt.date(2020, 1, 1), i) for i in range(5)] + [("p", 1, "elk", 1, dt.date(2020, 1, 1), 9)]
    df = spark.createDataFrame(data, "park string, cell bigint, species string, faves int, observed_on date, photo_id bigint")
    got = [r.species for r in ranking.cell_strip(df).orderBy("rn").collect()]
    assert got == ["bison", "bison", "bison", "elk"]
    assert [r.species for r in ranking.cell_strip_v1(df).collect()] == ["bison"] * 3


def _landmarks(spark):
    kinds = ["peak", "lake", "geyser"]
    data = [("p", f"n/{i}", f"N{i:02d}", kinds[i % 3], -110 + i * 0.01, 44.0 + (i * 7 % 5) * 0.01, i % 3, "u" if i < 6 else None) for i in range(30)]
    return spark.createDataFrame(data, "park string, id string, name string, kind string, lon double, lat double, rank int, url string")


def test_tour(spark):
    picked = ranking.round_robin_stops(_landmarks(spark))
    order = ranking.chain_stops(picked).orderBy("tour").collect()
    assert len(order) == 8
    assert order[0].lon == min(r.lon for r in order)
    first = [r.kind for r in picked.orderBy("pick").limit(3).collect()]
    assert len(set(first)) == 3
    for a, b, c in zip(order, order[1:], order[2:]):
        assert hav((a.lon, a.lat), (b.lon, b.lat)) <= hav((a.lon, a.lat), (c.lon, c.lat)) + 1e-6


def test_tour_match_order(spark):
    lm = spark.createDataFrame(
        [("p", "n/1", "Norris Basin Museum", "attraction", 0.0, 0.0, 1, None), ("p", "n/2", "Old Faithful", "geyser", 0.0, 0.0, 0, None), ("p", "n/3", "The Big Falls", "waterfall", 0.0, 0.0, 2, None)],
        "park string, id string, name string, kind string, lon double, lat double, rank int, url string",
    )
    stops = spark.createDataFrame(
        [("p", 0, "old faithful", None, None), ("p", 1, "Norris Basin", -1.0, 2.0), ("p", 2, "Norris", None, None), ("p", 3, "Big Falls", None, None), ("p", 4, "Nowhere", None, None)],
        "park string, pos int, stop string, fb_lon double, fb_lat double",
    )
    got = [r.how for r in ranking.match_tour(stops, lm).orderBy("pos").collect()]
    assert got == ["exact", "configured", "prefix", "contains", "missing"]


def test_cap_keeps_stops(spark):
    lm = _landmarks(spark)
    out = ranking.cap_by_kind(lm, lm.filter("id = 'n/29'"), per_kind=2, overall=4)
    ids = {r.id for r in out.collect()}
    assert "n/29" in ids and len(ids) == 6


# ---- proximity -----------------------------------------------------------------------------------------------------


def test_distance_join_equals_brute_force_everywhere(spark):
    rng = random.Random(11)
    for base_lat, base_lon in ((44.9, -110.0), (-0.01, 0.01), (68.0, 20.0)):
        a = [(i, base_lon + rng.uniform(-0.05, 0.05), base_lat + rng.uniform(-0.05, 0.05)) for i in range(150)]
        b = [(i, base_lon + rng.uniform(-0.05, 0.05), base_lat + rng.uniform(-0.05, 0.05)) for i in range(60)]
        left = spark.createDataFrame(a, "id int, lon double, lat double")
        right = spark.createDataFrame(b, "rid int, r_lon double, r_lat double")
        got = sorted((r.id, r.rid) for r in spatial.distance_join(left, right, 900.0).collect())
        want = sorted((i, j) for i, x, y in a for j, u, v in b if hav((x, y), (u, v), 6371000.0) <= 900.0)
        assert got == want and got


def test_nearest_equals_brute_force(spark):
    rng = random.Random(7)
    pts = [(i, rng.uniform(-112, -108), rng.uniform(43, 46)) for i in range(120)]
    tgt = [(i, rng.uniform(-110.2, -110.0), rng.uniform(44.8, 45.0)) for i in range(40)]

    def planar(p, q):
        kx = 111320.0 * math.cos(math.radians((p[1] + q[1]) / 2))
        return math.hypot((q[0] - p[0]) * kx, (q[1] - p[1]) * 110540.0)

    got = spatial.nearest(spark.createDataFrame(pts, "p int, lon double, lat double"), spark.createDataFrame(tgt, "t int, lon double, lat double"), "p", "t")
    best = {i: min(planar((x, y), (u, v)) for _, u, v in tgt) for i, x, y in pts}
    out = {r.p: r.dist_m for r in got.collect()}
    assert out == {i: pytest.approx(d, rel=1e-9) for i, d in best.items()}


def test_cells_near_lines(spark):
    rng = random.Random(5)
    cells = [("p", c, -110 + rng.uniform(-0.03, 0.03), 44.9 + rng.uniform(-0.03, 0.03)) for c in range(300)]
    line = [(-110.02, 44.89), (-110.0, 44.9), (-109.98, 44.92), (-109.98, 44.92)]
    df = spark.createDataFrame(cells, "park string, cell bigint, lon double, lat double")
    lines_df = spark.createDataFrame([("p", "t", [{"lon": x, "lat": y} for x, y in line])], "park string, stop string, coords array<struct<lon:double,lat:double>>")

    def dist(lon, lat):
        kx = 111320.0 * math.cos(math.radians(lat))
        best = math.inf
        for (x1, y1), (x2, y2) in zip(line, line[1:]):
            ax, ay, dx, dy = (x1 - lon) * kx, (y1 - lat) * 110540.0, (x2 - x1) * kx, (y2 - y1) * 110540.0
            l2 = dx * dx + dy * dy
            t = max(0.0, min(1.0, -(ax * dx + ay * dy) / l2)) if l2 else 0.0
            best = min(best, math.hypot(ax + t * dx, ay + t * dy))
        return best

    got = {r.cell for r in spatial.cells_near_lines(df, lines_df, 300.0).collect()}
    assert got == {c for _, c, x, y in cells if dist(x, y) <= 300.0} and got


def test_place_rollup(spark):
    samples = spark.createDataFrame(
        [("p", "peak", -110.0, 44.9, 500.0), ("p", "trail", -110.1, 44.9, 300.0), ("p", "trail", -110.1005, 44.9, 300.0), ("p", "far", -109.0, 44.0, 500.0)],
        "park string, place string, lon double, lat double, radius_m double",
    )
    day = dt.date(2024, 6, 1)
    s = spark.createDataFrame(
        [("p", -110.001, 44.9, day, "Elk"), ("p", -110.0, 44.901, day, "Bison"), ("p", -110.1002, 44.9, day, "Elk")],
        "park string, lon double, lat double, observed_on date, scientific_name string",
    )
    pl = spark.createDataFrame([("p", x, x) for x in ("peak", "trail", "far")], "park string, id string, name string")
    out = {r.place: r for r in places.place_rollup(pl, spatial.place_hits(s, samples)).collect()}
    assert {k: v.n for k, v in out.items()} == {"peak": 2, "trail": 1, "far": 0}
    assert [t.scientific_name for t in out["peak"].top] == ["Bison", "Elk"]
    assert out["peak"].months[5] == 2 and sum(out["far"].months) == 0


# ---- lines and graph ---------------------------------------------------------------------------------------------------


def line_frame(spark, *pts):
    return spark.createDataFrame([("l", [{"lon": x, "lat": y} for x, y in pts])], "line string, coords array<struct<lon:double,lat:double>>")


def test_samples_step_evenly(spark):
    rng = random.Random(2)
    pts, lat = [], 44.0
    for _ in range(120):
        pts.append((-110.0, lat))
        lat += rng.uniform(0.0001, 0.0006)
    out = lines.resample(line_frame(spark, *pts), 50.0).orderBy("at_m").collect()
    for a, b in zip(out[:-2], out[1:-1]):
        assert hav((a.lon, a.lat), (b.lon, b.lat), 6371000.0) == pytest.approx(50.0, abs=1e-3)
    assert out[-1].lat == pts[-1][1]


def test_point_and_heading(spark):
    df = line_frame(spark, (-110.0, 44.0), (-110.0, 44.01), (-109.99, 44.01))
    at = spark.createDataFrame([("l", -5.0), ("l", 500.0), ("l", 1e9)], "line string, at_m double")
    got = lines.point_at(df, at).orderBy("at_m").collect()
    assert (got[0].lon, got[0].lat) == (-110.0, 44.0) and got[2].lon == -109.99
    assert got[1].lat == pytest.approx(44.0 + 500 / 111194.9, abs=1e-6)
    near_end = spark.createDataFrame([("l", 500.0), ("l", 1909.0)], "line string, at_m double")
    h = lines.heading_at(df, near_end, 50.0).orderBy("at_m").collect()
    assert h[0].heading == pytest.approx(0.0, abs=0.1) and h[1].heading == pytest.approx(90.0, abs=0.1)


def test_simplify_drops_what_is_straight(spark):
    pts = [(-110.0 + i * 1e-4, 44.0 + (1e-6 if i % 2 else 0.0)) for i in range(50)] + [(-109.995, 44.01)]
    n = line_frame(spark, *pts).select(F.size(lines.simplify(F.col("coords"), 5.0))).collect()[0][0]
    assert n == 3


def ways_frame(spark, ways):
    data = [(i, t, n, [{"lon": x, "lat": y} for x, y in g]) for i, t, n, g in ways]
    return spark.createDataFrame(data, "id bigint, tags map<string,string>, nodes array<bigint>, geometry array<struct<lon:double,lat:double>>")


@pytest.fixture()
def town(spark):
    """A road crossed by a trail at node 2, plus a private road."""
    return ways_frame(spark, [
        (1, {"highway": "primary", "name": "Main"}, [1, 2, 3], [(0.0, 0.0), (0.002, 0.0), (0.004, 0.0)]),
        (2, {"highway": "path"}, [4, 2, 5], [(0.002, -0.002), (0.002, 0.0), (0.002, 0.002)]),
        (3, {"highway": "primary", "access": "private"}, [1, 9], [(0.0, 0.0), (0.0, 0.01)]),
        (4, {"highway": "service"}, [1, 8], [(0.0, 0.0), (0.0, 0.02)]),
    ])


def test_graph_is_cut_at_junctions(town):
    kept = graph.usable_ways(town)
    assert [r.node for r in graph.junctions(kept).collect()] == [2]
    edges = graph.cut_edges(kept)
    assert edges.count() == 4
    assert graph.graph_nodes(edges).count() == 5
    assert {r.node for r in graph.graph_nodes(edges).filter("road").collect()} == {1, 2, 3}


def test_long_ways_are_cut_by_length(spark):
    w = ways_frame(spark, [(1, {"highway": "primary"}, list(range(11)), [(i * 0.001, 0.0) for i in range(11)])])
    lengths = [r.length_m for r in graph.cut_edges(w).orderBy("part").collect()]
    assert lengths == [334.0, 334.0, 334.0, 111.0]


def _grid(spark):
    """A one-way short cut, a long road and a trail."""
    data = [
        (1, 1, 2, 1000.0, 0, 0), (2, 2, 3, 1000.0, 0, 0), (3, 1, 3, 500.0, 0, 1), (4, 3, 4, 700.0, 1, 0), (5, 1, 2, 900.0, 0, 0),
    ]
    coords = [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}, {"lon": 2.0, "lat": 2.0}]
    return spark.createDataFrame([(*d, coords) for d in data], "edge_id bigint, src bigint, dst bigint, length_m double, kind int, oneway int, coords array<struct<lon:double,lat:double>>")


def test_shortest_distances_by_mode(spark):
    e = _grid(spark)
    src = spark.createDataFrame([(1,), (3,)], "node bigint")
    drive = {(r.source, r.node): r.dist for r in graph.shortest_distances(src, e, "drive").collect()}
    assert drive == {(1, 1): 0.0, (1, 2): 900.0, (1, 3): 500.0, (3, 3): 0.0, (3, 2): 1000.0, (3, 1): 1900.0}
    hike = {(r.source, r.node): r.dist for r in graph.shortest_distances(src, e, "hike").collect()}
    assert hike[(1, 4)] == 1200.0


def test_shortest_distances_equal_dijkstra(spark):
    import heapq

    rng = random.Random(9)
    data = [(i, rng.randrange(40), rng.randrange(40), float(rng.randrange(10, 99)), 0, rng.randrange(2)) for i in range(130)]
    data = [d for d in data if d[1] != d[2]]
    coords = [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}]
    e = spark.createDataFrame([(*d, coords) for d in data], "edge_id bigint, src bigint, dst bigint, length_m double, kind int, oneway int, coords array<struct<lon:double,lat:double>>")
    adj = {}
    for _, s, t, m, _, one in data:
        adj.setdefault(s, []).append((t, m))
        if not one:
            adj.setdefault(t, []).append((s, m))
    want = {}
    for s in (0, 1, 2):
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for v, m in adj.get(u, []):
                if d + m < dist.get(v, math.inf):
                    dist[v] = d + m
                    heapq.heappush(heap, (d + m, v))
        want.update({(s, n): d for n, d in dist.items()})
    src = spark.createDataFrame([(0,), (1,), (2,)], "node bigint")
    dist = graph.shortest_distances(src, e, "drive")
    assert {(r.source, r.node): r.dist for r in dist.collect()} == want
    # every path adds up to its distance
    targets = dist.select("source", F.col("node").alias("target"))
    walked = graph.trace_paths(dist, targets, e).join(e.select("edge_id", "length_m"), "edge_id")
    sums = {(r.source, r.target): r.m for r in walked.groupBy("source", "target").agg(F.sum("length_m").alias("m")).collect()}
    assert sums == {k: v for k, v in want.items() if v > 0}


def test_path_geometry_is_turned_and_stitched(spark):
    e = _grid(spark)
    dist = graph.shortest_distances(spark.createDataFrame([(3,)], "node bigint"), e, "drive")
    got = graph.trace_paths(dist, spark.createDataFrame([(3, 1)], "source bigint, target bigint"), e).orderBy("pos").collect()
    assert [r.edge_id for r in got] == [2, 5]
    assert [len(r.coords) for r in got] == [3, 2]
    assert got[0].coords[0].lon == 2.0


def test_distance_matrix_drops_the_unreachable(spark):
    e = _grid(spark)
    nodes = spark.createDataFrame([(1, 0.0, 0.0, True), (2, 0.01, 0.0, True), (3, 0.02, 0.0, True), (4, 0.03, 0.0, False), (7, 0.5, 0.5, True)], "node bigint, lon double, lat double, road boolean")
    sites = spark.createDataFrame([("t", "a", 0.0, 0.0, True), ("t", "b", 0.0101, 0.0, False), ("t", "z", 0.5, 0.5, False)], "trip string, site string, lon double, lat double, is_start boolean")
    got = {(r.from_site, r.to_site): (r.distance_m, r.seconds) for r in graph.distance_matrix(sites, nodes, e, "drive").collect()}
    assert set(got) == {("a", "b"), ("b", "a")}
    assert got[("a", "b")] == (900.0, pytest.approx(900 / 15.6 + 300))


def test_trail_rollup(spark):
    pts = [{"lon": -110.8, "lat": 44.0}, {"lon": -110.78, "lat": 44.0}, {"lon": -110.7, "lat": 44.0}]
    data = [(1, "T", 1, 500.0, pts), (2, "T", 1, 250.0, pts[:2]), (3, "Short", 1, 100.0, pts), (4, "Road", 0, 900.0, pts)]
    df = spark.createDataFrame(data, "edge_id bigint, name string, kind int, length_m double, coords array<struct<lon:double,lat:double>>")
    two = df.withColumn("park", F.lit("p")).union(df.filter("edge_id = 1").withColumn("park", F.lit("q")))
    got = sorted((r.park, r.name, r.length_m, r.pieces, r.lon) for r in rollups.trail_rollup(two).collect())
    assert got == [("p", "T", 750.0, 2, -110.78), ("q", "T", 500.0, 1, -110.78)]


# ---- tiles -------------------------------------------------------------------------------------------------------------------


def test_tiles_cover_exactly(spark):
    box = spark.createDataFrame([("k", -110.5, 44.8, -110.18, 44.91)], "key string, min_lon double, min_lat double, max_lon double, max_lat double")
    t = tiling.tile_boxes(box)
    assert t.count() == 21
    area = t.select(F.sum((F.col("tile.max_lon") - F.col("tile.min_lon")) * (F.col("tile.max_lat") - F.col("tile.min_lat")))).collect()[0][0]
    assert area == pytest.approx(0.32 * 0.11)
    assert tiling.quarter(t).count() == 84
    with pytest.raises(ValueError):
        tiling.tile_boxes(box, 0.1)


def test_adaptive_tiles_equal_a_walk(spark):
    rng = random.Random(4)
    pts = [(rng.gauss(0.1, 0.01), rng.gauss(0.1, 0.02)) for _ in range(800)]
    pts = [(abs(x), abs(y)) for x, y in pts]
    df = spark.createDataFrame(pts, "lon double, lat double")
    got = {(r.level, r.tx, r.ty): (r.n, r.status) for r in tiling.adaptive_tiles(df, (0.0, 0.0), cap=30).collect()}
    deepest = tiling.depth_limit(0.05)
    want = {}

    def walk(level, tx, ty, inside):
        state = "split" if len(inside) >= 30 and level < deepest else "capped" if len(inside) >= 30 else "done"
        want[(level, tx, ty)] = (len(inside), state)
        if state == "split":
            unit = 0.05 / 2**deepest
            sc = 2 ** (deepest - level - 1)
            for dx in (0, 1):
                for dy in (0, 1):
                    cx, cy = tx * 2 + dx, ty * 2 + dy
                    walk(level + 1, cx, cy, [p for p in inside if math.floor(math.floor(p[0] / unit) / sc) == cx and math.floor(math.floor(p[1] / unit) / sc) == cy])

    unit = 0.05 / 2**deepest
    roots = {(math.floor(math.floor(x / unit) / 2**deepest), math.floor(math.floor(y / unit) / 2**deepest)) for x, y in pts}
    for tx, ty in roots:
        walk(0, tx, ty, [p for p in pts if math.floor(math.floor(p[0] / unit) / 2**deepest) == tx and math.floor(math.floor(p[1] / unit) / 2**deepest) == ty])
    assert got == want


# ---- names in questions ------------------------------------------------------------------------------------------------------


def test_names_in_questions(spark):
    species = spark.createDataFrame(
        [
            ("Bison bison", "American Bison", [], None, 90), ("Cervus canadensis", "Wapiti", ["American Elk", "Elk"], None, 80),
            ("Ursus arctos", "Grizzly Bear", [], None, 9), ("Ursus americanus", "Black Bear", [], None, 30), ("Canis lupus", "Gray Wolf", [], "exclude", 5),
            ("Vulpes vulpes", "Red Fox", [], None, 7), ("Callospermophilus lateralis", "Golden-mantled Ground Squirrel", [], None, 3),
        ],
        "species string, common_name string, other_names array<string>, action string, sightings bigint",
    )
    questions = [
        ("a", "A spot with plenty of bison"), ("b", "best month for ELK"), ("c", "any bear around?"), ("d", "wolves lately, anyone"), ("e", "foxes and american bison"),
        ("f", "golden-mantled ground squirrels near camp"), ("g", "welkin"), ("h", "a grizzly bear"),
    ]
    q = spark.createDataFrame(questions, "qid string, text string")
    got = {}
    for r in search.match_species(q, species).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.species, r.score))
    assert got["a"] == [("Bison bison", 2.5)]
    assert got["b"] == [("Cervus canadensis", 3.0)]
    assert got["c"] == [("Ursus americanus", 2.0)] and "d" not in got
    assert got["e"] == [("Bison bison", 3.0), ("Vulpes vulpes", 2.0)]
    assert got["f"] == [("Callospermophilus lateralis", 3.0)]
    assert got["g"] == [("Cervus canadensis", 3.0)]
    assert got["h"][0] == ("Ursus arctos", 3.0)


# ---- report ---------------------------------------------------------------------------------------------------------------------


def test_species_bar_needs_every_band_above(spark):
    pred, rev = [], []
    for b, (score, right, wrong) in enumerate([(0.55, 3, 20), (0.65, 14, 3), (0.75, 16, 2), (0.9, 17, 1)]):
        for i in range(right + wrong):
            pred.append((f"i{b}_{i}", "full", score))
            rev.append((f"i{b}_{i}", "full", "tp", "yes" if i < right else "no"))
    p = spark.createDataFrame(pred, "image_id string, variant string, prediction_score double")
    r = spark.createDataFrame(rev, "image_id string, variant string, verdict string, species_agree string").withColumn("reviewer", F.lit("me"))
    got = {x.band: x.bar for x in report.species_precision(r, p).collect()}
    assert got == {"0.5-0.6": False, "0.6-0.7": True, "0.7-0.8": True, "0.8-1.0": True}
    only_top = {x.band: x.bar for x in report.species_precision(r.filter("image_id not like 'i2%'"), p).collect()}
    assert only_top["0.8-1.0"] is True and only_top["0.6-0.7"] is False


def test_compare_runs(spark):
    ddl = (
        "filepath string, prediction string, classifications struct<classes:array<string>,scores:array<double>>, "
        "detections array<struct<category:string,label:string,conf:double,bbox:array<double>>>"
    )
    def item(path, conf):
        return (path, "x", (["k"], [0.5]), [("1", "l", conf, [0.1, 0.1, 0.2, 0.2])])

    a = spark.createDataFrame([item("a.jpg", 0.5), item("b.jpg", 0.5)], ddl)
    assert report.compare_runs(a, a, 1e-6).collect()[0].identical is True
    b = spark.createDataFrame([item("/d/a.jpg", 0.75), item("/d/b.jpg", 0.5)], ddl)
    r = report.compare_runs(a, b, 1e-6).collect()[0]
    assert (r.n, r.max_score_diff, r.identical) == (2, 0.25, False)
    r = report.compare_runs(a, a.filter("filepath = 'a.jpg'"), 1e-6).collect()[0]
    assert (r.n, r.only_a, r.only_b, r.identical) == (1, 1, 0, False)


def test_reviewers_are_not_pooled(spark):
    ddl = "image_id string, variant string, det_idx int, reviewer string, verdict string"
    reviews = spark.createDataFrame([("a", "full", 0, "me", "tp"), ("a", "full", 0, "jo", "fp"), ("a", "yaw000", 0, "jo", "fp")], ddl)
    boxes = spark.createDataFrame([("a", "full", 0, 0.5), ("a", "yaw000", 0, 0.5)], "image_id string, variant string, det_idx int, conf double")
    images = spark.createDataFrame([("a", "c")], "image_id string, corridor string")
    with pytest.raises(quality.MixedReviewers):
        report.reviewed_boxes(reviews, boxes, images)
    assert [r.verdict for r in report.reviewed_boxes(reviews, boxes, images, "me").collect()] == ["tp"]
    assert [r.variant for r in report.reviewed_boxes(reviews, boxes, images, population="pano").collect()] == ["yaw000"]


def test_relative_months(spark):
    data = [("p", "a", [0, 0, 0, 0, 0, 30, 0, 0, 0, 0, 0, 0], 30), ("p", "b", [0, 0, 0, 10, 0, 80, 0, 0, 0, 0, 0, 0], 90), ("p", "c", [5] + [0] * 11, 5)]
    df = spark.createDataFrame(data, "park string, species string, months array<bigint>, sightings bigint")
    got = {r.species: (r.rel_peak, r.rel_max) for r in rollups.relative_months(df).collect()}
    assert got["b"][0] == 4 and got["a"][0] == 6 and got["c"] == (None, 0.0)


def test_hex_distance_helpers_agree(spark):
    c = spark.range(1).select(hexgrid.cell_of(F.lit(10.0), F.lit(50.0), 8).alias("c"))
    a = c.select(hexgrid.center(F.col("c")).alias("a"), hexgrid.center(F.col("c"), 8).alias("b")).collect()[0]
    assert a.a.lon == pytest.approx(a.b.lon) and a.a.lat == pytest.approx(a.b.lat)


@pytest.mark.parametrize("values", [1 << 22, 40])
def test_similar_labels_equal_brute_force(spark, monkeypatch, values):
    """One block of labels, and many; ties, other lengths and vectors without a direction."""
    monkeypatch.setattr(ranking, "LABEL_VALUES", values)
    monkeypatch.setattr(ranking, "VECTOR_BLOCK", 16)
    rng = random.Random(values)
    vec = lambda n=4: [rng.choice([-1.0, 0.5, 2.0, 3.0]) for _ in range(n)]
    labels = [(f"l{i}", vec()) for i in range(30)] + [("twin", [1.0, 2.0, 3.0, 4.0]), ("again", [2.0, 4.0, 6.0, 8.0]), ("short", [1.0, 2.0]), ("zero", [0.0] * 4)]
    vectors = [(i, vec()) for i in range(50)] + [(50, [1.0, 2.0, 3.0, 4.0]), (51, None), (52, []), (53, [0.0] * 4), (54, [1.0, None, 1.0, 1.0]), (55, [3.0, 1.0]), (56, [1.0] * 3), (57, [1e-200] * 4), (58, [float("nan")] * 4)]
    got = ranking.similar_labels(spark.createDataFrame(vectors, "vec_id int, vec array<double>"), spark.createDataFrame(labels, "label string, vec array<double>"), 3)
    unit = lambda x: [y / max(map(abs, x)) for y in x]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    rows, of = sorted(tuple(r) for r in got.collect()), dict(labels)
    want = []
    for i, v in vectors:
        if not v or None in v or not any(v) or v[0] != v[0]:
            continue
        best = sorted((cos(unit(v), unit(w)) for w in of.values() if len(w) == len(v) and any(w)), reverse=True)[:3]
        want += [(i, rank, pytest.approx(score)) for rank, score in enumerate(best, 1)]
    assert [(i, rank, score) for i, rank, _, score in rows] == want
    assert all(score == pytest.approx(cos(unit(vectors[i][1]), unit(of[name]))) for i, _, name, score in rows)
    assert len({(i, name) for i, _, name, _ in rows}) == len(rows)
    assert [name for i, _, name, _ in rows if i == 50][:2] == ["again", "twin"]
