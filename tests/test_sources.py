from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from observatory import schemas
from observatory.operators import quality, rollups
from observatory.sources import readers, records, rules, sinks


def land(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.json"), "w") as fh:
        fh.write("\n".join(json.dumps(x) for x in lines))
    return path


def test_observations(spark, out_dir):
    path = land(f"{out_dir}/obs", [
        {"id": 1, "observed_on": "2024-06-01", "time_observed_at": "2024-06-01T08:00:00-06:00", "geojson": {"type": "Point", "coordinates": [-110.1, 44.6]},
         "license_code": "cc-by", "uri": "https://x/1", "user": {"login": "ann"}, "taxon": {"id": 5, "name": "Bison bison", "rank": "species"},
         "positional_accuracy": 12, "public_positional_accuracy": 30, "not_declared": {"a": [1]}},
        {"id": 2, "observed_on": "2024-06-02", "taxon_geoprivacy": "obscured", "geojson": {"type": "Point", "coordinates": [-110.2, 44.7]}, "taxon": {"name": "Ursus arctos"}},
        {"id": 3, "geoprivacy": "private"},
    ])
    raw = readers.read_json(spark, path, schemas.OBSERVATION)
    out = {r.source_id: r for r in records.normalize_observations(raw, F.lit("p")).collect()}
    a = out["1"]
    assert a.observed_at == dt.datetime(2024, 6, 1, 14) and a.coordinate_status == "open" and a.positional_accuracy_m == 30
    assert a.attribution == "ann via iNaturalist, CC BY 4.0, https://x/1"
    assert out["2"].coordinate_status == "obscured" and out["2"].license == "all rights reserved"
    assert out["3"].coordinate_status == "private" and out["3"].url.endswith("/observations/3")
    assert json.loads(a.raw_json)["taxon"]["id"] == 5 and json.loads(a.raw_json)["not_declared"] == {"a": [1]}


def test_occurrences(spark, out_dir):
    path = land(f"{out_dir}/occ", [
        {"key": 1, "datasetKey": "d", "species": "Bison bison", "taxonRank": "SPECIES", "decimalLatitude": 44.0, "decimalLongitude": -110.0,
         "coordinateUncertaintyInMeters": 1000.0, "eventDate": "2024-06-01/2024-06-05", "recordedBy": "Ann"},
        {"key": 2, "datasetKey": "d", "datasetName": "Set", "acceptedScientificName": "B b L.", "decimalLatitude": 44.0, "decimalLongitude": -110.0, "coordinateUncertaintyInMeters": 1001.0},
        {"key": 3, "decimalLatitude": 44.0, "decimalLongitude": -110.0, "dataGeneralizations": "10 km", "year": 2020, "month": 3, "day": 4},
        {"key": 4},
    ])
    out = {r.source_id: r for r in records.normalize_occurrences(readers.read_json(spark, path, schemas.OCCURRENCE), F.lit("p")).collect()}
    assert [out[k].coordinate_status for k in "1234"] == ["open", "obscured", "obscured", "missing"]
    assert out["1"].observed_on == dt.date(2024, 6, 1) and out["1"].taxon_rank == "species"
    assert out["3"].observed_on == dt.date(2020, 3, 4)
    assert out["2"].attribution == "unknown observer via GBIF (Set), license unspecified, https://www.gbif.org/occurrence/2"


def test_street_images(spark, out_dir):
    path = land(f"{out_dir}/img", [
        {"id": "7", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "computed_geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "captured_at": 1700000000000},
        {"id": "8", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}},
        {"id": "9"},
    ])
    out = {r.image_id: r for r in records.flatten_images(readers.read_json(spark, path, schemas.STREET_IMAGE), F.lit("c")).collect()}
    assert (out["7"].lon, out["7"].lon_raw, out["7"].position_source) == (1.5, 1.0, "computed")
    assert out["7"].captured_at == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert (out["8"].lon, out["8"].position_source) == (1.0, "gps")
    assert out["9"].lon is None and out["9"].license == "CC BY-SA 4.0"


def test_detector_files(spark, out_dir):
    os.makedirs(f"{out_dir}/det")
    with open(f"{out_dir}/det/p.json", "w") as fh:
        json.dump({"predictions": [
            {"filepath": "/a/1.jpg", "model_version": "m", "prediction": "x", "detections": [{"category": "1", "label": "animal", "conf": 0.4, "bbox": [0.1, 0.1, 0.2, 0.2]}, {"category": "3", "conf": 0.9, "bbox": [0, 0, 1, 1]}]},
            {"filepath": "/a/2__yaw090.jpg", "failures": ["LOAD"]},
        ]}, fh)
    items = records.prediction_items(readers.read_documents(spark, f"{out_dir}/det", schemas.PREDICTION_FILE))
    p = {r.image_id: r for r in records.prediction_rows(items, F.lit("run")).collect()}
    assert (p["1"].n_detections, p["1"].max_animal_conf, p["1"].failures) == (2, 0.4, None)
    assert (p["2"].variant, p["2"].model_version, p["2"].max_animal_conf, p["2"].failures) == ("yaw090", "unknown", None, '["LOAD"]')
    d = records.detection_rows(items).orderBy("det_idx").collect()
    assert [(r.det_idx, r.category, r.bbox_w) for r in d] == [(0, "1", 0.2), (1, "3", 1.0)]


def test_map_elements_and_park_tree(spark, out_dir):
    for park in ("acadia", "zion"):
        os.makedirs(f"{out_dir}/{park}")
        with open(f"{out_dir}/{park}/osm.json", "w") as fh:
            json.dump({"elements": [
                {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": park}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "nodes": [1, 2], "geometry": [{"lat": 0.0, "lon": 0.0}, {"lat": 1.0, "lon": 1.0}]},
            ]}, fh)
    pts = records.osm_points(readers.read_elements(spark, f"{out_dir}/acadia/osm.json"))
    assert sorted((r.id, r.lon, r.lat) for r in pts.collect()) == [("node/1", 2.0, 1.0), ("way/2", 4.0, 3.0)]
    ways = readers.read_elements(spark, f"{out_dir}/zion/osm.json", ways=True).collect()
    assert len(ways) == 1 and ways[0].nodes == [1, 2]
    tree = readers.read_park_tree(spark, out_dir, "osm.json", spark.createDataFrame([], "elements array<struct<id:bigint>>").schema)
    assert sorted(r.park for r in tree.collect()) == ["acadia", "zion"]


def test_review_csv_round_trip(spark, out_dir):
    sample = spark.createDataFrame(
        [("i1", "full", 0, "0.5-0.8", 0.61249, "u;m;o;f;bison;bison;american bison", 0.7, "clf", '["blank"]', "u")],
        "image_id string, variant string, det_idx int, band string, conf double, prediction string, prediction_score double, prediction_source string, top5_classes string, source_url string",
    )
    path = f"{out_dir}/review"
    sinks.write_review_template(records.review_template(sample), path)
    sinks.write_review_template(records.review_template(sample).limit(0), path)
    back = readers.read_review_csv(spark, path)
    row = back.collect()[0]
    assert (row.predicted, row.conf, row.top5, row.frame_file) == ("american bison", "0.612", "blank", "i1_full_0_frame.jpg")
    assert records.review_rows(back).count() == 0
    filled = back.withColumn("verdict", F.lit(" TP ")).withColumn("est_distance_m", F.lit("70")).withColumn("true_species", F.lit(" Bison "))
    r = records.review_rows(filled).collect()[0]
    assert (r.verdict, r.est_distance_m, r.true_species, r.reviewer) == ("tp", 70.0, "Bison", "me")
    with pytest.raises(PySparkException):
        records.review_rows(back.withColumn("verdict", F.lit("maybe"))).collect()


def test_upsert_and_append(spark, out_dir):
    ddl = "k int, v string, at int"
    have = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], ddl)
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], ddl)
    merged = sinks.upsert(have, new, ["k"], [F.col("at")])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    again = sinks.upsert(merged, new, ["k"], [F.col("at")])
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in merged.collect())
    path = f"{out_dir}/append"
    assert sinks.append_new(path, have, new, ["k"], [F.col("at")]) == 1
    assert sinks.append_new(path, have.unionByName(spark.read.parquet(path)), new, ["k"], [F.col("at")]) == 0
    with pytest.raises(ValueError):
        sinks.require_append("predictions_raw", "overwrite")


def test_scope_replacement_leaves_no_stale_rows(spark, out_dir):
    path = f"{out_dir}/derived"
    rows = spark.createDataFrame([("s", "c1", 1), ("s", "c1", 2), ("s", "c2", 3)], "source string, corridor string, v int")
    sinks.replace_partitions(rows, path, ["source", "corridor"])
    sinks.replace_partitions(spark.createDataFrame([("s", "c1", 9)], rows.schema), path, ["source", "corridor"])
    assert sorted((r.corridor, r.v) for r in spark.read.parquet(path).collect()) == [("c1", 9), ("c2", 3)]


def test_published_parquet_and_manifest(spark, out_dir):
    base = spark.range(20).select(
        F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("sighting_id"), F.lit("gbif").alias("source"), F.lit("p").alias("park"),
        F.date_add(F.lit("2024-01-01").cast("date"), (20 - F.col("id")).cast("int")).alias("observed_on"), F.lit("open").alias("coordinate_status"),
        F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.when(F.col("id") == 3, "x").alias("duplicate_of"),
    )
    for f in schemas.SIGHTINGS:
        if f.name not in base.columns:
            base = base.withColumn(f.name, F.lit(None).cast(f.dataType))
    path = f"{out_dir}/sightings"
    assert sinks.write_sightings(base, path) == 19
    back = readers.read_open_sightings(spark, path)
    assert back.count() == 19 and set(back.columns) == set(schemas.SIGHTING_EXPORT_COLUMNS)
    m = sinks.manifest(spark, path, "*.parquet")
    stored = spark.createDataFrame(m.collect(), m.schema)
    assert sinks.verify_manifest(stored, sinks.manifest(spark, path, "*.parquet")).count() == 0
    changed = stored.withColumn("sha256", F.lit("0"))
    assert {r.problem for r in sinks.verify_manifest(changed, m).collect()} == {"changed"}
    assert {r.problem for r in sinks.verify_manifest(stored.limit(0), m).collect()} == {"unlisted"}


def test_documents_per_park(spark, out_dir):
    path = f"{out_dir}/docs"
    sinks.write_documents(spark.createDataFrame([("a", '{"x":1}'), ("b", '{"x":2}')], "park string, value string"), path)
    assert sorted(r.park for r in spark.read.text(path).collect()) == ["a", "b"]


def test_rule_files(spark, out_dir):
    with open(f"{out_dir}/r.toml", "w") as fh:
        fh.write('[zion]\nname = "Zion"\nstate = "UT"\nbbox = [-113.2, 37.1, -112.8, 37.5]\ntour = ["A", "B"]\n[zion.tour_fallback]\nB = [-113.0, 37.2]\n"A@wiki" = "Alpha"\n')
    r = rules.load_regions(spark, f"{out_dir}/r.toml").collect()[0]
    assert (r.key, r.min_lon, r.max_lat) == ("zion", -113.2, 37.5)
    tours = rules.load_tours(spark, f"{out_dir}/r.toml").orderBy("pos").collect()
    assert (tours[0].article, tours[0].fb_lon, tours[1].fb_lon) == ("Alpha", None, -113.0)
    with open(f"{out_dir}/bad.toml", "w") as fh:
        fh.write('[x]\nname = "x"\nbbox = [37.1, -113.2, 37.5, -112.8]\n')
    with pytest.raises(ValueError):
        rules.load_regions(spark, f"{out_dir}/bad.toml")


def test_schema_guard(spark):
    good = spark.createDataFrame([], schemas.TILES)
    assert schemas.require_schema(good, schemas.TILES).columns == [f.name for f in schemas.TILES]
    with pytest.raises(schemas.SchemaMismatch):
        schemas.require_schema(good.drop("status"), schemas.TILES)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0), (2, 44.0, -110.0), (3, None, 1.0)], "id int, lon double, lat double")
    checks = {"position": quality.lon_lat_violation(F.col("lon"), F.col("lat"))}
    assert [(r.key, r.reason) for r in quality.violations(df, checks, "id").collect()] == [("2", "latitude out of range")]
    good, bad = quality.split_quarantine(df, checks)
    assert good.count() == 2 and bad.count() == 1
    with pytest.raises(PySparkException):
        quality.enforce(df.withColumn("id", F.col("id").cast("string")), checks, "id").collect()
    strict = {"position": quality.lon_lat_violation(F.col("lon"), F.col("lat"), allow_null=False)}
    assert quality.violations(df, strict, "id").count() == 2
    quality.check_conservation(3, 2, 1)
    with pytest.raises(ValueError):
        quality.check_conservation(3, 2, 2)


def test_ledger(spark, out_dir):
    df = spark.range(10)
    e = quality.ledger_entry(df, "s", "even", F.col("id") % 2 == 0, {"odd": F.col("id") % 2 == 1}).collect()[0]
    assert (e.n_in, e.n_out, e.n_dropped, e.dropped_odd) == (10, 5, 5, 5)
    quality.append_ledger(spark, f"{out_dir}/ledger", "s", "even", 10, 5, seed=3)
    quality.append_ledger(spark, f"{out_dir}/ledger", "s", "even", 4, 4)
    r = quality.ledger_summary(spark, f"{out_dir}/ledger").collect()[0]
    assert (r.n_in, r.n_out, r.n_dropped) == (14, 9, 5)
    quality.record_sample(df, f"{out_dir}/sample", ["id"], seed=7)
    assert spark.read.json(f"{out_dir}/sample").count() == 10


def test_reviewers_are_not_pooled(spark):
    df = spark.createDataFrame([("a", "c"), ("me", "c"), ("b", "d")], "reviewer string, corridor string")
    with pytest.raises(quality.MixedReviewers):
        quality.single_reviewer(df)
    assert quality.single_reviewer(df, "a").count() == 1
    assert {r.corridor: r.reviewer for r in quality.choose_reviewer(df, ["corridor"]).collect()} == {"c": "me", "d": "b"}
    assert {r.corridor: r.reviewer for r in quality.choose_reviewer(df, ["corridor"], "a").collect()} == {"c": "a", "d": "b"}


def test_seed_parks(spark):
    have = spark.createDataFrame([("zion", "Zion National Park")], "park string, name string")
    seeds = spark.createDataFrame([("zion", "Other"), ("z2", "ZION national park"), ("arches", "Arches")], "park string, name string")
    got = {r.park: r.configured for r in rollups.add_seed_parks(have, seeds).collect()}
    assert got == {"zion": True, "arches": False}


def test_resume_and_changes(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "tile_id string")
    done = spark.createDataFrame([("a", "done"), ("b", "error")], "tile_id string, status string")
    assert sorted(r.tile_id for r in records.unfinished(work, done).collect()) == ["b", "c"]
