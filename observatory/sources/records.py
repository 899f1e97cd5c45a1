"""Landed records to the model's tables. Pure projections: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.functions import names, text, times

# The uncertainty above which a position is a guess, the animal
# category code, the licence of street images and their page address.
OBSCURED_UNCERTAINTY_M = 1000.0
ANIMAL_CATEGORY = "1"
HUMAN_CATEGORY = "2"
VEHICLE_CATEGORY = "3"
STREET_LICENSE = "CC BY-SA 4.0"
STREET_PAGE = "https://www.mapillary.com/app/?pKey="
OBSERVATION_PAGE = "https://www.inaturalist.org/observations/"
OCCURRENCE_PAGE = "https://www.gbif.org/occurrence/"


def _source(df: DataFrame) -> Column:
    """The record as it came: its source text where the reader kept it, else its columns as JSON."""
    if "source_text" in df.columns:
        return F.col("source_text")
    return F.to_json(F.struct(*df.columns))


def _point(geometry: Column) -> tuple[Column, Column]:
    ok = (geometry["type"] == "Point") & (F.size(geometry["coordinates"]) >= 2)
    return (
        F.when(ok, F.get(geometry["coordinates"], F.lit(0))),
        F.when(ok, F.get(geometry["coordinates"], F.lit(1))),
    )


def _non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_observations(obs: DataFrame, park: Column) -> DataFrame:
    """Observation records to ``sightings`` rows."""
    lon, lat = _point(F.col("geojson"))
    hidden = F.array(F.lit("obscured"), F.lit("private"))
    obscured = (
        F.coalesce(F.col("obscured"), F.lit(False))
        | F.coalesce(F.array_contains(hidden, F.col("geoprivacy")), F.lit(False))
        | F.coalesce(F.array_contains(hidden, F.col("taxon_geoprivacy")), F.lit(False))
    )
    status = (
        F.when(lon.isNull() & (F.col("geoprivacy") == "private"), "private")
        .when(lon.isNull(), "missing")
        .when(obscured, "obscured")
        .otherwise("open")
    )
    sid = F.col("id").cast("string")
    url = F.coalesce(_non_empty(F.col("uri")), F.concat(F.lit(OBSERVATION_PAGE), sid))
    lic = text.license_name(F.col("license_code"))
    accuracy = F.coalesce(
        F.nullif(F.col("public_positional_accuracy"), F.lit(0.0)), F.col("positional_accuracy")
    )
    return obs.select(
        F.concat(F.lit("inaturalist:"), sid).alias("sighting_id"),
        F.lit("inaturalist").alias("source"),
        sid.alias("source_id"),
        F.lit("inaturalist").alias("dataset"),
        park.alias("park"),
        F.lit("human_verified").alias("confidence_basis"),
        F.col("taxon.id").cast("string").alias("taxon_id"),
        F.col("taxon.name").alias("scientific_name"),
        F.col("taxon.preferred_common_name").alias("common_name"),
        F.col("taxon.rank").alias("taxon_rank"),
        F.col("taxon.iconic_taxon_name").alias("taxon_class"),
        times.instant_to_ntz(F.col("time_observed_at")).alias("observed_at"),
        F.col("observed_on").try_cast("date").alias("observed_on"),
        lon.alias("lon"),
        lat.alias("lat"),
        accuracy.alias("positional_accuracy_m"),
        status.alias("coordinate_status"),
        F.col("user.login").alias("observer"),
        lic.alias("license"),
        url.alias("url"),
        text.attribution("inaturalist", F.col("user.login"), lic, url).alias("attribution"),
        F.lit(None).cast("string").alias("duplicate_of"),
        _source(obs).alias("raw_json"),
    )


def normalize_occurrences(occ: DataFrame, park: Column) -> DataFrame:
    """Occurrence records to ``sightings`` rows."""
    lon, lat = F.col("decimalLongitude"), F.col("decimalLatitude")
    vague = F.coalesce(
        F.nullif(F.length("dataGeneralizations"), F.lit(0)), F.nullif(F.length("informationWithheld"), F.lit(0))
    ).isNotNull() | F.coalesce(F.col("coordinateUncertaintyInMeters") > OBSCURED_UNCERTAINTY_M, F.lit(False))
    status = F.when(lon.isNull() | lat.isNull(), "missing").when(vague, "obscured").otherwise("open")
    sid = F.col("key").cast("string")
    url = F.coalesce(_non_empty(F.col("references")), F.concat(F.lit(OCCURRENCE_PAGE), sid))
    title = F.coalesce(_non_empty(F.col("datasetName")), F.col("datasetKey"))
    return occ.select(
        F.concat(F.lit("gbif:"), sid).alias("sighting_id"),
        F.lit("gbif").alias("source"),
        sid.alias("source_id"),
        F.col("datasetKey").alias("dataset"),
        park.alias("park"),
        F.lit("human_verified").alias("confidence_basis"),
        F.col("taxonKey").cast("string").alias("taxon_id"),
        F.coalesce(
            _non_empty(F.col("species")), _non_empty(F.col("acceptedScientificName")), F.col("scientificName")
        ).alias("scientific_name"),
        F.col("vernacularName").alias("common_name"),
        _non_empty(F.lower("taxonRank")).alias("taxon_rank"),
        F.col("class").alias("taxon_class"),
        times.event_instant(F.col("eventDate")).alias("observed_at"),
        times.event_day(F.col("eventDate"), F.col("year"), F.col("month"), F.col("day")).alias("observed_on"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.col("coordinateUncertaintyInMeters").alias("positional_accuracy_m"),
        status.alias("coordinate_status"),
        F.col("recordedBy").alias("observer"),
        F.col("license").alias("license"),
        url.alias("url"),
        text.attribution("gbif", _non_empty(F.col("recordedBy")), _non_empty(F.col("license")), url, title).alias("attribution"),
        F.lit(None).cast("string").alias("duplicate_of"),
        _source(occ).alias("raw_json"),
    )


def flatten_images(rec: DataFrame, corridor: Column) -> DataFrame:
    """Street-image records to ``images`` rows (S3)."""
    c_lon, c_lat = _point(F.col("computed_geometry"))
    r_lon, r_lat = _point(F.col("geometry"))
    wrapped = F.get_json_object("detections", "$.data")
    return rec.select(
        F.col("id").alias("image_id"),
        corridor.alias("corridor"),
        F.when(c_lon.isNotNull(), c_lon).otherwise(r_lon).alias("lon"),
        F.when(c_lon.isNotNull(), c_lat).otherwise(r_lat).alias("lat"),
        r_lon.alias("lon_raw"),
        r_lat.alias("lat_raw"),
        F.when(c_lon.isNotNull(), "computed").otherwise("gps").alias("position_source"),
        F.col("captured_at").alias("captured_at_ms"),
        times.millis_to_ntz(F.col("captured_at")).alias("captured_at"),
        "compass_angle",
        "computed_compass_angle",
        "camera_type",
        "is_pano",
        "make",
        "model",
        "width",
        "height",
        "quality_score",
        F.col("sequence").alias("sequence_id"),
        F.col("creator.id").alias("creator_id"),
        F.col("creator.username").alias("creator_username"),
        F.lit(STREET_LICENSE).alias("license"),
        F.concat(F.lit(STREET_PAGE), F.col("id")).alias("source_url"),
        "thumb_1024_url",
        "thumb_2048_url",
        "thumb_original_url",
        F.coalesce(wrapped, F.col("detections")).alias("mapillary_detections"),
        _source(rec).alias("raw_json"),
    )


def prediction_items(files: DataFrame) -> DataFrame:
    """One row per prediction of landed detector files."""
    return files.select(F.explode("predictions").alias("p")).select("p.*")


def prediction_rows(items: DataFrame, run_id: Column) -> DataFrame:
    """Detector items to ``predictions_raw`` rows."""
    who = names.image_and_variant(F.col("filepath"))
    boxes = F.coalesce(F.col("detections"), F.array().cast("array<struct<category:string,label:string,conf:double,bbox:array<double>>>"))
    animal = F.transform(F.filter(boxes, lambda d: d["category"] == ANIMAL_CATEGORY), lambda d: d["conf"])
    return items.select(
        who["image_id"].alias("image_id"),
        F.coalesce(_non_empty(F.col("model_version")), F.lit("unknown")).alias("model_version"),
        who["variant"].alias("variant"),
        run_id.alias("run_id"),
        "prediction",
        "prediction_score",
        "prediction_source",
        F.coalesce(F.to_json("classifications.classes"), F.lit("[]")).alias("top5_classes"),
        F.coalesce(F.to_json("classifications.scores"), F.lit("[]")).alias("top5_scores"),
        F.size(boxes).alias("n_detections"),
        F.array_max(animal).alias("max_animal_conf"),
        F.when(F.size("failures") > 0, F.to_json("failures")).alias("failures"),
        _source(items).alias("raw_json"),
    )


def detection_rows(items: DataFrame) -> DataFrame:
    """Detector items to one ``detections_raw`` row per box."""
    who = names.image_and_variant(F.col("filepath"))
    return items.select(
        who["image_id"].alias("image_id"),
        F.coalesce(_non_empty(F.col("model_version")), F.lit("unknown")).alias("model_version"),
        who["variant"].alias("variant"),
        F.posexplode("detections").alias("det_idx", "d"),
    ).select(
        "image_id",
        "model_version",
        "variant",
        "det_idx",
        "d.category",
        "d.label",
        "d.conf",
        *[F.get("d.bbox", F.lit(i)).alias(f"bbox_{n}") for i, n in enumerate("xywh")],
    )


def osm_points(elements: DataFrame) -> DataFrame:
    """Map elements with the node's own position or the way's centre."""
    return elements.select(
        F.concat_ws("/", "type", "id").alias("id"),
        F.coalesce("lon", "center.lon").alias("lon"),
        F.coalesce("lat", "center.lat").alias("lat"),
        "tags",
    )


def daily_weather(series: DataFrame) -> DataFrame:
    """Parallel daily arrays to one row per day."""
    zipped = F.arrays_zip(
        F.col("daily.time").alias("date"),
        F.col("daily.temperature_2m_max").alias("tmax"),
        F.col("daily.temperature_2m_min").alias("tmin"),
        F.col("daily.precipitation_sum").alias("precip"),
        F.col("daily.snowfall_sum").alias("snow"),
    )
    return series.select("park", F.inline(zipped)).withColumn("date", F.col("date").cast("date"))


def review_rows(csv: DataFrame, reviewer: str = "me") -> DataFrame:
    """Filled review CSV rows to ``manual_review`` rows; blanks are skipped."""
    def clean(c: str) -> Column:
        return _non_empty(F.trim(c))

    verdict = F.lower(clean("verdict"))
    return csv.filter(verdict.isNotNull()).select(
        "image_id",
        F.coalesce(clean("variant"), F.lit("full")).alias("variant"),
        F.col("det_idx").cast("int").alias("det_idx"),
        F.lit(reviewer).alias("reviewer"),
        F.when(
            verdict.isin("tp", "fp", "unsure"), verdict
        ).otherwise(F.raise_error(F.concat(F.lit("bad verdict "), verdict, F.lit(" for "), F.col("image_id")))).alias("verdict"),
        clean("true_species").alias("true_species"),
        F.lower(clean("species_agree")).alias("species_agree"),
        clean("est_distance_m").cast("double").alias("est_distance_m"),
        clean("notes").alias("notes"),
    )


def review_template(sample: DataFrame) -> DataFrame:
    """A drawn sample in the columns a reviewer fills in."""
    stem = F.concat_ws("_", "image_id", "variant", F.col("det_idx").cast("string"))
    top5 = F.transform(F.from_json("top5_classes", "array<string>"), names.display_name)
    blank = [F.lit("").alias(c) for c in ("verdict", "true_species", "species_agree", "est_distance_m", "notes")]
    return sample.select(
        "image_id",
        "variant",
        "det_idx",
        "band",
        F.bround("conf", 3).alias("conf"),
        names.display_name(F.col("prediction")).alias("predicted"),
        F.bround("prediction_score", 3).alias("prediction_score"),
        "prediction_source",
        F.array_join(top5, " | ").alias("top5"),
        "source_url",
        F.concat(stem, F.lit("_frame.jpg")).alias("frame_file"),
        F.concat(stem, F.lit("_crop.jpg")).alias("crop_file"),
        *blank,
    )


def union_sources(*normalised: DataFrame) -> DataFrame:
    """Normalised sources as one table, columns by name."""
    out = normalised[0]
    for more in normalised[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def changed_since(df: DataFrame, column: str, since: str) -> DataFrame:
    """Records whose change stamp is on or after a date (S17); pushes to the scan."""
    return df.filter(F.col(column) >= F.lit(since))


def without_datasets(df: DataFrame, skip: DataFrame, key: str = "datasetKey") -> DataFrame:
    """Records of every dataset not on the skip list."""
    return df.join(skip.select(key), key, "left_anti")


def dataset_counts(df: DataFrame, key: str = "datasetKey") -> DataFrame:
    """Facet counts, so a mirror's share shows before ingest."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def unfinished(work: DataFrame, ledger: DataFrame, key: str = "tile_id") -> DataFrame:
    """Work not finished by an earlier run; ``error`` entries are retried."""
    done = ledger.filter(F.col("status") != "error").select(key).distinct()
    return work.join(done, key, "left_anti")
