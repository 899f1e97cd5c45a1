"""Declared schemas. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


SIGHTINGS_DDL = (
    "sighting_id string, source string not null, source_id string not null, dataset string, park string, "
    "confidence_basis string not null, taxon_id string, scientific_name string, common_name string, "
    "taxon_rank string, taxon_class string, observed_at timestamp_ntz, observed_on date, lon double, lat double, "
    "positional_accuracy_m double, coordinate_status string not null, observer string, license string, url string, "
    "attribution string, duplicate_of string, fetched_at timestamp_ntz, raw_json string"
)
IMAGES_DDL = (
    "image_id string, corridor string, lon double, lat double, lon_raw double, lat_raw double, position_source string, "
    "captured_at_ms bigint, captured_at timestamp_ntz, compass_angle double, computed_compass_angle double, "
    "camera_type string, is_pano boolean, make string, model string, width int, height int, quality_score double, "
    "sequence_id string, creator_id string, creator_username string, license string not null, source_url string not null, "
    "thumb_1024_url string, thumb_2048_url string, thumb_original_url string, mapillary_detections string, "
    "fetched_at timestamp_ntz, raw_json string"
)
TILES_DDL = (
    "tile_id string, corridor string, min_lon double, min_lat double, max_lon double, max_lat double, "
    "status string, n_images int, fetched_at timestamp_ntz"
)
DOWNLOADS_DDL = (
    "image_id string, local_path string, size_kind string, width int, height int, bytes bigint, sha256 string, "
    "error string, downloaded_at timestamp_ntz"
)
RUNS_DDL = (
    "run_id string, corridor string, population string, model_version string, speciesnet_version string, "
    "backend string, image_dir string, predictions_json string, n_files int, country string, admin1_region string, "
    "batch_size int, exit_code int, started_at timestamp_ntz, finished_at timestamp_ntz, notes string"
)
PREDICTIONS_DDL = (
    "image_id string, model_version string, variant string not null, run_id string, prediction string, "
    "prediction_score double, prediction_source string, top5_classes string, top5_scores string, n_detections int, "
    "max_animal_conf double, failures string, raw_json string, predicted_at timestamp_ntz"
)
DETECTIONS_DDL = (
    "image_id string, model_version string, variant string, det_idx int, category string, label string, conf double, "
    "bbox_x double, bbox_y double, bbox_w double, bbox_h double"
)
REVIEWS_DDL = (
    "image_id string, variant string, det_idx int, reviewer string, verdict string, true_species string, "
    "species_agree string, est_distance_m double, notes string, reviewed_at timestamp_ntz"
)
# Landed records.
OBSERVATION_DDL = (
    "id bigint, quality_grade string, observed_on string, time_observed_at string, obscured boolean, geoprivacy string, "
    "taxon_geoprivacy string, geojson struct<type:string,coordinates:array<double>>, positional_accuracy double, "
    "public_positional_accuracy double, license_code string, uri string, user struct<id:bigint,login:string>, "
    "taxon struct<id:bigint,name:string,preferred_common_name:string,rank:string,iconic_taxon_name:string>, "
    "faves_count int, photos array<struct<id:bigint,url:string,license_code:string>>, updated_at string"
)
OCCURRENCE_DDL = (
    "key bigint, datasetKey string, datasetName string, species string, scientificName string, "
    "acceptedScientificName string, taxonRank string, taxonKey bigint, class string, vernacularName string, "
    "decimalLatitude double, decimalLongitude double, coordinateUncertaintyInMeters double, dataGeneralizations string, "
    "informationWithheld string, eventDate string, year int, month int, day int, recordedBy string, license string, "
    "references string, basisOfRecord string, lastInterpreted string"
)
STREET_IMAGE_DDL = (
    "id string, geometry struct<type:string,coordinates:array<double>>, "
    "computed_geometry struct<type:string,coordinates:array<double>>, captured_at bigint, compass_angle double, "
    "computed_compass_angle double, camera_type string, is_pano boolean, make string, model string, width int, height int, "
    "quality_score double, sequence string, creator struct<id:string,username:string>, thumb_1024_url string, "
    "thumb_2048_url string, thumb_original_url string, detections string"
)
PREDICTION_FILE_DDL = (
    "predictions array<struct<filepath:string,model_version:string,prediction:string,prediction_score:double,"
    "prediction_source:string,failures:array<string>,classifications:struct<classes:array<string>,scores:array<double>>,"
    "detections:array<struct<category:string,label:string,conf:double,bbox:array<double>>>>>"
)
OSM_ELEMENT_DDL = (
    "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
)
OSM_WAY_DDL = (
    "type string, id bigint, tags map<string,string>, nodes array<bigint>, geometry array<struct<lon:double,lat:double>>"
)
DAILY_WEATHER_DDL = (
    "park string, daily struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,"
    "precipitation_sum:array<double>,snowfall_sum:array<double>>"
)
REVIEW_CSV_COLUMNS = (
    "image_id", "variant", "det_idx", "band", "conf", "predicted", "prediction_score", "prediction_source", "top5",
    "source_url", "frame_file", "crop_file", "verdict", "true_species", "species_agree", "est_distance_m", "notes",
)
# The canonical export projection, in order.
SIGHTING_EXPORT_COLUMNS = (
    "sighting_id", "source", "dataset", "park", "confidence_basis", "taxon_id", "scientific_name", "common_name",
    "taxon_rank", "taxon_class", "observed_at", "observed_on", "lon", "lat", "positional_accuracy_m",
    "coordinate_status", "observer", "license", "url", "attribution",
)

REVIEW_CSV = T.StructType([T.StructField(c, T.StringType()) for c in REVIEW_CSV_COLUMNS])

KEYS = {
    "images": ("image_id",),
    "tiles": ("tile_id",),
    "downloads": ("image_id",),
    "runs": ("run_id",),
    "predictions_raw": ("image_id", "model_version", "variant"),
    "detections_raw": ("image_id", "model_version", "variant", "det_idx"),
    "manual_review": ("image_id", "variant", "det_idx", "reviewer"),
    "sightings": ("sighting_id",),
}
APPEND_ONLY = ("predictions_raw", "detections_raw")


def __getattr__(name: str) -> T.StructType:
    """``SIGHTINGS``, ``IMAGES``...: the declared text parsed on first use, by the running session."""
    text = globals().get(f"{name}_DDL")
    if text is None:
        raise AttributeError(name)
    parsed = globals()[name] = T.StructType.fromDDL(text)
    return parsed


class SchemaMismatch(ValueError):
    """Stored columns are not the declared ones."""


def require_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Refuse a frame whose column names or types differ from the declaration."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    if have != want:
        diff = sorted(set(have.items()) ^ set(want.items()))
        raise SchemaMismatch(f"columns differ from the declared schema: {diff}")
    return df.select(*[f.name for f in expected])
