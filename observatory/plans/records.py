"""Queries over landed records, text, photos, sinks, quality and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from observatory import schemas
from observatory.functions import labels, names, stats, text, times
from observatory.operators import quality, ranking, search
from observatory.plans import testbed as tb
from observatory.plans.camera import rounded
from observatory.plans.registry import query
from observatory.session import materialise
from observatory.sources import records, sinks


def o(sql: str, *ctes: str, extra: str = "") -> str:
    return tb.oracle(sql, *ctes, extra=extra)


# ---- landed records -------------------------------------------------------------------
# The tables are written as the JSON a source would land, then read with the
# declared schema and normalised.

_OBS_JSON = """SELECT to_json(named_struct('id', event_id, 'observed_on', CAST(CAST(ts AS DATE) AS STRING),
  'time_observed_at', CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 'junk' ELSE concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), CASE WHEN event_id % 2 = 0 THEN '-06:00' ELSE 'Z' END) END,
  'obscured', event_id % 6 = 0, 'geoprivacy', CASE WHEN event_id % 8 = 0 THEN 'private' END, 'taxon_geoprivacy', CASE WHEN event_id % 10 = 0 THEN 'obscured' END,
  'geojson', CASE WHEN event_id % 7 = 0 THEN NULL ELSE named_struct('type', 'Point', 'coordinates', array((event_id % 3600) / 20e0 - 90, (event_id % 1700) / 20e0 - 40)) END,
  'positional_accuracy', CAST(event_id % 50 AS DOUBLE), 'public_positional_accuracy', CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 900 AS DOUBLE) END,
  'license_code', CASE event_id % 5 WHEN 0 THEN 'cc-by' WHEN 1 THEN 'cc0' WHEN 2 THEN 'odd' WHEN 3 THEN '' END, 'uri', CASE WHEN event_id % 2 = 0 THEN concat('https://example.org/o/', event_id) END,
  'user', named_struct('id', user_id, 'login', CASE WHEN user_id % 4 <> 0 THEN concat('u', user_id) END),
  'taxon', named_struct('id', user_id, 'name', event_type, 'preferred_common_name', upper(event_type), 'rank', 'species', 'iconic_taxon_name', 'Aves'))) AS value FROM events"""


def _landed(spark, sf, text_sql, schema, *tables):
    tb.register(spark, sf, *tables)
    return spark.sql(text_sql).select(F.from_json("value", schema).alias("r")).select("r.*")


@query(
    "normalize_observations",
    """SELECT 'inaturalist:' || event_id AS sighting_id, CASE WHEN event_id % 7 = 0 AND event_id % 8 = 0 THEN 'private' WHEN event_id % 7 = 0 THEN 'missing'
     WHEN event_id % 6 = 0 OR event_id % 8 = 0 OR event_id % 10 = 0 THEN 'obscured' ELSE 'open' END AS coordinate_status,
     CASE WHEN event_id % 4 = 0 OR event_id % 9 = 0 THEN '-' ELSE strftime(date_trunc('second', ts) + CASE WHEN event_id % 2 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') END AS observed_at,
     CAST(CAST(ts AS DATE) AS VARCHAR) AS observed_on, CASE WHEN event_id % 7 = 0 THEN -999e0 ELSE (event_id % 3600) / 20e0 - 90 END AS lon,
     CASE WHEN event_id % 3 = 0 AND event_id % 900 <> 0 THEN event_id % 900 ELSE event_id % 50 END * 1e0 AS accuracy,
     CASE event_id % 5 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'CC0 1.0' WHEN 2 THEN 'odd' ELSE 'all rights reserved' END AS license,
     CASE WHEN event_id % 2 = 0 THEN 'https://example.org/o/' ELSE 'https://www.inaturalist.org/observations/' END || event_id AS url,
     CASE WHEN user_id % 4 <> 0 THEN 'u' || user_id ELSE 'iNaturalist user' END || ' via iNaturalist, ' || CASE event_id % 5 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'CC0 1.0' WHEN 2 THEN 'odd' ELSE 'all rights reserved' END
      || ', ' || CASE WHEN event_id % 2 = 0 THEN 'https://example.org/o/' ELSE 'https://www.inaturalist.org/observations/' END || event_id AS attribution FROM events""",
)
def observations(spark, sf):
    obs = _landed(spark, sf, _OBS_JSON, schemas.OBSERVATION, "events")
    s = records.normalize_observations(obs, F.lit("park0"))
    return s.select(
        "sighting_id", "coordinate_status", F.coalesce(F.col("observed_at").cast("string"), F.lit("-")).alias("observed_at"),
        F.col("observed_on").cast("string").alias("observed_on"), F.coalesce("lon", F.lit(-999.0)).alias("lon"),
        F.col("positional_accuracy_m").alias("accuracy"), "license", "url", "attribution",
    )


_OCC_JSON = """SELECT to_json(named_struct('key', o_orderkey, 'datasetKey', concat('ds', o_custkey % 7), 'datasetName', CASE WHEN o_custkey % 7 > 3 THEN concat('Set ', o_custkey % 7) END,
  'species', CASE WHEN o_orderkey % 3 = 0 THEN 'Alces alces' END, 'acceptedScientificName', CASE WHEN o_orderkey % 3 = 1 THEN 'Alces alces L.' END, 'scientificName', 'Alces',
  'taxonRank', CASE WHEN o_orderkey % 5 <> 0 THEN 'SPECIES' END, 'taxonKey', o_custkey, 'class', 'Mammalia',
  'decimalLatitude', CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 1700) / 20e0 END, 'decimalLongitude', (o_orderkey % 3600) / 20e0 - 90,
  'coordinateUncertaintyInMeters', CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 2000 AS DOUBLE) END, 'dataGeneralizations', CASE o_orderkey % 9 WHEN 0 THEN 'to 10 km' WHEN 1 THEN '' END,
  'informationWithheld', CASE WHEN o_orderkey % 13 = 0 THEN 'yes' END,
  'eventDate', CASE o_orderkey % 6 WHEN 0 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:00:00Z') WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
    WHEN 2 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), '/2005-01-01') WHEN 3 THEN '1999' WHEN 4 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:00:00+02:00/2005-01-01') END,
  'year', year(o_orderdate), 'month', month(o_orderdate), 'day', day(o_orderdate), 'recordedBy', CASE WHEN o_orderkey % 2 = 0 THEN 'Ann' END, 'license', CASE WHEN o_orderkey % 3 = 0 THEN 'CC' END,
  'references', CASE WHEN o_orderkey % 10 = 0 THEN 'https://example.org/x' END)) AS value FROM orders"""


@query(
    "normalize_occurrences",
    """SELECT 'gbif:' || o_orderkey AS sighting_id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 9 = 0 OR o_orderkey % 13 = 0 OR (o_orderkey % 4 <> 0 AND o_orderkey % 2000 > 1000) THEN 'obscured' ELSE 'open' END AS coordinate_status,
     CASE o_orderkey % 3 WHEN 0 THEN 'Alces alces' WHEN 1 THEN 'Alces alces L.' ELSE 'Alces' END AS scientific_name, CASE WHEN o_orderkey % 5 <> 0 THEN 'species' ELSE '-' END AS taxon_rank,
     CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 10:00:00' WHEN 4 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 08:00:00' ELSE '-' END AS observed_at,
     CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS observed_on,
     CASE WHEN o_orderkey % 2 = 0 THEN 'Ann' ELSE 'unknown observer' END || ' via GBIF (' || CASE WHEN o_custkey % 7 > 3 THEN 'Set ' ELSE 'ds' END || (o_custkey % 7) || '), ' || CASE WHEN o_orderkey % 3 = 0 THEN 'CC' ELSE 'license unspecified' END
      || ', ' || CASE WHEN o_orderkey % 10 = 0 THEN 'https://example.org/x' ELSE 'https://www.gbif.org/occurrence/' || o_orderkey END AS attribution FROM orders""",
)
def occurrences(spark, sf):
    occ = _landed(spark, sf, _OCC_JSON, schemas.OCCURRENCE, "orders")
    s = records.normalize_occurrences(occ, F.lit("park0"))
    return s.select(
        "sighting_id", "coordinate_status", "scientific_name", F.coalesce("taxon_rank", F.lit("-")).alias("taxon_rank"),
        F.coalesce(F.col("observed_at").cast("string"), F.lit("-")).alias("observed_at"), F.col("observed_on").cast("string").alias("observed_on"), "attribution",
    )


_IMG_JSON = """SELECT to_json(named_struct('id', CAST(event_id AS STRING), 'geometry', CASE WHEN event_id % 9 <> 0 THEN named_struct('type', 'Point', 'coordinates', array((event_id % 360) - 180e0, (event_id % 180) - 90e0)) END,
  'computed_geometry', CASE WHEN event_id % 3 = 0 THEN named_struct('type', 'Point', 'coordinates', array((event_id % 360) - 179.5e0, (event_id % 180) - 89.5e0)) END,
  'captured_at', CASE WHEN event_id % 5 <> 0 THEN 1700000000000 + event_id * 1000 END, 'is_pano', event_id % 2 = 0, 'sequence', concat('q', user_id), 'creator', named_struct('id', CAST(user_id AS STRING), 'username', concat('n', user_id)),
  'width', 100, 'height', 50, 'detections', CASE event_id % 4 WHEN 0 THEN '{"data":[1]}' WHEN 1 THEN '[2]' END)) AS value FROM events"""


@query(
    "flatten_images",
    """SELECT CAST(event_id AS VARCHAR) AS image_id, CASE WHEN event_id % 3 = 0 THEN 'computed' ELSE 'gps' END AS position_source,
     CASE WHEN event_id % 3 = 0 THEN (event_id % 360) - 179.5e0 WHEN event_id % 9 <> 0 THEN (event_id % 360) - 180e0 ELSE -999e0 END AS lon,
     CASE WHEN event_id % 9 <> 0 THEN (event_id % 360) - 180e0 ELSE -999e0 END AS lon_raw,
     CASE WHEN event_id % 5 <> 0 THEN strftime(make_timestamp((1700000000000 + event_id * 1000) * 1000), '%Y-%m-%d %H:%M:%S') ELSE '-' END AS captured_at,
     'n' || user_id AS creator_username, CASE event_id % 4 WHEN 0 THEN '[1]' WHEN 1 THEN '[2]' ELSE '-' END AS detections, 'https://www.mapillary.com/app/?pKey=' || event_id AS source_url FROM events""",
)
def flatten_images(spark, sf):
    rec = _landed(spark, sf, _IMG_JSON, schemas.STREET_IMAGE, "events")
    i = records.flatten_images(rec, F.lit("c0"))
    return i.select(
        "image_id", "position_source", F.coalesce("lon", F.lit(-999.0)).alias("lon"), F.coalesce("lon_raw", F.lit(-999.0)).alias("lon_raw"),
        F.coalesce(F.col("captured_at").cast("string"), F.lit("-")).alias("captured_at"), "creator_username",
        F.coalesce("mapillary_detections", F.lit("-")).alias("detections"), "source_url",
    )


def _prediction_items(spark, sf):
    tb.register(spark, sf, "events")
    files = spark.sql(
        """SELECT to_json(named_struct('predictions', array(named_struct('filepath', concat('/d/', event_id, CASE WHEN event_id % 4 = 0 THEN '__yaw090' ELSE '' END, '.jpg'), 'model_version', CASE WHEN event_id % 6 <> 0 THEN 'v9' END,
       'prediction', event_type, 'prediction_score', value / 500e0, 'failures', CASE WHEN event_id % 20 = 0 THEN array('X') END,
       'detections', CASE WHEN event_id % 5 <> 0 THEN transform(sequence(0, event_id % 3), i -> named_struct('category', CAST((event_id + i) % 3 + 1 AS STRING), 'label', 'l', 'conf', ((event_id * 7 + i * 3) % 100) / 100e0, 'bbox', array(0.1e0, 0.2e0, 0.3e0, 0.4e0))) END)))) AS value FROM events"""
    )
    return records.prediction_items(files.select(F.from_json("value", schemas.PREDICTION_FILE).alias("r")).select("r.*"))


_DET = """SELECT event_id, i, CAST((event_id + i) % 3 + 1 AS VARCHAR) AS category, ((event_id * 7 + i * 3) % 100) / 100e0 AS conf FROM (SELECT event_id, unnest(range(0, event_id % 3 + 1)) AS i FROM events WHERE event_id % 5 <> 0)"""


@query(
    "prediction_rows",
    f"""SELECT CAST(e.event_id AS VARCHAR) AS image_id, CASE WHEN e.event_id % 4 = 0 THEN 'yaw090' ELSE 'full' END AS variant, CASE WHEN e.event_id % 6 <> 0 THEN 'v9' ELSE 'unknown' END AS model_version,
     CASE WHEN e.event_id % 5 = 0 THEN 0 ELSE CAST(e.event_id % 3 + 1 AS INT) END AS n_detections, coalesce(max(conf) FILTER (category = '1'), -1) AS max_animal_conf, CASE WHEN e.event_id % 20 = 0 THEN '["X"]' ELSE '-' END AS failures
     FROM events e LEFT JOIN ({_DET}) d USING (event_id) GROUP BY e.event_id""",
)
def prediction_rows(spark, sf):
    p = records.prediction_rows(_prediction_items(spark, sf), F.lit("run"))
    return p.select(
        "image_id", "variant", "model_version", "n_detections", F.coalesce("max_animal_conf", F.lit(-1.0)).alias("max_animal_conf"),
        F.coalesce("failures", F.lit("-")).alias("failures"),
    )


@query(
    "detection_rows",
    f"SELECT CAST(event_id AS VARCHAR) AS image_id, CAST(i AS INT) AS det_idx, category, conf, 0.3e0 AS bbox_w FROM ({_DET})",
)
def detection_rows(spark, sf):
    return records.detection_rows(_prediction_items(spark, sf)).select("image_id", "det_idx", "category", "conf", "bbox_w")


@query(
    "osm_points",
    """SELECT 'node/' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5e0 ELSE p_size * 1e0 END AS lat, p_size * -1e0 AS lon FROM part""",
)
def osm_points(spark, sf):
    el = _landed(
        spark, sf,
        """SELECT to_json(named_struct('type', 'node', 'id', p_partkey, 'lat', CASE WHEN p_partkey % 3 <> 0 THEN p_size * 1e0 END, 'lon', CASE WHEN p_partkey % 3 <> 0 THEN p_size * -1e0 END,
      'center', CASE WHEN p_partkey % 3 = 0 THEN named_struct('lat', p_size + 0.5e0, 'lon', p_size * -1e0) END, 'tags', map('name', p_name))) AS value FROM part""",
        schemas.OSM_ELEMENT, "part",
    )
    return records.osm_points(el).select("id", "lat", "lon")


@query(
    "daily_weather",
    """SELECT 'p' || (o_custkey % 5) AS park, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_totalprice AS tmax, CASE WHEN o_orderkey % 3 = 0 THEN -1e0 ELSE 2e0 END AS snow FROM orders""",
)
def daily_weather(spark, sf):
    tb.register(spark, sf, "orders")
    days = spark.sql(
        """SELECT concat('p', o_custkey % 5) AS park, named_struct('time', array(CAST(CAST(o_orderdate AS DATE) AS STRING)), 'temperature_2m_max', array(o_totalprice), 'temperature_2m_min', array(1e0),
      'precipitation_sum', array(0e0), 'snowfall_sum', array(CASE WHEN o_orderkey % 3 <> 0 THEN 2e0 END)) AS daily FROM orders"""
    )
    w = records.daily_weather(days)
    return w.select("park", F.col("date").cast("string").alias("date"), "tmax", F.coalesce("snow", F.lit(-1.0)).alias("snow"))


@query(
    "dataset_counts",
    "SELECT datasetKey, n FROM (SELECT 'ds' || (o_custkey % 7) AS datasetKey, count(*) AS n FROM orders GROUP BY 1) WHERE datasetKey NOT IN ('ds1', 'ds4')",
)
def dataset_counts(spark, sf):
    occ = tb.table(spark, sf, "orders").select(F.concat(F.lit("ds"), F.col("o_custkey") % 7).alias("datasetKey"))
    skip = spark.createDataFrame([("ds1",), ("ds4",)], "datasetKey string")
    return records.dataset_counts(records.without_datasets(occ, skip))


@query("changed_since", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01 00:00:00'")
def changed_since(spark, sf):
    return records.changed_since(tb.table(spark, sf, "orders"), "o_orderdate", "2000-06-01 00:00:00").select("o_orderkey")


@query(
    "unfinished_tiles",
    "SELECT o_orderkey AS tile_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')",
)
def unfinished(spark, sf):
    work = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"))
    ledger = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), F.when(F.col("l_returnflag") == "R", "error").otherwise("done").alias("status")
    )
    return records.unfinished(work, ledger)


# ---- sinks as DataFrames ----------------------------------------------------------------


def _versions(spark, sf):
    e = tb.table(spark, sf, "events").select((F.col("user_id") * 10 + F.col("event_id") % 7).alias("key"), "ts", "event_id", "value")
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


@query(
    "upsert_last_wins",
    """WITH e AS (SELECT user_id * 10 + event_id % 7 AS key, ts, event_id, value FROM events), inc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn FROM e WHERE event_id % 2 = 1) WHERE rn = 1)
     SELECT key, event_id, value FROM inc UNION ALL SELECT key, event_id, value FROM e WHERE event_id % 2 = 0 AND key NOT IN (SELECT key FROM inc)""",
)
def upsert(spark, sf):
    have, inc = _versions(spark, sf)
    return sinks.upsert(have, inc, ["key"], [F.col("ts"), F.col("event_id")]).select("key", "event_id", "value")


@query(
    "insert_if_absent",
    """WITH e AS (SELECT user_id * 10 + event_id % 7 AS key, ts, event_id, value FROM events) SELECT key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM e WHERE event_id % 2 = 1)
     WHERE rn = 1 AND key NOT IN (SELECT key FROM e WHERE event_id % 2 = 0 AND event_id % 3 = 0)""",
)
def insert_absent(spark, sf):
    have, inc = _versions(spark, sf)
    return sinks.insert_if_absent(have.filter("event_id % 3 = 0"), inc, ["key"], [F.col("ts"), F.col("event_id")]).select("key", "event_id", "value")


@query(
    "replace_scope",
    "SELECT event_id, user_id, value * 2 AS value FROM events WHERE user_id % 4 = 0 AND event_id % 2 = 0 UNION ALL SELECT event_id, user_id, value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE user_id % 4 = 0 AND event_id % 2 = 0)",
)
def replace_scope(spark, sf):
    e = tb.table(spark, sf, "events").select("event_id", "user_id", "value")
    return sinks.replace_scope(e, e.filter("user_id % 4 = 0 AND event_id % 2 = 0").withColumn("value", F.col("value") * 2), ["user_id"])


@query(
    "published_sightings",
    tb.oracle("SELECT sighting_id, park, CAST(observed_on AS VARCHAR) AS observed_on, coordinate_status FROM sightings WHERE duplicate_of IS NULL", "sightings"),
)
def published(spark, sf):
    out = sinks.canonical_projection(tb.sightings(spark, sf))
    return out.select("sighting_id", "park", F.col("observed_on").cast("string").alias("observed_on"), "coordinate_status")


# ---- quality ----------------------------------------------------------------------------------


@query(
    "contract_violations",
    """SELECT CAST(event_id AS VARCHAR) AS key, 'position' AS "check", CASE WHEN value - 100 > 180 THEN 'longitude out of range' ELSE 'latitude out of range' END AS reason FROM events WHERE value - 100 NOT BETWEEN -180 AND 180 OR value / 4 > 90
     UNION ALL SELECT CAST(event_id AS VARCHAR), 'epoch', 'not a millisecond epoch' FROM events WHERE event_id % 50 = 0
     UNION ALL SELECT CAST(event_id AS VARCHAR), 'box', CASE WHEN event_id % 30 = 0 THEN 'box origin out of range' ELSE 'box past the frame' END FROM events WHERE event_id % 30 = 0 OR event_id % 45 = 1""",
)
def contracts(spark, sf):
    e = tb.table(spark, sf, "events")
    x = F.when(F.col("event_id") % 30 == 0, 3.0).when(F.col("event_id") % 45 == 1, 0.9).otherwise(0.1)
    ms = F.when(F.col("event_id") % 50 == 0, F.lit(1_700_000_000)).otherwise(F.lit(1_700_000_000_000)).cast("bigint")
    checks = {
        "position": quality.lon_lat_violation(F.col("value") - 100, F.col("value") / 4),
        "box": quality.box_violation(x, F.lit(0.1), F.lit(0.5), F.lit(0.5)),
        "epoch": quality.epoch_violation(ms),
    }
    return quality.violations(e, checks, "event_id")


@query(
    "filter_ledger",
    """SELECT 'keep' AS stage, 'value under 100 and not an error' AS rule, count(*) AS n_in, count(*) FILTER (value < 100 AND event_type <> 'error') AS n_out,
     count(*) FILTER (NOT (value < 100 AND event_type <> 'error')) AS n_dropped, count(*) FILTER (value >= 100) AS dropped_value, count(*) FILTER (value < 100 AND event_type = 'error') AS dropped_error FROM events""",
)
def ledger(spark, sf):
    e = tb.table(spark, sf, "events")
    low, err = F.col("value") < 100, F.col("event_type") == "error"
    return quality.ledger_entry(e, "keep", "value under 100 and not an error", low & ~err, {"value": ~low, "error": low & err})


# ---- text -------------------------------------------------------------------------------------------


@query(
    "html_stripped",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""",
)
def html_stripped(spark, sf):
    return tb.table(spark, sf, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("digest"))


@query(
    "credits",
    r"""SELECT page_id, license, CASE WHEN length(w) > 80 THEN left(w, 79) || '…' WHEN w <> '' THEN w ELSE 'unknown' END AS artist FROM (SELECT page_id,
     CASE page_id % 4 WHEN 0 THEN 'CC BY-SA 4.0' WHEN 1 THEN 'Public domain' WHEN 2 THEN 'GFDL' ELSE 'cc0' END AS license, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS w FROM pages) WHERE license <> 'GFDL'""",
)
def credits(spark, sf):
    p = tb.table(spark, sf, "pages")
    lic = F.expr("CASE page_id % 4 WHEN 0 THEN '<b>CC BY-SA 4.0</b>' WHEN 1 THEN 'Public domain' WHEN 2 THEN 'GFDL' ELSE 'cc0' END")
    c = text.credit(lic, F.lit("u"), F.col("html"))
    return p.withColumn("c", c).filter("c IS NOT NULL").select("page_id", "c.license", "c.artist")


@query(
    "slugs",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_')) AS digest FROM documents""",
)
def slugs(spark, sf):
    return tb.table(spark, sf, "documents").select("doc_id", F.md5(text.slug(F.col("text"))).alias("digest"))


@query(
    "observer_keys",
    r"""SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS digest FROM documents""",
)
def observer_keys(spark, sf):
    return tb.table(spark, sf, "documents").select("doc_id", F.md5(names.observer_key(F.col("text"))).alias("digest"))


_NORM = r"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_INTENT = "concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(q, '{p}') THEN '{n}' END" for n, p in text.INTENTS.items()
) + ")"
_MON = "CASE " + " ".join(
    f"WHEN contains(q, '{m.lower()}') THEN {i}" for i, m in enumerate(stats.MONTH_NAMES, start=1)
) + " ELSE 0 END"


@query(
    "question_intents",
    f"""SELECT conv_id, turn, {_INTENT} AS intents, {_MON} AS month FROM (SELECT conv_id, turn, {_NORM.format(t='text')} AS q FROM conversations)""",
)
def intents(spark, sf):
    c = tb.table(spark, sf, "conversations").withColumn("qid", F.struct("conv_id", "turn"))
    return search.question_intents(c).select(
        "qid.conv_id", "qid.turn", F.array_join("intents", ",").alias("intents"), F.coalesce("month", F.lit(0)).alias("month")
    )


_SING = r"""CASE WHEN w = 'wolves' THEN 'wolf' WHEN w = 'geese' THEN 'goose' WHEN w = 'mice' THEN 'mouse' WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(sh|ch|x|s)es$') THEN left(w, -2)
 WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END"""
# Names come from the benchmark's own words: its first two words are a common
# name, its first word another name, its last three words the scientific one.
_SPECIES_WORDS = {
    "spark": "split(trim(regexp_replace(text, '\\\\s+', ' ')), ' ')",
    "duck": r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')",
}
_GENERIC = "(" + ", ".join(f"'{g}'" for g in search.GENERIC_WORDS) + ")"
MATCH = rf"""sp0 AS (SELECT item_id, {_SPECIES_WORDS['duck']} AS ws FROM benchmark),
 sp1 AS (SELECT 'sp' || item_id AS species, ws[1] || ' ' || ws[2] AS common_name, [ws[3]] AS other_names, item_id % 50 AS sightings, CASE WHEN item_id % 7 = 0 THEN 'exclude' END AS action FROM sp0),
 nm AS (SELECT DISTINCT species, {_NORM.format(t='n')} AS nn FROM (SELECT species, unnest(list_concat([common_name], other_names, [species])) AS n FROM sp1 WHERE action IS NULL) WHERE n IS NOT NULL),
 q AS (SELECT conv_id * 1000 + turn AS qid, {_NORM.format(t='text')} AS q FROM conversations),
 qw AS (SELECT DISTINCT qid, f FROM (SELECT qid, unnest([w, {_SING}]) AS f FROM (SELECT qid, unnest(string_split(q, ' ')) AS w FROM q) WHERE w <> '')),
 dw AS (SELECT species, nn, w, ng, count(*) OVER (PARTITION BY species, nn) AS need FROM (SELECT DISTINCT species, nn, w, 0 AS ng FROM (SELECT species, nn, unnest(string_split(nn, ' ')) AS w FROM nm WHERE nn <> '') WHERE w NOT IN {_GENERIC})),
 tot AS (SELECT species, nn, count(DISTINCT w) AS total FROM (SELECT species, nn, unnest(string_split(nn, ' ')) AS w FROM nm WHERE nn <> '') GROUP BY ALL),
 sc AS (SELECT qid, species, max(s) AS score FROM (SELECT qid, species, 3.0e0 AS s FROM q JOIN nm ON nn <> '' AND contains(q.q, nn)
   UNION ALL SELECT qid, species, CASE WHEN need = total THEN 2.5e0 ELSE 2.0e0 END FROM (SELECT qid, d.species, d.nn, d.need, count(*) AS got FROM dw d JOIN qw ON qw.f = d.w GROUP BY ALL) JOIN tot USING (species, nn) WHERE got = need) GROUP BY ALL),
 lw AS (SELECT w, min(species) AS species FROM (SELECT species, regexp_extract({_NORM.format(t='common_name')}, '[^ ]+$') AS w FROM sp1 WHERE action IS NULL) WHERE w <> '' GROUP BY w HAVING count(*) = 1),
 al AS (SELECT * FROM sc UNION ALL SELECT DISTINCT qid, species, 1.0e0 FROM qw JOIN lw ON lw.w = qw.f WHERE qid NOT IN (SELECT qid FROM sc))"""


@query(
    "match_species_names",
    o(
        """SELECT qid, species, score, CAST(rank AS INT) AS rank FROM (SELECT a.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sightings DESC, species) AS rank FROM al a JOIN sp1 USING (species)) WHERE rank <= 3""",
        extra=MATCH,
    ),
)
def match_names(spark, sf):
    tb.register(spark, sf, "benchmark")
    w = spark.sql(f"SELECT item_id, {_SPECIES_WORDS['spark']} AS ws FROM benchmark")
    species = w.select(
        F.concat(F.lit("sp"), "item_id").alias("species"), F.concat_ws(" ", F.get("ws", F.lit(0)), F.get("ws", F.lit(1))).alias("common_name"),
        F.array(F.get("ws", F.lit(2))).alias("other_names"), F.when(F.col("item_id") % 7 == 0, "exclude").alias("action"), (F.col("item_id") % 50).alias("sightings"),
    )
    q = tb.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return search.match_species(q, species)


_SAID = r"""regexp_extract_all(regexp_replace(a, '\[\d+\]', '', 'g'), '\d[\d,.]*')"""
_FACTN = r"""regexp_extract_all(f, '\d[\d,.]*')"""
_CLEAN = r"""list_distinct(list_transform({x}, lambda n: regexp_replace(n, '[.,]+$', '')))"""


@query(
    "answer_checks",
    rf"""SELECT doc_id, len(list_filter(list_distinct(list_transform(regexp_extract_all(a, '\[(\d+)\]', 1), lambda n: CAST(n AS BIGINT))), lambda n: n BETWEEN 1 AND 9)) AS cited,
     array_to_string(list_sort(list_filter({_CLEAN.format(x=_SAID)}, lambda n: NOT list_contains({_CLEAN.format(x=_FACTN)}, n) AND length(regexp_replace(n, '[^\d]', '', 'g')) >= 3)), '|') AS stray,
     CASE WHEN regexp_matches(lower(a), 'doesn''t say|does not say') THEN 1 ELSE 0 END AS declined
     FROM (SELECT doc_id, text || ' [' || doc_id % 12 || '] and [' || doc_id % 5 || '] ' || doc_id * 7 || ', 12.5' || CASE WHEN doc_id % 9 = 0 THEN ' The data doesn''t say.' ELSE '' END AS a, 'fact ' || doc_id * 7 || '. 1' AS f FROM documents)""",
)
def answer_checks(spark, sf):
    d = tb.table(spark, sf, "documents")
    i = F.col("doc_id")
    answer = F.concat(
        "text", F.lit(" ["), i % 12, F.lit("] and ["), i % 5, F.lit("] "), i * 7, F.lit(", 12.5"),
        F.when(i % 9 == 0, " The data doesn't say.").otherwise(""),
    )
    a = d.select(
        i.alias("qid"), answer.alias("answer"), F.concat(F.lit("fact "), i * 7, F.lit(". 1")).alias("fact_text"),
        F.lit(9).cast("bigint").alias("fact_count"), F.lit(0).alias("ms"),
    )
    return search.check_answers(a).select(
        F.col("qid").alias("doc_id"), F.size("cited").cast("bigint").alias("cited"),
        F.array_join(F.array_sort("uncited_numbers"), "|").alias("stray"), F.col("says_no_data").cast("int").alias("declined"),
    )


@query(
    "facts_numbered",
    """SELECT doc AS qid, ord, CAST(n AS INT) AS n FROM (SELECT l_suppkey AS doc, l_orderkey AS ord, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, f) AS n FROM (
     SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, 'fact ' || l_linenumber AS f FROM lineitem)) WHERE n <= 28""",
)
def facts_numbered(spark, sf):
    f = tb.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("ord"), F.concat(F.lit("fact "), "l_linenumber").alias("fact")
    ).distinct()
    return search.number_facts(f).select("qid", "ord", "n")


@query(
    "index_search",
    tb.oracle(
        "SELECT DISTINCT scientific_name FROM sightings WHERE contains(lower(coalesce(common_name, '')), 'bi') OR contains(lower(scientific_name), 'bi')", "sightings"
    ),
)
def index_search(spark, sf):
    s = tb.sightings(spark, sf)
    return s.filter(text.name_matches(F.array("common_name", "scientific_name"), " Bi ")).select("scientific_name").distinct()


# ---- vocabularies and small functions ------------------------------------------------------------------

_WX = "CASE WHEN c = 0 THEN 'Clear' WHEN c = 1 THEN 'Mainly clear' WHEN c = 2 THEN 'Partly cloudy' WHEN c = 3 THEN 'Overcast' WHEN c IN (45, 48) THEN 'Fog' WHEN c BETWEEN 51 AND 57 THEN 'Drizzle' WHEN c BETWEEN 61 AND 67 THEN 'Rain' WHEN c BETWEEN 71 AND 77 THEN 'Snow' WHEN c BETWEEN 80 AND 82 THEN 'Showers' WHEN c IN (85, 86) THEN 'Snow showers' WHEN c >= 95 THEN 'Thunderstorm' ELSE 'Unsettled' END"
_WI = "CASE WHEN c = 0 THEN 'sun' WHEN c <= 2 THEN 'partly' WHEN c = 3 THEN 'cloud' WHEN c IN (45, 48) THEN 'fog' WHEN c BETWEEN 51 AND 57 THEN 'drizzle' WHEN c BETWEEN 61 AND 67 OR c BETWEEN 80 AND 82 THEN 'rain' WHEN c BETWEEN 71 AND 77 OR c IN (85, 86) THEN 'snow' WHEN c >= 95 THEN 'storm' ELSE 'cloud' END"


@query("weather_words", f"SELECT c AS code, {_WX} AS label, {_WI} AS icon, count(*) AS n FROM (SELECT l_partkey % 100 AS c FROM lineitem) GROUP BY 1")
def weather(spark, sf):
    w = tb.table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 100).alias("code")).agg(F.count("*").alias("n"))
    return w.select("code", labels.weather_label(F.col("code")).alias("label"), labels.weather_icon(F.col("code")).alias("icon"), "n")


@query(
    "distance_texts",
    """SELECT event_id, CASE WHEN m < 950 THEN CAST(floor(m / 50 + 0.5) * 50 AS BIGINT) || ' m' ELSE printf('%.1f km', m / 1000) END AS dist,
     CASE WHEN CAST(floor(m / 60 + 0.5) AS BIGINT) < 60 THEN CAST(floor(m / 60 + 0.5) AS BIGINT) || ' min' ELSE printf('%d h %02d min', CAST(floor(floor(m / 60 + 0.5) / 60) AS BIGINT), CAST(floor(m / 60 + 0.5) AS BIGINT) % 60) END AS took,
     CAST(floor(value * 9 / 5 + 32 + 0.5) AS BIGINT) AS f FROM (SELECT event_id, value, event_id % 9000 + 0.25e0 AS m FROM events)""",
)
def distance_texts(spark, sf):
    m = F.col("event_id") % 9000 + F.lit(0.25)
    return tb.table(spark, sf, "events").select(
        "event_id", text.format_distance(m).alias("dist"), text.format_time(m).alias("took"), text.to_fahrenheit(F.col("value")).alias("f")
    )


@query(
    "park_short_names",
    tb.oracle("SELECT park, regexp_replace(name, ' National Park$', '') AS short FROM parks", "parks"),
)
def short_names(spark, sf):
    return tb.parks(spark, sf).select("park", text.short_park(F.col("name")).alias("short"))


@query(
    "place_stems",
    r"""SELECT p_partkey, coalesce(CASE WHEN s = '' OR regexp_matches(s, '^\d') THEN NULL ELSE s END, '-') AS stem FROM (SELECT p_partkey, trim(regexp_replace(CASE p_partkey % 4 WHEN 0 THEN p_name || ' Trail' WHEN 1 THEN 'Campground' WHEN 2 THEN p_partkey || ' viewpoint' ELSE p_name END,
     '(?i)\b(trail|trailhead|campground|campsite|picnic area|overlook|viewpoint|visitor center)\b', '', 'g')) AS s FROM part)""",
)
def place_stems(spark, sf):
    n = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' Trail') WHEN 1 THEN 'Campground' WHEN 2 THEN concat(p_partkey, ' viewpoint') ELSE p_name END")
    return tb.table(spark, sf, "part").select("p_partkey", F.coalesce(text.place_stem(n), F.lit("-")).alias("stem"))


@query(
    "label_similarity",
    """SELECT vec_id, CAST(rank AS INT) AS rank, label, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM (
     SELECT e.vec_id, l.label, list_dot_product(CAST(e.embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))) AS score FROM embeddings e,
     (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings GROUP BY label) l)) WHERE rank <= 5""",
)
def label_similarity(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    lab = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec"))
    out = ranking.similar_labels(e.select("vec_id", F.col("embedding").alias("vec")), lab)
    return rounded(out, "score", digits=5)


# ---- photos ----------------------------------------------------------------------------------------------


def _photos(spark, sf):
    """Orders as observations, their distinct lines as photos; the strips read the result several times, so it is written once.

    Line numbers and keys meet the orders; what is written out of them comes after that join.
    """
    tb.register(spark, sf, "orders", "lineitem")
    obs = spark.sql(
        """SELECT o_orderkey AS observation_id, concat('park', o_custkey % 5) AS park, concat('sp', o_custkey % 23) AS species, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 40 END AS cell, o_orderkey % 50 AS faves,
      CAST(o_orderdate AS DATE) AS observed_on, transform(array_sort(v), x -> named_struct('url', concat(
        CASE x.k % 4 WHEN 0 THEN 'https://static.inaturalist.org/photos/' WHEN 1 THEN 'https://elsewhere.org/photos/' ELSE 'https://inaturalist-open-data.s3.amazonaws.com/photos/' END, o_orderkey * 100000 + x.n * 10000 + x.k, '/medium.JPG'),
        'license_code', CASE x.k % 5 WHEN 0 THEN 'cc-by-nd' WHEN 1 THEN NULL WHEN 2 THEN 'cc0' ELSE 'cc-by-nc' END)) AS photos
      FROM orders JOIN (SELECT l_orderkey, collect_set(named_struct('n', l_linenumber, 'k', l_partkey)) AS v FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
    )
    return materialise(ranking.first_photo(ranking.first_of_row(obs)), "photos")


PH = """ph AS (SELECT * FROM (SELECT o_orderkey AS observation_id, 'park' || (o_custkey % 5) AS park, 'sp' || (o_custkey % 23) AS species, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 40 END AS cell, o_orderkey % 50 AS faves,
   CAST(o_orderdate AS DATE) AS observed_on, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS photo_id, CASE l_partkey % 5 WHEN 2 THEN 'CC0' ELSE 'CC BY-NC' END AS licence,
   row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS rn1 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 4 <> 1 AND l_partkey % 5 NOT IN (0, 1)) WHERE rn1 = 1),
 strip0 AS (SELECT *, row_number() OVER (PARTITION BY park, cell ORDER BY faves DESC, observed_on DESC, photo_id) AS rn, row_number() OVER (PARTITION BY park, cell, species ORDER BY faves DESC, observed_on DESC, photo_id) AS rs FROM ph WHERE cell IS NOT NULL),
 gal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park, species ORDER BY faves DESC, observed_on DESC, photo_id) AS rank FROM ph) WHERE rank <= 8)"""


@query("species_gallery", o("SELECT park, species, photo_id, licence, CAST(rank AS INT) AS rank FROM gal", extra=PH))
def gallery(spark, sf):
    return ranking.species_gallery(_photos(spark, sf)).select("park", "species", "photo_id", "licence", "rank")


@query("cell_strip", o("SELECT park, cell, species, photo_id FROM strip0 s WHERE rn <= 3 OR (rs = 1 AND NOT EXISTS (SELECT 1 FROM strip0 t WHERE t.park = s.park AND t.cell = s.cell AND t.species = s.species AND t.rn <= 3))", extra=PH))
def strip(spark, sf):
    return ranking.cell_strip(_photos(spark, sf)).select("park", "cell", "species", "photo_id")


@query("cell_strip_superseded", o("SELECT park, cell, photo_id, CAST(rn AS INT) AS rn FROM strip0 WHERE rn <= 3", extra=PH))
def strip_v1(spark, sf):
    return ranking.cell_strip_v1(_photos(spark, sf)).select("park", "cell", "photo_id", "rn")


@query(
    "photos_near_stops",
    o(
        """SELECT park, stop, species, photo_id, CAST(tier < 2 AS INT) AS near FROM (SELECT *, row_number() OVER (PARTITION BY park, stop, species ORDER BY tier, o1, o2, photo_id) AS k FROM (
     SELECT w.park, w.stop, w.species, 0 AS tier, c.pos AS o1, s.rn2 AS o2, s.photo_id FROM w JOIN sc c USING (park, stop) JOIN st s ON s.park = w.park AND s.cell = c.cell AND s.species = w.species
     UNION ALL SELECT w.park, w.stop, w.species, 1, g.rank, c.pos, g.photo_id FROM w JOIN sc c USING (park, stop) JOIN gal g ON g.park = w.park AND g.cell = c.cell AND g.species = w.species
     UNION ALL SELECT w.park, w.stop, w.species, 2, 1, 0, g.photo_id FROM w JOIN gal g ON g.park = w.park AND g.species = w.species AND g.rank = 1)) WHERE k = 1""",
        "stops",
        extra=PH
        + """, st AS (SELECT *, row_number() OVER (PARTITION BY park, cell ORDER BY rn) AS rn2 FROM strip0 s WHERE rn <= 3 OR (rs = 1 AND NOT EXISTS (SELECT 1 FROM strip0 t WHERE t.park = s.park AND t.cell = s.cell AND t.species = s.species AND t.rn <= 3))),
 sc AS (SELECT park, stop, (stop + p) % 40 AS cell, p AS pos FROM stops, (SELECT unnest([0, 1, 2]) AS p)), w AS (SELECT park, stop, 'sp' || (stop % 23) AS species FROM stops)""",
    ),
)
def photos_near(spark, sf):
    ph = _photos(spark, sf)
    s = tb.stops(spark, sf)
    cells = s.select("park", "stop", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).withColumn("cell", (F.col("stop") + F.col("pos")) % 40)
    wanted = s.select("park", "stop", F.concat(F.lit("sp"), F.col("stop") % 23).alias("species"))
    out = ranking.photo_near(wanted, cells, ranking.cell_strip(ph), ranking.species_gallery(ph))
    return out.withColumn("near", F.col("near").cast("int"))


@query(
    "focus_photos",
    o(
        """SELECT park, cell, species, photo_id, k.src AS src, CAST(row_number() OVER (PARTITION BY park, cell, species ORDER BY k.src, k.o, photo_id) AS INT) AS position FROM (
     SELECT park, cell, species, photo_id, min({'src': src, 'o': ord}) AS k FROM (SELECT park, cell, species, photo_id, 0 AS src, rn AS ord FROM strip0 s WHERE rn <= 3 OR (rs = 1 AND NOT EXISTS (SELECT 1 FROM strip0 t WHERE t.park = s.park AND t.cell = s.cell AND t.species = s.species AND t.rn <= 3))
     UNION ALL SELECT park, cell, species, photo_id, 1, rank FROM gal WHERE cell IS NOT NULL) GROUP BY ALL)""",
        extra=PH,
    ),
)
def focus(spark, sf):
    ph = _photos(spark, sf)
    return ranking.focus_photos(ranking.cell_strip(ph), ranking.species_gallery(ph))


@query(
    "nearest_licensed_photos",
    """SELECT place, photo_id, CAST(rank AS INT) AS rank FROM (SELECT l_suppkey AS place, pid AS photo_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, pid) AS rank FROM (
     SELECT DISTINCT l_suppkey, l_quantity, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS pid, l_partkey FROM lineitem) WHERE l_partkey % 5 IN (0, 1, 2) AND l_partkey % 7 <> 0) WHERE rank <= 6""",
)
def nearest_licensed(spark, sf):
    l = tb.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("place"), F.col("l_quantity").alias("dist_m"), F.expr("l_orderkey * 100000 + l_linenumber * 10000 + l_partkey").alias("photo_id"),
        F.expr("CASE l_partkey % 5 WHEN 0 THEN 'CC BY 2.0' WHEN 1 THEN 'PD-USGov' WHEN 2 THEN 'Public domain' WHEN 3 THEN 'GFDL' ELSE 'Fair use' END").alias("license_short"),
        F.expr("CASE WHEN l_partkey % 7 <> 0 THEN 't' END").alias("thumb"),
    ).distinct()
    return ranking.nearest_licensed(l).select("place", "photo_id", "rank")


@query(
    "event_times",
    """SELECT event_id, strftime(make_timestamp(1700000000000000 + event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN event_id % 3 = 0 THEN '-' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events""",
)
def event_times(spark, sf):
    e = tb.table(spark, sf, "events")
    d = F.expr("CASE event_id % 3 WHEN 0 THEN 'x/y' WHEN 1 THEN concat(CAST(CAST(ts AS DATE) AS STRING), '/2030-01-01') ELSE CAST(CAST(ts AS DATE) AS STRING) END")
    none = F.lit(None).cast("int")
    return e.select(
        "event_id", times.millis_to_ntz(F.lit(1_700_000_000_000) + F.col("event_id") * 1000).cast("string").alias("at"),
        F.coalesce(times.event_day(d, none, none, none).cast("string"), F.lit("-")).alias("day"),
    )
