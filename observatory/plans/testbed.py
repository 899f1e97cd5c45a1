"""The model's tables derived from the driver's tables.

The driver's data has no coordinates, frames or reviews, so each is derived
row by row with integer arithmetic that both engines repeat exactly. Every
derivation is a projection of a whole table: what the queries below read grows
with the data.

Expressions valid in both dialects are shared text; the engine's own spelling
is used for JSON, intervals and epochs. Decimal literals carry an exponent
because a plain ``2.0`` is a DECIMAL in Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. The session zone is part of the model: all times are naive UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_text(key: str, spread: str) -> str:
    return f"(-110.5e0 + (({key} % 40) * 7919 % 10000) / 25000e0 + ({spread} * 104729 % 1000) / 50000e0)"


def lat_text(key: str, spread: str) -> str:
    return f"(44.5e0 + (({key} % 40) * 104729 % 10000) / 25000e0 + ({spread} * 7919 % 1000) / 50000e0)"


def park_text(key: str) -> str:
    return f"concat('park', ({key} % 40) % 5)"


LON, LAT, PARK = lon_text("user_id", "event_id"), lat_text("user_id", "event_id"), park_text("user_id")

NAME = """CASE event_type
 WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'Bison bison' WHEN 1 THEN 'Bos bison' ELSE 'Bison bison bison' END
 WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'Cervus canadensis' ELSE 'Cervus elaphus' END
 WHEN 'purchase' THEN 'Ursus arctos horribilis'
 WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN 'Canis lupus' WHEN k % 4 = 1 THEN 'Lontra canadensis' ELSE 'Vulpes vulpes' END
 ELSE CASE WHEN k % 13 = 0 THEN NULL ELSE 'Mammalia' END END"""
COMMON = """CASE event_type
 WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'American Bison' ELSE 'Bison' END
 WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'Wapiti' WHEN 1 THEN 'American Elk' WHEN 2 THEN 'Elk' ELSE NULL END
 WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'Grizzly Bear' END
 WHEN 'signup' THEN CASE WHEN k % 4 = 1 THEN 'River Otter' WHEN k % 4 = 0 THEN 'Gray Wolf' ELSE 'Red Fox' END
 ELSE NULL END"""
RANK = """CASE WHEN event_type = 'error' THEN 'class'
 WHEN event_type = 'purchase' OR (event_type = 'click' AND event_id % 3 = 2) THEN 'subspecies' ELSE 'species' END"""
CLASS = "CASE WHEN k % 17 = 0 THEN NULL WHEN event_type = 'error' THEN 'Aves' ELSE 'Mammalia' END"
SOURCE = "CASE user_id % 3 WHEN 0 THEN 'inaturalist' WHEN 1 THEN 'gbif' ELSE 'mapillary_cv' END"
STATUS = "CASE WHEN k % 23 = 0 THEN 'missing' WHEN k % 7 = 0 THEN 'obscured' ELSE 'open' END"
OBSERVER = "CASE WHEN k % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN concat('Obs_', user_id % 9) ELSE concat('obs ', user_id % 9) END"
RAW = """concat('{"k":', k, ',"taxon_geoprivacy":',
 CASE WHEN event_type = 'purchase' OR k % 10 = 0 OR (event_type = 'signup' AND k % 4 = 1) THEN '"obscured"' ELSE 'null' END,
 ',"corridor":"c', user_id % 3, '"}')"""

_K = {"spark": "CAST(get_json_object(props, '$.k') AS BIGINT)", "duck": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}
_SEEN = {
    "spark": "ts + make_dt_interval(CAST(((user_id % 40) % 24) * 30 AS INT))",
    "duck": "ts + to_days(CAST(((user_id % 40) % 24) * 30 AS INTEGER))",
}
# Values every other expression leans on, computed once a row. Spark would copy
# them into each expression and pushed filter, so they come from a generator,
# which nothing is pushed through.
_EVENTS = {
    "spark": f"""(SELECT e.*, g.k, g.seen, n.scientific_name FROM events e
      LATERAL VIEW inline(array(named_struct('k', {_K['spark']}, 'seen', {_SEEN['spark']}))) g AS k, seen
      LATERAL VIEW inline(array(named_struct('scientific_name', {NAME}))) n AS scientific_name)""",
    "duck": f"(SELECT *, {NAME} AS scientific_name FROM (SELECT *, {_K['duck']} AS k, {_SEEN['duck']} AS seen FROM events))",
}
_US = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "duck": "epoch_us(ts)"}


def sightings_text(engine: str) -> str:
    return f"""SELECT concat({SOURCE}, ':', event_id) AS sighting_id, {SOURCE} AS source, CAST(event_id AS STRING) AS source_id,
 'd1' AS dataset, {PARK} AS park,
 CASE WHEN user_id % 3 = 2 THEN 'model_predicted' ELSE 'human_verified' END AS confidence_basis,
 concat('t', event_type) AS taxon_id, scientific_name, {COMMON} AS common_name, {RANK} AS taxon_rank,
 {CLASS} AS taxon_class, CASE WHEN k % 11 = 0 THEN NULL ELSE seen END AS observed_at,
 CAST(seen AS DATE) AS observed_on,
 CASE WHEN k % 23 = 0 THEN NULL ELSE {LON} END AS lon, CASE WHEN k % 23 = 0 THEN NULL ELSE {LAT} END AS lat,
 value AS positional_accuracy_m, {STATUS} AS coordinate_status, {OBSERVER} AS observer, 'CC BY 4.0' AS license,
 concat('https://example.org/', event_id) AS url, concat('record ', event_id) AS attribution,
 CASE WHEN event_id % 19 = 0 THEN 'dup' ELSE NULL END AS duplicate_of, {RAW} AS raw_json, event_id
 FROM {_EVENTS[engine]} e"""


def images_text(engine: str) -> str:
    return f"""SELECT concat('img', lpad(CAST(event_id AS STRING), 10, '0')) AS image_id, concat('c', user_id % 3) AS corridor,
 CASE WHEN k % 23 = 0 THEN NULL ELSE {LON} END AS lon, CASE WHEN k % 23 = 0 THEN NULL ELSE {LAT} END AS lat,
 concat('s', user_id) AS sequence_id, CASE WHEN k % 31 = 0 THEN NULL ELSE ts END AS captured_at,
 CASE WHEN k % 31 = 0 THEN NULL ELSE {_US[engine]} END AS ts_us,
 CASE WHEN k % 29 = 0 THEN NULL ELSE event_id % 7 = 0 END AS is_pano,
 CASE event_id % 4 WHEN 0 THEN 'perspective' WHEN 1 THEN 'fisheye' WHEN 2 THEN 'equirectangular' ELSE NULL END AS camera_type,
 concat('u', user_id % 12) AS creator_username, CAST(1024 + event_id % 7 AS BIGINT) AS width, CAST(768 AS BIGINT) AS height,
 (event_id % 360) * 1e0 AS bearing, 'CC BY-SA 4.0' AS license, concat('https://example.org/i/', event_id) AS source_url, event_id
 FROM {_EVENTS[engine]} e"""


LABEL = """CASE WHEN k % 10 = 0 THEN 'e5;;;;;;human' ELSE CASE event_type
 WHEN 'click' THEN 'a1;mammalia;artiodactyla;bovidae;bison;bison;american bison'
 WHEN 'view' THEN 'b2;mammalia;artiodactyla;cervidae;;;'
 WHEN 'purchase' THEN 'c3;mammalia;carnivora;canidae;canis;familiaris;domestic dog'
 WHEN 'signup' THEN 'd4;no cv result;;;;;no cv result' ELSE 'blank' END END"""
VARIANT = "CASE WHEN event_id % 7 = 0 THEN 'yaw090' ELSE 'full' END"


def predictions_text(engine: str) -> str:
    return f"""SELECT concat('img', lpad(CAST(event_id AS STRING), 10, '0')) AS image_id, 'v1' AS model_version, {VARIANT} AS variant,
 {LABEL} AS prediction, (k * 37 % 101) / 100e0 AS prediction_score, 'classifier' AS prediction_source,
 CASE WHEN k % 9 = 0 THEN NULL ELSE least(value / 300e0, 1e0) END AS max_animal_conf,
 CASE WHEN k % 41 = 0 THEN '["x"]' ELSE NULL END AS failures, event_id
 FROM {_EVENTS[engine]} e"""


_BOX = {
    "spark": "SELECT *, explode(sequence(0L, event_id % 3)) AS di FROM events",
    "duck": "SELECT *, unnest(range(0, event_id % 3 + 1)) AS di FROM events",
}


def detections_text(engine: str) -> str:
    return f"""SELECT concat('img', lpad(CAST(event_id AS STRING), 10, '0')) AS image_id, 'v1' AS model_version, {VARIANT} AS variant,
 CAST(di AS INT) AS det_idx,
 CASE WHEN (event_id + di) % 5 = 0 THEN '2' WHEN (event_id + di) % 7 = 0 THEN '3' ELSE '1' END AS category,
 ((event_id * 31 + di * 17) % 1000) / 1000e0 AS conf, (event_id % 50) / 100e0 AS bbox_x, (event_id % 40) / 100e0 AS bbox_y,
 (event_id % 60) / 100e0 AS bbox_w, 3e-1 AS bbox_h
 FROM ({_BOX[engine]}) e"""


DOWNLOADS = """SELECT concat('img', lpad(CAST(event_id AS STRING), 10, '0')) AS image_id, concat('/p/', event_id) AS local_path,
 CASE WHEN event_id % 10 = 1 THEN 'timeout' ELSE NULL END AS error FROM events WHERE event_id % 5 <> 0"""

REVIEWS = """SELECT concat('img', lpad(CAST(doc_id AS STRING), 10, '0')) AS image_id,
 CASE WHEN doc_id % 7 = 0 THEN 'yaw090' ELSE 'full' END AS variant, 0 AS det_idx,
 CASE WHEN doc_id % 3 = 0 THEN 'me' ELSE 'ann' END AS reviewer,
 CASE WHEN quality = 1 THEN 'tp' WHEN toxic = 1 THEN 'unsure' ELSE 'fp' END AS verdict,
 CASE doc_id % 4 WHEN 0 THEN ' Bison ' WHEN 1 THEN 'bison' WHEN 2 THEN 'elk' ELSE NULL END AS true_species,
 CASE doc_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'rollup' WHEN 2 THEN 'no' WHEN 3 THEN 'yes' ELSE NULL END AS species_agree,
 CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id * 37 % 400) + 5e-1 END AS est_distance_m FROM labels"""

STOPS = f"""SELECT concat('node/', s_suppkey) AS id, s_suppkey AS stop, s_name AS name, {park_text('s_suppkey')} AS park,
 {lon_text('s_suppkey', 's_suppkey')} AS lon, {lat_text('s_suppkey', 's_suppkey')} AS lat,
 CASE s_suppkey % 5 WHEN 0 THEN 'peak' WHEN 1 THEN 'lake' WHEN 2 THEN 'geyser' WHEN 3 THEN 'waterfall' ELSE 'valley' END AS kind,
 CAST(CASE s_suppkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 6 END AS INT) AS rank,
 CASE WHEN s_suppkey % 3 = 0 THEN concat('https://en.wikipedia.org/wiki/', s_suppkey) ELSE NULL END AS url
 FROM supplier"""

PARKS = "SELECT concat('park', r_regionkey) AS park, concat(r_name, ' National Park') AS name, r_regionkey FROM region"

# Items around a point: parts as facilities.
ITEM_KIND = """CASE p_partkey % 9 WHEN 0 THEN 'camp' WHEN 1 THEN 'stay' WHEN 2 THEN 'trailhead' WHEN 3 THEN 'viewpoint'
 WHEN 4 THEN 'picnic' WHEN 5 THEN 'info' WHEN 6 THEN 'feature' WHEN 7 THEN 'trail' ELSE 'boat' END"""
ITEMS = f"""SELECT concat('node/', 1000000 + p_partkey) AS id, p_name AS name, {park_text('p_partkey')} AS park,
 {ITEM_KIND} AS kind, p_type AS sub, p_size % 3 <> 0 AS named, {lon_text('p_partkey', 'p_partkey')} AS lon,
 {lat_text('p_partkey', 'p_partkey')} AS lat, CASE WHEN p_partkey % 9 = 7 THEN p_size * 100e0 ELSE NULL END AS length_m,
 p_size, p_partkey FROM part"""

# Ways: an order is a way, its distinct line numbers are consecutive nodes of a grid.
NODE = "(l_orderkey * 3 + l_linenumber)"
NODE_LON = f"(-110.5e0 + ({NODE} % 200) * 1e-3)"
NODE_LAT = f"(44.5e0 + ((({NODE} - {NODE} % 200) / 200e0) % 1000) * 1e-3)"
HIGHWAY = """CASE o_custkey % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'path' WHEN 3 THEN 'track'
 WHEN 4 THEN 'service' ELSE 'secondary' END"""
ACCESS = "CASE WHEN o_orderkey % 23 = 0 THEN 'private' ELSE NULL END"
ONEWAY = "CASE WHEN o_orderkey % 10 = 0 THEN 'yes' ELSE NULL END"
WAY_NAME = "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE concat('Way ', o_custkey % 50) END"


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Run a derivation over the named tables."""
    register(spark, sf_dir, *names)
    return spark.sql(text)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, sightings_text("spark"), "events")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, images_text("spark"), "events")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, predictions_text("spark"), "events")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, detections_text("spark"), "events")


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DOWNLOADS, "events")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, REVIEWS, "labels")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with their prediction and frame."""
    from observatory.operators.chains import detection_frame

    return detection_frame(
        detections(spark, sf_dir), predictions(spark, sf_dir).drop("event_id"), images(spark, sf_dir).drop("event_id")
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, STOPS, "supplier")


def parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PARKS, "region")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ITEMS, "part")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways: vertices are the order's distinct line numbers in order."""
    text = f"""SELECT o_orderkey AS id,
      map_filter(map('highway', {HIGHWAY}, 'access', {ACCESS}, 'oneway', {ONEWAY}, 'name', {WAY_NAME}), (k, v) -> v IS NOT NULL) AS tags,
      transform(v, x -> x.node) AS nodes, transform(v, x -> named_struct('lon', x.lon, 'lat', x.lat)) AS geometry
      FROM orders JOIN (
        SELECT l_orderkey, array_sort(collect_list(named_struct('node', node, 'lon', lon, 'lat', lat))) AS v FROM (
          SELECT DISTINCT l_orderkey, CAST({NODE} AS BIGINT) AS node, {NODE_LON} AS lon, {NODE_LAT} AS lat FROM lineitem) d
        GROUP BY l_orderkey) g ON o_orderkey = l_orderkey"""
    return _sql(spark, sf_dir, text, "orders", "lineitem")


CTES = {
    "sightings": sightings_text("duck"),
    "images": images_text("duck"),
    "predictions": predictions_text("duck"),
    "detections": detections_text("duck"),
    "downloads": DOWNLOADS,
    "reviews": REVIEWS,
    "stops": STOPS,
    "parks": PARKS,
    "items": ITEMS,
    "boxes": "SELECT * FROM detections JOIN (SELECT * EXCLUDE (event_id) FROM predictions) USING (image_id, model_version, variant) "
    "JOIN (SELECT * EXCLUDE (event_id) FROM images) USING (image_id)",
}
NEEDS = {"boxes": ("detections", "predictions", "images")}


def oracle(body: str, *ctes: str, extra: str = "") -> str:
    """A DuckDB statement with the derived tables it names in front."""
    wanted: list[str] = []
    for c in ctes:
        for d in (*NEEDS.get(c, ()), c):
            if d not in wanted:
                wanted.append(d)
    parts = [f"{c} AS ({CTES[c]})" for c in wanted]
    if extra:
        parts.append(extra)
    head = "WITH RECURSIVE " if "RECURSIVE_STEP" in body or "RECURSIVE_STEP" in extra else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
