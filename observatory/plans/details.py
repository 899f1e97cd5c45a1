"""Queries over the smaller functions: boxes, rings, names, bodies, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from observatory import schemas
from observatory.functions import geo, names, stats, text
from observatory.operators import graph, lines, ranking, rollups, search
from observatory.plans import places as pl
from observatory.plans import records as rc
from observatory.plans import testbed as tb
from observatory.plans.camera import rounded
from observatory.plans.places import bearing_sql
from observatory.plans.registry import query
from observatory.plans.sightings import PLACED, SPECIES, EFFORT, NAME_RULES, REL, MSUM, _cell_species, _species, hav
from observatory.sources import records, sinks


def o(sql: str, *ctes: str, extra: str = "") -> str:
    return tb.oracle(sql, *ctes, extra=extra)


# ---- boxes and rings ---------------------------------------------------------------------

_BX = "SELECT o_orderkey, (o_orderkey % 300) - 150e0 AS w, (o_orderkey % 120) - 60e0 AS s, (o_orderkey % 300) - 150e0 + (o_orderkey % 16) / 8e0 AS e, (o_orderkey % 120) - 60e0 + 0.25e0 AS n FROM orders"


@query(
    "box_algebra",
    f"""SELECT o_orderkey, printf('%.5f_%.5f_%.5f_%.5f', w, s, e, n) AS id, CAST(w < e AND s < n AND w >= -180 AND e <= 180 AND s >= -90 AND n <= 90 AS INT) AS valid, round((e - w) * (n - s), 6) AS area,
     round((w + e) / 2, 6) AS mid_lon, round(2 * 6371008.8e0 * asin(sqrt(cos(radians((s + n) / 2)) * cos(radians((s + n) / 2)) * pow(sin(radians(e - w) / 2), 2))) / 1000, 6) AS ew_km FROM ({_BX})""",
)
def box_algebra(spark, sf):
    tb.register(spark, sf, "orders")
    box = geo.box_struct("w", "s", "e", "n")
    return spark.sql(_BX).select(
        "o_orderkey", geo.box_id(box).alias("id"), geo.box_valid(box).cast("int").alias("valid"), F.round(geo.box_area(box), 6).alias("area"),
        F.round(geo.box_center(box)["lon"], 6).alias("mid_lon"), F.round(geo.box_size_km(box)["ew_km"], 6).alias("ew_km"),
    )


@query(
    "ring_centroids",
    o(
        f"""SELECT line, round(avg(lon), 7) AS lon, round(avg(lat), 7) AS lat FROM (SELECT DISTINCT l_orderkey AS line, {tb.NODE} AS node, {tb.NODE_LON} AS lon, {tb.NODE_LAT} AS lat FROM lineitem) GROUP BY 1"""
    ),
)
def ring_centroids(spark, sf):
    w = tb.ways(spark, sf).select(F.col("id").alias("line"), F.concat("geometry", F.slice("geometry", 1, 1)).alias("ring"))
    c = geo.ring_centroid(F.col("ring"))
    return w.select("line", F.round(c["lon"], 7).alias("lon"), F.round(c["lat"], 7).alias("lat"))


@query(
    "frame_of_live_boxes",
    o(
        """SELECT round(coalesce(min(CASE WHEN live THEN lon END), min(lon)), 6) AS min_lon, round(coalesce(max(CASE WHEN live THEN lat END), max(lat)), 6) AS max_lat FROM (SELECT *, park = 'park1' AS live FROM stops)""", "stops"
    ),
)
def live_frame(spark, sf):
    s = tb.stops(spark, sf)
    boxes = s.select(
        F.when(F.col("park") == "park1", "live").otherwise("seed").alias("status"), F.col("lon").alias("min_lon"), F.col("lat").alias("min_lat"),
        F.col("lon").alias("max_lon"), F.col("lat").alias("max_lat"),
    )
    return rounded(rollups.frame_of_boxes(boxes).select("min_lon", "max_lat"), "min_lon", "max_lat")


# ---- lines and paths ------------------------------------------------------------------------


def _at(at: str, end: str) -> str:
    return f"""SELECT line, ax + (bx - ax) * (({at} - c0) / m) AS lon, ay + (by_ - ay) * (({at} - c0) / m) AS lat FROM (SELECT *, max(c1) OVER (PARTITION BY line) AS total FROM leg WHERE m > 0)
     WHERE c0 <= {at} AND ({at} < c1 OR (c1 = total AND {at} = total))"""


_HEAD = f"""hd AS (SELECT line, total, CASE WHEN least(total, 160e0) - 100e0 > 5 THEN 100e0 ELSE 40e0 END AS f, CASE WHEN least(total, 160e0) - 100e0 > 5 THEN least(total, 160e0) ELSE total END AS t FROM (SELECT line, sum(m) AS total FROM leg GROUP BY 1)),
 hp AS (SELECT l.line, x.i, ax + (bx - ax) * ((least(greatest(x.d, 0), h.total) - c0) / m) AS lon, ay + (by_ - ay) * ((least(greatest(x.d, 0), h.total) - c0) / m) AS lat,
   row_number() OVER (PARTITION BY l.line, x.i ORDER BY leg DESC) AS rn FROM leg l JOIN hd h USING (line), LATERAL (SELECT unnest([0, 1]) AS i, unnest([h.f, h.t]) AS d) x WHERE m > 0 AND c0 <= least(greatest(x.d, 0), h.total)),
 h2 AS (SELECT a.line, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat FROM hp a JOIN hp b ON b.line = a.line AND a.i = 0 AND b.i = 1 AND a.rn = 1 AND b.rn = 1)"""


@query(
    "line_start_headings",
    o(f"SELECT line, round({bearing_sql('a', 'b')}, 3) AS heading FROM h2 WHERE sqrt(pow(alon - blon, 2) + pow(alat - blat, 2)) > 1e-4", extra=pl.WAYLINES + ", " + _HEAD),
)
def headings(spark, sf):
    """Headings 100 m along, where the two points are apart enough to have one."""
    wl = pl._way_lines(spark, sf)
    out = lines.heading_at(wl, wl.select("line", F.lit(100.0).alias("at_m")), 60.0)
    total = lines.geo_length(F.col("coords"))
    far = wl.filter(F.size("coords") > 1).select("line", total.alias("total")).filter("total > 50")
    return out.join(far, "line").select("line", F.round("heading", 3).alias("heading"))


@query(
    "path_lengths",
    o(
        """SELECT CAST(source AS BIGINT) AS source, CAST(node AS BIGINT) AS target, dist AS length_m FROM dist WHERE dist > 0 /* RECURSIVE_STEP */""", extra=pl.DIST
    ),
)
def path_lengths(spark, sf):
    """Every traced path adds up to its distance."""
    edges = pl._cut_once(pl._edges(spark, sf))
    dist = graph.shortest_distances(pl._sources(spark, sf), edges, "drive")
    walked = graph.trace_paths(dist, dist.select("source", F.col("node").alias("target")), edges)
    return walked.join(edges.select("edge_id", "length_m"), "edge_id").groupBy("source", "target").agg(F.sum("length_m").alias("length_m"))


# ---- names, bodies, vocabularies ---------------------------------------------------------------


@query(
    "variants_and_stems",
    """SELECT event_id, 'yaw' || lpad(CAST(event_id * 45 % 360 AS VARCHAR), 3, '0') AS variant, (event_id * 45 % 360) * 1e0 AS yaw, CAST(event_id AS VARCHAR) AS image_id FROM events""",
)
def variants(spark, sf):
    v = names.variant_name(F.col("event_id") * 45)
    who = names.image_and_variant(F.concat(F.lit("/a/b/"), F.col("event_id").cast("string"), F.lit("__"), v, F.lit(".jpeg")))
    return tb.table(spark, sf, "events").select("event_id", who["variant"].alias("variant"), names.variant_yaw(who["variant"]).alias("yaw"), who["image_id"].alias("image_id"))


@query(
    "wiki_links",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') ELSE '-' END AS url, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '-' END AS title FROM part""",
)
def wiki_links(spark, sf):
    tag = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("en:"), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("fr:"), "p_name"))
    url = text.wiki_url(tag)
    return tb.table(spark, sf, "part").select(
        "p_partkey", F.coalesce(url, F.lit("-")).alias("url"), F.coalesce(text.wiki_title(url), F.lit("-")).alias("title")
    )


@query(
    "elevation_bodies",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value - 400 WHEN 1 THEN -9999e0 WHEN 2 THEN -9999e0 ELSE CASE WHEN value - 600 >= -500 THEN value - 600 ELSE -9999e0 END END AS elevation FROM events""",
)
def elevations(spark, sf):
    e = tb.table(spark, sf, "events")
    body = F.expr(
        """CASE event_id % 4 WHEN 0 THEN concat('{"value": "', value - 400, '"}') WHEN 1 THEN 'Call failed.' WHEN 2 THEN '{"value": -1000000}' ELSE concat('{"value": ', value - 600, '}') END"""
    )
    return e.select("event_id", F.coalesce(text.parse_elevation(body), F.lit(-9999.0)).alias("elevation"))


@query(
    "station_names",
    """SELECT s_suppkey, 'Fork ' || s_suppkey || ' near the Lake, ' || CASE WHEN s_suppkey % 2 = 0 THEN 'UT' ELSE 'WY' END AS name FROM supplier""",
)
def station_names(spark, sf):
    raw = F.concat(F.lit("FORK "), "s_suppkey", F.lit(" NEAR THE LAKE, "), F.when(F.col("s_suppkey") % 2 == 0, "UT").otherwise("wy"))
    return tb.table(spark, sf, "supplier").select("s_suppkey", text.title_case(raw).alias("name"))


@query(
    "review_rows",
    o(
        """SELECT image_id, variant, verdict, coalesce(trim(true_species), '-') AS true_species, coalesce(est_distance_m, -1) AS est_distance_m FROM reviews WHERE verdict <> 'unsure'""", "reviews"
    ),
)
def review_rows(spark, sf):
    r = tb.reviews(spark, sf)
    csv = r.select(
        "image_id", F.when(F.col("variant") == "full", "").otherwise(F.concat(F.lit(" "), "variant")).alias("variant"), F.col("det_idx").cast("string").alias("det_idx"),
        F.when(F.col("verdict") == "unsure", "  ").otherwise(F.upper("verdict")).alias("verdict"), "true_species", "species_agree",
        F.col("est_distance_m").cast("string").alias("est_distance_m"), F.lit(" ").alias("notes"),
    )
    out = records.review_rows(csv)
    return out.select("image_id", "variant", "verdict", F.coalesce("true_species", F.lit("-")).alias("true_species"), F.coalesce("est_distance_m", F.lit(-1.0)).alias("est_distance_m"))


@query(
    "manifest_problems",
    """SELECT file, problem FROM (SELECT doc_id AS file, CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'unlisted' WHEN doc_id % 10 = 3 THEN 'changed' END AS problem FROM documents) WHERE problem IS NOT NULL""",
)
def manifest_problems(spark, sf):
    d = tb.table(spark, sf, "documents").select(
        F.col("doc_id").alias("file"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"), F.sha2(F.concat("text", F.lit("x")), 256).alias("other")
    )
    stored = d.filter("file % 10 <> 2").select("file", "sha256", "bytes")
    now = d.filter("file % 10 <> 1").select("file", F.when(F.col("file") % 10 == 3, F.col("other")).otherwise(F.col("sha256")).alias("sha256"), "bytes")
    return sinks.verify_manifest(stored, now)


@query(
    "species_documents",
    o(
        """SELECT park, to_json({'species': species, 'sightings': sightings, 'human_verified': human_verified, 'months': [m1, m2, m3]}) AS value FROM sp""", "sightings", extra=SPECIES
    ),
)
def species_documents(spark, sf):
    sp = _species(spark, sf).select("park", "species", "sightings", "human_verified", F.slice("months", 1, 3).alias("months"))
    return sinks.row_documents(sp)


@query(
    "union_of_sources",
    """SELECT 'inaturalist' AS source, count(*) AS n FROM events UNION ALL SELECT 'gbif', count(*) FROM orders""",
)
def union_sources(spark, sf):
    obs = records.normalize_observations(rc._landed(spark, sf, rc._OBS_JSON, schemas.OBSERVATION, "events"), F.lit("p"))
    occ = records.normalize_occurrences(rc._landed(spark, sf, rc._OCC_JSON, schemas.OCCURRENCE, "orders"), F.lit("p"))
    return records.union_sources(obs, occ).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "species_by_total",
    o("SELECT species, CAST(sum(sightings) AS BIGINT) AS total FROM sp GROUP BY 1 ORDER BY total DESC, species", "sightings", extra=SPECIES),
)
def species_by_total(spark, sf):
    totals = _species(spark, sf).groupBy("species").agg(F.sum("sightings").alias("total"))
    return ranking.species_order(totals)


_TOP3 = """CASE WHEN n = 3 AND c - a = 2 THEN nm[a] || ' to ' || nm[c] WHEN n = 3 AND a = 1 AND b = 2 AND c = 12 THEN 'Dec to Feb' WHEN n = 3 AND a = 1 AND b = 11 AND c = 12 THEN 'Nov to Jan' ELSE array_to_string(list_transform(ms, lambda i: nm[i]), ', ') END"""


@query(
    "busiest_months",
    f"""WITH m AS (SELECT o_custkey AS who, month(o_orderdate) AS m, count(*) AS k FROM orders GROUP BY ALL), t AS (SELECT who, sum(k) AS total FROM m GROUP BY 1),
     r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY k DESC, m) AS rn FROM m),
     g AS (SELECT who, list(m ORDER BY m) AS ms, count(*) AS n FROM r WHERE rn <= 3 GROUP BY 1)
     SELECT who, CASE WHEN total < 12 THEN '-' ELSE 'Busiest ' || {_TOP3} END AS label FROM (SELECT who, ms, n, total, ms[1] AS a, ms[2] AS b, ms[3] AS c,
       ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'] AS nm FROM g JOIN t USING (who))""",
)
def busiest_months(spark, sf):
    m = tb.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("who")).agg(stats.month_counts(F.month("o_orderdate")).alias("months"))
    return m.select("who", F.coalesce(stats.busiest_label(F.col("months")), F.lit("-")).alias("label"))


# ---- grounded sentences ----------------------------------------------------------------------------

@query(
    "park_sentences",
    o(
        f"""SELECT park, park || ': ' || replace(format('{{:,}}', CAST(sum(sightings) AS BIGINT)), ' ', '') || ' recorded sightings of ' || count(*) || ' species; ' ||
     CAST(floor(100 * CAST(sum(m6 + m7 + m8) AS DOUBLE) / CAST(sum({MSUM}) AS DOUBLE) + 0.5) AS BIGINT) || '% fall in June to August.' AS fact FROM sp GROUP BY park""",
        "sightings", extra=SPECIES,
    ),
)
def park_sentences(spark, sf):
    return search.park_fact(rollups.park_facts(_species(spark, sf)))


@query(
    "hotspots_named",
    o(
        f"""SELECT park, species, cell, "count", rank, landmark, round(d, 6) AS dist_m FROM (SELECT h.park, h.species, h.cell, h."count", CAST(h.rank AS INT) AS rank, s.name AS landmark,
     {hav('h', 's', 6371000.0)} AS d, row_number() OVER (PARTITION BY h.park, h.species, h.cell ORDER BY {hav('h', 's', 6371000.0)}, s.id) AS rn FROM (
     SELECT * REPLACE (round_even(lon, 4) AS lon, round_even(lat, 4) AS lat) FROM (SELECT *, {pl._unhex()} FROM (
       SELECT *, row_number() OVER (PARTITION BY park, species ORDER BY "count" DESC, cell) AS rank FROM cs WHERE NOT coarsened) WHERE rank <= 3)) h, stops s) WHERE rn = 1""",
        "sightings", "stops", extra=PLACED,
    ),
)
def hotspots_named(spark, sf):
    out = search.name_hotspots(ranking.hotspots(_cell_species(spark, sf)), tb.stops(spark, sf).drop("park"))
    return out.withColumn("dist_m", F.round("dist_m", 6))


@query(
    "hotspots_near_landmarks",
    o(
        f"""SELECT park, species, cell, landmark, round(d, 6) AS dist_m FROM (SELECT h.park, h.species, h.cell, s.name AS landmark, {hav('h', 's', 6371000.0)} AS d, row_number() OVER (PARTITION BY h.park, h.species, h.cell ORDER BY {hav('h', 's', 6371000.0)}, s.id) AS rn FROM (
     SELECT *, {pl._unhex()} FROM (SELECT *, row_number() OVER (PARTITION BY park, species ORDER BY "count" DESC, cell) AS rank FROM cs WHERE NOT coarsened) WHERE rank <= 3) h, stops s) WHERE rn = 1""",
        "sightings", "stops", extra=PLACED,
    ),
)
def hotspots_near(spark, sf):
    from observatory.functions import hexgrid

    top = ranking.hotspots(_cell_species(spark, sf))
    at = hexgrid.center(F.col("cell"), 9)
    exact = top.withColumn("lon", at["lon"]).withColumn("lat", at["lat"])
    out = search.name_hotspots(exact, tb.stops(spark, sf).drop("park"))
    return out.select("park", "species", "cell", "landmark", F.round("dist_m", 6).alias("dist_m"))


_M, _R = (", ".join(f"{c}{m}" for m in range(1, 13)) for c in "mr")
_NAMED = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"


@query(
    "species_facts",
    o(
        f"""SELECT rel.park, rel.species, coalesce(p.common_name, rel.species) || ' (' || rel.species || '): ' || format('{{:,}}', sightings) || ' sightings, ' || format('{{:,}}', human_verified)
     || ' verified by people and ' || model_predicted || ' model-predicted, recorded ' || year(first_on) || ' to ' || year(last_on) || '; busiest month ' || {_NAMED}[list_position([{_M}], greatest({_M}))]
     || coalesce(CASE WHEN greatest({_R}) > 0 THEN '; seen ' || printf('%.1f', greatest({_R})) || 'x more than usual in ' || {_NAMED}[list_position([{_R}], greatest({_R}))] END, '') || '.' AS fact
     FROM rel LEFT JOIN picked p ON p.park = rel.park AND p.species = rel.species""",
        "sightings", extra=f"{SPECIES}, {EFFORT}, {REL}",
    ),
)
def species_facts(spark, sf):
    return search.species_fact(rollups.relative_months(_species(spark, sf)))


@query(
    "species_sentence_months",
    o(
        f"""SELECT park, species, list_position([{", ".join(f"m{m}" for m in range(1, 13))}], greatest({", ".join(f"m{m}" for m in range(1, 13))})) AS busiest FROM rel""",
        "sightings", extra=f"{SPECIES}, {NAME_RULES}, {EFFORT}, {REL}",
    ),
)
def species_sentence_months(spark, sf):
    rel = rollups.relative_months(_species(spark, sf))
    fact = search.species_fact(rel)
    named = F.regexp_extract("fact", r"busiest month (\w+)", 1)
    order = F.array(*[F.lit(m) for m in stats.MONTH_NAMES])
    return fact.select("park", "species", F.array_position(order, named).cast("int").alias("busiest"))
