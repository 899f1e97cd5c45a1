"""Queries over places, landmarks, proximity, lines, the graph and climate."""

from __future__ import annotations

from pyspark.sql import functions as F

from observatory.functions import hexgrid, labels
from observatory.operators import graph, lines, places, ranking, rollups, spatial, tiling
from observatory.plans import testbed as tb
from observatory.plans.camera import rounded
from observatory.plans.registry import query
from observatory.plans.sightings import PLACED, _cell_species, hav
from observatory.session import materialise

SPHERE = 6371000.0


def o(sql: str, *ctes: str, extra: str = "") -> str:
    return tb.oracle(sql, *ctes, extra=extra)


# ---- map elements -------------------------------------------------------------------

_TAGS = """map_filter(map(
 'tourism', CASE p_partkey % 14 WHEN 0 THEN 'camp_site' WHEN 1 THEN 'hotel' WHEN 3 THEN 'viewpoint' WHEN 4 THEN 'picnic_site' WHEN 5 THEN 'information' WHEN 9 THEN 'museum' END,
 'highway', CASE WHEN p_partkey % 14 = 2 THEN 'trailhead' END, 'leisure', CASE WHEN p_partkey % 14 = 6 THEN 'slipway' END,
 'amenity', CASE WHEN p_partkey % 14 = 7 THEN 'ranger_station' END,
 'natural', CASE p_partkey % 14 WHEN 8 THEN 'geyser' WHEN 10 THEN 'peak' WHEN 11 THEN 'water' END,
 'waterway', CASE WHEN p_partkey % 14 = 12 THEN 'waterfall' END, 'historic', CASE WHEN p_partkey % 14 = 13 THEN 'ruins' END,
 'information', CASE WHEN p_partkey % 14 = 5 THEN CASE WHEN p_size % 2 = 0 THEN 'visitor_centre' ELSE 'board' END END,
 'name', CASE WHEN p_size % 3 <> 0 THEN concat(p_name, ' ', p_brand) END,
 'wikipedia', CASE p_size % 4 WHEN 0 THEN concat('en:', p_name) WHEN 1 THEN concat('fr:', p_name) END,
 'ele', CASE WHEN p_size % 5 = 0 THEN CAST(p_size * 10 AS STRING) WHEN p_size % 7 = 0 THEN 'high' END,
 'capacity', CASE WHEN p_size % 6 = 0 THEN CAST(p_size AS STRING) END, 'fee', CASE p_size % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END,
 'reservation', CASE p_size % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'required' END, 'backcountry', CASE WHEN p_size % 7 = 0 THEN 'yes' END,
 'seasonal', CASE p_size % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END), (k, v) -> v IS NOT NULL)"""
_ELEMENTS = f"""SELECT concat('node/', p_partkey) AS id, {tb.park_text('p_partkey')} AS park, {tb.lon_text('p_partkey', 'p_partkey')} AS lon,
 {tb.lat_text('p_partkey', 'p_partkey')} AS lat, {_TAGS} AS tags, p_partkey, p_size FROM part"""
_CORNERS = [("-0.15e0 - r_regionkey / 100e0", "-0.15e0"), ("0.15e0 + r_regionkey / 100e0", "-0.1e0"), ("0.12e0", "0.15e0"), ("-0.08e0", "0.15e0")]
_RING = "array(" + ", ".join(f"named_struct('lon', -110.3e0 + ({x}), 'lat', 44.7e0 + ({y}))" for x, y in _CORNERS) + ")"
_BOUNDARIES = f"SELECT concat('park', r_regionkey) AS park, array({_RING}) AS rings FROM region"


def _elements(spark, sf):
    tb.register(spark, sf, "part", "region")
    el = spark.sql(_ELEMENTS)
    return places.inside(el, places.boundary_boxes(spark.sql(_BOUNDARIES)))


def _edge_sql(a: int, b: int) -> str:
    (ax, ay), (bx, by) = _CORNERS[a], _CORNERS[b]
    y1, y2 = f"(44.7e0 + ({ay}))", f"(44.7e0 + ({by}))"
    x1, x2 = f"(-110.3e0 + ({ax}))", f"(-110.3e0 + ({bx}))"
    return f"CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < {x1} + (lat - {y1}) * ({x2} - {x1}) / ({y2} - {y1}) THEN 1 ELSE 0 END"


_INSIDE = "(" + " + ".join(_edge_sql(i, (i + 1) % 4) for i in range(4)) + ") % 2 = 1"
EL = f"""el AS (SELECT *, p_partkey % 14 AS m, CASE WHEN p_size % 3 <> 0 THEN p_name || ' ' || p_brand END AS nm, {_INSIDE} AS inside
 FROM (SELECT *, concat('node/', p_partkey) AS id, {tb.park_text('p_partkey')} AS park, {tb.lon_text('p_partkey', 'p_partkey')} AS lon, {tb.lat_text('p_partkey', 'p_partkey')} AS lat FROM part) p
 JOIN region ON concat('park', r_regionkey) = park)"""
LM = f"""{EL}, lm0 AS (SELECT *, CASE m WHEN 8 THEN 0 WHEN 12 THEN 2 WHEN 10 THEN 4 WHEN 11 THEN 5 WHEN 3 THEN 9 WHEN 5 THEN 10 WHEN 9 THEN 11 WHEN 13 THEN 12 END AS rank,
 CASE m WHEN 8 THEN 'geyser' WHEN 12 THEN 'waterfall' WHEN 10 THEN 'peak' WHEN 11 THEN 'lake' WHEN 3 THEN 'viewpoint' WHEN 5 THEN 'visitor centre' WHEN 9 THEN 'attraction' WHEN 13 THEN 'historic' END AS kind,
 CASE WHEN p_size % 4 = 0 THEN 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') END AS url FROM el WHERE nm IS NOT NULL AND inside AND m IN (3, 5, 8, 9, 10, 11, 12, 13)),
 lm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park, lower(nm) ORDER BY rank, url IS NULL, nm, id) AS rn FROM lm0) WHERE rn = 1)"""
AM = f"""{EL}, am AS (SELECT *, CASE m WHEN 0 THEN 'camp' WHEN 1 THEN 'stay' WHEN 2 THEN 'trailhead' WHEN 3 THEN 'viewpoint' WHEN 4 THEN 'picnic' WHEN 5 THEN 'info' WHEN 7 THEN 'info' WHEN 6 THEN 'boat' ELSE 'feature' END AS kind,
 CASE m WHEN 0 THEN 'camp site' WHEN 1 THEN 'hotel' WHEN 2 THEN 'trailhead' WHEN 3 THEN 'viewpoint' WHEN 4 THEN 'picnic site' WHEN 5 THEN 'information' WHEN 7 THEN 'ranger station' WHEN 6 THEN 'slipway' WHEN 8 THEN 'geyser' WHEN 10 THEN 'peak' ELSE '' END AS sub,
 coalesce(nm, CASE m WHEN 0 THEN 'Campsite' WHEN 2 THEN 'Trailhead' WHEN 3 THEN 'Viewpoint' WHEN 4 THEN 'Picnic site' WHEN 6 THEN 'Boat launch' END) AS name
 FROM el WHERE m IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12) AND (m <> 5 OR p_size % 2 = 0) AND (m IN (0, 2, 3, 4, 6) OR nm IS NOT NULL) AND (m IN (0, 1) OR inside))"""


@query("points_inside_boundary", o("SELECT id, CAST(inside AS INT) AS inside FROM el", extra=EL))
def inside(spark, sf):
    return _elements(spark, sf).select("id", F.col("inside").cast("int").alias("inside"))


@query(
    "landmarks",
    o("SELECT park, id, nm AS name, kind, CAST(rank AS INT) AS rank, coalesce(url, '-') AS url, CASE WHEN p_size % 5 = 0 THEN p_size * 10e0 ELSE -1e0 END AS ele_m FROM lm", extra=LM),
)
def landmarks(spark, sf):
    return places.landmarks_from(_elements(spark, sf)).select(
        "park", "id", "name", "kind", "rank", F.coalesce("url", F.lit("-")).alias("url"), F.coalesce("ele_m", F.lit(-1.0)).alias("ele_m")
    )


@query(
    "amenities",
    o("SELECT park, id, kind, sub, name, CAST(nm IS NOT NULL AS INT) AS named, round_even(lon, 5) AS lon, round_even(lat, 5) AS lat FROM am", extra=AM),
)
def amenities(spark, sf):
    return places.amenities_from(_elements(spark, sf)).select(
        "park", "id", "kind", "sub", "name", F.col("named").cast("int").alias("named"), "lon", "lat"
    )


@query(
    "campground_details",
    o(
        """SELECT id, concat_ws(' · ', '1.2 km', CASE WHEN p_size % 7 = 0 THEN 'backcountry' END, CASE WHEN p_size % 6 = 0 THEN p_size || ' sites' END,
     CASE p_size % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'fee' END, CASE p_size % 5 WHEN 0 THEN 'first come' WHEN 1 THEN 'reservation required' END,
     CASE WHEN p_size % 3 = 1 THEN 'seasonal' END) AS detail FROM am WHERE kind = 'camp'""",
        extra=AM,
    ),
)
def camp_details(spark, sf):
    from observatory.functions import text

    am = places.amenities_from(_elements(spark, sf)).filter("kind = 'camp'")
    return am.select("id", text.camp_detail(F.col("tags"), F.lit(1234.0)).alias("detail"))


@query(
    "camp_and_trail_lists",
    o(
        """SELECT park, id, name, rank FROM (SELECT park, id, name, CAST(row_number() OVER (PARTITION BY park ORDER BY id) AS INT) AS rank FROM am
     WHERE kind = 'camp' AND nm IS NOT NULL AND p_size % 7 <> 0) WHERE rank <= 8
     UNION ALL SELECT park, id, name, rank FROM (SELECT park, id, name, CAST(row_number() OVER (PARTITION BY park ORDER BY length_m DESC, name, id) AS INT) AS rank FROM items WHERE kind = 'trail') WHERE rank <= 8""",
        "items", extra=AM,
    ),
)
def camp_lists(spark, sf):
    trails = tb.items(spark, sf).filter("kind = 'trail'")
    camps, longest = ranking.camp_and_trail_lists(places.amenities_from(_elements(spark, sf)), trails)
    return camps.select("park", "id", "name", "rank").unionByName(longest.select("park", "id", "name", "rank"))


# ---- landmarks and tours ---------------------------------------------------------------

_LORDER = "rank, url IS NULL, name, id"


PICKS = f"""turns AS (SELECT *, row_number() OVER (PARTITION BY park, tier, kind ORDER BY {_LORDER}) AS turn, min(kr) OVER (PARTITION BY park, tier, kind) AS first_kind
   FROM (SELECT *, CASE WHEN url IS NULL THEN 1 ELSE 0 END AS tier, row_number() OVER (PARTITION BY park, url IS NULL ORDER BY {_LORDER}) AS kr FROM stops)),
 picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park ORDER BY tier, turn, first_kind) AS pick FROM turns) WHERE pick <= 8)"""


@query("tour_round_robin", o("SELECT park, id, CAST(pick AS INT) AS pick FROM picks", "stops", extra=PICKS))
def round_robin(spark, sf):
    return ranking.round_robin_stops(tb.stops(spark, sf)).select("park", "id", "pick")


@query(
    "tour_nearest_chain",
    o(
        f"""SELECT park, id, CAST(len(seen) - 1 AS INT) AS tour FROM walk /* RECURSIVE_STEP */""",
        "stops",
        extra=f"""{PICKS}, walk AS (SELECT park, id, lon, lat, [id] AS seen FROM (SELECT *, row_number() OVER (PARTITION BY park ORDER BY lon, id) AS rn FROM picks) WHERE rn = 1
     UNION ALL SELECT park, id, lon, lat, seen FROM (SELECT p.park, p.id, p.lon, p.lat, list_append(w.seen, p.id) AS seen,
       row_number() OVER (PARTITION BY p.park ORDER BY {hav('w', 'p')}, p.lon, p.id) AS rn FROM walk w JOIN picks p ON p.park = w.park AND NOT list_contains(w.seen, p.id)) WHERE rn = 1)""",
    ),
)
def tour_chain(spark, sf):
    return ranking.chain_stops(ranking.round_robin_stops(tb.stops(spark, sf))).select("park", "id", "tour")


TOUR = """SELECT concat('park', n_regionkey) AS park, CAST(n_nationkey AS INT) AS pos, CASE n_nationkey % 4 WHEN 0 THEN concat('Supplier#', lpad(CAST(n_nationkey AS STRING), 9, '0'))
     WHEN 1 THEN concat('supplier#00000', n_nationkey % 3) WHEN 2 THEN concat('0', n_nationkey) ELSE CASE WHEN n_nationkey > 12 THEN 'supplier' ELSE n_name END END AS stop,
     CASE WHEN n_nationkey % 5 = 1 THEN -110e0 END AS fb_lon, CASE WHEN n_nationkey % 5 = 1 THEN 44e0 END AS fb_lat, CASE WHEN n_nationkey % 3 = 0 THEN concat('Article ', n_nationkey) END AS article FROM nation"""
# Configured stops are places for the stops after them; listed landmarks come first.
MATCHED = f"""t AS ({TOUR}), xs AS (SELECT DISTINCT t.park, pos FROM t JOIN stops s ON s.park = t.park AND lower(s.name) = lower(t.stop)),
 cf AS (SELECT * FROM t WHERE fb_lon IS NOT NULL AND (park, pos) NOT IN (SELECT (park, pos) FROM xs)),
 cand AS (SELECT t.park, t.pos, s.id, CASE WHEN lower(name) = lower(t.stop) THEN 0 WHEN starts_with(lower(name), lower(t.stop)) THEN 2 WHEN contains(lower(name), lower(t.stop)) THEN 3 END AS g, 0 AS late, rank, url IS NULL AS u, name
   FROM t JOIN stops s ON s.park = t.park
   UNION ALL SELECT t.park, t.pos, 'config/' || cf.pos, CASE WHEN starts_with(lower(cf.stop), lower(t.stop)) THEN 2 WHEN contains(lower(cf.stop), lower(t.stop)) THEN 3 END, 1, cf.pos, false, cf.stop FROM t JOIN cf ON cf.park = t.park AND cf.pos < t.pos),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park, pos ORDER BY g, late, rank, u, name, id) AS rn FROM cand WHERE g IS NOT NULL) WHERE rn = 1),
 mt AS (SELECT t.park, t.pos, t.stop, t.article, CASE WHEN g = 0 THEN 'exact' WHEN fb_lon IS NOT NULL THEN 'configured' WHEN g = 2 THEN 'prefix' WHEN g = 3 THEN 'contains' ELSE 'missing' END AS how,
   CASE WHEN g IS DISTINCT FROM 0 AND fb_lon IS NOT NULL THEN 'config/' || t.pos ELSE b.id END AS id FROM t LEFT JOIN best b ON b.park = t.park AND b.pos = t.pos)"""


def _tour(spark, sf):
    tb.register(spark, sf, "nation")
    return spark.sql(TOUR)


@query("tour_name_match", o("SELECT park, pos, how, coalesce(id, '-') AS id FROM mt", "stops", extra=MATCHED))
def tour_match(spark, sf):
    out = ranking.match_tour(_tour(spark, sf), tb.stops(spark, sf))
    return out.select("park", "pos", "how", F.coalesce("id", F.lit("-")).alias("id"))


@query(
    "landmarks_capped",
    o(
        f"""SELECT park, id, coalesce(url, '-') AS url FROM (SELECT *, row_number() OVER (PARTITION BY park ORDER BY {_LORDER}) - 1 AS before FROM (
     SELECT *, row_number() OVER (PARTITION BY park, kind ORDER BY {_LORDER}) AS rn FROM al WHERE NOT st UNION ALL SELECT *, 0 FROM al WHERE st) WHERE rn <= 2)
     LEFT JOIN (SELECT park, count(DISTINCT id) AS extra FROM sid GROUP BY park) USING (park) WHERE st OR before < 6 + coalesce(extra, 0)""",
        "stops",
        extra=MATCHED + """, ar AS (SELECT park, id, max_by(article, pos) AS article FROM mt WHERE id IS NOT NULL AND article IS NOT NULL GROUP BY 1, 2),
 sid AS (SELECT park, id FROM mt WHERE id IS NOT NULL UNION SELECT park, concat('gone/', pos) FROM mt WHERE pos % 6 = 0),
 al AS (SELECT l.park, l.id, name, kind, rank, coalesce('https://en.wikipedia.org/wiki/' || replace(article, ' ', '_'), url) AS url, (l.park, l.id) IN (SELECT (park, id) FROM sid) AS st FROM (
   SELECT park, id, name, kind, rank, url FROM stops UNION ALL SELECT park, id, stop, 'place', 14, 'https://en.wikipedia.org/wiki/' || replace(stop, ' ', '_') FROM mt WHERE how = 'configured') l
   LEFT JOIN ar ON ar.park = l.park AND ar.id = l.id)""",
    ),
)
def landmarks_capped(spark, sf):
    """The tour's stops, some of them configured and some that no list has, stay; the others are capped."""
    tour, lm = _tour(spark, sf), tb.stops(spark, sf)
    matched = ranking.match_tour(tour, lm)
    gone = tour.filter("pos % 6 = 0").select("park", F.concat(F.lit("gone/"), "pos").alias("id"))
    stops = matched.filter("id is not null").select("park", "id").unionByName(gone)
    return ranking.cap_by_kind(ranking.tour_landmarks(lm, matched, tour), stops, 2, 6).select("park", "id", F.coalesce("url", F.lit("-")).alias("url"))


@query(
    "tour_stops_in_order",
    o(
        """SELECT 'park' || r AS park, CAST(p - 1 AS INT) AS pos, s.id, name FROM (SELECT n_regionkey AS r, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM
     (SELECT n_regionkey, list(concat('node/', n_nationkey * 3) ORDER BY n_nationkey DESC) AS ids FROM nation GROUP BY 1)) t JOIN stops s ON s.id = t.id AND s.park = 'park' || r""",
        "stops",
    ),
)
def tour_order(spark, sf):
    n = tb.table(spark, sf, "nation")
    ids = F.transform(F.reverse(F.array_sort(F.collect_list("n_nationkey"))), lambda k: F.concat(F.lit("node/"), (k * 3).cast("string")))
    tour = n.groupBy(F.concat(F.lit("park"), "n_regionkey").alias("park")).agg(ids.alias("tour"))
    return ranking.stops_in_order(tour, tb.stops(spark, sf)).select("park", "pos", "id", "name")


_BEAR = """(degrees(atan2(sin(radians({b}lon - {a}lon)) * cos(radians({b}lat)), cos(radians({a}lat)) * sin(radians({b}lat)) - sin(radians({a}lat)) * cos(radians({b}lat)) * cos(radians({b}lon - {a}lon)))) + 360e0)"""


def bearing_sql(a: str, b: str) -> str:
    x = _BEAR.format(a=a, b=b)
    return f"({x} - 360e0 * floor({x} / 360e0))"


@query(
    "tour_headings",
    o(
        f"""SELECT park, pos, round(coalesce({bearing_sql('', 'n_')}, {bearing_sql('p_', '')}, 0), 6) AS heading FROM (SELECT park, CAST(stop AS INT) AS pos, lon, lat,
     lead(lon) OVER w AS n_lon, lead(lat) OVER w AS n_lat, lag(lon) OVER w AS p_lon, lag(lat) OVER w AS p_lat FROM stops WINDOW w AS (PARTITION BY park ORDER BY stop))""",
        "stops",
    ),
)
def tour_headings(spark, sf):
    s = tb.stops(spark, sf).withColumn("pos", F.col("stop").cast("int"))
    return rounded(ranking.stop_headings(s).select("park", "pos", "heading"), "heading")


# ---- ways ---------------------------------------------------------------------------------

_HW = "CASE o_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 0 END"
WAYS = f"""wy AS (SELECT o_orderkey AS id, {_HW} AS kind, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS oneway, {tb.WAY_NAME} AS name FROM orders
   WHERE o_custkey % 6 <> 4 AND o_orderkey % 23 <> 0),
 vt AS (SELECT DISTINCT l_orderkey AS id, CAST({tb.NODE} AS BIGINT) AS node, {tb.NODE_LON} AS lon, {tb.NODE_LAT} AS lat FROM lineitem),
 v AS (SELECT vt.*, kind, oneway, name, row_number() OVER w AS k, count(*) OVER (PARTITION BY vt.id) AS nv, lag(lon) OVER w AS p_lon, lag(lat) OVER w AS p_lat
   FROM vt JOIN wy ON wy.id = vt.id WINDOW w AS (PARTITION BY vt.id ORDER BY node)),
 vv AS (SELECT *, count(*) OVER (PARTITION BY node) >= 2 AS joint FROM v WHERE nv >= 2)"""
_HPV = """2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"""
CUTS = f"""{WAYS},
 cut AS (SELECT id, k, node, lon, lat, node AS src, k AS first, 0e0 AS m, false AS done, CAST(NULL AS BIGINT) AS e_src, CAST(NULL AS BIGINT) AS e_dst, CAST(NULL AS DOUBLE) AS e_m, CAST(NULL AS BIGINT) AS e_n, kind, oneway, name FROM vv WHERE k = 1
   UNION ALL
   SELECT x.id, x.k, x.node, x.lon, x.lat, CASE WHEN brk THEN x.node ELSE psrc END, CASE WHEN brk THEN x.k ELSE pfirst END, CASE WHEN brk THEN 0e0 ELSE mm END, brk, CASE WHEN brk THEN psrc END, CASE WHEN brk THEN x.node END, CASE WHEN brk THEN mm END, CASE WHEN brk THEN x.k - pfirst + 1 END, x.kind, x.oneway, x.name
   FROM (SELECT n.*, c.src AS psrc, c.first AS pfirst, c.m + {_HPV.format(a='c', b='n')} AS mm, (n.k = n.nv OR n.joint OR c.m + {_HPV.format(a='c', b='n')} >= 300) AS brk FROM cut c JOIN vv n ON n.id = c.id AND n.k = c.k + 1) x),
 ed AS (SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS part, kind, oneway, name, e_src AS src, e_dst AS dst, round_even(e_m, 0) AS length_m, e_m, e_n AS n, k AS last FROM cut WHERE done) WHERE src <> dst AND e_m > 0)"""


# ---- place list ------------------------------------------------------------------------------

PLACES = """pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park, id ORDER BY sr, name) AS rn FROM (
   SELECT park, id, 'landmark' AS src, kind, NULL AS sub, name, lon, lat, NULL AS length_m, 500e0 AS radius_m, 0 AS sr FROM stops
   UNION ALL SELECT park, CASE WHEN p_partkey % 20 = 0 THEN concat('node/', p_partkey / 20) ELSE id END, 'item', kind, sub, name, lon, lat, NULL, 500e0, 1 FROM items WHERE named AND kind <> 'trail'
   UNION ALL SELECT park, id, 'trail', 'trail', NULL, name, lon, lat, length_m, 300e0, 2 FROM items WHERE kind = 'trail')) WHERE rn = 1)"""
PLACES = PLACES.replace("p_partkey / 20", "p_partkey // 20")


def _places(spark, sf):
    s = tb.stops(spark, sf).withColumn("ele_m", F.lit(None).cast("double"))
    it = tb.items(spark, sf).withColumn("tags", F.create_map(F.lit("ele"), F.col("p_size").cast("string")))
    own = F.when(F.col("p_partkey") % 20 == 0, F.concat(F.lit("node/"), F.expr("p_partkey div 20"))).otherwise(F.col("id"))
    points = it.filter("kind <> 'trail'").withColumn("id", own)
    return places.collect_places(s, points, it.filter("kind = 'trail'"))


@query("place_list", o("SELECT park, id, src, kind, name FROM pl", "stops", "items", extra=PLACES))
def place_list(spark, sf):
    return _places(spark, sf).select("park", "id", "src", "kind", "name")


_WAY_PARK = "concat('park', id % 5)"


def _near_ctes() -> str:
    """hits: places and the sightings near them, trails by the samples along their edges."""
    return f"""{CUTS}, ts AS (SELECT {_WAY_PARK} AS park, name, concat('trail/', name) AS id, sum(length_m) AS length_m FROM ed WHERE kind = 1 AND name IS NOT NULL GROUP BY ALL HAVING sum(length_m) >= 500),
 pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park, id ORDER BY sr, name) AS rn FROM (
   SELECT park, id, 'landmark' AS src, name, lon, lat, 500e0 AS radius_m, 0 AS sr FROM stops
   UNION ALL SELECT park, CASE WHEN p_partkey % 20 = 0 THEN concat('node/', p_partkey // 20) ELSE id END, 'item', name, lon, lat, 500e0, 1 FROM items WHERE named AND kind <> 'trail'
   UNION ALL SELECT park, id, 'trail', name, NULL, NULL, 300e0, 2 FROM ts)) WHERE rn = 1),
 ev AS (SELECT ed.id, ed.part, {_WAY_PARK.replace('id', 'ed.id')} AS park, ed.name, v.k, v.lon AS ax, v.lat AS ay, lead(v.lon) OVER w AS bx, lead(v.lat) OVER w AS by_, row_number() OVER w AS leg
   FROM ed JOIN vv v ON v.id = ed.id AND v.k BETWEEN ed.last - ed.n + 1 AND ed.last WHERE ed.kind = 1 AND ed.name IS NOT NULL WINDOW w AS (PARTITION BY ed.id, ed.part ORDER BY v.k)),
 em AS (SELECT *, 2 * {SPHERE}e0 * asin(sqrt(least(1e0, pow(sin((radians(by_) - radians(ay)) / 2), 2) + cos(radians(ay)) * cos(radians(by_)) * pow(sin(radians(bx - ax) / 2), 2)))) AS m FROM ev),
 ec AS (SELECT *, sum(m) OVER (PARTITION BY id, part ORDER BY leg ROWS UNBOUNDED PRECEDING) AS c1 FROM em WHERE bx IS NOT NULL),
 sm AS (SELECT park, name, ax AS lon, ay AS lat FROM ev WHERE leg = 1
   UNION ALL SELECT park, name, ax + (bx - ax) * ((at_m - (c1 - m)) / m), ay + (by_ - ay) * ((at_m - (c1 - m)) / m) FROM (SELECT *, unnest(range(CAST(floor((c1 - m) / 150e0) AS BIGINT) + 1, CAST(floor(c1 / 150e0) AS BIGINT) + 1)) * 150e0 AS at_m FROM ec WHERE m > 0)),
 pt AS (SELECT park, id, lon, lat, radius_m FROM pl WHERE src <> 'trail' UNION ALL SELECT pl.park, pl.id, sm.lon, sm.lat, radius_m FROM pl JOIN sm ON sm.park = pl.park AND sm.name = pl.name WHERE src = 'trail'),
 open_s AS (SELECT sighting_id, park, lon, lat, month(observed_on) AS month, scientific_name FROM sightings WHERE coordinate_status = 'open' AND lon IS NOT NULL),
 hits AS (SELECT DISTINCT p.park, p.id AS place, s.month, s.scientific_name, s.sighting_id FROM pt p JOIN open_s s ON s.park = p.park
   AND s.lat BETWEEN p.lat - 0.01e0 AND p.lat + 0.01e0 AND s.lon BETWEEN p.lon - 0.02e0 AND p.lon + 0.02e0 AND {hav('p', 's', SPHERE)} <= p.radius_m)"""


def _hits(spark, sf):
    """Places with the trails of the road network, their sites, and what is near these; a trail reaches along all its edges."""
    edges = materialise(_edges(spark, sf).filter("kind = 1 and name is not null"), "trail-edges")
    trails = rollups.trail_rollup(edges).withColumn("id", F.concat(F.lit("trail/"), "name"))
    s = tb.stops(spark, sf).withColumn("ele_m", F.lit(None).cast("double"))
    it = tb.items(spark, sf).withColumn("tags", F.create_map(F.lit("ele"), F.col("p_size").cast("string")))
    own = F.when(F.col("p_partkey") % 20 == 0, F.concat(F.lit("node/"), F.expr("p_partkey div 20"))).otherwise(F.col("id"))
    p = materialise(places.collect_places(s, it.filter("kind <> 'trail'").withColumn("id", own), trails), "places")
    seen = tb.sightings(spark, sf).filter((F.col("coordinate_status") == "open") & F.col("lon").isNotNull())
    return p, *spatial.site_hits(seen, places.place_samples(p, lines.trail_pieces(edges)))


@query(
    "sightings_near_places",
    o("SELECT park, place, CAST(month AS INT) AS month, coalesce(scientific_name, '-') AS species, count(*) AS n FROM hits GROUP BY ALL /* RECURSIVE_STEP */", "stops", "items", "sightings", extra=_near_ctes()),
)
def near_places(spark, sf):
    _, members, hits = _hits(spark, sf)
    return members.join(hits, ["park", "site"]).select("park", "place", "month", F.coalesce("scientific_name", F.lit("-")).alias("species"), "n")


@query(
    "place_rollup",
    o(
        """SELECT pl.park, pl.id AS place, coalesce(n, 0) AS n, coalesce(species, 0) AS species, coalesce(top, '') AS top FROM pl
     LEFT JOIN (SELECT park, place, count(*) AS n, count(DISTINCT scientific_name) AS species FROM hits GROUP BY 1, 2) t ON t.park = pl.park AND t.place = pl.id
     LEFT JOIN (SELECT park, place, string_agg(coalesce(scientific_name, '-') || '=' || n, ';' ORDER BY n DESC, scientific_name NULLS FIRST) AS top FROM (
       SELECT *, row_number() OVER (PARTITION BY park, place ORDER BY n DESC, scientific_name NULLS FIRST) AS rn FROM (SELECT park, place, scientific_name, count(*) AS n FROM hits GROUP BY ALL))
       WHERE rn <= 5 GROUP BY 1, 2) k ON k.park = pl.park AND k.place = pl.id /* RECURSIVE_STEP */""",
        "stops", "items", "sightings", extra=_near_ctes(),
    ),
)
def place_rollup(spark, sf):
    p, members, hits = _hits(spark, sf)
    out = places.place_rollup(p, hits, members=members)
    top = F.array_join(
        F.transform("top", lambda t: F.concat_ws("=", F.coalesce(t["scientific_name"], F.lit("-")), t["n"].cast("string"))), ";"
    )
    return out.select("park", "place", "n", "species", F.coalesce(top, F.lit("")).alias("top"))


_ORDERS = {"recorded": "n DESC, name, id", "readers": "coalesce(views_pm, -1) DESC, n DESC, name, id", "az": "name, id", "longest": "coalesce(length_m, 0) DESC, n DESC, name, id"}


@query(
    "place_orders",
    o(
        " UNION ALL ".join(
            f"SELECT '{how}' AS how, park, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY park ORDER BY {order}) AS INT) AS rank FROM px) WHERE rank <= 5"
            for how, order in _ORDERS.items()
        ),
        "items", extra="px AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_size END AS views_pm, p_size % 7 AS n FROM items)",
    ),
)
def place_orders(spark, sf):
    px = tb.items(spark, sf).withColumn("views_pm", F.expr("CASE WHEN p_size % 2 = 0 THEN p_size END")).withColumn("n", F.col("p_size") % 7)
    parts = [ranking.rank_places(px, how, 5).select(F.lit(how).alias("how"), "park", "id", "rank") for how in _ORDERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "place_search",
    o(
        """SELECT park, id, name, CAST(src_rank AS INT) AS src_rank, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY park ORDER BY src_rank, name, id) AS rank FROM (
     SELECT park, id, name, 0 AS src_rank FROM stops WHERE contains(lower(name), '7') UNION ALL SELECT park, id, name, 1 FROM items WHERE named AND contains(lower(name), '7'))) WHERE rank <= 10""",
        "stops", "items",
    ),
)
def place_search(spark, sf):
    return ranking.search_places(tb.stops(spark, sf), tb.items(spark, sf), " 7 ").select("park", "id", "name", "src_rank", "rank")


_LABEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.KIND_LABELS.items()) + " ELSE replace(kind, '_', ' ') END"


@query(
    "place_vocabulary",
    o(
        f"""SELECT id, CASE WHEN kind = 'trail' THEN 'trails' WHEN kind IN ('camp', 'stay') THEN 'camping' WHEN kind IN ('trailhead', 'picnic', 'info', 'boat') THEN 'facilities' ELSE 'sites' END AS grp,
     {_LABEL} AS label FROM pl WHERE contains(lower(name), 'ring') OR contains(lower({_LABEL}), 'ring')""",
        "stops", "items", extra=PLACES,
    ),
)
def place_vocabulary(spark, sf):
    out = places.match_places(_places(spark, sf), "Ring")
    return out.select("id", labels.place_group(F.col("kind"), F.col("src")).alias("grp"), "label")


# ---- proximity -----------------------------------------------------------------------------------


def _unhex(alias: str = "") -> str:
    r, c = hexgrid.R, hexgrid.COS_STD
    q = f"((cell >> 28) & {hexgrid.FIELD - 1}) - {hexgrid.HALF}"
    rr = f"(cell & {hexgrid.FIELD - 1}) - {hexgrid.HALF}"
    e = f"{hexgrid.edge_m(9)!r}e0"
    x = f"{e} * 1.7320508075688772e0 * (({q}) + ({rr}) / 2e0)"
    y = f"{e} * 1.5e0 * ({rr})"
    return f"degrees(({x}) / {r * c!r}e0) AS lon, degrees(asin(({y}) * {c / r!r})) AS lat"


def _cells(spark, sf):
    """The published cell table: the neighbourhood questions read it twice, so it is written once."""
    return materialise(_cell_species(spark, sf), "cells")


CENTRES = f"""cen AS (SELECT DISTINCT park, cell, {_unhex()} FROM cs WHERE NOT coarsened),
 nearc AS (SELECT st.park, st.stop, c.cell FROM stops st JOIN cen c ON c.park = st.park AND {hav('c', 'st', SPHERE)} <= 2500e0)"""


@query(
    "species_near_stops",
    o(
        """SELECT park, stop, species, "count", rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY park, stop ORDER BY "count" DESC, species) AS INT) AS rank FROM (
     SELECT n.park, n.stop, species, CAST(sum("count") AS BIGINT) AS "count" FROM nearc n JOIN cs ON cs.park = n.park AND cs.cell = n.cell GROUP BY ALL)) WHERE rank <= 6""",
        "sightings", "stops", extra=f"{PLACED}, {CENTRES}",
    ),
)
def near_stops(spark, sf):
    out = spatial.species_near_stops(_cells(spark, sf), tb.stops(spark, sf))
    return out.select("park", "stop", "species", "count", "rank")


@query(
    "totals_near_stops",
    o(
        """SELECT park, stop, CAST(sum(k) AS BIGINT) AS total, count(*) AS cells FROM nearc JOIN (SELECT park, cell, sum("count") AS k FROM cs GROUP BY ALL) USING (park, cell) GROUP BY 1, 2""",
        "sightings", "stops", extra=f"{PLACED}, {CENTRES}",
    ),
)
def totals_near(spark, sf):
    return spatial.near_totals(_cells(spark, sf), tb.stops(spark, sf))


# Trails: each park's stops in key order, cut into pieces of five.
_LINES = """SELECT park, stop DIV 25 AS stop, transform(array_sort(collect_list(named_struct('k', stop, 'lon', lon, 'lat', lat))), x -> named_struct('lon', x.lon, 'lat', x.lat)) AS coords
 FROM st GROUP BY park, stop DIV 25"""
SEGS = """sg AS (SELECT park, stop // 25 AS line, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS by_ FROM stops WINDOW w AS (PARTITION BY park, stop // 25 ORDER BY stop))"""
_SEGD = """sqrt(pow(ax1 + t * dx, 2) + pow(ay1 + t * dy, 2))"""
SEGHIT = f"""{SEGS}, sh AS (SELECT park, line, cell, min({_SEGD}) AS d FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, -(ax1 * dx + ay1 * dy) / (dx * dx + dy * dy))) ELSE 0e0 END AS t FROM (
   SELECT *, bx1 - ax1 AS dx, by1 - ay1 AS dy FROM (SELECT c.park, line, cell, (ax - lon) * kx AS ax1, (ay - lat) * 110540e0 AS ay1, (bx - lon) * kx AS bx1, (by_ - lat) * 110540e0 AS by1
   FROM (SELECT *, 111320e0 * cos(radians(lat)) AS kx FROM cen) c JOIN sg ON sg.park = c.park AND bx IS NOT NULL))) GROUP BY ALL HAVING d <= 300)"""


def _lines(spark, sf):
    tb.stops(spark, sf).createOrReplaceTempView("st")
    return spark.sql(_LINES)


@query(
    "species_near_lines",
    o(
        """SELECT park, stop, species, "count", rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY park, stop ORDER BY "count" DESC, species) AS INT) AS rank FROM (
     SELECT n.park, n.line AS stop, species, CAST(sum("count") AS BIGINT) AS "count" FROM sh n JOIN cs ON cs.park = n.park AND cs.cell = n.cell GROUP BY ALL)) WHERE rank <= 8""",
        "sightings", "stops", extra=f"{PLACED}, {CENTRES}, {SEGHIT}",
    ),
)
def near_lines(spark, sf):
    out = spatial.species_near_lines(_cells(spark, sf), _lines(spark, sf))
    return out.select("park", "stop", "species", "count", "rank")


@query(
    "street_images",
    o(
        f"""SELECT stop, image_id, CAST(pano AS INT) AS is_pano, round(d, 6) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY d - CASE WHEN pano THEN 150e0 ELSE 0e0 END, image_id) AS rn FROM (
     SELECT s.stop, i.image_id, coalesce(is_pano, false) AS pano, {hav('i', 's')} AS d FROM stops s JOIN images i ON i.lat BETWEEN s.lat - 0.01e0 AND s.lat + 0.01e0 WHERE {hav('i', 's')} <= 300e0)) WHERE rn = 1""",
        "stops", "images",
    ),
)
def street_images(spark, sf):
    out = spatial.street_image(tb.stops(spark, sf), tb.images(spark, sf))
    return out.select("stop", "image_id", F.col("is_pano").cast("int").alias("is_pano"), F.round("dist_m", 6).alias("dist_m"))


_GRP = "CASE WHEN kind = 'feature' THEN 'features' WHEN kind = 'trailhead' THEN 'hike' WHEN kind = 'trail' THEN 'trails' WHEN kind = 'camp' THEN 'camp' WHEN kind = 'stay' THEN 'stay' ELSE 'facilities' END"


@query(
    "things_near_stops",
    o(
        f"""SELECT anchor, grp, id, rank, round(d, 6) AS dist_m FROM (SELECT *, CAST(row_number() OVER (PARTITION BY anchor, grp ORDER BY CASE WHEN grp = 'trails' THEN -length_m ELSE d END, d, id) AS INT) AS rank FROM (
     SELECT s.stop AS anchor, {_GRP.replace('kind', 'i.kind')} AS grp, i.id, i.length_m, {hav('i', 's', SPHERE)} AS d FROM stops s, items i) WHERE d <= CASE WHEN grp IN ('camp', 'stay') THEN 12000e0 ELSE 3000e0 END)
     WHERE rank <= CASE WHEN grp = 'stay' THEN 3 ELSE 6 END""",
        "stops", "items",
    ),
)
def things_near(spark, sf):
    anchors = tb.stops(spark, sf).select(F.col("stop").alias("anchor"), "lon", "lat")
    out = spatial.things_near(anchors, tb.items(spark, sf))
    return out.select("anchor", "grp", "id", "rank", F.round("dist_m", 6).alias("dist_m"))


@query(
    "nearest_stop_of_items",
    o(
        """SELECT item, stop, round(d, 6) AS dist_m FROM (SELECT i.id AS item, s.stop, sqrt(pow((s.lon - i.lon) * 111320e0 * cos(radians((i.lat + s.lat) / 2)), 2) + pow((s.lat - i.lat) * 110540e0, 2)) AS d,
     row_number() OVER (PARTITION BY i.id ORDER BY sqrt(pow((s.lon - i.lon) * 111320e0 * cos(radians((i.lat + s.lat) / 2)), 2) + pow((s.lat - i.lat) * 110540e0, 2)), s.stop) AS rn FROM items i, stops s) WHERE rn = 1""",
        "items", "stops",
    ),
)
def nearest_stop(spark, sf):
    pts = tb.items(spark, sf).select(F.col("id").alias("item"), "lon", "lat")
    return rounded(spatial.nearest(pts, tb.stops(spark, sf), "item", "stop", start_m=500.0).select("item", "stop", "dist_m"), "dist_m")


# ---- lines --------------------------------------------------------------------------------------

WAYLINES = f"""vx AS (SELECT DISTINCT l_orderkey AS line, CAST({tb.NODE} AS BIGINT) AS node, {tb.NODE_LON} AS lon, {tb.NODE_LAT} AS lat FROM lineitem),
 lg AS (SELECT *, lead(lon) OVER w AS bx, lead(lat) OVER w AS by_, row_number() OVER w AS leg FROM vx WINDOW w AS (PARTITION BY line ORDER BY node)),
 lm1 AS (SELECT line, leg, lon AS ax, lat AS ay, bx, by_, {{hav}} AS m FROM lg WHERE bx IS NOT NULL),
 cum AS (SELECT *, sum(m) OVER (PARTITION BY line ORDER BY leg ROWS UNBOUNDED PRECEDING) AS c1 FROM lm1),
 leg AS (SELECT *, c1 - m AS c0 FROM cum)""".replace(
    "{hav}",
    """2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin((radians(by_) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(by_)) * pow(sin(radians(bx - lon) / 2), 2))))""",
)


def _way_lines(spark, sf):
    return tb.ways(spark, sf).select(F.col("id").alias("line"), F.col("geometry").alias("coords"))


@query(
    "line_samples",
    o(
        """SELECT line, round(at_m, 6) AS at_m, round(ax + (bx - ax) * ((at_m - c0) / m), 6) AS lon, round(ay + (by_ - ay) * ((at_m - c0) / m), 6) AS lat FROM (
     SELECT *, unnest(range(CAST(floor(c0 / 150e0) AS BIGINT) + 1, CAST(floor(c1 / 150e0) AS BIGINT) + 1)) * 150e0 AS at_m FROM leg WHERE m > 0)
     UNION ALL SELECT line, 0e0, round(lon, 6), round(lat, 6) FROM lg WHERE leg = 1""",
        extra=WAYLINES,
    ),
)
def line_samples(spark, sf):
    return rounded(lines.sample_lines(_way_lines(spark, sf)), "at_m", "lon", "lat")


@query("line_lengths", o("SELECT line, count(*) AS legs, round(sum(m), 6) AS length_m FROM leg GROUP BY line", extra=WAYLINES))
def line_lengths(spark, sf):
    return lines.legs(_way_lines(spark, sf)).groupBy("line").agg(
        F.count("*").alias("legs"), F.round(F.sum(F.col("c1") - F.col("c0")), 6).alias("length_m")
    )


@query(
    "line_positions",
    o(
        """SELECT line, round(ax + (bx - ax) * ((200e0 - c0) / m), 6) AS lon, round(ay + (by_ - ay) * ((200e0 - c0) / m), 6) AS lat FROM leg WHERE c0 <= 200e0 AND 200e0 < c1
     UNION ALL SELECT line, round(bx, 6), round(by_, 6) FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY leg DESC) AS rn FROM leg) WHERE rn = 1 AND c1 <= 200e0""",
        extra=WAYLINES,
    ),
)
def line_positions(spark, sf):
    wl = _way_lines(spark, sf)
    wanted = wl.select("line", F.lit(200.0).alias("at_m"))
    return rounded(lines.point_at(wl, wanted).select("line", "lon", "lat"), "lon", "lat")


@query("line_headings")
def line_headings(spark, sf):
    wl = _way_lines(spark, sf)
    return lines.heading_at(wl, wl.select("line", F.lit(100.0).alias("at_m")), 60.0)


# ---- graph ---------------------------------------------------------------------------------------

def _edges(spark, sf, simplify_m=None, ways=None):
    """``ways``: those of the testbed, where a query reads them too; cutting reads them three times, so they are derived once."""
    ways = materialise(tb.ways(spark, sf), "ways") if ways is None else ways
    usable = graph.usable_ways(ways).withColumn("park", F.concat(F.lit("park"), F.col("id") % 5))
    return graph.cut_edges(usable, simplify_m=simplify_m, carry=["park"])


def _cut_once(edges):
    """The edges that a search, its tree and its paths read, written once."""
    return materialise(edges.select("edge_id", "kind", "oneway", "src", "dst", "length_m", "coords"), "edges")


@query("junctions", o("SELECT node, uses FROM (SELECT node, count(*) AS uses FROM vv GROUP BY 1) WHERE uses >= 2", extra=WAYS))
def junctions(spark, sf):
    return graph.junctions(graph.usable_ways(tb.ways(spark, sf)))


@query(
    "road_edges",
    o("SELECT id, src, dst, length_m, CAST(kind AS INT) AS kind, oneway, coalesce(name, '-') AS name FROM ed /* RECURSIVE_STEP */", extra=CUTS),
)
def road_edges(spark, sf):
    return _edges(spark, sf).select("id", "src", "dst", "length_m", "kind", "oneway", F.coalesce("name", F.lit("-")).alias("name"))


@query(
    "trail_rollup",
    o(
        """SELECT concat('park', id % 5) AS park, name, sum(length_m) AS length_m, count(*) AS pieces FROM ed WHERE kind = 1 AND name IS NOT NULL GROUP BY 1, 2 HAVING sum(length_m) >= 500 /* RECURSIVE_STEP */""",
        extra=CUTS,
    ),
)
def trail_rollup(spark, sf):
    return rollups.trail_rollup(_edges(spark, sf)).select("park", "name", "length_m", "pieces")


@query(
    "trail_pieces",
    o("SELECT concat('park', id % 5) AS park, name, count(*) AS pieces FROM ed WHERE kind = 1 AND name IS NOT NULL GROUP BY 1, 2 /* RECURSIVE_STEP */", extra=CUTS),
)
def trail_pieces(spark, sf):
    return lines.trail_pieces(_edges(spark, sf)).groupBy("park", "name").agg(F.count("*").alias("pieces"))


ADJ = f"""{CUTS}, ad AS (SELECT src, dst, b.m AS m, b.id AS id, b.part AS part, b.n AS n FROM (SELECT src, dst, min(struct_pack(m := length_m, id := id, part := part, n := n)) AS b FROM (
   SELECT src, dst, length_m, id, part, n FROM ed WHERE kind = 0 UNION ALL SELECT dst, src, length_m, id, part, n FROM ed WHERE kind = 0 AND oneway = 0) GROUP BY 1, 2))"""


@query("adjacency_drive", o("SELECT src, dst, m AS length_m FROM ad /* RECURSIVE_STEP */", extra=ADJ))
def adjacency(spark, sf):
    return graph.adjacency(_edges(spark, sf), "drive").select("src", "dst", "length_m")


@query(
    "graph_nodes",
    o(
        """SELECT node, CAST(max(road) AS INT) AS road FROM (SELECT src AS node, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS road FROM ed UNION ALL SELECT dst, CASE WHEN kind = 0 THEN 1 ELSE 0 END FROM ed) GROUP BY 1 /* RECURSIVE_STEP */""",
        extra=CUTS,
    ),
)
def graph_nodes(spark, sf):
    return graph.graph_nodes(_edges(spark, sf)).select("node", F.col("road").cast("int").alias("road"))


def _sources(spark, sf):
    """A source per supplier: the first node of the order with its number."""
    return tb.table(spark, sf, "supplier").select((F.col("s_suppkey") * 30 + 1).cast("bigint").alias("node"))


def dist_sql(sources: str, before: str = ADJ) -> str:
    """dist: the least distance and then the fewest edges from each of ``sources`` (node) to all nodes, by one table of labels."""
    return f"""{before}, dist(source, node, dist, hops) USING KEY (source, node) AS (SELECT node, node, 0e0, 0 FROM ({sources})
   UNION SELECT c.source, c.node, c.d.dist, c.d.hops FROM (SELECT r.source, ad.dst AS node, min(struct_pack(dist := r.dist + ad.m, hops := r.hops + 1)) AS d FROM dist r JOIN ad ON ad.src = r.node GROUP BY ALL) c
    LEFT JOIN recurring.dist k ON k.source = c.source AND k.node = c.node WHERE k.dist IS NULL OR c.d.dist < k.dist OR (c.d.dist = k.dist AND c.d.hops < k.hops))"""


DIST = dist_sql("SELECT DISTINCT CAST(s_suppkey * 30 + 1 AS BIGINT) AS node FROM supplier")


@query(
    "shortest_distances",
    o("SELECT source, node, dist, CAST(hops AS BIGINT) AS hops FROM dist /* RECURSIVE_STEP */", extra=DIST),
)
def shortest(spark, sf):
    return graph.shortest_distances(_sources(spark, sf), _edges(spark, sf), "drive").select("source", "node", "dist", "hops")


# The step before the last of a best path: the smallest node that leads there, by the one edge between the two.
TREE = f"""{DIST}, tree AS (SELECT source, node, hops, b.prev AS prev, b.id AS id, b.part AS part, b.n AS n FROM (
   SELECT v.source, v.node, v.hops, min(struct_pack(prev := ad.src, id := ad.id, part := ad.part, n := ad.n)) AS b FROM dist v JOIN ad ON ad.dst = v.node
   JOIN dist u ON u.source = v.source AND u.node = ad.src AND u.dist + ad.m = v.dist AND u.hops + 1 = v.hops GROUP BY ALL)),
 far AS (SELECT source, max(struct_pack(d := dist, node := node)).node AS target FROM dist GROUP BY source),
 walk AS (SELECT source, target, target AS node FROM far UNION ALL SELECT w.source, w.target, t.prev FROM walk w JOIN tree t ON t.source = w.source AND t.node = w.node)"""


@query(
    "shortest_paths",
    o(
        "SELECT source, target, CAST(hops - 1 AS INTEGER) AS pos, id AS way, CAST(part AS INTEGER) AS part, CAST(n - CASE WHEN hops > 1 THEN 1 ELSE 0 END AS INTEGER) AS n FROM walk JOIN tree USING (source, node) /* RECURSIVE_STEP */",
        extra=TREE,
    ),
)
def paths(spark, sf):
    """The path to the farthest node of every source."""
    edges = _cut_once(_edges(spark, sf))
    dist = graph.shortest_distances(_sources(spark, sf), edges, "drive")
    far = dist.groupBy("source").agg(F.max_by("node", F.struct("dist", "node")).alias("target"))
    walked = graph.trace_paths(dist, far, edges)
    return walked.select("source", "target", "pos", F.col("edge_id.id").alias("way"), F.col("edge_id.part").alias("part"), F.size("coords").alias("n"))


_PLANAR = "sqrt(pow((n.lon - s.lon) * 111320e0 * cos(radians((s.lat + n.lat) / 2)), 2) + pow((n.lat - s.lat) * 110540e0, 2))"
SNAPPED = f"""{ADJ}, site AS (SELECT id // 4 AS trip, id AS site, min_by(lon, node) AS lon, min_by(lat, node) AS lat, id % 4 = 0 AS is_start FROM vt JOIN orders ON o_orderkey = id GROUP BY id),
 pl AS (SELECT DISTINCT node, lon, lat FROM vv WHERE node IN (SELECT src FROM ed WHERE kind = 0 UNION SELECT dst FROM ed WHERE kind = 0)),
 spot AS (SELECT lon, lat, min(node) AS node FROM pl GROUP BY ALL),
 near AS (SELECT s.lon, s.lat, min(struct_pack(d := {_PLANAR}, node := n.node)).node AS node FROM (SELECT DISTINCT lon, lat FROM site) s, spot n WHERE abs(n.lat - s.lat) < 0.05 AND abs(n.lon - s.lon) < 0.05 GROUP BY ALL),
 st AS (SELECT site.*, node FROM site JOIN near USING (lon, lat))"""


@query(
    "trip_distances",
    o(
        """SELECT a.trip, a.site AS from_site, b.site AS to_site, dist AS distance_m, dist / 15.6e0 + 300 AS seconds FROM live a JOIN live b USING (trip) JOIN dist ON dist.source = a.node AND dist.node = b.node WHERE a.site <> b.site /* RECURSIVE_STEP */""",
        extra=dist_sql("SELECT DISTINCT node FROM st", SNAPPED)
        + ", live AS (SELECT * FROM st WHERE (trip, node) IN (SELECT s.trip, d.node FROM st s JOIN dist d ON d.source = s.node WHERE s.is_start))",
    ),
)
def trips(spark, sf):
    ways = materialise(tb.ways(spark, sf), "ways")
    first, last = (F.get("coords", at) for at in (F.lit(0), F.size("coords") - 1))
    edges = _cut_once(_edges(spark, sf, ways=ways).filter("kind = 0").withColumn("coords", F.array(first, last)))
    v = F.get("geometry", F.lit(0))
    sites = ways.select(
        F.expr("id div 4").alias("trip"), F.col("id").alias("site"), v["lon"].alias("lon"), v["lat"].alias("lat"), (F.col("id") % 4 == 0).alias("is_start")
    )
    return graph.distance_matrix(sites, graph.graph_nodes(edges), edges, "drive")


@query(
    "length_by_class",
    o(
        """SELECT coalesce(cls, 'total') AS cls, round_even(sum(m) / 1000, 2) AS km, count(DISTINCT id) AS n_ways FROM (SELECT id, CASE o_custkey % 6 WHEN 2 THEN 'trail' WHEN 3 THEN 'trail' ELSE 'road' END AS cls,
     CASE WHEN p_lon IS NULL THEN 0 ELSE (CASE WHEN lon BETWEEN -110.48e0 AND -110.35e0 AND lat BETWEEN 44.52e0 AND 44.7e0 THEN 1 ELSE 0 END + CASE WHEN p_lon BETWEEN -110.48e0 AND -110.35e0 AND p_lat BETWEEN 44.52e0 AND 44.7e0 THEN 1 ELSE 0 END)
      * 2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin((radians(lat) - radians(p_lat)) / 2), 2) + cos(radians(p_lat)) * cos(radians(lat)) * pow(sin(radians(lon - p_lon) / 2), 2)))) / 2 END AS m
     FROM (SELECT l.*, lag(lon) OVER w AS p_lon, lag(lat) OVER w AS p_lat FROM (SELECT DISTINCT l_orderkey AS id, """
        + f"CAST({tb.NODE} AS BIGINT) AS node, {tb.NODE_LON} AS lon, {tb.NODE_LAT} AS lat"
        + """ FROM lineitem) l WINDOW w AS (PARTITION BY id ORDER BY node)) JOIN orders ON o_orderkey = id) GROUP BY ROLLUP (cls)""",
    ),
)
def length_by_class(spark, sf):
    w = tb.ways(spark, sf).select(F.try_element_at("tags", F.lit("highway")).alias("highway"), F.col("geometry").alias("coords"))
    return graph.length_by_class(w, (-110.48, 44.52, -110.35, 44.7))


# ---- tiles ------------------------------------------------------------------------------------------


@query(
    "box_tiles",
    """SELECT concat('park', r_regionkey) AS key, r AS row, c AS col, round(lo, 9) AS min_lon, round(la, 9) AS min_lat, round(least(lo + 0.05e0, -110.5e0 + w), 9) AS max_lon, round(least(la + 0.05e0, 44.5e0 + h), 9) AS max_lat FROM (
     SELECT *, -110.5e0 + c * 0.05e0 AS lo, 44.5e0 + r * 0.05e0 AS la FROM (SELECT *, unnest(range(0, CAST(ceil(w / 0.05e0 - 1e-9) AS BIGINT))) AS c FROM (SELECT *, unnest(range(0, CAST(ceil(h / 0.05e0 - 1e-9) AS BIGINT))) AS r FROM (
       SELECT r_regionkey, 0.32e0 + r_regionkey * 0.04e0 AS w, 0.11e0 + r_regionkey * 0.03e0 AS h FROM region))))""",
)
def box_tiles(spark, sf):
    tb.register(spark, sf, "region")
    boxes = spark.sql(
        """SELECT concat('park', r_regionkey) AS key, -110.5e0 AS min_lon, 44.5e0 AS min_lat, -110.5e0 + (0.32e0 + r_regionkey * 0.04e0) AS max_lon, 44.5e0 + (0.11e0 + r_regionkey * 0.03e0) AS max_lat FROM region"""
    )
    t = tiling.tile_boxes(boxes)
    return t.select("key", "row", "col", *[F.round(F.col(f"tile.{c}"), 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


def _tile_levels(cap: int, deepest: int, unit: str) -> str:
    lv = ", ".join(f"({d}, {2 ** (deepest - d)})" for d in range(deepest + 1))
    return f"""pc AS (SELECT lvl, floor(ix / sc) AS tx, floor(iy / sc) AS ty, count(*) AS n FROM (SELECT floor((lon + 110.6e0) / {unit}) AS ix, floor((lat - 44.4e0) / {unit}) AS iy FROM images WHERE lon IS NOT NULL),
   (VALUES {lv}) AS v(lvl, sc) GROUP BY ALL),
 vis AS (SELECT lvl, tx, ty FROM pc WHERE lvl = 0 UNION ALL SELECT lvl + 1, tx * 2 + dx, ty * 2 + dy FROM pc, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dx, dy) WHERE n >= {cap} AND lvl < {deepest})"""


@query(
    "adaptive_tiles",
    o(
        """SELECT CAST(lvl AS INT) AS level, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 40 AND lvl < 5 THEN 'split' WHEN coalesce(n, 0) >= 40 THEN 'capped' ELSE 'done' END AS status
     FROM vis LEFT JOIN pc USING (lvl, tx, ty)""",
        "images", extra=_tile_levels(40, 5, repr(0.05 / 32) + "e0"),
    ),
)
def adaptive_tiles(spark, sf):
    out = tiling.adaptive_tiles(tb.images(spark, sf), (-110.6, 44.4), cap=40)
    return out.select("level", "tx", "ty", "n", "status")


# ---- climate, gauges, boxes -----------------------------------------------------------------------


@query(
    "climate_normals",
    """SELECT station, CAST(month AS INT) AS month, round_even(avg(CASE WHEN hi IS NOT NULL AND lo IS NOT NULL THEN hi END), 1) AS tmax, round_even(avg(CASE WHEN hi IS NOT NULL AND lo IS NOT NULL THEN lo END), 1) AS tmin,
     round_even(sum(coalesce(p, 0)) / count(DISTINCT y), 0) AS precip_mm, round_even(CAST(sum(CASE WHEN coalesce(p, 0) >= 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(DISTINCT y), 0) AS wet_days FROM (
     SELECT o_custkey % 5 AS station, month(o_orderdate) AS month, year(o_orderdate) AS y, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey % 400) / 8e0 END AS hi,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 300) / 8e0 - 10 END AS lo, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 64) / 16e0 END AS p FROM orders) GROUP BY 1, 2""",
)
def climate(spark, sf):
    tb.register(spark, sf, "orders")
    days = spark.sql(
        """SELECT o_custkey % 5 AS station, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey % 400) / 8e0 END AS tmax,
     CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 300) / 8e0 - 10 END AS tmin, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 64) / 16e0 END AS precip,
     CAST(NULL AS DOUBLE) AS snow FROM orders"""
    )
    return rollups.climate_normals(days, ["station"]).select("station", "month", "tmax", "tmin", "precip_mm", "wet_days")


@query(
    "climate_anchor",
    o(
        """SELECT p.park, round(CASE WHEN n > 0 THEN lon ELSE -110.3e0 END, 6) AS lon, CASE WHEN n > 0 THEN s.name ELSE 'park centre' END AS at FROM parks p LEFT JOIN
     (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park ORDER BY n DESC, name) AS rn FROM (SELECT *, CASE WHEN park = 'park3' THEN 0 ELSE stop % 17 END AS n FROM stops)) WHERE rn = 1) s USING (park)""",
        "parks", "stops",
    ),
)
def climate_anchor(spark, sf):
    p = tb.parks(spark, sf).select("park", F.lit(-110.5).alias("min_lon"), F.lit(44.5).alias("min_lat"), F.lit(-110.1).alias("max_lon"), F.lit(44.9).alias("max_lat"))
    s = tb.stops(spark, sf).withColumn("n", F.when(F.col("park") == "park3", 0).otherwise(F.col("stop") % 17))
    return rounded(rollups.climate_anchor(p, s).select("park", "lon", "at"), "lon")


@query(
    "gauges_latest",
    """SELECT site, coalesce(flow_cfs, -1) AS flow_cfs, coalesce(temp_c, -1) AS temp_c FROM (SELECT user_id AS site, max(CASE WHEN code = '00060' AND rn = 1 AND v > -999 THEN v END) AS flow_cfs,
     max(CASE WHEN code = '00010' AND rn = 1 AND v > -999 THEN v END) AS temp_c FROM (SELECT *, row_number() OVER (PARTITION BY user_id, code ORDER BY ts DESC, event_id DESC) AS rn FROM (
       SELECT *, CASE event_type WHEN 'click' THEN '00060' WHEN 'view' THEN '00010' ELSE 'x' END AS code, CASE WHEN event_id % 3 = 0 THEN -999e0 ELSE value END AS v FROM events)) GROUP BY 1) WHERE flow_cfs IS NOT NULL OR temp_c IS NOT NULL""",
)
def gauges(spark, sf):
    return rollups.latest_gauges(_readings(spark, sf)).select(
        "site", F.coalesce("flow_cfs", F.lit(-1.0)).alias("flow_cfs"), F.coalesce("temp_c", F.lit(-1.0)).alias("temp_c")
    )


def _readings(spark, sf):
    e = tb.table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("site"), "ts", F.col("event_id").alias("reading_id"),
        F.expr("CASE event_type WHEN 'click' THEN '00060' WHEN 'view' THEN '00010' ELSE 'x' END").alias("code"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN -999e0 ELSE value END").alias("value"),
    )


@query(
    "gauges_top_flow",
    """WITH l AS (SELECT user_id AS site, event_type, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM (
     SELECT *, CASE WHEN event_id % 3 = 0 THEN -999e0 ELSE value END AS v FROM events WHERE event_type IN ('click', 'view'))) WHERE rn = 1 AND v > -999),
     g AS (SELECT site, max(CASE WHEN event_type = 'click' THEN v END) AS flow_cfs FROM l GROUP BY 1)
     SELECT park, site, flow_cfs, CAST(rank AS INT) AS rank FROM (SELECT concat('park', site % 5) AS park, site, flow_cfs,
     row_number() OVER (PARTITION BY site % 5 ORDER BY coalesce(flow_cfs, -1) DESC, site) AS rank FROM g) WHERE rank <= 3""",
)
def top_gauges(spark, sf):
    gauges = rollups.latest_gauges(_readings(spark, sf)).withColumn("park", F.concat(F.lit("park"), F.col("site") % 5))
    return ranking.top_gauges(gauges).select("park", "site", "flow_cfs", "rank")


@query(
    "quakes_recent",
    """SELECT park, n, event_id, round(mag, 6) AS mag FROM (SELECT *, count(*) OVER (PARTITION BY park) AS n, row_number() OVER (PARTITION BY park ORDER BY mag DESC, event_id) AS rn FROM (
     SELECT user_id % 5 AS park, event_id, ts, value / 60e0 AS mag FROM events) WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY AND mag >= 1.5) WHERE rn = 1""",
)
def quakes(spark, sf):
    e = tb.table(spark, sf, "events").select((F.col("user_id") % 5).alias("park"), "event_id", "ts", (F.col("value") / 60.0).alias("mag"))
    return rounded(rollups.largest_event(rollups.recent_events(e, "2024-01-30 00:00:00", 10), ["park"]).drop("ts"), "mag")


@query(
    "boxes_of_points",
    o(
        """SELECT park, round(min(lon), 6) AS min_lon, round(min(lat), 6) AS min_lat, round(max(lon), 6) AS max_lon, round(max(lat), 6) AS max_lat FROM sightings GROUP BY 1
     HAVING max(lon) - min(lon) < 8 AND max(lat) - min(lat) < 8""",
        "sightings",
    ),
)
def boxes_of_points(spark, sf):
    return rounded(rollups.box_of_points(tb.sightings(spark, sf), ["park"]), "min_lon", "min_lat", "max_lon", "max_lat")


@query(
    "readers_per_month",
    """SELECT cust, CAST(round_even(avg(o_totalprice), 0) AS BIGINT) AS views_pm FROM (SELECT o_custkey AS cust, o_totalprice FROM orders WHERE o_orderdate >= DATE '1999-03-01' AND o_orderdate < DATE '2000-03-01') GROUP BY 1""",
)
def readers(spark, sf):
    v = tb.table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("date").alias("month"), F.col("o_totalprice").alias("views"))
    return rollups.monthly_readers(v, ["cust"], "2000-03-15")
