"""Queries that write tables as files, read them back, and compare what came of it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.functions import geo
from observatory.operators import lines, quality, rollups, tiling
from observatory.plans import places as pl
from observatory.plans import testbed as tb
from observatory.plans.places import o
from observatory.plans.registry import query
from observatory.plans.sightings import PLACED, _cell_species
from observatory.session import scratch_path
from observatory.sources import readers, sinks


@query(
    "landed_ways",
    o(
        """SELECT line AS id, count(*) AS n, round(min(lon), 6) AS min_lon, round(max(lat), 6) AS max_lat, coalesce(any_value(CASE WHEN o_custkey % 4 <> 0 THEN concat('Way ', o_custkey % 50) END), '-') AS name
     FROM vx JOIN orders ON o_orderkey = line GROUP BY line""",
        extra=pl.WAYLINES,
    ),
)
def landed_ways(spark, sf):
    """Ways as documents of up to 500 elements with some points among them, read as landed files.

    Each document is a file, and all files lie in one folder, which is listed at once.
    """
    path = scratch_path(spark, "landed-ways")
    way = F.struct(F.lit("way").alias("type"), "id", "tags", "nodes", "geometry")
    point = F.struct(F.lit("node").alias("type"), "id", "tags", F.lit(None).cast("array<bigint>").alias("nodes"), F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("geometry"))
    rows = tb.ways(spark, sf).select(F.expr("id div 500").alias("doc"), F.explode(F.array(way, point)).alias("e"))
    docs = rows.groupBy("doc").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    got = readers.read_elements(spark, path, ways=True)
    lon, lat = F.array_min(F.transform("geometry", lambda p: p["lon"])), F.array_max(F.transform("geometry", lambda p: p["lat"]))
    name = F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("-"))
    return got.select("id", F.size("nodes").cast("bigint").alias("n"), F.round(lon, 6).alias("min_lon"), F.round(lat, 6).alias("max_lat"), name.alias("name"))


@query(
    "open_sightings",
    tb.oracle("SELECT park, count(*) AS n, count(DISTINCT scientific_name) AS species FROM sightings WHERE coordinate_status = 'open' AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY park", "sightings"),
)
def open_sightings(spark, sf):
    """The export of all sightings, read back with the predicates pushed to the scan."""
    path = scratch_path(spark, "export")
    tb.sightings(spark, sf).write.parquet(path)
    got = readers.read_open_sightings(spark, path)
    return got.groupBy("park").agg(F.count("*").alias("n"), F.count_distinct("scientific_name").alias("species"))


@query(
    "written_sightings",
    tb.oracle("SELECT park, count(*) AS n, 0 AS out_of_order, CAST(min(observed_on) AS VARCHAR) AS first_on FROM sightings WHERE duplicate_of IS NULL GROUP BY park", "sightings"),
)
def written_sightings(spark, sf):
    """Canonical rows written by park, and how many rows of a file come before the row ahead of them."""
    path = scratch_path(spark, "sightings")
    sinks.write_sightings(tb.sightings(spark, sf), path, rows_per_file=1000)
    rows = spark.read.parquet(path).select("park", "observed_on", "sighting_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    spot = F.struct("observed_on", "sighting_id")
    back = F.coalesce(spot < F.lag(spot).over(W.partitionBy("file").orderBy("at")), F.lit(False))
    marked = rows.withColumn("back", back.cast("int"))
    return marked.groupBy("park").agg(F.count("*").alias("n"), F.sum("back").cast("int").alias("out_of_order"), F.min("observed_on").cast("string").alias("first_on"))


@query(
    "park_tree",
    tb.oracle(
        """SELECT park, 'source' AS facet, source AS value, count(*) AS n FROM sightings GROUP BY ALL UNION ALL SELECT park, 'status', coordinate_status, count(*) FROM sightings GROUP BY ALL""", "sightings"
    ),
)
def park_tree(spark, sf):
    """A document per park in the park's folder, read as a tree; the folder names the park."""
    path = scratch_path(spark, "parks")
    summary = rollups.park_summary(tb.sightings(spark, sf)).filter("facet in ('source', 'status')")
    docs = summary.groupBy("park").agg(F.collect_list(F.struct("facet", "value", "n")).alias("facets"))
    sinks.write_documents(sinks.row_documents(docs), path)
    schema = spark.createDataFrame([], "facets array<struct<facet:string,value:string,n:bigint>>").schema
    got = readers.read_park_tree(spark, path, "*.txt", schema)
    return got.select(F.substring_index("park", "=", -1).alias("park"), F.explode("facets").alias("f")).select("park", "f.*")


@query(
    "tile_quarters",
    """SELECT key, CAST(q AS INT) AS quarter, count(*) AS n, round(sum((x1 - x0) * (y1 - y0)), 9) AS area, round(min(x0), 9) AS min_lon, round(max(y1), 9) AS max_lat FROM (
     SELECT key, q, CASE WHEN q % 2 = 0 THEN lo ELSE (lo + hi) / 2 END AS x0, CASE WHEN q % 2 = 0 THEN (lo + hi) / 2 ELSE hi END AS x1, CASE WHEN q < 2 THEN la ELSE (la + lb) / 2 END AS y0, CASE WHEN q < 2 THEN (la + lb) / 2 ELSE lb END AS y1 FROM (
      SELECT key, lo, la, least(lo + 0.05e0, -110.5e0 + w) AS hi, least(la + 0.05e0, 44.5e0 + h) AS lb FROM (SELECT *, -110.5e0 + c * 0.05e0 AS lo, 44.5e0 + r * 0.05e0 AS la FROM (
       SELECT *, unnest(range(0, CAST(ceil(w / 0.05e0 - 1e-9) AS BIGINT))) AS c FROM (SELECT *, unnest(range(0, CAST(ceil(h / 0.05e0 - 1e-9) AS BIGINT))) AS r FROM (
        SELECT concat('nation', n_nationkey) AS key, 0.32e0 + n_regionkey * 0.04e0 AS w, 0.11e0 + n_nationkey * 0.01e0 AS h FROM nation))))) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS q)) GROUP BY ALL""",
)
def tile_quarters(spark, sf):
    """The tiles of a box per nation, each in its four quarters."""
    tb.register(spark, sf, "nation")
    boxes = spark.sql(
        """SELECT concat('nation', n_nationkey) AS key, -110.5e0 AS min_lon, 44.5e0 AS min_lat, -110.5e0 + (0.32e0 + n_regionkey * 0.04e0) AS max_lon, 44.5e0 + (0.11e0 + n_nationkey * 0.01e0) AS max_lat FROM nation"""
    )
    q = tiling.quarter(tiling.tile_boxes(boxes)).select("key", "quarter", "tile.*")
    area = F.sum((F.col("max_lon") - F.col("min_lon")) * (F.col("max_lat") - F.col("min_lat")))
    out = q.groupBy("key", "quarter").agg(F.count("*").alias("n"), area.alias("area"), F.min("min_lon").alias("min_lon"), F.max("max_lat").alias("max_lat"))
    return out.select("key", "quarter", "n", *[F.round(c, 9).alias(c) for c in ("area", "min_lon", "max_lat")])


@query("rounded_lines", o("SELECT line, round_even(lon, 2) AS lon, round_even(lat, 2) AS lat, count(*) AS n FROM vx GROUP BY ALL", extra=pl.WAYLINES))
def rounded_lines(spark, sf):
    """Vertices per rounded position."""
    pts = pl._way_lines(spark, sf).select("line", F.explode(geo.round_ring(F.col("coords"), 2)).alias("p"))
    return pts.groupBy("line", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")).agg(F.count("*").alias("n"))


@query(
    "filters_conserve",
    tb.oracle(
        """SELECT 'export' AS stage, 'mapped' AS rule, count(*) AS n_in, count(*) FILTER (lon IS NOT NULL) AS n_out, count(*) FILTER (lon IS NULL) AS n_dropped FROM sightings
     UNION ALL SELECT 'export', 'open', count(*), count(*) FILTER (coordinate_status = 'open'), count(*) FILTER (coordinate_status <> 'open') FROM sightings WHERE lon IS NOT NULL""",
        "sightings",
    ),
)
def filters_conserve(spark, sf):
    """Two filters counted as their rows pass, checked to lose nothing unseen, and logged."""
    path, log = scratch_path(spark, "filtered"), scratch_path(spark, "ledger")
    all_rows, seen = quality.observed_count(tb.sightings(spark, sf), "seen")
    mapped, kept = quality.observed_count(all_rows.filter("lon is not null"), "mapped", n_open=F.count_if(F.col("coordinate_status") == "open"), n_shut=F.count_if(F.col("coordinate_status") != "open"))
    mapped.select("sighting_id").write.parquet(path)
    n_in, n_mapped, n_open, n_shut = seen.get["n"], kept.get["n"], kept.get["n_open"], kept.get["n_shut"]
    quality.check_conservation(n_mapped, n_open, n_shut, "open")
    quality.append_ledger(spark, log, "export", "mapped", n_in, n_mapped)
    quality.append_ledger(spark, log, "export", "open", n_mapped, n_open)
    return quality.ledger_summary(spark, log)


@query(
    "pinned_sample",
    tb.oracle("SELECT sighting_id, park, '{\"n\": 40, \"seed\": 7}' AS parameters FROM (SELECT *, row_number() OVER (ORDER BY md5(concat(sighting_id, ':7'))) AS rn FROM sightings) WHERE rn <= 40", "sightings"),
)
def pinned_sample(spark, sf):
    """The 40 lowest of a seeded order, pinned with what drew them and read back."""
    path = scratch_path(spark, "pinned")
    drawn = tb.sightings(spark, sf).withColumn("o", F.md5(F.concat("sighting_id", F.lit(":7")))).orderBy("o").limit(40)
    quality.record_sample(drawn, path, ["sighting_id", "park"], n=40, seed=7)
    return spark.read.schema("sighting_id string, park string, parameters string").json(path)


@query(
    "cell_feature_documents",
    tb.oracle(
        """SELECT park, cell, res, CAST(sum("count") AS BIGINT) AS n, CAST(sum(hv) AS BIGINT) AS hv, CAST(sum(mp) AS BIGINT) AS mp, CAST(min(y0) AS INT) AS y0, CAST(max(y1) AS INT) AS y1, count(*) AS species, 7 AS corners, 'Polygon' AS shape
     FROM cs GROUP BY park, cell, res""",
        "sightings",
        extra=PLACED,
    ),
)
def cell_documents(spark, sf):
    """One feature text per cell, written per park, read back and parsed."""
    path = scratch_path(spark, "cell-features")
    sinks.write_documents(sinks.cell_features(rollups.cell_totals(_cell_species(spark, sf))), path)
    schema = (
        "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, "
        "properties struct<cell:bigint,res:int,coarsened:boolean,count:bigint,hv:bigint,mp:bigint,y0:int,y1:int,sp:array<struct<species:string,count:bigint>>>"
    )
    f = spark.read.schema("value string, park string").text(path).select("park", F.from_json("value", schema).alias("f"))
    p = "f.properties."
    return f.select(
        "park", F.col(p + "cell").alias("cell"), F.col(p + "res").alias("res"), F.col(p + "count").alias("n"), F.col(p + "hv").alias("hv"), F.col(p + "mp").alias("mp"),
        F.col(p + "y0").alias("y0"), F.col(p + "y1").alias("y1"), F.size(p + "sp").cast("bigint").alias("species"),
        F.size(F.get("f.geometry.coordinates", F.lit(0))).alias("corners"), F.col("f.geometry.type").alias("shape"),
    )


# Spans between kept vertices, each split at its farthest vertex until none is off by more than five metres.
_OFF = """sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2))"""
_SPANS = f"""pv AS (SELECT line, leg AS k, lon * 111320e0 * cos(radians(first_value(lat) OVER w)) AS x, lat * 110540e0 AS y FROM lg WINDOW w AS (PARTITION BY line ORDER BY leg)),
 sp AS (SELECT line, CAST(1 AS BIGINT) AS i, max(k) AS j, false AS cut FROM pv GROUP BY line
   UNION ALL SELECT line, unnest([i, m]) AS i, unnest([m, j]) AS j, true FROM (SELECT line, i, j, arg_max(k, struct_pack(off := off, neg := -k)) AS m, max(off) AS far FROM (
     SELECT line, i, j, k, {_OFF} AS off FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS t FROM (
      SELECT s.line, s.i, s.j, v.k, v.x - a.x AS px, v.y - a.y AS py, b.x - a.x AS dx, b.y - a.y AS dy FROM sp s JOIN pv a ON a.line = s.line AND a.k = s.i JOIN pv b ON b.line = s.line AND b.k = s.j
      JOIN pv v ON v.line = s.line AND v.k > s.i AND v.k < s.j))) GROUP BY line, i, j) WHERE far > 5)"""


@query(
    "lines_simplified",
    o(
        """SELECT line, CAST(count(*) AS INT) AS before, CAST(count(*) FILTER (k = 1 OR k = n OR (line, k) IN (SELECT (line, i) FROM sp WHERE cut)) AS INT) AS after
     FROM (SELECT line, k, max(k) OVER (PARTITION BY line) AS n FROM pv) GROUP BY line /* RECURSIVE_STEP */""",
        extra=pl.WAYLINES + ", " + _SPANS,
    ),
)
def lines_simplified(spark, sf):
    return pl._way_lines(spark, sf).select("line", F.size("coords").alias("before"), F.size(lines.simplify(F.col("coords"))).alias("after"))
