"""Queries over sightings: cells, species, parks, months, rules, duplicates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from observatory.functions import hexgrid, names
from observatory.operators import dedupe, ranking, rollups, suppress
from observatory.plans import testbed as tb
from observatory.plans.registry import query
from observatory.sources import rules as ruletables

SYN = ruletables.DEFAULT_SYNONYMS

# ---- shared SQL ---------------------------------------------------------------

# The canonical name and the rule of a name, as plain CASE text.
CANON = """CASE WHEN NAME IN ('Bos bison') THEN 'Bison bison' WHEN NAME = 'Bison bison bison' THEN 'Bison bison'
 WHEN NAME = 'Cervus elaphus' THEN 'Cervus canadensis' WHEN NAME LIKE 'Ursus arctos %' THEN 'Ursus arctos' ELSE NAME END"""


def canon(col: str = "scientific_name") -> str:
    return CANON.replace("NAME", col)


def hex_sql(src: str, lon: str = "lon", lat: str = "lat", res: str = "res") -> str:
    """Cell ids of the rows of ``src`` as nested selects."""
    r, c = hexgrid.R, hexgrid.COS_STD
    edge = f"CASE {res} " + " ".join(f"WHEN {i} THEN {hexgrid.edge_m(i)!r}e0" for i in (6, 7, 8, 9)) + " END"
    return f"""(SELECT * EXCLUDE (x_, y_, e_, qf, rf, q0, r0, s0, q1, r1),
      CAST((CAST({res} AS BIGINT) * 268435456 + CAST(q1 AS BIGINT) + 134217728) * 268435456 + CAST(r1 AS BIGINT) + 134217728 AS BIGINT) AS cell
     FROM (SELECT *, CASE WHEN abs(q0 - qf) > abs(r0 - rf) AND abs(q0 - qf) > abs(s0 - (-qf - rf)) THEN -r0 - s0 ELSE q0 END AS q1,
       CASE WHEN NOT (abs(q0 - qf) > abs(r0 - rf) AND abs(q0 - qf) > abs(s0 - (-qf - rf))) AND abs(r0 - rf) > abs(s0 - (-qf - rf))
         THEN -q0 - s0 ELSE r0 END AS r1
      FROM (SELECT *, floor(qf + 0.5e0) AS q0, floor(rf + 0.5e0) AS r0, floor((-qf - rf) + 0.5e0) AS s0
       FROM (SELECT *, ({math.sqrt(3.0) / 3.0!r}e0 * x_ - y_ / 3.0e0) / e_ AS qf, ({2.0 / 3.0!r}e0 * y_) / e_ AS rf
        FROM (SELECT *, {r * c!r}e0 * radians({lon}) AS x_, {r / c!r}e0 * sin(radians({lat})) AS y_, {edge} AS e_ FROM {src}) h1) h2) h3) h4)"""


AUTO = """auto AS (SELECT park, scientific_name FROM sightings WHERE source = 'inaturalist' AND scientific_name IS NOT NULL
 GROUP BY ALL HAVING avg(CASE WHEN json_extract_string(raw_json, '$.taxon_geoprivacy') IN ('obscured', 'private') THEN 1e0 ELSE 0e0 END) >= 0.5)"""
RULES = """rules AS (SELECT * FROM (VALUES (0, 'Canis lupus', 'exclude', NULL), (1, 'Gulo gulo', 'exclude', NULL),
 (2, 'Lynx canadensis', 'exclude', NULL), (3, 'Ursus arctos', 'coarsen', 6), (4, 'Puma concolor', 'coarsen', 6),
 (5, 'Haliaeetus leucocephalus', 'coarsen', 6)) AS v(ord, rule_name, action, rule_res))"""
NAME_RULES = f"""{AUTO}, {RULES},
listed AS (SELECT park, name, arg_min(action, ord) AS action FROM (
   SELECT park, scientific_name AS name FROM sightings UNION SELECT park, {canon()} FROM sightings) n
   JOIN rules ON name = rule_name OR starts_with(name, rule_name || ' ') GROUP BY ALL),
ruled AS (SELECT park, name, action FROM listed UNION ALL
   SELECT park, scientific_name, 'coarsen' FROM auto a WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.park = a.park AND l.name = a.scientific_name))"""
PLACED = f"""{NAME_RULES},
mapped AS (SELECT s.*, {canon('s.scientific_name')} AS species, coalesce(c.action, r.action) AS action FROM sightings s
   LEFT JOIN ruled c ON c.park = s.park AND c.name = {canon('s.scientific_name')}
   LEFT JOIN ruled r ON r.park = s.park AND r.name = s.scientific_name
   WHERE duplicate_of IS NULL AND coordinate_status = 'open' AND lon IS NOT NULL AND scientific_name IS NOT NULL),
placed AS (SELECT *, CASE WHEN action = 'coarsen' THEN 6 ELSE 9 END AS res FROM mapped WHERE action IS NULL OR action <> 'exclude'),
cs AS (SELECT park, cell, res, species, count(*) AS "count", count(*) FILTER (confidence_basis = 'human_verified') AS hv,
   count(*) FILTER (confidence_basis <> 'human_verified') AS mp, min(year(observed_on)) AS y0, max(year(observed_on)) AS y1,
   min(taxon_class) AS taxon_class, res <> 9 AS coarsened
   FROM {hex_sql('placed')} GROUP BY park, cell, res, species)"""
VOTES = f"""votes AS (SELECT park, {canon()} AS species, CASE WHEN source = 'inaturalist' THEN 0 ELSE 1 END AS tier, common_name, count(*) AS n
   FROM sightings WHERE duplicate_of IS NULL AND scientific_name IS NOT NULL AND common_name <> '' GROUP BY ALL),
picked AS (SELECT park, species, common_name FROM (SELECT *, row_number() OVER (PARTITION BY park, species ORDER BY tier, n DESC, common_name DESC) AS rn
   FROM votes) WHERE rn = 1)"""
MONTHS = ", ".join(f"count(*) FILTER (month(observed_on) = {m}) AS m{m}" for m in range(1, 13))
SPECIES = f"""{VOTES},
srows AS (SELECT *, {canon()} AS species FROM sightings WHERE duplicate_of IS NULL AND scientific_name IS NOT NULL
   AND (taxon_rank IN ('species', 'subspecies') OR source = 'mapillary_cv')),
sp AS (SELECT park, species, min(taxon_class) AS taxon_class, count(*) AS sightings,
   count(*) FILTER (coordinate_status = 'open') AS open_coordinates, count(*) FILTER (coordinate_status = 'obscured') AS obscured_coordinates,
   count(*) FILTER (source = 'inaturalist') AS n_inaturalist, count(*) FILTER (source = 'gbif') AS n_gbif,
   count(*) FILTER (source = 'mapillary_cv') AS n_mapillary_cv,
   count(*) FILTER (confidence_basis = 'human_verified') AS human_verified,
   count(*) FILTER (confidence_basis = 'model_predicted') AS model_predicted,
   min(observed_on) AS first_on, max(observed_on) AS last_on, {MONTHS},
   max(CASE WHEN source = 'inaturalist' AND scientific_name = species THEN taxon_id END) AS taxon_id,
   coalesce(string_agg(DISTINCT CASE WHEN scientific_name <> species THEN scientific_name END, '|'
     ORDER BY CASE WHEN scientific_name <> species THEN scientific_name END), '') AS aliases
   FROM srows GROUP BY park, species)"""
MSUM = " + ".join(f"m{m}" for m in range(1, 13))
EFFORT = "effort AS (SELECT park, " + ", ".join(f"sum(m{m}) AS e{m}" for m in range(1, 13)) + " FROM sp GROUP BY park)"
ESUM = " + ".join(f"e{m}" for m in range(1, 13))


def _cell_species(spark, sf):
    return rollups.cell_species(tb.sightings(spark, sf), ruletables.suppression_rules(spark), SYN)


def _species(spark, sf):
    return rollups.species_rollup(tb.sightings(spark, sf), SYN, ruletables.suppression_rules(spark))


def _species_and_cells(spark, sf):
    """Both exports from one pass for names and one for cells."""
    rows, ruled = tb.sightings(spark, sf), ruletables.suppression_rules(spark)
    facts = rollups.name_facts(rows, SYN)
    return rollups.species_rollup(rows, SYN, ruled, facts), rollups.cell_species(rows, ruled, SYN, facts=facts)


def s(sql: str) -> str:
    return tb.oracle(sql, "sightings")


# ---- cells ----------------------------------------------------------------------


@query(
    "cell_species",
    tb.oracle('SELECT park, cell, res, species, "count", hv, mp, CAST(y0 AS INT) AS y0, CAST(y1 AS INT) AS y1, coalesce(taxon_class, \'-\') AS taxon_class FROM cs', "sightings", extra=PLACED),
)
def cell_species(spark, sf):
    return _cell_species(spark, sf).select(
        "park", "cell", "res", "species", "count", "hv", "mp", "y0", "y1", F.coalesce("taxon_class", F.lit("-")).alias("taxon_class")
    )


@query(
    "cell_totals",
    tb.oracle(
        """SELECT park, cell, res, CAST(sum("count") AS BIGINT) AS "count", CAST(sum(hv) AS BIGINT) AS hv, CAST(sum(mp) AS BIGINT) AS mp,
     CAST(min(y0) AS INT) AS y0, CAST(max(y1) AS INT) AS y1, count(*) AS n_species, string_agg(species || '=' || "count", ';' ORDER BY "count" DESC, species) AS sp
     FROM cs GROUP BY park, cell, res""",
        "sightings",
        extra=PLACED,
    ),
)
def cell_totals(spark, sf):
    sp = F.array_join(F.transform("sp", lambda e: F.concat_ws("=", e["species"], e["count"].cast("string"))), ";")
    return rollups.cell_totals(_cell_species(spark, sf)).select(
        "park", "cell", "res", "count", "hv", "mp", "y0", "y1", F.size("sp").cast("bigint").alias("n_species"), sp.alias("sp")
    )


@query(
    "top_cells_per_species",
    tb.oracle(
        """SELECT park, species, cell, "count", CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY park, species ORDER BY "count" DESC, cell) AS rank FROM cs)
     WHERE rank <= 3""",
        "sightings",
        extra=PLACED,
    ),
)
def top_cells(spark, sf):
    return ranking.top_cells(_cell_species(spark, sf)).select("park", "species", "cell", "count", "rank")


@query(
    "hotspots_uncoarsened",
    tb.oracle(
        """SELECT park, species, cell, "count", CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY park, species ORDER BY "count" DESC, cell) AS rank FROM cs
     WHERE NOT coarsened) WHERE rank <= 3""",
        "sightings",
        extra=PLACED,
    ),
)
def hotspots(spark, sf):
    return ranking.hotspots(_cell_species(spark, sf)).select("park", "species", "cell", "count", "rank")


_FILTERED = """SELECT park, cell, CAST(sum("count") AS BIGINT) AS "count", CAST(sum(hv) AS BIGINT) AS hv, CAST(sum(mp) AS BIGINT) AS mp FROM cs {where}
 GROUP BY park, cell HAVING coalesce(max(y1), 2025) >= 2025 AND coalesce(min(y0), 2025) <= 2025"""


@query("cells_in_year_range", tb.oracle(_FILTERED.format(where=""), "sightings", extra=PLACED))
def cells_in_years(spark, sf):
    return ranking.filter_cells(_cell_species(spark, sf), 2025, 2025).drop("y0", "y1")


@query(
    "cells_in_year_range_species",
    tb.oracle(_FILTERED.format(where="WHERE species = 'Bison bison'"), "sightings", extra=PLACED),
)
def cells_in_years_species(spark, sf):
    return ranking.filter_cells(_cell_species(spark, sf), 2025, 2025, "Bison bison").drop("y0", "y1")


@query(
    "cell_detail",
    tb.oracle(
        """SELECT park, cell, species, "count", CAST(row_number() OVER (PARTITION BY park, cell ORDER BY CASE WHEN species = 'Bison bison' THEN 0 ELSE 1 END,
     "count" DESC, species) AS INT) AS rank FROM cs""",
        "sightings",
        extra=PLACED,
    ),
)
def cell_detail(spark, sf):
    return ranking.cell_detail(_cell_species(spark, sf), "Bison bison").select("park", "cell", "species", "count", "rank")


@query(
    "cell_ids",
    tb.oracle(
        f"""SELECT sighting_id, cell FROM {hex_sql('(SELECT *, 7 AS res FROM sightings WHERE lon IS NOT NULL)')}""",
        "sightings",
    ),
)
def cell_ids(spark, sf):
    df = tb.sightings(spark, sf).filter("lon is not null")
    return df.select("sighting_id", hexgrid.cell_of(F.col("lon"), F.col("lat"), 7).alias("cell"))


# ---- rules and names ---------------------------------------------------------------


@query(
    "auto_sensitive_species",
    s(
        """SELECT park, scientific_name, round(avg(CASE WHEN json_extract_string(raw_json, '$.taxon_geoprivacy') IN ('obscured', 'private')
     THEN 1e0 ELSE 0e0 END), 6) AS share FROM sightings WHERE source = 'inaturalist' AND scientific_name IS NOT NULL GROUP BY ALL HAVING share >= 0.5"""
    ),
)
def auto_sensitive(spark, sf):
    return suppress.auto_sensitive(tb.sightings(spark, sf)).withColumn("share", F.round("share", 6))


@query("suppression_rules", tb.oracle("SELECT park, name, action FROM ruled", "sightings", extra=NAME_RULES))
def suppression(spark, sf):
    df = tb.sightings(spark, sf)
    both = df.select("park", F.explode(F.array("scientific_name", names.canonical_species(F.col("scientific_name"), SYN))).alias("name"))
    rules = ruletables.suppression_rules(spark)
    return suppress.name_rules(both, rules, suppress.auto_sensitive(df)).select("park", "name", "action")


@query(
    "common_name_votes",
    tb.oracle(
        """SELECT p.park, p.species, p.common_name, coalesce((SELECT string_agg(DISTINCT v.common_name, '|' ORDER BY v.common_name) FROM votes v
     WHERE v.park = p.park AND v.species = p.species AND v.common_name <> p.common_name), '') AS other_names FROM picked p""",
        "sightings",
        extra=VOTES,
    ),
)
def common_names(spark, sf):
    out = rollups.pick_names(rollups.name_votes(tb.sightings(spark, sf), SYN))
    return out.select("park", "species", "common_name", F.array_join("other_names", "|").alias("other_names"))


@query(
    "canonical_names",
    """SELECT raw, CASE WHEN regexp_matches(raw, '^[A-Z]\\S* [a-z0-9#]*[a-z][a-z0-9#]*( \\S+)+$') THEN split_part(raw, ' ', 1) || ' ' || split_part(raw, ' ', 2)
     ELSE raw END AS canonical, count(*) AS n FROM (SELECT upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' || lower(p_type) AS raw FROM part
     UNION ALL SELECT p_name || ' ' || p_type FROM part UNION ALL SELECT p_type || ' ' || p_name FROM part) GROUP BY 1, 2""",
)
def canonical_names(spark, sf):
    p = tb.table(spark, sf, "part")
    first = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" "), F.lower("p_type"))
    spelled = F.array(first, F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_name"))
    raw = p.select(F.explode(spelled).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return raw.select("raw", names.canonical_species(F.col("raw")).alias("canonical"), "n")


# ---- species and parks ---------------------------------------------------------------

_M = ", ".join(f"m{m}" for m in range(1, 13))


def _months_flat(col="months"):
    return [F.get(col, F.lit(m - 1)).alias(f"m{m}") for m in range(1, 13)]


@query(
    "species_rollup",
    tb.oracle(
        f"""SELECT sp.park, sp.species, coalesce(sp.taxon_class, '-') AS taxon_class, sightings, open_coordinates, obscured_coordinates, n_inaturalist, n_gbif,
     n_mapillary_cv, human_verified, model_predicted, CAST(first_on AS VARCHAR) AS first_on, CAST(last_on AS VARCHAR) AS last_on, {_M},
     coalesce(taxon_id, '-') AS taxon_id, aliases, coalesce(common_name, '-') AS common_name, coalesce(action, '-') AS action
     FROM sp LEFT JOIN picked p ON p.park = sp.park AND p.species = sp.species LEFT JOIN ruled r ON r.park = sp.park AND r.name = sp.species""",
        "sightings",
        extra=SPECIES + ", " + NAME_RULES,
    ),
)
def species_rollup(spark, sf):
    def dash(c):
        return F.coalesce(c, F.lit("-")).alias(c)

    return _species(spark, sf).select(
        "park", "species", dash("taxon_class"), "sightings", "open_coordinates", "obscured_coordinates", "n_inaturalist", "n_gbif",
        "n_mapillary_cv", "human_verified", "model_predicted", F.col("first_on").cast("string").alias("first_on"),
        F.col("last_on").cast("string").alias("last_on"), *_months_flat(), dash("taxon_id"),
        F.array_join("aliases", "|").alias("aliases"), dash("common_name"), dash("action"),
    )


@query(
    "park_summary",
    s(
        """SELECT park, 'park' AS facet, '' AS value, count(*) AS n, count(*) FILTER (duplicate_of IS NULL) AS canonical,
     CAST(min(observed_on) AS VARCHAR) AS first_on, CAST(max(observed_on) AS VARCHAR) AS last_on FROM sightings GROUP BY park
     UNION ALL SELECT park, 'source', source, count(*), count(*) FILTER (duplicate_of IS NULL), CAST(min(observed_on) AS VARCHAR), CAST(max(observed_on) AS VARCHAR) FROM sightings GROUP BY park, source
     UNION ALL SELECT park, 'class', coalesce(taxon_class, ''), count(*), count(*) FILTER (duplicate_of IS NULL), CAST(min(observed_on) AS VARCHAR), CAST(max(observed_on) AS VARCHAR) FROM sightings GROUP BY park, taxon_class
     UNION ALL SELECT park, 'status', coordinate_status, count(*), count(*) FILTER (duplicate_of IS NULL), CAST(min(observed_on) AS VARCHAR), CAST(max(observed_on) AS VARCHAR) FROM sightings GROUP BY park, coordinate_status"""
    ),
)
def park_summary(spark, sf):
    return (
        rollups.park_summary(tb.sightings(spark, sf))
        .withColumn("first_on", F.col("first_on").cast("string"))
        .withColumn("last_on", F.col("last_on").cast("string"))
    )


@query(
    "distinct_species",
    s("SELECT park, count(DISTINCT scientific_name) AS species FROM sightings WHERE taxon_rank IN ('species', 'subspecies') GROUP BY park"),
)
def distinct_species(spark, sf):
    return rollups.distinct_species(tb.sightings(spark, sf))


_SUMMER = "round(CAST(count(*) FILTER (month({c}) BETWEEN 6 AND 8) AS DOUBLE) / count(*), 6)"
_EMPTY = "concat_ws(',', " + ", ".join(f"CASE WHEN count(*) FILTER (month({{c}}) = {m}) = 0 THEN '{m}' END" for m in range(1, 13)) + ")"
_MC = ", ".join(f"count(*) FILTER (month({{c}}) = {m}) AS m{m}" for m in range(1, 13))


def _profile_sql(key: str, col: str, src: str, where: str) -> str:
    return f"SELECT {key}, {_MC.format(c=col)}, {_SUMMER.format(c=col)} AS summer_share, {_EMPTY.format(c=col)} AS empty_months FROM {src} WHERE {where} GROUP BY {key}"


def _profile(df, key, col):
    out = rollups.month_profile(df, [key], col)
    return out.select(
        key, *_months_flat(), F.round("summer_share", 6).alias("summer_share"),
        F.array_join(F.col("empty_months").cast("array<string>"), ",").alias("empty_months"),
    )


@query("seasonal_sightings", s(_profile_sql("park", "observed_on", "sightings", "duplicate_of IS NULL AND observed_on IS NOT NULL")))
def seasonal_sightings(spark, sf):
    return _profile(rollups.canonical(tb.sightings(spark, sf)), "park", "observed_on")


@query("seasonal_imagery", tb.oracle(_profile_sql("corridor", "captured_at", "images", "captured_at IS NOT NULL"), "images"))
def seasonal_imagery(spark, sf):
    return _profile(tb.images(spark, sf), "corridor", "captured_at")


def _rel(m: int) -> str:
    return f"CASE WHEN ({MSUM}) >= 30 AND e{m} > 0 THEN (m{m} / CAST(({MSUM}) AS DOUBLE)) / (e{m} / CAST(({ESUM}) AS DOUBLE)) ELSE 0e0 END"


REL = f"rel AS (SELECT sp.*, {', '.join(f'{_rel(m)} AS r{m}' for m in range(1, 13))} FROM sp JOIN effort USING (park))"
_GREATEST = "greatest(" + ", ".join(f"r{m}" for m in range(1, 13)) + ")"


@query(
    "relative_months",
    tb.oracle(
        f"""SELECT park, species, {", ".join(f"round(r{m}, 6) AS r{m}" for m in range(1, 13))}, round({_GREATEST}, 6) AS rel_max,
     CAST(CASE WHEN {_GREATEST} > 0 THEN list_position([{", ".join(f"r{m}" for m in range(1, 13))}], {_GREATEST}) ELSE 0 END AS BIGINT) AS rel_peak FROM rel""",
        "sightings",
        extra=f"{SPECIES}, {EFFORT}, {REL}",
    ),
)
def relative_months(spark, sf):
    rel = rollups.relative_months(_species(spark, sf))
    return rel.select(
        "park", "species", *[F.round(F.get("rel", F.lit(m - 1)), 6).alias(f"r{m}") for m in range(1, 13)],
        F.round("rel_max", 6).alias("rel_max"), F.coalesce("rel_peak", F.lit(0)).cast("bigint").alias("rel_peak"),
    )


_LONG = " UNION ALL ".join(f"SELECT park, species, {m} AS month, m{m} AS n, r{m} AS ratio, ({MSUM}) AS total FROM rel" for m in range(1, 13))


@query(
    "seen_more_than_usual",
    tb.oracle(
        f"""SELECT park, CAST(month AS INT) AS month, species, n, round(ratio, 6) AS ratio, CAST(rank AS INT) AS rank FROM (SELECT l.*, row_number() OVER
     (PARTITION BY l.park, month ORDER BY ratio DESC, species) AS rank FROM ({_LONG}) l LEFT JOIN ruled r ON r.park = l.park AND r.name = l.species
     WHERE total >= 30 AND n >= 10 AND r.action IS NULL) WHERE rank <= 6""",
        "sightings",
        extra=f"{SPECIES}, {NAME_RULES}, {EFFORT}, {REL}",
    ),
)
def seen_more(spark, sf):
    out = rollups.seen_more_than_usual(rollups.relative_months(_species(spark, sf)))
    return out.select("park", "month", "species", "n", F.round("ratio", 6).alias("ratio"), "rank")


@query(
    "park_facts",
    tb.oracle(
        f"""SELECT park, CAST(sum(sightings) AS BIGINT) AS sightings, count(*) AS species,
     round(CAST(sum(m6 + m7 + m8) AS DOUBLE) / CAST(sum({MSUM}) AS DOUBLE), 6) AS summer_share FROM sp GROUP BY park""",
        "sightings",
        extra=SPECIES,
    ),
)
def park_facts(spark, sf):
    return rollups.park_facts(_species(spark, sf)).withColumn("summer_share", F.round("summer_share", 6))


@query(
    "species_index",
    tb.oracle(
        """SELECT sp.species, coalesce(arg_min(p.common_name, CASE WHEN p.common_name IS NOT NULL THEN sp.park END), '-') AS common_name,
     CAST(sum(sightings) AS BIGINT) AS total, CAST(sum(coalesce(c.cells, 0)) AS BIGINT) AS cells, count(*) AS n_parks,
     string_agg(sp.park || '=' || sightings, ';' ORDER BY sp.park) AS parks
     FROM sp LEFT JOIN picked p ON p.park = sp.park AND p.species = sp.species
     LEFT JOIN (SELECT park, species, count(*) AS cells FROM cs GROUP BY ALL) c ON c.park = sp.park AND c.species = sp.species GROUP BY sp.species""",
        "sightings",
        extra=f"{SPECIES}, {PLACED}",
    ),
)
def species_index(spark, sf):
    idx = rollups.species_index(*_species_and_cells(spark, sf))
    entries = F.array_sort(F.transform(F.map_entries("parks"), lambda e: F.concat_ws("=", e["key"], e["value"]["s"].cast("string"))))
    return idx.select(
        "species", F.coalesce("common_name", F.lit("-")).alias("common_name"), "total", "cells", "n_parks",
        F.array_join(entries, ";").alias("parks"),
    )


@query(
    "cell_entries_without_species",
    tb.oracle(
        """SELECT cs.park, count(*) AS entries, count(*) FILTER (sp.species IS NULL) AS unlisted FROM cs LEFT JOIN sp
     ON sp.park = cs.park AND sp.species = cs.species GROUP BY cs.park""",
        "sightings",
        extra=f"{SPECIES}, {PLACED}",
    ),
)
def unlisted(spark, sf):
    return rollups.unlisted_cell_entries(*_species_and_cells(spark, sf))


@query(
    "parks_per_species",
    tb.oracle(
        """SELECT species, park, sightings, CAST(rank AS INT) AS rank, round(CAST(sightings AS DOUBLE) / peak, 6) AS share FROM (SELECT *, max(sightings) OVER (PARTITION BY species) AS peak,
     row_number() OVER (PARTITION BY species ORDER BY sightings DESC, park) AS rank FROM sp)""",
        "sightings",
        extra=SPECIES,
    ),
)
def parks_per_species(spark, sf):
    out = ranking.parks_per_species(_species(spark, sf))
    return out.select("species", "park", "sightings", "rank", F.round("share", 6).alias("share"))


@query(
    "park_index",
    tb.oracle(
        """SELECT p.park, p.name, CASE WHEN p.r_regionkey = 4 THEN 'seed' WHEN s.sightings IS NOT NULL THEN 'live' ELSE 'planned' END AS status,
     coalesce(s.species, 0) AS species, coalesce(s.sightings, 0) AS sightings, coalesce(c.cells, 0) AS cells, coalesce(t.stops, 0) AS stops
     FROM parks p LEFT JOIN (SELECT park, count(*) AS species, CAST(sum(sightings) AS BIGINT) AS sightings FROM sp GROUP BY park) s USING (park)
     LEFT JOIN (SELECT park, count(DISTINCT cell) AS cells FROM cs GROUP BY park) c USING (park)
     LEFT JOIN (SELECT park, count(*) AS stops FROM stops GROUP BY park) t USING (park)""",
        "sightings",
        "parks",
        "stops",
        extra=f"{SPECIES}, {PLACED}",
    ),
)
def park_index(spark, sf):
    p = tb.parks(spark, sf)
    known = rollups.add_seed_parks(p.filter("r_regionkey < 4").select("park", "name"), p.select("park", "name"))
    out = rollups.park_index(known, *_species_and_cells(spark, sf), tb.stops(spark, sf))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("species", "sightings", "cells", "stops")]
    return out.select("park", "name", "status", *zero)


# ---- bias ------------------------------------------------------------------------------

_BIAS_BOXES = "SELECT concat('c', r_regionkey % 3) AS corridor, concat('park', r_regionkey) AS park, -110.4e0 AS min_lon, 44.55e0 AS min_lat, -110.15e0 AS max_lon, 44.85e0 AS max_lat FROM region WHERE r_regionkey < 3"
_DISK = "(VALUES " + ", ".join(
    f"({dq * hexgrid.FIELD + dr})" for dq in (-1, 0, 1) for dr in range(max(-1, -dq - 1), min(1, -dq + 1) + 1)
) + ") AS d(o)"
COVER = f"""covered AS (SELECT DISTINCT corridor, cell + o AS cell FROM (SELECT DISTINCT corridor, cell FROM
   {hex_sql('(SELECT corridor, lon, lat, 9 AS res FROM images WHERE lon IS NOT NULL)')}) c, {_DISK})"""


@query("coverage_cells", tb.oracle("SELECT corridor, count(*) AS cells, min(cell) AS lo, max(cell) AS hi FROM covered GROUP BY corridor", "images", extra=COVER))
def coverage_cells(spark, sf):
    cov = rollups.coverage_cells(tb.images(spark, sf))
    return cov.groupBy("corridor").agg(F.count("*").alias("cells"), F.min("cell").alias("lo"), F.max("cell").alias("hi"))


@query(
    "road_bias",
    tb.oracle(
        f"""SELECT corridor, taxon_class, n, covered, round(1 - CAST(covered AS DOUBLE) / n, 6) AS fraction_outside FROM (
      SELECT corridor, coalesce(cls, '(all)') AS taxon_class, count(*) AS n, count(*) FILTER (hit) AS covered FROM (
        SELECT b.corridor, coalesce(x.taxon_class, 'unknown') AS cls, EXISTS (SELECT 1 FROM covered c WHERE c.corridor = b.corridor AND c.cell = x.cell) AS hit
        FROM {hex_sql("(SELECT *, 9 AS res FROM sightings WHERE duplicate_of IS NULL AND coordinate_status = 'open' AND lon IS NOT NULL)")} x
        JOIN ({_BIAS_BOXES}) b ON b.park = x.park AND x.lon BETWEEN min_lon AND max_lon AND x.lat BETWEEN min_lat AND max_lat) h
      GROUP BY GROUPING SETS ((corridor), (corridor, cls)))""",
        "sightings",
        "images",
        extra=COVER,
    ),
)
def road_bias(spark, sf):
    tb.register(spark, sf, "region")
    boxes = spark.sql(_BIAS_BOXES)
    out = rollups.road_bias(tb.sightings(spark, sf), rollups.coverage_cells(tb.images(spark, sf)), boxes)
    return out.withColumn("fraction_outside", F.round("fraction_outside", 6))


# ---- duplicates ------------------------------------------------------------------------

DEDUPE_M, DEDUPE_S = 700.0, 43200.0
HAV = """2 * {r}e0 * asin(sqrt(least(1e0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2)
 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"""


def hav(a: str, b: str, radius: float = 6371008.8) -> str:
    return HAV.format(a=a, b=b, r=radius)


_MATCH = f"""a.park = b.park AND a.observed_on = b.observed_on AND a.scientific_name IS NOT DISTINCT FROM b.scientific_name
 AND {hav('a', 'b')} <= {DEDUPE_M}e0 AND ((a.who <> '' AND a.who = b.who)
 OR abs(epoch_us(a.observed_at) - epoch_us(b.observed_at)) <= {int(DEDUPE_S * 1e6)})"""
DEDUPED = f"""c AS (SELECT *, CASE source WHEN 'inaturalist' THEN 0 WHEN 'gbif' THEN 1 ELSE 2 END AS prio,
   lower(regexp_replace(coalesce(observer, ''), '[^A-Za-z0-9]', '', 'g')) AS who FROM sightings WHERE lon IS NOT NULL AND observed_on IS NOT NULL),
 t1 AS (SELECT a.sighting_id, min(b.sighting_id) AS duplicate_of FROM c a JOIN c b ON a.prio = 1 AND b.prio = 0 AND {_MATCH} GROUP BY 1),
 kept AS (SELECT * FROM c WHERE prio = 0 OR (prio = 1 AND sighting_id NOT IN (SELECT sighting_id FROM t1))),
 t2 AS (SELECT sighting_id, arg_min(hit, p || hit) AS duplicate_of FROM (SELECT a.sighting_id, b.sighting_id AS hit, b.prio AS p FROM c a JOIN kept b ON a.prio = 2 AND {_MATCH}) GROUP BY 1),
 dups AS (SELECT sighting_id, duplicate_of FROM t1 UNION ALL SELECT * FROM t2)"""


@query("duplicates", tb.oracle("SELECT * FROM dups", "sightings", extra=DEDUPED))
def duplicates(spark, sf):
    return dedupe.find_duplicates(tb.sightings(spark, sf), DEDUPE_M, DEDUPE_S)


@query(
    "duplicate_counts",
    tb.oracle(
        """SELECT park, count(*) AS total, count(d.sighting_id) AS marked_duplicate FROM sightings s LEFT JOIN dups d USING (sighting_id) GROUP BY park""",
        "sightings",
        extra=DEDUPED,
    ),
)
def duplicate_counts(spark, sf):
    df = tb.sightings(spark, sf)
    return dedupe.dedupe_counts(dedupe.mark_duplicates(df, dedupe.find_duplicates(df, DEDUPE_M, DEDUPE_S)))
