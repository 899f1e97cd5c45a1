"""Cell, species, park, month and report rollups.

Every aggregate here combines before its shuffle (counts, sums, extremes,
``max_by``), so a key holding a third of the rows arrives as one partial row
per input partition. Arrays are only gathered over keys that are bounded by a
vocabulary (species in a cell, parks of a species), never over raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.functions import hexgrid, names, stats
from observatory.operators import suppress
from observatory.session import materialise

CELL_RES = 9


def canonical(sightings: DataFrame) -> DataFrame:
    """Rows that are not duplicates of another."""
    return sightings.filter(F.col("duplicate_of").isNull())


def mappable(sightings: DataFrame) -> DataFrame:
    return canonical(sightings).filter(
        (F.col("coordinate_status") == "open") & F.col("lon").isNotNull() & F.col("scientific_name").isNotNull()
    )


def cell_species(
    sightings: DataFrame, rules: DataFrame, synonyms: Mapping[str, str], res: int = CELL_RES, facts: DataFrame | None = None
) -> DataFrame:
    """Counts per (park, cell, species): all, by people, by the model, first and last year (A1).

    Excluded species leave, coarsened ones land in their rule's coarser cell.
    With ``facts`` (``name_facts``) the rules need no pass of their own.
    """
    counts = None if facts is None else privacy_of(facts)
    ruled = suppress.apply_rules(mappable(sightings), sightings, rules, synonyms, counts)
    placed = ruled.filter(~F.col("action").eqNullSafe("exclude")).withColumn(
        "res", F.when(F.col("action") == "coarsen", F.coalesce("rule_res", F.lit(suppress.AUTO_RES))).otherwise(res)
    )
    people = F.col("confidence_basis") == "human_verified"
    year = F.year("observed_on")
    return (
        placed.withColumn("cell", hexgrid.cell_of(F.col("lon"), F.col("lat"), F.col("res")))
        .groupBy("park", "cell", "res", "species")
        .agg(
            F.count("*").alias("count"),
            F.count_if(people).alias("hv"),
            F.count_if(~people).alias("mp"),
            F.min(year).alias("y0"),
            F.max(year).alias("y1"),
            F.min("taxon_class").alias("taxon_class"),
        )
        .withColumn("coarsened", F.col("res") != res)
    )


def cell_totals(per_species: DataFrame) -> DataFrame:
    """Totals per cell with the nested species list, most recorded first."""
    entry = F.struct((-F.col("count")).alias("neg"), "species", "count", "hv", "mp", "y0", "y1")
    return (
        per_species.groupBy("park", "cell", "res", "coarsened")
        .agg(
            F.sum("count").alias("count"),
            F.sum("hv").alias("hv"),
            F.sum("mp").alias("mp"),
            F.min("y0").alias("y0"),
            F.max("y1").alias("y1"),
            F.array_sort(F.collect_list(entry)).alias("sp"),
        )
        .withColumn("sp", F.transform("sp", lambda e: e.dropFields("neg")))
        .withColumn("ring", hexgrid.boundary(F.col("cell")))
    )


def name_votes(sightings: DataFrame, synonyms: Mapping[str, str]) -> DataFrame:
    """Votes per (park, species, tier, common name); one table for every export (A3)."""
    tier = F.when(F.col("source") == "inaturalist", "inaturalist").otherwise("other")
    return (
        canonical(sightings)
        .filter(F.col("scientific_name").isNotNull() & (F.length("common_name") > 0))
        .groupBy(
            "park",
            names.canonical_species(F.col("scientific_name"), synonyms).alias("species"),
            tier.alias("tier"),
            "common_name",
        )
        .agg(F.count("*").alias("votes"))
    )


def pick_names(votes: DataFrame) -> DataFrame:
    """The winning name per species and the losing ones, sorted."""
    ballot = F.struct("votes", "common_name")
    first = F.max(F.when(F.col("tier") == "inaturalist", ballot))
    other = F.max(F.when(F.col("tier") == "other", ballot))
    return (
        votes.groupBy("park", "species")
        .agg(F.coalesce(first, other)["common_name"].alias("common_name"), F.collect_set("common_name").alias("_all"))
        .withColumn("other_names", F.array_sort(F.array_except("_all", F.array("common_name"))))
        .drop("_all")
    )


COUNTED = (
    "sightings", "open_coordinates", "obscured_coordinates", "n_inaturalist", "n_gbif", "n_mapillary_cv", "human_verified", "model_predicted",
)


def name_facts(sightings: DataFrame, synonyms: Mapping[str, str]) -> DataFrame:
    """Per (park, scientific name, tier, common name) all that species, votes and rules are made of.

    The one pass over the sightings behind ``species_rollup``: names are few
    where rows are many, so the result is written and the rest works on it.
    ``sightings`` and the other counts hold rows that are listed as a species;
    ``votes`` holds rows of any rank, ``own`` and ``flagged`` duplicates as well.
    """
    kept = F.col("duplicate_of").isNull()
    source = F.col("source")
    listed = F.coalesce(kept & (F.col("taxon_rank").isin("species", "subspecies") | (source == "mapillary_cv")), F.lit(False))

    def of(column: str, value: str) -> Column:
        return F.count_if(listed & (F.col(column) == value))

    facts = (
        sightings.filter(F.col("scientific_name").isNotNull())
        .groupBy("park", "scientific_name", F.when(source == "inaturalist", "inaturalist").otherwise("other").alias("tier"), "common_name")
        .agg(
            *suppress.privacy_counts(),
            F.count_if(kept & (F.length("common_name") > 0)).alias("votes"),
            F.count_if(listed).alias("sightings"),
            of("coordinate_status", "open").alias("open_coordinates"),
            of("coordinate_status", "obscured").alias("obscured_coordinates"),
            of("source", "inaturalist").alias("n_inaturalist"),
            of("source", "gbif").alias("n_gbif"),
            of("source", "mapillary_cv").alias("n_mapillary_cv"),
            of("confidence_basis", "human_verified").alias("human_verified"),
            of("confidence_basis", "model_predicted").alias("model_predicted"),
            F.min(F.when(listed, F.col("taxon_class"))).alias("taxon_class"),
            F.max(F.when(listed & (source == "inaturalist"), F.col("taxon_id"))).alias("taxon_id"),
            F.min(F.when(listed, F.col("observed_on"))).alias("first_on"),
            F.max(F.when(listed, F.col("observed_on"))).alias("last_on"),
            stats.month_counts(F.month(F.when(listed, F.col("observed_on")))).alias("months"),
        )
        .withColumn("species", names.canonical_species(F.col("scientific_name"), synonyms))
    )
    return materialise(facts, "names")


def privacy_of(facts: DataFrame) -> DataFrame:
    return facts.groupBy("park", "scientific_name").agg(F.sum("own").alias("own"), F.sum("flagged").alias("flagged"))


def species_rollup(
    sightings: DataFrame, synonyms: Mapping[str, str], rules: DataFrame | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """Per (park, species): counts by status, source and basis, dates, months, aliases, id, names.

    ``facts`` is ``name_facts`` of the sightings, where another step has it too.
    """
    facts = name_facts(sightings, synonyms) if facts is None else facts
    same = F.col("scientific_name") == F.col("species")
    agg = facts.filter("sightings > 0").groupBy("park", "species").agg(
        F.min("taxon_class").alias("taxon_class"),
        F.max(F.when(same, F.col("taxon_id"))).alias("taxon_id"),
        *[F.sum(c).alias(c) for c in COUNTED],
        F.min("first_on").alias("first_on"),
        F.max("last_on").alias("last_on"),
        F.array(*[F.sum(F.get("months", F.lit(i))) for i in range(12)]).alias("months"),
        F.array_sort(F.collect_set(F.when(~same, F.col("scientific_name")))).alias("aliases"),
    )
    votes = facts.filter("votes > 0").groupBy("park", "species", "tier", "common_name").agg(F.sum("votes").alias("votes"))
    out = agg.join(pick_names(votes), ["park", "species"], "left")
    if rules is None:
        return out
    ruled = suppress.name_rules(agg.select("park", F.col("species").alias("name")), rules, suppress.auto_sensitive_of(privacy_of(facts)))
    return out.join(ruled.withColumnRenamed("name", "species"), ["park", "species"], "left")


def park_summary(sightings: DataFrame) -> DataFrame:
    """Counts by source, class and status plus the totals in one pass.

    One ``GROUPING SETS`` aggregation replaces a query per figure; ``facet``
    names the set a row belongs to.
    """
    grouped = sightings.groupingSets(
        [["park"], ["park", "source"], ["park", "taxon_class"], ["park", "coordinate_status"]],
        "park",
        "source",
        "taxon_class",
        "coordinate_status",
    ).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("n"),
        F.count_if(F.col("duplicate_of").isNull()).alias("canonical"),
        F.min("observed_on").alias("first_on"),
        F.max("observed_on").alias("last_on"),
    )
    facet = (
        F.when(F.col("gid") == 3, "source")
        .when(F.col("gid") == 5, "class")
        .when(F.col("gid") == 6, "status")
        .otherwise("park")
    )
    value = F.coalesce("source", "taxon_class", "coordinate_status", F.lit(""))
    return grouped.select("park", facet.alias("facet"), value.alias("value"), "n", "canonical", "first_on", "last_on")


def distinct_species(sightings: DataFrame) -> DataFrame:
    return (
        sightings.filter(F.col("taxon_rank").isin("species", "subspecies"))
        .groupBy("park")
        .agg(F.count_distinct("scientific_name").alias("species"))
    )


def coverage_cells(images: DataFrame, res: int = CELL_RES, ring: int = 1) -> DataFrame:
    """Cells within ``ring`` of any image, per corridor (J9): distinct cells
    first, so the ring is expanded once per cell and not once per image."""
    cells = (
        images.filter(F.col("lon").isNotNull())
        .select("corridor", hexgrid.cell_of(F.col("lon"), F.col("lat"), res).alias("c"))
        .distinct()
    )
    return cells.select("corridor", F.explode(hexgrid.disk(F.col("c"), ring)).alias("cell")).distinct()


def road_bias(sightings: DataFrame, covered: DataFrame, boxes: DataFrame, res: int = CELL_RES) -> DataFrame:
    """Share of open sightings outside image coverage, per corridor and class with totals.

    ``boxes`` holds one row per corridor: its park and rectangle. The park is
    the equi-key; sightings are counted per cell before meeting the coverage.
    """
    inside = (
        canonical(sightings)
        .filter(F.col("coordinate_status") == "open")
        .join(boxes, "park")
        .filter(
            F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
            & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
        )
    )
    per_cell = (
        inside.groupBy(
            "corridor",
            F.coalesce("taxon_class", F.lit("unknown")).alias("taxon_class"),
            hexgrid.cell_of(F.col("lon"), F.col("lat"), res).alias("cell"),
        )
        .agg(F.count("*").alias("k"))
        .join(covered.withColumn("hit", F.lit(True)), ["corridor", "cell"], "left")
    )
    return (
        per_cell.groupingSets([["corridor"], ["corridor", "taxon_class"]], "corridor", "taxon_class")
        .agg(
            F.sum("k").alias("n"),
            F.coalesce(F.sum(F.when(F.col("hit"), F.col("k"))), F.lit(0)).alias("covered"),
        )
        .withColumn("taxon_class", F.coalesce("taxon_class", F.lit("(all)")))
        .withColumn("fraction_outside", 1 - F.col("covered") / F.col("n"))
    )


def month_profile(rows: DataFrame, keys: list[str], when: str) -> DataFrame:
    """Month histogram, summer share and the months with nothing (A5)."""
    out = rows.filter(F.col(when).isNotNull()).groupBy(*keys).agg(stats.month_counts(F.month(when)).alias("months"))
    empty = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda m: F.get("months", m - 1) == 0)
    return out.withColumn("summer_share", stats.summer_share(F.col("months"))).withColumn("empty_months", empty)


def effort(species_months: DataFrame, keys: list[str]) -> DataFrame:
    """Everyone's counts per month: the park's observation effort."""
    total = [F.sum(F.get("months", F.lit(i))).alias(f"m{i}") for i in range(12)]
    return species_months.groupBy(*keys).agg(*total).select(
        *keys, F.array(*[f"m{i}" for i in range(12)]).alias("effort")
    )


def relative_months(species_months: DataFrame, minimum: int = 30) -> DataFrame:
    """Each species' month share over everyone's, and its peak.

    One row per (park, species); the month arithmetic stays inside the row.
    """
    joined = species_months.join(effort(species_months, ["park"]), "park")
    total = stats.array_total(F.col("months"))
    everyone = stats.array_total(F.col("effort"))
    ratio = F.zip_with(
        "months",
        "effort",
        lambda m, e: F.when((total >= minimum) & (e > 0), m / total / (e / everyone)).otherwise(F.lit(0.0)),
    )
    out = joined.withColumn("total", total).withColumn("rel", ratio)
    peak = F.array_max("rel")
    return out.withColumn("rel_max", peak).withColumn(
        "rel_peak", F.when(peak > 0, F.array_position("rel", peak))
    )


def seen_more_than_usual(relative: DataFrame, top: int = 6, min_total: int = 30, min_month: int = 10) -> DataFrame:
    """Per (park, month): unsuppressed species by ratio."""
    from observatory.operators.ranking import top_k

    rows = relative.filter((F.col("total") >= min_total) & F.col("action").isNull()).select(
        "park", "species", F.posexplode(F.arrays_zip("months", "rel")).alias("i", "m")
    )
    rows = rows.select("park", "species", (F.col("i") + 1).alias("month"), F.col("m.months").alias("n"), F.col("m.rel").alias("ratio"))
    return top_k(
        rows.filter(F.col("n") >= min_month), ["park", "month"], [F.desc("ratio"), F.asc("species")], top, "rank"
    )


def park_facts(species_months: DataFrame) -> DataFrame:
    """Grand total, species count and summer share per park."""
    sums = [F.sum(F.get("months", F.lit(i))).alias(f"m{i}") for i in range(12)]
    agg = species_months.groupBy("park").agg(
        F.sum("sightings").alias("sightings"), F.count("*").alias("species"), *sums
    )
    months = F.array(*[f"m{i}" for i in range(12)])
    return agg.select("park", "sightings", "species", stats.summer_share(months).alias("summer_share"))


def species_index(species: DataFrame, cells: DataFrame) -> DataFrame:
    """Across parks: per species its parks, totals and names.

    ``cells`` is the per-(park, cell, species) table. Cell entries above
    species level have no species row; they are counted, not kept.
    """
    counts = cells.groupBy("park", "species").agg(F.count("*").alias("cells"))
    per_park = species.join(counts, ["park", "species"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    entry = F.struct(
        "park",
        F.struct(
            F.col("sightings").alias("s"), F.col("human_verified").alias("hv"), F.col("model_predicted").alias("mp"),
            F.col("action").alias("x"), "cells",
        ).alias("stats"),
    )
    every = F.array_compact(F.concat(F.array("common_name"), "aliases", F.coalesce("other_names", F.array())))
    rolled = per_park.groupBy("species").agg(
        F.min_by("common_name", F.when(F.col("common_name").isNotNull(), F.col("park"))).alias("common_name"),
        F.min("taxon_class").alias("taxon_class"),
        F.sum("sightings").alias("total"),
        F.sum("cells").alias("cells"),
        F.count("*").alias("n_parks"),
        F.map_from_entries(F.collect_list(entry)).alias("parks"),
        F.array_distinct(F.flatten(F.collect_list(every))).alias("_names"),
    )
    chosen = F.array(F.col("common_name"))
    return rolled.withColumn("other", F.array_sort(F.array_except("_names", chosen))).drop("_names")


def unlisted_cell_entries(species: DataFrame, cells: DataFrame) -> DataFrame:
    """Cell entries without a species row, per park."""
    known = species.select("park", "species", F.lit(True).alias("known"))
    joined = cells.join(known, ["park", "species"], "left")
    return joined.groupBy("park").agg(
        F.count("*").alias("entries"), F.count_if(F.col("known").isNull()).alias("unlisted")
    )


def park_index(parks: DataFrame, species: DataFrame, cells: DataFrame, stops: DataFrame) -> DataFrame:
    """Parks with their counts and status ``live/planned/seed``."""
    n_species = species.groupBy("park").agg(F.count("*").alias("species"), F.sum("sightings").alias("sightings"))
    n_cells = cells.groupBy("park").agg(F.count_distinct("cell").alias("cells"))
    n_stops = stops.groupBy("park").agg(F.count("*").alias("stops"))
    status = (
        F.when(~F.col("configured"), "seed").when(F.col("sightings").isNotNull(), "live").otherwise("planned")
    )
    return (
        parks.join(n_species, "park", "left")
        .join(n_cells, "park", "left")
        .join(n_stops, "park", "left")
        .withColumn("status", status)
    )


def add_seed_parks(configured: DataFrame, seeds: DataFrame) -> DataFrame:
    """Configured parks plus the seeds not configured by key or by name."""
    low = configured.select(F.lower("name").alias("_low")).distinct()
    fresh = (
        seeds.join(configured.select("park"), "park", "left_anti")
        .withColumn("_low", F.lower("name"))
        .join(low, "_low", "left_anti")
        .drop("_low")
    )
    return configured.withColumn("configured", F.lit(True)).unionByName(fresh.withColumn("configured", F.lit(False)))


def climate_normals(days: DataFrame, keys: list[str], wet_mm: float = 1.0) -> DataFrame:
    """Monthly means of highs and lows, rain, snow and wet days per year."""
    both = F.col("tmax").isNotNull() & F.col("tmin").isNotNull()
    years = F.greatest(F.lit(1), F.count_distinct(F.year("date")))
    rain = F.coalesce("precip", F.lit(0.0))
    agg = days.groupBy(*keys, F.month("date").alias("month")).agg(
        F.avg(F.when(both, F.col("tmax"))).alias("tmax"),
        F.avg(F.when(both, F.col("tmin"))).alias("tmin"),
        (F.sum(rain) / years).alias("precip_mm"),
        (F.sum(F.coalesce("snow", F.lit(0.0))) / years).alias("snow_cm"),
        (F.sum((rain >= wet_mm).cast("int")) / years).alias("wet_days"),
    )
    return agg.select(
        *keys,
        "month",
        F.bround("tmax", 1).alias("tmax"),
        F.bround("tmin", 1).alias("tmin"),
        F.bround("precip_mm", 0).alias("precip_mm"),
        F.bround("snow_cm", 1).alias("snow_cm"),
        F.bround("wet_days", 0).alias("wet_days"),
    )


def climate_anchor(parks: DataFrame, places: DataFrame) -> DataFrame:
    """Where to read a park's climate: its most recorded place, else its box centre."""
    top = places.groupBy("park").agg(
        F.min_by(F.struct("name", "lon", "lat", "n"), F.struct(-F.col("n"), F.col("name"))).alias("p")
    )
    joined = parks.join(top, "park", "left")
    seen = F.col("p.n") > 0
    return joined.select(
        "park",
        F.when(seen, F.col("p.lon")).otherwise((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"),
        F.when(seen, F.col("p.lat")).otherwise((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"),
        F.when(seen, F.col("p.name")).otherwise("park centre").alias("at"),
    )


def trail_rollup(edges: DataFrame, min_m: float = 500.0) -> DataFrame:
    """Named trails per park: length, pieces and the midpoint of the longest piece."""
    mid = F.get("coords", F.floor(F.size("coords") / 2).cast("int"))
    return (
        edges.filter((F.col("kind") == 1) & F.col("name").isNotNull())
        .groupBy("park", "name")
        .agg(
            F.sum("length_m").alias("length_m"),
            F.count("*").alias("pieces"),
            F.min_by(mid, F.struct((-F.col("length_m")).alias("neg"), "edge_id")).alias("point"),
        )
        .filter(F.col("length_m") >= min_m)
        .select("park", "name", "length_m", "pieces", F.col("point.lon").alias("lon"), F.col("point.lat").alias("lat"))
    )


def box_of_points(points: DataFrame, keys: list[str], max_deg: float = 8.0) -> DataFrame:
    """Bounding box per key, over-wide ones refused."""
    return (
        points.groupBy(*keys)
        .agg(
            F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"),
            F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"),
        )
        .filter((F.col("max_lon") - F.col("min_lon") < max_deg) & (F.col("max_lat") - F.col("min_lat") < max_deg))
    )


def frame_of_boxes(parks: DataFrame) -> DataFrame:
    """The box that holds every live park, or every park when none is live."""
    def ends(fold, column: str) -> Column:
        live = fold(F.when(F.col("status") == "live", F.col(column)))
        return F.coalesce(live, fold(F.col(column))).alias(column)

    return parks.agg(ends(F.min, "min_lon"), ends(F.min, "min_lat"), ends(F.max, "max_lon"), ends(F.max, "max_lat"))


def coverage_summary(images: DataFrame, tiles: DataFrame) -> DataFrame:
    """Images, sequences, dates and tiles per corridor."""
    img = images.groupBy("corridor").agg(
        F.count_distinct("image_id").alias("images"),
        F.count_distinct("sequence_id").alias("sequences"),
        F.min("captured_at").alias("first"),
        F.max("captured_at").alias("last"),
    )
    til = tiles.groupBy("corridor").agg(
        F.count("*").alias("tiles"), F.count_if(F.col("status") == "capped").alias("truncated")
    )
    return img.join(til, "corridor", "left")


def monthly_readers(views: DataFrame, keys: list[str], today: str) -> DataFrame:
    """Average monthly readers over the twelve complete months before ``today``.

    Views are added as decimals (six places): a mean that ends in one half rounds
    to the even number whatever the order of the rows.
    """
    this_month = F.trunc(F.lit(today).cast("date"), "month")
    window = (F.col("month") >= F.add_months(this_month, -12)) & (F.col("month") < this_month)
    mean = F.avg(F.col("views").cast("decimal(28,6)"))
    return views.filter(window).groupBy(*keys).agg(F.bround(mean, 0).cast("bigint").alias("views_pm"))


# Gauge parameter codes and the no-data sentinel.
FLOW_CODE, TEMP_CODE, NO_DATA = "00060", "00010", -999.0


def latest_gauges(readings: DataFrame) -> DataFrame:
    """Latest flow and temperature per site; sites with neither are dropped."""
    def latest(code: str) -> Column:
        order = F.when(F.col("code") == code, F.struct("ts", "reading_id"))
        return F.max_by("value", order)

    def known(value: Column) -> Column:
        return F.when(value > NO_DATA, value)

    return (
        readings.groupBy("site")
        .agg(
            known(latest(FLOW_CODE)).alias("flow_cfs"),
            known(latest(TEMP_CODE)).alias("temp_c"),
            F.max("ts").alias("ts"),
        )
        .filter(F.col("flow_cfs").isNotNull() | F.col("temp_c").isNotNull())
    )


def recent_events(events: DataFrame, today: str, days: int = 30, min_mag: float = 1.5) -> DataFrame:
    """Events of the last days above a magnitude."""
    since = F.lit(today).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return events.filter((F.col("ts") >= since) & (F.col("mag") >= min_mag))


def largest_event(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.max_by(F.struct("event_id", "mag", "ts"), F.struct("mag", (-F.col("event_id")).alias("neg"))).alias("e"),
        F.count("*").alias("n"),
    ).select(*keys, "n", "e.event_id", "e.mag", "e.ts")
