"""Map elements to landmarks, amenities and the place list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.functions import geo, labels, names, stats, text
from observatory.operators import lines
from observatory.operators.ranking import best_per
from observatory.operators.spatial import POINT_RADIUS_M, TRAIL_BUFFER_M
from observatory.session import materialise

TOP_SPECIES = 5
COVER = 64


def boundary_cover(boundaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A grid over each park's box: cells (park, row, col, edge) that a boundary crosses or that lie inside, and the boundary's legs by row.

    A grid has ``COVER`` rows and columns whatever the park. Cells that no leg
    touches are inside or outside as a whole, which their middle tells; cells
    outside are not listed. ``rings`` of a row are the legs of every ring that
    reach into it: a ray along a latitude crosses no others.
    """
    wide = {a: F.when(F.col(f"max_{a}") > F.col(f"min_{a}"), (F.col(f"max_{a}") - F.col(f"min_{a}")) / COVER).otherwise(1.0) for a in ("lon", "lat")}
    corner = F.named_struct(*[x for a in ("lon", "lat") for x in (F.lit(f"min_{a}"), F.col(f"min_{a}"), F.lit(a), wide[a])])
    rings = boundaries.select("park", corner.alias("g"), F.posexplode("rings").alias("ring", "pts"))
    turned = F.concat(F.slice("pts", 2, F.size("pts")), F.slice("pts", 1, 1))
    legs = rings.select("park", "g", "ring", F.explode(F.zip_with("pts", turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e")).filter("e.a <> e.b")

    def cells(low: Column, high: Column, axis: str) -> Column:
        """Rows or columns between two coordinates, with what rounding could add."""
        at = lambda v, more: F.floor((v - F.col(f"g.min_{axis}")) / F.col(f"g.{axis}") + more).cast("int")
        inside = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(COVER - 1))
        return F.sequence(inside(at(low, -1e-6)), inside(at(high, 1e-6)))

    legs = legs.withColumn("row", F.explode(cells(F.least("e.a.lat", "e.b.lat"), F.greatest("e.a.lat", "e.b.lat"), "lat")))
    rows = legs.groupBy("park", "row", "ring").agg(F.collect_list("e").alias("legs")).groupBy("park", "row").agg(F.collect_list("legs").alias("rings"))
    rows = materialise(rows, "boundary-rows")

    rise = F.col("e.b.lat") - F.col("e.a.lat")

    def lon_at(lat: Column) -> Column:
        """Where a leg is at a latitude, kept between its ends; a flat leg is everywhere along itself."""
        t = F.least(F.greatest((lat - F.col("e.a.lat")) / F.nullif(rise, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.col("e.a.lon") + (F.col("e.b.lon") - F.col("e.a.lon")) * t

    flat = F.abs(rise) < F.col("g.lat") * 1e-9
    floor = F.col("g.min_lat") + F.col("g.lat") * F.col("row")
    ends = [F.when(flat, c).otherwise(x) for c, x in ((F.col("e.a.lon"), lon_at(floor - F.col("g.lat") * 1e-6)), (F.col("e.b.lon"), lon_at(floor + F.col("g.lat") * (1 + 1e-6))))]
    touched = legs.select("park", "row", F.explode(cells(F.least(*ends), F.greatest(*ends), "lon")).alias("col")).distinct()
    touched = materialise(touched, "boundary-cells")

    every = boundaries.select("park", corner.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(COVER - 1))).alias("row"))
    every = every.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(COVER - 1)))).join(touched, ["park", "row", "col"], "left_anti")
    mid = [F.col(f"g.min_{a}") + F.col(f"g.{a}") * (F.col(c) + 0.5) for a, c in (("lon", "col"), ("lat", "row"))]
    within = every.select("park", "row", "col", mid[0].alias("lon"), mid[1].alias("lat")).join(rows, ["park", "row"]).filter(crossed_by_rings())
    cover = touched.withColumn("edge", F.lit(True)).unionByName(within.select("park", "row", "col", F.lit(False).alias("edge")))
    return materialise(cover, "boundary-cover"), rows


def crossed_by_rings() -> Column:
    """Whether a ray from lon, lat crosses the legs of some ring an odd number of times."""

    def crosses(leg: Column) -> Column:
        a, b = leg["a"], leg["b"]
        straddles = (a["lat"] > F.col("lat")) != (b["lat"] > F.col("lat"))
        at = a["lon"] + (F.col("lat") - a["lat"]) * (b["lon"] - a["lon"]) / F.when(straddles, b["lat"] - a["lat"])
        return straddles & F.coalesce(F.col("lon") < at, F.lit(False))

    return F.exists("rings", lambda ring: F.size(F.filter(ring, crosses)) % 2 == 1)


def inside(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Add ``inside``: the point lies in its park's boundary.

    ``boundaries``: park, ``rings`` (outer rings) and their box, a row per park.
    Points find their cell in the park's grid; only those in a cell that the
    boundary crosses are tested, and only against the legs of their row. No
    ring travels with the points.
    """
    cover, rows = boundary_cover(boundaries)
    return _placed(points, boundaries, cover).join(rows.withColumnRenamed("row", "_edge"), ["park", "_edge"], "left").select(
        *points.columns, F.coalesce(F.when(F.col("_edge").isNotNull(), crossed_by_rings()).otherwise(F.col("_in")), F.lit(False)).alias("inside")
    )


def _placed(points: DataFrame, boundaries: DataFrame, cover: DataFrame) -> DataFrame:
    """Points with ``_in``: whether their cell is in the cover, and ``_edge``: their row, if the boundary crosses their cell."""
    box = boundaries.select("park", *[F.col(f"{m}_{a}").alias(f"_{m}_{a}") for m in ("min", "max") for a in ("lon", "lat")])
    boxed = points.join(box, "park", "left")
    inbox = F.col("lon").between(F.col("_min_lon"), F.col("_max_lon")) & F.col("lat").between(F.col("_min_lat"), F.col("_max_lat"))

    def cell(a: str) -> Column:
        width = F.when(F.col(f"_max_{a}") > F.col(f"_min_{a}"), (F.col(f"_max_{a}") - F.col(f"_min_{a}")) / COVER).otherwise(1.0)
        return F.when(inbox, F.least(F.floor((F.col(a) - F.col(f"_min_{a}")) / width).cast("int"), F.lit(COVER - 1)))

    at = boxed.select(*[F.col(f"`{c}`") for c in points.columns], cell("lat").alias("_row"), cell("lon").alias("_col"))
    side = cover.select("park", F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("edge").alias("_e"))
    found = at.join(side, ["park", "_row", "_col"], "left")
    return found.withColumn("_in", F.col("_e").isNotNull()).withColumn("_edge", F.when(F.col("_e"), F.col("_row"))).drop("_row", "_col", "_e")


def boundary_boxes(boundaries: DataFrame) -> DataFrame:
    """Boundary rows with the box of their rings."""
    pts = F.flatten("rings")

    def ends(field: str, fold) -> F.Column:
        return fold(F.transform(pts, lambda p: p[field]))

    return boundaries.select(
        "park", "rings",
        ends("lon", F.array_min).alias("min_lon"), ends("lat", F.array_min).alias("min_lat"),
        ends("lon", F.array_max).alias("max_lon"), ends("lat", F.array_max).alias("max_lat"),
    )


def landmarks_from(elements: DataFrame) -> DataFrame:
    """Named elements of a landmark kind inside the boundary, best first per name.

    ``elements``: park, id, lon, lat, tags, inside.
    """
    from observatory.operators.ranking import best_by_name

    k = labels.landmark_kind(F.col("tags"))

    def tag(key: str) -> F.Column:
        return F.nullif(F.try_element_at("tags", F.lit(key)), F.lit(""))

    rows = elements.filter(tag("name").isNotNull() & F.col("lat").isNotNull() & F.col("inside")).withColumn("k", k)
    rows = rows.filter(F.col("k").isNotNull()).select(
        "park",
        "id",
        tag("name").alias("name"),
        "k.kind",
        "k.rank",
        F.bround("lon", 5).alias("lon"),
        F.bround("lat", 5).alias("lat"),
        text.number_or_null(tag("ele")).alias("ele_m"),
        tag("wikidata").alias("wikidata"),
        text.wiki_url(tag("wikipedia")).alias("url"),
    )
    return best_by_name(rows)


def amenities_from(elements: DataFrame) -> DataFrame:
    """Facilities, lodging and natural features with their default names."""
    k = labels.amenity_kind(F.col("tags"))
    name = F.nullif(F.try_element_at("tags", F.lit("name")), F.lit(""))
    rows = elements.filter(F.col("lat").isNotNull()).withColumn("k", k).withColumn("_name", name)
    rows = rows.filter(
        F.col("k").isNotNull()
        & (~F.col("k.needs_name") | F.col("_name").isNotNull())
        & (~F.col("k.inside_only") | F.col("inside"))
    )
    sub = F.coalesce(names.sub_kind(F.col("tags")), F.lit(""))
    return rows.select(
        "park",
        "id",
        "k.kind",
        F.replace(sub, F.lit("_"), F.lit(" ")).alias("sub"),
        F.coalesce("_name", names.default_name(F.col("tags"), F.col("k.kind"))).alias("name"),
        F.col("_name").isNotNull().alias("named"),
        F.bround("lon", 5).alias("lon"),
        F.bround("lat", 5).alias("lat"),
        labels.keep_tags(F.col("tags"), labels.COPIED_TAGS).alias("tags"),
    )


def collect_places(landmarks: DataFrame, items: DataFrame, trails: DataFrame) -> DataFrame:
    """One place per id: landmarks, then named items, then trails.

    All inputs carry ``park``. A number-like ``ele`` tag becomes metres.
    """
    ele = F.try_element_at("tags", F.lit("ele"))
    elevation = F.when(ele.rlike(r"^\d*\.?\d*$") & ele.rlike(r"\d"), ele.try_cast("double"))
    a = landmarks.select(
        "park", "id", F.lit("landmark").alias("src"), "kind", F.lit(None).cast("string").alias("sub"), "name", "lon", "lat",
        "ele_m", "url", F.lit(None).cast("map<string,string>").alias("tags"), F.lit(None).cast("double").alias("length_m"),
        F.lit(POINT_RADIUS_M).alias("radius_m"), F.lit(0).alias("src_rank"),
    )
    b = items.filter("named").select(
        "park", "id", F.lit("item").alias("src"), "kind", "sub", "name", "lon", "lat", elevation.alias("ele_m"),
        F.lit(None).cast("string").alias("url"), labels.keep_tags(F.col("tags"), labels.PLACE_TAGS).alias("tags"),
        F.lit(None).cast("double").alias("length_m"), F.lit(POINT_RADIUS_M).alias("radius_m"), F.lit(1).alias("src_rank"),
    )
    c = trails.select(
        "park", "id", F.lit("trail").alias("src"), F.lit("trail").alias("kind"), F.lit(None).cast("string").alias("sub"),
        "name", "lon", "lat", F.lit(None).cast("double").alias("ele_m"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("map<string,string>").alias("tags"), F.col("length_m").cast("double"),
        F.lit(TRAIL_BUFFER_M).alias("radius_m"), F.lit(2).alias("src_rank"),
    )
    return best_per(a.unionByName(b).unionByName(c), ["park", "id"], [F.asc("src_rank"), F.asc("name")]).drop("src_rank")


def place_samples(places: DataFrame, pieces: DataFrame, step_m: float = lines.TRAIL_SAMPLE_M) -> DataFrame:
    """Sample points of each place: its own point, or points along every piece of its trail.

    ``pieces``: park, name, coords, the edges that carry a trail's name. A trail
    without a piece keeps its own point.
    """
    trails = places.filter(F.col("src") == "trail").select("park", F.col("id").alias("place"), "name", F.col("lon").alias("own_lon"), F.col("lat").alias("own_lat"), "radius_m")
    walked = lines.sample_lines(pieces.select("park", "name", "coords")).select("park", "name", "lon", "lat")
    walked = trails.join(walked, ["park", "name"], "left").select("park", "place", F.coalesce("lon", "own_lon").alias("lon"), F.coalesce("lat", "own_lat").alias("lat"), "radius_m")
    points = places.filter(F.col("src") != "trail").select("park", F.col("id").alias("place"), "lon", "lat", "radius_m")
    return points.unionByName(walked)


def place_rollup(places: DataFrame, hits: DataFrame, k: int = TOP_SPECIES, members: DataFrame | None = None) -> DataFrame:
    """Sightings, species, months and top species per place.

    ``members``: park, place, site, if ``hits`` are those of sites
    (``spatial.site_hits``): a site is rolled up once for all its places.
    """
    if members is not None:
        hits = hits.withColumnRenamed("site", "place")
    # A place's species are a vocabulary-bounded list: ranked once, then folded
    # with the totals in the same pass over the same partitioning.
    months = [F.sum(F.when(F.col("month") == m, F.col("n"))).alias(f"m{m}") for m in range(1, 13)]
    per_species = hits.groupBy("park", "place", "scientific_name").agg(F.sum("n").alias("n"), *months)
    order = W.partitionBy("park", "place").orderBy(F.desc("n"), "scientific_name")
    ranked = per_species.withColumn("rank", F.row_number().over(order))
    sums = [F.coalesce(F.sum(f"m{m}"), F.lit(0)).cast("bigint") for m in range(1, 13)]
    kept = F.when(F.col("rank") <= k, F.struct("rank", "scientific_name", "n"))
    totals = ranked.groupBy("park", "place").agg(
        F.sum("n").alias("n"),
        F.count("scientific_name").alias("species"),
        F.array(*sums).alias("months"),
        F.array_sort(F.collect_list(kept)).alias("top"),
    )
    if members is not None:
        totals = members.join(totals.withColumnRenamed("place", "site"), ["park", "site"]).drop("site")
    zero = F.array_repeat(F.lit(0).cast("bigint"), 12)
    p = places.withColumnRenamed("id", "place")
    return (
        p.join(totals, ["park", "place"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("species", F.coalesce("species", F.lit(0)))
        .withColumn("months", F.coalesce("months", zero))
        .withColumn("busiest", stats.busiest_label(F.col("months")))
    )


def match_places(places: DataFrame, query: str) -> DataFrame:
    """Places whose name or printed kind contains the query."""
    label = labels.kind_label(F.col("kind"), F.col("sub"))
    return places.withColumn("label", label).filter(text.name_matches(F.array("name", "label"), query))
