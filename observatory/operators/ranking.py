"""Top-k and ordered picks.

``row_number() <= k`` is planned with a group limit below the shuffle, so each
task sends at most k rows per group however large the group is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.functions import geo, labels, text
from observatory.operators.segmented import previous_row
from observatory.session import materialise


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str | None = None) -> DataFrame:
    """First ``k`` rows per group of a total order."""
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k)
    return ranked.withColumnRenamed("_rn", out) if out else ranked.drop("_rn")


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per group."""
    return top_k(df, keys, order, 1)


# ---- photos -----------------------------------------------------------------

SPECIES_PHOTOS = 8
CELL_PHOTOS = 3


def displayable_photos(observations: DataFrame) -> DataFrame:
    """One row per displayable photo of an observation.

    ``observations`` carries ``photos array<struct<url,license_code>>`` beside
    its own columns.
    """
    parsed = text.parse_photo(F.col("photo.url"))
    rows = observations.select(
        *[c for c in observations.columns if c != "photos"], F.posexplode("photos").alias("photo_pos", "photo")
    )
    return (
        rows.withColumn("licence", text.display_license(F.col("photo.license_code")))
        .withColumn("p", parsed)
        .filter(F.col("licence").isNotNull() & F.col("p").isNotNull())
        .select("*", "p.photo_id", "p.ext", "p.host")
        .drop("photo", "p")
    )


def first_of_row(observations: DataFrame) -> DataFrame:
    """The first displayable photo of each row of ``displayable_photos``' input, with its columns; rows without one go.

    Photos are judged inside their row, so nothing holds a row per photo.
    """
    licensed = F.filter(
        F.transform("photos", lambda p, i: F.struct(i.alias("photo_pos"), text.display_license(p["license_code"]).alias("licence"), p["url"].alias("url"))),
        lambda x: x["licence"].isNotNull(),
    )
    # an address is read whole only where it is known to be one
    known = F.filter(licensed, lambda x: text.parse_photo(x["url"]).isNotNull())
    first = F.get(known, F.lit(0))
    rows = observations.select(*[c for c in observations.columns if c != "photos"], F.explode(F.array(first)).alias("x"))
    rows = rows.filter(F.col("x").isNotNull()).withColumn("p", text.parse_photo(F.col("x.url")))
    return rows.select("*", "x.photo_pos", "x.licence", "p.photo_id", "p.ext", "p.host").drop("x", "p")


def first_photo(photos: DataFrame, observation: str = "observation_id") -> DataFrame:
    """The first displayable photo of each observation."""
    rest = [c for c in photos.columns if c != observation]
    return (
        photos.groupBy(observation)
        .agg(F.min_by(F.struct(*rest), F.struct("photo_pos", "photo_id")).alias("_p"))
        .select(observation, "_p.*")
    )


def photo_order() -> list[Column]:
    """Most liked, then most recent, then the lower photo id."""
    return [F.desc("faves"), F.col("observed_on").desc_nulls_last(), F.asc("photo_id")]


def species_gallery(photos: DataFrame, k: int = SPECIES_PHOTOS) -> DataFrame:
    """Top photos per species."""
    return top_k(photos, ["park", "species"], photo_order(), k, "rank")


def cell_strip(photos: DataFrame, k: int = CELL_PHOTOS) -> DataFrame:
    """Per cell its best ``k`` photos, then the best of every other species there.

    Both limits are taken on disjoint passes: the best of each (cell, species)
    first, which bounds a cell by its species, and the best ``k`` of the cell.
    """
    placed = photos.filter(F.col("cell").isNotNull())
    order = photo_order()
    top = top_k(placed, ["park", "cell"], order, k, "rn")
    bests = top_k(placed, ["park", "cell", "species"], order, 1)
    seen = top.select("park", "cell", "species").distinct()
    others = bests.join(seen, ["park", "cell", "species"], "left_anti")
    tail = W.partitionBy("park", "cell").orderBy(*order)
    others = others.withColumn("rn", F.row_number().over(tail) + k)
    return top.unionByName(others)


def cell_strip_v1(photos: DataFrame, k: int = CELL_PHOTOS) -> DataFrame:
    """Superseded: the best ``k`` only."""
    return top_k(photos.filter(F.col("cell").isNotNull()), ["park", "cell"], photo_order(), k, "rn")


def photo_near(
    wanted: DataFrame, stop_cells: DataFrame, strips: DataFrame, gallery: DataFrame
) -> DataFrame:
    """A photo of a species at a stop: from a nearby cell's strip, else a gallery
    photo whose cell is near, else the species' best (J22).

    ``wanted``: park, stop, species. ``stop_cells``: park, stop, cell, pos.
    """
    here = wanted.join(stop_cells, ["park", "stop"])
    s = strips.select("park", "cell", "species", "photo_id", F.col("rn").alias("order"))
    a = here.join(s, ["park", "cell", "species"]).select(
        "park", "stop", "species", F.lit(0).alias("tier"), F.col("pos").alias("o1"), F.col("order").alias("o2"), "photo_id"
    )
    g = gallery.select("park", "species", "cell", "photo_id", F.col("rank").alias("order"))
    b = here.join(g, ["park", "species", "cell"]).select(
        "park", "stop", "species", F.lit(1).alias("tier"), F.col("order").alias("o1"), F.col("pos").alias("o2"), "photo_id"
    )
    c = wanted.join(g.filter(F.col("order") == 1), ["park", "species"]).select(
        "park", "stop", "species", F.lit(2).alias("tier"), F.lit(1).alias("o1"), F.lit(0).alias("o2"), "photo_id"
    )
    picked = F.min(F.struct("tier", "o1", "o2", "photo_id"))
    return (
        a.unionByName(b)
        .unionByName(c)
        .groupBy("park", "stop", "species")
        .agg(picked.alias("p"))
        .select("park", "stop", "species", "p.photo_id", (F.col("p.tier") < 2).alias("near"))
    )


# ---- cells and hotspots ------------------------------------------------------


def top_cells(cells: DataFrame, k: int = 3) -> DataFrame:
    """Busiest cells per (park, species) with their centre."""
    from observatory.functions import hexgrid

    ranked = top_k(cells, ["park", "species"], [F.desc("count"), F.asc("cell")], k, "rank")
    at = hexgrid.center(F.col("cell"))
    return ranked.withColumn("lon", F.bround(at["lon"], 4)).withColumn("lat", F.bround(at["lat"], 4))


def hotspots(cells: DataFrame, k: int = 3) -> DataFrame:
    """Busiest cells per species that were not coarsened."""
    return top_cells(cells.filter(~F.col("coarsened")), k)


def filter_cells(cells: DataFrame, lo: int, hi: int, species: str | None = None) -> DataFrame:
    """Cells whose year span overlaps a range; with a species its own counts."""
    rows = cells if species is None else cells.filter(F.col("species") == species)
    if species is None:
        rows = rows.groupBy("park", "cell").agg(
            F.sum("count").alias("count"), F.sum("hv").alias("hv"), F.sum("mp").alias("mp"),
            F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        )
    kept = (F.coalesce("y1", F.lit(hi)) >= lo) & (F.coalesce("y0", F.lit(lo)) <= hi)
    return rows.filter(kept).select("park", "cell", "count", "hv", "mp", "y0", "y1")


def cell_detail(cells: DataFrame, focus: str | None = None) -> DataFrame:
    """A cell's species, the focus first, then by count."""
    first = F.when(F.col("species") == F.lit(focus), 0).otherwise(1)
    order = W.partitionBy("park", "cell").orderBy(first, F.desc("count"), "species")
    return cells.withColumn("rank", F.row_number().over(order))


def focus_photos(strips: DataFrame, gallery: DataFrame) -> DataFrame:
    """Photos of a species in a cell in order: its strip, then its gallery, distinct by photo."""
    both = strips.select("park", "cell", "species", "photo_id", F.lit(0).alias("src"), F.col("rn").alias("o")).unionByName(
        gallery.filter(F.col("cell").isNotNull()).select(
            "park", "cell", "species", "photo_id", F.lit(1).alias("src"), F.col("rank").alias("o")
        )
    )
    once = both.groupBy("park", "cell", "species", "photo_id").agg(F.min(F.struct("src", "o")).alias("k"))
    order = W.partitionBy("park", "cell", "species").orderBy("k", "photo_id")
    return once.select("park", "cell", "species", "photo_id", "k.src", F.row_number().over(order).alias("position"))


def parks_per_species(species: DataFrame, first: int = 4) -> DataFrame:
    """Parks of each species by sightings, with the bar share of the largest."""
    peak = species.groupBy("species").agg(F.max("sightings").alias("peak"))
    ranked = species.withColumn(
        "rank", F.row_number().over(W.partitionBy("species").orderBy(F.desc("sightings"), "park"))
    )
    return (
        ranked.join(peak, "species")
        .withColumn("share", F.col("sightings") / F.col("peak"))
        .withColumn("shown", F.col("rank") <= first)
        .select("species", "park", "sightings", "rank", "share", "shown")
    )


def species_order(index: DataFrame) -> DataFrame:
    """The cross-park index in its printed order (T6): a range sort, not one task."""
    return index.orderBy(F.desc("total"), "species")


# ---- landmarks ---------------------------------------------------------------

MAX_LANDMARKS = 80
MAX_PER_KIND = 20
TOUR_STOPS = 8


def best_by_name(landmarks: DataFrame) -> DataFrame:
    """One landmark per name: best kind, with an article first."""
    return best_per(
        landmarks.withColumn("_low", F.lower("name")),
        ["park", "_low"],
        [F.asc("rank"), F.col("url").isNull().asc(), F.asc("name"), F.asc("id")],
    ).drop("_low")


def landmark_order() -> list[Column]:
    return [F.asc("rank"), F.col("url").isNull().asc(), F.asc("name"), F.asc("id")]


def cap_by_kind(
    landmarks: DataFrame, stops: DataFrame, per_kind: int = MAX_PER_KIND, overall: int = MAX_LANDMARKS
) -> DataFrame:
    """At most ``per_kind`` a kind and ``overall`` a park; tour stops always stay.

    ``stops``: park, id. Every different id of a park makes room for one landmark
    more, whether or not the list has it. The per-kind limit runs first and leaves a bounded list per park, so the
    running count over survivors and stops is a short window.
    """
    ids = stops.select("park", "id").distinct().withColumn("is_stop", F.lit(True))
    room = ids.groupBy("park").agg(F.count("id").alias("_stops"))
    marked = landmarks.join(ids, ["park", "id"], "left").withColumn("is_stop", F.coalesce("is_stop", F.lit(False)))
    others = top_k(marked.filter(~F.col("is_stop")), ["park", "kind"], landmark_order(), per_kind)
    pool = others.unionByName(marked.filter("is_stop"))
    listed = W.partitionBy("park").orderBy(*landmark_order())
    # Others stay while the kept list is short. Stops count towards it too, so
    # the place of an other in the pool is the length of the kept list before it
    # until the list first fills up; from there only stops are added.
    pool = pool.withColumn("_before", F.row_number().over(listed) - 1).join(room, "park", "left")
    kept = F.col("is_stop") | (F.col("_before") < overall + F.coalesce("_stops", F.lit(0)))
    return pool.filter(kept).select(*landmarks.columns, "is_stop")


def round_robin_stops(landmarks: DataFrame, k: int = TOUR_STOPS) -> DataFrame:
    """Landmarks in turns across kinds, those with an article first.

    No kind can give more than ``k`` stops, so each is cut to ``k`` before the
    turns are interleaved.
    """
    tiered = landmarks.withColumn("tier", F.col("url").isNull().cast("int"))
    # the kinds take turns in the order their first landmark is listed
    firsts = tiered.groupBy("park", "tier", "kind").agg(
        F.min(F.struct("rank", F.col("url").isNull().alias("u"), "name", "id")).alias("kind_first")
    )
    cut = top_k(tiered, ["park", "tier", "kind"], landmark_order(), k, "turn")
    return top_k(
        cut.join(firsts, ["park", "tier", "kind"]),
        ["park"],
        [F.asc("tier"), F.asc("turn"), F.asc("kind_first")],
        k,
        "pick",
    ).drop("kind_first")


def chain_stops(picked: DataFrame) -> DataFrame:
    """Order a park's few stops as a nearest-neighbour walk from the westernmost.

    Sequential, hence grouped pandas; a group holds at most ``TOUR_STOPS`` rows.
    """
    import numpy as np

    radius = geo.MEAN_EARTH_RADIUS_M

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        lon, lat = np.radians(pdf["lon"].to_numpy()), np.radians(pdf["lat"].to_numpy())
        left = list(np.lexsort((pdf["id"].to_numpy().astype(str), lon)))
        route = [left.pop(0)]
        while left:
            at = route[-1]
            rest = np.array(left)
            chord = (
                np.sin((lat[rest] - lat[at]) / 2) ** 2
                + np.cos(lat[at]) * np.cos(lat[rest]) * np.sin((lon[rest] - lon[at]) / 2) ** 2
            )
            route.append(left.pop(int(np.argmin(2 * radius * np.arcsin(np.sqrt(chord))))))
        out = pdf.iloc[route][["park", "id", "name", "kind", "lon", "lat"]].copy()
        out["tour"] = range(len(out))
        return out

    schema = "park string, id string, name string, kind string, lon double, lat double, tour int"
    return picked.select("park", "id", "name", "kind", "lon", "lat").groupBy("park").applyInPandas(walk, schema)


def match_tour(stops: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Curated stop names to landmarks: exact, configured coordinate, prefix, contains, missing.

    ``stops``: park, pos, stop, fb_lon, fb_lat. Stops are configuration, about a
    dozen a park; the park is the equi-key and each landmark meets only its own
    park's stops. A stop that stands at its configured coordinate is a place
    itself (``config/`` and its number): later stops may find it by a part of its
    name, after all listed landmarks.
    """
    s = stops.withColumn("key", F.lower("stop"))
    listed = F.struct(F.lit(0).alias("late"), "rank", F.col("url").isNull().alias("u"), "name", "id")
    l = landmarks.select("park", F.col("id").alias("lm_id"), F.lower("name").alias("low"), F.col("lon").alias("lm_lon"), F.col("lat").alias("lm_lat"), listed.alias("listed"))
    named = s.join(l.select("park", F.col("low").alias("key")).distinct(), ["park", "key"], "left_semi").select("park", "pos")
    own = s.filter(F.col("fb_lon").isNotNull()).join(named, ["park", "pos"], "left_anti")
    config = F.concat(F.lit("config/"), F.col("pos").cast("string"))
    late = F.struct(F.lit(1).alias("late"), F.col("pos").alias("rank"), F.lit(False).alias("u"), F.col("stop").alias("name"), config.alias("id"))
    c = own.select("park", config.alias("lm_id"), F.col("key").alias("low"), F.col("fb_lon").alias("lm_lon"), F.col("fb_lat").alias("lm_lat"), late.alias("listed"))
    grade = (
        F.when((F.col("low") == F.col("key")) & (F.col("listed.late") == 0), 0)
        .when(F.col("low").startswith(F.col("key")), 2)
        .when(F.contains(F.col("low"), F.col("key")), 3)
    )
    there = (F.col("listed.late") == 0) | (F.col("listed.rank") < F.col("pos"))
    hits = (
        s.join(l.unionByName(c), "park")
        .withColumn("grade", F.when(there, grade))
        .filter(F.col("grade").isNotNull())
        .groupBy("park", "pos")
        .agg(F.min(F.struct("grade", "listed", "lm_id", "lm_lon", "lm_lat")).alias("h"))
    )
    joined = s.join(hits, ["park", "pos"], "left")
    has_fallback = F.col("fb_lon").isNotNull()
    how = (
        F.when(F.col("h.grade") == 0, "exact")
        .when(has_fallback, "configured")
        .when(F.col("h.grade") == 2, "prefix")
        .when(F.col("h.grade") == 3, "contains")
        .otherwise("missing")
    )
    configured = how == "configured"
    return joined.select(
        "park",
        "pos",
        "stop",
        how.alias("how"),
        F.when(configured, config).otherwise(F.col("h.lm_id")).alias("id"),
        F.when(configured, F.col("fb_lon")).otherwise(F.col("h.lm_lon")).alias("lon"),
        F.when(configured, F.col("fb_lat")).otherwise(F.col("h.lm_lat")).alias("lat"),
    )


def tour_landmarks(landmarks: DataFrame, matched: DataFrame, articles: DataFrame) -> DataFrame:
    """The landmark list once the tour is matched: configured stops join it, and articles set for stops replace their landmarks' (J17).

    ``matched``: as ``match_tour`` gives it. ``articles``: park, pos, article; of
    several stops at one landmark the last one's article counts.
    """
    wiki = lambda title: F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))
    new = {
        "park": F.col("park"), "id": F.col("id"), "name": F.col("stop"), "kind": F.lit("place"), "rank": F.lit(len(labels.LANDMARK_RULES)),
        "lon": F.col("lon"), "lat": F.col("lat"), "url": wiki(F.col("stop")),
    }
    fields = landmarks.schema.fields
    added = matched.filter("how = 'configured'").select(*[new.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    told = matched.filter(F.col("id").isNotNull()).join(articles.filter(F.col("article").isNotNull()), ["park", "pos"])
    told = told.groupBy("park", "id").agg(F.max_by("article", "pos").alias("_article"))
    out = landmarks.unionByName(added).join(told, ["park", "id"], "left")
    return out.withColumn("url", F.coalesce(wiki(F.col("_article")), F.col("url"))).select(*landmarks.columns)


def stops_in_order(tour: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Tour ids with their landmark, list order kept, unknown ids dropped.

    ``tour``: park and an array of ids.
    """
    ids = tour.select("park", F.posexplode("tour").alias("pos", "id"))
    return ids.join(landmarks, ["park", "id"]).select("park", "pos", "id", "name", "kind", "lon", "lat")


def stop_headings(stops: DataFrame, segment: int = 1000) -> DataFrame:
    """Heading at each stop: toward the next, else from the previous.

    Both neighbours are found in segments of the list, so a park whose list is
    most of the table is still many tasks.
    """
    cut = stops.withColumn("_seg", F.floor(F.col("pos") / segment))
    before = previous_row(cut, ["park"], "_seg", ["pos"], ["lon", "lat"], "_before")
    back = before.withColumn("_neg", -F.col("pos")).withColumn("_nseg", -F.col("_seg"))
    both = previous_row(back, ["park"], "_nseg", ["_neg"], ["lon", "lat"], "_after")
    heading = F.coalesce(
        geo.bearing_deg("lon", "lat", F.col("_after.lon"), F.col("_after.lat")),
        geo.bearing_deg(F.col("_before.lon"), F.col("_before.lat"), "lon", "lat"),
        F.lit(0.0),
    )
    return both.withColumn("heading", heading).select(*stops.columns, "heading")


def nearest_licensed(photos: DataFrame, k: int = 6) -> DataFrame:
    """Nearest reusable photos per place."""
    ok = text.is_reusable(F.col("license_short")) & F.col("thumb").isNotNull()
    return top_k(photos.filter(ok), ["place"], [F.asc("dist_m"), F.asc("photo_id")], k, "rank")


# ---- places ------------------------------------------------------------------


def rank_places(places: DataFrame, how: str, k: int) -> DataFrame:
    """The first ``k`` of a place order per park."""
    order = {
        "recorded": [F.desc("n")],
        "readers": [F.coalesce("views_pm", F.lit(-1)).desc(), F.desc("n")],
        "az": [],
        "longest": [F.coalesce("length_m", F.lit(0.0)).desc(), F.desc("n")],
    }[how]
    return top_k(places, ["park"], [*order, F.asc("name"), F.asc("id")], k, "rank")


def search_places(landmarks: DataFrame, items: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Per park the first ``k`` places whose name contains the query: landmarks, then named amenities."""
    low = query.strip().lower()
    hit = F.contains(F.lower("name"), F.lit(low)) & F.lit(bool(low))
    kind = F.when(F.col("kind") == "info", "visitor centre").otherwise(F.col("sub"))
    a = landmarks.filter(hit).select("park", "id", "name", "kind", "lon", "lat", F.lit(0).alias("src_rank"))
    b = items.filter(hit & F.col("named")).select("park", "id", "name", kind.alias("kind"), "lon", "lat", F.lit(1).alias("src_rank"))
    return top_k(a.unionByName(b), ["park"], [F.asc("src_rank"), F.asc("name"), F.asc("id")], k, "rank")


def camp_and_trail_lists(items: DataFrame, trails: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Named campgrounds that are not backcountry, and the longest trails, per park."""
    front = F.coalesce(F.try_element_at("tags", F.lit("backcountry")), F.lit("no")) != "yes"
    camps = items.filter((F.col("kind") == "camp") & F.col("named") & front)
    return (
        top_k(camps, ["park"], [F.asc("id")], k, "rank"),
        top_k(trails, ["park"], [F.desc("length_m"), F.asc("name")], k, "rank"),
    )


def top_gauges(gauges: DataFrame, k: int = 3) -> DataFrame:
    """Per park the gauges with the most flow, unknown flow last."""
    return top_k(gauges, ["park"], [F.coalesce("flow_cfs", F.lit(-1.0)).desc(), F.asc("site")], k, "rank")


# Numbers of label vectors in a block (32 MB), vectors in a block that meets several of these, and what a task multiplies at once.
LABEL_VALUES = 1 << 22
VECTOR_BLOCK = 1 << 16
VECTOR_SLICE = 256
PAIR_SLICE = 1 << 14


def _nearest_labels(vectors: pa.Table, labels: pa.Table, k: int) -> pa.Table:
    """vec_id, label and score of the ``k`` best labels of each vector: one matrix product, then exact scores of those that can be among them."""
    if not len(labels) or not len(vectors):
        return pa.table({"vec_id": vectors.column("vec_id")[:0], "label": labels.column("label")[:0], "score": pa.array([], pa.float64())})
    labels = labels.take(pc.sort_indices(labels.column("label"), null_placement="at_start"))
    b, a = _matrix(labels.column("vec")), _matrix(vectors.column("vec"))
    out = []
    for start in range(0, len(a), VECTOR_SLICE):
        part = a[start:start + VECTOR_SLICE]
        rough = part @ b.T
        edge = np.partition(rough, -k, axis=1)[:, -k] if k < len(b) else np.full(len(part), -np.inf)
        row, at = np.nonzero(rough >= edge[:, None] - 1e-9)
        score = np.concatenate([np.einsum("ij,ij->i", part[row[s:s + PAIR_SLICE]], b[at[s:s + PAIR_SLICE]]) for s in range(0, max(1, len(row)), PAIR_SLICE)])
        best = np.lexsort((at, -score, row))  # labels are in order, so ties go by label
        row, at, score = row[best], at[best], score[best]
        first = np.searchsorted(row, row)
        few = np.arange(len(row)) - first < k
        out.append((start + row[few], at[few], score[few]))
    row, at, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
    return pa.table({"vec_id": vectors.column("vec_id").take(pa.array(row)), "label": labels.column("label").take(pa.array(at)), "score": pa.array(score, pa.float64())})


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column at length 1, in double precision; lists have one length and none is zero."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def similar_labels(vectors: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Best label vectors per vector by cosine.

    ``vectors``: vec_id, vec; ``labels``: label, vec. Vectors are dealt into
    blocks, and so are labels; a block of one meets a block of the other as one
    matrix product in a task, which returns ``k`` labels per vector, and these
    are merged. Labels that fit one block are sent to the vectors, which then
    stay where they are. Vectors that are null, empty, all zero, or hold a null
    or non-finite component have no rows, and neither have vectors without a
    label of their length. Equal scores go by label; rows that repeat a vec_id
    are ranked together.
    """
    spark = vectors.sparkSession
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields + labels.schema.fields if f.name in ("vec_id", "label")}
    shape = f"vec_id {types['vec_id']}, label {types['label']}, score double"
    usable = F.coalesce(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False)
    )
    width = F.size("vec").alias("width")
    labels = materialise(labels.filter(usable).select("label", "vec", width), "labels")
    vectors = vectors.filter(usable).select("vec_id", "vec", width)
    found = spark.createDataFrame([], shape)
    for size in labels.groupBy("width").agg(F.count("*").alias("n")).collect():  # one row per length of vectors
        fit, own = labels.filter(F.col("width") == size.width).select("label", "vec"), vectors.filter(F.col("width") == size.width).select("vec_id", "vec")
        if size.n * size.width <= LABEL_VALUES:
            found = found.union(_by_one_block(own, fit, k, shape))
        else:
            found = found.union(_by_blocks(own, fit, -(-size.n * size.width // LABEL_VALUES), k, shape))
    return top_k(found, ["vec_id"], [F.desc("score"), F.asc("label")], k, "rank").select("vec_id", "rank", "label", "score")


def _by_one_block(vectors: DataFrame, labels: DataFrame, k: int, shape: str) -> DataFrame:
    """For labels of at most ``LABEL_VALUES`` numbers, which every task holds."""
    held = vectors.sparkSession.sparkContext.broadcast(labels.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _nearest_labels(pa.Table.from_batches([batch]), held.value, k).combine_chunks().to_batches()

    return vectors.mapInArrow(run, shape)


def _by_blocks(vectors: DataFrame, labels: DataFrame, blocks: int, k: int, shape: str) -> DataFrame:
    """Every block of vectors against every block of labels, each pair of blocks in a task of its own."""
    rows = materialise(vectors, "vectors")
    parts = max(1, -(-rows.count() // VECTOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c, "vec"), F.lit(n)).cast("int")
    left = rows.select(own("vec_id", parts).alias("i"), every(blocks).alias("j"), "vec_id", "vec")
    right = labels.select(every(parts).alias("i"), own("label", blocks).alias("j"), "label", "vec")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _nearest_labels(a, b, k)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, shape)
