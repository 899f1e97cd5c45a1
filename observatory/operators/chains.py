"""Frame chains: detections of consecutive frames folded into one event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.functions import geo, names
from observatory.operators.segmented import attach
from observatory.session import materialise
from observatory.sources.records import ANIMAL_CATEGORY

# Longest gap and step inside a chain, the bar for a mapped box,
# the assumed range of a camera sighting.
CHAIN_GAP_S = 60.0
CHAIN_DIST_M = 200.0
MIN_CONF = 0.5
RANGE_M = 150.0
SEGMENT_S = 3600.0


def population_filter(population: str, column: str = "is_pano") -> Column:
    """Perspective frames or panoramas, null counting as perspective."""
    pano = F.coalesce(F.col(column), F.lit(False))
    return pano if _pano(population) else ~pano


def variant_filter(population: str, column: str = "variant") -> Column:
    return F.col(column).like("yaw%") if _pano(population) else F.col(column) == "full"


def _pano(population: str) -> bool:
    if population not in ("perspective", "pano"):
        raise ValueError("population must be perspective or pano")
    return population == "pano"


def detection_frame(detections: DataFrame, predictions: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes with their prediction and frame."""
    joined = detections.join(predictions, ["image_id", "model_version", "variant"])
    return joined.join(images, "image_id")


def mark_chains(
    frames: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    gap_s: float = CHAIN_GAP_S,
    dist_m: float = CHAIN_DIST_M,
    extra: Sequence[str] = (),
    segment_s: float = SEGMENT_S,
) -> DataFrame:
    """Add ``chain``: the 1-based number of a row's chain along its key.

    A row extends the chain when its time is within ``gap_s`` and its position
    within ``dist_m`` of the previous row of the key; any null breaks it. With
    ``extra`` columns the previous row must also agree on them (W3). ``order``
    starts with ``ts_us``, the time in microseconds, and rows without a time
    close the key.

    Keys are cut into time segments, so a sequence holding most of the rows is
    still many tasks.
    """
    width = int(segment_s * 1_000_000)
    late = F.lit(9_000_000_000_000)
    cut = frames.withColumn("_seg", F.coalesce(F.floor(F.col("ts_us") / width), late))
    spot = F.struct("ts_us", "lon", "lat", *extra)

    def broken(here: Column, before: Column) -> Column:
        """1 when a row does not extend the chain of the row before it."""
        near = geo.haversine_m(here["lon"], here["lat"], before["lon"], before["lat"]) <= dist_m
        same = near & (F.abs(here["ts_us"] - before["ts_us"]) <= int(gap_s * 1_000_000))
        for c in extra:
            same = same & here[c].eqNullSafe(before[c])
        return (~F.coalesce(same, F.lit(False))).cast("bigint")

    inside = W.partitionBy(*keys, "_seg").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    # breaks inside the segment; its first row is settled below
    local = (
        cut.withColumn("_prev", F.lag(spot).over(inside))
        .withColumn("_brk", F.when(F.col("_prev").isNotNull(), broken(spot, F.col("_prev"))).otherwise(F.lit(0).cast("bigint")))
        .withColumn("_run", F.sum("_brk").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    )
    # written once, because the rows and their segment summary both start here
    local = materialise(local.drop("_prev"), "chains")
    at = F.struct(*order)
    summary = local.groupBy(*keys, "_seg").agg(
        F.min_by(spot, at).alias("_head"), F.max_by(spot, at).alias("_tail"), F.sum("_brk").alias("_n")
    )
    across = W.partitionBy(*keys).orderBy("_seg")
    before = F.lag("_tail").over(across)
    opened = summary.withColumn("_open", F.when(before.isNotNull(), broken(F.col("_head"), before)).otherwise(F.lit(1).cast("bigint")))
    upto = F.sum(F.col("_n") + F.col("_open")).over(across.rowsBetween(W.unboundedPreceding, W.currentRow))
    carried = opened.withColumn("_base", upto - F.col("_n"))
    joined = attach(local, carried, [*keys, "_seg"], ["_base"])
    return joined.withColumn("chain", F.col("_base") + F.col("_run")).drop("_base", "_run", "_brk", "_seg")


def frame_boxes(boxes: DataFrame, min_conf: float) -> DataFrame:
    """Qualifying boxes counted per frame and label: boxes of one frame never merge."""
    return (
        boxes.filter((F.col("category") == ANIMAL_CATEGORY) & (F.col("conf") >= min_conf))
        .groupBy("corridor", "sequence_id", "image_id", "ts_us", "lon", "lat", "prediction")
        .agg(F.count("*").alias("n_boxes"))
    )


def cluster_detections(
    boxes: DataFrame, min_conf: float = 0.2, gap_s: float = CHAIN_GAP_S, dist_m: float = CHAIN_DIST_M
) -> DataFrame:
    """Per corridor: boxes, images, chains, individuals and the duplicate rate."""
    frames = frame_boxes(boxes, min_conf)
    chained = mark_chains(
        frames, ["corridor", "sequence_id", "prediction"], ["ts_us", "image_id"], gap_s, dist_m
    )
    chains = chained.groupBy("corridor", "sequence_id", "prediction", "chain").agg(
        F.max("n_boxes").alias("largest"), F.sum("n_boxes").alias("boxes")
    )
    totals = chains.groupBy("corridor").agg(
        F.sum("boxes").alias("n_boxes"), F.count("*").alias("n_clusters"), F.sum("largest").alias("n_individuals")
    )
    images = frames.groupBy("corridor").agg(F.count_distinct("image_id").alias("n_images"))
    return totals.join(images, "corridor").withColumn(
        "duplicate_rate", 1 - F.col("n_individuals") / F.col("n_boxes")
    )


def cluster_detections_v1(
    boxes: DataFrame, min_conf: float = 0.2, gap_s: float = CHAIN_GAP_S, dist_m: float = CHAIN_DIST_M
) -> DataFrame:
    """Superseded: chains single boxes against the previous row of the whole sequence."""
    rows = boxes.filter((F.col("category") == ANIMAL_CATEGORY) & (F.col("conf") >= min_conf))
    chained = mark_chains(
        rows, ["corridor", "sequence_id"], ["ts_us", "image_id", "det_idx"], gap_s, dist_m, extra=["prediction"]
    )
    per_sequence = chained.groupBy("corridor", "sequence_id").agg(
        F.count("*").alias("boxes"), F.max("chain").alias("clusters")
    )
    return per_sequence.groupBy("corridor").agg(
        F.sum("boxes").alias("n_boxes"), F.sum("clusters").alias("n_clusters")
    )


def qualifying_boxes(boxes: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """Animal boxes confident enough and not labelled as something else."""
    return boxes.filter(
        (F.col("category") == ANIMAL_CATEGORY)
        & (F.col("conf") >= min_conf)
        & ~names.is_excluded(F.col("prediction"))
    )


def box_filter_counts(boxes: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """How many animal boxes each rule drops, per corridor (P5)."""
    low = F.col("conf") < min_conf
    label = ~low & names.is_excluded(F.col("prediction"))
    return (
        boxes.filter(F.col("category") == ANIMAL_CATEGORY)
        .groupBy("corridor")
        .agg(
            F.count("*").alias("n_in"),
            F.count_if(~low & ~label).alias("n_kept"),
            F.count_if(low).alias("dropped_conf"),
            F.count_if(label).alias("dropped_label"),
        )
    )


def species_chains(
    boxes: DataFrame, min_conf: float = MIN_CONF, gap_s: float = CHAIN_GAP_S, dist_m: float = CHAIN_DIST_M
) -> DataFrame:
    """Qualifying boxes with their resolved species and chain number."""
    kept = qualifying_boxes(boxes, min_conf).withColumn(
        "sp", names.resolve_species(F.col("prediction"), F.col("prediction_score"))
    )
    # the strongest box of a frame comes first, so order on the negated score
    ordered = kept.withColumn("species", F.col("sp.scientific_name")).withColumn("_neg", -F.col("conf"))
    order = ["ts_us", "image_id", "_neg", "det_idx"]
    return mark_chains(ordered, ["corridor", "sequence_id", "species"], order, gap_s, dist_m)


def chain_members(chained: DataFrame) -> DataFrame:
    """One row per box with its chain (the whole membership, flat)."""
    return chained.select("corridor", "sequence_id", "species", "chain", "image_id", "variant", "det_idx")


def detections_to_sightings(
    boxes: DataFrame,
    park: Column,
    min_conf: float = MIN_CONF,
    gap_s: float = CHAIN_GAP_S,
    dist_m: float = CHAIN_DIST_M,
) -> DataFrame:
    """One model-predicted sighting per chain of one resolved species.

    The strongest box speaks for the chain (the earliest one on a tie). Every
    aggregate is fixed size; the member images of a chain, which have no bound,
    are the flat table ``chain_members``.
    """
    chained = species_chains(boxes, min_conf, gap_s, dist_m)
    best = F.min_by(
        F.struct(
            "image_id", "variant", "det_idx", "conf", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "prediction",
            "prediction_score", "model_version", "sp", "ts_us", "captured_at", "lon", "lat", "bearing",
            "creator_username", "license", "source_url", "width", "height",
        ),
        F.struct("_neg", "ts_us", "image_id", "det_idx"),
    )
    per_chain = chained.groupBy("corridor", "sequence_id", "species", "chain").agg(
        best.alias("b"),
        F.count("*").alias("chain_boxes"),
        F.count_distinct("image_id").alias("chain_frames"),
    )
    b = F.col("b")
    sid = F.concat_ws(":", b["image_id"], b["variant"], b["det_idx"].cast("string"))
    provenance = F.to_json(
        F.struct(
            "corridor",
            b["image_id"].alias("image_id"),
            b["variant"].alias("variant"),
            b["det_idx"].alias("det_idx"),
            b["conf"].alias("detector_conf"),
            F.array(b["bbox_x"], b["bbox_y"], b["bbox_w"], b["bbox_h"]).alias("bbox"),
            b["prediction"].alias("ensemble_label"),
            b["prediction_score"].alias("ensemble_score"),
            b["bearing"].alias("camera_bearing_deg"),
            b["width"].alias("frame_width"),
            b["height"].alias("frame_height"),
            F.col("chain_boxes").alias("chain_frames"),
            F.lit(RANGE_M).alias("range_m_assumed"),
        )
    )
    from observatory.functions.text import attribution

    return per_chain.select(
        F.concat(F.lit("mapillary_cv:"), sid).alias("sighting_id"),
        F.lit("mapillary_cv").alias("source"),
        sid.alias("source_id"),
        b["model_version"].alias("dataset"),
        park.alias("park"),
        F.lit("model_predicted").alias("confidence_basis"),
        F.lit(None).cast("string").alias("taxon_id"),
        b["sp"]["scientific_name"].alias("scientific_name"),
        b["sp"]["common_name"].alias("common_name"),
        b["sp"]["taxon_rank"].alias("taxon_rank"),
        F.lit("Mammalia").alias("taxon_class"),
        b["captured_at"].alias("observed_at"),
        b["captured_at"].cast("date").alias("observed_on"),
        b["lon"].alias("lon"),
        b["lat"].alias("lat"),
        F.lit(RANGE_M).alias("positional_accuracy_m"),
        F.when(b["lon"].isNotNull(), "open").otherwise("missing").alias("coordinate_status"),
        b["creator_username"].alias("observer"),
        b["license"].alias("license"),
        b["source_url"].alias("url"),
        attribution("mapillary_cv", b["creator_username"], b["license"], b["source_url"], b["model_version"]).alias("attribution"),
        F.lit(None).cast("string").alias("duplicate_of"),
        provenance.alias("raw_json"),
        "corridor",
        "chain_boxes",
        "chain_frames",
    )


def boxes_of(detections: DataFrame, model_version: str, variant: str, min_conf: float, image_id: str | None = None) -> DataFrame:
    """Animal boxes above a confidence, of one frame or of all (P15); every test pushes to the scan."""
    boxes = detections.filter(
        (F.col("model_version") == model_version)
        & (F.col("variant") == variant)
        & (F.col("category") == ANIMAL_CATEGORY)
        & (F.col("conf") >= min_conf)
    )
    if image_id is not None:
        boxes = boxes.filter(F.col("image_id") == image_id)
    return boxes.select("image_id", "det_idx", "conf", "bbox_x", "bbox_y", "bbox_w", "bbox_h")
