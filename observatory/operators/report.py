"""The detection report's numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.functions import names, stats
from observatory.operators import quality
from observatory.operators.chains import MIN_CONF, population_filter, variant_filter
from observatory.operators.segmented import exact_percentiles

# The share of right names a band needs, and on how many boxes.
SPECIES_TARGET = 0.6
SPECIES_MIN_N = 15


def volume_counts(
    images: DataFrame, downloads: DataFrame, predictions: DataFrame, population: str = "perspective", approximate: bool = False
) -> DataFrame:
    """Indexed, downloaded, failed and predicted counts per corridor.

    Three aggregations, one per input, joined on the corridor.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    chosen = population_filter(population)
    img = images.groupBy("corridor").agg(F.count("*").alias("n_indexed_all"), F.count_if(chosen).alias("n_indexed"))
    frame = images.select("image_id", "corridor", "is_pano")
    dl = (
        downloads.select("image_id", "error")
        .join(frame.filter(chosen), "image_id")
        .groupBy("corridor")
        .agg(
            F.count_if(F.col("error").isNull()).alias("n_downloaded"),
            F.count_if(F.col("error").isNotNull()).alias("n_download_failed"),
        )
    )
    pr = (
        predictions.filter(variant_filter(population))
        .select("image_id", "model_version", "failures")
        .join(frame, "image_id")
        .groupBy("corridor")
        .agg(
            distinct("image_id").alias("n_predicted"),
            F.count("*").alias("n_variants_predicted"),
            F.count_if(F.col("failures").isNotNull()).alias("n_model_failures"),
            F.count_distinct("model_version").alias("n_model_versions"),
        )
    )
    out = img.join(dl, "corridor", "left").join(pr, "corridor", "left")
    return out.fillna(0)


def hit_rates(
    predictions: DataFrame, images: DataFrame, thresholds: Sequence[float] = stats.THRESHOLDS, population: str = "perspective"
) -> DataFrame:
    """Share of images with an animal at each threshold, with its interval.

    An image's best score is taken first; thresholds are then unrolled from a
    constant array over one row per image.
    """
    per_image = (
        predictions.filter(variant_filter(population))
        .join(images.select("image_id", "corridor"), "image_id")
        .groupBy("corridor", "image_id")
        .agg(F.max("max_animal_conf").alias("best"))
    )
    at = [F.count_if(F.col("best") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)]
    wide = per_image.groupBy("corridor").agg(F.count("*").alias("n"), *at)
    long = wide.select(
        "corridor",
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("k")) for i, t in enumerate(thresholds)])
        ).alias("r"),
    ).select("corridor", "n", "r.*")
    ci = stats.wilson(F.col("k"), F.col("n"))
    return long.withColumn("frac", stats.safe_ratio(F.col("k"), F.col("n"))).withColumn("lo", ci["lo"]).withColumn("hi", ci["hi"])


def threshold_sweep(
    detections: DataFrame, images: DataFrame, cuts: Sequence[float], category: str = "1", population: str = "perspective"
) -> DataFrame:
    """Boxes at or above each cut, and their percent, per corridor in one pass.

    The cuts are columns of one conditional aggregation; they become rows only
    after it, so no row of the table meets a list of thresholds.
    """
    at = [F.count_if(F.col("conf") >= t).alias(f"t{i}") for i, t in enumerate(cuts)]
    boxes = detections.filter((F.col("category") == category) & variant_filter(population)).select("image_id", "conf")
    wide = boxes.join(images.select("image_id", "corridor"), "image_id").groupBy("corridor").agg(F.count("*").alias("n"), *at)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("k")) for i, t in enumerate(cuts)])
    long = wide.select("corridor", "n", F.explode(rows).alias("r"))
    return long.select("corridor", "r.threshold", "r.k", "n", (stats.safe_ratio(F.col("r.k"), F.col("n")) * 100).alias("pct"))


def images_with(detections: DataFrame, images: DataFrame, category: str, min_conf: float, population: str = "perspective") -> DataFrame:
    """Distinct images with a box of a category, per corridor."""
    return (
        detections.filter((F.col("category") == category) & (F.col("conf") >= min_conf) & variant_filter(population))
        .join(images.select("image_id", "corridor"), "image_id")
        .groupBy("corridor")
        .agg(F.count_distinct("image_id").alias("n_images"))
    )


def top_labels(predictions: DataFrame, images: DataFrame, min_conf: float, k: int = 12, population: str = "perspective") -> DataFrame:
    """Most frequent labels per corridor of frames with an animal (T2), limited below the exchange."""
    counts = (
        predictions.filter(variant_filter(population) & (F.col("max_animal_conf") >= min_conf))
        .select("image_id", "prediction")
        .join(images.select("image_id", "corridor"), "image_id")
        .groupBy("corridor", "prediction")
        .agg(F.count("*").alias("n"))
    )
    best = W.partitionBy("corridor").orderBy(F.desc("n"), "prediction")
    top = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.withColumn("label", names.display_name(F.col("prediction")))


def label_scores(predictions: DataFrame, images: DataFrame, population: str = "perspective") -> DataFrame:
    """Frames and mean score per corridor and label."""
    rows = predictions.filter(variant_filter(population)).select("image_id", "prediction", "prediction_score")
    return rows.join(images.select("image_id", "corridor"), "image_id").groupBy("corridor", "prediction").agg(
        F.count_distinct("image_id").alias("n_images"), F.avg("prediction_score").alias("mean_score")
    )


def reviews_of(reviews: DataFrame, reviewer: str | None, population: str) -> DataFrame:
    """One reviewer's rows of one population; two reviewers' rows are never pooled."""
    return quality.single_reviewer(reviews.filter(variant_filter(population)), reviewer)


def reviewed_boxes(
    reviews: DataFrame, detections: DataFrame, images: DataFrame, reviewer: str | None = None, population: str = "perspective", match_model: bool = False
) -> DataFrame:
    """Verdicts of one reviewer and population with their box and corridor.

    The key has no model version, so a box scored by two models counts twice;
    ``match_model`` adds it when the reviews carry one. Without a ``reviewer``
    the rows must be of one only.
    """
    keys = ["image_id", "variant", "det_idx"] + (["model_version"] if match_model else [])
    mine = reviews_of(reviews, reviewer, population)
    return mine.join(detections.select(*keys, "conf"), keys).join(images.select("image_id", "corridor"), "image_id")


def _verdicts() -> list[Column]:
    def n(v: str) -> Column:
        return F.count_if(F.col("verdict") == v).alias(v)

    return [F.count("*").alias("n"), n("tp"), n("fp"), n("unsure")]


def precision_by_band(reviewed: DataFrame) -> DataFrame:
    """Precision per corridor and band with the total, in one pass."""
    banded = reviewed.withColumn("band", F.coalesce(stats.band_of(F.col("conf")), F.lit("out")))
    agg = banded.groupingSets([["corridor"], ["corridor", "band"]], "corridor", "band").agg(*_verdicts())
    judged = F.col("tp") + F.col("fp")
    ci = stats.wilson(F.col("tp"), judged)
    return (
        agg.withColumn("band", F.coalesce("band", F.lit("(all)")))
        .withColumn("precision", stats.safe_ratio(F.col("tp"), judged))
        .withColumn("lo", ci["lo"])
        .withColumn("hi", ci["hi"])
    )


def band_verdicts(reviewed: DataFrame) -> DataFrame:
    """Band by verdict contingency table per corridor."""
    return (
        reviewed.withColumn("band", stats.band_of(F.col("conf")))
        .groupBy("corridor", "band")
        .pivot("verdict", ["tp", "fp", "unsure"])
        .count()
        .fillna(0)
    )


def species_precision(reviews: DataFrame, predictions: DataFrame, reviewer: str | None = None, population: str = "perspective") -> DataFrame:
    """Right names per score band by one reviewer, and whether the bar can sit there.

    ``bar`` holds when the band and every band above it clear the target on
    enough boxes: a running minimum over four rows.
    """
    reviews = reviews_of(reviews, reviewer, population)
    wanted = predictions.filter(variant_filter(population)).join(reviews.select("image_id", "variant"), ["image_id", "variant"], "left_semi")
    score = wanted.groupBy("image_id", "variant").agg(F.max("prediction_score").alias("s"))
    rows = reviews.join(score, ["image_id", "variant"], "left").withColumn(
        "band", stats.band_of(F.col("s"), stats.SPECIES_BANDS, outside=None)
    )
    tp = F.col("verdict") == "tp"
    agree = F.coalesce("species_agree", F.lit("na"))
    judged = tp & (agree != "na")
    agg = (
        rows.filter(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.count("*").alias("n"),
            F.count_if(tp).alias("tp"),
            F.count_if(F.col("verdict") == "fp").alias("fp"),
            F.count_if(judged).alias("judged"),
            F.count_if(judged & (agree == "yes")).alias("exact"),
            F.count_if(judged & (agree == "rollup")).alias("rollup"),
        )
    )
    ci = stats.wilson(F.col("exact"), F.col("judged"))
    out = (
        agg.withColumn("wrong", F.col("judged") - F.col("exact") - F.col("rollup"))
        .withColumn("animal_precision", stats.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("species_precision", stats.safe_ratio(F.col("exact"), F.col("judged")))
        .withColumn("lo", ci["lo"])
        .withColumn("hi", ci["hi"])
    )
    passes = (F.col("judged") >= SPECIES_MIN_N) & (F.coalesce("species_precision", F.lit(0.0)) >= SPECIES_TARGET)
    above = W.partitionBy(F.lit(1)).orderBy("band").rowsBetween(W.currentRow, W.unboundedFollowing)
    # a band nobody reviewed fails, and so does every band below it
    bands_above = F.count("*").over(above)
    order = F.array_position(F.array(*[F.lit(b) for b in stats.band_labels(stats.SPECIES_BANDS)]), F.col("band"))
    whole = bands_above == len(stats.SPECIES_BANDS) - order + 1
    return out.withColumn("bar", whole & (F.min(passes.cast("int")).over(above) == 1))


def distance_percentiles(reviewed: DataFrame, keys: Sequence[str], fractions: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Median, p90 and longest distance of true positives."""
    rows = reviewed.filter((F.col("verdict") == "tp") & F.col("est_distance_m").isNotNull())
    return exact_percentiles(rows, list(keys), "est_distance_m", fractions, width=25.0)


def distance_histogram(reviewed: DataFrame, width: float = 25.0) -> DataFrame:
    """True positives per corridor and distance bin."""
    return (
        reviewed.filter((F.col("verdict") == "tp") & F.col("est_distance_m").isNotNull())
        .groupBy("corridor", (F.floor(F.col("est_distance_m") / width) * width).alias("bin_m"))
        .agg(F.count("*").alias("n"))
    )


def majority_baseline(reviews: DataFrame, images: DataFrame) -> DataFrame:
    """Most common reviewed species per corridor and its share."""
    name = F.lower(F.trim("true_species"))
    counts = (
        reviews.filter((F.col("verdict") == "tp") & (F.length(name) > 0))
        .join(images.select("image_id", "corridor"), "image_id")
        .groupBy("corridor", name.alias("species"))
        .agg(F.count("*").alias("k"))
    )
    return (
        counts.groupBy("corridor")
        .agg(F.sum("k").alias("n"), F.max(F.struct("k", "species")).alias("top"))
        .select("corridor", "n", "top.species", (F.col("top.k") / F.col("n")).alias("accuracy"))
    )


def image_density(images: DataFrame, road_km: float | None = None) -> DataFrame:
    """Dates, sequences, contributors and panoramas per corridor."""
    out = images.groupBy("corridor").agg(
        F.count("*").alias("n_images"),
        F.min("captured_at").alias("first"),
        F.max("captured_at").alias("last"),
        F.count_distinct("sequence_id").alias("n_sequences"),
        F.count_distinct("creator_username").alias("n_contributors"),
        F.count_if(F.coalesce("is_pano", F.lit(False))).alias("n_pano"),
    )
    return out if not road_km else out.withColumn("images_per_road_km", F.col("n_images") / road_km)


def image_facets(images: DataFrame) -> DataFrame:
    """Images per year, month and camera type: one pass over three grouping sets."""
    rows = images.select(
        "corridor", F.year("captured_at").alias("y"), F.month("captured_at").alias("m"),
        F.coalesce("camera_type", F.lit("unknown")).alias("camera"),
    )
    agg = rows.groupingSets(
        [["corridor", "y"], ["corridor", "m"], ["corridor", "camera"]], "corridor", "y", "m", "camera"
    ).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    facet = F.when(F.col("gid") == 3, "year").when(F.col("gid") == 5, "month").otherwise("camera")
    value = F.coalesce(F.col("y").cast("string"), F.col("m").cast("string"), "camera")
    return agg.select("corridor", facet.alias("facet"), value.alias("value"), "n")


def camera_pass(
    images: DataFrame, predictions: DataFrame, sightings: DataFrame, reviews: DataFrame, corridors: DataFrame
) -> DataFrame:
    """Camera-pass summary per corridor.

    ``corridors`` lists every corridor with its park, so one nobody indexed
    still shows as planned. Species names become a map bounded by vocabulary.
    """
    full = predictions.filter(F.col("variant") == "full").join(images.select("image_id", "corridor"), "image_id")
    scored = full.groupBy("corridor", "image_id").agg(F.max("max_animal_conf").alias("best"))
    frames = scored.groupBy("corridor").agg(
        F.count("*").alias("frames_scored"), F.count_if(F.col("best") >= MIN_CONF).alias("frames_with_animal")
    )
    img = images.groupBy("corridor").agg(
        F.count("*").alias("images_indexed"),
        F.count_distinct("creator_username").alias("contributors"),
        F.min(F.year("captured_at")).alias("y0"),
        F.max(F.year("captured_at")).alias("y1"),
        stats.month_counts(F.month("captured_at")).alias("months"),
    )
    mine = sightings.filter((F.col("source") == "mapillary_cv") & F.col("duplicate_of").isNull()).withColumn(
        "corridor", F.get_json_object("raw_json", "$.corridor")
    )
    by_name = mine.groupBy("corridor", "scientific_name").agg(F.count("*").alias("k"))
    unnamed = F.col("scientific_name") == names.UNIDENTIFIED_NAME
    named = by_name.groupBy("corridor").agg(
        F.sum("k").alias("sightings"),
        F.coalesce(F.sum(F.when(~unnamed, F.col("k"))), F.lit(0)).alias("named"),
        F.map_from_entries(F.collect_list(F.when(~unnamed, F.struct("scientific_name", "k")))).alias("species_named"),
    )
    chosen = quality.choose_reviewer(
        reviews.filter(F.col("variant") == "full").join(images.select("image_id", "corridor"), "image_id"), ["corridor"]
    )
    out = (
        corridors.join(img, "corridor", "left")
        .join(frames, "corridor", "left")
        .join(named, "corridor", "left")
        .join(chosen, "corridor", "left")
        .fillna(0, ["images_indexed", "contributors", "frames_scored", "frames_with_animal", "sightings", "named"])
    )
    status = (
        F.when(F.col("frames_scored") == 0, "planned").when(F.col("reviewer").isNotNull(), "reviewed").otherwise("unreviewed")
    )
    return out.withColumn("unnamed", F.col("sightings") - F.col("named")).withColumn("status", status)


def compare_runs(a: DataFrame, b: DataFrame, tol: float) -> DataFrame:
    """Two detector runs: mismatches, largest differences and files that one run lacks.

    Inputs are prediction items; boxes are compared by position inside the
    joined row, so only file names are shuffled. Runs are identical only when
    they hold the same files.
    """
    l, r = a.alias("a"), b.alias("b")
    joined = l.join(r, names.file_stem(F.col("a.filepath")) == names.file_stem(F.col("b.filepath")), "full_outer")
    da, db = F.col("a.detections"), F.col("b.detections")
    shared = F.least(F.size(da), F.size(db))

    def head(x: Column) -> Column:
        return F.slice(x, F.lit(1), shared)

    conf_diff = F.array_max(F.zip_with(head(da), head(db), lambda x, y: F.abs(x["conf"] - y["conf"])))
    box_diff = F.array_max(
        F.zip_with(
            head(da), head(db), lambda x, y: F.array_max(F.zip_with(x["bbox"], y["bbox"], lambda u, v: F.abs(u - v)))
        )
    )
    sa, sb = F.col("a.classifications.scores"), F.col("b.classifications.scores")
    score_diff = F.array_max(F.zip_with(sa, sb, lambda x, y: F.abs(x - y)))
    both = F.col("a.filepath").isNotNull() & F.col("b.filepath").isNotNull()
    rows = joined.select(
        both.alias("both"), F.col("b.filepath").isNull().alias("only_a"), F.col("a.filepath").isNull().alias("only_b"),
        (~F.col("a.prediction").eqNullSafe(F.col("b.prediction"))).alias("label"),
        (F.size(da) != F.size(db)).alias("boxes"),
        F.greatest(conf_diff, score_diff, F.lit(0.0)).alias("score_diff"),
        F.coalesce(box_diff, F.lit(0.0)).alias("box_diff"),
    )
    out = rows.agg(
        F.count_if("both").alias("n"),
        F.count_if("only_a").alias("only_a"),
        F.count_if("only_b").alias("only_b"),
        F.count_if(F.col("both") & F.col("label")).alias("label_mismatch"),
        F.count_if(F.col("both") & F.col("boxes")).alias("box_count_mismatch"),
        F.coalesce(F.max(F.when(F.col("both"), F.col("score_diff"))), F.lit(0.0)).alias("max_score_diff"),
        F.coalesce(F.max(F.when(F.col("both"), F.col("box_diff"))), F.lit(0.0)).alias("max_box_diff"),
    )
    same = (
        (F.col("only_a") + F.col("only_b") + F.col("label_mismatch") + F.col("box_count_mismatch") == 0)
        & (F.col("max_score_diff") <= tol) & (F.col("max_box_diff") <= tol)
    )
    return out.withColumn("identical", same)
