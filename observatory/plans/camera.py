"""Queries over street images, detections, predictions and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from observatory.functions import names, stats
from observatory.operators import chains, quality, report, rollups, sampling
from observatory.plans import testbed as tb
from observatory.plans.registry import query
from observatory.sources import records

# Chains on the test tables: events of one user and type are days apart.
GAP_S, DIST_M = 259200.0, 2500.0
GAP_US = int(GAP_S * 1e6)


def o(sql: str, *ctes: str, extra: str = "") -> str:
    return tb.oracle(sql, *ctes, extra=extra)


W95 = """round(greatest(0e0, ({k} / CAST({n} AS DOUBLE) + 3.8416e0 / (2 * {n})) / (1 + 3.8416e0 / {n})
 - 1.96e0 * sqrt(({k} / CAST({n} AS DOUBLE)) * (1 - {k} / CAST({n} AS DOUBLE)) / {n} + 3.8416e0 / (4e0 * {n} * {n})) / (1 + 3.8416e0 / {n})), 6) AS lo,
 round(least(1e0, ({k} / CAST({n} AS DOUBLE) + 3.8416e0 / (2 * {n})) / (1 + 3.8416e0 / {n})
 + 1.96e0 * sqrt(({k} / CAST({n} AS DOUBLE)) * (1 - {k} / CAST({n} AS DOUBLE)) / {n} + 3.8416e0 / (4e0 * {n} * {n})) / (1 + 3.8416e0 / {n})), 6) AS hi"""


def wilson_sql(k: str, n: str) -> str:
    return W95.format(k=k, n=n)


def rounded(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


NAME_OF = """CASE WHEN prediction IS NULL OR prediction = '' THEN '' WHEN prediction LIKE '%;no cv result;%' THEN 'unknown'
 WHEN length(prediction) - length(replace(prediction, ';', '')) <> 6 THEN prediction ELSE split_part(prediction, ';', 7) END"""
DISPLAY = f"""CASE WHEN length(prediction) - length(replace(prediction, ';', '')) <> 6 THEN prediction WHEN prediction LIKE '%;no cv result;%' THEN 'unknown'
 WHEN split_part(prediction, ';', 7) <> '' THEN split_part(prediction, ';', 7) WHEN split_part(prediction, ';', 6) <> '' THEN split_part(prediction, ';', 6) || ' (species)'
 WHEN split_part(prediction, ';', 5) <> '' THEN split_part(prediction, ';', 5) || ' (genus)' WHEN split_part(prediction, ';', 4) <> '' THEN split_part(prediction, ';', 4) || ' (family)'
 ELSE prediction END"""

_CHAIN = """frames AS (SELECT corridor, sequence_id, image_id, ts_us, lon, lat, prediction, count(*) AS n_boxes FROM boxes
   WHERE category = '1' AND conf >= 0.2e0 GROUP BY ALL),
 lagged AS (SELECT *, lag(ts_us) OVER w AS p_ts, lag(lon) OVER w AS p_lon, lag(lat) OVER w AS p_lat FROM frames
   WINDOW w AS (PARTITION BY {keys} ORDER BY ts_us NULLS LAST, image_id)),
 chained AS (SELECT *, sum(CASE WHEN abs(ts_us - p_ts) <= {gap} AND {hav} <= {dist}e0 THEN 0 ELSE 1 END)
   OVER (PARTITION BY {keys} ORDER BY ts_us NULLS LAST, image_id ROWS UNBOUNDED PRECEDING) AS chain FROM lagged)"""
_HAVP = """2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin((radians(lat) - radians(p_lat)) / 2), 2)
 + cos(radians(p_lat)) * cos(radians(lat)) * pow(sin(radians(lon - p_lon) / 2), 2))))"""
CHAINED = _CHAIN.format(keys="corridor, sequence_id, prediction", gap=GAP_US, hav=_HAVP, dist=DIST_M)


@query(
    "frame_chains",
    o(
        """SELECT corridor, sequence_id, prediction, CAST(chain AS BIGINT) AS chain, count(*) AS frames, CAST(max(n_boxes) AS BIGINT) AS largest FROM chained GROUP BY ALL""",
        "boxes", extra=CHAINED,
    ),
)
def frame_chains(spark, sf):
    frames = chains.frame_boxes(tb.boxes(spark, sf), 0.2)
    out = chains.mark_chains(
        frames, ["corridor", "sequence_id", "prediction"], ["ts_us", "image_id"], GAP_S, DIST_M, segment_s=86400.0
    )
    return out.groupBy("corridor", "sequence_id", "prediction", "chain").agg(
        F.count("*").alias("frames"), F.max("n_boxes").alias("largest")
    )


@query(
    "individuals_estimate",
    o(
        """SELECT corridor, CAST(sum(b) AS BIGINT) AS n_boxes, count(*) AS n_clusters, CAST(sum(m) AS BIGINT) AS n_individuals,
     (SELECT count(DISTINCT image_id) FROM frames f WHERE f.corridor = c.corridor) AS n_images, round(1 - CAST(sum(m) AS DOUBLE) / CAST(sum(b) AS DOUBLE), 6) AS duplicate_rate
     FROM (SELECT corridor, sequence_id, prediction, chain, sum(n_boxes) AS b, max(n_boxes) AS m FROM chained GROUP BY ALL) c GROUP BY corridor""",
        "boxes", extra=CHAINED,
    ),
)
def individuals(spark, sf):
    return rounded(chains.cluster_detections(tb.boxes(spark, sf), 0.2, GAP_S, DIST_M), "duplicate_rate")


@query(
    "individuals_estimate_superseded",
    o(
        f"""SELECT corridor, count(*) AS n_boxes, CAST(sum(CASE WHEN prediction = p_l AND abs(ts_us - p_ts) <= {GAP_US} AND {_HAVP} <= {DIST_M}e0 THEN 0 ELSE 1 END) AS BIGINT) AS n_clusters
     FROM (SELECT *, lag(ts_us) OVER w AS p_ts, lag(lon) OVER w AS p_lon, lag(lat) OVER w AS p_lat, lag(prediction) OVER w AS p_l FROM boxes
      WHERE category = '1' AND conf >= 0.2e0 WINDOW w AS (PARTITION BY corridor, sequence_id ORDER BY ts_us NULLS LAST, image_id, det_idx)) GROUP BY corridor""",
        "boxes",
    ),
)
def individuals_v1(spark, sf):
    return chains.cluster_detections_v1(tb.boxes(spark, sf), 0.2, GAP_S, DIST_M)


_KEEP = f"""kept AS (SELECT *, CASE WHEN split_part(prediction, ';', 6) <> '' AND prediction NOT LIKE '%;no cv result;%' AND prediction_score >= 0.8e0
   AND upper(substr(split_part(prediction, ';', 5), 1, 1)) || substr(split_part(prediction, ';', 5), 2) || ' ' || split_part(prediction, ';', 6) NOT IN
     ('Bos taurus', 'Canis familiaris', 'Felis catus', 'Equus caballus', 'Ovis aries', 'Capra hircus', 'Sus scrofa')
   THEN upper(substr(split_part(prediction, ';', 5), 1, 1)) || substr(split_part(prediction, ';', 5), 2) || ' ' || split_part(prediction, ';', 6)
   ELSE 'Mammalia' END AS species FROM boxes WHERE category = '1' AND conf >= 0.5e0 AND {NAME_OF} NOT IN ('human', 'vehicle', 'blank')),
 klag AS (SELECT *, lag(ts_us) OVER w AS p_ts, lag(lon) OVER w AS p_lon, lag(lat) OVER w AS p_lat FROM kept
   WINDOW w AS (PARTITION BY corridor, sequence_id, species ORDER BY ts_us NULLS LAST, image_id, conf DESC, det_idx)),
 kch AS (SELECT *, sum(CASE WHEN abs(ts_us - p_ts) <= {GAP_US} AND {_HAVP} <= {DIST_M}e0 THEN 0 ELSE 1 END)
   OVER (PARTITION BY corridor, sequence_id, species ORDER BY ts_us NULLS LAST, image_id, conf DESC, det_idx ROWS UNBOUNDED PRECEDING) AS chain FROM klag)"""


@query(
    "detections_to_sightings",
    o(
        """SELECT 'mapillary_cv:' || image_id || ':' || variant || ':' || det_idx AS sighting_id, corridor, species AS scientific_name,
     CASE WHEN species = 'Mammalia' THEN 'class' ELSE 'species' END AS taxon_rank, CASE WHEN lon IS NULL THEN 'missing' ELSE 'open' END AS coordinate_status,
     chain_boxes, chain_frames FROM (SELECT *, count(*) OVER c AS chain_boxes, row_number() OVER (PARTITION BY corridor, sequence_id, species, chain
       ORDER BY conf DESC, ts_us NULLS FIRST, image_id, det_idx) AS rn FROM kch WINDOW c AS (PARTITION BY corridor, sequence_id, species, chain)) b
     JOIN (SELECT corridor, sequence_id, species, chain, count(DISTINCT image_id) AS chain_frames FROM kch GROUP BY ALL) f USING (corridor, sequence_id, species, chain)
     WHERE rn = 1""",
        "boxes", extra=_KEEP,
    ),
)
def to_sightings(spark, sf):
    out = chains.detections_to_sightings(tb.boxes(spark, sf), F.lit("park0"), gap_s=GAP_S, dist_m=DIST_M)
    return out.select(
        "sighting_id", "corridor", "scientific_name", "taxon_rank", "coordinate_status", "chain_boxes", "chain_frames"
    )


@query(
    "chain_members",
    o("SELECT corridor, sequence_id, species, CAST(chain AS BIGINT) AS chain, image_id, variant, det_idx FROM kch", "boxes", extra=_KEEP),
)
def chain_members(spark, sf):
    return chains.chain_members(chains.species_chains(tb.boxes(spark, sf), gap_s=GAP_S, dist_m=DIST_M))


@query(
    "box_filter_counts",
    o(
        f"""SELECT corridor, count(*) AS n_in, count(*) FILTER (conf >= 0.5e0 AND nm NOT IN ('human', 'vehicle', 'blank')) AS n_kept,
     count(*) FILTER (conf < 0.5e0) AS dropped_conf, count(*) FILTER (conf >= 0.5e0 AND nm IN ('human', 'vehicle', 'blank')) AS dropped_label
     FROM (SELECT *, {NAME_OF} AS nm FROM boxes WHERE category = '1') GROUP BY corridor""",
        "boxes",
    ),
)
def box_filters(spark, sf):
    return chains.box_filter_counts(tb.boxes(spark, sf))


@query(
    "boxes_of_frame",
    o(
        """SELECT image_id, det_idx, conf FROM detections WHERE category = '1' AND conf >= 0.3e0 AND model_version = 'v1' AND variant = 'full'""",
        "detections",
    ),
)
def boxes_of(spark, sf):
    return chains.boxes_of(tb.detections(spark, sf), "v1", "full", 0.3).select("image_id", "det_idx", "conf")


@query(
    "display_names",
    o(f"SELECT prediction, {DISPLAY} AS shown, {NAME_OF} AS tested, count(*) AS n FROM predictions GROUP BY ALL", "predictions"),
)
def display_names(spark, sf):
    p = tb.predictions(spark, sf).groupBy("prediction").agg(F.count("*").alias("n"))
    return p.select(
        "prediction", names.display_name(F.col("prediction")).alias("shown"), names.exclusion_name(F.col("prediction")).alias("tested"), "n"
    )


# ---- report -------------------------------------------------------------------------


@query(
    "volume_counts",
    o(
        """SELECT i.corridor, n_indexed_all, n_indexed, coalesce(n_downloaded, 0) AS n_downloaded, coalesce(n_download_failed, 0) AS n_download_failed,
     coalesce(n_predicted, 0) AS n_predicted, coalesce(n_variants_predicted, 0) AS n_variants_predicted, coalesce(n_model_failures, 0) AS n_model_failures,
     coalesce(n_model_versions, 0) AS n_model_versions
     FROM (SELECT corridor, count(*) AS n_indexed_all, count(*) FILTER (NOT coalesce(is_pano, false)) AS n_indexed FROM images GROUP BY 1) i
     LEFT JOIN (SELECT corridor, count(*) FILTER (error IS NULL) AS n_downloaded, count(*) FILTER (error IS NOT NULL) AS n_download_failed
       FROM downloads JOIN images USING (image_id) WHERE NOT coalesce(is_pano, false) GROUP BY 1) d USING (corridor)
     LEFT JOIN (SELECT corridor, count(DISTINCT p.image_id) AS n_predicted, count(*) AS n_variants_predicted, count(failures) AS n_model_failures,
       count(DISTINCT model_version) AS n_model_versions FROM predictions p JOIN images i2 ON i2.image_id = p.image_id WHERE variant = 'full' GROUP BY 1) p USING (corridor)""",
        "images", "downloads", "predictions",
    ),
)
def volume(spark, sf):
    return report.volume_counts(tb.images(spark, sf), tb.downloads(spark, sf), tb.predictions(spark, sf))


@query(
    "hit_rates",
    o(
        f"""SELECT corridor, threshold, n, k, round(CAST(k AS DOUBLE) / n, 6) AS frac, {wilson_sql('k', 'n')} FROM (
     SELECT corridor, t AS threshold, count(DISTINCT image_id) AS n, count(DISTINCT CASE WHEN max_animal_conf >= t THEN image_id END) AS k
     FROM (SELECT p.image_id, corridor, max_animal_conf FROM predictions p JOIN images i ON i.image_id = p.image_id WHERE variant = 'full'),
       (SELECT unnest([0.2e0, 0.5e0, 0.8e0]) AS t) GROUP BY 1, 2)""",
        "predictions", "images",
    ),
)
def hit_rates(spark, sf):
    return rounded(report.hit_rates(tb.predictions(spark, sf), tb.images(spark, sf)), "frac", "lo", "hi")


@query(
    "threshold_sweep",
    o(
        """SELECT corridor, threshold, k, n, round(100e0 * k / n, 6) AS pct FROM (SELECT corridor, t AS threshold, count(*) FILTER (conf >= t) AS k, count(*) AS n
     FROM detections JOIN (SELECT image_id, corridor FROM images) USING (image_id), (SELECT unnest([0.1e0, 0.2e0, 0.3e0, 0.5e0, 0.8e0]) AS t)
     WHERE category = '1' AND variant = 'full' GROUP BY 1, 2)""",
        "detections", "images",
    ),
)
def threshold_sweep(spark, sf):
    return rounded(report.threshold_sweep(tb.detections(spark, sf), tb.images(spark, sf), (0.1, 0.2, 0.3, 0.5, 0.8)), "pct")


@query(
    "images_with_people_and_vehicles",
    o(
        """SELECT category, corridor, count(DISTINCT d.image_id) AS n_images FROM detections d JOIN images i ON i.image_id = d.image_id
     WHERE category IN ('2', '3') AND conf >= 0.2e0 AND variant = 'full' GROUP BY 1, 2""",
        "detections", "images",
    ),
)
def images_with(spark, sf):
    d, i = tb.detections(spark, sf), tb.images(spark, sf)
    out = [report.images_with(d, i, c, 0.2).withColumn("category", F.lit(c)) for c in (records.HUMAN_CATEGORY, records.VEHICLE_CATEGORY)]
    return out[0].unionByName(out[1])


@query(
    "top_labels",
    o(
        f"""SELECT corridor, rank, prediction, n, {DISPLAY} AS label FROM (SELECT *, CAST(row_number() OVER (PARTITION BY corridor ORDER BY n DESC, prediction) AS INT) AS rank FROM (
     SELECT corridor, prediction, count(*) AS n FROM predictions JOIN (SELECT image_id, corridor FROM images) USING (image_id)
     WHERE variant = 'full' AND max_animal_conf >= 0.2e0 GROUP BY 1, 2)) WHERE rank <= 12""",
        "predictions", "images",
    ),
)
def top_labels(spark, sf):
    return report.top_labels(tb.predictions(spark, sf), tb.images(spark, sf), 0.2)


@query(
    "label_scores",
    o(
        """SELECT corridor, prediction, count(DISTINCT image_id) AS n_images, round(avg(prediction_score), 6) AS mean_score
     FROM predictions JOIN (SELECT image_id, corridor FROM images) USING (image_id) WHERE variant = 'full' GROUP BY 1, 2""",
        "predictions", "images",
    ),
)
def label_scores(spark, sf):
    return rounded(report.label_scores(tb.predictions(spark, sf), tb.images(spark, sf)), "mean_score")


BAND = "CASE WHEN conf >= 0.2e0 AND conf < 0.5e0 THEN '0.2-0.5' WHEN conf >= 0.5e0 AND conf < 0.8e0 THEN '0.5-0.8' WHEN conf >= 0.8e0 AND conf < 1.01e0 THEN '0.8-1.0' ELSE 'out' END"
REVIEWED = f"""rv AS (SELECT r.*, d.conf, i.corridor, {BAND} AS band FROM reviews r JOIN detections d USING (image_id, variant, det_idx)
   JOIN (SELECT image_id, corridor FROM images) i USING (image_id) WHERE r.reviewer = 'ann' AND r.variant = 'full')"""


def _reviewed(spark, sf):
    return report.reviewed_boxes(tb.reviews(spark, sf), tb.detections(spark, sf), tb.images(spark, sf), "ann")


@query(
    "precision_by_band",
    o(
        f"""SELECT corridor, band, n, tp, fp, unsure, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, {wilson_sql('tp', 'nullif(tp + fp, 0)')} FROM (
     SELECT corridor, coalesce(band, '(all)') AS band, count(*) AS n, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp,
     count(*) FILTER (verdict = 'unsure') AS unsure FROM rv GROUP BY GROUPING SETS ((corridor), (corridor, band)))""",
        "reviews", "detections", "images", extra=REVIEWED,
    ),
)
def precision(spark, sf):
    return rounded(report.precision_by_band(_reviewed(spark, sf)), "precision", "lo", "hi")


@query(
    "band_verdicts",
    o(
        """SELECT corridor, band, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'unsure') AS unsure FROM rv GROUP BY 1, 2""",
        "reviews", "detections", "images", extra=REVIEWED,
    ),
)
def band_verdicts(spark, sf):
    return report.band_verdicts(_reviewed(spark, sf))


SBAND = " ".join(f"WHEN s >= {lo}e0 AND s < {hi}e0 THEN '{stats.band_label(lo, hi)}'" for lo, hi in stats.SPECIES_BANDS)


@query(
    "species_precision",
    o(
        f"""SELECT band, n, tp, fp, judged, exact, rollup, judged - exact - rollup AS wrong, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS animal_precision,
     round(CAST(exact AS DOUBLE) / nullif(judged, 0), 6) AS species_precision, {wilson_sql('exact', 'nullif(judged, 0)')},
     CASE WHEN (SELECT count(*) FROM b b2 WHERE b2.band >= b.band AND judged >= 15 AND coalesce(CAST(exact AS DOUBLE) / nullif(judged, 0), 0) >= 0.6e0) = 
       (CASE band WHEN '0.5-0.6' THEN 4 WHEN '0.6-0.7' THEN 3 WHEN '0.7-0.8' THEN 2 ELSE 1 END) THEN 1 ELSE 0 END AS bar FROM b""",
        "reviews", "predictions",
        extra=f"""b AS (SELECT CASE {SBAND} END AS band, count(*) AS n, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp,
     count(*) FILTER (verdict = 'tp' AND coalesce(species_agree, 'na') <> 'na') AS judged, count(*) FILTER (verdict = 'tp' AND species_agree = 'yes') AS exact,
     count(*) FILTER (verdict = 'tp' AND species_agree = 'rollup') AS rollup FROM reviews
     LEFT JOIN (SELECT image_id, variant, max(prediction_score) AS s FROM predictions GROUP BY 1, 2) USING (image_id, variant)
     WHERE CASE {SBAND} END IS NOT NULL AND reviewer = 'ann' AND variant = 'full' GROUP BY 1)""",
    ),
)
def species_precision(spark, sf):
    out = report.species_precision(tb.reviews(spark, sf), tb.predictions(spark, sf), "ann")
    return rounded(out, "animal_precision", "species_precision", "lo", "hi").withColumn("bar", F.col("bar").cast("int"))


@query(
    "distance_percentiles",
    o(
        """SELECT corridor, count(*) AS n, max(est_distance_m) AS max, round(quantile_cont(est_distance_m, 0.5), 6) AS p0, round(quantile_cont(est_distance_m, 0.9), 6) AS p1
     FROM rv WHERE verdict = 'tp' AND est_distance_m IS NOT NULL GROUP BY 1""",
        "reviews", "detections", "images", extra=REVIEWED,
    ),
)
def distance_percentiles(spark, sf):
    return rounded(report.distance_percentiles(_reviewed(spark, sf), ["corridor"]), "p0", "p1")


@query(
    "distance_histogram",
    o(
        "SELECT corridor, floor(est_distance_m / 25) * 25 AS bin_m, count(*) AS n FROM rv WHERE verdict = 'tp' AND est_distance_m IS NOT NULL GROUP BY 1, 2",
        "reviews", "detections", "images", extra=REVIEWED,
    ),
)
def distance_histogram(spark, sf):
    return report.distance_histogram(_reviewed(spark, sf)).withColumn("bin_m", F.col("bin_m").cast("double"))


@query(
    "majority_baseline",
    o(
        """SELECT corridor, CAST(n AS BIGINT) AS n, species, round(CAST(k AS DOUBLE) / CAST(n AS DOUBLE), 6) AS accuracy FROM (SELECT *, sum(k) OVER (PARTITION BY corridor) AS n,
     row_number() OVER (PARTITION BY corridor ORDER BY k DESC, species DESC) AS rn FROM (SELECT corridor, lower(trim(true_species)) AS species, count(*) AS k
     FROM reviews JOIN (SELECT image_id, corridor FROM images) USING (image_id) WHERE verdict = 'tp' AND trim(true_species) <> '' GROUP BY 1, 2)) WHERE rn = 1""",
        "reviews", "images",
    ),
)
def majority(spark, sf):
    return rounded(report.majority_baseline(tb.reviews(spark, sf), tb.images(spark, sf)), "accuracy")


@query(
    "image_density",
    o(
        """SELECT corridor, count(*) AS n_images, CAST(min(captured_at) AS VARCHAR) AS first, CAST(max(captured_at) AS VARCHAR) AS last, count(DISTINCT sequence_id) AS n_sequences,
     count(DISTINCT creator_username) AS n_contributors, count(*) FILTER (is_pano) AS n_pano, round(count(*) / 12.5e0, 6) AS images_per_road_km FROM images GROUP BY 1""",
        "images",
    ),
)
def image_density(spark, sf):
    out = report.image_density(tb.images(spark, sf), 12.5)
    return rounded(out, "images_per_road_km").withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))


@query(
    "image_facets",
    o(
        """SELECT corridor, 'year' AS facet, CAST(year(captured_at) AS VARCHAR) AS value, count(*) AS n FROM images GROUP BY 1, 3
     UNION ALL SELECT corridor, 'month', CAST(month(captured_at) AS VARCHAR), count(*) FROM images GROUP BY 1, 3
     UNION ALL SELECT corridor, 'camera', coalesce(camera_type, 'unknown'), count(*) FROM images GROUP BY 1, 3""",
        "images",
    ),
)
def image_facets(spark, sf):
    return report.image_facets(tb.images(spark, sf))


@query(
    "camera_pass_summary",
    o(
        """SELECT c.corridor, c.park, coalesce(images_indexed, 0) AS images_indexed, coalesce(contributors, 0) AS contributors, coalesce(frames_scored, 0) AS frames_scored,
     coalesce(frames_with_animal, 0) AS frames_with_animal, CAST(coalesce(sightings, 0) AS BIGINT) AS sightings, CAST(coalesce(named, 0) AS BIGINT) AS named,
     CASE WHEN coalesce(frames_scored, 0) = 0 THEN 'planned' WHEN reviewer IS NOT NULL THEN 'reviewed' ELSE 'unreviewed' END AS status, coalesce(reviewer, '-') AS reviewer
     FROM (SELECT concat('c', r_regionkey) AS corridor, concat('park', r_regionkey) AS park FROM region) c
     LEFT JOIN (SELECT corridor, count(*) AS images_indexed, count(DISTINCT creator_username) AS contributors FROM images GROUP BY 1) USING (corridor)
     LEFT JOIN (SELECT corridor, count(DISTINCT p.image_id) AS frames_scored, count(DISTINCT CASE WHEN max_animal_conf >= 0.5e0 THEN p.image_id END) AS frames_with_animal
       FROM predictions p JOIN images i ON i.image_id = p.image_id WHERE variant = 'full' GROUP BY 1) USING (corridor)
     LEFT JOIN (SELECT json_extract_string(raw_json, '$.corridor') AS corridor, count(*) AS sightings, count(*) FILTER (scientific_name <> 'Mammalia') AS named
       FROM sightings WHERE source = 'mapillary_cv' AND duplicate_of IS NULL GROUP BY 1) USING (corridor)
     LEFT JOIN (SELECT corridor, CASE WHEN bool_or(reviewer = 'me') THEN 'me' ELSE min(reviewer) END AS reviewer FROM reviews JOIN (SELECT image_id, corridor FROM images) USING (image_id)
       WHERE variant = 'full' GROUP BY 1) USING (corridor)""",
        "images", "predictions", "sightings", "reviews",
    ),
)
def camera_pass(spark, sf):
    corridors = tb.table(spark, sf, "region").select(
        F.concat(F.lit("c"), "r_regionkey").alias("corridor"), F.concat(F.lit("park"), "r_regionkey").alias("park")
    )
    s = tb.sightings(spark, sf)
    out = report.camera_pass(tb.images(spark, sf), tb.predictions(spark, sf), s, tb.reviews(spark, sf), corridors)
    return out.select(
        "corridor", "park", "images_indexed", "contributors", "frames_scored", "frames_with_animal", "sightings", "named", "status",
        F.coalesce("reviewer", F.lit("-")).alias("reviewer"),
    )


@query(
    "reviewer_choice",
    o(
        """SELECT corridor, CASE WHEN bool_or(reviewer = 'me') THEN 'me' ELSE min(reviewer) END AS reviewer FROM reviews JOIN (SELECT image_id, corridor FROM images) USING (image_id) GROUP BY 1""",
        "reviews", "images",
    ),
)
def reviewer_choice(spark, sf):
    rows = tb.reviews(spark, sf).join(tb.images(spark, sf).select("image_id", "corridor"), "image_id")
    return quality.choose_reviewer(rows, ["corridor"])


@query(
    "compare_runs",
    o(
        """SELECT count(*) FILTER (both_) AS n, count(*) FILTER (event_id % 90 = 1) AS only_a, count(*) FILTER (event_id % 90 = 2) AS only_b,
     count(*) FILTER (both_ AND event_id % 50 = 0) AS label_mismatch, count(*) FILTER (both_ AND event_id % 40 = 0) AS box_count_mismatch,
     round(max(CASE WHEN both_ AND event_id % 30 = 0 THEN 0.25e0 ELSE 0e0 END), 6) AS max_score_diff, 0 AS identical
     FROM (SELECT *, event_id % 90 NOT IN (1, 2) AS both_ FROM events)""",
    ),
)
def compare_runs(spark, sf):
    d = tb.detections(spark, sf).join(tb.predictions(spark, sf).select("image_id", "prediction", "event_id"), "image_id")
    box = F.struct("det_idx", "category", F.lit("x").alias("label"), "conf", F.array("bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("bbox"))
    a = d.groupBy("image_id", "prediction", "event_id").agg(F.array_sort(F.collect_list(box)).alias("b"))
    slim = F.transform("b", lambda x: x.dropFields("det_idx"))
    scores = F.struct(F.array(F.lit("k")).alias("classes"), F.array(F.lit(0.5)).alias("scores")).alias("classifications")
    run1 = a.select(F.concat("image_id", F.lit(".jpg")).alias("filepath"), "prediction", slim.alias("detections"), scores, "event_id")
    moved = F.when(F.col("event_id") % 30 == 0, 0.25).otherwise(0.0)
    run2 = run1.select(
        F.concat(F.lit("/other/"), "filepath").alias("filepath"),
        F.when(F.col("event_id") % 50 == 0, "z").otherwise(F.col("prediction")).alias("prediction"),
        F.when(F.col("event_id") % 40 == 0, F.slice("detections", F.lit(1), F.size("detections") - 1)).otherwise(F.col("detections")).alias("detections"),
        F.struct(F.array(F.lit("k")).alias("classes"), F.array(F.lit(0.5) + moved).alias("scores")).alias("classifications"), "event_id",
    )
    run2 = run2.filter("event_id % 90 <> 1").drop("event_id")
    out = report.compare_runs(run1.filter("event_id % 90 <> 2").drop("event_id"), run2, 1e-6)
    return rounded(out, "max_score_diff").drop("max_box_diff").withColumn("identical", F.col("identical").cast("int"))


# ---- samples ------------------------------------------------------------------------------


@query(
    "pending_downloads",
    o(
        """SELECT corridor, image_id, CAST(pick AS INT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY h, image_id) AS pick FROM (
     SELECT i.*, md5(i.image_id || ':phase0') AS h, row_number() OVER (PARTITION BY corridor, sequence_id ORDER BY md5(i.image_id || ':phase0'), i.image_id) AS rn
     FROM images i WHERE NOT coalesce(is_pano, false) AND NOT EXISTS (SELECT 1 FROM downloads d WHERE d.image_id = i.image_id AND d.error IS NULL)) WHERE rn <= 5) WHERE pick <= 400""",
        "images", "downloads",
    ),
)
def pending(spark, sf):
    out = sampling.pending_downloads(tb.images(spark, sf), tb.downloads(spark, sf), 400, max_per_sequence=5)
    return out.select("corridor", "image_id", "pick")


@query(
    "downloaded_frames",
    o(
        """SELECT corridor, image_id, local_path, width, height FROM images JOIN downloads USING (image_id) WHERE error IS NULL AND NOT coalesce(is_pano, false)""",
        "images", "downloads",
    ),
)
def downloaded(spark, sf):
    return sampling.downloaded(tb.images(spark, sf), tb.downloads(spark, sf)).select("corridor", "image_id", "local_path", "width", "height")


def _candidates(spark, sf, min_conf, seed):
    b = tb.boxes(spark, sf).filter(chains.variant_filter("perspective"))
    return sampling.review_candidates(b, tb.downloads(spark, sf), min_conf, seed)


def _cand_sql(min_conf: float, seed: int) -> str:
    return f"""cand AS MATERIALIZED (SELECT b.*, md5(image_id || ':' || variant || ':' || det_idx || ':{seed}') AS h FROM boxes b JOIN downloads d USING (image_id)
   WHERE d.error IS NULL AND category = '1' AND conf >= {min_conf}e0 AND variant = 'full')"""


@query(
    "review_candidates",
    o("SELECT corridor, image_id, variant, det_idx, h FROM cand", "boxes", "downloads", extra=_cand_sql(0.2, 42)),
)
def candidates(spark, sf):
    return _candidates(spark, sf, 0.2, 42).select("corridor", "image_id", "variant", "det_idx", "h")


@query(
    "sample_uniform",
    o(
        f"""SELECT corridor, image_id, det_idx, {BAND} AS band, CAST(pick AS INT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY h) AS pick FROM
     (SELECT *, row_number() OVER (PARTITION BY corridor, image_id ORDER BY h) AS rn FROM cand) WHERE rn = 1) WHERE pick <= 30""",
        "boxes", "downloads", extra=_cand_sql(0.2, 42),
    ),
)
def sample_uniform(spark, sf):
    return sampling.sample_uniform(_candidates(spark, sf, 0.2, 42)).select("corridor", "image_id", "det_idx", "band", "pick")


# The twin of the greedy draw walks every candidate, one a step, with its state in lists.
_GREEDY = f"""ranked AS MATERIALIZED (SELECT corridor, image_id, det_idx, {BAND} AS band, h, row_number() OVER (PARTITION BY corridor ORDER BY h) AS i FROM cand),
 walk AS (SELECT corridor, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS imgs, 10 AS q1, 10 AS q2, 10 AS q3, false AS took, '' AS image_id, 0 AS det_idx, '' AS band FROM (SELECT DISTINCT corridor FROM ranked)
   UNION ALL
   SELECT w.corridor, r.i, CASE WHEN ok THEN list_append(imgs, r.image_id) ELSE imgs END, q1 - CASE WHEN ok AND r.band = '0.2-0.5' THEN 1 ELSE 0 END,
     q2 - CASE WHEN ok AND r.band = '0.5-0.8' THEN 1 ELSE 0 END, q3 - CASE WHEN ok AND r.band = '0.8-1.0' THEN 1 ELSE 0 END, ok, r.image_id, r.det_idx, r.band
   FROM walk w JOIN ranked r ON r.corridor = w.corridor AND r.i = w.i + 1,
   LATERAL (SELECT NOT list_contains(w.imgs, r.image_id) AND len(w.imgs) < 30 AND CASE r.band WHEN '0.2-0.5' THEN w.q1 WHEN '0.5-0.8' THEN w.q2 WHEN '0.8-1.0' THEN w.q3 ELSE 0 END > 0 AS ok) x)"""


@query(
    "sample_stratified",
    o(
        "SELECT corridor, image_id, det_idx, band FROM walk WHERE took /* RECURSIVE_STEP */", "boxes", "downloads",
        extra=_cand_sql(0.2, 42) + ", " + _GREEDY,
    ),
)
def sample_stratified(spark, sf):
    return sampling.sample_stratified(_candidates(spark, sf, 0.2, 42)).select("corridor", "image_id", "det_idx", "band")


_SB = " ".join(f"WHEN prediction_score >= {lo}e0 AND prediction_score < {hi}e0 THEN {i}" for i, (lo, hi) in enumerate(stats.SPECIES_BANDS))
_SPECIES_WALK = f"""ranked AS MATERIALIZED (SELECT corridor, image_id, det_idx, CASE {_SB} END AS b, row_number() OVER (ORDER BY CASE corridor WHEN 'c2' THEN 0 WHEN 'c0' THEN 1 ELSE 2 END, h) AS i
   FROM cand WHERE {NAME_OF} NOT IN ('human', 'vehicle', 'blank') AND CASE {_SB} END IS NOT NULL),
 walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS imgs, [20, 20, 20, 20] AS q, false AS took, '' AS corridor, '' AS image_id, 0 AS det_idx
   UNION ALL
   SELECT r.i, CASE WHEN ok THEN list_append(imgs, r.image_id) ELSE imgs END,
     CASE WHEN ok THEN [q[1] - CASE WHEN b = 0 THEN 1 ELSE 0 END, q[2] - CASE WHEN b = 1 THEN 1 ELSE 0 END, q[3] - CASE WHEN b = 2 THEN 1 ELSE 0 END, q[4] - CASE WHEN b = 3 THEN 1 ELSE 0 END] ELSE q END,
     ok, r.corridor, r.image_id, r.det_idx
   FROM walk w JOIN ranked r ON r.i = w.i + 1, LATERAL (SELECT NOT list_contains(w.imgs, r.image_id) AND w.q[r.b + 1] > 0 AS ok) x)"""


@query(
    "sample_species_scores",
    o(
        "SELECT corridor, image_id, det_idx FROM walk WHERE took /* RECURSIVE_STEP */", "boxes", "downloads",
        extra=_cand_sql(0.5, 7) + ", " + _SPECIES_WALK,
    ),
)
def sample_species(spark, sf):
    out = sampling.sample_species(_candidates(spark, sf, 0.5, 7), ["c2", "c0", "c1"], per_band=20)
    return out.withColumn("corridor", F.element_at(F.array(F.lit("c2"), F.lit("c0"), F.lit("c1")), F.col("corridor_rank").cast("int"))).select(
        "corridor", "image_id", "det_idx"
    )


@query(
    "sample_shortfalls",
    o(
        """SELECT corridor, band, coalesce(taken, 0) AS taken, 10 - coalesce(taken, 0) AS short FROM (SELECT * FROM (SELECT DISTINCT corridor FROM walk WHERE took),
     (SELECT unnest(['0.2-0.5', '0.5-0.8', '0.8-1.0']) AS band)) LEFT JOIN (SELECT corridor, band, count(*) AS taken FROM walk WHERE took GROUP BY 1, 2) USING (corridor, band) /* RECURSIVE_STEP */""",
        "boxes", "downloads", extra=_cand_sql(0.2, 42) + ", " + _GREEDY,
    ),
)
def sample_shortfalls(spark, sf):
    drawn = sampling.sample_stratified(_candidates(spark, sf, 0.2, 42))
    return sampling.shortfalls(drawn, ["corridor"], stats.band_labels(stats.CONFIDENCE_BANDS), 10)


@query(
    "review_template",
    o(
        f"""SELECT image_id, variant, det_idx, round_even(conf, 3) AS conf, {DISPLAY} AS predicted, round_even(prediction_score, 3) AS prediction_score,
     image_id || '_' || variant || '_' || det_idx || '_frame.jpg' AS frame_file FROM cand""",
        "boxes", "downloads", extra=_cand_sql(0.2, 42),
    ),
)
def review_template(spark, sf):
    c = _candidates(spark, sf, 0.2, 42).withColumn("band", stats.band_of(F.col("conf"))).withColumn("top5_classes", F.lit("[]"))
    return records.review_template(c).select("image_id", "variant", "det_idx", "conf", "predicted", "prediction_score", "frame_file")


@query(
    "coverage_summary",
    o(
        """SELECT corridor, count(DISTINCT image_id) AS images, count(DISTINCT sequence_id) AS sequences, CAST(min(captured_at) AS VARCHAR) AS first, CAST(max(captured_at) AS VARCHAR) AS last,
     any_value(t.tiles) AS tiles, any_value(t.truncated) AS truncated FROM images JOIN (SELECT concat('c', l_suppkey % 3) AS corridor, count(*) AS tiles, count(*) FILTER (l_returnflag = 'R') AS truncated
     FROM lineitem GROUP BY 1) t USING (corridor) GROUP BY corridor""",
        "images",
    ),
)
def coverage_summary(spark, sf):
    tiles = tb.table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("corridor"), F.when(F.col("l_returnflag") == "R", "capped").otherwise("done").alias("status")
    )
    out = rollups.coverage_summary(tb.images(spark, sf), tiles)
    return out.withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))
