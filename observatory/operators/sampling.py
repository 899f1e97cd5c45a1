"""Seeded, reproducible samples for download and review."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.functions import names, stats
from observatory.operators.chains import population_filter
from observatory.operators.ranking import top_k
from observatory.sources.records import ANIMAL_CATEGORY


def seeded_order(seed: str | int, *parts: str) -> Column:
    """A stable pseudo-random key: same order on every run and machine."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts], F.lit(str(seed))))


def pending_downloads(
    images: DataFrame,
    downloads: DataFrame,
    limit: int,
    max_per_sequence: int = 20,
    population: str = "perspective",
    seed: str = "phase0",
) -> DataFrame:
    """Frames still to fetch: seeded order, capped per sequence, per corridor.

    Failed downloads count as not fetched. Both limits are group limits, so a
    sequence with most of the frames sends ``max_per_sequence`` rows per task.
    """
    done = downloads.filter(F.col("error").isNull()).select("image_id").distinct()
    open_ = images.filter(population_filter(population)).join(done, "image_id", "left_anti")
    keyed = open_.withColumn("_h", seeded_order(seed, "image_id"))
    capped = top_k(keyed, ["corridor", "sequence_id"], [F.asc("_h"), F.asc("image_id")], max_per_sequence)
    return top_k(capped, ["corridor"], [F.asc("_h"), F.asc("image_id")], limit, "pick").drop("_h")


def downloaded(images: DataFrame, downloads: DataFrame, population: str = "perspective") -> DataFrame:
    """Successful downloads with their frame size."""
    ok = downloads.filter(F.col("error").isNull()).select("image_id", "local_path")
    return images.filter(population_filter(population)).select("image_id", "corridor", "width", "height").join(ok, "image_id")


def review_candidates(boxes: DataFrame, downloads: DataFrame, min_conf: float, seed: int) -> DataFrame:
    """Animal boxes of downloaded frames with their seeded key."""
    ok = downloads.filter(F.col("error").isNull()).select("image_id", "local_path")
    return (
        boxes.filter((F.col("category") == ANIMAL_CATEGORY) & (F.col("conf") >= min_conf))
        .join(ok, "image_id")
        .withColumn("h", seeded_order(seed, "image_id", "variant", "det_idx"))
    )


def sample_uniform(candidates: DataFrame, n: int = 30) -> DataFrame:
    """Superseded: one box per frame in seeded order, whatever its band."""
    first = top_k(candidates, ["corridor", "image_id"], [F.asc("h"), F.asc("det_idx")], 1)
    picked = top_k(first, ["corridor"], [F.asc("h"), F.asc("image_id")], n, "pick")
    return picked.withColumn("band", stats.band_of(F.col("conf")))


def _greedy(short: DataFrame, keys: Sequence[str], order: Sequence[str], quota: dict[str, int], n: int) -> DataFrame:
    """Walk a short candidate list in order: take a box when its band has room
    and its frame is not taken. Order-dependent, hence grouped pandas over the
    bounded list ``_contenders`` leaves."""
    columns = [*keys, *order, "image_id", "variant", "det_idx", "band"]
    columns = list(dict.fromkeys(columns))
    fields = {f.name: f.dataType.simpleString() for f in short.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in columns) + ", pick int"

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        room, frames, rows = dict(quota), set(), []
        for row in pdf.sort_values(list(order)).itertuples(index=False):
            if len(rows) == n:
                break
            if room.get(row.band, 0) > 0 and row.image_id not in frames:
                room[row.band] -= 1
                frames.add(row.image_id)
                rows.append(row)
        out = pd.DataFrame(rows, columns=list(pdf.columns))[columns]
        out["pick"] = range(1, len(out) + 1)
        return out

    slim = short.select(*columns)
    if keys:
        return slim.groupBy(*keys).applyInPandas(draw, schema)
    # one list for all corridors: the contenders are a fixed number of rows
    return slim.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: draw(pdf.drop(columns="_all")), schema)


def _contenders(candidates: DataFrame, keys: Sequence[str], order: Sequence[str], per_band: int, n: int) -> DataFrame:
    """The only boxes a draw can ever look at, a fixed number per key and band.

    Of the boxes one frame has in one band only the first matters: whatever
    stops it (band full, frame taken) stops the later ones too, and if it is
    taken the frame is. In a band at most ``n`` of those frames can be taken by
    other picks and ``per_band`` fill the band, so the first ``n + per_band``
    are enough. The greedy draw over this list equals the draw over all rows.
    """
    by = [F.asc(c) for c in order]
    first = top_k(candidates, [*keys, "band", "image_id"], by, 1)
    return top_k(first, [*keys, "band"], by, n + per_band)


def sample_stratified(candidates: DataFrame, n: int = 30) -> DataFrame:
    """Equal quota per confidence band, one box per frame, never back-filled."""
    labels = stats.band_labels(stats.CONFIDENCE_BANDS)
    per_band = math.ceil(n / len(labels))
    banded = candidates.withColumn("band", stats.band_of(F.col("conf"))).filter(F.col("band").isin(*labels))
    order = ["h", "image_id", "det_idx"]
    short = _contenders(banded, ["corridor"], order, per_band, n)
    return _greedy(short, ["corridor"], order, dict.fromkeys(labels, per_band), n)


def sample_species(candidates: DataFrame, corridors: Sequence[str], per_band: int = 30) -> DataFrame:
    """Quotas over species-score bands shared by the corridors in order."""
    labels = stats.band_labels(stats.SPECIES_BANDS, "s")
    rank = F.array_position(F.array(*[F.lit(c) for c in corridors]), F.col("corridor"))
    banded = (
        candidates.filter(F.col("corridor").isin(*corridors) & ~names.is_excluded(F.col("prediction")))
        .withColumn("band", stats.species_band_of(F.col("prediction_score")))
        .filter(F.col("band").isNotNull())
        .withColumn("corridor_rank", rank)
    )
    n = per_band * len(labels)
    order = ["corridor_rank", "h", "image_id", "det_idx"]
    short = _contenders(banded, [], order, per_band, n)
    return _greedy(short, [], order, dict.fromkeys(labels, per_band), n)


def shortfalls(sample: DataFrame, keys: Sequence[str], labels: Sequence[str], quota: int) -> DataFrame:
    """What each band is short of its quota, bands with nothing included."""
    got = sample.groupBy(*keys, "band").agg(F.count("*").alias("taken"))
    wanted = sample.select(*keys).distinct().withColumn("band", F.explode(F.array(*[F.lit(b) for b in labels])))
    return wanted.join(got, [*keys, "band"], "left").select(
        *keys, "band", F.coalesce("taken", F.lit(0)).alias("taken"), (quota - F.coalesce("taken", F.lit(0))).alias("short")
    )
