"""Contracts, conservation and the filter ledger."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The window a millisecond epoch must fall in, box tolerances.
MS_EPOCH_MIN = 1_000_000_000_000
MS_EPOCH_MAX = 2_000_000_000_000
BOX_EPS = 1e-6
BOX_EDGE_EPS = 1e-3


def lon_lat_violation(lon: Column, lat: Column, allow_null: bool = True) -> Column:
    """Reason text when a coordinate pair breaks the contract, else null."""
    missing = lon.isNull() | lat.isNull()
    bad = F.when(~lon.between(-180, 180), "longitude out of range").when(
        ~lat.between(-90, 90), "latitude out of range"
    )
    return F.when(missing, F.lit(None if allow_null else "missing coordinates")).otherwise(bad)


def box_violation(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Boxes are origin plus size in [0, 1]; pixels and corner formats fail."""
    known = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    return F.when(
        known,
        F.when(~(x.between(-BOX_EPS, 1 + BOX_EPS) & y.between(-BOX_EPS, 1 + BOX_EPS)), "box origin out of range")
        .when(~(w.between(0, 1 + BOX_EPS) & h.between(0, 1 + BOX_EPS)), "box size out of range")
        .when((x + w > 1 + BOX_EDGE_EPS) | (y + h > 1 + BOX_EDGE_EPS), "box past the frame"),
    )


def epoch_violation(ms: Column) -> Column:
    return F.when(~((ms >= MS_EPOCH_MIN) & (ms < MS_EPOCH_MAX)), "not a millisecond epoch")


def violations(df: DataFrame, checks: Mapping[str, Column], key: str) -> DataFrame:
    """One row per broken contract: the offending id, the check and the reason."""
    found = F.array(
        *[F.struct(F.lit(name).alias("check"), reason.alias("reason")) for name, reason in checks.items()]
    )
    return (
        df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("v"))
        .select("key", "v.*")
        .filter(F.col("reason").isNotNull())
    )


def enforce(df: DataFrame, checks: Mapping[str, Column], key: str) -> DataFrame:
    """Fail the job on the first broken contract, naming the row.

    The check rides on the key column, so it cannot be pruned away while the
    row's id is still used.
    """
    reason = F.coalesce(*[F.when(r.isNotNull(), F.concat(F.lit(n + ": "), r)) for n, r in checks.items()])
    text = F.concat(reason, F.lit(" in "), F.coalesce(F.col(key).cast("string"), F.lit("?")))
    return df.withColumn(key, F.when(reason.isNotNull(), F.raise_error(text)).otherwise(F.col(key)))


def split_quarantine(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that fail with their first reason."""
    marked = df.withColumn("_reason", F.coalesce(*checks.values()))
    good = marked.filter(F.col("_reason").isNull()).drop("_reason")
    return good, marked.filter(F.col("_reason").isNotNull())


def observed_count(df: DataFrame, name: str, **extra: Column) -> tuple[DataFrame, Observation]:
    """Count rows as they pass, at no extra job."""
    metrics = Observation(name)
    return df.observe(metrics, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()]), metrics


def check_conservation(n_in: int, n_kept: int, n_dropped: int, stage: str = "") -> None:
    if n_in != n_kept + n_dropped:
        raise ValueError(f"{stage}: {n_in} in != {n_kept} kept + {n_dropped} dropped")


def ledger_entry(df: DataFrame, stage: str, rule: str, keep: Column, reasons: Mapping[str, Column] | None = None) -> DataFrame:
    """One ledger row for a filter: in, out, dropped and the drops per reason.

    A single conditional aggregation over the input; nothing is counted twice.
    """
    kept = F.coalesce(keep, F.lit(False))
    aggs = [
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(kept).alias("n_out"),
        F.count_if(~kept).alias("n_dropped"),
    ]
    aggs += [F.count_if(F.coalesce(c, F.lit(False))).alias(f"dropped_{n}") for n, c in (reasons or {}).items()]
    return df.agg(*aggs).select(F.lit(stage).alias("stage"), F.lit(rule).alias("rule"), "*")


def append_ledger(spark: SparkSession, path: str, stage: str, rule: str, n_in: int, n_out: int, **extra) -> dict:
    """Append one JSON line for a filter that ran; parameters ride along."""
    entry = {
        "ts": datetime.now(UTC).isoformat(timespec="seconds"),
        "stage": stage,
        "rule": rule,
        "n_in": n_in,
        "n_out": n_out,
        "n_dropped": n_in - n_out,
        **extra,
    }
    spark.createDataFrame([(json.dumps(entry, default=str),)], "value string").coalesce(1).write.mode("append").text(path)
    return entry


def ledger_summary(spark: SparkSession, path: str) -> DataFrame:
    """Totals per stage and rule over everything logged."""
    schema = "ts string, stage string, rule string, n_in bigint, n_out bigint, n_dropped bigint"
    return (
        spark.read.schema(schema)
        .json(path)
        .groupBy("stage", "rule")
        .agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.sum("n_dropped").alias("n_dropped"))
    )


def record_sample(sample: DataFrame, path: str, keys: Sequence[str], **parameters) -> None:
    """Pin a drawn sample: its parameters and exact ids as JSON rows."""
    pinned = sample.select(*keys).withColumn("parameters", F.lit(json.dumps(parameters, default=str)))
    pinned.write.mode("errorifexists").json(path)


class MixedReviewers(ValueError):
    """More than one reviewer's rows would be pooled."""


def single_reviewer(reviews: DataFrame, reviewer: str | None = None) -> DataFrame:
    """Rows of one reviewer; refuses to pool two."""
    if reviewer is not None:
        return reviews.filter(F.col("reviewer") == reviewer)
    found = [r.reviewer for r in reviews.select("reviewer").distinct().limit(2).collect()]
    if len(found) > 1:
        raise MixedReviewers("more than one reviewer present; name one")
    return reviews


def choose_reviewer(reviews: DataFrame, by: Sequence[str], wanted: str | None = None) -> DataFrame:
    """The reviewer to report per group: the one asked for, else ``me``, else the first by name."""
    rank = F.when(F.col("reviewer") == F.lit(wanted), 0).when(F.col("reviewer") == "me", 1).otherwise(2)
    return reviews.groupBy(*by).agg(F.min_by("reviewer", F.struct(rank, F.col("reviewer"))).alias("reviewer"))


