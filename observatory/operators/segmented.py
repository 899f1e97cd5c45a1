"""Ordered passes over groups of any size.

A plain ``lag`` or running sum partitioned by a key puts the whole key in one
task. Here every key is cut into segments by an extra column (a time bucket, a
value range): the window runs inside a segment, and what crosses a segment
boundary is carried by a summary with one row per key and segment. The summary
join reuses the partitioning of the window, so the rows are shuffled once.

Segments must be ordered like the rows: every row of a lower segment precedes
every row of a higher one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.session import materialise


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null, keeping the left columns and the named right ones."""
    l, r = df.alias("l"), side.alias("r")
    return l.join(r, _same(keys, "l", "r"), "left").select("l.*", *[F.col(f"r.{c}") for c in columns])


def previous_row(
    df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], columns: Sequence[str], out: str = "prev"
) -> DataFrame:
    """Add ``out``: a struct of ``columns`` of the previous row of the key, null for its first row."""
    value = F.struct(*columns)
    inside = W.partitionBy(*keys, segment).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    local = df.withColumn("_local", F.lag(value).over(inside))
    tails = df.groupBy(*keys, segment).agg(
        F.max_by(value, F.struct(*[F.col(c) for c in order])).alias("_tail")
    )
    across = W.partitionBy(*keys).orderBy(segment)
    carried = tails.withColumn("_carry", F.lag("_tail").over(across)).drop("_tail")
    joined = attach(local, carried, [*keys, segment], ["_carry"])
    return joined.withColumn(out, F.coalesce("_local", "_carry")).drop("_local", "_carry")


def running_total(
    df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], value: Column, out: str = "total"
) -> DataFrame:
    """Add ``out``: the inclusive running sum of ``value`` along the key."""
    work = df.withColumn("_v", value)
    inside = (
        W.partitionBy(*keys, segment)
        .orderBy(*[F.col(c).asc_nulls_last() for c in order])
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = work.withColumn("_run", F.sum("_v").over(inside))
    sums = work.groupBy(*keys, segment).agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.withColumn("_base", F.sum("_s").over(before)).drop("_s")
    joined = attach(local, carried, [*keys, segment], ["_base"])
    return joined.withColumn(out, F.col("_run") + F.coalesce(F.col("_base"), F.lit(0))).drop("_v", "_run", "_base")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], width: float
) -> DataFrame:
    """Linear-interpolated percentiles per key, without sorting a key in one task.

    Values are counted first (combining map-side), then ranked by a segmented
    running total over ranges ``width`` wide, and only the rows around each
    wanted rank survive. Output: keys, ``n``, ``max``, ``p0``, ``p1``... in the
    order of ``fractions``.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counted = materialise(counted.withColumn("_seg", F.floor(F.col(value) / width)), "values")
    ranked = running_total(counted, keys, "_seg", [value], F.col("_n"), "_upto")
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("n"), F.max(value).alias("max"))
    joined = attach(ranked, totals, keys, ["n", "max"])
    aggs = []
    for i, fraction in enumerate(fractions):
        at = (F.col("n") - 1) * F.lit(float(fraction))
        lo, hi = F.floor(at), F.ceil(at)
        holds_lo = (lo < F.col("_upto")) & (lo >= F.col("_upto") - F.col("_n"))
        holds_hi = (hi < F.col("_upto")) & (hi >= F.col("_upto") - F.col("_n"))
        v_lo = F.max(F.when(holds_lo, F.col(value)))
        v_hi = F.max(F.when(holds_hi, F.col(value)))
        frac = F.max(at - lo)
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(f"p{i}"))
    return joined.groupBy(*keys, "n", "max").agg(*aggs)
