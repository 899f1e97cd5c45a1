"""Interval, ratio and banding expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Review bands and the naming review's score bands; the open top
# edge keeps a score of exactly 1.0 in the last band.
CONFIDENCE_BANDS = ((0.2, 0.5), (0.5, 0.8), (0.8, 1.01))
SPECIES_BANDS = ((0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 1.01))
THRESHOLDS = (0.2, 0.5, 0.8)
Z_95 = 1.96


def wilson(k: Column, n: Column, z: float = Z_95) -> Column:
    """Wilson score interval ``struct<lo,hi>``, null when ``n`` is zero."""
    size = F.when(n > 0, n.cast("double"))
    p = k.cast("double") / size
    denom = F.lit(1.0) + F.lit(z * z) / size
    centre = (p + F.lit(z * z) / (size * 2.0)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / size + F.lit(z * z) / (size * size * 4.0)) / denom
    return F.when(
        n > 0,
        F.struct(
            F.greatest(F.lit(0.0), centre - half).alias("lo"), F.least(F.lit(1.0), centre + half).alias("hi")
        ),
    )


def safe_ratio(num: Column, den: Column) -> Column:
    return num / F.when(den != 0, den)


def band_label(lo: float, hi: float, prefix: str = "") -> str:
    return f"{prefix}{lo:.1f}-{min(hi, 1.0):.1f}"


def band_labels(bands: Sequence[tuple[float, float]], prefix: str = "") -> list[str]:
    return [band_label(lo, hi, prefix) for lo, hi in bands]


def band_of(
    value: Column,
    bands: Sequence[tuple[float, float]] = CONFIDENCE_BANDS,
    prefix: str = "",
    outside: str | None = "out",
) -> Column:
    """Half-open band label of a score; ``outside`` when no band holds it."""
    out = F.lit(outside)
    for lo, hi in reversed(bands):
        out = F.when((value >= lo) & (value < hi), F.lit(band_label(lo, hi, prefix))).otherwise(out)
    return out


def species_band_of(score: Column) -> Column:
    return band_of(score, SPECIES_BANDS, prefix="s", outside=None)


def month_counts(month: Column, weight: Column | None = None) -> Column:
    """Twelve conditional sums packed January to December."""
    one = F.lit(1) if weight is None else weight
    return F.array(*[F.coalesce(F.sum(F.when(month == m, one)), F.lit(0)).cast("bigint") for m in range(1, 13)])


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def summer_share(months: Column) -> Column:
    """June to August share of a month histogram."""
    return safe_ratio(array_total(F.slice(months, 6, 3)).cast("double"), array_total(months))


# Month names as printed.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def busiest_label(months: Column, minimum: int = 12) -> Column:
    """Top three months: a range when they touch (the year wraps), else a list."""
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    ranked = F.array_sort(F.transform(months, lambda n, i: F.struct((-n).alias("neg"), i.alias("i"))))
    top = F.array_sort(F.transform(F.filter(F.slice(ranked, 1, 3), lambda t: t["neg"] < 0), lambda t: t["i"]))
    a, b, c = F.get(top, F.lit(0)), F.get(top, F.lit(1)), F.get(top, F.lit(2))

    def name(i: Column) -> Column:
        return F.get(names, i)

    three = F.size(top) == 3
    span = (
        F.when(three & (c - a == 2), F.concat_ws(" to ", name(a), name(c)))
        .when(three & (a == 0) & (b == 1) & (c == 11), F.concat_ws(" to ", F.lit("Dec"), F.lit("Feb")))
        .when(three & (a == 0) & (b == 10) & (c == 11), F.concat_ws(" to ", F.lit("Nov"), F.lit("Jan")))
        .otherwise(F.array_join(F.transform(top, name), ", "))
    )
    return F.when(array_total(months) >= minimum, F.concat(F.lit("Busiest "), span))
