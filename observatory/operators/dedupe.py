"""Cross-source duplicates.

Two sightings are one event when they share raw name and day, lie within
``dist_m``, and either their observers agree after normalisation or their times
are within ``window_s``. Sources are ranked; rows are settled from the best
source down, so a row only meets rows that are already known to stay.

A third of all rows may be one species on one day at one overlook, so no step
lists the pairs of such a group. Positions and times are filed in fine cells:

* first every row meets the few best rows of its wide cell, in order of rank: the
  first in reach is its answer, and in a crowd nearly all rows find one there. What
  is left goes on to fine cells;
* cells that lie wholly within reach of each other are settled by one minimum
  per cell, whatever they hold;
* a pair of cells at the edge of reach that still holds many pairs of rows is
  split, both cells in halves along every axis, and its parts are judged alike:
  settled by a minimum, out of reach, or split again;
* only small pairs of cells at the edge compare rows, and there only the rows
  whose id is lower than the best already found are ever joined;
* rows that a rule cannot tell apart (one place, and one time or one observer)
  are compared once: of the kept ones the best, of the others any.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.functions import geo, names
from observatory.session import materialise

# Source ranks, distance and time limits.
SOURCE_PRIORITY = {"inaturalist": 0, "gbif": 1, "mapillary_cv": 2}
OTHER_PRIORITY = 9
DEDUPE_DIST_M = 200.0
DEDUPE_WINDOW_S = 3600.0

_GRID = 4          # fine cells per reach, on each axis
_SLOTS = 2         # fine time slots per window
_DEPTH = 8         # how often a cell may be halved
_LEAF = 1 << 8     # pairs of rows that two cells may compare one by one
_WIDE = 4          # reaches a wide cell is long on each axis, windows in time
_FIRST = 48        # best rows of a wide cell that are tried before its fine cells


def _priority(source: Column, ranks: Mapping[str, int]) -> Column:
    out = F.lit(OTHER_PRIORITY)
    for name, rank in ranks.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def _reach(dist_m: float) -> float:
    """Straight-line metres of a surface distance: cells live in space, so
    there are no poles, no date line and no latitude-dependent widths."""
    return 2 * geo.MEAN_EARTH_RADIUS_M * math.sin(dist_m / 2 / geo.MEAN_EARTH_RADIUS_M)


def _prepare(sightings: DataFrame, dist_m: float, window_s: float, ranks: Mapping[str, int]) -> DataFrame:
    side = _reach(dist_m) / _GRID
    lat, lon = F.radians("lat"), F.radians("lon")
    axes = {"fx": F.cos(lat) * F.cos(lon), "fy": F.cos(lat) * F.sin(lon), "fz": F.sin(lat)}
    micros = F.unix_micros(F.col("observed_at").cast("timestamp"))
    return sightings.filter(
        F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("observed_on").isNotNull()
    ).select(
        F.col("sighting_id").alias("id"),
        "park",
        F.coalesce("scientific_name", F.lit("")).alias("name"),
        F.col("scientific_name").isNull().alias("unnamed"),
        F.col("observed_on").alias("day"),
        "lon",
        "lat",
        micros.alias("us"),
        F.nullif(names.observer_key(F.col("observer")), F.lit("")).alias("who"),
        _priority(F.col("source"), ranks).alias("prio"),
        F.when(F.col("source").isin(*ranks), "").otherwise(F.coalesce("source", F.lit(""))).alias("src"),
        *[F.floor(v * geo.MEAN_EARTH_RADIUS_M / (side / 2**_DEPTH)).cast("bigint").alias(n) for n, v in axes.items()],
        F.floor(micros / F.lit(window_s * 1e6 / _SLOTS / 2**_DEPTH)).cast("bigint").alias("ft"),
    )


_KEYS = ["park", "name", "unnamed", "day"]
_AXES = ["fx", "fy", "fz"]


def _tried(probe: DataFrame, canon: DataFrame, dist_m: float, window_s: float) -> tuple[DataFrame, list[DataFrame]]:
    """(``id`` and ``hit`` of rows of ``probe`` that repeat one, ids not settled by time and by observer) by the ``_FIRST`` best rows around.

    Kept rows are filed in every wide cell that their reach touches, so the list
    of a cell begins with the best of all rows that one of its own can repeat, and
    the first on it in reach is the best. A list that is not full is whole: its
    cell is settled. Rows without a time meet only lists by observer.
    """
    parts = []
    for by_time in (True, False):
        need = F.col("us").isNotNull() if by_time else F.col("who").isNotNull()
        keys = _KEYS + ([] if by_time else ["who"])
        widths = {a: (_GRID << _DEPTH) * _WIDE for a in _AXES} | ({"ft": (_SLOTS << _DEPTH) * _WIDE} if by_time else {})
        cells = [f"w_{a}" for a in widths]
        point = ["lon", "lat"] + (["us"] if by_time else [])
        alike = canon.filter(need).groupBy(*keys, *widths, *point).agg(F.min(F.struct("prio", "src", "id")).alias("rank"))
        for a, w in widths.items():
            gap = w // _WIDE + 1
            alike = alike.withColumn(f"w_{a}", F.explode(F.array_distinct(F.array(F.floor((F.col(a) - gap) / w), F.floor((F.col(a) + gap) / w)))))
        best = alike.withColumn("pos", F.row_number().over(W.partitionBy(*keys, *cells).orderBy("rank"))).filter(F.col("pos") <= _FIRST)
        best = materialise(best.select(*keys, *cells, "pos", "rank", *[F.col(c).alias(f"c_{c}") for c in point]), "best-of-cells")
        rows = probe.filter(need)
        for a, w in widths.items():
            rows = rows.withColumn(f"w_{a}", F.floor(F.col(a) / w))
        on = geo.haversine_m("lon", "lat", "c_lon", "c_lat") <= dist_m
        if by_time:
            on = on & (F.abs(F.col("us") - F.col("c_us")) <= int(window_s * 1e6))
        # a whole number is the cheapest to take the least of; its row comes after
        met = rows.select("id", *keys, *cells, *point).join(best.drop("rank"), [*keys, *cells])
        first = met.groupBy("id", *keys, *cells).agg(F.min(F.when(on, F.col("pos"))).alias("pos"), F.max("pos").alias("n"))
        parts.append(materialise(first.join(best.select(*keys, *cells, "pos", "rank"), [*keys, *cells, "pos"], "left").select("id", F.col("rank").alias("hit"), "n"), "tried"))
    # under a rule a hit or a whole list settles a row
    left = [part.filter(F.col("hit").isNull() & (F.col("n") >= _FIRST)).select("id") for part in parts]
    hits = parts[0].unionByName(parts[1]).filter(F.col("hit").isNotNull()).select("id", "hit")
    return hits, left


def _best(probe: DataFrame, canon: DataFrame, dist_m: float, window_s: float, by_time: bool) -> DataFrame:
    """Lowest (prio, src, id) canonical row matching each probe row under one rule.

    ``by_time`` asks for times within the window; otherwise observers must be
    equal. Returns ``id`` and ``hit``.
    """
    keys = _KEYS + ([] if by_time else ["who"])
    axes = _AXES + (["ft"] if by_time else [])
    need = F.col("us").isNotNull() if by_time else F.col("who").isNotNull()
    point = ["lon", "lat"] + (["us"] if by_time else [])
    alike = [*keys, *axes, *point]
    rows = probe.filter(need).select("id", *alike)
    p = rows.select(*alike).distinct()
    c = canon.filter(need).groupBy(*alike).agg(F.min(F.struct("prio", "src", "id")).alias("rank"))
    other = {a: f"n_{a}" for a in axes}

    def at(depth: int, df: DataFrame) -> DataFrame:
        """Rows with their cell at a depth instead of the finest."""
        return df.withColumns({a: F.shiftright(a, _DEPTH - depth) for a in axes}) if depth < _DEPTH else df

    def judged(pairs: DataFrame, depth: int) -> DataFrame:
        """Pairs of cells that may still matter, with the probe cell's bound and whether the pair is settled by it."""

        def squares(shift: int) -> Column:
            """Squared least (shift -1) or largest (shift 1) gap of two cells, in sides."""
            total = F.lit(0).cast("bigint")
            for a in _AXES:
                gap = F.greatest(F.abs(F.col(other[a]) - F.col(a)) + shift, F.lit(0))
                total = total + gap * gap
            return total

        whole, possible = squares(1) <= (_GRID << depth) ** 2, squares(-1) <= (_GRID << depth) ** 2
        if by_time:
            steps = F.abs(F.col(other["ft"]) - F.col("ft"))
            whole = whole & (steps + 1 <= _SLOTS << depth)
            possible = possible & (steps - 1 <= _SLOTS << depth)
        # the number of cells around a cell is bounded, whatever they hold
        cell = W.partitionBy(*keys, *axes)
        seen = pairs.filter(possible).withColumn("bound", F.least("bound", F.min(F.when(whole, F.col("least"))).over(cell)))
        rival = ~whole & (F.col("bound").isNull() | (F.col("least") < F.col("bound")))
        return seen.select(*keys, *axes, *other.values(), "bound", "n_p", "n_c", rival.alias("rival"))

    # Cells meet in blocks just over twice the reach wide, so a cell's reach
    # touches two blocks per axis. A block holds a fixed number of cells: a
    # group of any size is a bounded number of cell pairs.
    reach = {a: (_SLOTS if a == "ft" else _GRID) + 1 for a in axes}
    near = at(0, p).groupBy(*keys, *axes).agg(F.count("*").alias("n_p"))
    there = at(0, c).groupBy(*keys, *axes).agg(F.min("rank").alias("least"), F.count("*").alias("n_c"))
    for a, n in reach.items():
        width = 2 * n + 1
        ends = F.array(F.floor((F.col(a) - n) / width), F.floor((F.col(a) + n) / width))
        near = near.withColumn(f"b_{a}", F.explode(F.array_distinct(ends)))
        there = there.withColumn(f"b_{a}", F.floor(F.col(a) / width)).withColumnRenamed(a, other[a])
    pairs = near.join(there, [*keys, *[f"b_{a}" for a in axes]]).withColumn("bound", F.lit(None).cast(there.schema["least"].dataType))

    hits = None
    for depth in range(_DEPTH + 1):
        cells = materialise(judged(pairs, depth), "cells")
        big = F.col("rival") & (F.col("n_p") * F.col("n_c") > _LEAF) if depth < _DEPTH else F.lit(False)
        found = _compared(at(depth, p), at(depth, c), cells.filter(F.col("rival") & ~big), keys, axes, point, dist_m, window_s, by_time)
        bounds = cells.groupBy(*keys, *axes).agg(F.min("bound").alias("hit")).filter(F.col("hit").isNotNull())
        here = at(depth, rows).join(bounds, [*keys, *axes]).select("id", "hit")
        here = here.unionByName(at(depth, rows).join(found, [*keys, *axes, *point]).select("id", "hit"))
        hits = here if hits is None else hits.unionByName(here)
        split = cells.filter(big)
        if split.isEmpty():
            break
        up = {a: F.shiftright(a, 1).alias(f"u_{a}") for a in axes}
        mine = at(depth + 1, p).groupBy(*keys, *axes).agg(F.count("*").alias("n_p")).select(*keys, *axes, *up.values(), "n_p")
        theirs = at(depth + 1, c).groupBy(*keys, *axes).agg(F.min("rank").alias("least"), F.count("*").alias("n_c"))
        theirs = theirs.select(*keys, *[F.col(a).alias(o) for a, o in other.items()], *[F.shiftright(a, 1).alias(f"v_{a}") for a in axes], "least", "n_c")
        split = split.select(*keys, *[F.col(a).alias(f"u_{a}") for a in axes], *[F.col(o).alias(f"v_{a}") for a, o in other.items()], "bound")
        pairs = split.join(mine, [*keys, *[f"u_{a}" for a in axes]]).join(theirs, [*keys, *[f"v_{a}" for a in axes]])
    return hits.groupBy("id").agg(F.min("hit").alias("hit"))


def _compared(
    p: DataFrame, c: DataFrame, edge: DataFrame, keys: list[str], axes: list[str], point: list[str], dist_m: float, window_s: float, by_time: bool
) -> DataFrame:
    """The best row within reach of each probe position, out of the cells at its edge."""
    # Of a cell only the rows better than some probe's bound can still win: in
    # a crowded place that is a handful, however many rows the cell holds.
    asked = edge.groupBy(*keys, *[F.col(f"n_{a}").alias(a) for a in axes]).agg(
        F.max("bound").alias("_top"), F.bool_or(F.col("bound").isNull()).alias("_any")
    )
    c = c.join(asked, [*keys, *axes]).filter(F.col("_any") | (F.col("rank") < F.col("_top")))
    left = p.join(edge.select(*keys, *axes, *[f"n_{a}" for a in axes], "bound"), [*keys, *axes])
    right = c.select(*keys, *[F.col(a).alias(f"n_{a}") for a in axes], F.col("rank").alias("hit"), *[F.col(a).alias(f"c_{a}") for a in point])
    on = geo.haversine_m("lon", "lat", "c_lon", "c_lat") <= dist_m
    on = on & (F.col("bound").isNull() | (F.col("hit") < F.col("bound")))
    if by_time:
        on = on & (F.abs(F.col("us") - F.col("c_us")) <= int(window_s * 1e6))
    met = left.join(right, [*keys, *[f"n_{a}" for a in axes]]).filter(on)
    return met.groupBy(*keys, *axes, *point).agg(F.min("hit").alias("hit"))


def find_duplicates(
    sightings: DataFrame,
    dist_m: float = DEDUPE_DIST_M,
    window_s: float = DEDUPE_WINDOW_S,
    ranks: Mapping[str, int] = SOURCE_PRIORITY,
) -> DataFrame:
    """``sighting_id`` of every duplicate with the row it repeats.

    Any row of a better source is visited before any of a worse one, so settling
    the sources in rank order against the rows that stayed is exactly the greedy
    pass over the sorted group. Sources without a rank come last, by name.
    """
    rows = materialise(_prepare(sightings, dist_m, window_s, ranks), "dedupe")
    levels = sorted((r.prio, r.src) for r in rows.select("prio", "src").distinct().collect())  # one per source
    found = rows.limit(0).select("id", F.lit(None).cast("string").alias("duplicate_of"))
    kept: DataFrame | None = None
    for prio, src in levels:
        probe = rows.filter((F.col("prio") == prio) & (F.col("src") == src))
        if kept is None:
            kept = probe
            continue
        hits, left = _tried(probe, kept, dist_m, window_s)
        for ids, by_time in zip(left, (True, False), strict=True):
            if not ids.isEmpty():
                rest = materialise(probe.join(ids, "id", "left_semi"), "rest")
                hits = hits.unionByName(_best(rest, kept, dist_m, window_s, by_time))
        dup = hits.groupBy("id").agg(F.min("hit").alias("hit")).select("id", F.col("hit.id").alias("duplicate_of"))
        dup = materialise(dup, "duplicates")
        found = found.unionByName(dup)
        kept = kept.unionByName(probe.join(dup.select("id"), "id", "left_anti"))
    return found.select(F.col("id").alias("sighting_id"), "duplicate_of")


def mark_duplicates(sightings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Set ``duplicate_of``; nothing is removed."""
    return sightings.drop("duplicate_of").join(duplicates, "sighting_id", "left").select(*sightings.columns)


def dedupe_counts(marked: DataFrame) -> DataFrame:
    """Total and marked rows per park."""
    return marked.groupBy("park").agg(
        F.count("*").alias("total"), F.count_if(F.col("duplicate_of").isNotNull()).alias("marked_duplicate")
    )
