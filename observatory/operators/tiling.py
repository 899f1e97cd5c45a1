"""Boxes to tiles, and adaptive quadtree tiling of a point table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.functions import geo

# Tile width, the row count that splits a tile, the least width.
TILE_DEG = 0.05
CAP_ROWS = 1500
MIN_SPLIT_DEG = 0.002


def tile_boxes(boxes: DataFrame, tile_deg: float = TILE_DEG) -> DataFrame:
    """An exact cover of each box by tiles, row by row from the south-west (G1).

    The last column and row are clipped, never overhanging, and float noise
    never makes a sliver. ``boxes``: key, min_lon, min_lat, max_lon, max_lat.
    """
    if not 0 < tile_deg < 0.1:
        raise ValueError("tile_deg must be positive and under 0.1")

    def steps(lo: str, hi: str) -> Column:
        n = F.ceil((F.col(hi) - F.col(lo)) / tile_deg - 1e-9)
        return F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)) - 1)

    grid = boxes.withColumn("row", F.explode(steps("min_lat", "max_lat"))).withColumn(
        "col", F.explode(steps("min_lon", "max_lon"))
    )
    lon0 = F.col("min_lon") + F.col("col") * F.lit(tile_deg)
    lat0 = F.col("min_lat") + F.col("row") * F.lit(tile_deg)
    tile = geo.box_struct(
        lon0, lat0, F.least(lon0 + tile_deg, F.col("max_lon")), F.least(lat0 + tile_deg, F.col("max_lat"))
    )
    out = grid.select("key", "row", "col", tile.alias("tile"))
    thin = (geo.box_width(F.col("tile")) <= 1e-12) | (geo.box_height(F.col("tile")) <= 1e-12)
    return out.filter(~thin).withColumn("tile_id", geo.box_id(F.col("tile")))


def quarter(tiles: DataFrame) -> DataFrame:
    """Each tile's four quarters."""
    return tiles.select("key", F.col("tile_id").alias("parent_id"), F.posexplode(geo.box_quarters(F.col("tile"))).alias("quarter", "tile")).withColumn(
        "tile_id", geo.box_id(F.col("tile"))
    )


def depth_limit(tile_deg: float, min_deg: float = MIN_SPLIT_DEG) -> int:
    """How often a tile can be halved while it is wider than the least width."""
    depth = 0
    while tile_deg / 2**depth > min_deg:
        depth += 1
    return depth


def adaptive_tiles(
    points: DataFrame, origin: tuple[float, float], tile_deg: float = TILE_DEG, cap: int = CAP_ROWS, min_deg: float = MIN_SPLIT_DEG
) -> DataFrame:
    """Quadtree over a point table: tiles holding ``cap`` rows split until they
    do not or are at the least width (G3). Statuses: split, capped, done.

    Points are counted once, at the deepest level, combining before the
    shuffle; every coarser count is a rollup of that. A tile was visited exactly
    when its parent split, so no level waits for another and nothing is looped.
    Tiles are half-open squares on a grid from ``origin``.
    """
    deepest = depth_limit(tile_deg, min_deg)
    unit = tile_deg / 2**deepest
    ix = F.floor((F.col("lon") - origin[0]) / unit).cast("bigint")
    iy = F.floor((F.col("lat") - origin[1]) / unit).cast("bigint")
    fine = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).groupBy(ix.alias("ix"), iy.alias("iy")).agg(
        F.count("*").alias("n")
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(deepest)))
    scale = F.pow(F.lit(2), F.lit(deepest) - F.col("level"))
    counts = (
        fine.withColumn("level", levels)
        .groupBy("level", F.floor(F.col("ix") / scale).alias("tx"), F.floor(F.col("iy") / scale).alias("ty"))
        .agg(F.sum("n").alias("n"))
    )
    split = counts.filter((F.col("n") >= cap) & (F.col("level") < deepest))
    corner = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (0, 1) for dx in (0, 1)])
    children = split.select("level", "tx", "ty", F.explode(corner).alias("c")).select(
        (F.col("level") + 1).alias("level"), (F.col("tx") * 2 + F.col("c.dx")).alias("tx"), (F.col("ty") * 2 + F.col("c.dy")).alias("ty")
    )
    roots = counts.filter(F.col("level") == 0).select("level", "tx", "ty")
    visited = roots.unionByName(children).join(counts, ["level", "tx", "ty"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.lit(tile_deg) / F.pow(F.lit(2.0), F.col("level"))
    lon0, lat0 = F.lit(origin[0]) + F.col("tx") * size, F.lit(origin[1]) + F.col("ty") * size
    status = F.when((F.col("n") >= cap) & (F.col("level") < deepest), "split").when(F.col("n") >= cap, "capped").otherwise("done")
    tile = geo.box_struct(lon0, lat0, lon0 + size, lat0 + size)
    return visited.withColumn("status", status).withColumn("tile_id", geo.box_id(tile))

