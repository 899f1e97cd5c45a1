"""A hexagonal grid as column expressions.

Equal-area cylindrical projection, pointy-top axial coordinates by cube
rounding, edges growing by the square root of seven per coarser resolution, so
resolution 9 has a 174 m edge and resolution 6 about 3.2 km. A cell is one
``bigint``: resolution, q and r in fixed-width fields, so a neighbour is an
integer addition and every join on cells is a plain long equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6371008.8
EDGE_R9_M = 174.375668
COS_STD = math.cos(math.radians(45.0))
FIELD = 1 << 28
HALF = 1 << 27
NO_CELL = -1


def edge_m(res: int) -> float:
    return EDGE_R9_M * math.sqrt(7.0) ** (9 - res)


def edge_col(res: Column) -> Column:
    return F.lit(EDGE_R9_M) * F.pow(F.sqrt(F.lit(7.0)), F.lit(9) - res)


def cell_of(lon: Column, lat: Column, res: int | Column = 9) -> Column:
    """The cell id holding a point; without coordinates it is ``NO_CELL``.

    Never null on purpose: a nullable join or group key makes the optimizer add
    a not-null filter, and that filter would evaluate this expression again.
    """
    edge = F.lit(edge_m(res)) if isinstance(res, int) else edge_col(res)
    x = F.lit(R * COS_STD) * F.radians(lon)
    y = F.lit(R / COS_STD) * F.sin(F.radians(lat))
    qf = (F.lit(math.sqrt(3.0) / 3.0) * x - y / 3.0) / edge
    rf = (F.lit(2.0 / 3.0) * y) / edge
    sf = -qf - rf
    q0, r0, s0 = (F.floor(v + 0.5).cast("double") for v in (qf, rf, sf))
    dq, dr, ds = F.abs(q0 - qf), F.abs(r0 - rf), F.abs(s0 - sf)
    fix_q = (dq > dr) & (dq > ds)
    q = F.when(fix_q, -r0 - s0).otherwise(q0)
    r = F.when(~fix_q & (dr > ds), -q0 - s0).otherwise(r0)
    level = F.lit(res) if isinstance(res, int) else res
    return F.coalesce(_pack(level, q.cast("bigint"), r.cast("bigint")), F.lit(NO_CELL))


def _pack(res: Column, q: Column, r: Column) -> Column:
    return (res.cast("bigint") * FIELD + (q + HALF)) * FIELD + (r + HALF)


def cell_res(cell: Column) -> Column:
    return F.shiftright(cell, 56).cast("int")


def _axial(cell: Column) -> tuple[Column, Column]:
    r = cell.bitwiseAND(F.lit(FIELD - 1).cast("bigint")) - HALF
    q = F.shiftright(cell, 28).bitwiseAND(F.lit(FIELD - 1).cast("bigint")) - HALF
    return q, r


def disk(cell: Column, k: int) -> Column:
    """Cells within ``k`` steps, the cell itself included."""
    offsets = [
        dq * FIELD + dr
        for dq in range(-k, k + 1)
        for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)
    ]
    return F.transform(F.array(*[F.lit(o).cast("bigint") for o in offsets]), lambda o: cell + o)


def _plane(cell: Column, res: int | None) -> tuple[Column, Column, Column]:
    q, r = _axial(cell)
    edge = edge_col(cell_res(cell)) if res is None else F.lit(edge_m(res))
    x = edge * F.lit(math.sqrt(3.0)) * (q + r / 2.0)
    y = edge * 1.5 * r
    return x, y, edge


def _to_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(R * COS_STD))


def _to_lat(y: Column) -> Column:
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * F.lit(COS_STD / R)))))


def center(cell: Column, res: int | None = None) -> Column:
    """Centre of a cell as ``struct<lon,lat>``; pass ``res`` when all cells share it."""
    x, y, _ = _plane(cell, res)
    return F.named_struct(F.lit("lon"), _to_lon(x), F.lit("lat"), _to_lat(y))


def boundary(cell: Column, decimals: int = 5) -> Column:
    """Closed ring of the six corners, rounded half-even."""
    x, y, edge = _plane(cell, None)
    corners = []
    for i in (0, 1, 2, 3, 4, 5, 0):
        angle = math.radians(60.0 * i - 30.0)
        corners.append(
            F.named_struct(
                F.lit("lon"), F.bround(_to_lon(x + edge * math.cos(angle)), decimals),
                F.lit("lat"), F.bround(_to_lat(y + edge * math.sin(angle)), decimals),
            )
        )
    return F.array(*corners)


def parent(cell: Column, res: int) -> Column:
    """The coarser cell holding this cell's centre."""
    c = center(cell)
    return cell_of(c["lon"], c["lat"], res)
