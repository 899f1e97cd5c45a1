"""Embedding near-duplicates: an exact metric range join over pivots.

Unit vectors are compared by their distance on the sphere's chord, where a
cosine of at least c is a distance of at most sqrt(2 - 2c). Every vector belongs
to its nearest pivot; with a cell's radius the triangle inequality says which
vectors from other cells can reach into it, and only those are copied there. A
cell that lies wholly within reach of a vector is counted without a copy. Cells
are then joined independently, cut into blocks of bounded size. A block writes
how many links each of its own vectors has and links of a spanning forest, not
its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from observatory.llm.links import components, local_roots
from observatory.llm.vectors import matrix, of_width, plain, usable
from observatory.session import materialise

SLACK = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def pick_pivots(points: DataFrame, rows: int) -> np.ndarray:
    """A sixteenth of the square root of ``rows`` vectors, by the hash of their id: cells and pivots grow alike."""
    k = max(1, math.isqrt(rows) // 16)
    got = points.orderBy(F.xxhash64("node"), "node").select("vec").limit(k).collect()
    return unit(np.array([r.vec for r in got], np.float64))


def close(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (unit length) with at least ``cosine``.

    Single precision leaves out what is surely below; double precision decides
    the rest.
    """
    rough = a.astype(np.float32) @ b.astype(np.float32).T >= cosine - 1e-5 - 2e-7 * a.shape[1]
    if np.count_nonzero(rough) > 1 << 17:
        return np.nonzero(a @ b.T >= cosine)
    x, y = np.nonzero(rough)
    sure = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
    return x[sure], y[sure]


def near_duplicates(
    df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096
) -> DataFrame:
    """vec_id, n_links and component_id of every row of ``df``.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing and are their own component. Vectors of different lengths
    do not link. Equal vectors are compared once and count each other; rows that
    repeat an id are rows of their own, linked like any other. Rows with a null
    id take part and have a null component unless a linked row has an id. Ties do
    not occur: a pair is linked or it is not. Only the two named columns are
    read; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = plain(df, id_col, vector_col)
    classes = rows.groupBy("vec").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    points = materialise(classes.withColumn("node", F.xxhash64("vec")), "points")
    counts = spark.createDataFrame([], "node bigint, links bigint")
    edges = spark.createDataFrame([], "a bigint, b bigint")
    for width, n in of_width(points):
        more, others = _linked(points.filter(F.size("vec") == width), n, cosine, block)
        counts, edges = counts.union(more), edges.union(others)
    total = counts.groupBy("node").agg(F.sum("links").alias("links"))
    groups = materialise(components(edges, "vector-links"), "vector-groups")
    known = points.select("vec", "node", "first").join(total, "node", "left").join(groups, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least, "component").select("vec", F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    good = rows.join(materialise(known, "vector-classes"), "vec").select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = df.filter(~usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("vec_id"))
    return good.union(alone.select("vec_id", F.lit(0).cast("bigint"), "vec_id"))


def _linked(points: DataFrame, rows: int, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Link counts (node, links) and links (a, b) between vectors of one length."""
    spark = points.sparkSession
    kind = points.schema["vec"].dataType.simpleString()
    reach = math.sqrt(2 - 2 * cosine)
    pivots = spark.sparkContext.broadcast(pick_pivots(points, rows))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = chords(unit(matrix(batch.column(2))), pivots.value)
            cell = d.argmin(axis=1)
            yield pa.record_batch(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])],
                names=["node", "weight", "vec", "cell", "radius"],
            )

    homes = materialise(points.select("node", "weight", "vec").mapInArrow(home, f"node bigint, weight bigint, vec {kind}, cell int, radius double"), "cells")
    cells = homes.groupBy("cell").agg(F.max("radius").alias("radius"), F.min("node").alias("node")).collect()  # one row per pivot
    radius, head = np.full(len(pivots.value), np.inf), np.zeros(len(pivots.value), np.int64)
    for c in cells:
        radius[c.cell], head[c.cell] = c.radius, c.node
    facts = spark.sparkContext.broadcast((radius, head))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every vector: a copy for its own cell and for those it may reach.

        Cells that it reaches whole (kind 1: cell, weight) get its weight for all
        their vectors, and one link each (kind 2); itself is taken off again
        (kind 3).
        """
        p = pivots.value
        radius, head = facts.value
        between = np.maximum(chords(p, p), 1e-12)
        for batch in batches:
            node, weight, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            d = chords(unit(matrix(batch.column(2))), p)
            at = np.arange(len(d))
            whole = d + radius <= reach - SLACK
            beyond = (d * d - d[at, own][:, None] ** 2) / (2 * between[own])  # how far the cell's border is
            partly = (d - radius <= reach + SLACK) & (beyond <= reach + SLACK) & ~whole & np.isfinite(radius)
            partly[at, own] = True
            row, cell = np.nonzero(partly)
            given = whole.T.astype(np.int64) @ weight
            some = np.flatnonzero(given)
            has = np.flatnonzero(whole.any(axis=1))
            first = whole.argmax(axis=1)
            pairs = np.unique(np.stack([np.repeat(first, whole.sum(axis=1)), np.nonzero(whole)[1]], axis=1), axis=0)
            joined = local_roots(len(p), pairs[:, 0], pairs[:, 1])
            moved = np.flatnonzero(joined != np.arange(len(p)))
            off = node[whole[at, own]]
            tail = [
                (some, given[some], 1), (node[has], head[first[has]], 2), (head[moved], head[joined[moved]], 2), (off, np.full(len(off), -1), 3),
            ]
            extra = sum(len(t[0]) for t in tail)
            mine = own[row] == cell
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([np.zeros(len(row), np.int32), *[np.full(len(t[0]), t[2], np.int32) for t in tail]])),
                    pa.array(np.concatenate([node[row], *[t[0] for t in tail]]).astype(np.int64)),
                    pa.array(np.concatenate([weight[row], *[t[1] for t in tail]]).astype(np.int64)),
                    pa.array(np.concatenate([cell, np.zeros(extra)]).astype(np.int32)),
                    pa.array(np.concatenate([mine, np.zeros(extra, bool)])),
                    pa.array(np.concatenate([~(mine & whole[row, cell]), np.zeros(extra, bool)])),
                    pa.concat_arrays([batch.column(2).take(pa.array(row)), pa.nulls(extra, batch.column(2).type)]),
                ],
                names=["kind", "node", "other", "cell", "is_left", "is_right", "vec"],
            )

    shape = f"kind int, node bigint, other bigint, cell int, is_left boolean, is_right boolean, vec {kind}"
    out = materialise(homes.select("node", "weight", "vec", "cell").mapInArrow(spread, shape), "copies")
    copies = out.filter("kind = 0")
    sizes = copies.groupBy("cell").agg(F.count_if("is_left").alias("n_left"), F.count_if("is_right").alias("n_right"))
    dealt = copies.join(sizes.filter("n_left > 0 and n_right > 0"), "cell")  # one row per pivot on the right
    lefts, rights = F.ceil(F.col("n_left") / block).cast("int"), F.ceil(F.col("n_right") / block).cast("int")
    turn = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = dealt.filter("is_left").select("cell", F.pmod(turn, lefts).cast("int").alias("i"), every(rights).alias("j"), F.lit(True).alias("is_left"), "node", "other", "vec")
    right = dealt.filter("is_right").select("cell", every(lefts).alias("i"), F.pmod(turn, rights).cast("int").alias("j"), F.lit(False).alias("is_left"), "node", "other", "vec")

    def compare(rows: pa.Table) -> pa.Table:
        is_left = rows.column("is_left").to_numpy()
        node, weight = rows.column("node").to_numpy(), rows.column("other").to_numpy()
        vectors = unit(matrix(rows.column("vec")))
        names, place = np.unique(node, return_inverse=True)
        a, b = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        for s in range(0, len(a), 256):
            x, y = close(vectors[a[s:s + 256]], vectors[b], cosine)
            pairs_a, pairs_b = place[a[s + x]], place[b[y]]
            apart = pairs_a != pairs_b
            pairs_a, pairs_b, gain = pairs_a[apart], pairs_b[apart], weight[b[y[apart]]]
            links += np.bincount(pairs_a, gain, len(names)).astype(np.int64)
            if len(pairs_a):
                root = local_roots(len(names), np.concatenate([pairs_a, np.arange(len(names))]), np.concatenate([pairs_b, root]))
        # copies of a vector link with each other; they are counted in the block that compares the vector with itself
        both = np.intersect1d(place[a], place[b])
        own = np.zeros(len(names), np.int64)
        own[place] = weight
        links[both] += own[both] - 1
        some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(names)))
        return pa.table({
            "kind": np.repeat(np.array([3, 2], np.int32), [len(some), len(moved)]),
            "node": np.concatenate([names[some], names[moved]]), "other": np.concatenate([links[some], names[root[moved]]]),
        })

    joined = materialise(left.union(right).groupBy("cell", "i", "j").applyInArrow(compare, "kind int, node bigint, other bigint"), "joined")
    given = out.filter("kind = 1").groupBy(F.col("node").cast("int").alias("cell")).agg(F.sum("other").alias("other"))
    both = joined.unionByName(out.filter("kind > 1").select("kind", "node", "other"))
    counts = both.filter("kind = 3").select("node", F.col("other").alias("links")).union(
        homes.join(given, "cell").select("node", F.col("other").alias("links"))
    )
    return counts, both.filter("kind = 2").select(F.col("node").alias("a"), F.col("other").alias("b"))
