"""Approximate nearest neighbours: a navigable small-world graph per shard.

Vectors are dealt into shards by hash. A shard's graph has levels of
geometrically fewer nodes; each node keeps near neighbours in different
directions, stored as flat arrays, and the index is a table with one row per
shard. A search descends greedily through the upper levels and widens to a beam
on the lowest, for a block of queries at once; the shards' results are merged by
exact distance.

Equal vectors are one node that carries its smallest ids, as many as a result
can hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.llm.vectors import matrix, plain
from observatory.session import materialise

INDEX = "width int, shard int, ids array<array<bigint>>, vectors array<double>, levels array<array<int>>, neighbours array<array<int>>"
CHUNK = 256


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T))


def diverse(v: np.ndarray, cand: np.ndarray, dist: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` of each row's candidates (-1 pads, nearest first): those nearer to the row than to any kept so far, then the nearest of the rest."""
    out = np.full((len(cand), keep), -1, np.int32)
    for s in range(0, len(cand), CHUNK):
        c, d = cand[s:s + CHUNK], dist[s:s + CHUNK]
        x = v[c]
        sq = (x * x).sum(2)
        between = sq[:, :, None] + sq[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
        kept, n = np.zeros(c.shape, bool), np.zeros(len(c), np.int64)
        closest = np.full(c.shape, np.inf, np.float32)
        for k in range(c.shape[1]):
            take = (c[:, k] >= 0) & (d[:, k] < closest[:, k]) & (n < keep)
            kept[:, k] = take
            n += take
            closest = np.where(take[:, None], np.minimum(closest, between[:, k]), closest)
        order = np.argsort(np.where(c < 0, 2, ~kept), axis=1, kind="stable")[:, :keep]
        out[s:s + CHUNK, :order.shape[1]] = np.take_along_axis(c, order, axis=1)
    return out


def nearest_first(v: np.ndarray, owner: np.ndarray, other: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The links owner-other as one padded row per owner, nearest first, at most ``most`` each."""
    key = np.unique(owner.astype(np.int64) * n + other)
    owner, other = key // n, key % n
    d = ((v[owner] - v[other]) ** 2).sum(1)
    order = np.lexsort((other, d, owner))
    owner, other, d = owner[order], other[order], d[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    ok = place < most
    cand, dist = np.full((n, most), -1, np.int32), np.full((n, most), np.inf, np.float32)
    cand[owner[ok], place[ok]], dist[owner[ok], place[ok]] = other[ok], d[ok]
    return cand, dist


def connect(v: np.ndarray, keep: int, width: int) -> np.ndarray:
    """Neighbours (rows of ``keep``, -1 pads) of all rows of ``v``, which join in their order.

    Rows join in doubling batches and look for neighbours among those that are
    there by then, so the first rows keep long links; links go both ways and are
    thinned to diverse ones after each batch.
    """
    n, links = len(v), np.full((len(v), keep), -1, np.int32)
    start = 1
    while start < n:
        stop = min(n, 2 * start)
        found = []
        for s in range(start, stop, CHUNK):
            e = min(stop, s + CHUNK)
            d = squares(v[s:e], v[:stop])
            d[np.arange(e - s), np.arange(s, e)] = np.inf
            most = min(width, stop - 1)
            c = np.argpartition(d, most - 1, axis=1)[:, :most]
            near = np.take_along_axis(d, c, axis=1)
            order = np.argsort(near, axis=1, kind="stable")
            found.append(diverse(v, np.take_along_axis(c, order, axis=1), np.take_along_axis(near, order, axis=1), max(1, keep // 2)))
        new = np.concatenate(found)
        a, b = np.repeat(np.arange(start, stop), new.shape[1])[new.ravel() >= 0], new.ravel()[new.ravel() >= 0]
        old = links[:stop]
        x, y = np.repeat(np.arange(stop), keep)[old.ravel() >= 0], old.ravel()[old.ravel() >= 0]
        cand, dist = nearest_first(v, np.concatenate([a, b, x]), np.concatenate([b, a, y]), stop, 2 * keep)
        links[:stop] = diverse(v, cand, dist, keep)
        start = stop
    return links


class Graph:
    """One shard: vectors, nodes of every level (all of them on level 0) and their neighbours there."""

    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], neighbours: list[np.ndarray]):
        self.vectors, self.levels, self.neighbours = vectors, levels, neighbours
        self.small = vectors.astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = 16, width: int = 64) -> Graph:
        """Rows join in the given order; the level of a row is drawn with a fixed seed."""
        n = len(vectors)
        tall = np.floor(-np.log(1 - np.random.default_rng(7).random(n)) / math.log(links)).astype(int)
        v = vectors.astype(np.float32)
        levels, neighbours = [], []
        for level in range(int(tall.max(initial=0)) + 1):
            nodes = np.flatnonzero(tall >= level).astype(np.int32)
            keep = 2 * links if level == 0 else links
            near = connect(v[nodes], keep, width)
            levels.append(nodes)
            neighbours.append(np.where(near < 0, -1, nodes[near]).astype(np.int32))
        return cls(vectors, levels, neighbours)

    def search(self, queries: np.ndarray, k: int, beam: int = 128, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Node and exact distance of the ``k`` nearest found per query, nearest first; -1 pads."""
        q, v = queries.astype(np.float32), self.small
        rows = np.arange(len(q))
        at = np.full(len(q), self.levels[-1][0])
        best = ((v[at] - q) ** 2).sum(1)
        for nodes, near in zip(self.levels[:0:-1], self.neighbours[:0:-1], strict=True):
            active = rows
            while len(active):
                around = near[np.searchsorted(nodes, at[active])]
                d = np.where(around < 0, np.inf, ((v[around] - q[active, None]) ** 2).sum(2))
                j = d.argmin(axis=1)
                better = d[np.arange(len(j)), j] < best[active]
                active, j, around, d = active[better], j[better], around[better], d[better]
                at[active], best[active] = around[np.arange(len(j)), j], d[np.arange(len(j)), j]
        beam = min(beam, len(v))
        ids, dist = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), np.inf, np.float32)
        ids[:, 0], dist[:, 0] = at, best
        done, seen = np.zeros(ids.shape, bool), np.zeros((len(q), len(v)), bool)
        seen[rows, at] = True
        active = rows
        while True:
            waiting = np.where(done[active] | (ids[active] < 0), np.inf, dist[active])
            active = active[np.isfinite(waiting.min(axis=1))]
            if not len(active):
                break
            waiting = np.where(done[active] | (ids[active] < 0), np.inf, dist[active])
            pick = np.argsort(waiting, axis=1, kind="stable")[:, :at_once]
            open_ = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            nodes = np.where(open_, np.take_along_axis(ids[active], pick, axis=1), -1)
            marks = done[active]
            np.put_along_axis(marks, pick, True, axis=1)
            around = np.where(nodes[:, :, None] < 0, -1, self.neighbours[0][nodes]).reshape(len(active), -1)
            around = np.sort(around, axis=1)
            fresh = around >= 0
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            fresh &= ~seen[active[:, None], around]
            seen[np.broadcast_to(active[:, None], around.shape)[fresh], around[fresh]] = True
            d = np.full(around.shape, np.inf, np.float32)
            r, c = np.nonzero(fresh)
            d[r, c] = ((v[around[r, c]] - q[active[r]]) ** 2).sum(1)
            all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], axis=1)
            all_d = np.concatenate([dist[active], d], axis=1)
            all_done = np.concatenate([marks, np.zeros(around.shape, bool)], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[active], dist[active], done[active] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_d, all_done))
        exact = np.sqrt(((self.vectors[ids] - queries[:, None]) ** 2).sum(2))
        exact[ids < 0] = np.inf
        order = np.argsort(exact, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(exact, order, axis=1)


def build_index(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096) -> DataFrame:
    """One row per shard of every usable vector's graph.

    Null, empty, zero and non-finite vectors take no part; vectors of different
    lengths are in different shards. Of equal vectors the ``k + 1`` smallest ids
    are kept, null ids last: no result of ``k`` can reach beyond them.
    """
    rows = plain(df, id_col, vector_col)
    order = W.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    nodes = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = materialise(nodes.select("ids", "vec", F.size("vec").alias("width")), "nodes")
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("turn")
        graph = Graph.build(matrix(table.column("vec")))
        flat = lambda arrays, kind: pa.array([[np.asarray(a).ravel() for a in arrays]], pa.list_(pa.list_(kind)))
        return pa.table({
            "width": table.column("width")[:1], "shard": table.column("shard")[:1],
            "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([graph.vectors.ravel()], pa.list_(pa.float64())),
            "levels": flat(graph.levels, pa.int32()), "neighbours": flat(graph.neighbours, pa.int32()),
        })

    turned = nodes.withColumn("turn", F.xxhash64(F.lit(1), "vec"))
    return materialise(turned.groupBy("width", "shard").applyInArrow(build, INDEX), "index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = 128, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest found of every query.

    Rows with the query's own id are no candidates; fewer than ``k`` candidates
    are all returned. Ties go to the smaller id. Of queries that share an id the
    smallest vector asks; queries with a null id or an unusable vector, and
    queries of a length that no indexed vector has, give nothing. Queries are
    dealt in blocks, and each block meets each shard of its length once.
    """
    asks = plain(queries, id_col, vector_col).filter("vec_id is not null").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asks = materialise(asks.withColumn("width", F.size("vec")), "queries")
    blocks = max(1, math.ceil(asks.count() / block))
    asks = asks.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("width").alias("of"), F.expr("shard + 0").alias("part"))
    right = asks.join(shards, F.col("width") == F.col("of")).select("width", F.col("part").alias("shard"), "block", "vec_id", "vec")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(graphs: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(graphs) and len(asked):
            row = graphs.slice(0, 1).to_pylist()[0]
            ids, width = row["ids"], row["width"]
            links = [len(n) // max(1, len(at)) for n, at in zip(row["neighbours"], row["levels"], strict=True)]
            graph = Graph(
                np.array(row["vectors"], np.float64).reshape(-1, width), [np.array(x, np.int32) for x in row["levels"]],
                [np.array(x, np.int32).reshape(-1, n) for x, n in zip(row["neighbours"], links, strict=True)],
            )
            nodes, dist = graph.search(matrix(asked.column("vec")), k + 1, beam)
            for q, found, d in zip(asked.column("vec_id").to_pylist(), nodes.tolist(), dist.tolist(), strict=True):
                near = [(s, i is None, i) for node, s in zip(found, d, strict=True) if node >= 0 for i in ids[node] if i != q]
                out += [(q, i, s) for s, _, i in sorted(near, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ("width", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, "query_id bigint, vec_id bigint, score double")
    best = W.partitionBy("query_id").orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

