"""Network searches against Dijkstra on networks with long chains, rings, one-way streets and edges of no length."""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from observatory.operators import graph

EDGES = "edge_id bigint, src bigint, dst bigint, length_m double, kind int, oneway int, coords array<struct<lon:double,lat:double>>"


def edges_frame(spark, rows):
    return spark.createDataFrame([(i, s, d, float(m), 0, one, [{"lon": float(s), "lat": 0.0}, {"lon": float(d), "lat": 0.0}]) for i, (s, d, m, one) in enumerate(rows)], EDGES)


def arcs_of(rows):
    out = {}
    for s, d, m, one in rows:
        for a, b in ((s, d), (d, s))[: 1 if one else 2]:
            out.setdefault(a, {})[b] = min(m, out.get(a, {}).get(b, math.inf))
    return out


def dijkstra(arcs, start):
    best, heap = {start: (0.0, 0)}, [(0.0, 0, start)]
    while heap:
        d, h, u = heapq.heappop(heap)
        if (d, h) > best[u]:
            continue
        for v, m in arcs.get(u, {}).items():
            if (d + m, h + 1) < best.get(v, (math.inf, 0)):
                best[v] = (d + m, h + 1)
                heapq.heappush(heap, (d + m, h + 1, v))
    return best


def network(seed, junctions=14, chains=24):
    """Junctions joined by chains of up to thirty edges, with dead ends, a ring on its own and a double road."""
    rng, rows, fresh = random.Random(seed), [], 1000
    for _ in range(chains):
        a, b, n = rng.randrange(junctions), rng.randrange(junctions), rng.choice([1, 1, 2, 5, 30])
        nodes = [a, *range(fresh, fresh + n - 1), b if rng.random() < 0.8 else fresh + n]
        fresh += n + 1
        one = rng.random() < 0.3
        for u, v in zip(nodes, nodes[1:], strict=False):
            if u != v:
                rows.append((u, v, rng.choice([0, 1, 5, 9]), int(one or rng.random() < 0.05)))
    rows += [(u, (u - 500 + 1) % 7 + 500, 3, 0) for u in range(500, 507)] + [(0, 1, 4, 0), (0, 1, 4, 0), (1, 0, 2, 1)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_distances_and_tree_equal_dijkstra(spark, seed):
    rows = network(seed)
    arcs, starts = arcs_of(rows), [0, 3, 5, 501]
    src = spark.createDataFrame([(s,) for s in starts], "node bigint")
    dist = graph.shortest_distances(src, edges_frame(spark, rows), "drive")
    got = {(r.source, r.node): r for r in dist.collect()}
    want = {(s, n): b for s in starts for n, b in dijkstra(arcs, s).items()}
    assert {k: (r.dist, r.hops) for k, r in got.items()} == want
    for (s, n), r in got.items():
        before = [u for u in arcs if n in arcs[u] and (s, u) in want and (want[s, u][0] + arcs[u][n], want[s, u][1] + 1) == want[s, n]]
        assert r.prev == (min(before) if n != s else None)
    near = graph.shortest_distances(src, edges_frame(spark, rows), "drive", 12.0)
    assert {(r.source, r.node): (r.dist, r.hops) for r in near.collect()} == {k: b for k, b in want.items() if b[0] <= 12}


def test_rounds_follow_junctions_and_paths_double(spark, monkeypatch):
    """A path of 300 edges: nine rounds of contraction, a handful of labels, and two tables per doubling of the path."""
    rows = [(i, i + 1, 1, 0) for i in range(300)]
    written = []
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label="cut": written.append(label) or real(df, label))
    dist = graph.shortest_distances(spark.createDataFrame([(0,)], "node bigint"), edges_frame(spark, rows), "drive")
    assert {r.node: r.dist for r in dist.collect()} == {i: float(i) for i in range(301)}
    assert written.count("chains") <= 11 and written.count("labels") <= 4
    written.clear()
    path = graph.trace_paths(dist, spark.createDataFrame([(0, 300), (0, 7)], "source bigint, target bigint"), edges_frame(spark, rows)).collect()
    assert len(written) <= 2 * 9 + 1
    assert [r.edge_id for r in sorted(path, key=lambda r: r.pos) if r.target == 300] == list(range(300))
    assert [r.pos for r in sorted(path, key=lambda r: r.pos) if r.target == 7] == list(range(7))


@pytest.mark.parametrize("seed", [1])
def test_trip_matrix_equals_dijkstra(spark, seed):
    rng, rows = random.Random(seed), network(seed, junctions=10)
    arcs = arcs_of(rows)
    nodes = sorted({n for r in rows for n in r[:2]})
    at = {n: (i * 0.01, 0.0) for i, n in enumerate(nodes)}
    frame = spark.createDataFrame([(n, *xy, True) for n, xy in at.items()], "node bigint, lon double, lat double, road boolean")
    trips = {t: rng.sample(nodes, 5) for t in range(4)} | {9: [500, 503, 0]}
    sites = [(t, f"s{i}", *at[n], i == 0) for t, ns in trips.items() for i, n in enumerate(ns)] + [(9, "twin", *at[503], False)]
    trips[9].append(503)
    got = graph.distance_matrix(spark.createDataFrame(sites, "trip int, site string, lon double, lat double, is_start boolean"), frame, edges_frame(spark, rows), "drive")
    names = {t: {s: n for (tt, s, *_), n in zip([x for x in sites if x[0] == t], ns, strict=True)} for t, ns in trips.items()}
    want = {}
    for t, stops in names.items():
        live = {s: n for s, n in stops.items() if n in dijkstra(arcs, stops["s0"])}
        for a, u in live.items():
            far = dijkstra(arcs, u)
            want |= {(t, a, b): far[v][0] for b, v in live.items() if a != b and v in far}
    assert {(r.trip, r.from_site, r.to_site): r.distance_m for r in got.collect()} == want


def test_a_search_stops_at_its_goals(spark):
    rows = [(i, i + 1, 1, 0) for i in range(200)] + [(i, i + 1000, 1, 0) for i in range(200)]  # a comb: every node of the road is a junction
    net = graph.Network(edges_frame(spark, rows), "drive", spark.createDataFrame([(0,), (5,)], "node bigint"))
    start = spark.createDataFrame([(0, 0)], "search bigint, node bigint")
    goal = spark.createDataFrame([(0, 0, None), (0, 5, None)], "search bigint, node bigint, at_most double")
    labels = graph.settle(start, net.roads(), goals=goal)
    assert labels.filter("node = 5").first().dist == 5.0
    assert labels.count() < 20 < graph.settle(start, net.roads()).count()
    known = graph.settle(start, net.roads(), goals=goal.withColumn("at_most", F.lit(5.0)))
    assert known.filter("node = 5").first().dist == 5.0 and known.agg(F.max("dist")).first()[0] <= 5.0


def test_weak_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in range(100):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = graph.weak_components(spark.createDataFrame(pairs, "src bigint, dst bigint"))
    assert {r.node: r.component for r in got.collect()} == root


def test_contraction_and_late_rounds_carry_only_what_is_open(spark, monkeypatch):
    """Forty short roads beside a long one: arcs and searches that are done are not written again."""
    monkeypatch.setattr(graph, "MANY_SEARCHES", 2)
    long = [(i, i + 1, 1, 0) for i in range(12)] + [(i, i + 500, 1, 0) for i in range(12)]  # a comb
    rows = long + [(1000 + 10 * i, 1001 + 10 * i, 2, 0) for i in range(40)] + [(2000 + i, 2001 + i, 1, 0) for i in range(16)]
    sizes, real = {}, graph.materialise

    def counted(df, label="cut"):
        out = real(df, label)
        sizes.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "materialise", counted)
    starts = [0, 2000, *range(1000, 1400, 10)]
    dist = graph.shortest_distances(spark.createDataFrame([(s,) for s in starts], "node bigint"), edges_frame(spark, rows), "drive")
    arcs = arcs_of(rows)
    assert {(r.source, r.node): (r.dist, r.hops) for r in dist.collect()} == {(s, n): b for s in starts for n, b in dijkstra(arcs, s).items()}
    assert sizes["labels"][4] < 40 <= sizes["labels"][0] and sizes["searches"][0] <= 21
    assert sizes["chains"][1] <= 32 and sizes["chains"][-1] < sizes["chains"][1]  # the arcs of the one road with inner nodes


def test_pieces_of_a_batch_equal_those_of_each_way(monkeypatch):
    monkeypatch.setattr(graph, "SIDE_BY_SIDE", 12)
    rng = np.random.default_rng(5)
    offsets = np.append(0, np.cumsum(rng.integers(0, 30, 200)))
    m = rng.choice([0.0, 10.0, 99.5, 150.0, 400.0, np.nan], offsets[-1], p=[0.1, 0.3, 0.3, 0.2, 0.09, 0.01])
    stop = np.append(rng.random(offsets[-1]) < 0.2, False)
    stop[offsets[1:] - 1] = True
    want = []
    for i, (first, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        stops = (np.flatnonzero(stop[first + 1:end]) + 1).tolist()
        want += [(i, first + a, first + b, x) for a, b, x in graph._pieces(m[first:max(first, end - 1)], stops, 300.0)]
    got = list(zip(*(c.tolist() for c in graph._all_pieces(offsets, m, stop, 300.0)), strict=True))
    assert str(got) == str(want) and len(got) > 300
