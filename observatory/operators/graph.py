"""Road and trail graph: building, snapping, distances and paths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from observatory.functions import geo, labels
from observatory.operators import lines
from observatory.operators.spatial import nearest
from observatory.session import materialise

# Longest edge, tolerance, speeds and the stop overhead.
MAX_EDGE_M = 300.0
SIMPLIFY_M = 5.0
COORD_DECIMALS = 5
MANY_SEARCHES = 4096  # below so many, searches that have ended stay in the table
SIDE_BY_SIDE = 256  # vertices of a way that is cut along with others
SPEED_MS = {"drive": 15.6, "hike": 1.39}
STOP_OVERHEAD_S = 300.0


def _tag(key: str) -> Column:
    return F.try_element_at("tags", F.lit(key))


def usable_ways(ways: DataFrame) -> DataFrame:
    """Ways worth routing (P10).

    ``ways``: id, tags, nodes, geometry, and optionally ``inside``: whether the
    middle vertex lies in the boundary; outside only major roads stay.
    """
    hw = _tag("highway")
    keep = (
        hw.isin(*labels.ROAD_TAGS, *labels.TRAIL_TAGS)
        & ~hw.isin(*labels.NEVER_TAGS)
        & ~F.coalesce(_tag("access").isin(*labels.NO_ACCESS), F.lit(False))
        & ~F.coalesce(_tag("motor_vehicle") == "private", F.lit(False))
        & (F.size("nodes") == F.size("geometry"))
        & (F.size("nodes") >= 2)
    )
    if "inside" in ways.columns:
        keep = keep & (F.col("inside") | hw.isin(*labels.MAJOR_TAGS))
    return ways.filter(keep)


def junctions(ways: DataFrame) -> DataFrame:
    """Nodes used at least twice over the kept ways."""
    return (
        ways.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("uses")).filter(F.col("uses") >= 2)
    )


def _pieces(m: np.ndarray, stops: list[int], longest: float) -> list[tuple[int, int, float]]:
    """(first vertex, last vertex, length) of a way with legs ``m``, cut at ``stops`` and where a piece reaches ``longest``."""
    out, start = [], 0
    for stop in stops:
        while start < stop:
            ahead = 64
            while True:
                run = np.cumsum(m[start:min(start + ahead, stop)])
                at = int(np.searchsorted(run, longest))
                if at < len(run) or start + ahead >= stop:
                    break
                ahead *= 4
            end = min(start + at + 1, stop)
            out.append((start, end, float(run[end - start - 1])))
            start = end
    return out


def _all_pieces(offsets: np.ndarray, m: np.ndarray, stop: np.ndarray, longest: float) -> tuple[np.ndarray, ...]:
    """(way, first vertex, last vertex, length) of the pieces of all ways of a batch, in order.

    ``stop`` marks the vertices to cut at, the last of a way among them. Short ways
    advance side by side, a leg a step; long ones go one by one.
    """
    first, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64) - 1
    found = []
    for i in np.flatnonzero(end - first >= SIDE_BY_SIDE).tolist():
        stops = np.flatnonzero(stop[first[i] + 1:end[i] + 1]) + 1
        found += [(i, first[i] + a, first[i] + b, length) for a, b, length in _pieces(m[first[i]:end[i]], stops.tolist(), longest)]
    out = [tuple(np.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, (np.int64, np.int64, np.int64, float), strict=True))]
    way = np.flatnonzero((end > first) & (end - first < SIDE_BY_SIDE))
    at, last = first[way], end[way]
    start, run = at.copy(), np.zeros(len(way))
    while len(way):
        run, at = run + m[at], at + 1
        cut = stop[at] | ~(run < longest)
        out.append((way[cut], start[cut], at[cut], run[cut]))
        start, run, on = np.where(cut, at, start), np.where(cut, 0.0, run), at < last
        way, at, last, start, run = way[on], at[on], last[on], start[on], run[on]
    way, start, at, run = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(start)  # vertices are numbered through the ways
    return way[order], start[order], at[order], run[order]


def cut_edges(
    ways: DataFrame, max_edge_m: float = MAX_EDGE_M, simplify_m: float | None = SIMPLIFY_M, carry: Sequence[str] = ()
) -> DataFrame:
    """Ways cut at junctions, ends and every ``max_edge_m`` (G5), with the ``carry`` columns of their way.

    The length since the last cut starts anew at each cut, one pass over the
    vertices of an Arrow batch; nothing grows with the vertices of a way. Only
    node ids travel to find the junctions; each way then gets back the places of
    its own.
    """
    uses = ways.select("id", F.posexplode("nodes").alias("k", "node"))
    joints = uses.join(junctions(ways).select("node"), "node").groupBy("id").agg(F.collect_list("k").alias("joints"))
    oneway = _tag("oneway").isin("yes", "1", "true") | (_tag("junction") == "roundabout")
    kind = F.when(_tag("highway").isin(*labels.ROAD_TAGS), labels.KIND_ROAD).otherwise(labels.KIND_TRAIL)
    w = ways.join(joints, "id", "left").select(
        "id", *carry, kind.alias("kind"), F.coalesce(oneway, F.lit(False)).cast("int").alias("oneway"), _tag("name").alias("name"),
        "nodes", "geometry", "joints",
    )
    kept = [f for f in w.schema.fields if f.name not in ("nodes", "geometry", "joints")]
    ddl = "part int, src bigint, dst bigint, length_m double, coords array<struct<lon:double,lat:double>>"
    schema = T.StructType([*kept, *T._parse_datatype_string(ddl).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, lon, lat = lines.vertices(batch["geometry"])
            nodes, at = batch["nodes"].values.to_numpy(), batch["nodes"].offsets.to_numpy()
            if not len(lon):
                continue
            m, stop = lines.leg_lengths(lon, lat, geo.MEAN_EARTH_RADIUS_M), np.zeros(len(lon) + 1, bool)
            joints, of = batch["joints"].values.to_numpy(zero_copy_only=False), batch["joints"].offsets.to_numpy()
            stop[np.repeat(offsets[:-1], np.diff(of)) + joints[of[0]:of[-1]].astype(np.int64)] = True
            stop[offsets[1:] - 1] = True
            row, a, b, length = _all_pieces(offsets, m, stop, max_edge_m)
            if not len(row):
                continue
            part = np.arange(len(row)) - np.searchsorted(row, row)
            a, b = a - offsets[row], b - offsets[row]
            n = b - a + 1
            vertex = np.repeat(offsets[row] + a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            points = pa.StructArray.from_arrays([pa.array(lon[vertex]), pa.array(lat[vertex])], names=["lon", "lat"])
            coords = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), points)
            new = [part.astype(np.int32), nodes[at[row] + a], nodes[at[row] + b], length]
            yield pa.RecordBatch.from_arrays([*(batch[f.name].take(pa.array(row)) for f in kept), *map(pa.array, new), coords], names=schema.names)

    rows = w.mapInArrow(cut, schema).filter((F.col("src") != F.col("dst")) & (F.col("length_m") > 0))
    out = rows.select(
        F.concat_ws("/", F.col("id").cast("string"), F.col("part").cast("string")).alias("edge_key"),
        F.struct("id", "part").alias("edge_id"),
        "id", "part", *carry, "kind", "oneway", "name", "src", "dst", F.bround("length_m", 0).alias("length_m"), "coords",
    )
    if simplify_m is None:
        return out
    return out.withColumn("coords", geo.round_ring(lines.simplify(F.col("coords"), simplify_m), COORD_DECIMALS))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Edge ends with their position and whether a road touches them."""
    last = F.size("coords") - 1
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.get("coords", F.lit(0)).alias("at"), (F.col("kind") == labels.KIND_ROAD).alias("road")),
                F.struct(F.col("dst").alias("node"), F.get("coords", last).alias("at"), (F.col("kind") == labels.KIND_ROAD).alias("road")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("node").agg(F.min("at").alias("at"), F.bool_or("road").alias("road")).select(
        "node", "at.lon", "at.lat", "road"
    )


def adjacency(edges: DataFrame, mode: str) -> DataFrame:
    """Directed edges of a mode: driving uses roads only, one-way streets one way."""
    usable = edges if mode == "hike" else edges.filter(F.col("kind") == labels.KIND_ROAD)
    there = usable.select("src", "dst", "length_m", "edge_id", F.lit(False).alias("reversed"))
    back = usable.filter(F.col("oneway") == 0).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "length_m", "edge_id", F.lit(True).alias("reversed")
    )
    both = there.unionByName(back)
    # of parallel edges only the shortest can lie on a shortest path
    return both.groupBy("src", "dst").agg(F.min(F.struct("length_m", "edge_id", "reversed")).alias("e")).select("src", "dst", "e.*")


def snap(points: DataFrame, nodes: DataFrame, mode: str, key: str = "site") -> DataFrame:
    """Nearest graph node of each point; driving uses nodes a road touches."""
    usable = nodes if mode == "hike" else nodes.filter("road")
    return nearest(points, usable, key, "node")


def inner_nodes(arcs: DataFrame, keepers: DataFrame) -> DataFrame:
    """Nodes that only join two others, with these: node, lo, hi. ``keepers`` (node) are never among them."""
    near = arcs.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(arcs.select("dst", "src")).filter("node <> near").distinct()
    ends = near.groupBy("node").agg(F.count("*").alias("n"), F.min("near").alias("lo"), F.max("near").alias("hi"))
    return ends.filter("n = 2").select("node", "lo", "hi").join(keepers.select("node").distinct(), "node", "left_anti")


def contract(arcs: DataFrame, keepers: DataFrame) -> DataFrame:
    """Every arc with the chain that it ends: root, the node at the front of the chain, total and hops from there; ``inner``: whether it ends at an inner node.

    An arc out of an inner node goes on from the one arc that can lead into that
    node without turning back. Pointers are doubled, so a chain of n arcs takes
    log2(n) rounds; a round writes only the arcs that had not found their
    front before it. Arcs that nothing leads into, and rings of
    inner nodes that no chain enters, cannot be reached from a keeper and go.
    """
    inside = materialise(inner_nodes(arcs, keepers), "inner-nodes")
    heads = inside.select(F.col("node").alias("dst"), F.lit(True).alias("inner"))
    rows = arcs.filter("src <> dst").join(inside.withColumnRenamed("node", "src"), "src", "left").join(heads, "dst", "left")
    onward = F.when(F.col("lo") == F.col("dst"), F.col("hi")).otherwise(F.col("lo"))  # null for arcs out of a keeper
    now = rows.select(
        "src", "dst", F.coalesce("inner", F.lit(False)).alias("inner"), F.when(F.col("lo").isNull(), F.col("src")).alias("root"),
        F.col("length_m").alias("total"), F.lit(1).cast("bigint").alias("hops"), onward.alias("up_src"), F.when(F.col("lo").isNotNull(), F.col("src")).alias("up_dst"),
    )
    written, left = [materialise(now, "chains")], -1
    while (n := written[-1].filter("root is null").count()) and n != left:
        left, loose = n, written[-1].filter("root is null")
        now = reduce(DataFrame.unionByName, [w.filter("root is not null") for w in written], loose)
        up = now.filter("inner").select(
            F.col("src").alias("up_src"), F.col("dst").alias("up_dst"), F.col("root").alias("u_root"), F.col("total").alias("u_total"), F.col("hops").alias("u_hops"),
            F.col("up_src").alias("u_src"), F.col("up_dst").alias("u_dst"),
        )
        more = loose.join(up, ["up_src", "up_dst"]).select(
            "src", "dst", "inner", F.col("u_root").alias("root"), (F.col("total") + F.col("u_total")).alias("total"), (F.col("hops") + F.col("u_hops")).alias("hops"),
            F.col("u_src").alias("up_src"), F.col("u_dst").alias("up_dst"),
        )
        written.append(materialise(more, "chains"))
    return reduce(DataFrame.unionByName, written).filter("root is not null").drop("up_src", "up_dst")


def weak_components(arcs: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes of ``arcs`` (src, dst), whatever the direction.

    Every node takes the least of its neighbours as its parent, then parents'
    parents replace them, so trees halve their depth each round.
    """
    pairs = materialise(arcs.select("src", "dst").union(arcs.select("dst", "src")).filter("src <> dst").distinct(), "pairs")
    now = materialise(pairs.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("up")), "components")
    while True:
        of = now.select(F.col("node").alias("dst"), F.col("up").alias("d_up"))
        near = pairs.join(of, "dst").groupBy(F.col("src").alias("node")).agg(F.min("d_up").alias("m"))
        hooks = now.join(near, "node")  # the root of a tree hooks onto the least tree next to it
        roots = hooks.filter("m < up").groupBy(F.col("up").alias("node")).agg(F.min("m").alias("to"))
        own = hooks.select("node", F.least("up", "m").alias("up")).join(roots, "node", "left").select("node", F.least("up", "to").alias("up"))
        own = materialise(own, "components")
        jump = own.join(own.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))
        after = materialise(jump, "components")
        if after.join(now.withColumnRenamed("up", "was"), "node").filter("up <> was").isEmpty():
            return now.select("node", F.col("up").alias("component"))
        now = after


def settle(starts: DataFrame, roads: DataFrame, max_distance_m: float | None = None, goals: DataFrame | None = None) -> DataFrame:
    """search, node, dist, hops: the least distance, then fewest edges, from the start of each search.

    ``starts``: search, node. ``roads``: src, dst, total, hops. One table of
    labels is kept. In a round the labels that became better offer their
    neighbours a distance, and the least of offers and labels is the next table;
    the end is when nothing became better. Once half of the searches in the table
    have ended their labels leave it, so late rounds carry what still moves.

    ``goals``: search, node, at_most: where a search wants to get, and a distance
    known to be enough (null: none). A search drops what is farther than
    its farthest goal, as found so far or known beforehand.
    """
    pair = F.struct("dist", "hops")
    zero = starts.select("search", "node", F.lit(0.0).alias("dist"), F.lit(0).cast("bigint").alias("hops"), F.lit(True).alias("fresh"))
    now = materialise(zero.distinct(), "labels")
    ended, carried = [], now.select("search").distinct().count()
    while not (fresh := now.filter("fresh")).isEmpty():
        if carried >= MANY_SEARCHES and 2 * (n := fresh.select("search").distinct().count()) <= carried:
            moving, carried = materialise(fresh.select("search").distinct(), "searches"), n
            ended.append(now.join(moving, "search", "left_anti"))
            now = now.join(moving, "search", "left_semi")
            if goals is not None:
                goals = materialise(goals.join(moving, "search", "left_semi"), "goals")
        offers = fresh.select("search", F.col("node").alias("src"), "dist", F.col("hops").alias("h")).join(roads, "src").select(
            "search", F.col("dst").alias("node"), (F.col("dist") + F.col("total")).alias("dist"), (F.col("h") + F.col("hops")).alias("hops")
        )
        if max_distance_m is not None:
            offers = offers.filter(F.col("dist") <= max_distance_m)
        if goals is not None:
            found = goals.join(now.select("search", "node", "dist"), ["search", "node"], "left")
            enough = F.least("dist", "at_most")
            reach = found.groupBy("search").agg(F.when(F.bool_and(enough.isNotNull()), F.max(enough)).alias("reach"))
            offers = offers.join(reach, "search").filter(F.col("reach").isNull() | (F.col("dist") <= F.col("reach"))).drop("reach")
        kind = "struct<dist:double,hops:bigint>"
        both = offers.select("search", "node", F.lit(None).cast(kind).alias("had"), pair.alias("o")).unionByName(
            now.select("search", "node", pair.alias("had"), F.lit(None).cast(kind).alias("o"))
        )
        least = both.groupBy("search", "node").agg(F.min("had").alias("had"), F.min("o").alias("o"))
        better = F.coalesce(F.col("o") < F.col("had"), F.col("had").isNull())
        best = F.when(better, F.col("o")).otherwise(F.col("had"))
        now = materialise(least.select("search", "node", best.alias("b"), better.alias("fresh")).select("search", "node", "b.*", "fresh"), "labels")
    return reduce(DataFrame.unionByName, ended, now).drop("fresh")


class Network:
    """A mode's arcs with chains of degree-two nodes contracted; ``keepers`` (node) stay ends of roads."""

    def __init__(self, edges: DataFrame, mode: str, keepers: DataFrame):
        self.arcs = materialise(adjacency(edges, mode), "adjacency")
        self.chains = contract(self.arcs, keepers)

    def roads(self) -> DataFrame:
        """From keeper to keeper: src, dst, total, hops, the best of parallel chains."""
        ends = self.chains.filter(~F.col("inner") & (F.col("root") != F.col("dst")))
        best = ends.groupBy(F.col("root").alias("src"), "dst").agg(F.min(F.struct("total", "hops")).alias("b"))
        return materialise(best.select("src", "dst", "b.*"), "roads")

    def put_back(self, labels: DataFrame, max_distance_m: float | None = None) -> DataFrame:
        """Labels of the inner nodes too: the better of the two ends of their chain."""
        inner = self.chains.filter("inner").select(F.col("root").alias("node"), F.col("dst"), "total", F.col("hops").alias("h"))
        rows = labels.join(inner, "node").select("search", F.col("dst").alias("node"), F.struct((F.col("dist") + F.col("total")).alias("dist"), (F.col("hops") + F.col("h")).alias("hops")).alias("b"))
        if max_distance_m is not None:
            rows = rows.filter(F.col("b.dist") <= max_distance_m)
        best = rows.groupBy("search", "node").agg(F.min("b").alias("b")).select("search", "node", "b.*")
        return labels.unionByName(best)


def shortest_distances(
    sources: DataFrame, edges: DataFrame, mode: str, max_distance_m: float | None = None
) -> DataFrame:
    """Least distance from each source to every node it can reach, however far.

    ``sources``: one ``node`` per row. Nodes that only join two others are
    contracted away first, so rounds follow the junctions on a path and not its
    vertices, and are put back at the end. Of paths of equal length the one with
    fewest edges counts, then the one whose last node but one is the smallest, so
    the tree is the same however the rounds went.
    Output: source, node, dist, hops, prev, edge_id, reversed.
    """
    net = Network(edges, mode, sources)
    labels = settle(sources.select(F.col("node").alias("search"), "node").distinct(), net.roads(), max_distance_m)
    labels = materialise(net.put_back(labels, max_distance_m), "labels")
    offers = labels.select("search", F.col("node").alias("src"), "dist", "hops").join(net.arcs, "src").filter("search <> dst").select(
        F.col("search").alias("source"), F.col("dst").alias("node"),
        F.struct((F.col("dist") + F.col("length_m")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("prev"), "edge_id", "reversed").alias("o"),
    )
    if max_distance_m is not None:
        offers = offers.filter(F.col("o.dist") <= max_distance_m)
    best = offers.groupBy("source", "node").agg(F.min("o").alias("o")).select("source", "node", "o.*")
    none = [F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("prev", "edge_id", "reversed")]
    own = labels.filter("search = node").select(F.col("search").alias("source"), "node", "dist", "hops", *none)
    return materialise(own.unionByName(best), "distances")


def trace_paths(distances: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the path from a source to each wanted node, in order.

    ``targets``: source, target. The tables of 2, 4, 8... steps back are built by
    joining each with itself; then all nodes of all paths come out of these from
    the longest step to the shortest, every depth once by its binary digits. That
    is two written tables for every doubling of the longest path.
    Output has one row per edge: source, target, pos, edge_id and the edge's
    vertices in travel direction, the vertex shared with the edge before it
    dropped.
    """
    tree = distances.filter(F.col("prev").isNotNull()).select("source", "node", "prev", "hops", "edge_id", "reversed")
    at = materialise(targets.select("source", "target").distinct().join(distances.select("source", F.col("node").alias("target"), "hops"), ["source", "target"]), "targets")
    longest = at.agg(F.max("hops")).first()[0] or 0
    back = [tree.select("source", "node", "prev")]
    for _ in range(max(0, longest.bit_length() - 1)):
        up = back[-1].select("source", F.col("node").alias("prev"), F.col("prev").alias("far"))
        back.append(materialise(back[-1].join(up, ["source", "prev"]).select("source", "node", F.col("far").alias("prev")), "steps-back"))
    walked = at.select("source", "target", F.col("target").alias("node"))
    for step in reversed(back):
        walked = materialise(walked.unionByName(walked.join(step, ["source", "node"]).select("source", "target", F.col("prev").alias("node"))), "on-path")
    travelled = F.when(F.col("reversed"), F.reverse("coords")).otherwise(F.col("coords"))
    pos = (F.col("hops") - 1).cast("int")
    stitched = F.when(pos == 0, travelled).otherwise(F.slice(travelled, 2, F.size(travelled)))
    return (
        walked.join(tree, ["source", "node"])
        .join(edges.select("edge_id", "coords"), "edge_id")
        .select("source", "target", pos.alias("pos"), "edge_id", stitched.alias("coords"))
    )


def distance_matrix(sites: DataFrame, nodes: DataFrame, edges: DataFrame, mode: str) -> DataFrame:
    """Pairwise network distances of a trip's stops, those that the start cannot reach left out.

    ``sites``: trip, site, lon, lat, is_start. A trip is a visitor's list of a
    dozen stops, so pairs inside a trip are bounded by that list.

    Searches have goals, the trip's stops in the same part of the network: first
    from the start, forward and backward, then from every stop that the start
    reaches. Over the start, two stops are no farther apart than the way to it and
    the way from it, so these searches know beforehand how far they have to look.
    """
    where = sites.select(F.concat_ws("|", "trip", "site").alias("key"), "lon", "lat")
    snapped = snap(where, nodes, mode, "key").select("key", "node")
    s = sites.withColumn("key", F.concat_ws("|", "trip", "site")).join(snapped, "key").select("trip", "site", "is_start", "node")
    s = materialise(s, "stops")
    net = Network(edges, mode, s)
    roads = net.roads()
    part = weak_components(roads).withColumnRenamed("component", "part")
    stops = s.select("trip", "node", "is_start").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    stops = materialise(stops.groupBy("trip", "node", "part").agg(F.bool_or("is_start").alias("is_start")), "stops")
    search = F.struct("trip", F.col("node").alias("origin"))

    starts, unknown = stops.filter("is_start"), F.lit(None).cast("double")
    begun = starts.select("trip", "part", search.alias("search")).join(stops.select("trip", "part", "node"), ["trip", "part"])
    begun = materialise(begun.select("search", "node", unknown.alias("at_most")), "goals")
    ways = {}
    for name, arcs in (("out", roads), ("home", roads.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "total", "hops"))):
        labels = settle(starts.select(search.alias("search"), "node"), arcs, goals=begun)
        ways[name] = materialise(labels.join(begun.select("search", "node"), ["search", "node"], "left_semi").select("search", "node", "dist"), "ways")
    live = materialise(ways["out"].select("search.trip", "node").distinct().join(stops.drop("is_start"), ["trip", "node"]), "live-stops")
    home, out = (ways[n].select("search", F.col("node").alias(c), F.col("dist").alias(n)) for n, c in (("home", "origin"), ("out", "node")))
    over = home.join(out, "search").groupBy("search.trip", "origin", "node").agg(F.min(F.col("home") + F.col("out")).alias("at_most"))
    pairs = live.withColumnRenamed("node", "origin").join(live, ["trip", "part"]).join(over, ["trip", "origin", "node"], "left")
    wanted = materialise(pairs.select(F.struct("trip", "origin").alias("search"), "node", "at_most"), "goals")
    labels = settle(live.select(search.alias("search"), "node"), roads, goals=wanted)
    dist = labels.join(wanted.select("search", "node"), ["search", "node"], "left_semi").select("search.trip", F.col("search.origin").alias("source"), F.col("node").alias("to_node"), "dist")
    ends = s.join(live.select("trip", "node"), ["trip", "node"], "left_semi")
    legs = (
        ends.select("trip", F.col("site").alias("from_site"), F.col("node").alias("source"))
        .join(dist, ["trip", "source"])
        .join(ends.select("trip", F.col("site").alias("to_site"), F.col("node").alias("to_node")), ["trip", "to_node"])
        .filter(F.col("from_site") != F.col("to_site"))
    )
    seconds = F.col("dist") / SPEED_MS[mode] + STOP_OVERHEAD_S
    return legs.select("trip", "from_site", "to_site", F.col("dist").alias("distance_m"), seconds.alias("seconds"))


def length_by_class(ways: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Road, trail and other kilometres inside a box with the total.

    ``ways``: highway, coords.
    """
    rows = ways.select(
        labels.highway_class(F.col("highway")).alias("cls"), (geo.path_length_m(F.col("coords"), box) / 1000).alias("km")
    )
    agg = rows.rollup("cls").agg(F.sum("km").alias("km"), F.count("*").alias("n_ways"))
    return agg.select(F.coalesce("cls", F.lit("total")).alias("cls"), F.bround("km", 2).alias("km"), "n_ways")
