"""Connected components of links, over tables of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from observatory.session import materialise


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` nodes is linked with, directly or not, by the links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """node, component (the smallest node it reaches) of every node with a link.

    ``edges``: columns a and b of one type; loops and repeated links change
    nothing. Each round turns every node's links to its smallest neighbour, first
    for the larger neighbours, then for the smaller ones, so paths shorten by
    halves and every round has at most as many links as the first. Hubs are only
    aggregated and joined, never gathered. A round is one written table; its
    count and checksum tell whether it changed anything.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = materialise(now, label)
    mark = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), mark).first()
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.distinct(), label)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialise(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), label)
        got = after.agg(F.count("*"), mark).first()
        if got == seen:
            break
        now, seen = after, got
    roots = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
