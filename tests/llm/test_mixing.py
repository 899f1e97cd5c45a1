from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from observatory.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    """The rule as told: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), [s for s in names if sizes[s]]
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in open_:
            target[s] += given[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
        open_ = [s for s in open_ if target[s] < cap * sizes[s]]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_the_rule(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 50, 1000, 20_000]) for s in ["b", "a", "ä", "Z", "aa", None, "c"][: rng.randint(1, 7)]}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def documents(spark, seed=1, n=700):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["a", "b", "c", None]
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(sources), 7) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")


def test_mix_is_near_its_targets_and_nested(spark):
    rows = mixing.mix(documents(spark)).collect()
    assert len(rows) == 700
    taken, target, largest = {}, {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source] = r.target
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert 0 <= r.copies <= 3
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in taken)
    for s in taken:  # whole copies first, then the lowest hashes
        mine = sorted((r.hash, r.copies) for r in rows if r.source == s)
        assert [c for _, c in mine] == sorted((c for _, c in mine), reverse=True)
    again = {(r.doc_id, r.copies) for r in mixing.mix(documents(spark).repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}


def test_sizes(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a  b\tc\nd ", "a b\x1cc   d", "x " * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(mixing.size_of(F.col("t")).alias("n")).collect()] == [0, 0, 0, 1, 4, 3, 100_000]


def test_edge_cases(spark):
    rows = [(None, None, None, 1), (1, "", "a", 1), (1, "a b", "a", 1), (1, "a b", "a", 1), (None, "c d e", None, 1), (3, "x " * 9, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, hash int")
    got = [(r.doc_id, r.size, r.copies) for r in mixing.mix(df).collect()]
    assert len(got) == 6 and len({c for i, s, c in got if (i, s) == (1, 2)}) == 1
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mixed_documents(df.limit(0)).collect() == []
    nothing = df.filter("size(split(text, '')) < 2 or text is null")
    assert {r.copies for r in mixing.mix(nothing).collect()} <= {0}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(c for _, s, c in got if s)
