from __future__ import annotations

import numpy as np
import pytest

from observatory.llm import embedding_dedup, queries


def slow(rows, cosine=0.9):
    good = {}
    for i, (_, v) in enumerate(rows):
        a = None if v is None or any(x is None for x in v) else np.array(v, float)
        if a is not None and len(a) and np.isfinite(a).all() and a.any():
            good[i] = a / np.abs(a).max()
    near = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and np.dot(good[i], good[j]) / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= cosine] for i in good}
    out = []
    for i, (name, _) in enumerate(rows):
        group, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in group:
                    group.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        out.append((name, len(near.get(i, [])), min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, kind="double", **k):
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, vec int")
    return sorted([tuple(r) for r in embedding_dedup.near_duplicates(df, **k).collect()], key=str)


@pytest.mark.parametrize("block", [16, 4096])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup.math, "isqrt", lambda n: 16 * 9)  # nine pivots
    rng = np.random.default_rng(block)
    rows, n = [], 0
    for spread in (0.02, 0.1, 0.25, 1.0):
        for _ in range(5):
            centre = rng.normal(size=6)
            for _ in range(rng.integers(1, 14)):
                rows.append((n, (centre + spread * rng.normal(size=6)).round(3).tolist()))
                n += 1
    rows += [(n + i, rows[3][1]) for i in range(5)] + [(n + 9, [2 * x for x in rows[3][1]])]
    assert run(spark, rows, block=block) == slow(rows)


def test_edge_cases(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1e200, 1e200]),
        (8, [1e-200, 1e-200]), (9, [1.0, 1.0, 0.0]), (10, [1.0, -0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]),
    ]
    assert run(spark, rows) == slow(rows)
    assert run(spark, rows[:0]) == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in queries.table(spark, sf, "embeddings").collect()]
    got = queries.op4_embedding_dedup(spark, sf).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == slow(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
