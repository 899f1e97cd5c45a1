from __future__ import annotations

import numpy as np

from observatory.llm import hnsw, queries


def slow(rows, asks, k=10):
    out = {}
    for q, v in asks:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, x in rows if i != q and len(x) == len(v))
        out[q] = near[:k]
    return out


def test_recall_of_one_graph():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(1500, 32)), rng.normal(size=(20, 32)).repeat(50, axis=0) + 0.05 * rng.normal(size=(1000, 32))])
    v = v[rng.permutation(len(v))]
    graph = hnsw.Graph.build(v)
    nodes, dist = graph.search(v[:300], 10)
    truth = np.argsort(hnsw.squares(v[:300], v), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nodes.tolist(), truth.tolist(), strict=True)]) > 0.95
    assert (np.diff(dist, axis=1) >= 0).all() and all(len(n) == m.shape[0] for n, m in zip(graph.levels, graph.neighbours, strict=True))


def test_query_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in queries.table(spark, sf, "embeddings").collect()]
    truth = slow(rows, [r for r in rows if r[0] % 100 == 0])
    got = {}
    for r in queries.op7_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    vectors = dict(rows)
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near) and q not in [i for _, i in near]
        assert all(abs(s - np.linalg.norm(np.array(vectors[q]) - np.array(vectors[i]))) < 1e-9 for s, i in near)
    assert set(got) == set(truth)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in truth[q]}) / 10 for q in truth]) >= 0.95


def test_many_shards_and_edge_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(400, 8)).round(3).tolist())]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, [1.0, 2.0]), (2100, [1.0, 2.5])]
    bad = [(3000, None), (3100, []), (3200, [0.0] * 8), (3300, [float("nan")] * 8), (3400, [None] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*rows, *bad, rows[7]]], "vec_id bigint, embedding array<double>, vec int")
    index = hnsw.build_index(df, shard_rows=50)
    assert index.count() > 6
    got = {}
    for r in hnsw.search(index, df.filter("vec_id % 100 = 0 or vec_id = 5"), block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    truth = slow([*rows, rows[7]], [r for r in rows if r[0] % 100 == 0 or r[0] == 5])
    assert set(got) == {q for q, near in truth.items() if near}
    assert got[5] == [(0.0, 1000 + i) for i in range(10)] and got[2000] == [(0.5, 2100)]
    assert np.mean([got[q] == truth[q] for q in got]) > 0.8
    assert hnsw.search(hnsw.build_index(df.limit(0)), df).collect() == []
    assert hnsw.search(index, df.limit(0)).collect() == []
