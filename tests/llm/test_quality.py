from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from observatory.llm import quality, queries


def test_posteriors_find_the_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(40_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.75, 0.7, 0.9, 0.85, 0.6, 0.9])
    vote = np.where(rng.random((len(truth), 9)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    vote[rng.random(vote.shape) < 0.2] = quality.ABSTAIN
    codes, place, counts = np.unique(vote @ 3 ** np.arange(8, -1, -1), return_inverse=True, return_counts=True)
    good, right = quality.posteriors(codes, counts.astype(float), trust=0.0)
    assert np.abs(right - accuracy).max() < 0.02
    assert ((good[place] > 0.5) == truth).mean() > 0.97
    assert (quality.digits(codes)[place] == vote).all()


def test_linear_scorer_fits_soft_targets():
    rows = [([1, 2], [1.0, 1.0]), ([2, 3], [1.0, 1.0]), ([4], [1.0])]
    w = quality.fit_linear(rows, np.array([0.9, 0.1, 0.5]), rounds=3000)
    margin = [sum(w[i] * x for i, x in zip(*r, strict=True)) + w[-1] for r in rows]
    assert 1 / (1 + np.exp(-np.array(margin))) == pytest.approx([0.9, 0.1, 0.5], abs=0.03)


def test_agrees_with_the_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op1_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id")
    hit = (F.col("predicted") == F.col("quality")).cast("int")
    got = out.agg(F.avg(F.when(F.col("quality") == 0, hit)).alias("bad"), F.avg(F.when(F.col("quality") == 1, hit)).alias("good")).first()
    assert got.bad > 0.9 and got.good > 0.98, got


def test_edge_cases(spark):
    rows = [(1, None, 0.0), (2, "", 0.0), (None, "One fine sentence. " * 20, 0.0), (3, "x " * 60_000, 0.0), (3, "x " * 60_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    model = quality.learn(df)
    got = [tuple(r) for r in quality.score_texts(df, model).collect()]
    assert [g[0] for g in got] == [1, 2, None, 3, 3] and got[0][1:] == got[1][1:] and got[3] == got[4]
    assert all(0 <= g[2] <= 1 for g in got)
    nothing = quality.learn(df.limit(0))
    assert [r.score for r in quality.score_texts(df, nothing).collect()] == [0.5] * 5
    assert quality.score_texts(df.limit(0), model).collect() == []
