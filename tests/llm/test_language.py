from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from observatory.llm import language, queries


def slow_path_value(scores, penalty):
    n, k = scores.shape
    return max(
        sum(scores[t, p[t]] for t in range(n)) - penalty * sum(p[t] != p[t - 1] for t in range(1, n))
        for p in itertools.product(range(k), repeat=n)
    )


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k, penalty = rng.integers(1, 7), rng.integers(1, 4), rng.choice([0.5, 2.0, 5.0])
        scores = rng.normal(size=(n, k)) * 2
        path = language.viterbi(scores, penalty)
        value = scores[np.arange(n), path].sum() - penalty * (path[1:] != path[:-1]).sum()
        assert value == pytest.approx(slow_path_value(scores, penalty))


def sample(spark):
    rng = random.Random(1)
    words = {"xx": ["kato", "mira", "sol", "tenka"], "yy": ["üble", "grün", "strich", "pfau"], "zz": ["дом", "река", "снег"]}
    rows = [(i, " ".join(rng.choices(words[l], k=12)), l) for i, l in enumerate(rng.choices(list(words), k=90))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_spans_of_mixed_text(spark):
    model = language.learn(sample(spark))
    assert model.languages == ["xx", "yy", "zz"]
    text = "kato mira sol 12 tenka kato, grün strich pfau üble pfau -- снег дом"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = [(text[r.start:r.end], r.lang) for r in language.label_spans(df, model, penalty=4.0).collect()]
    assert got == [("kato mira sol 12 tenka kato,", "xx"), ("grün strich pfau üble pfau", "yy"), ("снег дом", "zz")]


def test_edge_cases(spark):
    model = language.learn(sample(spark))
    rows = [(1, None, 5), (2, "", 5), (None, "12 -- !", 5), (4, "kato " * 50_000, 5), (4, "kato " * 50_000, 5), (5, "ξένος", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred int")
    got = [tuple(r) for r in language.label_texts(df, model).collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (None, "und", 0.0)]
    assert got[3] == got[4] == (4, "xx", 1.0) and got[5][1] in model.languages
    assert language.label_texts(df.limit(0), model).collect() == []
    nothing = language.learn(sample(spark).limit(0))
    assert [r.lang_pred for r in language.label_texts(df, nothing).collect()] == ["und"] * 6


def test_held_out_accuracy(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    out = queries.op5_language(spark, "/root/testdata/sf0.01")
    got = out.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert out.count() == docs.count() and got[1] > 100 and got[0] > 0.97
