from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from observatory.llm import queries, toxicity


@pytest.fixture()
def reader():
    return toxicity.Reader({})


def test_a_composed_table_does_what_its_machines_do():
    machines = [toxicity.negation(), toxicity.reporting(), toxicity.targeting()]
    for symbols in ([4, 1, 6, 1], [5, 6, 2, 6, 1], [1, 0, 3, 1], [4, 0, 0, 0, 1, 3]):
        state, states = 0, [0, 0, 0]
        for s in symbols:
            state, marks = toxicity.GRAMMAR[state][s]
            steps = [m.step(x, s) for m, x in zip(machines, states, strict=True)]
            states = [x for x, _ in steps]
            assert marks == sum(m for _, m in steps)


@pytest.mark.parametrize(
    ("text", "clauses"),
    [
        ("You are an idiot.", [(5.0, 1, 0)]),
        ("an idiot, you", [(4.0, 1, 0)]),
        ("idiot that you are", [(5.0, 1, 0)]),
        ("He is not an idiot.", [(2.0, 1, 0)]),
        ("He said, what an idiot. A fool.", [(2.4, 1, 0)]),
        ("I will hurt you!", [(5.0, 0, 1)]),
        ("I will never hurt you!", []),
        ("They hurt.", []),
        ("idiot moron; clean words. scum", [(8.0, 2, 0), (4.0, 1, 0)]),
        ("", []),
    ],
)
def test_clauses(reader, text, clauses):
    got = reader.clauses(text)[0]
    assert [(round(w, 6), i, t) for w, i, t in got] == clauses


def test_edge_cases(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "you idiot, you moron, you scum", 1.0), (3, "fine words " * 50_000, 1.0), (3, "fine words " * 50_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.learn(df, none)
    got = [tuple(r) for r in toxicity.score_texts(df, model).collect()]
    assert [g[0] for g in got] == [1, 2, None, 3, 3] and got[0][1] == got[1][1] == got[3][1] < 0.3 < got[2][1]
    assert toxicity.score_texts(df.limit(0), model).collect() == []
    all_null = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.learn(df, all_null).terms == {}


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op2_toxicity(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").filter("held_out")
    hit = (F.col("predicted") == 1).cast("int")
    got = out.agg(F.avg(F.when(F.col("toxic") == 1, hit)).alias("recall"), F.avg(F.when(F.col("toxic") == 0, hit)).alias("false"), F.count("*").alias("n")).first()
    assert got.n > 900 and got.recall > 0.9 and got.false < 0.01, got
