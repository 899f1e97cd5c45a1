"""The stages against brute force on the smallest tables, and the columns that they hand on."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from observatory.llm import queries
from observatory.session import materialise
from tests.llm.test_pii import slow as slow_spans
from tests.llm.test_simhash import slow_fingerprint, slow_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), "step"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_are_handed_on(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_toxic_documents_go_and_others_stay(spark, steps):
    rejected = {r.doc_id for r in queries.op2_toxicity(spark, SF).filter("predicted = 1").collect()}
    assert ids(steps[1]) == sorted(set(ids(steps[0])) - rejected)


def test_one_of_each_group_stays(steps):
    fps = {r.doc_id: slow_fingerprint(r.text) for r in steps[1].collect()}
    groups = slow_groups(list(fps.values()))
    assert ids(steps[2]) == sorted({min(j for j in fps if fps[j] in groups[f]) for f in fps.values()})


def test_personal_data_is_gone(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    for r in steps[3].collect():
        assert slow_spans(r.text) == [] and r.n_chars == len(r.text)
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    assert ids(steps[3]) == ids(steps[2])


def test_mix_repeats_whole_documents(steps):
    texts = {r.doc_id: r.text for r in steps[3].collect()}
    mixed = steps[4].collect()
    assert mixed and all(texts[r.doc_id] == r.text for r in mixed)
    total = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r.text.split()) for r in mixed) - total) < 0.1 * total


def test_sequences_hold_every_token_once(steps):
    sent = steps[4].groupBy("doc_id").count()
    got = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("one"))
    for r in got.join(sent, "doc_id", "full").collect():
        assert r.n == r.one * r["count"]


def test_repeats_nulls_and_empty(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefghij") * 3 for _ in range(200))
    rows = [(1, long, "en", "a", 1), (2, long, "en", None, 1), (3, "x y z", None, "b", 5), (3, "x y z", None, "b", 5), (None, "q", "en", "a", 1), (4, None, "en", "b", None), (5, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("row", F.lit(1)).withColumn("score", F.lit(2))
    sizes = []
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = materialise(stage(spark, df, SF), "step")
            assert after.columns == df.columns
            df = after
            sizes.append(after.count())
        corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
    assert sizes[:3] == [7, 4, 4] and sizes[4:] == [0, 0, 0, 0]


def test_an_id_with_different_texts_is_several_documents(spark):
    """Each text goes with its own group; nothing that no other document holds is lost."""
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(99)) for _ in range(80)) for _ in range(5))
    rows = [(1, a), (3, a), (3, b), (4, c), (4, d), (4, d), (5, d), (6, e), (6, e), (7, b), (8, None), (8, "x y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for df in (docs, docs.repartition(5)):
        got = corpus_pipeline.drop_near_duplicates(spark, df, SF)
        assert got.columns == docs.columns
        assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted([(1, a), (3, b), (4, c), (4, d), (6, e), (8, ""), (8, "x y")])
