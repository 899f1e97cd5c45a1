from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from observatory.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def slow(docs, items, k=10):
    """The contract as told: score every document for every item."""
    texts = [(d, terms_of(t)) for d, t in docs]
    n_all, l_all = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms_of(text))
    out = set()
    for item, q in asked.items():
        scored = []
        for d, t in texts:
            tf, score = Counter(t), 0
            for w, times in q.items():
                if tf[w]:
                    weight = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1)))
                    score += times * weight * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * (25 + 75 * len(t) * n_all // l_all)))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort(key=lambda x: x[:3])
        out |= {(item, r, d, -s) for r, (s, _, _, d) in enumerate(scored[:k], 1)}
    return out


def run(spark, docs, items, k=10, **how):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, terms string, score int").repartition(3)
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id bigint, text string, q string")
    rows = [tuple(r) for r in rs.ranked(d, i, k, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_docs(rng, n, vocabulary):
    common, rare = vocabulary[:5], vocabulary[5:]
    word = lambda: rng.choice(common if rng.random() < 0.7 else rare)
    return [(i, rng.choice([" ", "-", ". "]).join(word() for _ in range(rng.choice([0, 1, 3, 20, 60])))) for i in range(n)]


@pytest.mark.parametrize("seed", range(200))
def test_hybrid_equals_a_plain_sum(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 3000)), int(rng.integers(1, 12))
    lists, total = [], np.zeros(n, np.int64)
    for _ in range(int(rng.integers(0, 9))):
        docs = np.sort(rng.choice(n, size=min(n, int(n ** rng.random())), replace=False)).astype(np.int32)
        scores = rng.integers(0, 4 if seed % 2 else 10_000, len(docs))
        total[docs] += scores
        lists.append(rs.Postings.of(docs, scores, (n >> rs.BLOCK_BITS) + 1))
    docs, scores = rs.hybrid(lists, n, k)
    assert np.array_equal(total[docs], scores) and len(set(docs.tolist())) == len(docs)
    best = sorted(range(n), key=lambda d: (-total[d], d))[:k]
    got = sorted(docs.tolist(), key=lambda d: (-total[d], d))[:k]
    assert got == [d for d in best if total[d] > 0]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "é", "ÀB", "7x", *(f"w{i}" for i in range(40)), "ſ", "K", "mixedCase"]
    docs = some_docs(rng, 300, vocabulary)
    items = [(i, " ".join(rng.choices(vocabulary + ["unknown"], k=rng.randint(0, 12)))) for i in range(15)]
    want = slow(docs, items)
    assert run(spark, docs, items) == want
    # small shards, all terms in the index, and items searched block by block
    monkeypatch.setattr(rs, "VOCABULARY", 2)
    monkeypatch.setattr(rs, "PAIRS", 20)
    assert run(spark, docs, items, shard_tokens=200) == want


def test_ties_copies_and_a_hot_text(spark):
    docs = [(i % 40, "same words here") for i in range(120)] + [(99, "words"), (100, "other")]
    items = [(1, "words"), (1, "words"), (2, "same same words"), (3, "none")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = rs.ranked(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    best = [r for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 2]
    assert [r["rank"] for r in best] == list(range(1, 11)) and [r.doc_id for r in best] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert {r.item_id for r in got} == {1, 2} and [r.doc_id for r in got if r.item_id == 1 and r["rank"] == 1] == [99]


def test_edge_cases(spark):
    long = "needle " + "hay " * 300_000
    docs = [(None, "needle"), (1, None), (2, ""), (3, "!? ,"), (4, long), (5, "x" * 500_000 + " needle"), (-6, "NEEDLE needle")]
    items = [(None, "needle"), (7, None), (8, ""), (9, "needle"), (9, "hay"), (10, "x" * 500_000)]
    assert run(spark, docs, items) == slow(docs, items)
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()
    assert run(spark, [(1, None), (2, "?")], items) == set()


def test_a_row_of_the_index(spark):
    df = spark.createDataFrame([(5, "b a b"), (6, "c a")], "doc_id bigint, text string").coalesce(1)
    row = rs.build_index(df).first()
    assert (row.doc_ids, row.lengths, row.n_docs, row.n_terms) == ([5, 6], [3, 2], 2, 5)
    assert [bytes(t) for t in row.terms] == [b"b", b"a", b"c"] and row.dfs == [1, 2, 1]
    assert np.frombuffer(row.docs, "<i4").tolist() == [0, 0, 1, 1] and np.frombuffer(row.tfs, "<i4").tolist() == [2, 1, 1, 1]
    with pytest.raises(ValueError):
        rs.build_index(df, range(rs.VOCABULARY + 1))


def test_slices_keep_terms_whole(monkeypatch):
    text = " ".join(["word", "x" * 40, "É", "a-b"] * 9).encode()
    whole = [w for part in rs.words(text) for w in part]
    monkeypatch.setattr(rs, "SLICE", 7)
    assert [w for part in rs.words(text) for w in part] == whole == [t.encode() for t in terms_of(text.decode())]
