from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from observatory.llm import links, simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps):
    seen = {}
    for f in set(fps):
        todo, group = [f], {f}
        while todo:
            x = todo.pop()
            for y in set(fps) - group:
                if bin(x ^ y).count("1") <= 3:
                    group.add(y)
                    todo.append(y)
        seen[f] = group
    return seen


def rows_of(rng, n=150):
    base = ["one two three four five six seven", "Ä b\tc d", "x", "", None, "two words"]
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [t + " z" for t in texts if rng.random() < 0.5] + base
    return [(i, rng.choice(texts)) for i in range(n)]


def test_fingerprint_is_the_spark_hash_and_the_slow_one(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)
    for t in ["", None, "A", "A b", "a B c", "ä Ö  ü x\ty\nz w " * 9]:
        assert simhash.fingerprint(t.encode() if t is not None else None) == slow_fingerprint(t)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_of_close_fingerprints(spark, block):
    rng = random.Random(block)
    fps = {0, 7, 15}
    for _ in range(12):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(15)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), block=block)
    got = {r.node: r.component for r in links.components(edges).collect()}
    back = {s: f for s, f in zip(signed, fps, strict=True)}
    for s in signed:
        group = slow_groups(fps)[back[s]]
        assert len(group) == sum(got.get(x, x) == got.get(s, s) for x in signed)


def test_near_duplicates_equal_brute_force(spark):
    rows = rows_of(random.Random(5))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    groups = slow_groups(list(fps.values()))
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i] == (int(np.uint64(fps[i]).astype(np.int64)), min(j for j in fps if fps[j] in groups[fps[i]]))


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q r s"), (4, None), (5, " ")], "doc_id bigint, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [("3", 3), ("3", 3), ("4", 4), ("5", 4), ("None", 3), ("None", None)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(20)] + [(1000, i) for i in range(500, 600)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(500, 600)} == {500} and got[1000] == 500
