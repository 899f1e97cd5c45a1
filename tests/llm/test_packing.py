from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from observatory.llm import packing, queries
from observatory.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def slow_ids(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


def fast_ids(text):
    return np.concatenate([*WordTokenizer.of(PATH).ids(text.encode()), np.zeros(0, np.uint16)]).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé'İΣς日 \t\n  \x1c\x85.,!-#12<|endoftx>’½é가😀"), max_size=40))
def test_words_have_the_ids_of_the_text(text):
    assert fast_ids(text) == slow_ids(text)[:-1]


def test_reserved_words_and_slices(monkeypatch):
    for text in ("a<|endoftext|>b <|startoftext|>", "it's we'll 'tis", "ÀÉ straße ŒUVRE ﬁ", "x" * 5000):
        assert fast_ids(text) == slow_ids(text)[:-1]
    monkeypatch.setattr("observatory.llm.tokens.SLICE", 64)
    text = " ".join(random.Random(1).choices(["alpha", "beta,", "\n", "ñandú"], k=400))
    assert fast_ids(text) == slow_ids(text)[:-1]


@pytest.mark.parametrize("seed", range(30))
def test_closest_fill_is_the_best_multiset(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
    window = rng.randint(max(lengths), 60)
    counts = {n: lengths.count(n) for n in lengths}
    got = packing.closest_fill(counts, window)
    assert got[max(lengths)] >= 1 and all(0 < k <= counts[n] for n, k in got.items())
    rest = sorted(lengths)[:-1]
    best = max(max(lengths) + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if max(lengths) + sum(c) <= window)
    assert sum(n * k for n, k in got.items()) == best


def check(rows, texts, window=4096):
    """Every token once, sequences gapless and within the window, no padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array(slow_ids(text)), 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start:at].astype("<u4").tobytes())
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query_is_a_round_trip_without_padding(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    assert check(queries.op10_packing(spark, sf).collect(), texts) == 0


@pytest.mark.parametrize("file_tokens", [64, 1 << 20])
def test_edge_cases(spark, file_tokens):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(["a", "longerword", "ü", "x1"], k=rng.randint(0, 60))) for i in range(120)}
    texts |= {200: None, 201: "", 202: " ", 203: "word " * 3000, None: "no id"}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, start int").repartition(3)
    rows = packing.pack(df, PATH, window=32, file_tokens=file_tokens).collect()
    assert check(rows, texts, 32) == 0
    twice = packing.pack(df.union(df), PATH, window=32).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in rows)
    assert packing.pack(df.limit(0), PATH).collect() == []
