from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from observatory.llm import blob_ledger, queries
from observatory.session import materialise

SCHEMA = "path string, version int, text string, blob string, spans int"


def versions(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def spans_of(df):
    return sorted((r.path or "", r.version or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in df.collect())


def slow_assign(text):
    """The rule as told, by hand: find, then drop what is short, without a retry."""
    out, at = [], 0
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    while m := pattern.search(text, at):
        at = m.end()
        if len(m.group(2)) >= 12:
            out.append(m.span())
    return out


def slow_runs(text, letters, start, least):
    """Runs of ``letters`` behind ``start`` of at least ``least`` characters, start included."""
    out, i = [], 0
    while i < len(text):
        if text.startswith(start, i) and (start or text[i] in letters):
            end = i + len(start)
            while end < len(text) and text[end] in letters:
                end += 1
            if end > i + len(start):
                if end - i >= least:
                    out.append((i, end))
                i = end
                continue
        i += 1
    return out


@pytest.mark.parametrize("seed", range(60))
def test_base_rules_equal_a_plain_search(seed):
    rng = random.Random(seed)
    bits = ["token", "TOKEN", "Api_Key", "apikey", "passwd", "password", "ſecret", "secret", "=", ":", " ", '"', "'", "a", "f0", "abcdef012345", "AKIA", "AKIAAKIA", "Z9", "Q" * 14, "é", "😀", "\n", "-", "."]
    text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))
    assign, access, hexes = blob_ledger.BASE
    assert blob_ledger.matches(assign, text) == slow_assign(text)
    assert blob_ledger.matches(access, text) == slow_runs(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 18)
    assert blob_ledger.matches(hexes, text) == slow_runs(text, "0123456789abcdef", "", 16)


def test_copies_are_read_once_and_found_everywhere(spark):
    secret, clean = 'x token = "abcdefghij0123456789"', "nothing here"
    rows = [(f"p{i}", 1, secret) for i in range(40)] + [("p0", 2, clean), ("q", 1, clean), ("q", 2, secret + " "), ("q", 3, secret)]
    df = versions(spark, rows)
    ledger = blob_ledger.scan(df, blob_ledger.empty_ledger(spark))
    assert ledger.count() == 3
    got = blob_ledger.findings(df, ledger)
    assert got.columns == ["path", "version", "blob", "spans"] and got.count() == len(rows)
    for r in got.collect():
        text = next(t for p, v, t in rows if (p, v) == (r.path, r.version))
        assert r.blob == hashlib.sha256(text.encode()).hexdigest()
        assert [s.kind for s in r.spans] == ([] if text == clean else ["assign"])


def test_only_unseen_pairs_are_scanned(spark, monkeypatch):
    first = versions(spark, [("a", 1, "AKIA" + "A" * 14), ("b", 1, "f" * 16)])
    ledger = blob_ledger.scan(first, blob_ledger.empty_ledger(spark))
    again = blob_ledger.scan(first, ledger)
    assert again.count() == 0
    # a new version of one path: only its blob is read
    second = versions(spark, [("a", 1, "AKIA" + "A" * 14), ("a", 2, "e" * 20), ("c", 1, "f" * 16)])
    more = blob_ledger.scan(second, ledger)
    assert [r.blob for r in more.collect()] == [hashlib.sha256(b"e" * 20).hexdigest()]
    both = ledger.union(more)
    # a changed rule: only it runs, on all blobs, and its old findings no longer count
    rules = (*blob_ledger.BASE[:2], blob_ledger.Rule("hex", 2, "[0-9a-f]{18,}"))
    todo = blob_ledger.unseen(blob_ledger.addressed(second), both, rules).collect()
    assert len(todo) == 3 and all(r.todo == ["hex:2"] for r in todo)
    newer = blob_ledger.scan(second, both, rules)
    assert {tuple(r.scanned) for r in newer.collect()} == {("hex:2",)}
    got = spans_of(blob_ledger.findings(second, both.union(newer), rules))
    assert got == [("a", 1, [("access", 0, 18)]), ("a", 2, [("hex", 0, 20)]), ("c", 1, [])]
    # without the broadcast, and with the ledger written twice, nothing changes
    monkeypatch.setattr(blob_ledger, "BROADCAST_BLOBS", 0)
    other = blob_ledger.scan(second, ledger)
    assert sorted(map(str, other.collect())) == sorted(map(str, more.collect()))
    assert spans_of(blob_ledger.findings(second, both.union(newer).union(newer), rules)) == got


def test_edge_cases(spark):
    long = "é" * 200_000 + ' Secret: "0123456789abcdef0123"' + " " * 100_000
    rows = [(None, None, None), ("e", 1, ""), ("e", 1, ""), ("l", 1, long), ("l", 1, long), ("s", 1, "token=secret :abcdefghijklmnop"), ("h", 1, "F" * 20 + "0" * 16)]
    df = versions(spark, rows)
    ledger = blob_ledger.scan(df, blob_ledger.empty_ledger(spark))
    got = spans_of(blob_ledger.findings(df, ledger))
    at = 200_001
    want = [("assign", at, at + 29), ("hex", at + 9, at + 29)]
    assert got == [("", 0, []), ("e", 1, []), ("e", 1, []), ("h", 1, [("hex", 20, 36)]), ("l", 1, want), ("l", 1, want), ("s", 1, [])]
    nothing = df.limit(0)
    assert blob_ledger.scan(nothing, ledger).count() == 0 and blob_ledger.findings(nothing, ledger).count() == 0
    assert blob_ledger.findings(df, blob_ledger.empty_ledger(spark)).filter("size(spans) > 0").count() == 0
    assert blob_ledger.scan(df, ledger, ()).count() == 0


def test_added_rules():
    by = {r.kind: r for r in blob_ledger.RULES}
    find = lambda kind, text: blob_ledger.matches(by[kind], text)
    assert find("key_block", "-----BEGIN RSA PRIVATE KEY-----") == [(0, 31)]
    assert find("web_token", "x eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl") == [(2, 40)]
    assert find("bearer", "Authorization: Bearer abcdefgh12345678") == [(15, 38)]
    assert find("login_url", "db://me:pass@host") == [(2, 13)] and find("login_url", "https://host:80/x@y") == []
    assert find("issued", "ghp_" + "a1" * 10) == [(0, 24)] and find("issued", "ghp_short") == []


def test_query_rows(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_secret_scan(spark, sf)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = materialise(got, "scan").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        found = sorted((s, i, e, rule.kind) for i, rule in enumerate(blob_ledger.RULES) for s, e in blob_ledger.matches(rule, docs[r.doc_id]))
        base = [x for x in found if x[1] < 3]
        line = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert r.spans == line(found) and r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == i for x in base) for i in range(3))
    assert got.filter(F.col("n_hex") > 0).count() > 0
