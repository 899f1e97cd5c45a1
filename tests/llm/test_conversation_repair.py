from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from observatory.llm import conversation_repair as cr
from observatory.llm import queries

WHOLE = re.compile(r"(s?(ua)+)?")


def slow(rows):
    """Cheapest edits of (initial, gone, cut) rows, ASCII-least, by trying all letters row by row."""
    best = {}

    def visit(i, made, cost, letters):
        if i == len(rows):
            tails = [""] if WHOLE.fullmatch(made) else []
            tails += [t for t in ("a", "ua") if WHOLE.fullmatch(made + t)]
            for t in tails:
                key = (cost + 3 * len(t), letters + "I" * len(t))
                best["x"] = min(best.get("x", key), key)
            return
        role, gone, cut = rows[i]
        for add in ("", "u", "a", "ua", "au"):
            now, spent, text = made + add, cost + 3 * len(add), letters + "I" * len(add)
            if not WHOLE.match(now) or not any(WHOLE.fullmatch(now + t) for t in ("", "a", "ua")):
                continue
            visit(i + 1, now, spent + 4, text + "D")
            if not gone:
                fits = lambda r: any(WHOLE.fullmatch(now + r + t) for t in ("", "a", "ua"))  # noqa: B023, E731
                if role in "sua" and role and fits(role):
                    visit(i + 1, now + role, spent + 3 * cut, text + "K")
                for r in "ua":
                    if fits(r):
                        visit(i + 1, now + r, spent + 3 + 3 * cut, text + "R")

    visit(0, "", 0, "")
    return best["x"]


def symbol(role, gone, cut):
    return cr.GONE if gone else 2 * ("sua".find(role) if role in "sua" else 3) + cut


ROWS = [(r, False, c) for r in "sua?" for c in (False, True)] + [("u", True, False)]


def solved(rows):
    symbols = bytes(symbol(*r) for r in rows)
    v, cost, letters, state = cr.solve(symbols)
    return cost + cr.tables().vectors[v][cr.START], letters + cr.closing(state)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_all_short_conversations(n):
    for rows in itertools.product(ROWS, repeat=n):
        assert solved(rows) == slow(rows), rows


@pytest.mark.parametrize("seed", range(40))
def test_longer_conversations(seed):
    rng = random.Random(seed)
    rows = [rng.choice(ROWS) for _ in range(rng.randint(4, 6))]
    assert solved(rows) == slow(rows)


def test_few_vectors_and_blocks_equal_single_steps():
    t = cr.tables()
    assert t.n == 30 and all(min(v) == 0 and max(v) <= 6 for v in t.vectors)
    rng = random.Random(1)
    for _ in range(200):
        symbols = bytes(rng.randrange(cr.SYMBOLS) for _ in range(rng.randint(0, 23)))
        table = cr.table_of(symbols)
        for v, state in ((rng.randrange(t.n), s) for s in range(4)):
            before, cost, letters, after = cr.solve(symbols, v, state)
            assert table[v].tolist()[:2] == [before, cost] and table[v, 2 + state] == after
            assert len(letters.replace("I", "")) == len(symbols)


@pytest.mark.parametrize("seed", range(20))
def test_segments_chain(seed):
    rng = random.Random(seed)
    parts = [bytes(rng.randrange(cr.SYMBOLS) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
    v, cost, letters, state = cr.solve(b"".join(parts))
    steps = [cr.table_of(p) for p in parts]
    assert (cr.chained(steps)[0] == cr.table_of(b"".join(parts))[0]).all()
    marks, total = cr.told(steps, 0, cr.START)
    assert total == cost + cr.tables().vectors[v][cr.START]
    pieces = [cr.solve(p, b, s) for p, (b, s) in zip(parts, marks, strict=True)]
    assert "".join(p[2] for p in pieces) == letters and pieces[-1][3] == state


def report(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, digest string, segment int")
    return {r.conv_id: r for r in cr.reports(cr.repair(df, **how)).collect()}


def plain(rows):
    """The whole report of one conversation, row by row."""
    space = " \t\n\x0b\x0c\r"
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), hashlib.sha256(m[2].encode()).hexdigest()))
    seen, marks, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(space)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        marks.append((role[:1] or "?", fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = solved(marks)
    state, lines, i = "", [], 0
    for letter in audit:
        if letter == "I":
            role = "assistant" if state == "u" else "user"
            lines.append(f"{role}:")
        else:
            _, role, text = rows[i]
            i += 1
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if state == "u" else "user"
            lines.append(f"{role}:{text}")
        state = role[0]
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def fields(r):
    return tuple(r)[1:]


@pytest.mark.parametrize("segment_rows", [4096, 5])
def test_conversations_in_spark(spark, segment_rows):
    rng = random.Random(segment_rows)
    rows = []
    for conv in [None, *range(30)]:
        for turn in range(rng.choice([1, 3, 8, 40])):
            text = rng.choice(["a.", "b", "", " \t", f"{turn}!", f"{turn} ja. \n", None, "é😀?"])
            rows.append((conv, rng.choice([turn, turn, turn // 2, None, turn * 10]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    got = report(spark, rows, segment_rows=segment_rows)
    assert len(got) == 31
    for conv, r in got.items():
        assert fields(r) == plain([x[1:] for x in rows if x[0] == conv]), conv


def test_a_conversation_with_nearly_all_rows(spark):
    """Cut over many segments and tasks; half of it are copies of one message."""
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"line {t}" + "." * (t % 5 > 0)) for t in range(3000)] + [(7, 3000, "user", "again.")] * 3000 + [(8, 0, "user", "hi.")]
    got = report(spark, rows, segment_rows=64)
    assert fields(got[7]) == plain([x[1:] for x in rows if x[0] == 7]) and fields(got[8]) == plain([(0, "user", "hi.")])


def test_copies_and_conversations_without_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", 2), (1, 1, "assistant", "b.", 1), (2, 0, "user", "c.", 0), (None, 0, None, None, 0)], "conv_id bigint, turn bigint, role string, text string, copies int")
    got = {r.conv_id: fields(r) for r in cr.reports(cr.repair(df, copies_col="copies")).collect()}
    assert got[1] == plain([(0, "user", "a."), (0, "user", "a."), (1, "assistant", "b.")]) and got[1][6] == "KDK"
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == got[None] == empty
    assert cr.reports(cr.repair(df.limit(0))).collect() == []


def test_long_texts_and_messages(spark):
    long = "ж" * 300_000 + "."
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", long), (1, 2, "assistant", long + " "), (2, 5, "tool", "x.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    repaired = cr.repair(df)
    out = sorted(cr.messages(repaired).collect(), key=lambda m: (m.conv_id, m.task, m.segment, m.place))
    assert [(m.conv_id, m.role, len(m.text)) for m in out] == [(1, "system", 2), (1, "user", 300_001), (1, "assistant", 300_002)]
    got = {r.conv_id: fields(r) for r in cr.reports(repaired).collect()}
    assert got == {c: plain([x[1:] for x in rows if x[0] == c]) for c in (1, 2)} and got[2][6] == "D"


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "Yes. No? Oh!") for c in range(40) for t in range(4)] + [(None, 1, None, None), (3, None, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for r in queries.damaged(df).collect():
        h = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(h, 1)
        if r.conv_id is not None and r.turn is not None:
            assert r.role == ("user" if h == 4 else "assistant") and r.text == {1: "", 2: "Yes No Oh"}.get(h, "Yes. No? Oh!")
