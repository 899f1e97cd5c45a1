from __future__ import annotations

import json

from observatory.llm import chat

SCHEMAS = {"look": {"properties": {"q": "string", "n": "integer", "x": "number", "tags": "array"}, "required": ["q"]}}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, json string")
    return [r.asDict() for r in chat.format_messages(df, SCHEMAS).collect()]


def call(*calls, content=None):
    return json.dumps({"tool_calls": [{"name": n, "id": i, "arguments": a} for i, n, a in calls], "content": content})


def test_links_order_and_validity(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "tool", json.dumps({"tool_call_id": "b", "content": "early"})),
        (1, 2, "assistant", call(("a", "look", {"q": "x", "n": 2}), ("b", "look", {"q": 3}), ("c", "other", {}), (None, "look", {"q": "y"}))),
        (1, 3, "tool", json.dumps({"content": "ok", "tool_call_id": "a"})), (1, 4, "tool", json.dumps({"tool_call_id": "zz"})),
        (2, 5, "tool", json.dumps({"tool_call_id": "a"})),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, rows)}
    assert len(got) == 6
    assert (got[1, 2]["n_calls"], got[1, 2]["n_valid"], got[1, 2]["n_answered"], got[1, 2]["linked"]) == (4, 2, 2, None)
    assert [got[k]["linked"] for k in ((1, 1), (1, 3), (1, 4), (2, 5))] == [True, True, False, False]
    order = sorted((r["order_turn"], r["order_step"], r["turn"]) for r in got.values() if r["conv_id"] == 1)
    assert [t for *_, t in order] == [0, 2, 1, 3, 4]
    assert got[1, 3]["json"] == '{"content":"ok","role":"tool","tool_call_id":"a"}'
    assert got[1, 2]["json"].startswith('{"role":"assistant","tool_calls":[{"arguments":{"n":2,"q":"x"},"id":"a","name":"look"}')


def test_types(spark):
    values = [({"q": "a", "x": 1.5}, 1), ({"q": "a", "x": 2}, 1), ({"q": "a", "tags": [1]}, 1), ({"q": "a", "tags": "t"}, 0), ({"n": 1}, 0), ({"q": None}, 0), ({"q": "a", "n": 1.5}, 0), ([1], 0), ({"q": "a", "more": 1}, 1)]
    rows = [(9, i, "assistant", call((f"i{i}", "look", a))) for i, (a, _) in enumerate(values)]
    got = {r["turn"]: r["n_valid"] for r in run(spark, rows)}
    assert [got[i] for i in range(len(values))] == [v for _, v in values]


def test_edge_cases(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, ""), (None, 2, "tool", '{"tool_call_id": "a"}'), (1, None, "user", "{ not json"), (1, 3, "user", "[1]"),
        (1, 4, "user", '{"tool_calls": "no", "content": 5}'), (1, 4, "user", '{"tool_calls": "no", "content": 5}'), (1, 5, "user", "ж😀\"\\\n" + "x" * 200_000),
        (1, 6, "assistant", call(("a", "look", {"q": "x"}))), (1, 7, "assistant", call(("a", "look", {"q": "x"}))), (1, 8, "tool", '{"tool_call_id": "a"}'),
    ]
    got = run(spark, rows)
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 0]["json"] == '{"role":"user"}' and by[1, 1]["json"] == '{"content":""}' and by[None, 2]["linked"] is False
    assert json.loads(by[1, None]["json"])["content"] == "{ not json" and by[1, 4]["json"] == '{"content":"5","role":"user"}'
    assert json.loads(by[1, 5]["json"])["content"].startswith("ж😀\"\\\n") and by[1, 8]["linked"] and by[1, 8]["order_turn"] == 8
    assert run(spark, rows[:0]) == []


def test_chains_of_moved_results_and_pasted_objects(spark):
    both = lambda answers, i: json.dumps({"tool_call_id": answers, "tool_calls": [{"id": i, "name": "look", "arguments": {"q": "x"}}]})
    rows = [
        (1, 1, "tool", both("x", "y")), (1, 2, "tool", both("y", "z")), (1, 3, "tool", json.dumps({"tool_call_id": "z"})), (1, 5, "assistant", call(("x", "look", {"q": "x"}))),
        (1, 6, "user", '{"a": 1}'), (2, 1, "tool", both("q", "p")), (2, 2, "tool", both("p", "q")), (2, 0, "tool", both("p", "r")), (2, -1, "tool", json.dumps({"tool_call_id": "r"})),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, rows)}
    assert len(got) == len(rows)
    assert [(got[1, t]["order_turn"], got[1, t]["order_step"]) for t in (5, 1, 2, 3)] == [(5, 0), (5, 1), (5, 2), (5, 3)]
    assert json.loads(got[1, 6]["json"]) == {"content": '{"a": 1}', "role": "user"}
    # two calls that wait for each other: the first turn goes behind the other's own turn, all that hangs on them follows
    assert [(got[2, t]["order_turn"], got[2, t]["order_step"]) for t in (1, 2, 0, -1)] == [(2, 1), (2, 2), (2, 2), (2, 3)]
