import json
import random

import pytest

from panelloom.llm.chat import ANSWER, as_events, linked

SCHEMA = (
    "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, "
    "content string, after array<string>, place string, calls int"
)
SCHEMAS = {
    "add": {"a": ("integer", True), "b": ("number", False), "note": ("string", False)},
    "find": {"q": ("object", True), "flags": ("array", False), "on": ("boolean", False)},
}


def call(conv, turn, call_id, name="add", arguments='{"a":1}', after=None):
    return (conv, turn, "call", "assistant", call_id, name, arguments, None, after, "x", 1)


def result(conv, turn, call_id, content="done"):
    return (conv, turn, "result", "tool", call_id, None, None, content, None, "x", 1)


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "name, arguments, told",
    [
        ("add", '{"a":1,"b":2.5,"note":"x"}', []),
        ("add", '{"b":3}', ["a: missing"]),
        ("add", '{"a":null}', ["a: missing"]),
        ("add", '{"a":1.5,"b":"x","c":1,"aa":2}', ["a: not integer", "b: not number", "aa: unknown", "c: unknown"]),
        ("add", "[1]", ["arguments: not a JSON object"]),
        ("add", '{"a":1', ["arguments: not a JSON object"]),
        ("add", '{"a":1,"a":2}', ["arguments: not a JSON object"]),
        ("add", None, ["arguments: not a JSON object"]),
        ("find", '{"q":{"x":[]},"flags":[1],"on":true}', []),
        ("find", '{"q":[],"flags":{},"on":1}', ["flags: not array", "on: not boolean", "q: not object"]),
        ("other", '{"a":1}', ["unknown tool"]),
        (None, '{"a":1}', ["unknown tool"]),
    ],
)
def test_arguments(spark, name, arguments, told):
    row = linked(events(spark, [call(1, 0, "x", name, arguments)]), SCHEMAS).first()
    assert row.problems == told


def test_status_and_json(spark):
    rows = [
        (1, 0, "message", "user", None, None, None, 'say "hé"\n/', None, "x", 1),
        call(1, 1, "a", arguments='{ "note" : "é\\u0041", "a" : 10, "b": 1e2 }'),
        result(1, 2, "a"),
        call(1, 3, "open"),
        result(1, 4, "orphan"),
        call(1, 5, "twice"), call(1, 6, "twice"), result(1, 7, "twice"),
        call(1, 8, None), result(1, 9, None),
        call(2, 0, "a", after=["gone", "twice"]),  # the other conversation's calls are not known here
        call(None, None, "n"), result(None, 3, "n"),
        result(1, 2, "same"), result(1, 2, "same"), call(1, 1, "same"),
    ]
    found = linked(events(spark, rows), SCHEMAS).collect()
    assert len(found) == len(rows)
    status = sorted((r.conv_id or 0, r.kind, r.call_id or "", r.status) for r in found)
    assert status == sorted([
        (1, "message", "", "message"), (1, "call", "a", "answered"), (1, "result", "a", "linked"),
        (1, "call", "open", "open"), (1, "result", "orphan", "orphan"),
        (1, "call", "twice", "ambiguous"), (1, "call", "twice", "ambiguous"), (1, "result", "twice", "ambiguous"),
        (1, "call", "", "unnamed"), (1, "result", "", "unnamed"), (2, "call", "a", "open"),
        (0, "call", "n", "answered"), (0, "result", "n", "linked"),
        (1, "result", "same", "ambiguous"), (1, "result", "same", "ambiguous"), (1, "call", "same", "ambiguous"),
    ])
    by = {(r.conv_id, r.kind, r.call_id): r for r in found}
    assert by[1, "message", None].json == '{"content":"say \\"hé\\"\\n/","role":"user","type":"message"}'
    assert by[1, "call", "a"].json == '{"arguments":{"a":10,"b":100.0,"note":"éA"},"id":"a","name":"add","type":"call"}'
    assert by[1, "result", "a"].json == '{"content":"done","id":"a","type":"result"}'
    assert by[2, "call", "a"].problems == ["after gone: missing", "after twice: missing"]
    assert all(json.loads(r.json) for r in found)
    assert linked(events(spark, []), SCHEMAS).count() == 0


def test_order(spark):
    rng = random.Random(1)
    rows, parents = [], {}
    for conv in range(12):
        n = rng.randrange(2, 12)
        name = [f"k{i}" for i in rng.sample(range(100), n)]
        for i in range(n):
            after = [x for x in name[:i] if rng.random() < 0.3]
            parents[conv, name[i]] = after
            rows.append(call(conv, rng.randrange(10), name[i], after=after or None))
            if rng.random() < 0.7:
                rows.append(result(conv, rng.randrange(12), name[i]))
    # A cycle, and a long chain told backwards.
    rows += [call(50, 3, "a", after=["c"]), call(50, 4, "b", after=["a"]), call(50, 5, "c", after=["b"]), call(50, 9, "d", after=["c"])]
    rows += [call(51, 8 - i, f"s{i}", after=[f"s{i - 1}"] if i else None) for i in range(8)]
    found = linked(events(spark, rows), SCHEMAS).collect()
    key = {(r.conv_id, r.kind, r.call_id): (r.place, r.depth) for r in found}
    turn = {(r[0], r[2], r[4]): r[1] for r in rows}
    ends = lambda c, x: key.get((c, "result", x), key[c, "call", x])
    for (conv, kind, x), at in key.items():
        if kind == "result" and (conv, "call", x) in key:
            assert at > key[conv, "call", x]
        if conv < 50 and kind == "call":
            before = [ends(conv, p) for p in parents[conv, x]]
            assert all(at > b for b in before)
            if all((turn[conv, "call", x], 0) > b for b in before):
                assert at == (turn[conv, "call", x], 0)
    assert {r.call_id for r in found if r.status == "cyclic"} & {"a", "b", "c"}
    assert [key[51, "call", f"s{i}"] for i in range(8)] == [(8, i) for i in range(8)]


def test_plain_conversation(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be nice"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (2, 0, "assistant", "?")],
        "conv_id long, turn long, role string, text string",
    )
    found = linked(as_events(turns), ANSWER).orderBy("conv_id", "place").collect()
    assert [(r.status, r.problems) for r in found] == [
        ("message", []), ("answered", []), ("linked", []), ("open", ["question: missing"]), ("orphan", []),
    ]
