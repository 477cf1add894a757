import json
import random

import pytest

from leakscope.llm import chat
from leakscope.llm.chat import call_levels, canonical, format_conversations, link_tool_calls, schema_errors

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "k": {"enum": ["x", "y"]}}, "additionalProperties": False}}
MESSAGES, CALLS, RESULTS = (
    "conv_id long, turn long, role string, content string", "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    "conv_id long, turn long, call_id string, content string",
)


def test_canonical_and_schema():
    assert canonical(json.loads('{"b": [1, 2.5],\n "a": "é\\u0001"}')) == '{"a":"é\\u0001","b":[1,2.5]}'
    schema = {"type": "object", "properties": {"n": {"type": ["number", "null"], "maximum": 3}, "l": {"type": "array", "items": {"type": "string", "minLength": 2}, "maxItems": 2}}}
    assert list(schema_errors({"n": None, "l": ["ab"]}, schema)) == []
    assert list(schema_errors({"n": 4, "l": ["a", "bc", "de"]}, schema)) == ["$.l[0]: out of range", "$.l: out of range", "$.n: out of range"]
    assert list(schema_errors({"n": True}, schema)) == ["$.n: not number or null"] and list(schema_errors([], schema)) == ["$: not object"]


def test_links_order_and_validity(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hi"), (1, 9, None, None), (None, 0, "user", "lone")], MESSAGES)
    calls = spark.createDataFrame([
        (1, 1, "c1", "add", '{"a": 1, "k": "x"}', ["c3"]), (1, 2, "c2", "add", '{"a": -1}', []), (1, 3, "c3", "add", '{"b": 2}', None),
        (1, 3, "c3", "add", '{"b": 2}', None), (1, 4, "c4", "add", "no json", ["c9"]), (2, 1, "c1", "sub", "{}", ["c2"]), (2, 2, "c2", "add", None, ["c1"]),
        (1, 7, None, "add", "{}", None), (None, 5, "c1", "add", '{"a": 5}', []),
    ], CALLS)
    results = spark.createDataFrame([(1, 5, "c1", "2"), (1, 6, "c1", "later"), (1, 6, "c7", "orphan"), (2, 3, "c1", None), (None, 6, "c1", "five")], RESULTS)
    rows = {(r.conv_id, r.call_id or r.turn): r for r in link_tool_calls(messages, calls, results, SCHEMAS).collect()}
    assert len(rows) == 12
    assert {k: r.status for k, r in rows.items() if k[0] == 1} == {(1, 0): "plain", (1, 9): "plain", (1, "c1"): "linked", (1, "c2"): "unanswered", (1, "c3"): "unanswered", (1, "c4"): "unanswered", (1, "c7"): "orphan", (1, 7): "unidentified"}
    assert rows[1, 7].record == '{"arguments":{},"depends_on":[],"id":null,"name":"add","result":null}' and rows[1, 7].errors == ["$.a: missing"]
    assert rows[1, "c1"].record == '{"arguments":{"a":1,"k":"x"},"depends_on":["c3"],"id":"c1","name":"add","result":"2"}' and rows[1, "c1"].valid
    assert rows[1, "c2"].errors == ["$.a: out of range"] and rows[1, "c3"].errors == ["$.a: missing", "$.b: unknown"]
    assert rows[1, "c4"].errors == ["$: not JSON"] and rows[2, "c1"].errors == ["$: unknown tool"] and rows[2, "c2"].errors == ["$: not object"]
    assert {k[1]: r.level for k, r in rows.items() if k[0] == 1} == {0: 0, 9: 0, 7: 0, "c1": 1, "c2": 0, "c3": 0, "c4": 0, "c7": 0}
    assert rows[2, "c1"].level is None and rows[2, "c2"].level is None  # a cycle
    assert rows[2, "c1"].status == "linked" and json.loads(rows[None, "c1"].record)["result"] == "five"


CALL_IDS = "conv_id string, call_id string, turn long, depends_on array<string>"


def test_levels_of_a_long_backward_chain(spark):
    calls = spark.createDataFrame([("a", f"c{i}", i, [f"c{i - 1}"] if i else []) for i in range(400)], CALL_IDS)
    assert {r.call_id: r.level for r in call_levels(calls).collect()} == {f"c{i}": i for i in range(400)}


def test_levels_of_a_long_forward_chain(spark, monkeypatch):
    calls = spark.createDataFrame([("a", f"c{i}", i, [f"c{i + 1}"]) for i in range(2000)], CALL_IDS)
    want = {f"c{i}": 1999 - i for i in range(2000)}
    assert {r.call_id: r.level for r in call_levels(calls).collect()} == want
    monkeypatch.setattr(chat, "LOCAL_ROWS", 1000)  # by joins: 11 rounds
    assert {r.call_id: r.level for r in call_levels(calls).collect()} == want


def plain_levels(needs):
    def level(i, above):
        if i in above:
            return None
        below = [level(n, above | {i}) for n in needs[i] if n in needs]
        return None if None in below else max((b + 1 for b in below), default=0)

    return {i: level(i, frozenset()) for i in needs}


@pytest.mark.parametrize("local", [200_000, 9])
def test_levels_like_plain_version(spark, monkeypatch, local):
    monkeypatch.setattr(chat, "LOCAL_ROWS", local)
    random.seed(3)
    convs = {}
    for c in range(30):
        n = random.randint(1, 14)
        order = random.sample(range(n), n)
        needs = {str(i): {str(order[j]) for j in random.sample(range(k), min(k, random.randint(0, 3)))} for k, i in enumerate(order)}
        if c % 5 == 4:  # a cycle, or a call that waits for itself
            needs[str(order[0])].add(str(order[random.randint(0, n - 1)]))
        if c % 3 == 0:
            needs[str(order[-1])].add("none")
        convs[str(c)] = needs
    rows = [(c, i, 0, [*own, None] if int(i) % 2 else sorted(own) or None) for c, needs in convs.items() for i, own in needs.items()]
    got = {(r.conv_id, r.call_id): r.level for r in call_levels(spark.createDataFrame(rows, CALL_IDS)).collect()}
    assert got == {(c, i): v for c, needs in convs.items() for i, v in plain_levels(needs).items()} and len(got) == len(rows)
    assert None in got.values() and max(v or 0 for v in got.values()) > 3
    assert call_levels(spark.createDataFrame([], CALL_IDS)).count() == 0


def test_levels_of_plain_conversations(spark):
    rows = [("a", t, "user", f"q{t}") for t in (1, 3, 5, 9, 11, 2)]
    out = format_conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    assert {r.turn: r.level for r in out.collect()} == {1: 0, 3: 1, 5: 2, 9: 0, 11: 1, 2: 0}


def test_rows_without_id_come_out(spark):
    calls = spark.createDataFrame([(1, 1, None, "add", '{"a": 1}', ["c1"]), (1, 1, None, "add", '{"a": 1}', ["c1"]), (None, None, None, None, None, None)], CALLS)
    results = spark.createDataFrame([(1, 2, None, "x"), (1, 2, None, "y"), (1, 2, None, "y")], RESULTS)
    messages = spark.createDataFrame([(1, 3, "call", "a message")], MESSAGES)
    out = link_tool_calls(messages, calls, results, SCHEMAS).collect()
    assert sorted((r.status, r.record) for r in out) == [
        ("plain", '{"content":"a message","role":"call"}'), ("unidentified", '{"arguments":null,"depends_on":[],"id":null,"name":null,"result":null}'),
        ("unidentified", '{"arguments":{"a":1},"depends_on":["c1"],"id":null,"name":"add","result":null}'),
        ("unidentified", '{"content":"x","id":null,"role":"tool"}'), ("unidentified", '{"content":"y","id":null,"role":"tool"}')]


def test_plain_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, record string"
    rows = [(1, 0, "system", "s", ""), (1, 1, "user", "q 1", ""), (1, 2, "assistant", "a", ""), (1, 3, "user", None, ""), (1, 3, "user", None, ""), (2, 4, "assistant", "x", "")]
    out = {(r.conv_id, r.turn): r for r in format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert len(out) == 4 + 0 and out[1, 1].status == "linked" and out[2, 4].status == "orphan"
    assert json.loads(out[1, 3].record)["depends_on"] == ["c1-1"] and not out[1, 3].valid
    assert format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_every_different_row_comes_out(spark):
    rows = [("a", 1, "user", "q"), ("a", 1, "user", "other q"), ("a", 1, "user", "other q"), ("a", 2, "assistant", "x"), ("a", 2, "assistant", "y"), ("a", 2, "assistant", None),
            ("a", None, "user", "when"), ("a", None, "assistant", "then"), (None, 1, "user", "null q"), ("", 1, "user", "blank q"), (None, 2, "assistant", "null a"), ("", 2, "assistant", "blank a")]
    out = format_conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    linked = {(r.conv_id, json.loads(r.record)["arguments"]["prompt"], json.loads(r.record)["result"]) for r in out if r.status == "linked"}
    assert linked == {("a", "other q", None), (None, "null q", "null a"), ("", "blank q", "blank a")}
    rest = sorted((r.status, r.turn or 0, json.loads(r.record).get("content") or json.loads(r.record)["arguments"]["prompt"]) for r in out if r.status != "linked")
    assert rest == [("duplicate", 1, "q"), ("duplicate", 2, "x"), ("duplicate", 2, "y"), ("plain", 0, "then"), ("plain", 0, "when")]


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_no_numbers_beyond_json(bad):
    with pytest.raises(ValueError):
        canonical({"a": bad})
