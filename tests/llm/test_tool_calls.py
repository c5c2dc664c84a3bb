import re
import json

import pytest

from veilframe.llm import tool_calls as T

TOOLS = {"find": {"q": ("string", True), "n": ("integer", False)}, "any": {"o": ("object", True), "l": ("array", False), "b": ("boolean", False), "x": ("number", False)}}
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string, json int"
RESULTS = "conv_id long, call_id string, turn long, content string"


@pytest.mark.parametrize(("name", "arguments", "problems"), [
    ("find", '{"q":"a","n":3}', []), ("find", '{"n":3}', ["missing q"]), ("find", '{"q":1,"n":"3"}', ["type of q", "type of n"]),
    ("find", '{"q":"a","z":1,"b":2}', ["extra b", "extra z"]), ("find", '{"q":null}', ["type of q"]), ("find", '{"q":"a"', ["bad json"]),
    ("find", '[1]', ["no object"]), ("find", None, ["missing q"]), ("none", '{}', ["unknown tool"]), (None, '{}', ["unknown tool"]),
    ("any", '{"o":{},"l":[1],"b":true,"x":1.5}', []), ("any", '{"o":[],"l":{},"b":0,"x":"1"}', ["type of o", "type of l", "type of b", "type of x"]),
    ("find", '{"q":"a","n":2.5}', ["type of n"]), ("find", '{"q":"a","q":"b"}', ["bad json"]), ("find", "", ["bad json"])])
def test_arguments(frame, name, arguments, problems):
    from pyspark.sql import functions as F
    out = frame([(name, arguments)], "name string, arguments string").select(
        T.argument_problems(F.col("name"), F.col("arguments"), TOOLS).alias("p")).first().p
    assert out == problems


def linked(frame, calls, results):
    out = T.link_calls(frame([(*c, 0) for c in calls], CALLS), frame(results, RESULTS), TOOLS).collect()
    return {(r.conv_id, r.call_id): r for r in out}, out


def test_links_order_and_json(frame):
    ok = '{"q":"a", "n": 3}'
    calls = [(1, "a", 1, "find", ok, None), (1, "b", 3, "find", ok, "a"), (1, "c", 5, "find", ok, "b"), (1, "d", 5, "find", ok, "zz"),
             (1, "x", 7, "find", ok, "y"), (1, "y", 8, "find", ok, "x"), (1, "v", 9, "find", ok, "x"), (2, "a", 1, "find", ok, "b"), (1, "a", 9, "find", "{}", None),
             (None, "a", 1, "find", ok, None), (3, None, 1, "find", ok, None), (3, None, 1, "find", ok, None), (4, "e", 6, "find", "{oops", None)]
    results = [(1, "a", 2, "é\n"), (1, "a", 4, "later"), (1, "b", 2, "early"), (9, "q", 1, "lost"), (None, "a", 2, "r"), (None, "a", 2, "r")]
    by_id, rows = linked(frame, calls, results)
    assert [by_id[1, i].depth for i in "abcdxyv"] == [0, 1, 2, 0, None, None, None]
    assert json.loads(by_id[1, "a"].json) == {"arguments": {"n": 3, "q": "a"}, "id": "a", "name": "find", "result": "é\n"}
    assert by_id[1, "a"].json.startswith('{"arguments":{"n":3,"q":"a"},"id":"a"') and by_id[1, "a"].copies == 2
    assert by_id[1, "b"].problems == ["early result"] and by_id[1, "d"].problems == ["no result", "dangling"]
    assert by_id[1, "x"].problems == ["no result", "cycle"] and by_id[2, "a"].problems == ["no result", "dangling"]
    assert by_id[9, "q"].problems == ["no call"] and json.loads(by_id[9, "q"].json) == {"id": "q", "result": "lost"}
    assert json.loads(by_id[4, "e"].json)["arguments"] == "{oops"
    assert len([r for r in rows if r.conv_id == 3]) == 2 and len([r for r in rows if r.conv_id is None]) == 3


def test_long_chain(frame):
    calls = [(1, f"c{i}", i, "find", '{"q":"a"}', f"c{i - 1}") for i in range(100)]
    by_id, _ = linked(frame, calls, [])
    assert [by_id[1, f"c{i}"].depth for i in range(100)] == list(range(100))


def test_lookups_never_go_through_the_driver(frame, monkeypatch):
    # Their tables are small as files, so that the planner would broadcast them, each row 16 times.
    plans, write = [], T.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(T, "written", noted)
    calls = [(1, f"c{i}", i, "find", '{"q":"a"}', f"c{i - 1}", 0) for i in range(4)]
    out = T.link_calls(frame(calls, CALLS), frame([(1, "c0", 1, "x")], RESULTS), TOOLS)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
    assert sorted((r.call_id, r.depth) for r in out.collect()) == [(f"c{i}", i) for i in range(4)]


def test_nothing(frame):
    assert linked(frame, [], [])[1] == []


def test_runs_without_python(spark, sf):
    from veilframe.llm.queries import QUERIES
    plan = QUERIES["op7_tool_calls"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
