import json

from tessera.llm import tool_calls as tc

SCHEMAS = {"add": (tc.Field("a", "integer"), tc.Field("b", "number", required=False, high=10), tc.Field("s", "string", required=False, low=2))}
CALL = "conv_id long, turn long, seq int, call_id string, name string, arguments string, after array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"


def run(spark, calls, results):
    made = tc.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), schemas=SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in made.collect()}


def test_links_levels_and_status(spark):
    calls = [
        (1, 5, 0, "d", "add", '{"a":1}', ["b", "c"]), (1, 1, 0, "a", "add", '{"a":1}', []), (1, 2, 0, "b", "add", '{"a":1}', ["a"]), (1, 3, 0, "c", "add", '{"a":1}', ["b", "a", "a"]),
        (2, 1, 0, "x", "add", '{"a":1}', ["y"]), (2, 2, 0, "y", "add", '{"a":1}', ["x"]), (2, 3, 0, "z", "add", '{"a":1}', ["x"]), (2, 4, 0, "w", "add", '{"a":1}', ["gone"]),
        (3, 2, 0, "a", "add", '{"a":2}', []), (3, 1, 0, "a", "add", '{"a":1}', []), (None, 1, 0, "q", "add", '{"a":1}', []), (4, 1, 0, None, "add", '{"a":1}', []),
    ]
    results = [(1, 2, "a", "one"), (1, 3, "b", None), (9, 1, "a", "stray"), (3, 4, "a", "B"), (3, 3, "a", "A"), (None, 1, "a", "n")]
    rows = run(spark, calls, results)
    assert len(rows) == 13
    assert [rows[1, c].level for c in "abcd"] == [0, 1, 2, 3]
    assert [rows[2, c].level for c in "xyzw"] == [None, None, None, 0]
    assert rows[2, "z"].errors == "dependencies form a cycle"
    assert rows[2, "w"].errors == "a dependency is not known"
    assert rows[1, "a"].status == rows[1, "b"].status == "linked"
    assert rows[1, "d"].status == "unanswered"
    assert (rows[9, "a"].status, rows[9, "a"].canonical_json) == ("orphan result", '{"arguments":null,"id":"a","level":null,"name":null,"result":"stray"}')
    assert (rows[3, "a"].n_calls, rows[3, "a"].n_results, rows[3, "a"].canonical_json) == (2, 2, '{"arguments":{"a":1},"id":"a","level":0,"name":"add","result":"A"}')
    assert rows[4, None].status == rows[None, "q"].status == rows[None, "a"].status == "no identifier"


def test_long_chains_and_junctions(spark):
    calls = [(1, i, 0, f"c{i}", "add", '{"a":1}', [f"c{i - 1}"] if i else []) for i in range(70)]
    calls += [(1, 100, 0, "j", "add", '{"a":1}', ["c69", "c3"]), (1, 101, 0, "k", "add", '{"a":1}', ["j"]), (1, 102, 0, "m", "add", '{"a":1}', ["k", "c1", "j"]), (1, 103, 0, "n", "add", '{"a":1}', ["m"])]
    calls += [(2, 0, 0, "p", "add", '{"a":1}', ["q"]), (2, 1, 0, "q", "add", '{"a":1}', ["p"]), (2, 2, 0, "r", "add", '{"a":1}', ["q"]), (2, 3, 0, "s", "add", '{"a":1}', ["r", "t"]), (2, 4, 0, "t", "add", '{"a":1}', []), (2, 5, 0, "u", "add", '{"a":1}', ["u"])]
    rows = run(spark, calls, [])
    assert [rows[1, f"c{i}"].level for i in range(70)] == list(range(70))
    assert [rows[1, c].level for c in "jkmn"] == [70, 71, 72, 73]
    assert [rows[2, c].level for c in "pqrstu"] == [None, None, None, None, 0, None]


def test_arguments_against_schemas(spark):
    cases = {
        '{"a": 1, "b": 2.5}': "", '{"a": "1"}': "a is not of type integer", '{"b": 11}': "a is missing; b is above 10", '{"a":1,"z":0,"s":"x"}': "s is below 2; z is not known",
        "{": "arguments are not JSON", '{"a": null}': "a is missing", '{"a": 1.5}': "a is not of type integer",
    }
    calls = [(1, i, 0, f"c{i}", "add", a, []) for i, a in enumerate(cases)] + [(1, 99, 0, "u", "other", "{}", []), (1, 100, 0, "n", None, None, None)]
    rows = run(spark, calls, [])
    assert [rows[1, f"c{i}"].errors for i in range(len(cases))] == list(cases.values())
    assert rows[1, "u"].errors == "tool is not known"
    assert rows[1, "n"].errors == "arguments are not JSON"
    assert rows[1, "c0"].valid and not rows[1, "c1"].valid


def test_canonical_json_sorts_keys(spark):
    text = '{ "b" : {"y":[1, {"q":"\\u00e9\\n","p":null}], "x":"\\"q\\"/"}, "a" : 1 }'
    rows = run(spark, [(1, 1, 0, "i\n\"", "add", text, [])], [(1, 2, "i\n\"", "line\n\ttab é")])
    made = rows[1, 'i\n"'].canonical_json
    want = {"arguments": json.loads(text), "id": 'i\n"', "level": 0, "name": "add", "result": "line\n\ttab é"}
    assert made == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_messages(spark):
    rows = [
        (1, 0, "user", "hello there"), (1, 1, "assistant", "hi"), (1, 2, "user", "more"), (1, 2, "user", "more"), (1, 3, "system", "x"), (2, 0, "assistant", '{"tool_calls":[{"id":"k","name":"answer","arguments":{"words":2,"query":"q"}},{"id":"l","name":"answer","arguments":{},"after":["k"]}]}'),
        (2, 1, "tool", '{"tool_call_id":"k","content":"ok"}'), (3, 0, "user", None), (3, None, "user", "lost"), (4, 0, None, "no role"), (5, 0, "user", "{not json"),
    ]
    m = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, level string")
    made = {(r.conv_id, r.call_id): r for r in tc.link(tc.calls_of(m), tc.results_of(m)).collect()}
    assert set(made) == {(1, "call-0"), (1, "call-2"), (2, "k"), (2, "l"), (3, "call-0"), (3, None), (5, "call-0")}
    assert (made[1, "call-0"].status, made[1, "call-2"].status, made[1, "call-2"].level, made[1, "call-2"].n_calls) == ("linked", "unanswered", 1, 2)
    assert (made[2, "k"].valid, made[2, "l"].level, made[2, "l"].errors) == (True, 1, "query is missing; words is missing")
    assert made[3, "call-0"].errors == "query is below 1; words is below 1"
    plan = tc.link(tc.calls_of(m), tc.results_of(m))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert tc.link(tc.calls_of(m.limit(0)), tc.results_of(m.limit(0))).collect() == []


def test_tables_written(spark, monkeypatch):
    """Each table is a file a partition: those of Kahn's rounds are written only where a call has several dependencies."""
    names, save = [], tc.Scratch.save
    monkeypatch.setattr(tc.Scratch, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    plain = [(1, i, 0, f"c{i}", "add", '{"a":1}', [f"c{i - 1}", f"c{i - 1}", "gone", None] if i else []) for i in range(4)]
    rows = run(spark, plain, [])
    assert [(rows[1, f"c{i}"].level, rows[1, f"c{i}"].errors) for i in range(4)] == [(0, "")] + [(i, "a dependency is not known") for i in range(1, 4)]
    assert [n for n in names if not n.startswith("chain")] == ["calls", "state"]
    names.clear()
    rows = run(spark, [*plain, (1, 9, 0, "j", "add", '{"a":1}', ["c3", "c1"])], [])
    assert rows[1, "j"].level == 4
    assert "hung" in names
