"""Linking, order, validation and canonical JSON on a small fixture, and the
query against its SQL."""

import json

from recspark.llm import tool_calls as tc

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, text string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def _link(spark, calls, results):
    rows = tc.link(spark.createDataFrame([(*c, "clash") for c in calls], CALLS), spark.createDataFrame(results, RESULTS),
                   tc.schema_table(spark)).collect()
    return {(r["conv_id"], r["call_id"]): r for r in rows}


def test_fixture(spark):
    got = _link(spark, [
        (1, "a", 0, "search", '{"query":"x","limit":3}', None),
        (1, "b", 1, "translate", '{"target":"en","text":"y","formal":"no"}', ["a"]),
        (1, "c", 2, "count", '{"text":"é \\" \\n","more":[1,{"z":1,"a":2}]}', ["a", "b", "zz"]),
        (1, "d", 3, "count", "not json", ["e"]),
        (1, "e", 4, "nope", '[1]', ["d"]),
        (1, "f", 5, "count", None, ["e"]),
        (1, "a", 7, "count", '{"text":"later"}', None),
        (2, "a", 0, "count", '{"text":"other conversation"}', []),
        (None, "a", 0, "count", "{}", None), (2, None, 0, "count", "{}", None),
    ], [(1, "a", 1, "ra"), (1, "a", 1, "ra"), (1, "q", 2, "lost"), (2, "a", 1, None), (None, "a", 1, "x")])
    assert set(got) == {(1, x) for x in "abcdefq"} | {(2, "a")}
    assert [got[1, x]["level"] for x in "abcdefq"] == [0, 1, 2, None, None, None, None]
    assert [got[1, x]["linked"] for x in "abcdefq"] == [True] + [False] * 6 and got[2, "a"]["linked"]
    assert got[1, "a"]["duplicates"] == 2
    assert {x: got[1, x]["problems"] for x in "abcdefq"} == {
        "a": "", "b": "type of formal", "c": "unknown more; waits for unknown call",
        "d": "arguments are no object; cycle", "e": "unknown tool; arguments are no object; cycle",
        "f": "arguments are no object; cycle", "q": "result without call"}
    for x in "abc":
        text = got[1, x]["json"]
        assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, "a"]["json"]) == {"arguments": {"limit": 3, "query": "x"}, "call_id": "a", "conv_id": 1,
                                               "level": 0, "name": "search", "result": "ra"}


def test_long_chain_in_one_conversation_and_empty(spark):
    n = 2000
    calls = [(1, f"k{i}", i, "count", '{"text":"t"}', [f"k{i - 1}"] if i else []) for i in range(n)]
    got = _link(spark, calls, [])
    assert [got[1, f"k{i}"]["level"] for i in range(n)] == list(range(n))
    assert _link(spark, [], []) == {}


def test_levels_against_a_plain_walk(spark):
    """Runs, forks, calls with several waits, waits into cycles, cycles of one, two and five."""
    import random

    rng = random.Random(5)
    calls = []
    for conv in range(6):
        for i in range(60):
            k = rng.choice([0, 1, 1, 1, 1, 2, 3])
            calls.append((conv, f"k{i}", i, "count", '{"text":"t"}', [f"k{rng.randrange(i)}" for _ in range(k)] if i else []))
    calls += [(9, f"r{i}", i, "count", "{}", [f"r{(i + 1) % 5}"]) for i in range(5)]
    calls += [(9, "self", 6, "count", "{}", ["self"]), (9, "x", 7, "count", "{}", ["y"]), (9, "y", 8, "count", "{}", ["x"]),
              (9, "in1", 9, "count", "{}", ["r0"]), (9, "in2", 10, "count", "{}", ["in1", "ok"]), (9, "ok", 11, "count", "{}", None),
              (9, "after", 12, "count", "{}", ["in2"]), (9, "fine", 13, "count", "{}", ["ok", "ok", None, "gone"])]
    want = {}
    while True:  # until no level changes
        new = {}
        ids = {(c, i) for c, i, *_ in calls}
        for c, i, _, _, _, after in calls:
            deps = [(c, d) for d in after or [] if (c, d) in ids]
            if all(d in want for d in deps):
                new[c, i] = max((want[d] + 1 for d in deps), default=0)
        if new == want:
            break
        want = new
    got = tc.levels(spark.createDataFrame([(*c, "") for c in calls], CALLS)).collect()
    assert len(got) == len(want) and {(r["conv_id"], r["call_id"]): r["level"] for r in got} == want
    assert set(want) >= {(9, "ok"), (9, "fine")} and not {i for c, i in want if c == 9} - {"ok", "fine"}
