import json
import re

from casewright.llm import chat_tools

SCHEMAS = {"f": {"x": ("integer", True), "s": ("string", False), "n": ("number", False), "o": ("object", False)}}
FIELDS = "conv_id long, turn long, role string, content string, tool_calls string, tool_call_id string, name string, level string"


def link(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FIELDS).repartition(3)
    return {(r.conv_id, r.call_id, r.turn): r for r in chat_tools.link_tool_calls(df, SCHEMAS).collect()}


def call(conv, turn, *calls):
    return (conv, turn, "assistant", None, json.dumps([{"id": i, "name": n, "arguments": json.dumps(a) if not isinstance(a, str) else a} for i, n, a in calls]), None)


def result(conv, turn, of, content="ok"):
    return (conv, turn, "tool", content, None, of)


def test_links_order_validation_and_json(spark):
    rows = [
        call(1, 1, ("a", "f", {"x": 1}), ("b", "f", {"x": 2, "s": "$a"})),
        call(1, 3, ("c", "f", {"s": "$b", "x": 3}), ("d", "f", {"x": 4, "s": "$zz"}), ("p", "f", {"x": 1, "s": "$q"}), ("q", "f", {"x": 1, "s": "$p"})),
        call(1, 9, ("a", "f", {"x": 9})),
        result(1, 2, "a"), result(1, 4, "b", 'say "hi"\n\\ é'), result(1, 2, "c"), result(1, 5, "lost"), result(1, 7, "a", "second"),
        call(2, 1, ("a", "f", {"x": "1"}), ("e", "g", {}), ("h", "f", "{bad"), ("i", "f", [1]), ("j", "f", {"s": 5, "n": 1.5, "o": {"z": 1, "a": [True, None]}}), ("k", "f", {"x": None})),
        call(None, 1, ("a", "f", {"x": 5, "s": "$a2"}), ("a2", "f", {"x": 5})), result(None, 2, "a"),
        (3, 1, "user", "plain", None, None), (3, 2, "assistant", "", "not json", None), (3, 3, "tool", "x", None, None), (3, None, None, None, None, None),
    ]
    got = link(spark, rows + rows[:1] + rows[3:4])
    assert (got[1, "a", 9].status, got.pop((1, "a", 9)).errors) == ("early", ["id:repeated"])
    got = {k[:2]: r for k, r in got.items()}
    status = {k: (r.level, r.status, r.errors) for k, r in got.items()}
    assert status == {
        (1, "a"): (0, "linked", []), (1, "b"): (0, "linked", []), (1, "c"): (0, "early", []), (1, "d"): (0, "unanswered", ["reference:unknown call"]),
        (1, "p"): (None, "cycle", []), (1, "q"): (None, "cycle", []), (1, "lost"): (None, "orphan", None),
        (2, "a"): (0, "unanswered", ["x:not integer"]), (2, "e"): (0, "unanswered", ["name:unknown tool"]), (2, "h"): (0, "unanswered", ["arguments:not JSON"]),
        (2, "i"): (0, "unanswered", ["arguments:not an object"]), (2, "j"): (0, "unanswered", ["s:not string", "x:missing"]), (2, "k"): (0, "unanswered", ["x:missing"]),
        (None, "a"): (1, "linked", []), (None, "a2"): (0, "unanswered", []), (3, None): (None, "orphan", None),
    }
    assert got[1, "b"].json == '{"arguments":{"s":"$a","x":2},"id":"b","name":"f","result":' + json.dumps('say "hi"\n\\ é', ensure_ascii=False) + "}"
    assert got[1, "a"].json.endswith('"result":"ok"}') and got[1, "a"].turn == 1
    assert got[2, "j"].json == '{"arguments":{"n":1.5,"o":{"a":[true,null],"z":1},"s":5},"id":"j","name":"f","result":null}'
    assert json.loads(got[2, "h"].json)["arguments"] == "{bad"


def test_long_chain_and_empty_table(spark):
    rows = [call(1, k, (f"c{k}", "f", {"x": k, "s": f"$c{k - 1}"})) for k in range(1, 400)]
    assert {r.level for r in link(spark, rows).values()} == {0}
    assert link(spark, []) == {}


def plain_levels(needs):
    """The definition over {call: calls it needs}; calls are (conversation, turn)."""
    moved = {k for k, ks in needs.items() if any(x > k for x in ks)}
    while more := {k for k, ks in needs.items() if k not in moved and moved & set(ks)}:
        moved |= more
    level = dict.fromkeys(needs.keys() - moved, 0)
    while placed := {k: 1 + max((level[x] for x in needs[k] if x in moved), default=0) for k in moved - level.keys() if all(x in level for x in needs[k])}:
        level |= placed
    return {k: level.get(k) for k in needs}


def linked_levels(spark, needs):
    rows = [call(conv, turn, (f"c{turn}", "f", {"x": 1, "o": {str(k): f"$c{k[1]}" for k in ks}})) for (conv, turn), ks in needs.items()]
    return {(r.conv_id, r.turn): r.level for r in link(spark, rows).values()}


def test_levels_equal_their_definition(spark):
    import random

    r, needs = random.Random(9), {}
    for conv in range(40):  # from chains to calls that need several, with and without cycles
        n, forward, several = r.randrange(2, 20), r.choice([0, 0.05, 0.3, 1]), r.choice([1, 1, 2, 3])
        for turn in range(n):
            others = [k for k in range(n) if k != turn and (k < turn or r.random() < forward)]
            needs[conv, turn] = [(conv, k) for k in r.sample(others, min(len(others), r.randrange(several + 1)))]
    for conv, order in ((50, list(range(1, 10))), (51, r.sample(range(1, 10), 9))):  # calls that need the two before them in some order
        for k, turn in enumerate(order):
            needs[conv, turn] = [(conv, x) for x in order[max(0, k - 2) : k]]
        needs[conv, order[0]] = [(conv, 99)]
        needs[conv, 99] = []
    want = plain_levels(needs)
    assert linked_levels(spark, needs) == want
    assert None in want.values() and max(x or 0 for x in want.values()) >= 9


def test_a_long_chain_behind_a_later_call_takes_few_tables(spark, monkeypatch):
    used = []

    class Counted(chat_tools.Scratch):
        def __init__(self, *a):
            super().__init__(*a)
            used.append(self)

    monkeypatch.setattr(chat_tools, "Scratch", Counted)
    for n in (24, 400):
        needs = {(1, k): [(1, k - 1)] for k in range(2, n + 1)} | {(1, 1): [(1, 9000)], (1, 9000): []}
        assert linked_levels(spark, needs) == plain_levels(needs)
    assert used[0].n <= used[1].n <= used[0].n + 5


def test_order_is_topological_and_cycles_are_told(spark):
    import random

    r, rows, needs = random.Random(4), [], {}
    for conv in range(6):
        for turn in range(25):
            mine = [k for k in r.sample(range(25), r.randrange(3)) if k < turn or r.random() < 0.25]
            needs[conv, turn] = mine
            rows.append(call(conv, turn, (f"c{turn}", "f", {"x": 1, "o": {str(k): f"$c{k}" for k in mine}})))
    got = link(spark, rows)
    placed, todo = set(), True  # what can be placed at all, by brute force
    while todo:
        todo = {k for k, ks in needs.items() if k not in placed and all((k[0], x) in placed for x in ks)}
        placed |= todo
    assert {(r.conv_id, r.turn) for r in got.values() if r.status != "cycle"} == placed and len(placed) < len(needs)
    for conv, turn in placed:
        for k in needs[conv, turn]:
            before, own = got[conv, f"c{k}", k], got[conv, f"c{turn}", turn]
            assert (before.level, before.turn) < (own.level, own.turn)
    assert max(r.level or 0 for r in got.values()) > 1


def test_null_and_empty_conversations_and_identifiers_that_restart(spark):
    fields = FIELDS.replace("conv_id long", "conv_id string")
    rows = [call(None, 1, ("a", "f", {"x": 1})), call("", 1, ("a", "f", {"x": 1})), result("", 2, "a", "one"), call("", 3, ("a", "f", {"x": 2})), result("", 4, "a", "two"), result("", 5, "a", "three"), call("", 6, (None, "f", {"x": 1})), result("", 7, None, "lost")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], fields)
    got = sorted(((r.conv_id, r.turn, r.call_id, r.status, json.loads(r.json)["result"], r.errors) for r in chat_tools.link_tool_calls(df, SCHEMAS).collect()), key=str)
    assert got == sorted([(None, 1, "a", "unanswered", None, []), ("", 1, "a", "linked", "one", []), ("", 3, "a", "linked", "two", ["id:repeated"]), ("", 5, "a", "orphan", "three", None), ("", 6, None, "unanswered", None, ["id:missing"]), ("", 7, None, "orphan", "lost", None)], key=str)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([call(1, 1, ("a", "f", {"x": 1}))], "conv_id long, turn long, role string, content string, tool_calls string, tool_call_id string")
    plan = chat_tools.link_tool_calls(df, SCHEMAS)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and not re.search("Python|Pandas|ArrowEval|MapIn", plan)
