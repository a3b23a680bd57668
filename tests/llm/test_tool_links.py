import json
import random

from quirefold.llm import queries, tool_links as L

SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}, "of": {"type": "string"}}}}
DDL = "conv_id long, turn long, role string, text string"


def _call(*calls):
    return json.dumps({"content": None, "tool_calls": [{"id": i, "depends_on": d, "function": {"name": n, "arguments": a}} for i, n, a, d in calls]})


def _result(identifier, content="ok"):
    return json.dumps({"tool_call_id": identifier, "content": content})


def _rows(spark, rows):
    return L.linked_messages(spark.createDataFrame(rows, DDL), SCHEMAS).collect()


def test_calls_results_order_and_validation(spark):
    rows = [
        (1, 0, "user", "go"),
        (1, 1, "tool", _result("a")),  # stands before its call
        (1, 2, "assistant", _call(("a", "f", {"x": 1}, []), ("b", "f", '{"x": "one"}', []))),
        (1, 3, "assistant", _call(("c", "g", {}, ["a"]), ("d", "f", {"x": 2, "of": "$ref:b"}, []))),
        (1, 4, "tool", _result("b")),
        (1, 5, "tool", _result("zz")),
        (1, 6, "user", "end"),
    ]
    got = {r["turn"]: r for r in _rows(spark, rows)}
    order = [t for t, _ in sorted(got.items(), key=lambda x: x[1]["position"])]
    assert order == [0, 2, 1, 4, 3, 5, 6]
    assert [r["position"] for r in sorted(got.values(), key=lambda r: r["position"])] == list(range(7))
    assert (got[2]["n_calls"], got[2]["n_linked"], got[2]["n_valid"]) == (2, 2, 1)
    assert (got[3]["n_calls"], got[3]["n_linked"], got[3]["n_valid"]) == (2, 0, 1)
    assert got[1]["linked"] and not got[5]["linked"] and got[0]["linked"] is None
    assert got[2]["message_json"].startswith('{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":{"x":1},"name":"f"}')


def test_random_conversations_are_in_topological_order(spark):
    rng = random.Random(4)
    rows, calls = [], {}
    for conv in range(6):
        ids = [f"k{i}" for i in range(8)]
        after = {x: rng.sample(ids[:i], min(i, rng.randrange(3))) for i, x in enumerate(ids)}
        turns = list(range(20))
        rng.shuffle(turns)
        for x in ids:
            call_turn, result_turn = turns.pop(), turns.pop()
            calls[conv, x] = (call_turn, result_turn, after[x])
            rows += [(conv, call_turn, "assistant", _call((x, "f", {"x": 1}, after[x]))), (conv, result_turn, "tool", _result(x))]
        rows += [(conv, t, "user", "plain") for t in turns]
    place = {(r["conv_id"], r["turn"]): r["position"] for r in _rows(spark, rows)}
    for (conv, x), (call, result, after) in calls.items():
        assert place[conv, call] < place[conv, result]
        for y in after:
            assert place[conv, calls[conv, y][1]] < place[conv, call]


def test_a_cycle_keeps_its_turns(spark):
    rows = [(1, 1, "assistant", _call(("a", "f", {"x": 1}, ["b"]))), (1, 2, "assistant", _call(("b", "f", {"x": 1}, ["a"]))), (1, 3, "user", "x")]
    got = sorted(_rows(spark, rows), key=lambda r: r["position"])
    assert [(r["turn"], r["cyclic"]) for r in got] == [(1, True), (2, True), (3, False)]


def _plain(rows):
    """position, n_linked, linked and cyclic of distinct (turn, role, text) rows of one conversation, without Spark."""
    parsed = [(t, r, x, L.parse(r, x, SCHEMAS)) for t, r, x in rows]
    at = lambda i: (parsed[i][0] is not None, parsed[i][0] or 0)  # noqa: E731  null turns first
    owners = {}
    for i, (*_, m) in enumerate(parsed):
        for c in m["calls"]:
            owners.setdefault(c["id"], []).append(i)

    def call_for(identifier, i):
        calls = sorted(owners.get(identifier, []), key=at)
        return next((c for c in reversed(calls) if at(c) <= at(i)), calls[0] if calls else None)

    before = {i: set() for i in range(len(parsed))}
    answer = {i: call_for(m["answers"], i) for i, (*_, m) in enumerate(parsed) if m["answers"] is not None}
    for i, (*_, m) in enumerate(parsed):
        if answer.get(i) is not None:
            before[i].add(answer[i])
        for c in m["calls"]:
            for need in c["needs"]:
                if (owner := call_for(need, i)) is not None:
                    before[i].add(owner)
                    replies = [r for r, o in answer.items() if o == owner and parsed[r][3]["answers"] == need]
                    before[i] |= set(sorted(replies, key=at)[-1:])
        before[i].discard(i)
    keys, left = {}, set(before)
    while ready := {i for i in left if not before[i] & left}:
        for i in ready:
            keys[i] = max([(at(i), 0), *((keys[b][0], keys[b][1] + 1) for b in before[i])])
        left -= ready
    for i in left:
        keys[i] = (at(i), 0)
    order = sorted(before, key=lambda i: (keys[i], at(i)))
    linked = [{c["id"] for c in parsed[i][3]["calls"]} & {parsed[r][3]["answers"] for r, o in answer.items() if o == i} for i in before]
    return [(parsed[i][0], order.index(i), len(linked[i]), (answer[i] is not None) if i in answer else None, i in left) for i in before]


def _got(spark, rows):
    return [(r["turn"], r["position"], r["n_linked"], r["linked"], r["cyclic"]) for r in _rows(spark, [(1, *row) for row in rows])]


def test_random_conversations_equal_the_plain_version(spark):
    rng = random.Random(7)
    for _ in range(3):
        turns = [None, *rng.sample(range(6000), 39)]
        rng.shuffle(turns)
        rows = []
        for t in turns:
            if rng.random() < 0.5:
                made = [(f"k{rng.randrange(6)}", "f", {"x": 1}, [f"k{rng.randrange(6)}"] if rng.random() < 0.3 else []) for _ in range(rng.randrange(1, 3))]
                rows.append((t, "assistant", _call(*made)))
            else:
                rows.append((t, "tool", _result(f"k{rng.randrange(7)}", rng.random())))
        assert sorted(_got(spark, rows), key=repr) == sorted(_plain(rows), key=repr)


def test_an_identifier_used_again_belongs_to_the_nearest_call_before(spark):
    rows = [(t, "assistant", _call(("call_0", "f", {"x": t}, []))) if t % 2 == 0 else (t, "tool", _result("call_0")) for t in range(3000)]
    got = sorted(_got(spark, rows))
    assert [g[1] for g in got] == list(range(3000))
    assert all(g[2:] == ((1, None, False) if g[0] % 2 == 0 else (0, True, False)) for g in got)


def test_null_turns_link_like_others(spark):
    rows = [(None, "assistant", _call(("a", "f", {"x": 1}, []))), (None, "tool", _result("a")), (3, "user", "x")]
    got = sorted(_rows(spark, [(1, *r) for r in rows]), key=lambda r: r["position"])
    assert [(r["role"], r["turn"], r["n_linked"], r["linked"]) for r in got] == [("assistant", None, 1, None), ("tool", None, 0, True), ("user", 3, 0, None)]


def test_long_chains_and_cycles_take_few_jobs(spark):
    n = 5000
    forward = [(1, i, "assistant", _call((f"k{i}", "f", {"x": 1}, [f"k{i - 1}"]))) for i in range(n)]
    backward = [(2, n - i, "assistant", _call((f"k{i}", "f", {"x": 1}, [f"k{i - 1}"]))) for i in range(n)]
    ring = [(3, i, "assistant", _call((f"k{i}", "f", {"x": 1}, [f"k{(i + 1) % 500}"]))) for i in range(500)]
    hostile = [(4, 0, "user", "plain"), (4, 1, "assistant", _call(("d", "f", "[" * 100_000, [])))]
    got = _rows(spark, forward + backward + ring + hostile)
    assert len(got) == 2 * n + 502
    place = {(r["conv_id"], r["turn"]): r["position"] for r in got}
    assert all(place[1, i] == i for i in range(n))
    assert all(place[2, n - i] == i for i in range(n))
    assert all(r["cyclic"] == (r["conv_id"] == 3) for r in got)


def test_hostile_json(spark):
    deep = "[" * 900 + "]" * 900
    texts = {
        1: _call(("a", "f", "[" * 100_000, [])),
        2: _call(("b", "f", deep, [])),
        3: '{"tool_calls": [{"id": "c\\ud800", "function": {"name": "f", "arguments": {"x": 1, "of": "\\udfff"}}}]}',
        4: '{"tool_calls": [{"id": "d", "function": {"name": "f", "arguments": {"x": NaN}}}]}',
        5: '{"tool_calls": [{"id": "e", "function": {"name": "f", "arguments": "{\\"x\\": 1e999}"}}]}',
        6: '{"tool_calls": ' + "[" * 50_000,
        7: '{"tool_call_id": "c\\ud800", "content": "\\udc00"}',
    }
    got = {r["turn"]: r for r in _rows(spark, [(1, t, "tool" if t == 7 else "assistant", x) for t, x in texts.items()])}
    assert len(got) == 7
    for r in got.values():
        json.loads(r["message_json"], parse_constant=lambda name: 1 / 0)
    assert (got[1]["n_calls"], got[1]["n_valid"]) == (1, 0)
    assert json.loads(got[4]["message_json"])["content"] == texts[4]
    assert json.loads(got[6]["message_json"])["content"] == texts[6]
    assert (got[5]["n_calls"], got[5]["n_valid"]) == (1, 0)
    assert (got[3]["n_valid"], got[3]["n_linked"], got[7]["linked"], got[7]["call_id"]) == (1, 1, True, "c\\ud800")


def test_long_texts_clashing_columns_and_empty_texts(spark):
    rows = [(1, 0, "user", "x " * 500_000, 1, "a"), (1, 1, "tool", _result("q", "y" * 300_000), 2, "b"), (1, 2, "user", "", 3, "c")]
    frame = spark.createDataFrame(rows, DDL + ", position int, h string")
    got = sorted(L.linked_messages(frame, SCHEMAS).collect(), key=lambda r: r["position"])
    assert [len(json.loads(r["message_json"])["content"]) for r in got] == [1_000_000, 300_000, 0]


def test_nulls_damage_repeats_and_empty_tables(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "tool", "{not json"), (1, 1, "user", "same"), (1, 1, "user", "same"), (1, 2, "assistant", '{"tool_calls": [{"id": 5}, 7]}')]
    got = _rows(spark, rows)
    assert len(got) == 6
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2, 3, 4]
    assert next(r for r in got if r["turn"] == 2)["n_valid"] == 0
    assert L.linked_messages(spark.createDataFrame([], DDL), SCHEMAS).collect() == []


def test_the_query_keeps_every_message(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    got = {(r["conv_id"], r["turn"]): r for r in queries.op6_tool_links(spark, sf_dir).collect()}
    assert len(got) == len(table)
    for r in table:
        assert json.loads(got[r["conv_id"], r["turn"]]["message_json"]) == {"role": r["role"], "content": r["text"]}
    for conv in {r["conv_id"] for r in table}:
        turns = sorted(r["turn"] for r in table if r["conv_id"] == conv)
        assert [got[conv, t]["position"] for t in turns] == list(range(len(turns)))


def test_schema_checks():
    schema = {"type": "array", "items": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "number", "maximum": 3, "enum": [1, 2.5, 9]}}}}
    assert L.problem_of([{"a": 1}, {"a": 2.5}], schema) is None
    assert L.problem_of([{"a": 9}], schema) == "$[0].a: out of bounds"
    assert L.problem_of([{"a": True}], schema) == "$[0].a: not of type number"
    assert L.problem_of([{}], schema) == "$[0].a: missing"
    assert L.problem_of([{"a": 1, "b": 2}], schema) == "$[0].b: not allowed"
    assert L.problem_of({}, schema) == "$: not of type array"
