"""Chat formatting: tool calls linked with their results, in an order that respects them, as canonical JSON.

A message is a row (conv_id, turn, role, text). A text that is a JSON object may carry ``tool_calls`` (id, function
name, arguments as an object or as a JSON string, optional ``depends_on`` ids) or, for role ``tool``, a
``tool_call_id`` with its content; any other text is plain content.

Calls and results meet in a hash join on (conversation, identifier). A result belongs to the last call with its
identifier at or before its turn, else to the first one after it. The messages of a conversation are ordered
topologically: a result follows its call, and a call follows the calls that it depends on and the last of their
results, by ``depends_on`` or by a string ``$ref:<id>`` in its arguments. Messages that nothing forces keep their
turns.

Where every message already stands behind what it depends on, the turns are the order and nothing more is done.
Otherwise the connected components of the dependencies that hold a misplaced message are ordered, each in one Arrow
group by Kahn's algorithm. A group holds the edges of one component, never a whole conversation. Places are global row
numbers less the first of the conversation.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import byte_postings, common

_REF = re.compile(r"\$ref:(\S+)")
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

_CALL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("needs", T.ArrayType(T.StringType())),
    ]
)
_MESSAGE = T.StructType(
    [T.StructField("json", T.StringType()), T.StructField("calls", T.ArrayType(_CALL)), T.StructField("answers", T.StringType())]
)


#: The turn that stands for a null one inside, before all others.
_FIRST_TURN = -(1 << 63)
#: Turns of one identifier that one window sorts together.
TURNS = 1024
_LONE = re.compile("[\ud800-\udfff]")


def clean(text: str | None) -> str | None:
    """``text`` with lone surrogates, which no UTF-8 can hold, spelled as their escapes."""
    return text if text is None or text.isascii() else _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spare space and no escapes but the necessary ones."""
    return clean(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(digits: str) -> float:
    if math.isinf(number := float(digits)):
        raise ValueError("number out of range")
    return number


def _refused(name: str):
    raise ValueError(f"{name} is not JSON")


def loaded(text: str):
    """The value of strict JSON; ValueError for NaN, Infinity, numbers out of range and what is nested too deeply."""
    try:
        value = json.loads(text, parse_constant=_refused, parse_float=_finite)
        canonical(value)  # what can't be written again is refused here
        return value
    except RecursionError:
        raise ValueError("nested too deeply") from None


def problem_of(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which ``value`` breaks ``schema`` (type, enum, bounds, required, properties, items), or None."""
    kind = schema.get("type")
    if kind == "integer":
        fits = isinstance(value, int) and not isinstance(value, bool)
    elif kind == "number":
        fits = isinstance(value, (int, float)) and not isinstance(value, bool)
    else:
        fits = kind is None or isinstance(value, _KINDS[kind])
    if not fits:
        return f"{at}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of bounds"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(schema.get("required", [])):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := problem_of(value[name], known[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := problem_of(item, schema["items"], f"{at}[{i}]"):
                return found
    return None


def _strings(value):
    """All strings in a value, by a list instead of calls, as values may be deep."""
    left = [value]
    while left:
        value = left.pop()
        if isinstance(value, str):
            yield value
        elif isinstance(value, dict):
            left += value.values()
        elif isinstance(value, list):
            left += value


def _call(raw, schemas: dict[str, dict]) -> tuple[dict, dict]:
    """(call for the canonical message, its id, problem and needs)."""
    raw = raw if isinstance(raw, dict) else {}
    function = raw.get("function") if isinstance(raw.get("function"), dict) else {}
    name, given = function.get("name"), function.get("arguments")
    problem, arguments = None, given
    if isinstance(given, str):
        try:
            arguments = loaded(given)
        except ValueError:
            problem = "$: not JSON"
    identifier = raw.get("id") if isinstance(raw.get("id"), str) else None
    if problem is None:
        problem = problem_of(arguments, schemas[name]) if isinstance(name, str) and name in schemas else "unknown function"
    if identifier is None:
        problem = "no id"
    named = raw.get("depends_on") if isinstance(raw.get("depends_on"), list) else []
    needs = {x for x in named if isinstance(x, str)} | {m for s in _strings(arguments) for m in _REF.findall(s)}
    message = {"id": identifier, "function": {"name": name, "arguments": arguments}, "type": "function"}
    return message, {"id": clean(identifier), "problem": clean(problem), "needs": sorted(map(clean, needs))}


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> dict:
    """json, calls and answers of one message; text that isn't a JSON object of either form is plain content."""
    body = None
    if text and text.lstrip()[:1] == "{":
        try:
            body = loaded(text)
        except ValueError:
            body = None
    message, calls, answers = {"content": text, "role": role}, [], None
    if isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
        pairs = [_call(c, schemas) for c in body["tool_calls"]]
        calls = [c for _, c in pairs]
        message = {"content": body.get("content"), "role": role, "tool_calls": [m for m, _ in pairs]}
    elif isinstance(body, dict) and role == "tool" and isinstance(body.get("tool_call_id"), str):
        answers = body["tool_call_id"]
        message = {"content": body.get("content"), "role": role, "tool_call_id": answers}
    try:
        return {"json": canonical(message), "calls": calls, "answers": clean(answers)}
    except RecursionError:  # arguments in a string, deep in themselves, under the levels of the message
        return {"json": canonical({"content": text, "role": role}), "calls": [], "answers": None}


def _parser(schemas: dict[str, dict]):
    kind = pa.struct(
        [
            ("json", pa.string()),
            ("calls", pa.list_(pa.struct([("id", pa.string()), ("problem", pa.string()), ("needs", pa.list_(pa.string()))]))),
            ("answers", pa.string()),
        ]
    )

    def run(roles: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([parse(r, t, schemas) for r, t in zip(roles.to_pylist(), texts.to_pylist())], kind)

    return F.arrow_udf(run, _MESSAGE)


_NODE = ["conv_id", "t", "h"]


def _as_of(asked: DataFrame, calls: DataFrame) -> DataFrame:
    """``asked`` (conv_id, id, t), distinct, with (a_t, a_h): the last call with that id at or before t, else the first after.

    Calls of one turn count as one, the last. Turns are dealt into stretches, so a window sorts a stretch of an
    identifier and another one its stretches; an identifier that all calls of a long conversation use is split.
    """
    stretch = F.floor(F.col("t") / TURNS).alias("s")
    at = F.struct("t", "h")
    called = calls.groupBy("conv_id", "id", "t").agg(F.max("h").alias("h")).select("conv_id", "id", "t", at.alias("call"), F.lit(0).alias("kind"))
    points = called.unionByName(asked.select("conv_id", "id", "t", F.lit(None).cast("struct<t:bigint,h:bigint>").alias("call"), F.lit(1).alias("kind")))
    points = common.stored(points.select("*", stretch), "points")
    edges = points.groupBy("conv_id", "id", "s").agg(F.min("call").alias("_low"), F.max("call").alias("_high"))
    over = Window.partitionBy("conv_id", "id").orderBy("s")
    near = edges.select(
        "conv_id", "id", "s",
        F.last("_high", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_low", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    w = Window.partitionBy("conv_id", "id", "s").orderBy("t", "kind")
    placed = points.select(
        "conv_id", "id", "s", "t", "kind",
        F.last("call", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_before"),
        F.first("call", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    call = F.coalesce("_before", "_earlier", "_after", "_later")
    found = placed.where("kind = 1").join(near, ["conv_id", "id", "s"]).select("conv_id", "id", "t", call.alias("_call")).where(F.col("_call").isNotNull())
    return found.select("conv_id", "id", "t", F.col("_call.t").alias("a_t"), F.col("_call.h").alias("a_h"))


def _edges(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between messages, results with their calls); both stored."""
    calls = marked.select(*_NODE, F.explode("m.calls").alias("c")).select(*_NODE, F.col("c.id").alias("id"), F.col("c.needs").alias("needs"))
    calls = common.stored(calls.where(F.col("id").isNotNull() | (F.size("needs") > 0)).distinct(), "calls")
    named = calls.where(F.col("id").isNotNull())
    results = common.stored(marked.where(F.col("m.answers").isNotNull()).select(*_NODE, F.col("m.answers").alias("id")).distinct(), "results")
    linked = results.join(_as_of(results.select("conv_id", "id", "t").distinct(), named), ["conv_id", "id", "t"])
    linked = common.stored(linked.select("conv_id", "id", "a_t", "a_h", "t", "h"), "linked")
    needs = common.stored(calls.select(*_NODE, F.explode("needs").alias("id")).distinct(), "needs")
    after_call = needs.join(_as_of(needs.select("conv_id", "id", "t").distinct(), named), ["conv_id", "id", "t"])
    after_call = common.stored(after_call.select("conv_id", "id", "a_t", "a_h", "t", "h"), "after-call")
    answered = linked.groupBy("conv_id", "id", "a_t", "a_h").agg(F.max(F.struct("t", "h")).alias("_last"))
    after_result = after_call.join(answered, ["conv_id", "id", "a_t", "a_h"]).select(
        "conv_id", F.col("_last.t").alias("a_t"), F.col("_last.h").alias("a_h"), "t", "h"
    )
    columns = ["conv_id", "a_t", "a_h", "t", "h"]
    edges = linked.select(*columns).unionByName(after_call.select(*columns)).unionByName(after_result)
    return common.stored(edges.where("a_t <> t or a_h <> h").distinct(), "edges"), linked


def ordered_nodes(edges: list[tuple]) -> dict[tuple, tuple | None]:
    """Kahn's algorithm on edges ((conv, t, h), (conv, t, h)): (effective turn, depth) of each node, None on or behind a cycle.

    The key of a message is the larger of (its turn, 0) and, over its predecessors, (their turn, their depth + 1).
    """
    after, waits = defaultdict(list), defaultdict(int)
    for a, b in edges:
        after[a].append(b)
        waits[b] += 1
        waits[a] += 0
    keys = {n: (n[1], 0) for n in waits}
    ready, settled = [n for n, count in waits.items() if not count], {}
    while ready:
        node = ready.pop()
        turn, depth = settled[node] = keys[node]
        for nxt in after[node]:
            keys[nxt] = max(keys[nxt], (turn, depth + 1))
            waits[nxt] -= 1
            if not waits[nxt]:
                ready.append(nxt)
    return {n: settled.get(n) for n in waits}


def _keys(edges: DataFrame) -> DataFrame:
    """(conv_id, t, h, eff, depth, cyclic) of the messages in components with a misplaced message."""
    node = lambda t, h: F.xxhash64("conv_id", t, h)
    misplaced = "a_t >= t"
    concerned = edges.where(misplaced).select("conv_id").distinct()
    edges = common.stored(edges.join(concerned, "conv_id", "left_semi").withColumns({"u": node("a_t", "a_h"), "v": node("t", "h")}), "concerned")
    schema = edges.select("conv_id", "t", "h", F.col("t").alias("eff"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("cyclic")).schema
    if edges.isEmpty():
        return edges.sparkSession.createDataFrame([], schema)
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v")
    roots = byte_postings.components(pairs)
    rooted = common.stored(edges.join(roots, F.col("v") == F.col("node"), "left").select("conv_id", "a_t", "a_h", "t", "h", F.coalesce("root", "v").alias("root")), "rooted")
    wanted = rooted.where(misplaced).select("root").distinct()

    def run(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("conv_id", "a_t", "a_h", "t", "h")))
        found = ordered_nodes([((c, at, ah), (c, t, h)) for c, at, ah, t, h in rows])
        made = [(c, t, h, *(key or (t, 0)), key is None) for (c, t, h), key in found.items()]
        kinds = [table.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*made), kinds)], names=schema.names)

    return common.stored(rooted.join(wanted, "root", "left_semi").groupBy("root").applyInArrow(run, schema), "keys")


def linked_messages(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message: conv_id, turn, role, position, n_calls, n_linked, n_valid, call_id, linked, cyclic, message_json.

    position counts from 0 within the conversation. n_linked are the calls with a result, n_valid those whose
    arguments satisfy the schema of a known function. linked tells of a result whether it has a call. cyclic marks
    messages on or behind a cycle of dependencies; they keep their turns. Null and empty texts are plain content, and
    so is what is no strict JSON (NaN, Infinity, numbers out of range, nesting too deep for the parser), however long;
    in canonical JSON lone surrogates keep their escapes. Null roles stay null; null turns come first and link like
    any other; messages of a null conv_id form one conversation without links. Equal turns go by role, then by a hash
    of the message. Repeated rows keep a place each and share their links. Columns besides the four are left out,
    whatever their names; an empty table gives an empty one.
    """
    common.small_batches(messages.sparkSession)
    marked = messages.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST_TURN)).alias("t"),
        F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("h"), _parser(schemas)("role", "text").alias("m"),
    )
    marked = common.stored(marked, "messages")
    edges, linked = _edges(marked)
    keys = _keys(edges)
    results = linked.select(*_NODE).distinct().withColumn("_linked", F.lit(True))
    # the tables of tool messages are small where few messages are, and never hold plain ones
    rows = marked.join(keys, _NODE, "left").join(results, _NODE, "left").join(_answered_calls(marked, linked), _NODE, "left")
    placed = rows.select(
        "conv_id", "turn", "t", "role", "h",
        F.coalesce("eff", "t").alias("eff"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size("m.calls").cast("long").alias("n_calls"),
        F.coalesce("_n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.size(F.filter("m.calls", lambda c: c["problem"].isNull())).cast("long").alias("n_valid"),
        F.col("m.answers").alias("call_id"),
        F.when(F.col("m.answers").isNotNull(), F.coalesce("_linked", F.lit(False))).alias("linked"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.col("m.json").alias("message_json"),
    )
    placed = common.stored(placed, "placed")
    numbered, _ = common.numbered(placed, ["conv_id", "eff", "depth", "t", "role", "h"], placed.count(), "row_no")
    numbered = common.stored(numbered, "numbered")
    first = common.stored(numbered.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("row_no").alias("_first_row")), "first-rows")
    out = numbered.join(common.maybe_broadcast(first, first.count()), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.select(
        "conv_id", "turn", "role", (F.col("row_no") - F.col("_first_row")).alias("position"),
        "n_calls", "n_linked", "n_valid", "call_id", "linked", "cyclic", "message_json",
    )


def _answered_calls(marked: DataFrame, linked: DataFrame) -> DataFrame:
    """(message, number of its calls that have a result)."""
    calls = marked.select(*_NODE, F.explode("m.calls").alias("c")).select(*_NODE, F.col("c.id").alias("id")).distinct()
    owners = linked.select("conv_id", "id", F.col("a_t").alias("t"), F.col("a_h").alias("h")).distinct()
    return calls.join(owners, [*_NODE, "id"], "left_semi").groupBy(*_NODE).agg(F.count("*").alias("_n_linked"))
