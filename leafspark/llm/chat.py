"""Chat formatting with tool-call linking.

Messages become nodes: tool calls, their results, and plain messages. A message whose text is a JSON object
with ``tool_calls`` carries one call per entry (``id``, ``name``, ``arguments``, optional ``depends_on``
naming other calls of the conversation); one with ``tool_call_id`` is a result. In a plain dialogue every
turn of a caller role is a call ``turn-<n>`` of the function ``reply``, and the answering role's next turn is
its result.

Calls and results are joined by (conversation, identifier) with a hash join; arguments are validated against
the function's schema; nodes are put in topological order; every node is serialised as canonical JSON (keys
sorted, no blanks, integral numbers without a fraction, no NaN).

Order: a node's ``order_turn`` is the largest turn among itself and all it depends on, its ``level`` the
longest chain of dependencies before it. Sorting a conversation by (order_turn, level, turn, call_id) puts
every node after what it depends on and otherwise keeps the given order. The calls of a conversation with up to
``MOST_EDGES`` dependencies, which are counted first, are ordered in one task. Longer ones are ordered in rounds
over the dependency edges, one round per level, each over keys (conversation, identifier), so that neither a long
conversation nor a hot one meets in one task; a round writes the calls of its level and looks at those only that
wait for them. Both give the same.

Edge cases: a null text is the empty string; text that looks like JSON and is not is a plain message.
Several calls with one identifier: the one of the smallest (turn, JSON) is linked, the others have the status
``duplicate``; repeated rows likewise. A result without a call is ``orphan``, a call without a result
``unanswered``. Nodes on a cycle have the status ``cycle`` and a null level. Null roles are kept as null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import written

#: Schemas of the functions; ``reply`` is the function that a plain dialogue calls.
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["text"],
        "properties": {"text": {"type": "string", "minLength": 1}},
        "additionalProperties": False,
    }
}

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int,
}


def plain(value):
    """The value with integral floats as integers; NaN and infinities are refused."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema`` (type, enum, required, properties, items, lengths, bounds)."""
    out = []
    kinds = schema.get("type")
    if kinds:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = any(
            isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool) or k not in ("number", "integer"))
            for k in kinds
        )
        if not fits:
            return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list):
        out += [x for i, v in enumerate(value) for x in faults(v, schema.get("items", {}), f"{at}[{i}]")]
    size = len(value) if isinstance(value, (str, list)) else None
    for key, low in (("minLength", True), ("minItems", True), ("maxLength", False), ("maxItems", False)):
        if key in schema and size is not None and (size < schema[key] if low else size > schema[key]):
            out.append(f"{at}: {key}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: maximum")
    return out


def _nodes(conv, turn, role, text: str, schemas: dict, callers: set, answerers: set) -> Iterator[tuple]:
    """(conv_id, turn, role, kind, call_id, name, valid, error, depends_on, json) of each node of a message."""
    body = None
    if text[:1] == "{":
        try:
            body = json.loads(text)
            canonical(body)
        except (ValueError, RecursionError):
            body = None
    if isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
        for k, call in enumerate(body["tool_calls"]):
            call = call if isinstance(call, dict) else {}
            own, name = str(call.get("id", f"turn-{turn}-{k}")), str(call.get("name", ""))
            arguments = call.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = json.loads(arguments)
                    canonical(arguments)
                except (ValueError, RecursionError):
                    pass
            schema = schemas.get(name)
            wrong = ["$: unknown function"] if schema is None else faults(arguments, schema)
            made = canonical({"arguments": arguments, "id": own, "name": name, "role": role})
            needs = call.get("depends_on") if isinstance(call.get("depends_on"), list) else []
            yield conv, turn, role, "call", own, name, not wrong, "; ".join(wrong), sorted({str(x) for x in needs}), made
    elif isinstance(body, dict) and "tool_call_id" in body:
        own = str(body["tool_call_id"])
        made = canonical({"content": body.get("content"), "role": role, "tool_call_id": own})
        yield conv, turn, role, "result", own, None, True, "", [], made
    elif role in callers:
        wrong = faults({"text": text}, schemas["reply"]) if "reply" in schemas else []
        made = canonical({"arguments": {"text": text}, "id": f"turn-{turn}", "name": "reply", "role": role})
        yield conv, turn, role, "call", f"turn-{turn}", "reply", not wrong, "; ".join(wrong), [], made
    elif role in answerers and turn is not None:
        made = canonical({"content": text, "role": role, "tool_call_id": f"turn-{turn - 1}"})
        yield conv, turn, role, "result", f"turn-{turn - 1}", None, True, "", [], made
    else:
        yield conv, turn, role, "message", None, None, True, "", [], canonical({"content": text, "role": role})


def nodes(messages: DataFrame, schemas: dict | None = None, callers=("user",), answerers=("assistant",)) -> DataFrame:
    """One row per call, result and plain message of ``messages`` (conv_id, turn, role, text)."""
    schemas, callers, answerers = SCHEMAS if schemas is None else schemas, set(callers), set(answerers)
    src = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    text = T.StringType()
    schema = T.StructType(
        [
            src.schema["conv_id"],
            T.StructField("turn", T.LongType()),
            *[T.StructField(c, text) for c in ("role", "kind", "call_id", "name")],
            T.StructField("valid", T.BooleanType()),
            T.StructField("error", text),
            T.StructField("depends_on", T.ArrayType(text)),
            T.StructField("json", text),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                node
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)
                for node in _nodes(*row, schemas, callers, answerers)
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return src.mapInArrow(run, schema)


_KEY = ["conv_id", "call_id"]


#: Most dependencies of a conversation that one task orders.
MOST_EDGES = 100_000


def _ordered(rows: pa.Table) -> pa.Table:
    """call_id, order_turn, level of one conversation's calls that depend on others and are on or behind no cycle."""
    columns = [rows.column(c).to_pylist() for c in ("needs", "needs_turn", "call_id", "turn")]
    waits, after, own, place = {}, {}, {}, {}
    for needs, needs_turn, call, turn in zip(*columns, strict=True):
        waits[call] = waits.get(call, 0) + 1
        after.setdefault(needs, []).append(call)
        own[call], place[needs] = turn, (needs_turn, 0)
    place = {c: p for c, p in place.items() if c not in waits}
    ready, out = list(place), []
    for call in ready:  # grows on the way
        turn, level = place[call]
        for nxt in after.get(call, ()):
            before = place.get(nxt, (own[nxt], 0))
            later = [t for t in (before[0], turn) if t is not None]
            place[nxt] = (max(later, default=None), max(before[1], level + 1))
            waits[nxt] -= 1
            if not waits[nxt]:
                ready.append(nxt)
                out.append(nxt)
    conv = rows.column("conv_id")
    return pa.table(
        {
            "conv_id": pa.array([conv[0].as_py()] * len(out), conv.type),
            "call_id": pa.array(out, pa.string()),
            "order_turn": pa.array([place[c][0] for c in out], pa.int64()),
            "level": pa.array([place[c][1] for c in out], pa.int32()),
        }
    )


def levels(calls: DataFrame, edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """conv_id, call_id, order_turn, level of the calls that are on or behind no cycle.

    ``calls``: conv_id, call_id, turn, one row per key. ``edges``: conv_id, needs, call_id; both ends exist.
    """
    edges = written(edges)
    first = calls.join(edges.select(*_KEY).distinct(), _KEY, "left_anti")
    first = written(first.select(*_KEY, F.col("turn").alias("order_turn"), F.lit(0).alias("level")))
    sizes = written(edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("m")))
    if not sizes.take(1):
        return first
    few = edges.join(sizes.where(F.col("m") <= most).select("conv_id"), "conv_id", "left_semi")
    few = few.join(calls, _KEY).join(calls.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("needs_turn")), ["conv_id", "needs"])
    kind = calls.schema["conv_id"].dataType.simpleString()
    done = [first, few.groupBy("conv_id").applyInArrow(_ordered, f"conv_id {kind}, call_id string, order_turn bigint, level int")]
    long = sizes.where(F.col("m") > most).select("conv_id")
    if long.take(1):
        edges = written(edges.join(long, "conv_id", "left_semi"))
        known = [first.join(long, "conv_id", "left_semi")]
        while True:
            waiting = edges.join(known[-1].select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi")
            asked = edges.join(waiting.select(*_KEY).distinct(), _KEY, "left_semi")
            placed = reduce(DataFrame.unionByName, known).withColumnRenamed("call_id", "needs")
            ready = (
                asked.join(placed, ["conv_id", "needs"], "left")
                .groupBy(*_KEY)
                .agg(F.count("level").alias("n"), F.count(F.lit(1)).alias("all"), F.max("order_turn").alias("after"), (F.max("level") + 1).alias("level"))
                .where("n = all")
            )
            fresh = ready.join(calls, _KEY).select(*_KEY, F.greatest("turn", "after").alias("order_turn"), "level")
            fresh = written(fresh)
            if not fresh.take(1):
                break
            known.append(fresh)
        done += known[1:]
    return reduce(DataFrame.unionByName, done)


def format_chat(messages: DataFrame, schemas: dict | None = None, **roles) -> DataFrame:
    """The nodes of ``messages`` with status, linked_turn, order_turn and level.

    ``linked_turn`` is the turn of a call's first result, or of a result's call.
    """
    rows = written(nodes(messages, schemas, **roles))
    calls, results = rows.where("kind = 'call'"), rows.where("kind = 'result'")
    least = F.min(F.struct("turn", "json"))
    heads = calls.groupBy(*_KEY).agg(least.alias("head"))
    answers = results.groupBy(*_KEY).agg(F.min("turn").alias("answer_turn"))
    heads = written(heads.join(answers.hint("shuffle_hash"), _KEY, "left").select(*_KEY, F.col("head.turn").alias("turn"), "head", "answer_turn"))
    given = calls.where(F.size("depends_on") > 0).select("conv_id", F.explode("depends_on").alias("needs"), "call_id")
    known = heads.select("conv_id", F.col("call_id").alias("needs"))
    placed = levels(heads.select(*_KEY, "turn"), given.distinct().join(known, ["conv_id", "needs"], "left_semi"))
    known_calls = heads.withColumnRenamed("turn", "call_turn").join(placed, _KEY, "left")
    linked = rows.join(known_calls.hint("shuffle_hash"), _KEY, "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    known_call = F.col("head").isNotNull()
    status = (
        F.when(is_call & (F.struct("turn", "json") != F.col("head")), "duplicate")
        .when((is_call | is_result) & known_call & F.col("level").isNull(), "cycle")
        .when(is_call & F.col("answer_turn").isNull(), "unanswered")
        .when(is_result & ~known_call, "orphan")
        .when(is_call | is_result, "linked")
        .otherwise("message")
    )
    return linked.select(
        "conv_id", "turn", "role", "kind", "call_id", "name", "valid", "error", "json",
        status.alias("status"),
        F.when(is_call, F.col("answer_turn")).when(is_result, F.col("call_turn")).alias("linked_turn"),
        F.when(known_call, F.greatest("turn", "order_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(known_call, F.col("level") + is_result.cast("int")).otherwise(F.lit(0)).alias("level"),
    )
