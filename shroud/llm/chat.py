"""Operator 2: chat formatting with linked tool calls.

Calls and results are joined by (conversation, call id); the first call and the first result of an id (least turn,
then text) count, later ones are marked.  Arguments are validated against the tool's schema.  Messages are ordered
topologically: a message stands at its own turn, a result never before its call, and a call never before the results
that its arguments refer to by {"$result": "<call id>"}; references to a later or unknown call, and to itself, are
errors and do not order.  Every message becomes one line of canonical JSON (sorted keys, no blanks, code points as they
are), with its place as two sort keys, so that a conversation of any size is never gathered in one task.

Null conversations are kept as one conversation without name; null turns stand first; null texts, names and contents
are "".  Arguments that are null or no JSON object fail validation; so do NaN and infinite numbers, which JSON does not have,
and what nests too deep to be read.  Lone surrogates stay as escapes.  An empty table gives no messages.  Results without call and calls without result
stay, with a status that says so.  Repeated rows stay, one of them linked.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SURROGATE = re.compile("[\ud800-\udfff]")
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def _no_number(word: str) -> None:
    raise ValueError(f"{word} is no JSON")


def read_arguments(raw: str | None) -> tuple[Any, str | None, set[str], str | None]:
    """(value, canonical text, references, error) of the arguments of a call."""
    try:
        value = json.loads(raw or "", parse_constant=_no_number)
        return value, canonical(value), references(value), None if isinstance(value, dict) else "no JSON object"
    except ValueError:
        return None, None, set(), "no JSON object"
    except RecursionError:
        return None, None, set(), "nested too deep"


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks the schema: type, enum, required, properties, additionalProperties, items, bounds."""
    if at != "$" and isinstance(value, dict) and set(value) == {"$result"}:
        return []  # to be filled from another call
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of bounds")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in properties:
                out += violations(value[k], properties[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{k}]")
    return out


def references(value: Any) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"}:
            return {str(value["$result"])}
        return set().union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def check_calls(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` (conv_id, turn, call_id, name, arguments) with ``canonical`` arguments, ``error`` and ``refers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors, refers = [], [], []
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist()):
                value, text, needs, wrong = read_arguments(raw)
                schema = schemas.get(name or "")
                found = ["unknown tool"] if schema is None else [wrong] if wrong else violations(value, schema)
                texts.append(text)
                errors.append(SURROGATE.sub("?", "; ".join(found)) or None)
                refers.append(sorted(SURROGATE.sub("?", r) for r in needs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string()), pa.array(refers, pa.list_(pa.string()))],
                                             [*batch.schema.names, "canonical", "error", "refers"])

    schema = ", ".join(f"`{n}` {t}" for n, t in calls.dtypes)
    return calls.mapInArrow(run, schema + ", canonical string, error string, refers array<string>")


def order_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, step, result_turn, lost): where each call stands so that it follows the results it refers to, and
    whether one of its references finds no earlier call.  A call starts
    at its own turn; a reference lifts it behind the result.  Rounds of one join each, until no call moves."""
    first = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"))
    keys = ["conv_id", "call_id"]
    named = calls.groupBy(*keys).agg(F.min(F.struct(F.col("turn").alias("t"), "refers")).alias("c")).select(
        *keys, F.col("c.t").alias("turn"), F.col("c.refers").alias("refers"))
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    named = stored(named.alias("a").join(first.alias("b"), same("a", "b") & (F.col("a.call_id") == F.col("b.call_id")), "left").select(
        "a.conv_id", "a.call_id", "a.turn", "a.refers", "result_turn"))
    links = named.select("conv_id", "call_id", F.col("turn").alias("t"), F.explode("refers").alias("needs"))
    # only a reference to an earlier call orders: no cycle can arise
    links = stored(links.alias("l").join(named.alias("n"), same("l", "n") & (F.col("l.needs") == F.col("n.call_id")) & (F.col("n.turn") < F.col("l.t")), "left").select(
        "l.conv_id", "l.call_id", F.when(F.col("n.call_id").isNotNull(), F.col("l.needs")).alias("needs")))
    lost = links.where("needs is null").select("conv_id", "call_id").distinct().withColumn("lost", F.lit(True))
    links = links.where("needs is not null")
    now = stored(named.alias("a").join(lost.alias("b"), same("a", "b") & (F.col("a.call_id") == F.col("b.call_id")), "left").select(
        "a.conv_id", "a.call_id", F.col("a.turn").alias("place"), F.lit(0).alias("step"), "a.result_turn", F.coalesce("b.lost", F.lit(False)).alias("lost")))
    if links.isEmpty():
        return now
    while True:
        ends = now.select("conv_id", "call_id", F.struct(F.greatest("place", "result_turn").alias("place"), (F.col("step") + 2).alias("step")).alias("end"))
        after = links.alias("l").join(ends.alias("e"), same("l", "e") & (F.col("l.needs") == F.col("e.call_id"))).groupBy(
            F.col("l.conv_id").alias("conv_id"), F.col("l.call_id").alias("call_id")).agg(F.max("end").alias("end"))
        own = F.struct(F.col("n.place").alias("place"), F.col("n.step").alias("step"))
        moved = now.alias("n").join(after.alias("a"), same("n", "a") & (F.col("n.call_id") == F.col("a.call_id")), "left").select(
            "n.conv_id", "n.call_id", F.greatest(own, F.col("a.end")).alias("at"), "n.result_turn", "n.lost", (F.col("a.end") > own).alias("moves"))
        moved = stored(moved.select("conv_id", "call_id", F.col("at.place").alias("place"), F.col("at.step").alias("step"), "result_turn", "lost", "moves"))
        if moved.where("moves").isEmpty():
            return moved.drop("moves")
        now = moved.drop("moves")


def format_chat(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, place, step, turn, kind, call_id, status, json): one row per message, call and result; (place, step, kind,
    call_id, turn) is the order inside a conversation.  ``messages`` has conv_id, turn, role, text; ``calls`` conv_id, turn, call_id, name,
    arguments; ``results`` conv_id, turn, call_id, content."""
    checked = stored(check_calls(calls.select("conv_id", "turn", "call_id", "name", "arguments"), schemas))
    results = stored(results.select("conv_id", "turn", "call_id", F.coalesce("content", F.lit("")).alias("content")))
    placed = order_calls(checked, results)
    winners = checked.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "canonical")).alias("w"))
    links = placed.alias("p").join(winners.alias("w"), F.col("p.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("p.call_id") == F.col("w.call_id"))).select(
        "p.conv_id", "p.call_id", "place", "step", "result_turn", "lost", F.col("w.w").alias("w"))
    of = lambda a: F.col(f"{a}.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col(f"{a}.call_id") == F.col("l.call_id"))
    call = checked.alias("c").join(links.alias("l"), of("c"), "left").select(
        "c.conv_id", F.coalesce("l.place", "c.turn").alias("place"), F.coalesce("l.step", F.lit(0)).alias("step"), "c.turn", F.lit("1call").alias("kind"), "c.call_id",
        F.when(F.col("c.call_id").isNull(), "no id").when(~F.struct("c.turn", "c.canonical").eqNullSafe(F.col("l.w")), "repeated id").when(
            F.col("c.error").isNotNull(), F.col("c.error")).when(F.col("l.result_turn").isNull(), "no result").when(F.col("l.lost"), "unknown reference").otherwise("ok").alias("status"),
        F.col("c.name").alias("a"), F.col("c.canonical").alias("b"))
    result = results.alias("r").join(links.alias("l"), of("r"), "left").select(
        "r.conv_id", F.greatest("r.turn", "l.place").alias("place"), (F.coalesce("l.step", F.lit(0)) + 1).alias("step"), "r.turn", F.lit("2result").alias("kind"), "r.call_id",
        F.when(F.col("l.call_id").isNull(), "no call").when(F.col("r.turn") != F.col("l.result_turn"), "repeated id").when(
            F.col("r.turn") < F.col("l.w.turn"), "before its call").otherwise("ok").alias("status"),
        F.lit(None).cast("string").alias("a"), F.col("r.content").alias("b"))
    plain = messages.select("conv_id", F.col("turn").alias("place"), F.lit(-1).alias("step"), "turn", F.lit("0message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
                            F.lit("ok").alias("status"), F.col("role").alias("a"), F.col("text").alias("b"))
    rows = plain.unionByName(call).unionByName(result)
    names = ["conv_id", "place", "step", "turn", "kind", "call_id", "status", "json"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_line(kind[1:], call_id, a, b) for kind, call_id, a, b in zip(*(batch.column(k).to_pylist() for k in ("kind", "call_id", "a", "b")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names[:-1]), pa.array(out, pa.string())], names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names[:-1]) + ", json string").withColumn("kind", F.substring("kind", 2, 10))


def _line(kind: str, call_id: str | None, a: str | None, b: str | None) -> str:
    if kind == "message":
        return canonical({"role": a or "", "content": b or ""})
    if kind == "call":
        function = f'{{"arguments":{b or "null"},"name":{canonical(a or "")}}}'  # the arguments are canonical by now
        return f'{{"role":"assistant","tool_calls":[{{"function":{function},"id":{canonical(call_id)},"type":"function"}}]}}'
    return canonical({"role": "tool", "tool_call_id": call_id, "content": b or ""})


# The query's tools: what a user asks becomes a call, what the assistant answers its result.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 40}, "limit": {"type": "integer", "minimum": 1, "maximum": 10}, "context": {"type": "string"}}},
}


def tool_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls and results from the conversations table: a user's turn calls ``search`` with its text (and, from the
    third turn on, refers to the call two turns before), the assistant's next turn is the result; system turns are messages."""
    call_id = lambda turn: F.concat(F.lit("call-"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), turn.cast("string"))
    messages = conversations.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("query"), (F.col("turn") % 12).alias("limit"),
                                   F.when(F.col("turn") >= 2, F.struct(call_id(F.col("turn") - 2).alias("$result"))).alias("context")))
    calls = conversations.where("role = 'user'").select("conv_id", "turn", call_id(F.col("turn")).alias("call_id"), F.lit("search").alias("name"), arguments.alias("arguments"))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return messages, calls, results
