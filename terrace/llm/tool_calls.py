"""Tool-call linking for chat data.

Calls and results are joined by (conversation, identifier).  A call waits for the
calls it names; its position is the largest turn among itself and all it waits
for, which orders a conversation topologically: calls that name only earlier
ones, nearly all, keep their turn, and only where a call names a later one does
a position have to be carried along, round by round.  Calls that wait for
themselves are told apart as cycles.  Arguments are checked against the schema of
the tool, and each call with its result is written as canonical JSON: keys in
order, no spaces, one spelling of each number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import cut, prepare

_TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces; whole floats are written as integers; text beyond ASCII stays as it is."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def errors_of(value: Any, schema: dict, at: str = "") -> list[str]:
    """What is wrong with ``value``, as path: rule.  Knows type, enum, const, required, properties, additionalProperties, items, bounds and pattern."""
    here, out = at or "/", []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if not any(isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
            return [f"{here}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{here}: enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{here}: const")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}/{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += errors_of(v, known[k], f"{at}/{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}/{k}: unknown")
    elif isinstance(value, list):
        if "items" in schema:
            for i, v in enumerate(value):
                out += errors_of(v, schema["items"], f"{at}/{i}")
        out += [f"{here}: {rule}" for rule, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", len(value)))) if bad]
    elif isinstance(value, str):
        out += [f"{here}: {rule}" for rule, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{here}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{here}: {rule}" for rule, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    return out


def on_cycles(edges: pd.DataFrame) -> pd.DataFrame:
    """(conv_id, call_id) of one conversation's calls that reach themselves over (call_id waits for other): Tarjan's components of several calls, and loops."""
    after: dict[str, list[str]] = {}
    for call, other in zip(edges.call_id, edges.other):
        after.setdefault(call, []).append(other)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    open_: set[str] = set()
    found: list[str] = [c for c, others in after.items() if c in others]
    for start in after:
        if start in index:
            continue
        work = [(start, iter(after[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        open_.add(start)
        while work:
            call, others = work[-1]
            for other in others:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    open_.add(other)
                    work.append((other, iter(after.get(other, []))))
                    break
                if other in open_:
                    low[call] = min(low[call], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[call])
                if low[call] == index[call]:
                    group = []
                    while not group or group[-1] != call:
                        group.append(stack.pop())
                        open_.discard(group[-1])
                    found += group if len(group) > 1 else []
    return pd.DataFrame({"conv_id": edges.conv_id.iloc[:1].repeat(len(set(found))).to_numpy(), "call_id": sorted(set(found))})


def cyclic_calls(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id) of the calls on a cycle of ``edges(conv_id, call_id, other, late)``.

    A cycle needs an edge to a later turn, so only conversations with such edges
    are looked at.  There, edges from calls that wait for nothing and to calls
    that nobody waits for are peeled off until none is left to peel; what remains
    of a conversation, cycles and what lies between two of them, goes to one task.
    """
    kinds = edges.select("conv_id", "call_id").schema
    left = cut(edges.join(edges.where("late").select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "call_id", "other"))
    before, rows = None, left.count()
    while rows and rows != before:
        waiting = left.select("conv_id", F.col("call_id").alias("other")).distinct()
        named = left.select("conv_id", F.col("other").alias("call_id")).distinct()
        left = cut(left.join(waiting, ["conv_id", "other"], "left_semi").join(named, ["conv_id", "call_id"], "left_semi"))
        before, rows = rows, left.count()
    return left.groupBy("conv_id").applyInPandas(on_cycles, kinds) if rows else edges.sparkSession.createDataFrame([], kinds)


def positions(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, position, hops, cyclic) of ``calls(conv_id, call_id, turn, after)``.

    Sorting by position, hops, turn and call_id is a topological order of all but
    the cyclic calls, which are exactly those that wait for themselves, directly or
    through others; they keep their turn.  Waiting for a call that does not exist or
    is cyclic is ignored.  The rounds are as many as later turns are named one after
    another, whatever that number is.
    """
    prepare(calls.sparkSession)
    known = cut(calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"), F.flatten(F.collect_list("after")).alias("after")))
    edges = known.select("conv_id", "call_id", F.explode("after").alias("other")).distinct()
    edges = edges.join(known.select("conv_id", F.col("call_id").alias("other"), F.col("turn").alias("other_turn")), ["conv_id", "other"])
    edges = edges.join(known.select("conv_id", "call_id", "turn"), ["conv_id", "call_id"])
    edges = cut(edges.select("conv_id", "call_id", "other", F.coalesce(F.col("other_turn") >= F.col("turn"), F.lit(True)).alias("late")))
    cyclic = cut(cyclic_calls(edges).withColumn("cyclic", F.lit(True)))
    for end in ("call_id", "other"):
        edges = edges.join(cyclic.select("conv_id", F.col("call_id").alias(end)), ["conv_id", end], "left_anti")
    edges = cut(edges)
    now = known.select("conv_id", "call_id", "turn", F.col("turn").alias("position"), F.lit(0).alias("hops"))
    # Calls that name only earlier turns need no round at all; the others, and those waiting for them, move.
    moved = cut(edges.where("late").select("conv_id", "call_id").distinct())
    while not moved.isEmpty():
        inputs = edges.join(moved, ["conv_id", "call_id"], "left_semi").join(
            now.select("conv_id", F.col("call_id").alias("other"), F.col("position").alias("p"), F.col("hops").alias("h")), ["conv_id", "other"]
        )
        wanted = inputs.groupBy("conv_id", "call_id").agg(F.max(F.struct("p", (F.col("h") + 1).alias("q"))).alias("w"))
        state = F.struct(F.col("position"), F.col("hops"))
        merged = now.join(wanted, ["conv_id", "call_id"], "left").withColumn("new", F.when(F.col("w").isNotNull() & (F.struct(F.col("w.p"), F.col("w.q")) > state), F.struct(F.col("w.p").alias("position"), F.col("w.q").alias("hops"))).otherwise(F.struct("position", "hops")))
        merged = cut(merged.select("conv_id", "call_id", "turn", F.col("new.position").alias("position"), F.col("new.hops").alias("hops"), (F.col("new") != state).alias("changed")))
        now = merged.drop("changed")
        changed = merged.where("changed").select("conv_id", F.col("call_id").alias("other"))
        moved = cut(edges.join(changed, ["conv_id", "other"], "left_semi").select("conv_id", "call_id").distinct())
    return now.join(cyclic, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "position", "hops", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and one per result without a call: conv_id, call_id, position, hops, state, errors, line.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), after (identifiers
    it waits for; may be null).  ``results``: conv_id, call_id, content.  state is
    linked, unanswered, orphan (a result without a call) or cycle.  Of repeated
    calls with one identifier that of the smallest turn counts, of repeated
    results the smallest content.  errors lists breaches of the tool's schema,
    "arguments: not JSON" or "tool: unknown"; line is the canonical JSON.  Rows
    without an identifier take no part.
    """
    prepare(calls.sparkSession)
    asked = calls.where("conv_id is not null and call_id is not null").withColumn("after", F.coalesce("after", F.array().cast("array<string>")))
    first = asked.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments")).alias("c"))
    given = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("content")).alias("r"))
    placed = positions(asked)
    both = first.join(placed, ["conv_id", "call_id"]).join(given, ["conv_id", "call_id"], "full")
    state = F.when(F.col("c").isNull(), "orphan").when(F.col("cyclic"), "cycle").when(F.col("r").isNull(), "unanswered").otherwise("linked")
    both = both.select("conv_id", "call_id", F.col("position").cast("long").alias("position"), F.col("hops").cast("int").alias("hops"), state.alias("state"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("r.content").alias("content"))

    @F.pandas_udf("errors string, line string")
    def written(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for call_ids, states, names, arguments, contents in batches:
            out = []
            for call_id, kind, name, text, content in zip(call_ids, states, names, arguments, contents):
                record: dict[str, Any] = {"id": call_id, "result": content}
                errors: list[str] = []
                if kind != "orphan":
                    try:
                        record["arguments"] = json.loads(text) if text is not None else None
                        if name in schemas:
                            errors = errors_of(record["arguments"], schemas[name])
                        else:
                            errors = ["tool: unknown"]
                    except (ValueError, RecursionError):
                        record["arguments"], errors = text, ["arguments: not JSON"]
                    record["name"] = name
                out.append((";".join(sorted(errors)), canonical(record)))
            yield pd.DataFrame(out, columns=["errors", "line"])

    found = both.withColumn("w", written("call_id", "state", "name", "arguments", "content"))
    return found.select("conv_id", "call_id", "position", "hops", "state", "w.errors", "w.line")
