"""Chat formatting: tool calls are linked with their results, ordered by what they need, checked, and written as canonical JSON."""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import small_batches

CALLS = "array<struct<id:string,name:string,arguments:string>>"
#: How arguments name the result of another call: {"$ref": "<call id>"}.
REFERENCE = r'"\$ref"\s*:\s*"((?:[^"\\]|\\.)*)"'
_OUT = "conv string, turn long, part int, role string, call_id string, json string, problems array<string>"


def canonical(value) -> str:
    """JSON with keys in order of code points, no blanks, no escapes that are not needed; whole numbers without a fraction."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(x[k]) for k in sorted(x)}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2**53:
            return int(x)
        return x

    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode("utf-8", "replace").decode()


def _kind(x) -> str:
    if x is None or isinstance(x, bool):
        return "null" if x is None else "boolean"
    if isinstance(x, (int, float)):
        return "integer" if isinstance(x, int) or x == int(x) else "number"
    return {str: "string", list: "array", dict: "object"}[type(x)]


def violations(value, schema: dict, at: str = "") -> Iterator[str]:
    """What a value breaks of a JSON schema's type, enum, minimum, maximum, minLength, maxLength, pattern, required, properties,
    additionalProperties, items. A reference to another call's result fits everything."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return
    where, kind = at or "/", _kind(value)
    if "type" in schema:
        allowed = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if kind not in allowed and not (kind == "integer" and "number" in allowed):
            yield f"{where}: {kind} instead of {' or '.join(allowed)}"
            return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{where}: not an allowed value"
    if kind in ("integer", "number"):
        if "minimum" in schema and value < schema["minimum"]:
            yield f"{where}: below {schema['minimum']}"
        if "maximum" in schema and value > schema["maximum"]:
            yield f"{where}: above {schema['maximum']}"
    if kind == "string":
        if len(value) < schema.get("minLength", 0):
            yield f"{where}: too short"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            yield f"{where}: too long"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"{where}: does not match"
    if kind == "array":
        for i, x in enumerate(value):
            yield from violations(x, schema.get("items", {}), f"{at}/{i}")
    if kind == "object":
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                yield f"{at}/{name}: missing"
        for name in sorted(value):
            if name in known:
                yield from violations(value[name], known[name], f"{at}/{name}")
            elif schema.get("additionalProperties", True) is False:
                yield f"{at}/{name}: unknown"


def ordered(ids: list[str], needs: list[set[str]]) -> tuple[list[int], set[int]]:
    """Calls of one message so that each comes behind those it needs, else in their own order; and those in or behind a circle, which stay last."""
    place = {}
    for i, x in enumerate(ids):
        place.setdefault(x, i)
    waits = [{place[x] for x in own if x in place} for own in needs]
    behind: list[list[int]] = [[] for _ in ids]
    for i, own in enumerate(waits):
        for j in own:
            behind[j].append(i)
    ready = [i for i, own in enumerate(waits) if not own]
    heapq.heapify(ready)
    out = []
    while ready:
        j = heapq.heappop(ready)
        out.append(j)
        for i in behind[j]:
            waits[i].discard(j)
            if not waits[i]:
                heapq.heappush(ready, i)
    rest = [i for i in range(len(ids)) if i not in set(out)]
    return out + rest, set(rest)


def _message(role, text, calls, turn, schemas) -> Iterator[tuple]:
    """The rows of one message: (part, role, call id, json, problems): the message itself, then results in the order of the calls."""
    calls = sorted(calls if calls is not None else [], key=lambda c: c["place"])
    parsed, problems = [], []
    for c in calls:
        own = []
        try:
            value = json.loads(c["arguments"]) if c["arguments"] is not None else {}
            canonical(value)
        except (ValueError, RecursionError):
            value = c["arguments"]
            own.append("arguments are no JSON")
        else:
            if c["name"] not in schemas:
                own.append("unknown tool")
            else:
                own += violations(value, schemas[c["name"]])
        if not c["first"]:
            own.append("identifier used before")
        for ref in c["refs"] if c["refs"] is not None else []:
            if ref["turn"] is None:
                own.append(f"needs unknown call {ref['id']}")
            elif ref["turn"] > turn:
                own.append(f"needs later call {ref['id']}")
        if c["results"] == 0:
            own.append("no result")
        elif c["results"] > 1:
            own.append("several results")
        parsed.append(value)
        problems.append(own)
    order, circle = ordered([c["id"] or "" for c in calls], [{r["id"] for r in (c["refs"] if c["refs"] is not None else [])} for c in calls])
    for i in circle:
        problems[i].append("in or behind a circle")
    message = {"role": role, "content": text}
    if calls:
        message["tool_calls"] = [{"id": calls[i]["id"], "type": "function", "function": {"name": calls[i]["name"], "arguments": parsed[i]}} for i in order]
    yield 0, role, None, canonical(message), []
    for part, i in enumerate(order, 1):
        c = calls[i]
        linked = c["results"] > 0 and c["first"]
        content = canonical({"role": "tool", "tool_call_id": c["id"], "name": c["name"], "content": c["content"]}) if linked else None
        yield part, "tool", c["id"], content, problems[i]


def format_chats(messages: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Rows that make up each conversation when ordered by turn, then part: conv, turn, part, message (tells messages of one turn
    apart), role, call_id, json, problems.

    messages: conv, turn, role, text, calls (array of id, name, arguments as JSON). results: conv, call_id, turn, content.
    schemas: by tool, the JSON schema of its arguments.

    Calls and results are joined by conversation and identifier. The calls of a message are ordered so that each stands behind those
    whose results its arguments name; between messages, turns are the order. Part 0 is the message with its calls; then one row per
    call with its result as json, or null without one, and all that is wrong with it: arguments that are no JSON or break the schema,
    an unknown tool, no or several results, an identifier used before, an unknown or later call needed, a circle. Results that no
    call asks for are rows of role tool with the problem "no call". Nothing is dropped. No task holds a conversation, only a message.

    Rows that repeat in all columns are one. Of several calls of an identifier, the first by turn, message and place is the one that
    results belong to; of several results the one of the first turn, then of the smallest content, counts. Null conversations are one
    conversation, null turns come first, null texts stay null, null call lists are empty; calls without identifier have no result.
    Other columns are ignored. Empty tables give no rows.
    """
    small_batches(messages.sparkSession)
    messages = messages.select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("calls").cast(CALLS).alias("calls"))
    messages = messages.dropDuplicates().withColumn("message", F.xxhash64("conv", "turn", "role", "text", F.to_json(F.struct("calls"))))
    calls = messages.select("conv", "turn", "message", F.posexplode("calls").alias("place", "call")).select("conv", "turn", "message", "place", "call.*")
    c = F.coalesce("conv", F.lit("\0"))
    results = results.select(F.col("conv").cast("string").alias("conv"), F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content")).dropDuplicates()
    # One row per identifier: the call that owns it and the result that counts, joined by hash of (conversation, identifier).
    owners = calls.filter("id IS NOT NULL").groupBy(c.alias("c"), F.col("id").alias("i")).agg(F.min(F.struct("turn", "message", "place")).alias("owner"))
    answers = results.filter("call_id IS NOT NULL").groupBy(c.alias("c"), F.col("call_id").alias("i")).agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n"))
    linked = owners.join(answers, ["c", "i"], "left")
    calls = calls.withColumn("c", c).join(linked.withColumnRenamed("i", "id"), ["c", "id"], "left")
    mine = F.struct("turn", "message", "place")
    calls = calls.withColumns({"first": F.col("owner").isNull() | (F.col("owner") == mine), "results": F.coalesce("n", F.lit(0)), "content": F.col("answer.content")})
    needs = calls.select("c", "message", "place", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("ref"))
    known = owners.select("c", F.col("i").alias("ref"), F.struct(F.col("owner.turn").alias("turn")).alias("at"))
    needs = needs.join(known, ["c", "ref"], "left").groupBy("message", "place").agg(F.array_sort(F.collect_list(F.struct(F.col("ref").alias("id"), F.col("at.turn").alias("turn")))).alias("refs"))
    calls = calls.join(needs, ["message", "place"], "left")
    whole = calls.groupBy("message").agg(F.collect_list(F.struct("place", "id", "name", "arguments", "first", "results", "content", "refs")).alias("linked"))
    rows = messages.drop("calls").join(whole, "message", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                turn = None if pd.isna(r.turn) else int(r.turn)
                for part, role, call, text, problems in _message(r.role, r.text, r.linked, -math.inf if turn is None else turn, schemas):
                    out.append((r.conv, turn, part, r.message, role, call, text, problems))
            found = pd.DataFrame(out, columns=["conv", "turn", "part", "message", "role", "call_id", "json", "problems"])
            yield found.astype({"turn": "Int64"})

    out = rows.mapInPandas(run, _OUT.replace("role string", "message long, role string"))
    orphans = results.withColumn("c", c).join(owners.select("c", F.col("i").alias("call_id")), ["c", "call_id"], "left_anti")

    @F.pandas_udf("string")
    def alone(ids: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([canonical({"role": "tool", "tool_call_id": i, "content": x}) for i, x in zip(ids, contents)], dtype=object)

    orphans = orphans.select("conv", "turn", F.lit(1).alias("part"), F.lit(None).cast("long").alias("message"), F.lit("tool").alias("role"), "call_id", alone("call_id", "content").alias("json"), F.array(F.lit("no call")).alias("problems"))
    return out.unionByName(orphans)
