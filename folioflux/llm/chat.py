"""Tool-call linking for chat data: calls meet their results by identifier, in dependency order, as canonical JSON.

Calls and results are grouped by conversation and identifier and joined on both, by a hash where one side is small. A call
that refers to the results of other calls comes after them: its level is one more than the highest level it refers to. Arguments are checked against the schema of their tool, and each linked call is serialised with
sorted keys and no optional white space.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from folioflux.llm.rows import attach, table
from folioflux.sources.staging import required_folder

TOGETHER = 100_000      # references of a conversation that one task orders
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
MESSAGE = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, tool_call_id string, content string"


def _no_number(name: str):
    raise ValueError(name)


def parsed(text: str | None):
    """The value of a JSON text; ValueError where it is none, names a number JSON has not, or is nested too deep."""
    try:
        return json.loads(text or "", parse_constant=_no_number)
    except RecursionError:
        raise ValueError("nested too deep") from None


def problem(schema: dict | None, text: str | None) -> str | None:
    """Why an arguments text does not fit a schema (type, properties, required, additionalProperties, enum, minimum)."""
    if schema is None:
        return "unknown tool"
    try:
        value = parsed(text)
    except ValueError:
        return "not JSON"
    return written(_problem(schema, value, "arguments"))


def _is(value, kind: str) -> bool:
    return value is None if kind == "null" else isinstance(value, TYPES.get(kind, ())) and not (isinstance(value, bool) and kind in ("integer", "number"))


def _problem(schema: dict, value, at: str) -> str | None:
    kind = schema.get("type")
    kinds = [kind] if isinstance(kind, str) else kind or []
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{at} is no {' or '.join(kinds)}"
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        return f"{at} is not allowed"
    if "minimum" in schema and _is(value, "number") and value < schema["minimum"]:
        return f"{at} is too small"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(schema.get("required", [])):
            if name not in value:
                return f"{at}.{name} is missing"
        for name in sorted(value):
            if name in known:
                if found := _problem(known[name], value[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name} is unknown"
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            if found := _problem(schema["items"], x, f"{at}[{k}]"):
                return found
    return None


def written(text: str | None) -> str | None:
    """Half of a surrogate pair, which no text can hold, as its escape."""
    return text and re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    return written(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, call_id, position, name, arguments, after) and results (conv_id, call_id, position, content).

    ``messages`` has conv_id, turn, role and text; a call message is a JSON object with tool_calls, a result message
    one with tool_call_id and content. Other texts, null and empty ones included, are neither.
    """
    parsed = messages.select("conv_id", F.col("turn").alias("position"), F.from_json("text", MESSAGE).alias("m"))
    calls = parsed.select("conv_id", "position", F.explode("m.tool_calls").alias("c")) \
        .select("conv_id", F.col("c.id").alias("call_id"), "position", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"),
                F.col("c.after").alias("after"))
    results = parsed.filter(F.col("m.tool_call_id").isNotNull()) \
        .select("conv_id", F.col("m.tool_call_id").alias("call_id"), "position", F.col("m.content").alias("content"))
    return calls, results


def _ordered(group: pa.Table) -> pa.Table:
    """Levels of one conversation's calls that refer to others: those without open references come first."""
    calls, on = (group.column(c).to_pylist() for c in ("call_id", "on"))
    waits, behind = Counter(calls), defaultdict(list)
    for call, other in zip(calls, on, strict=True):
        behind[other].append(call)
    now, level, found = [x for x in behind if x not in waits], 0, []
    while now:
        level, then = level + 1, []
        for other in now:
            for call in behind[other]:
                waits[call] -= 1
                if not waits[call]:
                    then.append(call)
        found += [(call, level) for call in then]
        now = then
    conv = group.column("conv_id").slice(0, 1).combine_chunks().take(pa.array([0] * len(found), pa.int64()))
    return pa.table({"conv_id": conv, "call_id": pa.array([c for c, _ in found], group.schema.field("call_id").type), "level": pa.array([n for _, n in found], pa.int32())})


def levels(calls: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(conv_id, call_id, level) of every call whose references can be put in order; a cycle has no levels.

    References to calls that do not exist do not hold a call back. A conversation of up to ``together`` references is
    ordered by one task. Longer ones go in rounds, as many as their longest chain: each call keeps the number of its open
    references, and a round's calls settle theirs.
    """
    spark, keys = calls.sparkSession, ["conv_id", "call_id"]
    nodes = calls.select(*keys).distinct()
    edges = calls.select(*keys, F.explode("after").alias("on")).distinct().join(nodes.withColumnRenamed("call_id", "on"), ["conv_id", "on"])
    edges = table(edges.select(*keys, "on"), "references")
    free = nodes.join(edges.select(*keys).distinct(), keys, "left_anti").withColumn("level", F.lit(0))
    long = table(edges.groupBy("conv_id").count().filter(F.col("count") > together).select("conv_id"), "long")
    schema = StructType([edges.schema["conv_id"], edges.schema["call_id"], StructField("level", IntegerType())])
    if long.isEmpty():
        return free.unionByName(edges.groupBy("conv_id").applyInArrow(_ordered, schema))
    short = edges.join(long, "conv_id", "left_anti").groupBy("conv_id").applyInArrow(_ordered, schema)
    edges = table(edges.join(long, "conv_id", "left_semi"), "long_references")
    now = table(free.join(long, "conv_id", "left_semi"), "level")
    waiting = table(edges.groupBy(*keys).agg(F.count("*").alias("open")), "waiting")
    made = f"{required_folder(spark)}/folioflux-llm/{uuid.uuid4().hex}/levels"
    number = 0
    while True:
        number += 1
        settled = edges.join(now.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"]).groupBy(*keys).agg(F.count("*").alias("n"))
        left = table(waiting.join(settled, keys, "left").select(*keys, (F.col("open") - F.coalesce("n", F.lit(0))).alias("open")), "waiting")
        now = table(left.filter("open = 0").select(*keys, F.lit(number).alias("level")), "level")
        if now.isEmpty():
            break
        # Every round adds its calls to one folder.
        now.write.mode("append").parquet(made)
        waiting = left.filter("open > 0")
    if number > 1:
        short = short.unionByName(spark.read.schema(schema).parquet(made))
    return free.unionByName(short)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, status, level, position, name, problem, canonical) for every identifier.

    status: linked, no_result, or no_call. Of repeated calls or results with one identifier the first by position
    counts, then the first by content. level is null for a result without call and for calls in a cycle or behind
    one. problem says why the arguments do not fit their tool's schema, else null; canonical is the JSON of call and
    result, with the arguments as they are where they are no JSON, which NaN, Infinity and very deep nesting are not either;
    half a surrogate pair is written as its escape. Rows without conversation or identifier cannot be
    linked and are left out. Empty tables give an empty result.
    """
    keys = ["conv_id", "call_id"]
    named = lambda df: df.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    calls, results = named(calls), named(results)
    one = calls.groupBy(*keys).agg(F.min(F.struct("position", "name", "arguments", "after")).alias("call"))
    answer = results.groupBy(*keys).agg(F.min(F.struct("position", "content")).alias("result"))
    ordered = levels(one.select(*keys, "call.after"))
    joined = one.hint("shuffle_hash").join(answer, keys, "full").join(ordered, keys, "left")
    status = F.when(F.col("call").isNull(), "no_call").when(F.col("result").isNull(), "no_result").otherwise("linked")
    flat = joined.select(*keys, status.alias("status"), "level", F.coalesce("call.position", "result.position").alias("position"),
                         F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"), F.col("call").isNotNull().alias("called"),
                         F.col("call.after").alias("after"), F.col("result.content").alias("content"))

    def make():
        def fn(texts, ids, names, called, after, content):
            problems, lines = [], []
            for t, i, name, is_call, needs, result in zip(texts, ids, names, called, after, content, strict=True):
                arguments = t.decode() if t is not None else None
                problems.append(problem(schemas.get(name), arguments) if is_call else None)
                rest = {"after": sorted(x for x in needs or () if x is not None), "id": i, "name": name, "result": result}
                try:
                    lines.append(canonical(rest | {"arguments": parsed(arguments)}))
                except (ValueError, RecursionError):
                    lines.append(canonical(rest | {"arguments": arguments}))
            return [problems, lines]
        return fn
    fields = [StructField("problem", StringType()), StructField("canonical", StringType())]
    return attach(flat, "arguments", fields, make, keep=[*keys, "status", "level", "position", "name"],
                  extra=["call_id", "name", "called", "after", "content"])
