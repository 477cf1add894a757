"""Chat formatting: tool calls are linked to their results, ordered so that what a call depends on comes first, checked
against the schemas of their tools, and written as canonical JSON."""
from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType

from leakscope.llm.common import stored

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks, and characters beyond ASCII as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is_type(value: Any, name: str) -> bool:
    if name == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if name == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return name in TYPES and isinstance(value, TYPES[name])


def schema_errors(value: Any, schema: Mapping[str, Any], at: str = "$") -> Iterator[str]:
    """What a value has against a JSON schema: type, enum, const, required, properties, additionalProperties, items, length and
    range. Other keywords are not looked at."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is_type(value, k) for k in kinds):
        yield f"{at}: not {' or '.join(kinds)}"
        return
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        yield f"{at}: not an allowed value"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from (f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value)
        for k in sorted(value):
            if k in known:
                yield from schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{k}: unknown"
    elif isinstance(value, list):
        if "items" in schema:
            for i, x in enumerate(value):
                yield from schema_errors(x, schema["items"], f"{at}[{i}]")
    for size, least, most in ((len(value), "minLength", "maxLength"),) if isinstance(value, str) else ((len(value), "minItems", "maxItems"),) if isinstance(value, list) else ((value, "minimum", "maximum"),) if _is_type(value, "number") else ():
        if least in schema and size < schema[least] or most in schema and size > schema[most]:
            yield f"{at}: out of range"


def _records(schemas: Mapping[str, Mapping[str, Any]]):
    @F.arrow_udf("struct<record: string, errors: array<string>>")
    def run(call_id: pa.Array, name: pa.Array, arguments: pa.Array, needs: pa.Array, result: pa.Array, role: pa.Array, status: pa.Array) -> pa.Array:
        out = []
        for i, n, a, d, r, who, kind in zip(*(x.to_pylist() for x in (call_id, name, arguments, needs, result, role, status)), strict=True):
            if kind == "plain" or who != "call":
                out.append({"record": canonical({"content": r, "role": who} if kind == "plain" else {"content": r, "id": i, "role": who}), "errors": []})
                continue
            errors: list[str] = []
            try:
                value = json.loads(a) if a is not None else None
                canonical(value)
            except ValueError:
                value, errors = a, ["$: not JSON"]
            if not errors:
                errors = list(schema_errors(value, schemas[n])) if n in schemas else ["$: unknown tool"]
            out.append({"record": canonical({"arguments": value, "depends_on": sorted({x for x in d or () if x is not None}), "id": i, "name": n, "result": r}), "errors": errors})
        return pa.array(out, pa.struct([("record", pa.string()), ("errors", pa.list_(pa.string()))]))

    return run


#: Conversations with up to so many calls and dependencies are ordered within a task, one at a time; longer ones by joins.
LOCAL_ROWS = 200_000
#: Lengths stop here, so that going around a cycle doesn't overflow.
FAR = 1 << 60


def longest_chains(needs: Mapping[str, set[str]]) -> dict[str, int | None]:
    """For every call the length of the longest chain of calls that it waits for; None for what a cycle holds."""
    waits = {i: {n for n in own if n in needs} for i, own in needs.items()}
    asked: dict[str, list[str]] = {}
    for i, own in waits.items():
        for n in own:
            asked.setdefault(n, []).append(i)
    level, left = dict.fromkeys(needs, 0), {i: len(own) for i, own in waits.items()}
    ready = [i for i, n in left.items() if not n]
    for i in ready:  # grows while it is walked
        for j in asked.get(i, ()):
            level[j] = max(level[j], level[i] + 1)
            left[j] -= 1
            if not left[j]:
                ready.append(j)
    return {i: level[i] if not left[i] else None for i in needs}


def _ordered(schema: pa.Schema):
    """Takes calls in the order of their conversations."""
    def settled(conv: Any, needs: dict[str, set[str]]) -> pa.RecordBatch:
        found = longest_chains(needs)
        return pa.RecordBatch.from_pydict({"conv_id": [conv] * len(found), "call_id": list(found), "level": list(found.values())}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, needs = None, {}
        for batch in batches:
            for c, i, own in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "call_id", "depends_on")), strict=True):
                if c != conv and needs:
                    yield settled(conv, needs)
                    needs = {}
                conv = c
                needs.setdefault(i, set()).update(own or ())
        if needs:
            yield settled(conv, needs)

    return run


def _levels_by_joins(calls: DataFrame) -> DataFrame:
    """`longest_chains` for conversations of any length, in rounds of joins. A call's level is the largest of `base` and of level +
    `far` over its edges. In every round edges to settled calls turn into a base, and an edge to a call with one edge is led on
    along that edge, so a chain takes rounds with the logarithm of its length and the number of edges never grows; where calls with
    several edges follow each other, each of these takes a round. A round that settles nothing leaves only what waits for a cycle."""
    nodes = stored(calls.select("conv_id", "call_id", F.lit(0).cast("long").alias("base"), F.lit(False).alias("done")).distinct(), "calls")
    need = calls.select("conv_id", "call_id", F.explode("depends_on").alias("need"))
    known = nodes.select("conv_id", F.col("call_id").alias("need"))
    edges = stored(need.join(known, ["conv_id", "need"], "left_semi").select("conv_id", "call_id", "need", F.lit(1).cast("long").alias("far")).distinct(), "needs")
    while True:
        own = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("need", "far")).alias("only"))
        state = stored(nodes.join(own, ["conv_id", "call_id"], "left"), "calls")
        if state.filter("n is null and not done").isEmpty():
            return state.select("conv_id", "call_id", F.when(F.col("done"), F.col("base")).cast("int").alias("level"))
        ahead = state.select("conv_id", F.col("call_id").alias("need"), F.col("base").alias("n_base"), "n", "only")
        led = stored(edges.join(ahead, ["conv_id", "need"]), "needs")
        bases = led.filter("n is null or n = 1").groupBy("conv_id", "call_id").agg(F.max(F.least(F.col("n_base") + F.col("far"), F.lit(FAR))).alias("more"))
        nodes = state.join(bases, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("base", "more").alias("base"), F.col("n").isNull().alias("done"))
        one = F.col("n") == 1
        on = led.filter("n is not null").select(
            "conv_id", "call_id", F.when(one, F.col("only.need")).otherwise(F.col("need")).alias("need"),
            F.when(one, F.least(F.col("far") + F.col("only.far"), F.lit(FAR))).otherwise(F.col("far")).alias("far"))
        edges = stored(on.groupBy("conv_id", "call_id", "need").agg(F.max("far").alias("far")), "needs")


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: ordered by level and turn, every call comes behind what it depends on.

    The level is the length of the longest chain of calls that a call waits for, 0 without dependencies. What a cycle holds, or
    waits for one, has no level. Dependencies on calls that don't exist, and null ones, are not waited for. Rows that share conv_id
    (not null) and call_id are one call. Conversations of more than LOCAL_ROWS calls and dependencies are ordered by joins.
    """
    rows = calls.select("conv_id", "call_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    many = stored(rows.groupBy("conv_id").agg(F.sum(1 + F.size("depends_on")).alias("n")).filter(F.col("n") > LOCAL_ROWS).select("conv_id"), "long")
    fields = rows.select("conv_id", "call_id").schema.add("level", IntegerType())
    short = rows.join(many, "conv_id", "left_anti").repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_ordered(to_arrow_schema(fields)), fields)
    return short if many.isEmpty() else short.unionAll(_levels_by_joins(stored(rows.join(many, "conv_id", "left_semi"), "long")))


def _key() -> Column:
    """A conversation as text: a null one is apart from ''."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c")


def _superseded(rows: DataFrame, *cols: str) -> DataFrame:
    """The different rows that share conversation and id with a smaller one. Only the keys of such rows are gathered."""
    keyed = rows.filter("call_id is not null").select(_key(), "call_id", F.struct("turn", "conv_id", *cols).alias("x"))
    seen = keyed.select("c", "call_id", F.xxhash64(F.to_json("x")).alias("h")).groupBy("c", "call_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    several = keyed.join(stored(seen.filter("lo != hi").select("c", "call_id"), "several"), ["c", "call_id"]).distinct()
    least = several.groupBy("c", "call_id").agg(F.min("x").alias("least"))
    return several.join(least, ["c", "call_id"]).filter(~F.col("x").eqNullSafe(F.col("least"))).select("call_id", "x.*")


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row per plain message, call, and result without call, without id or superseded: conv_id, level, turn, call_id, status, valid, errors,
    record.

    messages: conv_id, turn, role, content. calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on (call ids).
    results: conv_id, turn, call_id, content. Calls and results are hash-joined by conversation and id; a call with its result
    is 'linked', one without is 'unanswered', a result without call is an 'orphan', any other message is 'plain'. Read a
    conversation in the order of level (plain ones: 0), turn, call_id. Texts are not gathered by conversation, so one of any
    length is dealt out over many tasks.

    Of rows that share conversation and id, the earliest counts (ties: the smallest); each other different one comes out as
    'duplicate', on level 0. Different calls and results without call_id come out as 'unidentified', on level 0. A null conv_id is
    a conversation of its own. Arguments that are no JSON, or against their schema, or of an unknown tool, are kept and reported
    as not valid.
    """
    first = lambda df, *cols: df.filter("call_id is not null").groupBy(_key(), "call_id").agg(F.min(F.struct("turn", "conv_id", *cols)).alias("x")).select("c", "call_id", "x.*")
    own = first(calls, "name", "arguments", "depends_on").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))
    got = first(results, "content").select("c", "call_id", F.col("turn").alias("r_turn"), F.col("conv_id").alias("r_conv"), F.col("content").alias("result"), F.lit(True).alias("answered"))
    levels = call_levels(own.select(F.col("c").alias("conv_id"), "call_id", "turn", "depends_on")).withColumnRenamed("conv_id", "c")
    linked = own.withColumn("called", F.lit(True)).join(levels, ["c", "call_id"], "left").hint("shuffle_hash").join(got.hint("shuffle_hash"), ["c", "call_id"], "full")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    rows = linked.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.when(F.col("called").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"), F.coalesce("turn", "r_turn").alias("turn"),
        "call_id", status.alias("status"), "name", "arguments", "depends_on", "result", F.when(F.col("called").isNull(), "tool").otherwise(F.lit("call")).alias("role"))
    none = lambda kind: F.lit(None).cast(kind)
    plain = messages.select("conv_id", F.lit(0).alias("level"), "turn", none("string").alias("call_id"), F.lit("plain").alias("status"), none("string").alias("name"), none("string").alias("arguments"), none("array<string>").alias("depends_on"), F.col("content").alias("result"), "role")
    as_call = lambda df, status: df.select("conv_id", F.lit(0).alias("level"), "turn", "call_id", F.lit(status).alias("status"), "name", "arguments", "depends_on", none("string").alias("result"), F.lit("call").alias("role"))
    as_result = lambda df, status: df.select("conv_id", F.lit(0).alias("level"), "turn", "call_id", F.lit(status).alias("status"), none("string").alias("name"), none("string").alias("arguments"), none("array<string>").alias("depends_on"), F.col("content").alias("result"), F.lit("tool").alias("role"))
    unnamed = lambda df, *cols: df.filter("call_id is null").select("conv_id", "turn", "call_id", *cols).distinct()
    others = [as_call(_superseded(calls, "name", "arguments", "depends_on"), "duplicate"), as_result(_superseded(results, "content"), "duplicate"),
              as_call(unnamed(calls, "name", "arguments", "depends_on"), "unidentified"), as_result(unnamed(results, "content"), "unidentified")]
    made: Column = _records(schemas)("call_id", "name", "arguments", "depends_on", "result", "role", "status")
    out = reduce(DataFrame.unionByName, [*others, rows, plain]).withColumn("made", made)
    return out.select("conv_id", "level", "turn", "call_id", "status", (F.size("made.errors") == 0).alias("valid"), F.col("made.errors").alias("errors"), F.col("made.record").alias("record"))


# ---------------------------------------------------------------- conversations without marked calls

ANSWER = {"answer": {"type": "object", "required": ["prompt", "turn", "words"], "additionalProperties": False, "properties": {
    "prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 1}}}}


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain conversations (conv_id, turn, role, text) as messages, calls and results: a user's turn asks the tool `answer` and
    depends on the user's turn two before, if there is one; an assistant's turn is the result of the turn before. Rows without turn are messages."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    named = lambda turn: F.concat(F.lit("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), turn.cast("string"))
    users = rows.filter("role = 'user' and turn is not null").dropDuplicates(["conv_id", "turn", "text"])
    before = users.select(F.col("conv_id").alias("b_conv"), (F.col("turn") + 2).alias("b_turn")).distinct()
    asked = users.join(before, users["conv_id"].eqNullSafe(F.col("b_conv")) & (users["turn"] == F.col("b_turn")), "left")
    words = F.size(F.filter(F.split("text", r"[\x09-\x0D\x20]+"), lambda w: w != ""))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn", F.when(F.col("text").isNotNull(), words).alias("words")))
    calls = asked.select("conv_id", "turn", named(F.col("turn")).alias("call_id"), F.lit("answer").alias("name"), arguments.alias("arguments"),
                         F.when(F.col("b_turn").isNotNull(), F.array(named(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = rows.filter("role = 'assistant' and turn is not null").select("conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    messages = rows.filter("role is null or role not in ('user', 'assistant') or turn is null").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return messages, calls, results


def format_conversations(conversations: DataFrame) -> DataFrame:
    """`link_tool_calls` over plain conversations. Null texts are kept as null (and are no valid prompt)."""
    return link_tool_calls(*as_calls(conversations), ANSWER)
