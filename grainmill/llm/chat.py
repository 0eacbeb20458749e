"""Chat formatting with tool-call linking; DataFrame functions only.

Turns are rows (conversation, turn, role, text). A text that is a JSON object may carry calls,
`{"content": ..., "tool_calls": [{"id", "name", "arguments"}]}`, or a result,
`{"tool_call_id": ..., "content": ...}` in a turn of role `tool`. Results are linked to calls by a
hash join on (conversation, identifier); the arguments of a call are validated against the tool's
schema; and every message is serialised as canonical JSON: keys sorted, no white space, nested
arguments included.

Order: a message depends on the call that it answers. Each message gets `rank`, the array
(turn of the call it answers, or its own; 1 for answers, 0 otherwise; position of the call within
its turn; its own turn), and the ascending order of (conversation, rank) is a topological order that keeps the turns' order wherever
calls allow it. Ranks need no global sort, so a conversation of any length is spread over all tasks.

Defined results: null conversations and turns are kept (null is a conversation of its own; null
turns come first); null texts are null content; text that only looks like JSON is content; a result without a call, or an
identifier that several calls claim, is `unmatched` or linked to the earliest call at or before it
(else the earliest); a call without a result counts as open; repeated rows stay; empty tables give
none; columns beyond the four are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

#: JSON Schema's names of types, and how Spark names the type of a parsed value.
TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$"}
CALL = "array<struct<id:string,name:string,arguments:string>>"


def _refuse(where: str, schema: dict, known: set[str]) -> None:
    """A keyword that is not checked must not pass for one that is."""
    if odd := sorted(set(schema) - known - {"title", "description", "default", "examples"}):
        raise ValueError(f"schema of {where!r}: {', '.join(odd)} not supported")


def _checks(args: Column, schemas: dict[str, dict]) -> Column:
    """Per tool, whether a call's parsed arguments satisfy its schema: {properties: {name: {type, enum}}, required: [...], additionalProperties: bool}."""
    out = F.lit(False)
    for tool, schema in schemas.items():
        _refuse(tool, schema, {"type", "properties", "required", "additionalProperties"})
        if schema.get("type", "object") != "object" or not isinstance(schema.get("additionalProperties", True), bool):
            raise ValueError(f"schema of {tool!r}: arguments are an object, additionalProperties true or false")
        for name, p in schema.get("properties", {}).items():
            _refuse(f"{tool}.{name}", p, {"type", "enum"})
        props, ok = schema.get("properties", {}), F.schema_of_variant(args).rlike("^OBJECT<")
        for name in schema.get("required", []):
            ok &= F.try_variant_get(args, f'$["{name}"]', "variant").isNotNull()
        for name, p in props.items():
            v = F.try_variant_get(args, f'$["{name}"]', "variant")
            kinds = [p["type"]] if isinstance(p.get("type"), str) else p.get("type", [])
            if kinds:
                ok &= v.isNull() | F.schema_of_variant(v).rlike("|".join(TYPES[k] for k in kinds))
            if "enum" in p:
                ok &= v.isNull() | F.to_json(v).isin(*(json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False) for x in p["enum"]))
        if schema.get("additionalProperties") is False:
            keys = F.json_object_keys(F.to_json(args))
            ok &= F.size(F.array_except(keys, F.array(*map(F.lit, props)) if props else F.array().cast("array<string>"))) == 0
        out = F.when(F.col("name") == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def messages(turns: DataFrame, schemas: dict[str, dict] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, rank, n_calls, n_valid_calls, n_open_calls, link, json): one row per turn.

    link is null for messages that answer no call, else 'linked' or 'unmatched'. schemas: argument
    schemas by tool; calls of other tools are invalid, and without any schemas every object is valid. A schema
    with a keyword other than type, enum, properties, required and additionalProperties is refused.
    """
    t = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    looks = F.ltrim("text").startswith("{")
    t = t.withColumn("v", F.when(looks, F.try_parse_json("text")))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    raw_calls = F.from_json(F.to_json(get("$.tool_calls", "variant")), "array<string>")
    calls = F.transform(raw_calls, lambda c: F.try_parse_json(c))
    field = lambda c, path: F.try_variant_get(c, path, "string")
    arguments = lambda c: F.coalesce(F.try_parse_json(field(c, "$.arguments")), F.try_variant_get(c, "$.arguments", "variant"))  # noqa: E731  an object, or the text of one
    calls = F.transform(calls, lambda c: F.struct(field(c, "$.id").alias("id"), field(c, "$.name").alias("name"), F.to_json(arguments(c)).alias("arguments")))
    t = t.withColumn("calls", F.when(F.col("role") == "assistant", calls).otherwise(F.lit(None).cast(CALL)))
    t = t.withColumn("answers", F.when(F.col("role") == "tool", get("$.tool_call_id", "string")))
    structured = F.col("calls").isNotNull() | F.col("answers").isNotNull()
    content = F.when(structured, F.when(~F.is_variant_null(get("$.content", "variant")), F.coalesce(get("$.content", "string"), F.to_json(get("$.content", "variant"))))).otherwise(F.col("text"))
    t = t.withColumn("content", content).drop("v", "text")

    each = t.where("calls is not null").select("conv_id", "turn", F.posexplode("calls").alias("at", "c")).select("conv_id", F.col("turn").alias("call_turn"), F.col("at").alias("call_at"), "c.*")
    args = F.try_parse_json("arguments")
    valid = F.coalesce(F.schema_of_variant(args).rlike("^OBJECT<"), F.lit(False)) if schemas is None else _checks(args, schemas)
    each = each.withColumn("valid", valid)
    answers = t.where("answers is not null").select("conv_id", "turn", "answers")
    # One row per identifier: its calls are few (copies aside, one), so the earliest is an aggregate, not a sort.
    first = each.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("call_turn", "call_at")).alias("call"))
    linked = answers.distinct().join(first, answers["conv_id"].eqNullSafe(first["conv_id"]) & (answers["answers"] == first["id"])).select(answers["conv_id"], "turn", "answers", "call")
    answered = linked.select("conv_id", F.col("answers").alias("id")).distinct().withColumn("done", F.lit(True))
    e = each.join(answered, each["conv_id"].eqNullSafe(answered["conv_id"]) & (each["id"] == answered["id"]), "left").select(each["*"], F.coalesce("done", F.lit(False)).alias("done"))
    per_turn = e.distinct().groupBy("conv_id", "call_turn").agg(F.count_if("valid").alias("n_valid_calls"), F.count_if(~F.col("done")).alias("n_open_calls"))

    t = t.join(linked.select(F.col("conv_id").alias("lc"), F.col("turn").alias("lt"), F.col("answers").alias("la"), "call"), t["conv_id"].eqNullSafe(F.col("lc")) & t["turn"].eqNullSafe(F.col("lt")) & (F.col("answers") == F.col("la")), "left").drop("lc", "lt", "la")
    t = t.join(per_turn.select(F.col("conv_id").alias("pc"), F.col("call_turn").alias("pt"), "n_valid_calls", "n_open_calls"), t["conv_id"].eqNullSafe(F.col("pc")) & t["turn"].eqNullSafe(F.col("pt")) & F.col("calls").isNotNull(), "left").drop("pc", "pt")
    big = lambda c: F.coalesce(c, F.lit(-1)).cast("bigint")
    own = big(F.col("turn"))
    rank = F.when(F.col("call").isNotNull(), F.array(big(F.col("call.call_turn")), F.lit(1).cast("bigint"), big(F.col("call.call_at")), own)).otherwise(F.array(own, F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), own))
    link = F.when(F.col("call").isNotNull(), "linked").when(F.col("answers").isNotNull(), "unmatched")
    text_json = lambda c: F.coalesce(F.substring(F.to_json(F.array(c)), 2, 2147483647), F.lit("null]"))
    quoted = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_replace(text_json(c), r"\]$", ""))
    call_json = F.concat(F.lit("["), F.array_join(F.transform("calls", lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(c["arguments"], F.lit("null")), F.lit(',"id":'), quoted(c["id"]), F.lit(',"name":'), quoted(c["name"]), F.lit("}"))), ","), F.lit("]"))
    body = F.concat(
        F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":'), quoted(F.col("role")),
        F.when(F.col("answers").isNotNull(), F.concat(F.lit(',"tool_call_id":'), quoted(F.col("answers")))).otherwise(F.lit("")),
        F.when(F.col("calls").isNotNull(), F.concat(F.lit(',"tool_calls":'), call_json)).otherwise(F.lit("")),
        F.lit("}"),
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return t.select("conv_id", "turn", "role", rank.alias("rank"), count(F.when(F.col("calls").isNotNull(), F.size("calls"))).alias("n_calls"), count(F.col("n_valid_calls")).alias("n_valid_calls"), count(F.col("n_open_calls")).alias("n_open_calls"), link.alias("link"), body.alias("json"))
