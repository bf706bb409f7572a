"""Chat formatting with tool-call linking.  DataFrame functions only.

Input: messages (conv_id, turn, role, text).  Events are read from texts that are JSON:

* a message may hold ``{"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": {...}, "after": [ids]}]}``;
* a message of role ``tool`` holds ``{"tool_call_id": ..., "content": ...}``.

Everything else is plain content.  Calls and results are hash-joined on (conversation, identifier); a call's arguments are
checked against its tool's schema; calls are put in topological order of their ``after`` references; and each conversation
is serialised as canonical JSON: keys in code-point order, no spaces, arguments with the JSON types that they came with
(numbers in shortest form: 1.0 is 1, 2.50 is 2.5).

Defined results.  Null text: empty content.  Null turn: before all others.  A null conversation is one conversation.
Repeated identifiers: the first call (least turn, then position) owns the identifier, later ones are ``duplicate``; calls
without an identifier are ``duplicate`` too, as nothing can refer to them; of several results the first (least turn, then
content) is linked, the others are ``orphan``.  A result without a call is ``orphan``, a call without a result is
``pending``.  Unknown tools fail validation.  Arguments that are no object fail it and are written as they are; missing ones,
null and objects with a repeated key count as {}; a number that no double holds is read as text.  Calls whose references
form a circle, or wait for one that does, get rank null; references to no call of the conversation are ignored.  Repeated
messages are each written.  Conversation ids may have any type; numbers are written as such, others as texts.  Very long texts are read whole.  Columns other than the four are not looked at.  Empty input:
empty output.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.common import BROADCAST_ROWS, cut

_CALL = "array<struct<id:string,name:string,arguments:variant,after:array<string>>>"
#: JSON types that a schema may name, each with the pattern of the types that Spark finds in such values.
JSON_TYPES = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$"}
#: Turns of a conversation that are one row of the output.
PART_TURNS = 512


def json_string(c: Column) -> Column:
    """A JSON literal of a text, or of another value, as to_json writes it."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def schema_table(spark, schemas: Mapping[str, Mapping]) -> DataFrame:
    """{tool: {"required": [...], "properties": {name: {"type": ..., "enum": [...], "maxLength": n}}}} as rows; enum values as
    canonical JSON."""
    rows = [(tool, key, p.get("type", "string"), key in s.get("required", []), [json.dumps(x, ensure_ascii=False) for x in p["enum"]] if "enum" in p else None, p.get("maxLength")) for tool, s in schemas.items() for key, p in s["properties"].items()]
    table = spark.createDataFrame(rows, "name string, key string, kind string, required boolean, enum array<string>, longest int")
    return table.withColumn("enum", F.transform("enum", lambda x: F.to_json(F.parse_json(x))))


def events(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages (conv_id, turn, role, content), calls (+ pos, id, name, json, is_object, arguments,
    after), results (+ id, content)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    looks = F.ltrim(text).startswith("{")
    m = messages.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), looks.alias("looks"))
    calls = F.when(F.col("looks"), F.from_json(F.get_json_object("text", "$.tool_calls"), _CALL))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    # each argument once: its name, type and canonical JSON
    each = lambda v: F.transform(
        F.map_entries(F.when(is_object(v), v).cast("map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("kind"), F.to_json(e["value"]).alias("json")))
    no_args = F.array().cast("array<struct<key:string,kind:string,json:string>>")
    plain = lambda v: F.when(v.isNull() | (F.schema_of_variant(v) == "VOID"), F.lit("{}")).otherwise(F.to_json(v))
    calls = F.transform(calls, lambda c: F.struct(
        c["id"].alias("id"), c["name"].alias("name"), c["after"].alias("after"), plain(c["arguments"]).alias("json"), (is_object(c["arguments"]) | (plain(c["arguments"]) == "{}")).alias("is_object"),
        F.when(is_object(c["arguments"]), each(c["arguments"])).otherwise(no_args).alias("arguments")))
    rid = F.when(F.col("looks") & (F.col("role") == "tool"), F.get_json_object("text", "$.tool_call_id"))
    body = F.when(F.col("looks"), F.get_json_object("text", "$.content"))
    # parsed once: what follows reads the parsed table
    m = cut(m.select("conv_id", "turn", "role", F.when(calls.isNotNull() | rid.isNotNull(), F.coalesce(body, F.lit(""))).otherwise(F.col("text")).alias("content"), calls.alias("calls"), rid.alias("rid")), "tool-messages")
    call = m.select("conv_id", "turn", F.posexplode("calls").alias("pos", "c")).select("conv_id", "turn", "pos", "c.id", "c.name", "c.json", "c.is_object", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    result = m.where("rid is not null").select("conv_id", "turn", F.col("rid").alias("id"), "content")
    return m.select("conv_id", "turn", "role", "content", F.col("rid").isNotNull().alias("is_result")), call, result


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds errors: unknown tool, missing or unknown arguments, wrong types, values outside enum, too long ones."""
    n = schemas.count()
    rules = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("key", "kind", "required", F.coalesce("enum", F.array().cast("array<string>")).alias("enum"), F.col("enum").isNotNull().alias("has_enum"), "longest"))).alias("rules"))  # few arguments to a tool
    c = calls.join(F.broadcast(rules) if n <= BROADCAST_ROWS else rules.hint("merge"), "name", "left")

    def wrong(r: Column) -> Column:
        v = F.get(F.filter("arguments", lambda x: x["key"] == r["key"]), F.lit(0))
        typed = F.coalesce(*[F.when(r["kind"] == k, v["kind"].rlike(p)) for k, p in JSON_TYPES.items()], F.lit(False))
        # a string's canonical JSON has escapes
        length = F.when(v["kind"] == "STRING", F.length(F.get_json_object(F.concat(F.lit("["), v["json"], F.lit("]")), "$[0]")))
        return (
            F.when(v.isNull() & r["required"], F.concat(F.lit("missing:"), r["key"]))
            .when(v.isNull(), F.lit(None).cast("string"))
            .when(~typed, F.concat(F.lit("type:"), r["key"]))
            .when(r["has_enum"] & ~F.array_contains(r["enum"], v["json"]), F.concat(F.lit("enum:"), r["key"]))
            .when(length > r["longest"], F.concat(F.lit("length:"), r["key"]))
        )

    known = F.transform("rules", lambda r: r["key"])
    extra = F.transform(F.array_sort(F.array_except(F.transform("arguments", lambda x: x["key"]), known)), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.concat(F.filter(F.transform("rules", wrong), lambda x: x.isNotNull()), extra)
    errors = F.when(F.col("rules").isNull(), F.array(F.lit("tool"))).when(~F.col("is_object"), F.array(F.lit("arguments"))).otherwise(found)
    return c.withColumn("errors", errors).drop("rules", "arguments")


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with state, result_turn and result; results with state."""
    # calls without an identifier need no order: each is a group of its own
    order = W.partitionBy("conv_id", "id", F.when(F.col("id").isNull(), F.struct("turn", "pos"))).orderBy("turn", "pos")
    calls = calls.withColumn("first", (F.row_number().over(order) == 1) & F.col("id").isNotNull())
    ranked = results.withColumn("k", F.row_number().over(W.partitionBy("conv_id", "id").orderBy("turn", "content")))
    r = ranked.where("k = 1").select(F.col("conv_id").alias("rc"), F.col("id").alias("ri"), F.col("turn").alias("result_turn"), F.col("content").alias("result"))
    same = F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("id") == F.col("ri")) & F.col("first")
    linked = calls.join(r.hint("shuffle_hash"), same, "left").drop("rc", "ri")
    state = F.when(~F.col("first"), "duplicate").when(F.col("result_turn").isNull(), "pending").otherwise("linked")
    linked = linked.withColumn("state", state)
    owner = linked.where("first").select(F.col("conv_id").alias("cc"), F.col("id").alias("ci"))
    back = ranked.join(owner, F.col("conv_id").eqNullSafe(F.col("cc")) & (F.col("id") == F.col("ci")) & (F.col("k") == 1), "left")
    return linked, back.select("conv_id", "turn", "id", F.when(F.col("ci").isNull(), "orphan").otherwise("linked").alias("state"))


def topological(calls: DataFrame) -> DataFrame:
    """Adds rank: 0 without references, else 1 + the greatest rank among those referred to; null on circles.

    Calls with one reference form chains.  Pointers along chains are doubled until they point to a call that is no link of
    a chain, so a chain of n calls takes log n joins.  The other calls settle level by level: a level takes those whose
    references are all settled, however many they are.  What never gets there lies on a circle or behind one.
    """
    key = F.concat_ws("\x01", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.col("id"))
    own = calls.where("first").select(key.alias("k"), F.transform(F.array_distinct("after"), lambda r: F.concat_ws("\x01", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), r)).alias("after"))
    refs = own.select("k", F.explode("after").alias("r")).join(own.select(F.col("k").alias("r")), "r")
    refs = cut(refs, "tool-refs")
    if refs.isEmpty():
        return calls.withColumn("rank", F.when(F.col("first"), F.lit(0)))
    kinds = cut(refs.groupBy("k").agg(F.count("*").alias("n"), F.min("r").alias("to")), "tool-kinds")
    links = kinds.where("n = 1").select("k", "to", F.lit(1).cast("long").alias("d"))
    ends, links = None, cut(links, "tool-links")
    for _ in range(62):  # longer chains than 2**62 there are not
        nxt = links.select(F.col("k").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        j = links.join(nxt, "to", "left")
        step = cut(j.select("k", F.coalesce("to2", "to").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.col("to2").isNull().alias("end")), "tool-links")
        links = step.drop("end")
        if step.where("not end").isEmpty():
            ends = links
            break
        # pointers on a circle never end; all others have ended once their number no longer falls
        left = step.where("not end").count()
        if ends is not None and left == ends:
            ends = step.where("end").drop("end")
            break
        ends = left
    links = ends if isinstance(ends, DataFrame) else links
    # what calls with several references wait for: the ends of chains, and how far behind them
    many = refs.join(kinds.where("n > 1").select("k"), "k", "left_semi")
    via = links.select(F.col("k").alias("r"), "to", "d")
    on_chain = kinds.where("n = 1").select(F.col("k").alias("r"), F.lit(True).alias("chained"))
    wait = many.join(via, "r", "left").join(on_chain, "r", "left").select("k", F.when(F.col("chained").isNull(), F.col("r")).otherwise(F.col("to")).alias("to"), F.coalesce("d", F.lit(0).cast("long")).alias("d"))
    wait = cut(wait, "tool-wait")
    done = cut(own.join(kinds, "k", "left_anti").select("k", F.lit(0).cast("long").alias("rank")), "tool-done")
    new = done
    while not wait.isEmpty():
        told = wait.join(done.select(F.col("k").alias("to"), "rank"), "to", "left")
        new = told.groupBy("k").agg(F.max(F.col("rank") + F.col("d") + 1).alias("rank"), F.bool_and(F.col("rank").isNotNull()).alias("all")).where("all").select("k", "rank")
        new = cut(new, "tool-done")
        if new.isEmpty():
            break
        done = cut(done.unionByName(new), "tool-done")
        wait = cut(wait.join(new.select("k"), "k", "left_anti"), "tool-wait")
    behind = links.join(done.select(F.col("k").alias("to"), "rank"), "to").select("k", (F.col("rank") + F.col("d")).alias("rank"))
    ranks = done.unionByName(behind).select(F.col("k").alias("__k"), F.col("rank").cast("int").alias("rank"))
    return calls.withColumn("__c", F.when(F.col("first"), key)).join(ranks, F.col("__c") == F.col("__k"), "left").drop("__c", "__k")


def format_chat(messages: DataFrame, schemas: DataFrame, part_turns: int | None = PART_TURNS) -> DataFrame:
    """One row per conversation and run of part_turns turns, or per conversation if that is None: conv_id, part, n_messages, n_calls, n_linked, n_pending, n_duplicate,
    n_orphan, n_invalid, n_circular, json.  So an endless conversation becomes many rows; linking knows no parts.
    """
    part = (F.when(F.col("turn") < 0, F.lit(-1)).otherwise(F.floor(F.col("turn") / part_turns)) if part_turns else F.lit(0)).cast("long").alias("part")
    msgs, calls, results = events(messages.select("conv_id", "turn", "role", "text"))
    linked, back = link(validate(calls, schemas), results)
    linked, back = cut(linked, "tool-linked"), cut(back, "tool-back")
    ranked = cut(topological(linked), "tool-ranked")
    errors = F.array_join(F.transform("errors", json_string), ",")
    opt = lambda name, c: F.concat(F.lit(f'"{name}":'), F.coalesce(c, F.lit("null")))
    call = F.concat(
        F.lit("{"), opt("arguments", F.col("json")), F.lit(","), F.lit('"errors":['), errors, F.lit("],"), opt("id", json_string(F.col("id"))), F.lit(","), opt("name", json_string(F.col("name"))), F.lit(","),
        opt("rank", F.col("rank").cast("string")), F.lit(","), opt("result", json_string(F.col("result"))), F.lit(","), opt("state", json_string(F.col("state"))), F.lit("}"),
    )
    count = lambda c: F.count_if(c)
    per_call = ranked.groupBy("conv_id", part).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("r"), "turn", "pos", call.alias("j")))), lambda x: x["j"]), ",").alias("cj"),
        F.count("*").alias("n_calls"), count(F.col("state") == "linked").alias("n_linked"), count(F.col("state") == "pending").alias("n_pending"), count(F.col("state") == "duplicate").alias("n_duplicate"),
        count(F.size("errors") > 0).alias("n_invalid"), count(F.col("first") & F.col("rank").isNull()).alias("n_circular"),
    )
    per_result = back.groupBy("conv_id", part).agg(count(F.col("state") == "orphan").alias("n_orphan"))
    msg = F.concat(F.lit("{"), opt("content", json_string(F.col("content"))), F.lit(","), opt("role", json_string(F.col("role"))), F.lit("}"))
    # results are told by their calls; only orphans would be lost otherwise, and they are counted
    per_msg = msgs.groupBy("conv_id", part).agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", msg.alias("j")))), lambda x: x["j"]), ",").alias("mj"))
    a = per_call.withColumnsRenamed({"conv_id": "c1", "part": "p1"})
    b = per_result.withColumnsRenamed({"conv_id": "c2", "part": "p2"})
    same = lambda c, p: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("part") == F.col(p))
    out = per_msg.join(a, same("c1", "p1"), "left").join(b, same("c2", "p2"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    conv = F.coalesce(json_string(F.col("conv_id")), F.lit("null"))
    whole = F.concat(F.lit('{"calls":['), F.coalesce("cj", F.lit("")), F.lit('],"conv_id":'), conv, F.lit(',"messages":['), "mj", F.lit('],"part":'), F.col("part").cast("string"), F.lit("}"))
    return out.select("conv_id", "part", "n_messages", *[zero(c) for c in ("n_calls", "n_linked", "n_pending", "n_duplicate", "n_orphan", "n_invalid", "n_circular")], whole.alias("json"))


#: Schema of the one tool by which turns_as_calls() reads plain conversations.
REPLY = {"reply": {"required": ["prompt", "turn"], "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}}}


def turns_as_calls(messages: DataFrame) -> DataFrame:
    """Plain conversations as tool traces: a user's turn calls ``reply`` with the turn's text and waits for the user turn
    before it; the assistant's next turn is the result.  Texts that are tool events already, and system turns, stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = ~F.ltrim(text).startswith("{")
    name = lambda t: F.concat(F.lit("c"), F.coalesce(t.cast("string"), F.lit("")))
    turn = F.col("turn")
    call = F.to_json(F.struct(F.lit("").alias("content"), F.array(F.struct(name(turn).alias("id"), F.lit("reply").alias("name"), F.struct(text.alias("prompt"), turn.alias("turn")).alias("arguments"), F.when(turn >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), text.alias("content")))
    role = F.when(plain & (F.col("role") == "assistant"), "tool").otherwise(F.col("role"))
    return messages.select("conv_id", "turn", role.alias("role"), F.when(plain & (F.col("role") == "user"), call).when(plain & (F.col("role") == "assistant"), result).otherwise(F.col("text")).alias("text"))
