"""Chat rendering over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The system turn that is put before conversations without one.
DEFAULT_SYSTEM = "You answer briefly and truthfully."


def _line(template: str, role: Column, text: Column) -> Column:
    if template == "chatml":
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    if template == "llama3":
        return F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"), text, F.lit("<|eot_id|>"))
    if template == "generic":
        return F.when(role == "system", F.concat(F.lit("<|system|>\n"), text, F.lit("\n"))).when(role == "user", F.concat(F.lit("<|user|>\n"), text, F.lit("\n<|assistant|>\n"))).otherwise(F.concat(text, F.lit("\n")))
    raise ValueError(template)


# What asks for the assistant's answer.
_ASK = {"chatml": "<|im_start|>assistant\n", "llama3": "<|start_header_id|>assistant<|end_header_id|>\n\n", "generic": ""}


def render(messages: DataFrame, template: str = "chatml") -> DataFrame:
    """(conv_id, prompt): a conversation is one output row, its turns in order."""
    e = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    body = F.array_join(F.transform("m", lambda x: _line(template, x["role"], x["text"])), "")
    return e.select("conv_id", F.concat(body, F.lit(_ASK[template])).alias("prompt"))


def inject_system(messages: DataFrame, prompt: str = DEFAULT_SYSTEM) -> DataFrame:
    """A system turn -1 for conversations without a system role."""
    has = messages.where("role = 'system'").select("conv_id").distinct()
    new = messages.select("conv_id").distinct().join(has, "conv_id", "left_anti")
    return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(new.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(prompt).alias("text")))


_REQUEST = "model string, messages array<struct<role:string,content:string>>, prompt string, max_tokens int, temperature double, top_p double, top_k int, stream boolean, seed bigint"


def requests(bodies: DataFrame, body_col: str = "body", max_tokens: int = 256, temperature: float = 0.7, top_p: float = 0.9, top_k: int = 50) -> DataFrame:
    """Request bodies as columns, with presets where a field is missing."""
    r = bodies.withColumn("r", F.from_json(body_col, _REQUEST))
    or_ = lambda c, d: F.coalesce(F.col(f"r.{c}"), F.lit(d)).alias(c)
    return r.select(or_("model", "default"), F.col("r.messages").alias("messages"), F.col("r.prompt").alias("prompt"), or_("max_tokens", max_tokens), or_("temperature", temperature), or_("top_p", top_p), or_("top_k", top_k), or_("stream", False), F.col("r.seed").alias("seed"))


def next_token_pairs(rows: DataFrame, id_col: str, text_col: str, vocab: int = 256) -> DataFrame:
    """(id, pos, input, target): each byte modulo vocab and the byte after it; texts of fewer than two bytes give none."""
    b = F.transform(F.regexp_extract_all(F.hex(F.encode(F.col(text_col), "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int") % vocab)
    r = rows.where(F.octet_length(text_col) >= 2).select(F.col(id_col).alias("id"), b.alias("b"))
    pairs = F.zip_with(F.slice("b", F.lit(1), F.size("b") - 1), F.slice("b", F.lit(2), F.size("b") - 1), lambda x, y: F.struct(x.alias("input"), y.alias("target")))
    return r.select("id", F.posexplode(pairs).alias("pos", "p")).select("id", "pos", "p.input", "p.target")


def response_id(prefix: str, ts: Column) -> Column:
    """prefix-, whole seconds, and six digits of microseconds of a time."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.concat(F.lit(prefix + "-"), F.unix_seconds(ts.cast("timestamp")).cast("string"), F.lpad((us % 1_000_000).cast("string"), 6, "0"))


def visible_tokens(tokens: DataFrame, key: str = "conv_id", budget: int = 100) -> DataFrame:
    """tokens (key, pos, text) -> the rows a client sees: what lies between <think> and </think> is held back, tags that
    tokens cut included, but no more than ``budget`` tokens of a block; tokens go in order within a key.

    A token in which a block opens or closes is held back whole, as is the one with which the budget ends.
    """
    e = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("e"))
    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("inside"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        seen = F.concat(s["tail"], x["text"])
        after = F.when(s["inside"], seen).otherwise(F.substring(seen, F.instr(seen, "<think>") + 7, F.length(seen)))
        opens = ~s["inside"] & F.contains(seen, F.lit("<think>"))
        closes = (s["inside"] | opens) & F.contains(after, F.lit("</think>"))
        n = F.when(s["inside"], s["n"] + 1).otherwise(0)
        inside = (s["inside"] | opens) & ~closes & (n <= budget)
        tail = F.when(opens & ~closes, F.right(after, F.lit(7))).when(closes | (s["inside"] & ~inside), F.lit("")).otherwise(F.right(seen, F.lit(7)))
        return F.struct(tail.alias("tail"), inside.alias("inside"), n.cast("int").alias("n"), F.array_append(s["out"], ~s["inside"] & ~opens).alias("out"))

    z = e.withColumn("shown", F.aggregate("e", start, step)["out"])
    return z.select(key, F.explode(F.arrays_zip("e", "shown")).alias("z")).where("z.shown").select(key, "z.e.pos", "z.e.text")
