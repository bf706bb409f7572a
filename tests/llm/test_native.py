"""Mixing, sharding, tool calls: DataFrame functions only."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loam.llm import mixing, sharding, toolcalls


def fill(sizes, share=1.0):
    """Targets by going round until no target is above three times its source's size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, rest = {}, share * sum(sizes.values()), set(order)
    while rest:
        total = sum(weight[s] for s in rest)
        over = {s for s in rest if left * weight[s] / total > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in rest}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        rest -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_targets(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randrange(1, 5) for _ in range(r.randrange(0, 30))), r.choice("aaaaabcdefg") if i % 17 else None) for i in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = fill(sizes)
    taken = defaultdict(int)
    for x in out:
        assert 0 <= x.taken <= 3 * x.size and x.source_size == sizes[x.source]
        assert x.target == pytest.approx(want[x.source])
        taken[x.source] += x.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 30


def test_mix_is_nested_and_repeats(spark):
    rows = spark.createDataFrame([(i, "a b c", "s" if i % 2 else "t") for i in range(400)], "doc_id long, text string, source string")
    small = {x.doc_id: x.times for x in mixing.mix(rows, share=0.3).collect()}
    large = {x.doc_id: x.times for x in mixing.mix(rows, share=0.8).collect()}
    assert all(small[d] <= large[d] for d in small)
    assert large == {x.doc_id: x.times for x in mixing.mix(rows.repartition(7), share=0.8).collect()}


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(i, "a b", "s", 70 + i, "h", 1.5) for i in range(5)], "doc_id long, text string, source string, __size int, __row string, __time double")
    for out in (mixing.mix(df), mixing.mixed_rows(df), sharding.shard(df)):
        assert {x["__size"] for x in out.collect()} == {70, 71, 72, 73, 74} and {(x["__row"], x["__time"]) for x in out.collect()} == {("h", 1.5)}


def test_mix_edges(edge, empty):
    out = mixing.mix(edge)
    assert out.count() == edge.count() and set(edge.columns) <= set(out.columns)
    assert {x.size for x in out.where("text is null").collect()} == {0}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).columns == empty.columns
    assert mixing.mixed_rows(edge).columns == edge.columns
    n = mixing.mix(edge).agg(F.sum("times")).first()[0]
    assert mixing.mixed_rows(edge).count() == n


def split_by_hand(rows, limit):
    """Splits one bucket after the other."""
    out = {}

    def go(part, depth):
        if sum(b for _, b in part) <= limit or depth == 60:
            for h, _ in part:
                out[h] = depth
            return
        go([x for x in part if not x[0] >> (59 - depth) & 1], depth + 1)
        go([x for x in part if x[0] >> (59 - depth) & 1], depth + 1)

    go(rows, 0)
    return out


@pytest.mark.parametrize("limit", [40, 200, 5000, 10**9])
def test_shards_equal_splitting_by_hand(spark, limit, monkeypatch):
    monkeypatch.setattr(sharding, "ROUND_BITS", 3)
    r = random.Random(limit)
    df = spark.createDataFrame([(i, "é" * r.randrange(0, 15)) for i in range(300)], "doc_id long, text string")
    h = {x.doc_id: (x.h, x.b) for x in df.select("doc_id", mixing.row_hash("doc_id", "text").alias("h"), sharding.n_bytes("text").alias("b")).collect()}
    want = split_by_hand(list(h.values()), limit)
    for keep in (True, False):
        out = sharding.shard(df, limit=limit, keep=keep).collect()
        assert {x.doc_id: x.depth for x in out} == {d: want[v[0]] for d, v in h.items()}
        sums = Counter()
        for x in out:
            assert x.shard == format(h[x.doc_id][0], "060b")[: x.depth]
            sums[x.shard] += x.n_bytes
        assert all(sums[x.shard] == x.shard_bytes <= limit for x in out)


def test_shard_edges(edge, empty, spark):
    out = sharding.shard(edge, limit=1000)
    assert out.count() == edge.count() and set(edge.columns) <= set(out.columns)
    big = out.where("oversized").collect()
    assert {x.doc_id for x in big} == {6, 7, 8} and all(x.shard_bytes > 1000 for x in big)
    assert out.where("not oversized").agg(F.max("shard_bytes")).first()[0] <= 1000
    assert sharding.shard(empty).count() == 0
    same = spark.createDataFrame([(1, "abcde")] * 40, "doc_id long, text string")
    got = sharding.shard(same, limit=22).collect()
    assert len(got) == 40 and all(x.shard_bytes <= 22 for x in got) and len({x.shard for x in got}) == 10


CALL = lambda *c: json.dumps({"content": "hm", "tool_calls": list(c)})
RES = lambda i, t: json.dumps({"tool_call_id": i, "content": t})
SCHEMAS = {"add": {"required": ["x"], "properties": {"x": {"type": "integer"}, "mode": {"type": "string", "enum": ["a", "b"]}, "note": {"type": "string", "maxLength": 3}}}}


def chat(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {x.conv_id: (x, json.loads(x.json)) for x in toolcalls.format_chat(df, toolcalls.schema_table(spark, SCHEMAS)).collect()}


def chat_parts(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(x.conv_id, x.part): (x, json.loads(x.json)) for x in toolcalls.format_chat(df, toolcalls.schema_table(spark, SCHEMAS)).collect()}


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", "plain é \"quoted\"\n"),
        (1, 1, "assistant", CALL({"id": "c", "name": "add", "arguments": {"x": 3}, "after": ["b"]}, {"id": "b", "name": "add", "arguments": {"x": "no", "mode": "z", "note": "long!", "q": 1}, "after": ["a", "ghost"]}, {"id": "a", "name": "none", "arguments": {}})),
        (1, 2, "tool", RES("a", "ra")), (1, 3, "tool", RES("a", "again")), (1, 4, "tool", RES("zz", "lost")), (1, 5, "assistant", CALL({"id": "a", "name": "add", "arguments": {"x": 1}})),
        (2, 0, "assistant", CALL({"id": "p", "name": "add", "arguments": {"x": 1}, "after": ["q"]}, {"id": "q", "name": "add", "arguments": {}, "after": ["p"]})), (2, 1, "tool", RES("p", "1")),
    ]
    got = chat(spark, rows)
    x, j = got[1]
    assert [(c["id"], c["rank"], c["state"], c["result"]) for c in j["calls"]] == [("a", 0, "linked", "ra"), ("b", 1, "pending", None), ("c", 2, "pending", None), ("a", None, "duplicate", None)]
    assert j["calls"][1]["errors"] == ["enum:mode", "length:note", "type:x", "unknown:q"] and j["calls"][0]["errors"] == ["tool"]
    assert (x.n_calls, x.n_linked, x.n_orphan, x.n_duplicate, x.n_invalid) == (4, 1, 2, 1, 2)
    assert j["messages"][0]["content"] == rows[0][3]
    x, j = got[2]
    assert x.n_circular == 2 and [c["errors"] for c in j["calls"] if c["id"] == "q"] == [["missing:x"]]
    # canonical: the same text comes back from sorted keys without spaces
    assert all(json.dumps(j, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == x.json for x, j in got.values())


def test_chat_edges(spark):
    got = chat_parts(spark, [(1, None, "user", None), (1, 0, None, "{not json"), (None, 3, "tool", "{}"), (7, 10**6, "user", "late"), (7, 0, "user", "x" * 100_000), (7, 0, "user", "x" * 100_000)])
    assert set(got) == {(1, -1), (1, 0), (None, 0), (7, 0), (7, 10**6 // toolcalls.PART_TURNS)}
    content = {k: [m["content"] for m in j["messages"]] for k, (_, j) in got.items()}
    assert content == {(1, -1): [""], (1, 0): ["{not json"], (None, 0): ["{}"], (7, 0): ["x" * 100_000] * 2, (7, 10**6 // toolcalls.PART_TURNS): ["late"]}
    assert chat_parts(spark, []) == {}


def test_chain_of_calls(spark):
    calls = [{"id": f"k{i}", "name": "add", "arguments": {"x": i}, "after": [f"k{i - 1}"] if i else []} for i in range(12)]
    random.Random(0).shuffle(calls)
    _, j = chat(spark, [(1, 0, "assistant", CALL(*calls))])[1]
    assert [c["id"] for c in j["calls"]] == [f"k{i}" for i in range(12)] and [c["rank"] for c in j["calls"]] == list(range(12))


TYPED = {"t": {"required": ["n"], "properties": {"n": {"type": "integer"}, "s": {"type": "string", "maxLength": 4}, "o": {"type": "object"}, "b": {"type": "boolean"}, "a": {"type": "array"}, "f": {"type": "number", "enum": [1, 2.5, "x"]}}}}


def errors_by_hand(tool, args):
    if tool not in TYPED:
        return ["tool"]
    if args is None:
        args = {}
    if not isinstance(args, dict):
        return ["arguments"]
    kinds = {"integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "string": lambda v: isinstance(v, str), "object": lambda v: isinstance(v, dict), "boolean": lambda v: isinstance(v, bool), "array": lambda v: isinstance(v, list), "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool)}
    out = []
    for k, p in sorted(TYPED[tool]["properties"].items()):
        if k not in args:
            out += ["missing:" + k] if k in TYPED[tool]["required"] else []
        elif not kinds[p["type"]](args[k]):
            out.append("type:" + k)
        elif "enum" in p and args[k] not in p["enum"]:
            out.append("enum:" + k)
        elif isinstance(args[k], str) and len(args[k]) > p.get("maxLength", 99):
            out.append("length:" + k)
    return out + sorted("unknown:" + k for k in args if k not in TYPED[tool]["properties"])


def linked_by_hand(rows):
    """Each conversation's calls in order, and its number of orphans."""
    out = {}
    for conv in {c for c, *_ in rows}:
        calls, results = [], {}
        n_results = 0
        for _, turn, role, text in sorted(x for x in rows if x[0] == conv):
            j = json.loads(text) if text.startswith("{") else {}
            calls += [{"turn": turn, "pos": i, **c} for i, c in enumerate(j.get("tool_calls", []))]
            if role == "tool" and "tool_call_id" in j:
                n_results += 1
                results.setdefault(j["tool_call_id"], []).append((turn, j["content"]))
        first = {}
        for c in calls:
            if c["id"] is not None:
                first.setdefault(c["id"], c)
        rank = {}
        while new := {i: max([rank[r] + 1 for r in c["after"] if r in first], default=0) for i, c in first.items() if i not in rank and all(r in rank for r in c["after"] if r in first)}:
            rank |= new
        got, linked = [], 0
        for c in calls:
            own = first.get(c["id"]) is c
            hit = min(results[c["id"]]) if own and c["id"] in results else None
            linked += hit is not None
            got.append({"arguments": c["arguments"] if c["arguments"] is not None else {}, "errors": errors_by_hand(c["name"], c["arguments"]), "id": c["id"], "name": c["name"], "rank": rank.get(c["id"]) if own else None, "result": hit and hit[1], "state": "duplicate" if not own else "linked" if hit else "pending", "at": (c["turn"], c["pos"])})
        got.sort(key=lambda c: (1 << 30 if c["rank"] is None else c["rank"], c.pop("at")))
        out[conv] = (got, n_results - linked)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_traces_equal_linking_by_hand(spark, seed):
    r = random.Random(seed)
    value = lambda: r.choice([5, -3, "5", "true", True, None, {"k": 1, "a": [1, {"z": None, "b": "é\n"}]}, [], [1, "x"], "long text", 2.5, 1, "x", 10**20])
    rows = []
    for conv in range(30):
        ids = [f"i{k}" for k in range(r.randrange(1, 9))]
        for turn in range(r.randrange(1, 12)):
            if r.random() < 0.3:
                rows.append((conv, turn, "user", "plain"))
            elif r.random() < 0.5:
                rows.append((conv, turn, "tool", RES(r.choice([*ids, "ghost"]), f"r{turn}")))
            else:
                call = lambda: {"id": r.choice([*ids, None]), "name": r.choice(["t", "t", "t", "u"]), "arguments": r.choice([None, [1], "x"]) if r.random() < 0.1 else {k: value() for k in r.sample("nsobafq", r.randrange(0, 6))}, "after": r.sample(ids, min(len(ids), r.randrange(0, 3)))}
                rows.append((conv, turn, "assistant", CALL(*[call() for _ in range(r.randrange(1, 4))])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in toolcalls.format_chat(df, toolcalls.schema_table(spark, TYPED)).collect()}
    want = linked_by_hand(rows)
    for conv, (calls, orphans) in want.items():
        j = json.loads(got[conv].json)
        assert j["calls"] == calls and got[conv].n_orphan == orphans
        assert [type(v) for c in j["calls"] if isinstance(c["arguments"], dict) for v in c["arguments"].values()] == [type(v) for c in calls if isinstance(c["arguments"], dict) for _, v in sorted(c["arguments"].items())]
        assert json.dumps(j, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == got[conv].json


def test_shard_directory_is_a_row_a_shard_and_joins_nothing(spark, monkeypatch):
    """Cells of later rounds can be as many as rows: they are neither joined (Spark would broadcast their levels) nor looked up."""
    plans, keep = [], sharding.cut
    monkeypatch.setattr(sharding, "ROUND_BITS", 3)
    monkeypatch.setattr(sharding, "cut", lambda x, name: plans.append((name, x._jdf.queryExecution().optimizedPlan().toString())) or keep(x, name))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    slim = docs.select(sharding.row_hash("doc_id", "text").alias("h"), sharding.n_bytes("text").alias("n_bytes"))
    rounds, same = sharding._directory(slim, 40)
    assert len(rounds) > 1 and same is None
    for _, found in rounds[1:]:
        assert found.count() == found.select("shard").distinct().count()
    assert not any("Join" in p for name, p in plans if name == "shard-directory")
    out = sharding.shard(docs, limit=40).collect()
    per = {}
    for x in out:
        per.setdefault(x.shard, []).append(x.n_bytes)
        assert x.shard_bytes <= 40 and x.depth == len(x.shard)
    assert len(out) == 600 and all(x.shard_bytes == sum(per[x.shard]) and x.shard_rows == len(per[x.shard]) for x in out)
