"""Requests in bulk, stored responses, tokens of whole batches."""

import json
import random

import pyarrow as pa
import pytest

from loam.functions import bpe
from loam.operators import requests
from loam.sources import responses


def test_requests_are_answered_in_bulk(spark):
    rooms = spark.createDataFrame([("w:a", "w", "A"), ("w:b", "w", 'B"'), ("v:c", "v", "C")], "id string, wing_id string, name string")
    kg = spark.createDataFrame([(2, "x", "z", "causes"), (1, "x", "y", "supports")], "edge_seq long, from_id string, to_id string, relation string")
    call = lambda name, args, i=1: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": args}})
    bodies = {
        "rooms": call("palace_list_rooms", {"wing_id": "w"}), "twice": call("palace_list_rooms", {"wing_id": "w"}, "s"), "none": call("palace_list_rooms", {"wing_id": "?"}),
        "edges": call("palace_kg_query", {"from_id": "x"}), "missing": call("palace_kg_query", {"from_id": 3}), "noargs": '{"jsonrpc":"2.0","method":"tools/call","params":{"name":"palace_kg_query"}}',
        "tool": call("fly", {}), "list": '{"jsonrpc":"2.0","id":[1],"method":"tools/list"}', "method": '{"jsonrpc":"2.0","id":null,"method":"go \\"on\\""}',
        "bad": "{", "null": None, "empty": "", "array": "[]", "version": '{"jsonrpc":2.0,"id":5,"method":"initialize"}', "params": '{"jsonrpc":"2.0","id":7,"method":"tools/call"}',
        "name": '{"jsonrpc":"2.0","id":7,"method":"tools/call","params":{"name":1}}', "nullparams": '{"jsonrpc":"2.0","id":7,"method":"tools/call","params":null}', "init": '{"jsonrpc":"2.0","id":7,"method":"initialize"}',
    }
    df = spark.createDataFrame(list(bodies.items()), "seq string, body string")
    got = {x.seq: json.loads(x.response) for x in requests.answer(df, requests.store_routes(rooms, kg)).collect()}
    assert len(got) == len(bodies) and all(x["jsonrpc"] == "2.0" for x in got.values())
    codes = {k: x["error"]["code"] for k, x in got.items() if "error" in x}
    assert codes == {"method": -32601, "bad": -32700, "null": -32700, "empty": -32700, "array": -32600, "version": -32600, "params": -32602, "name": -32602, "nullparams": -32602}
    assert got["method"]["error"]["message"] == 'Method not found: go "on"' and got["method"]["id"] is None and got["version"]["id"] is None
    text = lambda k: got[k]["result"]["content"][0]["text"]
    assert json.loads(text("rooms")) == json.loads(text("twice")) == {"rooms": [{"id": "w:a", "name": "A"}, {"id": "w:b", "name": 'B"'}]} and got["twice"]["id"] == "s"
    assert json.loads(text("none")) == {"rooms": []} and json.loads(text("edges")) == {"edges": [{"relation": "supports", "to": "y"}, {"relation": "causes", "to": "z"}]}
    assert [(text(k), got[k]["result"]["isError"]) for k in ("missing", "noargs", "tool")] == [("Missing required parameter: from_id", True)] * 2 + [("Unknown tool: fly", True)]
    assert got["list"]["id"] == [1] and got["list"]["result"] == {"tools": []}
    assert requests.answer(df.limit(0), requests.store_routes(rooms, kg)).count() == 0


def test_shared_lists_meet_their_calls_by_shuffle(spark):
    """They grow with the tables, so they are never gathered for a broadcast, and each moves once."""
    rooms = spark.createDataFrame([("w:a", "w", "A")], "id string, wing_id string, name string")
    kg = spark.createDataFrame([(1, "x", "y", "supports")], "edge_seq long, from_id string, to_id string, relation string")
    body = '{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"palace_kg_query","arguments":{"from_id":"x"}}}'
    out = requests.answer(spark.createDataFrame([(1, body), (2, body)], "seq long, body string"), requests.store_routes(rooms, kg))
    assert "SortMergeJoin [__tool" in out._jdf.queryExecution().executedPlan().toString() and out.select("response").distinct().count() == 1


def test_chunks_in_pieces_of_any_size():
    r = random.Random(0)
    for _ in range(200):
        body = r.randbytes(r.randrange(0, 60))
        raw, at = b"", 0
        while at < len(body):
            n = r.randrange(1, 20)
            part = body[at : at + n]
            raw += b"%x%s\r\n" % (len(part), r.choice([b"", b";a=b", b" "])) + part + b"\r\n"
            at += n
        raw += b"0\r\n\r\n"
        assert responses.Chunks().feed(raw).body() == body
        c, step = responses.Chunks(), r.randrange(1, 9)
        for i in range(0, len(raw), step):
            c.feed(raw[i : i + step], last=i + step >= len(raw))
        assert c.body() == body and c.done
    assert responses.Chunks().feed(b"5\r\nabc").body() == b"" and responses.Chunks().feed(b"3\r\nabc").body() == b"abc" and responses.Chunks().feed(b"zz\r\nabc").body() == b""


def test_responses_are_decoded_and_followed(spark):
    rows = [(1, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\nX: a:b\r\n\r\nabcdef"), (2, b"HTTP/1.1 404\r\n\r\n\xff\x00"), (3, b"nothing"), (4, None), (5, b"HTTP/1.1 xx\r\n\r\n"), (6, b"HTTP/1.1 200 \xff\r\n\r\n"), (7, b"HTTP/1.0 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n2\r\nok\r\n0\r\n\r\n")]
    got = {x.id: x for x in responses.decode(spark.createDataFrame(rows, "id long, raw binary"), "id", "raw").collect()}
    assert bytes(got[1].body) == b"abc" and [tuple(h) for h in got[1].headers] == [("content-length", "3"), ("x", "a:b")]
    assert (got[2].status, bytes(got[2].body), bytes(got[7].body)) == (404, b"\xff\x00", b"ok") and all(got[i].error and got[i].status is None for i in (3, 4, 5, 6))
    chain = [(f"http://h/{i}", 302, [{"name": "location", "value": f"/{i + 1}"}], b"") for i in range(8)] + [("http://h:80/8", 200, [], b"end"), ("http://h/loop", 301, [{"name": "location", "value": "http://h/loop"}], b""), ("http://h/x", 302, [], b"no place")]
    told = spark.createDataFrame(chain, "url string, status int, headers array<struct<name:string,value:string>>, body binary")
    asked = spark.createDataFrame([(0, "http://h/0"), (3, "http://h/3"), (4, "http://h/loop"), (5, "http://h/x"), (6, "http://gone/")], "id long, url string")
    out = {x.id: (x.url, x.hops, x.status) for x in responses.follow(asked, told).collect()}
    assert out == {0: ("http://h:80/5", 5, 302), 3: ("http://h:80/8", 5, 200), 4: ("http://h:80/loop", 5, 301), 5: ("http://h:80/x", 0, 302), 6: ("http://gone:80/", 0, None)}


@pytest.mark.parametrize("known", [500_000, 3])
def test_tokens_equal_one_text_at_a_time(spark, monkeypatch, known):
    monkeypatch.setattr(bpe, "KNOWN", known)
    chars = bpe.byte_chars()
    pairs = [("t", "h"), ("th", "e"), ("a", "a"), ("aa", "a"), ("Ġ", "the")]
    vocab = {c: i for i, c in enumerate(chars)} | {a + b: 256 + i for i, (a, b) in enumerate(pairs)}
    tok = bpe.Tokenizer(vocab, {p: i for i, p in enumerate(pairs)}, {"<s>": 900, "<s><s>": 901, "the": 902})
    texts = [None, "", "the cat's <s><s><s> aaaaa", "x<s>y", "  the   é✓\n\n the", "thethe<s"] * 3
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "id string, text string")
    got = {x.id: x.tokens for x in bpe.encode(df, tok, "id", "text").collect()}
    assert got == {f"r{i}": tok.encode(t or "") for i, t in enumerate(texts)}


def test_texts_are_cut_into_pieces_a_slice_at_a_time(spark, monkeypatch):
    """A batch of any size goes by in slices of few bytes, with the same tokens."""
    texts = ["abc de", None, "", "é" * 30, "x y z", "", "abc de", "q"] * 5
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = list(bpe.slices(batch, 12))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 12 for p in parts) and len(parts) > 10
    monkeypatch.setattr(bpe, "SLICE_BYTES", 12)
    tok = bpe.Tokenizer({c: i for i, c in enumerate(bpe.byte_chars())}, {})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    assert {x.id: x.tokens for x in bpe.encode(df, tok, "id", "text").collect()} == {i: tok.encode(t or "") for i, t in enumerate(texts)}


def test_lists_are_gathered_in_ranges(spark, monkeypatch):
    """A key's list is made of texts of ranges of a few rows each, in order, nulls as in one list; and long rows are written one by one."""
    import json

    from pyspark.sql import functions as F

    from loam.operators import requests

    monkeypatch.setattr(requests, "PIECE", 3)
    rows = [(i, str(i % 3) if i % 10 else "9", None if i % 7 == 0 else f'r"{i}', i * 7 % 5) for i in range(40)]
    kg = spark.createDataFrame(rows, "edge_seq long, from_id string, relation string, to_id long").repartition(5, "to_id")
    got = {x.key: x.list for x in requests._listed(kg, "from_id", "edge_seq", F.struct("relation", F.col("to_id").alias("to"))).collect()}
    want = {k: [{"relation": r, "to": t} if r is not None else {"to": t} for _, f, r, t in rows if f == k] for k in "0129"}
    assert {k: json.loads(x) for k, x in got.items()} == want and all(" " not in x for x in got.values())
    bodies = spark.createDataFrame([(1, '{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"palace_kg_query","arguments":{"from_id":"2"}}}')], "seq long, body string")
    rooms = spark.createDataFrame([], "id string, wing_id string, name string")
    answer = json.loads(requests.answer(bodies, requests.store_routes(rooms, kg)).first().response)
    assert json.loads(answer["result"]["content"][0]["text"]) == {"edges": want["2"]}
    assert spark.conf.get("parquet.page.size.row.check.min") == "1"
