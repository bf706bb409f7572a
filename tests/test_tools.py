"""The cycle and the store's tools; validator, beliefs, tensors, generators, streamed answers against plain versions."""

import hashlib
import hmac
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import chat, corpus, ooda, provenance, stats, training
from loam.tools import Store, ToolError


def test_cycle(spark):
    obs = spark.createDataFrame([(0, "s", '{"t": 4.0, "co2": 9.0, "x": "no"}'), (1, "s", "Smoking causes cancer. rain leads to floods")], "seq long, source string, content string")
    h = ooda.orient(obs)
    got = {(x.seq, x.cause, x.effect) for x in h.collect()}
    assert got == {(0, "co2", "t"), (1, "smoking", "cancer"), (1, "rain", "floods")}
    hyp = spark.createDataFrame([(0, "a", "b", 0.9), (1, "a", "b", 0.9), (2, "c", "d", 0.1), (3, "", "d", 0.9), (4, "e", "f", 0.5), (5, "k", "l", 0.8)], "seq long, cause string, effect string, confidence double")
    known = spark.createDataFrame([("k → l",)], "title string")
    acc = ooda.decide(hyp, known, min_novelty=0.3).orderBy("seq").collect()
    assert [x.title for x in acc] == ["a → b", "e → f"]
    assert acc[0].novelty == pytest.approx(1 - 2 / 6) and acc[0].quality == pytest.approx(0.6 * 0.9 + 0.4 * acc[0].novelty)
    assert ooda.decide(hyp, known, min_novelty=0.9).count() == 0
    d = spark.createDataFrame([("T", "text", [("a", "b", 0.5)], 0.876)], "title string, description string, claims array<struct<cause:string,effect:string,confidence:double>>, quality double")
    assert ooda.render(d).first().entry == "# T\ntext\n## Claims\n- a → b (0.50)\nquality: 0.88"


def test_branching(spark):
    rows = [(1, i, 0.5, [0.0, 1.0]) for i in range(12)] + [(2, i, 0.1 * i, [0.0, 1.0]) for i in range(8)] + [(3, i, 0.97, [0.5, 0.5]) for i in range(8)]
    x = spark.createDataFrame(rows, "key int, step int, ratio double, losses array<double>")
    got = {(r.key, r.step): r for r in ooda.branching(x).collect()}
    assert [s for (k, s), r in sorted(got.items()) if r.branch] == list(range(5, 12)) and all(k == 1 for (k, _), r in got.items() if r.branch)
    assert got[1, 5].variance == 0.25 and (got[1, 5].ratio_a, got[1, 5].ratio_b) == (0.4, 0.6)
    assert got[3, 7].plateaued and not got[3, 7].branch and got[3, 7].ratio_b == 0.95
    again = {(r.key, r.step): r.branch for r in ooda.branching(x, reset=True).collect()}
    assert [s for (k, s), b in sorted(again.items()) if b] == [5, 11]  # six more cycles after the first branch


def _plain_verdict(model, cause, effect, evidence, contra, prior):
    """The validator by loops over plain lists."""

    def encode(text):
        b, v = text.lower().encode(), [0.0] * model.dim
        for i in range(len(b) - 1):
            v[(b[i] * 31 + b[i + 1]) % model.dim] += 1
        for i in range(len(b) - 2):
            v[(b[i] * 961 + b[i + 1] * 31 + b[i + 2]) % model.dim] += 1
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n > 1e-8 else v

    def score(which, x, items):
        es = [encode(t) for t in items]
        y = [sum(e[i] for e in es) / len(es) if es else 0.0 for i in range(model.dim)]
        wz, wx, wy = (w.tolist() for w in model.cells[which])
        z = [0.0] * len(wz)
        for _ in range(model.depth):
            z = [math.tanh(sum(a * b for a, b in zip(wz[i], z)) + sum(a * b for a, b in zip(wx[i], x)) + sum(a * b for a, b in zip(wy[i], y))) for i in range(len(wz))]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.heads[which].tolist(), z))))

    x = encode(f"{cause} causes {effect}")
    if contra and score(1, x, contra) > model.against:
        return "contradiction", score(1, x, contra)
    p, q = (min(max(v, 0.001), 0.999) for v in (prior, score(0, x, evidence)))
    c = p * q / (p * q + (1 - p) * (1 - q)) * (0.5 if not evidence else min(1, 0.5 + min(math.log(len(evidence)), 2) / 4))
    return ("pass" if c >= model.passing else "fail"), c


def test_validator(spark):
    rows = [(0, "rain", "floods", ["a b", "wet ground", "more"], [], 0.9), (1, "sun", "rain", [], [], 0.5), (2, "é", "x", ["y"] * 9, ["no", "never"], 0.7), (3, None, "", None, None, None)]
    x = spark.createDataFrame(rows, "id long, cause string, effect string, evidence array<string>, contra array<string>, prior double")
    model = training.Validator(dim=32, hidden=8)
    for r in training.validate(x, dim=32, hidden=8).collect():
        _, a, b, e, k, p = rows[r.id]
        want = _plain_verdict(model, a or "", b or "", e or [], k or [], 0.5 if p is None else p)
        assert r.verdict == want[0] and r.confidence == pytest.approx(want[1])
    edges = spark.createDataFrame([(i, i % 2, f"c{i}", f"e{i}") for i in range(6)], "id long, graph int, cause string, effect string")
    v, g = training.validate_graph(edges, dim=32, hidden=8)
    per = {k: [r.confidence for r in v.collect() if r.graph == k] for k in (0, 1)}
    assert {r.graph: r.confidence for r in g.collect()} == pytest.approx({k: sum(c) / 3 for k, c in per.items()})
    chains = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a"]), (2, [])], "id long, nodes array<string>")
    got = {r.id: (r.verdict, r.confidence) for r in training.validate_chains(chains, dim=32, hidden=8, passing=0.1).collect()}
    sure = 1.0
    for a, b in ("ab", "bc"):
        sure = math.sqrt(sure * _plain_verdict(training.Validator(dim=32, hidden=8, passing=0.1), a, b, [], [], sure)[1])
    assert got[0] == ("pass", pytest.approx(sure)) and got[1] == got[2] == ("pass", 1.0)
    assert training.validate_chains(chains, dim=32, hidden=8, passing=1.1).where("id = 0").first().verdict == "fail"


def test_belief_network(spark):
    empty = spark.createDataFrame([], "node string, alpha double, beta double, confidence double, n_updates int")
    nodes = stats.belief_nodes(empty, spark.createDataFrame([("a", 0.8, 1.0), ("b", None, None)], "node string, mean double, weight double"))
    deps = spark.createDataFrame([("b", "a", 0.5), ("z", "a", 1.0), ("b", "q", 0.6)], "child string, parent string, weight double")
    obs = [("a", 1, 3.0, 1.0), ("a", 2, 0.5, 0.5), ("b", 2, 2.0, 1.0), ("q", 3, 2.0, 1.0)]
    got = {r.node: r for r in stats.observe(nodes, deps.where("child <> 'b'"), spark.createDataFrame(obs, "node string, seq int, lr double, strength double")).collect()}
    want = {"a": [8.0, 2.0, 0], "b": [1.0, 1.0, 0]}

    def update(n, lr, s):
        w = s * max(math.log(1 + n[2]), 1)
        n[0] += lr * w if lr > 1 else w
        n[1] += w if lr > 1 else w / lr
        n[2] += 1

    for node, _, lr, s in obs:
        if node in want:
            update(want[node], lr, s)
    assert {k: [r.alpha, r.beta, r.n_updates] for k, r in got.items()} == {k: pytest.approx(v) for k, v in want.items()}
    only = [o for o in obs if o[0] != "b"]
    got = {r.node: r for r in stats.observe(nodes, deps, spark.createDataFrame(only, "node string, seq int, lr double, strength double")).collect()}
    a, b = [8.0, 2.0, 0], [1.0, 1.0, 0]
    for node, _, lr, s in only:
        if node == "a":
            update(a, lr, s)
            update(b, 1 + (a[0] / (a[0] + a[1]) - 0.5) * 0.5, s / 2)
        else:
            update(b, 1.0, s / 2)
    assert [got["b"].alpha, got["b"].beta, got["b"].n_updates] == pytest.approx(b)
    loop = spark.createDataFrame([("b", "a", 1.0), ("a", "b", 1.0)], "child string, parent string, weight double")
    with pytest.raises(ValueError):
        stats.observe(nodes, loop, spark.createDataFrame(obs, "node string, seq int, lr double, strength double"))


def test_tensor_files(spark):
    x = {"w": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.array([-1.5], np.float32)}
    half = json.dumps({"h": {"dtype": "F16", "shape": [2], "data_offsets": [0, 4]}, "__metadata__": {"k": "v"}}).encode()
    blob = len(half).to_bytes(8, "little") + half + np.array([0.5, -2], np.float16).tobytes()
    files = spark.createDataFrame([("x", training.tensor_file(x)), ("y", blob)], "path string, content binary")
    got = {r.name: (r.shape, r.values) for r in training.tensor_values(files).collect()}
    assert got == {"w": ([2, 3], [0, 1, 2, 3, 4, 5]), "b": ([1], [-1.5]), "h": ([2], [0.5, -2.0])}
    assert {(r.name, r.start, r.end) for r in training.tensor_headers(files).collect()} == {("w", 0, 24), ("b", 24, 28), ("h", 0, 4)}


def test_generators():
    r = corpus.Xorshift(1)
    x = 1
    for _ in range(5):
        x ^= (x << 13) % 2**64
        x ^= x >> 7
        x ^= (x << 17) % 2**64
        assert r.next() == x
    assert 0 <= corpus.Xorshift().unit() < 1


@pytest.mark.parametrize(
    ("tokens", "shown"),
    [
        (["a", "<think>", "b", "</think>", "c"], ["a", "c"]),
        (["<th", "ink>b", "c</thi", "nk>", "d", "<think>x</think>", "e"], ["<th", "d", "e"]),
        (["<think>"] + ["x"] * 5, ["x", "x"]),
        ([], []),
    ],
)
def test_visible_tokens(spark, tokens, shown):
    x = spark.createDataFrame([(1, i, t) for i, t in enumerate(tokens)], "conv_id int, pos int, text string")
    assert [r.text for r in chat.visible_tokens(x, budget=2).orderBy("pos").collect()] == shown


def test_mac(spark):
    r = spark.range(1).select(provenance.mac(b"k" * 100, F.lit("héllo").cast("binary"))).first()[0]
    assert r == hmac.new(b"k" * 100, "héllo".encode(), hashlib.sha256).hexdigest()


def test_tools(spark, tmp_path):
    s = Store(spark)
    assert len(Store.tools()) == 28
    wing = s.call("add_wing", name="Research").first().id
    room = s.call("add_room", wing_id=wing, name="Ants").first().id
    a = s.call("add_drawer", room_id=room, title="paths", content="ants find short paths").first().id
    assert s.call("add_drawer_if_unique", room_id=room, title="again", content="ants find short paths").first().is_new is False
    b = s.call("add_drawer_if_unique", room_id=room, title="other", content="quantum zebra 1234").first()
    assert b.is_new and b.id.endswith(":drawer:1")
    assert s.call("search", query="ants").first().id == a
    s.call("kg_add", from_id=a, to_id=b.id, relation="leads_to")
    s.call("kg_add_temporal", from_id=a, to_id=b.id, relation="supports", ts=1713168000)
    s.call("kg_add", from_id=a, to_id=b.id, relation="contradicts")
    assert s.call("kg_query", from_id=a).where("ts = 1713168000").count() == 1
    assert s.call("kg_contradictions").count() == 1
    assert [x.id for x in s.call("navigate", start=a, goal=b.id).orderBy("pos").collect()] == [a, b.id]
    s.call("deposit_pheromones", drawer_id=a, value=0.8)
    assert s.call("hot_paths").first().pheromone == 0.8
    assert s.call("decay_pheromones").first().average == pytest.approx(0.8 * 0.95 / 2)
    assert s.call("cold_spots").first().drawer_id == b.id
    s.call("create_agent", agent_id="x")
    for i in range(3):
        s.call("diary_write", agent_id="x", text=f"e{i}")
    assert [r.text for r in s.call("diary_read", agent_id="x", n=2).orderBy(F.desc("seq")).collect()] == ["e2", "e1"]
    assert s.call("status").first().n_drawers == 2 and s.call("graph_stats").first().n_edges == 3
    s.save(str(tmp_path / "store"))
    assert Store.load(spark, str(tmp_path / "store")).call("get_taxonomy").first().n_drawers == 2
    with pytest.raises(ToolError):
        s.call("nothing")
    with pytest.raises(ToolError):
        s.call("add_room", wing_id="wing:none", name="x")
