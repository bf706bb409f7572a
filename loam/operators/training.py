"""Small tensor and training operators, on numpy; metrics come back as rows."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class AdamW:
    lr: float = 0.01
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8
    decay: float = 0.01
    t: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], clip: float | None = 1.0) -> float:
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        scale = clip / norm if clip and norm > clip else 1.0
        self.t += 1
        for k, p in params.items():
            g = grads[k] * scale
            self.m[k] = self.b1 * self.m.get(k, 0) + (1 - self.b1) * g
            self.v[k] = self.b2 * self.v.get(k, 0) + (1 - self.b2) * g * g
            mh, vh = self.m[k] / (1 - self.b1**self.t), self.v[k] / (1 - self.b2**self.t)
            p -= self.lr * (mh / (np.sqrt(vh) + self.eps) + self.decay * p)
        return norm


class Mlp:
    """Token embedding, a hidden layer, logits over the vocabulary."""

    def __init__(self, vocab: int = 256, dim: int = 32, hidden: int = 64, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.1, (vocab, dim)), "w1": r.normal(0, dim**-0.5, (dim, hidden)), "w2": r.normal(0, hidden**-0.5, (hidden, vocab))}

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        e = self.p["embed"][x]
        h = np.maximum(e @ self.p["w1"], 0)
        z = h @ self.p["w2"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        n = np.arange(len(y))
        loss = float(-np.log(np.maximum(q[n, y], 1e-12)).mean())
        d = q
        d[n, y] -= 1
        d /= len(y)
        g = {"w2": h.T @ d}
        dh = (d @ self.p["w2"].T) * (h > 0)
        g["w1"] = e.T @ dh
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x, dh @ self.p["w1"].T)
        return loss, g


def train(spark: SparkSession, texts: list[str], epochs: int = 5, lr: float = 0.01, seed: int = 0) -> DataFrame:
    """(epoch, loss, grad_norm) of a byte model over a batch of sampled texts (bounded by the batch)."""
    data = [np.frombuffer(t.encode(), np.uint8).astype(int) for t in texts]
    pairs = [(t[:-1], t[1:]) for t in data if len(t) > 1]
    net, opt, rows = Mlp(seed=seed), AdamW(lr), []
    for epoch in range(epochs):
        total, norm = 0.0, 0.0
        for x, y in pairs:
            loss, g = net.loss(x, y)
            norm = opt.step(net.p, g)
            total += loss
        rows.append((epoch, total / max(len(pairs), 1), norm))
    return spark.createDataFrame(rows, "epoch int, loss double, grad_norm double")


def epoch_feedback(losses: list[float]) -> bool | None:
    """Whether a batch's rows get positive feedback: did the last loss fall?  None before two epochs."""
    return None if len(losses) < 2 else losses[-1] < losses[-2]


def deep_supervision(losses: DataFrame, key: str, seq: str, loss: str, gamma: float = 0.5) -> DataFrame:
    """(key, total): losses weighted by gamma ** (steps from the last)."""
    e = losses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(loss).alias("l")))).alias("e"))
    return e.select(key, F.aggregate("e", F.lit(0.0), lambda acc, x: acc * gamma + x["l"]).alias("total"))


def rms_norm(x: np.ndarray, w: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * w


def rope(x: np.ndarray, pos: int, base: float = 10000.0) -> np.ndarray:
    half = x.shape[-1] // 2
    a = pos * base ** (-np.arange(half) / half)
    c, s = np.cos(a), np.sin(a)
    p, q = x[..., :half], x[..., half:]
    return np.concatenate([p * c - q * s, p * s + q * c], -1)


@dataclass
class Lora:
    a: np.ndarray
    b: np.ndarray
    alpha: float

    @classmethod
    def new(cls, n_in: int, n_out: int, rank: int, alpha: float = 16.0, seed: int = 0) -> Lora:
        return cls(np.random.default_rng(seed).normal(0, 0.02, (n_in, rank)), np.zeros((rank, n_out)), alpha)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.a @ self.b * (self.alpha / self.a.shape[1])


def half_floats(raw: bytes, kind: str) -> np.ndarray:
    """f16 or bf16 bytes as float32."""
    u = np.frombuffer(raw, np.uint16)
    return u.view(np.float16).astype(np.float32) if kind == "F16" else (u.astype(np.uint32) << 16).view(np.float32)


def tensor_file(tensors: dict[str, np.ndarray]) -> bytes:
    """A safetensors file of float32 tensors: header length, JSON header, raw little-endian values."""
    head, body = {}, b""
    for name, x in tensors.items():
        raw = np.ascontiguousarray(x, "<f4").tobytes()
        head[name] = {"dtype": "F32", "shape": list(np.shape(x)), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    text = json.dumps(head).encode()
    return struct.pack("<Q", len(text)) + text + body


def _headers(data: bytes) -> tuple[int, dict]:
    (n,) = struct.unpack_from("<Q", data)
    return 8 + n, {k: t for k, t in json.loads(bytes(data[8 : 8 + n])).items() if k != "__metadata__"}


def tensor_headers(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) -> (path, name, dtype, shape, start, end) of the tensors in a safetensors file."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(path, name, t["dtype"], t["shape"], *t["data_offsets"]) for path, data in zip(pdf.path, pdf.content, strict=True) for name, t in _headers(data)[1].items()]
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "start", "end"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, dtype string, shape array<long>, start long, end long")


def tensor_values(files: DataFrame) -> DataFrame:
    """binaryFile rows -> (path, name, shape, values) as float32, a row per tensor; F32, F16 and BF16, others raise."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, data in zip(pdf.path, pdf.content, strict=True):
                at, head = _headers(data)
                for name, t in head.items():
                    if t["dtype"] not in ("F32", "F16", "BF16"):
                        raise ValueError(f"{name}: {t['dtype']} is not read")
                    a, b = t["data_offsets"]
                    raw = bytes(data[at + a : at + b])
                    x = np.frombuffer(raw, "<f4") if t["dtype"] == "F32" else half_floats(raw, t["dtype"])
                    yield pd.DataFrame({"path": [path], "name": [name], "shape": [t["shape"]], "values": [x]})

    return files.select("path", "content").mapInPandas(run, "path string, name string, shape array<long>, values array<float>")


class Validator:
    """Recursive validator of causal claims.

    A claim's text and the mean of its evidence feed z <- tanh(Wz z + Wx x + Wy y) for ``depth`` rounds; the head's score is
    combined with the prior and scaled by the amount of evidence.  Evidence against goes through a second cell: above
    ``against`` the verdict is a contradiction.  Weights are seeded, not trained.
    """

    def __init__(self, dim: int = 256, hidden: int = 256, depth: int = 6, passing: float = 0.65, against: float = 0.35, seed: int = 42):
        r = np.random.default_rng(seed)
        cell = lambda: (r.normal(0, hidden**-0.5, (hidden, hidden)), r.normal(0, dim**-0.5, (hidden, dim)), r.normal(0, dim**-0.5, (hidden, dim)))
        self.cells, self.heads = (cell(), cell()), r.normal(0, hidden**-0.5, (2, hidden))
        self.dim, self.depth, self.passing, self.against = dim, depth, passing, against

    def encode(self, text: str) -> np.ndarray:
        b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int64)
        h = np.concatenate([b[:-1] * 31 + b[1:], b[:-2] * 961 + b[1:-1] * 31 + b[2:]]) if len(b) > 1 else b[:0]
        v = np.bincount(h % self.dim, minlength=self.dim).astype(float)
        return v / max(np.sqrt((v * v).sum()), 1e-8)

    def pool(self, items: list[str]) -> np.ndarray:
        return np.mean([self.encode(t) for t in items], 0) if len(items) else np.zeros(self.dim)

    def score(self, which: int, x: np.ndarray, y: np.ndarray) -> float:
        wz, wx, wy = self.cells[which]
        u, z = wx @ x + wy @ y, np.zeros(len(wz))
        for _ in range(self.depth):
            z = np.tanh(wz @ z + u)
        return float(1 / (1 + np.exp(-self.heads[which] @ z)))

    def __call__(self, cause: str, effect: str, evidence: list[str] = (), contra: list[str] = (), prior: float = 0.5) -> tuple[str, float]:
        x = self.encode(f"{cause} causes {effect}")
        if len(contra) and (c := self.score(1, x, self.pool(contra))) > self.against:
            return "contradiction", c
        p, q = (min(max(v, 0.001), 0.999) for v in (prior, self.score(0, x, self.pool(evidence))))
        n = len(evidence)
        quality = min(1.0, 0.5 + 0.5 * min(np.log(n), 2.0) / 2) if n else 0.5
        got = float(min(max(p * q / (p * q + (1 - p) * (1 - q)) * quality, 0.0), 1.0))
        return ("pass" if got >= self.passing else "fail"), got

    def chain(self, nodes: list[str], evidence: list[str] = ()) -> tuple[str, float]:
        """Link by link, each with the confidence so far as its prior; the first link that does not pass ends it."""
        sure = 1.0
        for a, b in zip(nodes, nodes[1:], strict=False):
            verdict, c = self(a, b, evidence, prior=sure)
            if verdict != "pass":
                return "fail", c
            sure = float(np.sqrt(sure * c))
        return "pass", sure


def _strings(x) -> list[str]:
    return [] if x is None else [t for t in x if t is not None]


def validate(claims: DataFrame, id_col: str = "id", **options) -> DataFrame:
    """claims (id, cause, effect[, evidence array, contra array, prior]) -> (id, verdict, confidence), in Arrow batches."""
    have = claims.columns
    none = F.array().cast("array<string>")
    c = claims.select(F.col(id_col).cast("long").alias("id"), "cause", "effect", *[(F.col(k) if k in have else none).alias(k) for k in ("evidence", "contra")], (F.col("prior") if "prior" in have else F.lit(0.5)).cast("double").alias("prior"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Validator(**options)
        for pdf in it:
            got = [model(a or "", b or "", _strings(e), _strings(k), 0.5 if p != p or p is None else p) for a, b, e, k, p in zip(pdf.cause, pdf.effect, pdf.evidence, pdf.contra, pdf.prior, strict=True)]
            yield pd.DataFrame({"id": pdf.id, "verdict": [g[0] for g in got], "confidence": [g[1] for g in got]})

    return c.mapInPandas(run, "id long, verdict string, confidence double")


def validate_graph(edges: DataFrame, graph: str = "graph", **options) -> tuple[DataFrame, DataFrame]:
    """edges (id, graph, cause, effect[, evidence]) -> verdicts of the edges, and the mean confidence of each graph."""
    v = validate(edges, "id", **options).join(edges.select(F.col("id").cast("long").alias("id"), graph), "id")
    return v, v.groupBy(graph).agg(F.avg("confidence").alias("confidence"))


def validate_chains(chains: DataFrame, **options) -> DataFrame:
    """chains (id, nodes array[, evidence array]) -> (id, verdict, confidence); fewer than two nodes pass with 1."""
    none = F.array().cast("array<string>")
    c = chains.select(F.col("id").cast("long").alias("id"), "nodes", (F.col("evidence") if "evidence" in chains.columns else none).alias("evidence"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Validator(**options)
        for pdf in it:
            got = [model.chain(_strings(n), _strings(e)) for n, e in zip(pdf.nodes, pdf.evidence, strict=True)]
            yield pd.DataFrame({"id": pdf.id, "verdict": [g[0] for g in got], "confidence": [g[1] for g in got]})

    return c.mapInPandas(run, "id long, verdict string, confidence double")


def traced(fn: Callable[[np.ndarray], float], steps: list[np.ndarray], gamma: float = 0.5) -> float:
    """Supervised loss of a caller's own loss function over intermediate states."""
    total = 0.0
    for x in steps:
        total = total * gamma + fn(x)
    return total
