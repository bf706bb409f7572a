"""Byte-level BPE: the tokenizer is sent to the tasks; the distinct pieces of a slice of texts are merged once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.text import PRETOKEN


@lru_cache(1)
def byte_chars() -> list[str]:
    """Printable stand-ins for the 256 bytes: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {}, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


@dataclass
class Tokenizer:
    vocab: dict[str, int]
    merges: dict[tuple[str, str], int]
    specials: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        d = json.loads(text)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
        return cls(d["model"]["vocab"], {p: i for i, p in enumerate(pairs)}, {t["content"]: t["id"] for t in d.get("added_tokens", [])})

    def piece(self, chars: str) -> list[int]:
        """Merges the best-ranked pair, the leftmost of equals, until none is left; unknown symbols are 0."""
        parts = list(chars)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.merges.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.merges:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.vocab.get(p, 0) for p in parts]

    def encode(self, text: str) -> list[int]:
        import regex

        table = byte_chars()
        out: list[int] = []
        marks = sorted(self.specials, key=len, reverse=True)  # longer ones first, so overlaps have one reading
        split = regex.split("(" + "|".join(map(regex.escape, marks)) + ")", text) if marks else [text]
        for part in split:
            if part in self.specials:
                out.append(self.specials[part])
            else:
                for p in regex.findall(PRETOKEN, part):
                    out += self.piece("".join(table[b] for b in p.encode()))
        return out

    def decode(self, ids: list[int]) -> str:
        back = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        byte = {c: b for b, c in enumerate(byte_chars())}
        data = b"".join(bytes(byte.get(c, 63) for c in back.get(i, "<unk>")) for i in ids)
        return data.decode(errors="replace")


#: Pieces whose merges a task keeps, the longest of them, and bytes of texts that are cut into pieces at once.
KNOWN, KNOWN_CHARS, SLICE_BYTES = 200_000, 64, 1 << 20


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of at most so many bytes of text, or of one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(size):
        upto = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")), at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def encode(rows: DataFrame, tokenizer: Tokenizer, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens) of each row; null texts have no tokens.

    Special tokens are cut out first, the longest at a place.  A slice's pieces become a dictionary of distinct ones, each is
    merged once, and the ids of all pieces are one gather: no loop over tokens.  A task holds a slice of SLICE_BYTES (or one
    text) and KNOWN short pieces, however many rows and distinct pieces there are.
    """
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        tok, table = shared.value, byte_chars()
        marks = sorted(tok.specials, key=lambda m: (-len(m), m))
        pattern = regex.compile("|".join([*map(regex.escape, marks), PRETOKEN]) if marks else PRETOKEN)
        cut = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        known: dict[str, list[int]] = {m: [i] for m, i in tok.specials.items()}

        def pieces(text: str | None) -> list[str]:
            if not text:
                return []
            if cut is None or not cut.search(text):
                return pattern.findall(text)
            # a piece must not reach into a special token: what lies between is split by itself
            return [p for part in cut.split(text) for p in ([part] if part in tok.specials else regex.findall(PRETOKEN, part))]

        for batch in (x for whole in it for x in slices(whole, SLICE_BYTES)):
            lists = [pieces(t) for t in batch.column("text").to_pylist()]
            size = np.array([len(x) for x in lists], np.int64)
            coded = pa.array([p for x in lists for p in x], pa.string()).dictionary_encode()
            del lists
            names = coded.dictionary.to_pylist()
            if len(known) + len(names) > KNOWN:
                known = {m: [i] for m, i in tok.specials.items()}
            ids = []
            for p in names:
                if (x := known.get(p)) is None:
                    x = tok.piece("".join(table[b] for b in p.encode()))
                    if len(p) <= KNOWN_CHARS:
                        known[p] = x
                ids.append(x)
            n = np.array([len(x) for x in ids], np.int64)
            flat = np.array([i for x in ids for i in x], np.int32)
            first = np.cumsum(n) - n
            at = coded.indices.to_numpy()
            out = flat[np.arange(n[at].sum()) + np.repeat(first[at] - (np.cumsum(n[at]) - n[at]), n[at])] if len(at) else flat[:0]
            upto = np.concatenate([[0], np.cumsum(n[at])])[np.concatenate([[0], np.cumsum(size)])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(out))], ["id", "tokens"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tokens array<int>")


def token_names(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """(…, token): names of ids by a join; <unk> where there is none."""
    return ids.join(F.broadcast(vocab), "token_id", "left").withColumn("token", F.coalesce("token", F.lit("<unk>")))
