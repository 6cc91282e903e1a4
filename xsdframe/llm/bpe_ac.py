"""Byte-level BPE over an Aho-Corasick automaton.

Bytes are mapped to Latin-1 characters, so that pyahocorasick can hold the vocabulary.
A piece's tokens are found from left to right: take the longest token at the position;
if the token before it would not stand beside it, take a shorter one; if there is none,
step back and shorten the token before. Two tokens may stand side by side if and only if
merging their joined bytes gives these two, which is remembered for each pair; a row of
tokens whose neighbours all agree is exactly what the merges give. Positions from which
nothing led on are marked, so none is tried twice and the time is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, map_slices, pick
from .spans import MANY, SpanEncoder

#: Token pairs whose agreement is remembered; beyond, the memory starts anew.
PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class AhoBpe:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.trie.add_word(b.decode("latin-1"), (len(b), i))
        self.trie.make_automaton()
        self.agree: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids by applying merges in order of rank; used on two joined tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            k = ranked.index(least := min(ranked))
            if least == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def agrees(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.agree.get(pair)
        if known is None:
            if len(self.agree) >= PAIRS:
                self.agree.clear()
            known = self.agree[pair] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.trie.iter(piece.decode("latin-1")):
            at[end - match[0] + 1].append(match)  # the longest of a start comes last
        dead = bytearray(n + 1)
        out: list[int] = []
        tried = [len(at[0])]
        pos, ends = 0, [0]
        agree = self.agree
        while pos < n:
            k, moved = tried[-1], False
            here, left = at[pos], out[-1] if out else -1
            while k:
                k -= 1
                size, token = here[k]
                if not dead[pos + size] and (left < 0 or (known if (known := agree.get((left, token))) is not None else self.agrees(left, token))):
                    moved = True
                    break
            tried[-1] = k
            if moved:
                out.append(token)
                pos += size
                ends.append(pos)
                tried.append(len(at[pos]) if pos < n else 0)
            elif not out:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                dead[pos] = 1
                tried.pop(), ends.pop(), out.pop()
                pos = ends[-1]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_LOADED: dict[tuple[str, str], tuple[AhoBpe, SpanEncoder]] = {}


def loaded(path: str, pattern: str) -> tuple[AhoBpe, SpanEncoder]:
    """The automaton and the encoder of whole texts, one for each Python process.
    pattern: pieces are its matches; texts whose characters the class splitter does not
    cover are split by the pattern itself."""
    key = (path, pattern)
    if key not in _LOADED:
        import regex

        bpe, split = AhoBpe(load_ranks(path)), regex.compile(pattern)
        _LOADED[key] = bpe, SpanEncoder(
            lambda words: [bpe.encode(w.encode()) for w in words],
            lambda text: [i for m in split.finditer(text) for i in bpe.encode(m[0].encode())],
            most=MANY,
        )
    return _LOADED[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>) of each row; null and empty texts have no ids."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, count = loaded(path, pattern)[1].encode(part.column(1).to_pylist())
        ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        return pa.record_batch(
            [part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"]
        )

    return map_slices(pick(docs, id, text).toDF("doc_id", "text"), "text", work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary); a null list decodes to null."""

    def run(batches):
        for batch in batches:
            bpe = loaded(path, pattern)[0]
            out = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, its ids are
    decoded, and both are digested where they are made, so neither leaves the worker. Null
    texts are empty; repeated rows come out each; an empty table gives an empty result."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe, encoder = loaded(path, pattern)
        ids, count = encoder.encode(part.column(1).to_pylist())
        flat, ends = ids.tolist(), np.concatenate(([0], np.cumsum(count))).tolist()
        shown = list(map(str, flat))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return pa.record_batch(
            [
                part.column(0).cast(pa.int64()),
                pa.array(count),
                pa.array([sha(" ".join(shown[a:b]).encode()) for a, b in zip(ends, ends[1:])]),
                pa.array([sha(bpe.decode(flat[a:b])) for a, b in zip(ends, ends[1:])]),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = pick(docs, id, text).toDF("doc_id", "text").select(F.col("doc_id"), F.col("text"))
    return map_slices(rows, "text", work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 2 * SLICE_BYTES)
