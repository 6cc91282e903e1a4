"""Chat formatting with loss masks aligned by character offsets.

A conversation is rendered once, as a whole: each turn stands between control strings
that say its role; control strings inside texts are escaped by a backslash, as are
backslashes, so any text comes back exactly. The rendered text is encoded once with
offsets, which follow from the bytes that each token stands for. Spans of assistant text and the tokens' character spans are both sorted, so
binary search finds the tokens of each span; a token that reaches past the text keeps
the part of it that lies inside, and the mask is exact to the character.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HALF_SLICE, map_slices, pick, tune
from .spans import tokenizer_encoder

# Fixed values of this template: role, opening, closing.
OPEN = {"user": "[INST] ", "assistant": "<s> ", "system": "<<SYS>> "}
CLOSE = {"user": " [/INST]\n", "assistant": " </s>\n", "system": " <</SYS>>\n"}
OTHER = ("[ROLE] ", " [/ROLE][TEXT] ", " [/TEXT]\n")
CONTROL = r"\[/?(?:INST|ROLE|TEXT)\]|<</?SYS>>|</?s>"

_ESCAPE = re.compile(rf"\\|{CONTROL}")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_MARK = re.compile(rf"\\.|({CONTROL})", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation of (role, text) turns, and the spans of assistant texts.
    A null role or text is the empty one."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text or "")
        if role in OPEN:
            head, tail = OPEN[role], CLOSE[role]
        else:
            head, tail = OTHER[0] + escape(role or "") + OTHER[1], OTHER[2]
        out += [head, body, tail]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    roles = {"[INST]": "user", "<s>": "assistant", "<<SYS>>": "system"}
    turns, marks = [], [(m.start(), m.end(), m[1]) for m in _MARK.finditer(rendered) if m[1]]
    k = 0
    while k < len(marks):
        if marks[k][2] in roles:
            opened, closed, role = marks[k], marks[k + 1], roles[marks[k][2]]
            k += 2
        elif marks[k][2] == "[ROLE]":
            role = unescape(rendered[marks[k][1] + 1 : marks[k + 1][0] - 1])
            opened, closed = marks[k + 2], marks[k + 3]
            k += 4
        else:
            raise ValueError(f"unexpected {marks[k][2]} at {marks[k][0]}")
        turns.append((role, unescape(rendered[opened[1] + 1 : closed[0] - 1])))
    return turns


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which span, which token, and the part [begin, end) of the token inside the span, for
    each token that meets a span.

    offsets: rows of begin and end. Both lists are sorted, and spans do not overlap. A token
    that meets two spans comes once for each; empty spans meet none.
    """
    begin, end = np.asarray(offsets, np.int64).reshape(-1, 2).T
    a, b = np.asarray(spans, np.int64).reshape(-1, 2).T
    first = np.searchsorted(end, a, side="right")
    last = np.searchsorted(begin, b, side="left")
    n = np.where(a < b, last - first, 0)
    which = np.repeat(np.arange(len(a)), n)
    token = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]
    return which, token, np.maximum(begin[token], a[which]), np.minimum(end[token], b[which])


FORMATTED = (
    "conv_id long, rendered string, ids array<int>, token_begin array<int>, token_end array<int>,"
    " loss_token array<int>, loss_begin array<int>, loss_end array<int>"
)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): a row for each conversation, its turns in order of turn (null first),
    ties by role and text. A conversation is one training sequence, so it is whole; turns
    with a null conv_id are one conversation; repeated rows are turns of their own; an empty
    table has no conversation."""
    turn = F.struct("turn", "role", "text")
    return pick(rows, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


_WIDTHS: dict[str, np.ndarray] = {}


def token_bytes(path: str) -> np.ndarray:
    """How many bytes each id of a byte-level vocabulary stands for: its letters, one a byte.
    Special tokens are ordinary text here and never met."""
    if path not in _WIDTHS:
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        width = np.zeros(max(words.values()) + 1, np.int64)
        width[list(words.values())] = list(map(len, words))
        _WIDTHS[path] = width
    return _WIDTHS[path]


def encode(texts: list[str], tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in a row, how many each text has, and the ids' character spans in the joined
    texts. A token that holds part of a character has all of it in its span."""
    ids, count = tokenizer_encoder(tokenizer, False).encode(texts)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum(token_bytes(tokenizer)[ids])
    if (ends[-1] if len(ends) else 0) != len(data):
        raise ValueError(f"{tokenizer} does not keep every byte")
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    begins = np.concatenate(([0], ends[:-1]))
    return ids, count, np.stack([character[begins], character[ends - 1] + 1], 1) if len(ends) else np.zeros((0, 2), np.int64)


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def _formatted(convs: list[int | None], made: list[tuple[str, list[tuple[int, int]]]], tokenizer: str) -> pa.RecordBatch:
    """FORMATTED of some rendered conversations, which are encoded and aligned together."""
    texts = [text for text, _ in made]
    ids, count, offsets = encode(texts, tokenizer)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base, first = np.cumsum(size) - size, np.cumsum(count) - count
    own = [(a + x, b + x) for (_, spans), x in zip(made, base.tolist()) for a, b in spans]
    owner = np.repeat(np.arange(len(made)), [len(spans) for _, spans in made])
    which, token, a, b = align(offsets, own)
    of = owner[which]
    hits = np.bincount(of, minlength=len(made))
    local = offsets - np.repeat(base, count)[:, None]
    return pa.record_batch(
        [
            pa.array(convs, pa.int64()), pa.array(texts), _lists(ids, count), _lists(local[:, 0], count), _lists(local[:, 1], count),
            _lists(token - first[of], hits), _lists(a - base[of], hits), _lists(b - base[of], hits),
        ],
        [c.split()[0] for c in FORMATTED.split(", ")],
    )


def format(rows: DataFrame, tokenizer: str, most: int = HALF_SLICE) -> DataFrame:
    """FORMATTED for each conversation: the rendered text, its ids and their character
    spans, and the loss mask as token indices with the characters of each that count.
    Conversations are encoded together up to about `most` characters."""
    tune(rows.sparkSession)

    def run(batches):
        for batch in batches:
            convs, made, held = [], [], 0
            for k in range(batch.num_rows):
                turns = batch.column(1)[k].as_py()
                convs.append(batch.column(0)[k].as_py())
                made.append(render([(t["role"], t["text"]) for t in turns]))
                held += len(made[-1][0])
                if held >= most or k + 1 == batch.num_rows:
                    yield _formatted(convs, made, tokenizer)
                    convs, made, held = [], [], 0

    found = conversations(rows)
    return found.select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def covered(text: str, begin: np.ndarray, end: np.ndarray) -> str:
    """The characters under the parts of a mask, in order; each counts once."""
    if not len(begin):
        return ""
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return "".join(text[a:b] for a, b in zip(begin[new].tolist(), reach[np.concatenate((new[1:] - 1, [len(end) - 1]))].tolist()))


def digest(formatted: DataFrame) -> DataFrame:
    """DIGEST of each conversation, from its rendered text and mask: turns parsed from the
    text, the loss text put together from the characters under the mask. A character that
    several tokens share counts once. An empty table gives an empty result."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        marks = part.column(3), part.column(4)
        ends = marks[0].offsets.to_numpy()
        a, b = (m.values.to_numpy() for m in marks)
        shift = marks[1].offsets.to_numpy()[0] - ends[0]
        for k, (conv, text, n) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)))):
            turns = parse(text)
            here = slice(ends[k], ends[k + 1])
            loss = unescape(covered(text, a[here], b[ends[k] + shift : ends[k + 1] + shift]))
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            out.append((conv, len(turns), sha(said), len(loss), sha(loss), len(text), n))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in DIGEST.split(", ")])

    rows = formatted.select("conv_id", "rendered", F.size("ids").alias("n"), "loss_begin", "loss_end")
    return map_slices(rows, "rendered", work, DIGEST)


def with_probe(rows: DataFrame) -> DataFrame:
    """The rows and conversation -1, whose texts are control strings of the template."""
    probe = rows.sparkSession.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    return pick(rows, "conv_id", "turn", "role", "text").unionByName(probe)
