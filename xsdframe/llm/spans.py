"""Splitting whole batches of texts into pre-tokens with array operations, and encoding
each distinct pre-token once.

A byte-pair tokenizer encodes each pre-token (a match of its splitting pattern) by
itself, so a text's ids are its pre-tokens' ids in a row. Here all texts of a slice are
split at once by character classes; an Arrow dictionary finds the distinct pre-tokens;
only those not met before go to the tokenizer; the ids are gathered by index.

Splitting by classes is exact for characters that every Unicode version of the last
twenty years classifies alike (category in 3.2 equal to today's) outside the few
control characters on whose being white space libraries differ. A text with any other
character goes to the tokenizer whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa

OTHER, LETTER, DIGIT, SPACE, ODD = 0, 1, 2, 3, 4
#: Code points whose lower case depends on context or is longer in some libraries.
_ODD_CASE = {0x130, 0x3A3}

_TABLE: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of each code point of the basic plane; all above are ODD."""
    global _TABLE
    if _TABLE is None:
        old, out = unicodedata.ucd_3_2_0.category, np.full(0x10000, ODD, np.uint8)
        kinds = {"L": LETTER, "N": DIGIT, "M": OTHER, "P": OTHER, "S": OTHER}
        for cp in range(0x10000):
            kind = unicodedata.category(c := chr(cp))
            if kind == old(c) and kind[0] in kinds and cp not in _ODD_CASE:
                out[cp] = kinds[kind[0]]
        for c in " \t\n\r":
            out[ord(c)] = SPACE
        _TABLE = out
    return _TABLE


def _suffixes(cps: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the contraction ('s 't 'm 'd 're 've 'll) at each apostrophe of `at`, else 0.
    room: characters left in the text from there."""
    n = len(cps)
    one, two = cps[np.minimum(at + 1, n - 1)], cps[np.minimum(at + 2, n - 1)]
    short = (room >= 2) & np.isin(one, [ord(c) for c in "stmd"])
    e = two == ord("e")
    long = (room >= 3) & (((one == ord("r")) & e) | ((one == ord("v")) & e) | ((one == ord("l")) & (two == ord("l"))))
    return np.where(short, 2, np.where(long, 3, 0))


def _starts(cps: np.ndarray, cls: np.ndarray, first: np.ndarray, gpt: bool) -> np.ndarray:
    """Whether a pre-token starts at each character. first: where texts start.

    gpt: a single blank joins what follows it, and a run of white space before a
    non-space gives up its last character. Else: white space stands apart and each
    digit is a pre-token.
    """
    n = len(cps)
    start = first.copy()
    start[1:] |= cls[1:] != cls[:-1]
    last = np.ones(n, bool)  # of its text
    last[:-1] = first[1:]
    same = np.zeros(n, bool)  # the next character is in the same run
    same[:-1] = ~start[1:]
    alone = start & ~same & (cls == OTHER) & (cps == 0x27) & ~last
    if gpt:
        tail = np.flatnonzero((cls == SPACE) & ~last & ~same)  # white space before a non-space
        start[tail] = True
        start[tail[cps[tail] == 0x20] + 1] = False
    else:
        start |= cls == DIGIT
    marks = np.flatnonzero(alone & start)
    if len(marks):
        ends = np.flatnonzero(last)
        room = ends[np.searchsorted(ends, marks)] - marks + 1
        length = _suffixes(cps, marks, room)
        marks, length = marks[length > 0], length[length > 0]
        start[marks + 1] = False
        after = marks + length
        start[after[after < n]] = True
    return start


class SpanEncoder:
    """Ids of texts, by the pre-tokens' ids.

    encode_words: ids of each of a list of pre-tokens, encoded alone.
    encode_text: ids of one whole text, for texts that classes cannot split.
    lower: texts are normalised to NFC and lower case first, and white space has no ids.
    most: pre-tokens remembered; beyond, the rarest are forgotten.
    """

    def __init__(
        self,
        encode_words: Callable[[list[str]], list[list[int]]],
        encode_text: Callable[[str], list[int]],
        lower: bool = False,
        most: int = 200_000,
    ):
        self.encode_words, self.encode_text, self.lower, self.most = encode_words, encode_text, lower, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.count, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _add(self, words: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        k = len(self.known)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while k + len(words) > len(self.begin):
            self.begin, self.count, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.hits))
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin[k : k + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.count[k : k + len(words)] = sizes
        self.used += len(flat)
        self.known.update(zip(words, range(k, k + len(words))))

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            found = [() if self.lower and w[0] in " \t\n\r" else ids for w, ids in zip(part, self.encode_words(part))]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._add(part, sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))

    def _shrink(self) -> None:
        """Forget the pre-tokens met in the fewest slices; a quarter of the room at most stays taken."""
        hits = self.hits[: len(self.known)].copy()
        least = max(2, int(np.partition(hits, -self.most // 4)[-self.most // 4]) + 1) if len(hits) > self.most // 4 else 2
        old, begin, count, pool = self.known, self.begin, self.count, self.pool
        keep = [(w, k) for w, k in old.items() if hits[k] >= least]
        self._clear()
        at = np.array([k for _, k in keep], np.int64)
        sizes = count[at]
        ids = pool[np.repeat(begin[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        self._add([w for w, _ in keep], sizes, ids)

    def _word_numbers(self, distinct: pa.Array) -> np.ndarray:
        words = distinct.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        if len(self.known) + len(words) > self.most:
            self._shrink()
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([words[i] for i in new.tolist()])
        self.hits[number] += 1
        return number

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pre-tokens, each pre-token's number among them, and how many each text has.
        Texts must hold no ODD character and not be empty."""
        big = "".join(texts)
        cps = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.zeros(len(cps), bool)
        begins = np.cumsum(sizes) - sizes
        first[begins] = True
        start = np.flatnonzero(_starts(cps, char_classes()[cps], first, not self.lower))
        width = np.ones(len(cps), np.int32)
        width += cps >= 0x80
        width += cps >= 0x800
        at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        offsets = np.concatenate((at[start], at[-1:])).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.utf8(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(big.encode())]
        ).dictionary_encode()
        per_text = np.diff(np.concatenate((np.searchsorted(start, begins), [len(start)])))
        return words.dictionary, words.indices.to_numpy(zero_copy_only=False), per_text

    def odd_texts(self, texts: list[str | None]) -> list[int]:
        """Positions of the texts that classes might split otherwise than the pattern does."""
        whole = "".join(t for t in texts if t)
        if self._plain(whole):
            return []
        return [i for i, t in enumerate(texts) if t and not self._plain(t)]

    def _plain(self, text: str) -> bool:
        if text.isascii():
            cps = np.frombuffer(text.encode(), np.uint8)
        else:
            if self.lower and not unicodedata.is_normalized("NFC", text):
                return False
            cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            if cps.max() >= 0x10000:
                return False
        return not (char_classes()[cps] == ODD).any()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and how many each text has. Null and empty texts have none."""
        pieces: list[str] = []
        owner: list[int] = []
        odd = {i: self.encode_text(texts[i]) for i in self.odd_texts(texts)}
        for i, text in enumerate(texts):
            if text and i not in odd:
                for part in cut(text):
                    pieces.append(part.lower() if self.lower else part)
                    owner.append(i)
        total = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.uint32)
        if pieces:
            distinct, which, per_piece = self.split(pieces)
            number = self._word_numbers(distinct)[which]
            count = self.count[number]
            ids = self.pool[np.repeat(self.begin[number] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            ends = np.concatenate(([0], np.cumsum(count)))[np.cumsum(per_piece)]
            np.add.at(total, owner, np.diff(ends, prepend=0))
        if not odd:
            return ids, total
        done, out = np.concatenate(([0], np.cumsum(total))), []
        for i in range(len(texts)):
            out.append(np.array(odd[i], np.uint32) if i in odd else ids[done[i] : done[i + 1]])
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


#: Characters of a text that are split at once.
CUT = 1 << 19


def cut(text: str, most: int = CUT) -> list[str]:
    """The text in pieces of about `most` characters, cut where a pre-token surely starts:
    at a blank after an ASCII letter."""
    if len(text) <= most:
        return [text]
    out, begin = [], 0
    while len(text) - begin > most:
        at, end = -1, begin + most
        while at < 0 and end < len(text):
            p = text.rfind(" ", begin + 1, end)
            while p > begin and not (text[p - 1].isascii() and text[p - 1].isalpha()):
                p = text.rfind(" ", begin + 1, p)
            at = p if p > begin else -1
            end += most
        if at < 0:
            break
        out.append(text[begin:at])
        begin = at
    out.append(text[begin:])
    return out


def byte_letters() -> dict[int, int]:
    """Byte -> the letter that byte-level tokenizers write for it: printable Latin-1 stands
    for itself, the others are counted up from 256."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_LOADED: dict[tuple[str, bool, int], SpanEncoder] = {}


#: Pre-tokens remembered by default, and by tasks that hold little else.
FEW, MANY = 200_000, 400_000


def tokenizer_encoder(path: str, lower: bool, most: int = FEW) -> SpanEncoder:
    """The encoder of a byte-level tokenizers file, one for each Python process, so pre-tokens
    met by earlier tasks are known. Strings of special tokens in a text are ordinary text."""
    key = (path, lower, most)
    if key not in _LOADED:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        tokenize, letters = tok.model.tokenize, byte_letters()
        points = np.array([letters.get(b, b) for b in range(256)], "<u4")

        def encode_words(words: list[str]) -> list[list[int]]:
            """All words' bytes as letters at once: a letter for each byte, so places stay."""
            joined = "".join(words)
            sizes = map(len, words) if joined.isascii() else [len(w.encode()) for w in words]
            shown = points[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
            ends = [0, *accumulate(sizes)]
            return [[t.id for t in tokenize(shown[a:b])] for a, b in zip(ends, ends[1:])]

        _LOADED[key] = SpanEncoder(
            encode_words,
            lambda text: tok.encode(text, add_special_tokens=False).ids,
            lower,
            most,
        )
    return _LOADED[key]


