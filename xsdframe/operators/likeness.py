"""Documents of the same markup are read by one regular expression.

Most documents of a column differ from others in values alone. A document that has been read
in full becomes a template: its markup as it stands, with a group for each attribute value and
each text of an element without children. What such a value is has no part in how a document is
read (names, xsi attributes, nil, namespaces and white space between elements stay as they are in
the template), and the groups take no character that a parser would treat specially. So a text
that matches is read as the template was, with its own values in their places. All others are
read in full.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from ..plans.shapes import Slot

#: Templates of one number of tags and quotes, templates of one reader, and the groups and
#: characters of a template: documents beyond are read in full.
ALIKE, KEPT, GROUPS, LENGTH = 8, 512, 400, 20_000
#: Documents that become no template, after which no more are tried.
VAIN = 64

# Characters that a parser refuses or makes others of; surrogates count as such.
_ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f\ud800-\udfff\ufffe\uffff]")
_TEXT, _VALUE = "([^<>&]*)", '([^<>&"\t\n]*)'
_TAG = re.compile(r'<(/?)([^\s/<>"\'=&!?]+)((?:[ \t\n]+[^\s/<>"\'=&]+="[^"<&]*")*)[ \t\n]*(/?)>')
_ATTRIBUTE = re.compile(r'([^\s/<>"\'=&]+)="([^"<&]*)"')
_OPEN, _CLOSE = "\ue000", "\ue001"  # private, so in hardly any document
_MARKED = re.compile(f"{_OPEN}([0-9]+){_CLOSE}")


def told_by_markup(slot: Slot) -> bool:
    """Whether no value has a part in how a document is read: names with prefixes have."""
    return slot.kind != "object" or not (slot.binds or any(not told_by_markup(p.slot) for s in slot.shapes for p in s.parts))


def cut(xml: str) -> list[str] | None:
    """A document as markup and values in turn, markup first and last; None if it has other
    markup than elements and quoted attributes."""
    if len(xml) > LENGTH or _OPEN in xml or _CLOSE in xml or "<!" in xml or "<?" in xml:
        return None
    pieces, held, at, opened = [], [], 0, False
    for tag in _TAG.finditer(xml):
        closing, name, attributes, empty = tag.groups()
        between = xml[at : tag.start()]
        if "<" in between or ("&" in between and not (closing and opened)):
            return None
        if closing and opened:
            pieces += ["".join(held), between]
            held = []
        else:
            held.append(between)
        start = tag.start()
        for a in _ATTRIBUTE.finditer(xml, tag.start(3), tag.end(3)) if attributes else ():
            if a[1] != "xmlns" and ":" not in a[1]:
                held.append(xml[start : a.start(2)])
                pieces += ["".join(held), a[2]]
                held, start = [], a.end(2)
        held.append(xml[start : tag.end()])
        at, opened = tag.end(), not closing and not empty
    pieces.append("".join(held) + xml[at:])
    return pieces if len(pieces) < 2 * GROUPS else None


def pattern_of(pieces: list[str]) -> re.Pattern:
    out = []
    for k, piece in enumerate(pieces):
        quoted = k % 2 and pieces[k - 1].endswith('"')
        out.append((_VALUE if quoted else _TEXT) if k % 2 else re.escape(piece))
    return re.compile("".join(out))


class _Group(int):
    """The place of a value that a document has of its own."""


def _placed(value):
    """What a marked document was read as, with groups for marks; ValueError where a mark has
    become part of something else."""
    if isinstance(value, dict):
        return {k: _placed(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_placed(v) for v in value]
    if isinstance(value, str) and (_OPEN in value or _CLOSE in value):
        found = _MARKED.fullmatch(value)
        if not found:
            raise ValueError(value)
        return _Group(found[1])
    return value


def _column(kind: pa.DataType, parts: list, values: list[tuple], n: int) -> pa.Array:
    """For each of n documents the parts in turn, as an array."""
    if all(p is None for p in parts):
        return pa.nulls(n * len(parts), kind)
    missing = [p is None for p in parts]
    mask = pa.array(missing * n, pa.bool_()) if any(missing) else None
    if pa.types.is_struct(kind):
        inner = [_column(f.type, [None if p is None else p.get(f.name) for p in parts], values, n) for f in kind]
        return pa.StructArray.from_arrays(inner, fields=list(kind), mask=mask)
    if pa.types.is_list(kind):
        ends = np.cumsum(np.tile([len(p or ()) for p in parts], n), dtype=np.int32)
        inner = _column(kind.value_type, list(chain.from_iterable(p or () for p in parts)), values, n)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), inner, type=kind, mask=mask)
    if len(parts) == 1:
        (p,) = parts
        return pa.array(values[p], kind) if isinstance(p, _Group) else pa.repeat(pa.scalar(p, kind), n)
    if not any(isinstance(p, _Group) for p in parts):
        return pa.array(parts * n, kind)
    return pa.array(list(chain.from_iterable(zip(*(values[p] if isinstance(p, _Group) else repeat(p, n) for p in parts)))), kind)


class Reader:
    """Reads columns of documents. read: one text to {doc, error}, in full; kind: the type of that."""

    def __init__(self, read: Callable[[str | None], dict | None], kind: pa.DataType, slot: Slot):
        self.read, self.kind = read, kind
        self.templates: dict[tuple[int, int], list[tuple[re.Pattern, int]]] = {}
        self.bodies: list = []
        self.vain = 0 if told_by_markup(slot) else VAIN

    def learn(self, xml: str, key: tuple[int, int], full: dict | None) -> None:
        known = self.templates.setdefault(key, [])
        if len(known) >= ALIKE or len(self.bodies) >= KEPT or full is None or full["error"] is not None:
            return
        self.vain += 1
        pieces = cut(xml)
        if pieces is None:
            return
        pattern = pattern_of(pieces)
        marked = "".join(f"{_OPEN}{k // 2}{_CLOSE}" if k % 2 else p for k, p in enumerate(pieces))
        try:
            body = _placed(self.read(marked))
        except ValueError:
            return
        if body["error"] is None:
            known.append((pattern, len(self.bodies)))
            self.bodies.append(body)
            self.vain -= 1

    def __call__(self, texts: list[str | None]) -> pa.Array:
        rows: list[list[int]] = [[] for _ in self.bodies]
        found: list[list[tuple]] = [[] for _ in self.bodies]
        others, whole = [], []
        templates = self.templates
        for at, xml in enumerate(texts):
            key = None
            if xml is not None and self.bodies and (xml.isascii() and xml.isprintable() or not _ODD.search(xml)):
                key = (xml.count("<"), xml.count('"'))
                for pattern, k in templates.get(key, ()):
                    if (m := pattern.fullmatch(xml)) is not None:
                        rows[k].append(at)
                        found[k].append(m.groups())
                        break
                else:
                    k = -1
                if k >= 0:
                    continue
            full = self.read(xml)
            others.append(at)
            whole.append(full)
            if xml is not None and self.vain < VAIN:
                self.learn(xml, key or (xml.count("<"), xml.count('"')), full)
                rows += [[] for _ in self.bodies[len(rows) :]]
                found += [[] for _ in self.bodies[len(found) :]]
        parts, order = [pa.array(whole, self.kind)], [others]
        for body, at, groups in zip(self.bodies, rows, found):
            if at:
                parts.append(_column(self.kind, [body], list(zip(*groups)), len(at)))
                order.append(at)
        if len(parts) == 1:
            return parts[0]
        joined = pa.concat_arrays(parts)
        places = np.fromiter(chain.from_iterable(order), np.int64, len(texts))
        back = np.empty(len(texts), np.int64)
        back[places] = np.arange(len(texts))
        return joined.take(pa.array(back))
