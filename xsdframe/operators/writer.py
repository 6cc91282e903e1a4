"""From typed structs to XML text, as Spark expressions.

Prefixes are given out once for a plan: ns0, ns1, ... in the order of the schema's
fields; a document declares those that it uses, the root's own first. Attributes equal to their default are
left out, elements never. Objects that carry a recorded order are written in it if their
counts still match, else in schema order with open content at its wildcard's place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column

from ..functions import F, let
from ..ir import Wildcard
from ..plans.shapes import BOUND, EXTRA, NIL, ORDER, TAG, TYPE, Part, Shape, Slot
from ..qname import XML, XSI, split
from .opencontent import py_escape


def escape_text(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def escape_attribute(c: Column) -> Column:
    c = F.replace(escape_text(c), F.lit('"'), F.lit("&quot;"))
    c = F.replace(c, F.lit("'"), F.lit("&apos;"))
    return F.replace(F.replace(c, F.lit("\t"), F.lit("&#x9;")), F.lit("\n"), F.lit("&#xA;"))


class Writer:
    """Writes one plan's documents. raw: with a raw column beside, a leaf's original text is
    written again where it still means the value."""

    def __init__(self, root: str, slot: Slot):
        self.root, self.slot = root, slot
        self.prefixes: dict[str, str] = {}
        self._names(slot)
        self.tag(root)

    def _names(self, slot: Slot) -> None:
        for shape in slot.shapes:
            if shape.selector:
                self.tag(shape.selector)
            for part in shape.parts:
                if part.slot.kind != "absent":
                    if part.field.kind != "text":
                        self.tag(part.field.qname)
                    for member, _ in part.slot.leaf_tags:
                        self.tag(member)
                    self._names(part.slot)

    def tag(self, name: str) -> str:
        """A Clark name with this document's prefix."""
        namespace, local = split(name)
        if not namespace:
            return local
        if namespace == XML:
            return f"xml:{local}"
        if namespace not in self.prefixes:
            self.prefixes[namespace] = f"ns{len(self.prefixes)}"
        return f"{self.prefixes[namespace]}:{local}"

    def declared(self, body: Column) -> Column:
        """The declarations of the namespaces that a document's text uses, the root's own first.
        (A text that looks like a use only declares one too many.)"""
        own = split(self.root)[0]
        out = []
        for namespace in sorted(self.prefixes, key=lambda n: n != own):
            prefix = self.prefixes[namespace]
            said = F.lit(f' xmlns:{prefix}="{py_escape(namespace, True)}"')
            uses = [F.contains(body, f"<{prefix}:"), F.contains(body, f" {prefix}:"), F.contains(body, f'"{prefix}:')]
            out.append(said if namespace == own else F.when(uses[0] | uses[1] | uses[2], said).otherwise(""))
        return F.concat(*out, F.when(F.contains(body, " xsi:"), F.lit(f' xmlns:xsi="{XSI}"')).otherwise(""))

    def leaf(self, part: Part, v: Column, raw: Column | None) -> Column:
        plan = part.slot.simple
        if part.field.fixed is not None:  # its only lexical, as the schema has it
            return F.when(v.isNotNull(), F.lit(part.field.fixed))
        text = plan.text(v)
        if raw is not None:
            told = raw if part.field.kind != "element" else raw["v"]
            text = F.when(told.isNotNull() & plan.value(told).eqNullSafe(v), told).otherwise(text)
        # A prefix that the document's own could be is written as another.
        return F.regexp_replace(text, OWN_PREFIX, "q$1:") if part.binds else text

    def escaped(self, part: Part, v: Column, raw: Column | None, escape) -> Column:
        """The leaf's text, escaped if its type's lexicals can have characters that need it."""
        text = self.leaf(part, v, raw)
        return text if part.slot.simple.clean else escape(text)

    def element(self, name: str, part: Part, v: Column, nil: Column, raw: Column | None, told: Column | None = None) -> Column:
        """One occurrence, or null if it is absent. told: the substituted tag of a leaf."""
        if part.slot.kind == "open":
            return v["xml"]
        fixed = self.tag(name)
        if told is None:
            begin, end, empty = F.lit(f"<{fixed}>"), F.lit(f"</{fixed}>"), F.lit(f'<{fixed} xsi:nil="true"/>')
        else:
            cases = F.when(told.isNull(), fixed)
            for member, _ in part.slot.leaf_tags:
                cases = cases.when(told == member, self.tag(member))
            tag = cases.otherwise(fixed)
            begin, end, empty = F.concat(F.lit("<"), tag, F.lit(">")), F.concat(F.lit("</"), tag, F.lit(">")), F.concat(F.lit("<"), tag, F.lit(' xsi:nil="true"/>'))
        if part.slot.kind == "leaf":
            body = F.concat(begin, self.escaped(part, v, raw, escape_text), end)
        else:
            body = self.object(name, part.slot, v, raw)
        return F.when(nil, empty).when(v.isNotNull(), body) if part.field.nillable else F.when(v.isNotNull(), body)

    def occurrence(self, part: Part, raws: Column | None, tags: Column | None, keyed: bool):
        """A function of a repeated element's value and index giving its text, or keyed, its piece."""

        def piece(x: Column, i: Column) -> Column:
            nil = x.isNull() & F.lit(part.field.nillable)
            told = None if tags is None else F.get(tags, i)
            xml = self.element(part.field.qname, part, x, nil, None if raws is None else F.get(raws, i), told)
            return _piece(part, i, xml) if keyed else xml

        return piece

    def object(self, name: str, slot: Slot, v: Column, raw: Column | None) -> Column:
        if len(slot.shapes) == 1:
            return self.shape(name, slot, slot.shapes[0], v, raw)
        if slot.by_tag:
            out = None
            for shape in slot.shapes:
                text = self.shape(shape.selector, slot, shape, v, raw)
                out = F.when(v[TAG] == shape.selector, text) if out is None else out.when(v[TAG] == shape.selector, text)
            return out
        out = F.when(v[TYPE].isNull(), self.shape(name, slot, slot.shapes[0], v, raw))
        for shape in slot.shapes:
            if shape.selector:
                out = out.when(v[TYPE] == shape.selector, self.shape(name, slot, shape, v, raw, F.lit(f' xsi:type="{self.tag(shape.selector)}"')))
        # A type that the schema does not know: as declared, with all that was read besides.
        space, rest = F.regexp_extract(v[TYPE], r"\A\{(.*)\}", 1), F.regexp_extract(v[TYPE], r"([^}]*)\z", 1)
        bound = F.when(space == "", F.concat(F.lit(' xsi:type="'), rest, F.lit('"'))).otherwise(
            F.concat(F.lit(' xmlns:xt="'), escape_attribute(space), F.lit('" xsi:type="xt:'), rest, F.lit('"'))
        )
        return out.otherwise(self.shape(name, slot, slot.shapes[0], v, raw, bound, True))

    def shape(self, name: str, slot: Slot, shape: Shape, v: Column, raw: Column | None, more: Column | None = None, swept: bool = False) -> Column:
        tag = self.tag(name)
        inside = lambda p: None if raw is None else raw[p.column]
        attrs, text, empty = [], F.lit(""), []
        for part in shape.parts:
            if part.slot.kind == "absent":
                continue
            if part.field.kind == "attribute":
                written = self.leaf(part, v[part.column], inside(part))
                shown = written if part.slot.simple.clean else escape_attribute(written)
                here = F.concat(F.lit(f' {self.tag(part.field.qname)}="'), shown, F.lit('"'))
                if part.field.default is not None:
                    same = part.slot.simple.comparable(written) == part.slot.simple.comparable(F.lit(part.field.default))
                    here = F.when(~F.coalesce(same, F.lit(False)), here)
                attrs.append(F.coalesce(here, F.lit("")))
            elif part.field.kind == "text":
                text = F.coalesce(self.escaped(part, v[part.column], inside(part), escape_text), F.lit(""))
                empty.append(text == "")
        if slot.binds:
            written = F.transform(F.map_entries(v[BOUND]), _declaration)
            attrs.append(F.coalesce(F.array_join(written, ""), F.lit("")))
        replay = slot.ordered and (shape.ordered or swept)
        pieces: list[_Pieces] = []
        for part in [p for p in shape.parts if p.field.kind == "element"]:
            if part.slot.kind == "absent":
                pieces.append(_Pieces())
                continue
            tags = v[part.column + TAG] if part.slot.leaf_tags else None
            if part.repeated:
                pieces.append(_Pieces(many=F.transform(v[part.column], self.occurrence(part, inside(part), tags, replay))))
                empty.append(F.coalesce(F.size(v[part.column]), F.lit(0)) < 1)
            else:
                nil = F.coalesce(v[part.column + NIL], F.lit(False)) if part.field.nillable else F.lit(False)
                xml = self.element(part.field.qname, part, v[part.column], nil, inside(part), tags)
                empty.append(v[part.column].isNull() & ~nil if part.field.nillable else v[part.column].isNull())
                pieces.append(_Pieces(one=_piece(part, F.lit(0), xml) if replay else xml))
        extra_attrs = F.lit("")
        if shape.wild or swept:
            extra = v[EXTRA]
            extra_attrs = F.coalesce(extra["attributes"], F.lit(""))
            empty.append(F.coalesce(F.size(extra["elements"]), F.lit(0)) < 1)
            anys = [w for w in shape.wild if w.kind == "any"] or [Wildcard("any", at=len(pieces))]
            for k, w in reversed(list(enumerate(anys))):  # from the back, so places stay right
                found = F.filter(extra["elements"], _bucket(anys, k)) if len(anys) > 1 else extra["elements"]
                pieces.insert(min(w.at, len(pieces)), _Pieces(many=found if replay else F.transform(found, lambda x: x["xml"])))
        if replay:
            parts = F.filter(F.concat(*_arrays(pieces)), lambda x: x["xml"].isNotNull())
            body = let(F.struct(parts.alias("p"), v[ORDER].alias("o")), _replayed)
        else:
            texts = [F.coalesce(p.one if p.one is not None else F.array_join(p.many, ""), F.lit("")) for p in pieces if p.any()]
            body = F.concat(*texts) if texts else F.lit("")
        head = F.concat(F.lit(f"<{tag}"), *([more] if more is not None else []), *attrs, extra_attrs)
        nothing = reduce(lambda a, b: a & b, empty) if empty else F.lit(True)
        return F.concat(head, F.when(nothing, "/>").otherwise(F.concat(F.lit(">"), text, body, F.lit(f"</{tag}>"))))

    def document(self, v: Column, raw: Column | None = None) -> Column:
        """The whole document; null for a null value."""
        tag = self.tag(self.root)
        if self.slot.kind == "leaf":
            text = F.concat(F.lit(f"<{tag}>"), escape_text(self.slot.simple.text(v)), F.lit(f"</{tag}>"))
        elif self.slot.kind == "open":
            return v["xml"]
        else:
            text = self.object(self.root, self.slot, v, raw)
        start = len(tag) + 2  # behind the root's name
        return F.when(v.isNotNull(), let(text, lambda x: F.concat(F.lit(f"<{tag}"), self.declared(x), F.substr(x, F.lit(start)))))


@dataclass
class _Pieces:
    """What one field writes: a column for a single one, or an array of them."""

    one: Column | None = None
    many: Column | None = None

    def any(self) -> bool:
        return self.one is not None or self.many is not None


def _piece(part: Part, index: Column, xml: Column) -> Column:
    return F.struct(F.lit(part.column).alias("key"), index.alias("index"), xml.alias("xml"))


def _arrays(pieces: list[_Pieces]) -> list[Column]:
    """The pieces as arrays, single ones side by side in one."""
    out: list[Column] = []
    alone: list[Column] = []
    for p in [*pieces, None]:
        if p is not None and p.one is not None:
            alone.append(p.one)
        elif p is None or p.any():
            if alone:
                out.append(F.array(*alone))
                alone = []
            if p is not None:
                out.append(F.coalesce(p.many, F.array()))
    return out or [F.array()]


#: What the document's own prefixes look like.
OWN_PREFIX = r"\A\s*(ns[0-9]+|xsi|xt):"


def _declaration(e: Column) -> Column:
    """Of a prefix that values use; xml needs none."""
    prefix = F.when(F.concat(e["key"], F.lit(":")).rlike(OWN_PREFIX), F.concat(F.lit("q"), e["key"])).otherwise(e["key"])
    return F.when(e["key"] != "xml", F.concat(F.lit(" xmlns:"), prefix, F.lit('="'), escape_attribute(e["value"]), F.lit('"')))


def _bucket(anys: list[Wildcard], k: int):
    """Whether an extra element goes to the k-th wildcard: the first that takes its namespace,
    or the first of all if none does."""

    def takes(w: Wildcard, space: Column) -> Column:
        if w.namespaces == "##any":
            return F.lit(True)
        if w.namespaces == "##other":
            return ~space.isin("", w.target)
        names = {"##targetNamespace": w.target, "##local": ""}
        return space.isin([names.get(n, n) for n in w.namespaces.split()])

    def test(x: Column) -> Column:
        space = F.regexp_extract(x["key"], r"\A\{(.*)\}", 1)
        which = F.when(takes(anys[0], space), 0)
        for n, w in enumerate(anys[1:], 1):
            which = which.when(takes(w, space), n)
        return which.otherwise(0) == k

    return test


def _replayed(b: Column) -> Column:
    """The pieces in the recorded order, if it names each exactly once; else as they are."""
    parts, order = b["p"], b["o"]
    found = lambda o: F.filter(parts, lambda x: (x["key"] == o["key"]) & (x["index"] == o["index"]))
    fits = (F.size(parts) == F.size(order)) & F.forall(order, lambda o: F.size(found(o)) == 1)
    plain = F.transform(parts, lambda x: x["xml"])
    replay = F.transform(order, lambda o: F.get(found(o), F.lit(0))["xml"])
    return F.array_join(F.when(F.coalesce(fits, F.lit(False)), replay).otherwise(plain), "")
