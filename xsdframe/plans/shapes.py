"""Complex types as trees of slots: what a document's parts are read into.

A slot is a place in the result: a leaf, an object, or open content. An object has one
shape for each type it may have: the declared type, types derived from it (chosen by
xsi:type), or those of the elements that may stand for a substitution head (chosen by
the tag). Their fields share one struct; a field whose type differs between shapes gets
a name of its own. Recursive types are unrolled to a depth; below, content is open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, partial

from pyspark.sql import types as T

from ..errors import XsdFrameError
from ..ir import ComplexType, Element, Field, Schema, Wildcard
from ..qname import XSD, local
from .analyzer import ANY_TYPE, derived_types, substitution_members
from .simple import SimplePlan, SimplePlans

#: Columns beside the declared ones.
TYPE, TAG, EXTRA, ORDER, NIL, BOUND = "xsiType", "__qname", "_extra", "_order", "__nil", "_ns"

#: Open content: as JSON to look into, and as the XML to write again.
OPEN = T.StructType([T.StructField("json", T.StringType()), T.StructField("xml", T.StringType())])
_PIECE = T.StructType([T.StructField("key", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("xml", T.StringType())])
EXTRAS = T.StructType([T.StructField("json", T.StringType()), T.StructField("attributes", T.StringType()), T.StructField("elements", T.ArrayType(_PIECE))])


@dataclass
class Part:
    """A declared field in a shape. column: its name in the struct."""

    field: Field
    column: str
    slot: Slot
    names: list[str]
    forced_optional: bool = False

    @property
    def repeated(self) -> bool:
        return self.field.kind == "element" and self.field.card.repeated

    @property
    def required(self) -> bool:
        return self.field.card.least > 0 and not self.forced_optional

    @property
    def binds(self) -> bool:
        """Whether the value is a name with a prefix."""
        simple = self.slot.simple
        return self.slot.kind == "leaf" and simple.kind == "atomic" and simple.primitive in ("QName", "NOTATION")


@dataclass
class Shape:
    """One type's parts. selector: the xsi:type or tag that chooses it, None for the declared."""

    type: ComplexType
    parts: list[Part]
    selector: str | None = None
    ordered: bool = False

    @property
    def wild(self) -> list[Wildcard]:
        return self.type.wildcards

    @cached_property
    def elements(self) -> list[Part]:
        return [p for p in self.parts if p.field.kind == "element"]

    @cached_property
    def element_names(self) -> set[str]:
        return {p.field.qname for p in self.elements}


@dataclass
class Slot:
    """kind: leaf, object, open or absent (no document has it). An object's shapes are made
    when they are first asked for, so only what is used of a large schema is unrolled."""

    kind: str
    simple: SimplePlan | None = None
    make: Callable[[], list[Shape]] | None = None
    by_tag: bool = False
    leaf_tags: list[tuple[str, SimplePlan]] = field(default_factory=list)
    _made: list[Shape] | None = None

    @property
    def shapes(self) -> list[Shape]:
        if self._made is None:
            self._made = self.make() if self.make else []
        return self._made

    @property
    def polymorphic(self) -> bool:
        return len(self.shapes) > 1 and not self.by_tag

    def columns(self) -> dict[str, Part]:
        out: dict[str, Part] = {}
        for shape in self.shapes:
            for part in shape.parts:
                if part.slot.kind != "absent":
                    out.setdefault(part.column, part)
        return out

    @property
    def wild(self) -> bool:
        """Whether content that no field takes is kept: of wildcards, and of types that the
        schema does not know."""
        return self.polymorphic or any(s.wild for s in self.shapes)

    @property
    def ordered(self) -> bool:
        return self.polymorphic or any(s.ordered for s in self.shapes)

    @property
    def binds(self) -> bool:
        """Whether values of the object are names with prefixes, which must stay bound."""
        return any(p.binds for s in self.shapes for p in s.parts)

    # Spark types

    def spark(self) -> T.DataType:
        """Of the typed value."""
        if self.kind == "leaf":
            return self.simple.spark
        if self.kind == "open":
            return OPEN
        out = []
        for column, part in self.columns().items():
            kind = part.slot.spark()
            meta = {"qname": part.field.qname, "kind": part.field.kind, "type": part.field.type_name}
            meta |= {k: True for k, v in (("open", part.slot.kind == "open"), ("nillable", part.field.nillable), ("qnameValue", part.binds)) if v}
            if part.names[1:]:
                meta["substitutes"] = part.names[1:]
            meta |= {k: v for k, v in (("default", part.field.default), ("fixed", part.field.fixed), ("comment", part.field.doc)) if v is not None}
            out.append(T.StructField(column, T.ArrayType(kind) if part.repeated else kind, True, meta))
            if part.field.nillable and not part.repeated:
                out.append(T.StructField(column + NIL, T.BooleanType()))
            if part.slot.leaf_tags:
                out.append(T.StructField(column + TAG, T.ArrayType(T.StringType()) if part.repeated else T.StringType()))
        return T.StructType(out + self.extras())

    def extras(self) -> list[T.StructField]:
        out = []
        if self.polymorphic:
            out.append(T.StructField(TYPE, T.StringType()))
        if self.by_tag:
            out.append(T.StructField(TAG, T.StringType()))
        if self.binds:
            out.append(T.StructField(BOUND, T.MapType(T.StringType(), T.StringType())))
        if self.wild:
            out.append(T.StructField(EXTRA, EXTRAS))
        if self.ordered:
            out.append(T.StructField(ORDER, T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("index", T.IntegerType())]))))
        return out

    def raw(self) -> T.DataType:
        """Of what the shredder gives: all leaves as strings, with nil flags."""
        if self.kind == "leaf":
            tag = [T.StructField("tag", T.StringType())] if self.leaf_tags else []
            return T.StructType([T.StructField("v", T.StringType()), T.StructField("nil", T.BooleanType()), *tag])
        if self.kind == "open":
            return OPEN
        out = [T.StructField("_nil", T.BooleanType())]
        for column, part in self.columns().items():
            if part.field.kind != "element":
                kind = T.StringType()
            else:
                kind = T.ArrayType(part.slot.raw()) if part.repeated else part.slot.raw()
            out.append(T.StructField(column, kind))
        if len(self.shapes) > 1:
            out.append(T.StructField("_shape", T.IntegerType()))
        return T.StructType(out + self.extras())


class Shaper:
    """Builds slots for a schema."""

    def __init__(self, schema: Schema, simple: SimplePlans, depth: int, paths: set[str] | None = None, seen: set[str] | None = None):
        self.schema, self.simple, self.depth, self.paths, self.seen = schema, simple, depth, paths, seen
        self.members, self.derived = substitution_members(schema), derived_types(schema)

    def root(self, element: Element) -> Slot:
        return self.of_type(element.type_name, (), element.qname, "", substitute=False)

    def wanted(self, path: str) -> bool:
        """Whether a path is asked for, leads to one that is, or lies below one."""
        if self.paths is None:
            return True
        return any(p == path or p.startswith(path + ".") or path.startswith(p + ".") for p in self.paths)

    def of_type(self, name: str, open: tuple[str, ...], tag: str, path: str, substitute: bool = True) -> Slot:
        options = [m for m in self.members.get(tag, []) if m in self.schema.elements] if substitute else []
        if options:
            chosen = [(m, self.schema.elements[m].type_name) for m in options] + [(tag, name)]
            if all(t in self.schema.complex for _, t in chosen):
                return self._object([(t, m) for m, t in chosen], open, path, by_tag=True)
            if not any(t in self.schema.complex for _, t in chosen):
                string = f"{{{XSD}}}string"
                tags = [(m, self.simple.get(t if t != ANY_TYPE else string)) for m, t in chosen]
                return Slot("leaf", tags[-1][1], leaf_tags=tags)
            return Slot("open")
        if name in self.schema.complex:
            derived = [d for d in self.derived.get(name, []) if d in self.schema.complex]
            return self._object([(name, None), *((d, d) for d in derived)], open, path, by_tag=False)
        if name == ANY_TYPE:
            return Slot("open")
        return Slot("leaf", self.simple.get(name))

    def _object(self, types: list[tuple[str, str | None]], open: tuple[str, ...], path: str, by_tag: bool) -> Slot:
        deep = sum(o in {t for t, _ in types} for o in open)
        if deep >= self.depth:
            return Slot("open")
        return Slot("object", make=partial(self._shapes, types, open, path), by_tag=by_tag)

    def _shapes(self, types: list[tuple[str, str | None]], open: tuple[str, ...], path: str) -> list[Shape]:
        shapes: list[Shape] = []
        taken: dict[str, tuple[str, str, bool]] = {}
        for name, selector in types:
            found = self.schema.complex[name]
            forced = optional_groups(found)
            parts = []
            for f in found.fields:
                column, n, mark = f.key, 2, (f.qname, f.type_name, f.card.repeated)
                while taken.setdefault(column, mark) != mark:
                    column, n = f"{f.key}__{local(name)}" + (f"_{n}" if n > 2 else ""), n + 1
                there = f"{path}.{column}" if path else column
                if not self.wanted(there):
                    continue
                if self.seen is not None and there not in self.seen and f.kind != "text" and f.default is None and f.fixed is None:
                    inner = Slot("absent")
                else:
                    inner = self._slot(f, (*open, name), there)
                parts.append(Part(f, column, inner, [f.qname, *self.members.get(f.qname, [])] if f.kind == "element" else [f.qname], f.group in forced))
            shapes.append(Shape(found, parts, selector, order_matters(found, parts)))
        return shapes

    def _slot(self, f: Field, open: tuple[str, ...], path: str) -> Slot:
        if f.kind != "element":
            return Slot("leaf", self.simple.get(f.type_name))
        if f.unknown:
            return Slot("open")
        return self.of_type(f.type_name, open, f.qname, path)


def optional_groups(t: ComplexType) -> set[int]:
    """Choices of several branches, and those inside them: their members may be absent."""
    branches: dict[int, set[int]] = {g: set() for g in t.groups}
    for f in [*t.fields, *t.wildcards]:
        if f.group is not None:
            branches.setdefault(f.group, set()).add(f.branch)
    for outer, branch in t.guards.values():
        branches.setdefault(outer, set()).add(branch)
    out = {g for g, found in branches.items() if len(found) > 1}
    while True:
        more = {g for g, (outer, _) in t.guards.items() if outer in out} - out
        if not more:
            return out
        out |= more


def order_matters(t: ComplexType, parts: list[Part]) -> bool:
    """Whether documents may hold the elements in another order than the schema's."""
    elements = [p for p in parts if p.field.kind == "element"]
    if t.mixed or len(elements) + bool(t.wildcards) < 2:
        return False
    return any(p.repeated for p in elements) or bool(t.groups) or any(w.kind == "any" for w in t.wildcards)


def root_element(schema: Schema, name: str | None) -> Element:
    """A global element by Clark or local name; the only one if no name is told."""
    if name is None:
        if len(schema.elements) != 1:
            raise XsdFrameError(f"say which of {len(schema.elements)} elements is the root", "ambiguous-root")
        return next(iter(schema.elements.values()))
    found = [e for q, e in schema.elements.items() if q == name or local(q) == name]
    if len(found) != 1:
        raise XsdFrameError(f"{len(found)} elements are named {name}", "unknown-root" if not found else "ambiguous-root")
    return found[0]
