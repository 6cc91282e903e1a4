"""The shredder: XML text to a struct of strings, the only step outside the JVM.

It resolves namespaces, matches elements and attributes to declared fields, chooses
shapes by xsi:type or tag, notes nil, order and content that no field takes, and gives
open content as JSON. Everything else (types, facets, choices) is done on its result by
Spark expressions. Fields that a plan leaves out are never built.
"""

from __future__ import annotations

import json
from functools import partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import XsdFrameError
from ..plans.shapes import BOUND, EXTRA, ORDER, TAG, TYPE, Part, Shape, Slot
from ..qname import XSI, prefixed, split
from ..sources.xmltree import Node, decode_xml, parse_xml, repair_tag_names
from . import likeness
from .opencontent import extra_parts, open_value, open_xml

_NIL, _TYPE = f"{{{XSI}}}nil", f"{{{XSI}}}type"


def is_nil(node: Node) -> bool:
    return bool(node.attrs) and node.attrs.get(_NIL, "").strip() in ("true", "1")


def _matches(child: Node, name: str) -> bool:
    namespace, local = split(name)
    own, child_local = split(child.tag)
    return local == child_local and (namespace == own or (not namespace and not child.prefix))


def xsi_type(node: Node) -> str | None:
    told = node.attrs.get(_TYPE)
    if told is None:
        return None
    prefix, local = prefixed(told.strip())
    return f"{{{node.ns.get(prefix, '')}}}{local}"


def _shape(node: Node, slot: Slot) -> int:
    if slot.by_tag:
        return next((k for k, s in enumerate(slot.shapes) if s.selector and _matches(node, s.selector)), len(slot.shapes) - 1)
    told = xsi_type(node) if slot.polymorphic else None
    return next((k for k, s in enumerate(slot.shapes) if s.selector == told), 0) if told else 0


def read_slot(node: Node, slot: Slot):
    if slot.kind == "open":
        value = open_value(node)
        return {"json": json.dumps(value, ensure_ascii=False), "xml": open_xml(node.tag, value)}
    if slot.kind == "leaf":
        nil = is_nil(node)
        out = {"v": None if nil or node.children else node.text, "nil": nil}
        if slot.leaf_tags:  # the head, last, needs no tag
            out["tag"] = next((m for m, _ in slot.leaf_tags[:-1] if _matches(node, m)), None)
        return out
    if is_nil(node):
        return {"_nil": True}
    k = _shape(node, slot)
    told = xsi_type(node) if slot.polymorphic else None
    known = told is None or any(told in (s.selector, s.type.name) for s in slot.shapes)
    out = read_object(node, slot.shapes[k], not known)
    if len(slot.shapes) > 1:
        out["_shape"] = k
    if slot.by_tag:
        out[TAG] = slot.shapes[k].selector
    elif slot.polymorphic:
        out[TYPE] = told if told and told != slot.shapes[0].type.name else None
    return out


def assigned(node: Node, shape: Shape) -> list[tuple[Part, list[int]]]:
    """Which children each element field takes: all with its name, or the first; an exact name
    goes before a substitution."""
    kids, out = node.children, []
    if not kids:
        return [(part, []) for part in shape.elements]
    by_tag: dict[str, list[int]] = {}
    for at, child in enumerate(kids):
        by_tag.setdefault(child.tag, []).append(at)
    taken: set[int] = set()
    for part in shape.elements:
        name = part.field.qname
        if len(part.names) == 1 and not name.startswith("{}"):
            fit = by_tag.get(name, [])
        else:
            others = part.names[1:]
            fit = [
                at for at, child in enumerate(kids)
                if _matches(child, name) or any(_matches(child, n) for n in others if child.tag not in shape.element_names or child.tag == name)
            ]
        found = [at for at in fit if at not in taken]
        if not part.repeated:
            found = found[:1]
        taken.update(found)
        out.append((part, found))
    return out


def _bind(out: dict, node: Node, value: str | None) -> str | None:
    """The name with a prefix that is bound in the object's map as it is where it stands; a
    prefix that the map has for another namespace, and none at all, give way to a new one."""
    if value is None or not value.strip():
        return value
    prefix, local = prefixed(value.strip())
    uri = node.ns.get(prefix, "")
    bound = out.setdefault(BOUND, {})
    if not uri or (prefix and bound.setdefault(prefix, uri) == uri):
        return value
    n = 0
    while bound.setdefault(f"q{n}", uri) != uri:
        n += 1
    return f"q{n}:{local}"


def read_object(node: Node, shape: Shape, sweep: bool = False) -> dict:
    """sweep: keep what no field takes even without a wildcard, and the order."""
    out: dict = {"_nil": False}
    order: list[tuple[int, str, int]] = []
    used: set[str] = set()
    taken: set[int] = set()
    for part in shape.parts:
        f, column = part.field, part.column
        if f.kind == "attribute":
            used.add(f.qname)
            if part.slot.kind == "absent":
                if f.qname in node.attrs:
                    raise XsdFrameError(f"@{f.qname} is not among the paths that the plan was made for", "unseen")
                continue
            out[column] = node.attrs.get(f.qname)
            if part.binds:
                out[column] = _bind(out, node, out[column])
        elif f.kind == "text":
            out[column] = node.text if not shape.type.mixed or node.text.strip() or not node.children else None
            if part.binds:
                out[column] = _bind(out, node, out[column])
    for part, found in assigned(node, shape):
        taken.update(found)
        if part.slot.kind == "absent":
            if found:
                raise XsdFrameError(f"{part.field.qname} is not among the paths that the plan was made for", "unseen")
            continue
        if not found and part.column in out:
            continue  # another branch of a choice has the same field, and took what there is
        order += [(at, part.column, k) for k, at in enumerate(found)]
        values = [read_slot(node.children[at], part.slot) for at in found]
        if part.binds:
            for at, v in zip(found, values):
                v["v"] = _bind(out, node.children[at], v["v"])
        out[part.column] = values if part.repeated else values[0] if values else None
    if shape.wild or sweep:
        extra: dict = {}
        if sweep or any(w.kind == "anyAttribute" for w in shape.wild):
            extra |= {f"@{k}": v for k, v in node.attrs.items() if k not in used and not k.startswith(f"{{{XSI}}}")}
        seen: dict[str, int] = {}
        for at, child in enumerate(node.children):
            if at not in taken:
                value, key = open_value(child), child.tag
                held = extra.get(key)
                extra[key] = value if held is None else [*held, value] if isinstance(held, list) else [held, value]
                order.append((at, key, seen.get(key, 0)))
                seen[key] = seen.get(key, 0) + 1
        attrs, elements = extra_parts(extra)
        out[EXTRA] = {"json": json.dumps(extra, ensure_ascii=False), "attributes": attrs, "elements": elements} if extra else None
    if shape.ordered or sweep:
        out[ORDER] = [{"key": k, "index": i} for _, k, i in sorted(order)]
    if BOUND in out:
        out[BOUND] = list(out[BOUND].items())
    return out


def paths_of(node: Node, slot: Slot, path: str, out: set[str]) -> None:
    """The paths of fields that a document uses."""
    if slot.kind != "object" or is_nil(node):
        return
    shape = slot.shapes[_shape(node, slot)]
    under = f"{path}." if path else ""
    out.update(under + p.column for p in shape.parts if p.field.kind == "attribute" and p.field.qname in node.attrs)
    for part, found in assigned(node, shape):
        for at in found:
            out.add(under + part.column)
            paths_of(node.children[at], part.slot, under + part.column, out)


def used_paths(root: str, slot: Slot):
    """A function of an XML string column giving the paths of fields that each text uses."""

    @F.arrow_udf(returnType="array<string>")
    def used(xml: pa.Array) -> pa.Array:
        rows = []
        for text in xml.to_pylist():
            found: set[str] = set()
            try:
                node = parse_xml(repair_tag_names(text)) if text is not None else None
            except XsdFrameError:
                node = None
            if node is not None and node.tag == root:
                paths_of(node, slot, "", found)
            rows.append(sorted(found))
        return pa.array(rows, pa.list_(pa.string()))

    return used


def shred_one(xml: str | None, root: str, slot: Slot) -> dict | None:
    """{doc, error} of one text; null for null. A wrong root or a malformed text is an error."""
    if xml is None:
        return None
    try:
        node = parse_xml(repair_tag_names(xml))
    except XsdFrameError as e:
        return {"doc": None, "error": f"{e.code}: {e}"}
    if node.tag != root:
        return {"doc": None, "error": f"root: Root element '{root}' not found"}
    if slot.kind == "open" and is_nil(node):
        return {"doc": None, "error": None}
    try:
        return {"doc": read_slot(node, slot), "error": None}
    except XsdFrameError as e:
        return {"doc": None, "error": f"{e.code}: {e}"}


def raw_schema(slot: Slot) -> T.StructType:
    return T.StructType([T.StructField("doc", slot.raw()), T.StructField("error", T.StringType())])


def shredder(root: str, slot: Slot):
    """A function of an XML string column giving {doc, error}."""
    schema = raw_schema(slot)
    reader = likeness.Reader(partial(shred_one, root=root, slot=slot), to_arrow_type(schema), slot)

    @F.arrow_udf(returnType=schema)
    def shred(xml: pa.Array) -> pa.Array:
        return reader(xml.to_pylist())

    # So the optimizer never copies the call into each expression that uses its result.
    return shred.asNondeterministic()


def decoded(content: Column) -> Column:
    """The text of a column of XML files' bytes, by each file's own encoding."""

    @F.arrow_udf(returnType="string")
    def decode(data: pa.Array) -> pa.Array:
        return pa.array([None if b is None else decode_xml(b) for b in data.to_pylist()], pa.string())

    return decode(content)


def shred(xml: Column, root: str, slot: Slot) -> Column:
    return shredder(root, slot)(xml)


NODE = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("qname", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("nil", T.BooleanType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
])


def node_rows(xml: str | None) -> list[dict]:
    """All elements of a text in document order, for queries over any depth."""
    if xml is None:
        return []
    try:
        root = parse_xml(repair_tag_names(xml))
    except XsdFrameError:
        return []
    out: list[dict] = []
    todo = [(root, -1, 0)]
    while todo:
        node, parent, depth = todo.pop()
        here = len(out)
        out.append({
            "ord": here, "parent": parent, "depth": depth, "qname": node.tag, "prefix": node.prefix,
            "value": None if node.children else node.text, "nil": is_nil(node), "attributes": list(node.attrs.items()),
        })
        todo += [(c, here, depth + 1) for c in reversed(node.children)]
    return out


def nodes(xml: Column) -> Column:
    """The node table of an XML column as an array; explode it to rows. Malformed texts have
    no nodes."""
    schema = T.ArrayType(NODE)
    kind = to_arrow_type(schema)

    @F.arrow_udf(returnType=schema)
    def table(texts: pa.Array) -> pa.Array:
        return pa.array([node_rows(x) for x in texts.to_pylist()], kind)

    return table.asNondeterministic()(xml)  # so no expression that uses the result calls it again

