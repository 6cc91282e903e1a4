"""From schema documents to a Schema.

Work is done by walking declarations on demand: names of all files are entered first, so
order does not matter; then global elements and types are built, each particle adding
fields to its type; types that stand inside fields wait in a queue. Redefinitions replace
entries before anything is built. At the end extensions take over their bases' fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import XsdFrameError
from ..ir import Card, ComplexType, Element, Field, Schema, SimpleType, Wildcard
from ..qname import XSD, child_name, clark, local, prefixed
from ..sources.loader import SchemaFile, scan
from ..sources.xmltree import Node

ANY_TYPE, STRING = clark(XSD, "anyType"), clark(XSD, "string")
FACETS = (
    "enumeration", "pattern", "length", "minLength", "maxLength", "minInclusive", "maxInclusive", "minExclusive",
    "maxExclusive", "totalDigits", "fractionDigits", "whiteSpace",
)


def attr(node: Node, name: str, otherwise: str | None = None) -> str | None:
    return node.attrs.get(clark("", name), otherwise)


def kids(node: Node, *names: str) -> list[Node]:
    wanted = {clark(XSD, n) for n in names}
    return [c for c in node.children if c.tag in wanted]


def kid(node: Node, *names: str) -> Node | None:
    found = kids(node, *names)
    return found[0] if found else None


def documentation(node: Node) -> str | None:
    """The text of a declaration's annotations."""
    texts = [d.text.strip() for a in kids(node, "annotation") for d in kids(a, "documentation")]
    return "\n".join(t for t in texts if t) or None


def occurs(node: Node) -> Card:
    def bound(name: str) -> int | None:
        told = (attr(node, name) or "1").strip()
        if told == "unbounded" and name == "maxOccurs":
            return None
        if not re.fullmatch(r"[0-9]+", told):
            raise XsdFrameError(f"{name}={told!r} is not a number of occurrences", "invalid-occurs")
        return int(told)

    return Card(bound("minOccurs") or 0, bound("maxOccurs"))


@dataclass
class Declared:
    """A global declaration and the file in whose context it is read."""

    node: Node
    file: SchemaFile


@dataclass
class Scope:
    """Where a particle stands: in which file's context, how often, in which choice."""

    file: SchemaFile
    card: Card = Card()
    group: int | None = None
    branch: int | None = None
    open: tuple[str, ...] = ()

    def inside(self, **changes) -> Scope:
        return Scope(**{**self.__dict__, **changes})


@dataclass
class Analyzer:
    files: list[SchemaFile]
    out: Schema
    allow_missing_imports: bool = False
    declared: dict[str, dict[str, Declared]] = field(default_factory=lambda: {k: {} for k in ("simpleType", "complexType", "element", "group", "attributeGroup", "attribute")})
    queue: list[Callable[[], None]] = field(default_factory=list)
    choices: int = 0
    redefined: dict[str, str] = field(default_factory=dict)

    # Names

    def name(self, told: str | None, node: Node, file: SchemaFile) -> str:
        """The Clark name of a QName attribute: prefixes declared on the node itself count;
        without a prefix the default namespace, else the target namespace."""
        if not told:
            return STRING
        prefix, rest = prefixed(told.strip())
        scope = {**file.namespaces, **{k: v for k, v in node.ns.items() if k or v}}
        if not prefix:
            return clark(scope.get("") or file.namespace, rest)
        if prefix not in scope:
            self.out.report("unknown-namespace-prefix", f'unknown namespace prefix "{prefix}" in "{told}"', told)
            return clark("", rest)
        return clark(scope[prefix], rest)

    def fresh(self, name: str) -> str:
        taken, number = name, 2
        while taken in self.out.simple or taken in self.out.complex:
            taken, number = f"{name}_{number}", number + 1
        return taken

    # Declarations

    def declare(self) -> None:
        for file in self.files:
            self.out.namespaces.setdefault(file.namespace, file.path)
            for node in file.root.children:
                kind = local(node.tag)
                if kind in self.declared and attr(node, "name"):
                    self.declared[kind][clark(file.namespace, attr(node, "name"))] = Declared(node, file)
        for file in self.files:
            for whole in kids(file.root, "redefine"):
                if attr(whole, "schemaLocation"):
                    for node in whole.children:
                        if local(node.tag) in self.declared and attr(node, "name"):
                            self.redefine(node, file)

    def redefine(self, node: Node, file: SchemaFile) -> None:
        """The redefinition takes the name; the original is kept under a new one, to which
        references of the redefinition to itself lead."""
        kind, name = local(node.tag), clark(file.namespace, attr(node, "name"))
        entries = self.declared[kind]
        original = entries.get(name)
        if original is not None:
            kept, n = f"{name}-redefined", 2
            while kept in entries:
                kept, n = f"{name}-redefined-{n}", n + 1
            entries[kept] = original
            self.redefined[f"{id(node)}"] = kept
        elif self.refers_to(node, name, file):
            self.out.report("circular-redefinition", f'"{local(name)}" is redefined in terms of itself, and has no original', attr(node, "name"))
        entries[name] = Declared(node, file)

    def refers_to(self, node: Node, name: str, file: SchemaFile) -> bool:
        told = attr(node, "base") or attr(node, "ref")
        return bool(told) and self.name(told, node, file) == name or any(self.refers_to(c, name, file) for c in node.children)

    def own(self, name: str, owner: Node | None) -> str:
        """A reference of a redefinition to itself means the original."""
        return self.redefined.get(f"{id(owner)}", name) if owner is not None else name

    # Simple types

    def simple(self, node: Node, name: str, file: SchemaFile) -> SimpleType:
        """A simpleType node: list, union or restriction; attributes win over inline types."""
        out = SimpleType(name, doc=documentation(node))
        self.out.simple[name] = out
        if (body := kid(node, "list")) is not None:
            out.kind = "list"
            out.item = self.name(attr(body, "itemType"), body, file) if attr(body, "itemType") else self.inline_simple(body, name, file)
        elif (body := kid(node, "union")) is not None:
            out.kind = "union"
            if attr(body, "memberTypes"):
                out.members = [self.name(m, body, file) for m in attr(body, "memberTypes").split()]
            else:
                out.members = [self.synthetic(n, child_name(name, f"member{k}", "SimpleType"), file) for k, n in enumerate(kids(body, "simpleType"))]
        else:
            body = kid(node, "restriction")
            if body is None:
                out.base = STRING
            else:
                out.base = self.own(self.name(attr(body, "base"), body, file), node) if attr(body, "base") else self.inline_simple(body, name, file)
                out.facets = self.facets(body)
        return out

    @staticmethod
    def facets(body: Node) -> list[tuple[str, str]]:
        return [(local(c.tag), attr(c, "value", "")) for c in body.children if c.tag.startswith(f"{{{XSD}}}") and local(c.tag) in FACETS]

    def inline_simple(self, body: Node, owner: str, file: SchemaFile) -> str:
        inner = kid(body, "simpleType")
        return self.synthetic(inner, child_name(owner, "base", "SimpleType"), file) if inner is not None else STRING

    def synthetic(self, node: Node, name: str, file: SchemaFile) -> str:
        name = self.fresh(name)
        self.simple(node, name, file)
        return name

    # Complex types

    def complex(self, node: Node, name: str, file: SchemaFile) -> None:
        out = ComplexType(name, abstract=attr(node, "abstract") in ("true", "1"), doc=documentation(node))
        self.out.complex[name] = out
        content = kid(node, "complexContent", "simpleContent")
        mixed = attr(content, "mixed") if content is not None and local(content.tag) == "complexContent" else None
        out.mixed = (mixed if mixed is not None else attr(node, "mixed")) in ("true", "1")
        scope = Scope(file)
        if content is None:
            self.particles(node, out, scope)
        else:
            body = kid(content, "extension", "restriction")
            if body is not None:
                base = self.own(self.name(attr(body, "base"), body, file), node)
                if local(content.tag) == "simpleContent":
                    self.simple_content(body, base, out, scope)
                elif local(body.tag) == "extension":
                    out.base = base
                    self.particles(body, out, scope)
                else:
                    out.restriction_of = base if base != ANY_TYPE else None
                    self.particles(body, out, scope)
        if out.mixed and not any(f.kind == "text" for f in out.fields):
            out.fields.insert(0, Field("text", "", STRING, Card(0, 1), key="_text"))

    def simple_content(self, body: Node, base: str, out: ComplexType, scope: Scope) -> None:
        """Text of the innermost simple type, and the attributes along the bases, once each."""
        if local(body.tag) == "restriction":
            out.restriction_of = base
        elif base in self.declared["complexType"]:
            out.base = None  # its attributes are copied here, so nothing is merged later
            self.derived_by_copy[out.name] = base
        text, chain, seen = base, [], set()
        while text in self.declared["complexType"] and text not in seen:
            seen.add(text)
            there = self.declared["complexType"][text]
            content = kid(there.node, "simpleContent", "complexContent")
            inner = kid(content, "extension", "restriction") if content is not None else None
            if inner is None:
                break
            chain.append((inner, there.file))
            text = self.own(self.name(attr(inner, "base"), inner, there.file), there.node)
        facets = self.facets(body)
        if (inline := kid(body, "simpleType")) is not None:
            text = self.synthetic(inline, child_name(out.name, "text", "SimpleType"), scope.file)
        if facets:
            name = self.fresh(child_name(out.name, "text", "SimpleType"))
            self.out.simple[name] = SimpleType(name, base=text if text not in seen else STRING, facets=facets)
            text = name
        if text in seen or text in self.declared["complexType"]:
            text = STRING
        out.fields.append(Field("text", "", text, key="_text"))
        self.particles(body, out, scope)
        for inner, file in chain:
            for f in self.attributes_of(inner, out, scope.inside(file=file)):
                if not any(g.kind == "attribute" and g.qname == f.qname for g in out.fields):
                    out.fields.append(f)

    derived_by_copy: dict[str, str] = field(default_factory=dict)

    def attributes_of(self, body: Node, out: ComplexType, scope: Scope) -> list[Field]:
        probe = ComplexType(out.name)
        self.particles(body, probe, scope)
        return [f for f in probe.fields if f.kind == "attribute"]

    # Particles

    def particles(self, node: Node, out: ComplexType, scope: Scope) -> None:
        for child in node.children:
            if child.tag.startswith(f"{{{XSD}}}"):
                handler = getattr(self, f"on_{local(child.tag)}", None)
                if handler:
                    handler(child, out, scope)

    def on_sequence(self, node: Node, out: ComplexType, scope: Scope) -> None:
        self.particles(node, out, scope.inside(card=scope.card.times(occurs(node))))

    on_all = on_sequence

    def on_choice(self, node: Node, out: ComplexType, scope: Scope) -> None:
        """Each direct child is a branch of a new group; a choice in a branch of another is
        reached through it."""
        self.choices += 1
        group, card = self.choices, scope.card.times(occurs(node))
        out.groups[group] = card
        if scope.group is not None:
            out.guards[group] = (scope.group, scope.branch)
        branch = 0
        for child in node.children:
            kind = local(child.tag)
            if child.tag.startswith(f"{{{XSD}}}") and kind in ("element", "sequence", "choice", "group", "any", "all"):
                getattr(self, f"on_{kind}")(child, out, scope.inside(card=card, group=group, branch=branch))
                branch += 1

    def on_group(self, node: Node, out: ComplexType, scope: Scope) -> None:
        self.reference(node, "group", out, scope.inside(card=scope.card.times(occurs(node))))

    def on_attributeGroup(self, node: Node, out: ComplexType, scope: Scope) -> None:  # noqa: N802
        self.reference(node, "attributeGroup", out, scope)

    def reference(self, node: Node, kind: str, out: ComplexType, scope: Scope) -> None:
        """A group's particles, read in the context of the file that defines it."""
        told = attr(node, "ref")
        if told is None:
            return self.particles(node, out, scope)
        owner = next((o for o in reversed(scope.open) if o.startswith(kind)), None)
        name = self.name(told, node, scope.file)
        if owner and owner.partition(" ")[2] == name:
            name = self.redefined.get(f"{id(self.declared[kind][name].node)}", name)
        dashed = "attribute-group" if kind == "attributeGroup" else "group"
        if f"{kind} {name}" in scope.open:
            return self.out.report(f"circular-{dashed}-ref", f'circular {kind} ref "{told}" dropped', told)
        there = self.declared[kind].get(name)
        if there is None:
            return self.out.report(f"unresolved-{dashed}-ref", f'unresolved {kind} ref "{told}"', told)
        return self.particles(there.node, out, scope.inside(file=there.file, open=(*scope.open, f"{kind} {name}")))

    def form(self, node: Node, qualified: bool, file: SchemaFile) -> str:
        told = attr(node, "form")
        return file.namespace if (told == "qualified" if told else qualified) else ""

    def on_element(self, node: Node, out: ComplexType, scope: Scope) -> None:
        card = scope.card.times(occurs(node))
        place = {"card": card, "group": scope.group, "branch": scope.branch}
        told = attr(node, "ref")
        if told is not None:
            name = self.name(told, node, scope.file)
            there = self.declared["element"].get(name) or self.declared["element"].get(clark("", local(name)))
            if there is None:
                if not self.allow_missing_imports:
                    self.out.report("unresolved-element-ref", f'unresolved element ref "{told}"', told)
                else:
                    out.fields.append(Field("element", name, ANY_TYPE, key=local(name), unknown=True, **place))
                return
            name = name if name in self.declared["element"] else clark("", local(name))
            found = self.element(name)
            out.fields.append(Field(
                "element", name, found.type_name, nillable=found.nillable or attr(node, "nillable") in ("true", "1"), default=found.default,
                fixed=found.fixed, key=local(name), doc=documentation(node) or found.doc, **place,
            ))
            return
        name = attr(node, "name")
        if name is None:
            return
        qname = clark(self.form(node, scope.file.element_qualified, scope.file), name)
        out.fields.append(Field(
            "element", qname, self.type_of(node, scope.file, child_name(out.name, name)), nillable=attr(node, "nillable") in ("true", "1"),
            default=attr(node, "default"), fixed=attr(node, "fixed"), key=name, doc=documentation(node), **place,
        ))

    def type_of(self, node: Node, file: SchemaFile, made_up: str) -> str:
        """Of an element: the type attribute, an inline complex type, an inline simple type, or
        that of its substitution head, else anyType. Inline complex types are built later."""
        if attr(node, "type") is not None:
            return self.name(attr(node, "type"), node, file)
        if (inline := kid(node, "complexType")) is not None:
            name = self.fresh(made_up)
            self.out.complex[name] = ComplexType(name)
            self.queue.append(lambda: self.complex(inline, name, file))
            return name
        if (inline := kid(node, "simpleType")) is not None:
            return self.synthetic(inline, made_up.removesuffix("Type") + "SimpleType", file)
        return ANY_TYPE

    def on_attribute(self, node: Node, out: ComplexType, scope: Scope) -> None:
        least = 1 if attr(node, "use") == "required" else 0
        told = attr(node, "ref")
        source, file = node, scope.file
        if told is not None:
            qname = self.name(told, node, scope.file)
            there = self.declared["attribute"].get(qname)
            if there is None:
                if not qname.startswith("{http://www.w3.org/XML/1998/namespace}"):
                    self.out.report("unresolved-attribute-ref", f'unresolved attribute ref "{told}"', told)
                out.fields.append(Field("attribute", qname, STRING, Card(least, 1), default=attr(node, "default"), fixed=attr(node, "fixed"), key=f"@{local(qname)}"))
                return
            source, file = there.node, there.file
        elif attr(node, "name") is None:
            return
        else:
            qname = clark(self.form(node, scope.file.attribute_qualified, scope.file), attr(node, "name"))
        if attr(source, "type") is not None:
            kind = self.name(attr(source, "type"), source, file)
        elif (inline := kid(source, "simpleType")) is not None:
            kind = self.synthetic(inline, child_name(out.name, local(qname), "SimpleType"), file)
        else:
            kind = STRING
        first = lambda name: attr(node, name) if attr(node, name) is not None else attr(source, name)
        out.fields.append(Field(
            "attribute", qname, kind, Card(least, 1), default=first("default"), fixed=first("fixed"), key=f"@{local(qname)}",
            doc=documentation(node) or documentation(source),
        ))

    def wildcard(self, node: Node, out: ComplexType, scope: Scope, card: Card) -> None:
        at = sum(f.kind == "element" for f in out.fields)
        out.wildcards.append(Wildcard(local(node.tag), (attr(node, "namespace") or "##any").strip(), at, card, scope.group, scope.branch, scope.file.namespace))

    def on_any(self, node: Node, out: ComplexType, scope: Scope) -> None:
        self.wildcard(node, out, scope, scope.card.times(occurs(node)))

    def on_anyAttribute(self, node: Node, out: ComplexType, scope: Scope) -> None:  # noqa: N802
        self.wildcard(node, out, scope.inside(group=None, branch=None), Card(0, None))

    # Global elements

    def element(self, name: str) -> Element:
        if name not in self.out.elements:
            there = self.declared["element"][name]
            node, file = there.node, there.file
            found = Element(
                name, "", attr(node, "nillable") in ("true", "1"), default=attr(node, "default"), fixed=attr(node, "fixed"),
                abstract=attr(node, "abstract") in ("true", "1"), doc=documentation(node),
            )
            self.out.elements[name] = found
            if attr(node, "substitutionGroup"):
                found.heads = self.name(attr(node, "substitutionGroup").split()[0], node, file)
            found.type_name = self.type_of(node, file, clark(file.namespace, f"anonymous_{local(name)}_Type"))
            if found.type_name == ANY_TYPE and found.heads in self.declared["element"] and attr(node, "type") is None:
                found.type_name = self.element(found.heads).type_name
        return self.out.elements[name]

    # After all is collected

    def extend(self) -> None:
        """Extensions take their bases' fields first, wildcards move behind them."""
        done: set[str] = set()

        def visit(name: str, open: tuple[str, ...]) -> None:
            out = self.out.complex[name]
            base = self.out.complex.get(out.base or "")
            if name in done or base is None or out.base in open:
                return
            visit(out.base, (*open, name))
            done.add(name)
            shift = sum(f.kind == "element" for f in base.fields)
            own = [f for f in out.fields if not (f.kind == "text" and any(g.kind == "text" for g in base.fields))]
            out.fields = [*base.fields, *own]
            out.mixed = out.mixed or base.mixed
            if base.mixed or out.mixed:
                text = [f for f in out.fields if f.kind == "text"][:1]
                out.fields = text + [f for f in out.fields if f.kind != "text"]
            for w in out.wildcards:
                w.at += shift
            out.wildcards = [*(Wildcard(**w.__dict__) for w in base.wildcards), *out.wildcards]
            out.groups = {**base.groups, **out.groups}
            out.guards = {**base.guards, **out.guards}

        for name in list(self.out.complex):
            visit(name, (name,))

    def merge(self, out: ComplexType) -> None:
        """Neighbouring elements of one name, type and choice branch are one repeated field; a
        wildcard between them keeps them apart. Then keys: equal keys of different names get
        numbers."""
        merged: list[Field] = []
        walls = {w.at for w in out.wildcards if w.kind == "any"}
        seen = 0
        shift: dict[int, int] = {}
        for f in out.fields:
            if f.kind == "element":
                last = merged[-1] if merged else None
                if (
                    last is not None and last.kind == "element" and seen not in walls and f.qname == last.qname
                    and f.type_name == last.type_name and (f.group, f.branch) == (last.group, last.branch)
                ):
                    merged[-1] = last.with_(card=last.card.plus(f.card))
                    shift[seen] = 1
                    seen += 1
                    continue
                seen += 1
            merged.append(f)
        for w in out.wildcards:
            w.at -= sum(n for at, n in shift.items() if at < w.at)
        keys: dict[str, str] = {}
        out.fields = []
        for f in merged:
            key, n = f.key, 2
            while keys.setdefault(key, f.qname) != f.qname:
                key, n = f"{f.key}{n}", n + 1
            out.fields.append(f.with_(key=key))

    def cut_simple_cycles(self) -> None:
        """A simple type that leads to itself loses the step that does so."""
        simple = self.out.simple

        def reaches(start: str, name: str, seen: set[str]) -> bool:
            if name == start:
                return True
            if name in seen or name not in simple:
                return False
            seen.add(name)
            t = simple[name]
            return any(reaches(start, n, seen) for n in (t.base, t.item, *t.members) if n)

        for name, t in simple.items():
            for member in list(t.members):
                if reaches(name, member, set()):
                    t.members.remove(member)
                    self.out.report("circular-union-member", f'union member "{local(member)}" of "{local(name)}" dropped', local(member))
            if t.base and reaches(name, t.base, set()):
                self.out.report("circular-derivation", f'"{local(name)}" derives from itself', local(name))
                t.base = STRING
            if t.item and reaches(name, t.item, set()):
                self.out.report("circular-derivation", f'"{local(name)}" is a list of itself', local(name))
                t.item = STRING

    def run(self) -> Schema:
        self.declare()
        for name in self.declared["simpleType"]:
            there = self.declared["simpleType"][name]
            self.simple(there.node, name, there.file)
        for name in self.declared["complexType"]:
            if name in self.out.simple:
                raise XsdFrameError(f"{name} names a simple and a complex type", "type-name-collision")
            self.out.complex[name] = ComplexType(name)
        for name in self.declared["element"]:
            self.element(name)
        for name, there in self.declared["complexType"].items():
            self.complex(there.node, name, there.file)
        while self.queue:
            self.queue.pop(0)()
        self.extend()
        for out in self.out.complex.values():
            self.merge(out)
        self.cut_simple_cycles()
        for name, base in self.derived_by_copy.items():
            self.out.complex[name].base = base
        return self.out


def load_xsd(paths: str | list[str], allow_missing_imports: bool = False) -> Schema:
    """Compile schema files, and all that they import, include or redefine."""
    from ..sources.loader import expand

    out = Schema()
    entries = expand([paths] if isinstance(paths, str) else list(paths))
    if not entries:
        raise XsdFrameError("no schema files", "no-schema-files")
    files = scan(entries, out.report, out.edges)
    out.files = [f.path for f in files]
    return Analyzer(files, out, allow_missing_imports).run()


def substitution_members(schema: Schema) -> dict[str, list[str]]:
    """All elements that may stand for each head, directly or through others, in order of
    declaration; cycles end."""
    direct: dict[str, list[str]] = {}
    for e in schema.elements.values():
        if e.heads:
            direct.setdefault(e.heads, []).append(e.qname)
    out = {}
    for head in direct:
        found, todo = [], list(direct[head])
        while todo:
            name = todo.pop(0)
            if name not in found and name != head:
                found.append(name)
                todo += direct.get(name, [])
        out[head] = found
    return out


def derived_types(schema: Schema) -> dict[str, list[str]]:
    """All complex types derived from each, by extension or restriction, nearest first."""
    direct: dict[str, list[str]] = {}
    for t in schema.complex.values():
        for base in (t.base, t.restriction_of):
            if base:
                direct.setdefault(base, []).append(t.name)
    out = {}
    for name in direct:
        found, todo = [], list(direct[name])
        while todo:
            t = todo.pop(0)
            if t not in found and t != name:
                found.append(t)
                todo += direct.get(t, [])
        out[name] = found
    return out


