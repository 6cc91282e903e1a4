"""What schema files compile to: plain data, made once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: No upper bound.
UNBOUNDED = None


@dataclass(frozen=True)
class Card:
    """How often a particle occurs. most None: unbounded."""

    least: int = 1
    most: int | None = 1

    def times(self, other: Card) -> Card:
        """Of a particle in a particle: bounds multiply, 0 absorbs, else unbounded dominates."""
        if self.most == 0 or other.most == 0:
            most: int | None = 0
        elif self.most is None or other.most is None:
            most = None
        else:
            most = self.most * other.most
        return Card(self.least * other.least, most)

    def plus(self, other: Card) -> Card:
        return Card(self.least + other.least, None if self.most is None or other.most is None else self.most + other.most)

    @property
    def repeated(self) -> bool:
        return self.most is None or self.most > 1


@dataclass(frozen=True)
class Field:
    """One thing that a complex type declares. kind: element, attribute or text."""

    kind: str
    qname: str
    type_name: str
    card: Card = Card()
    nillable: bool = False
    group: int | None = None
    branch: int | None = None
    default: str | None = None
    fixed: str | None = None
    key: str = ""
    doc: str | None = None
    unknown: bool = False

    def with_(self, **changes) -> Field:
        return replace(self, **changes)


@dataclass
class SimpleType:
    """kind: restriction (base and facets), list (item) or union (members)."""

    name: str
    kind: str = "restriction"
    base: str = ""
    facets: list[tuple[str, str]] = field(default_factory=list)
    item: str = ""
    members: list[str] = field(default_factory=list)
    doc: str | None = None


@dataclass
class Wildcard:
    """any or anyAttribute. at: how many element fields stand before it."""

    kind: str
    namespaces: str = "##any"
    at: int = 0
    card: Card = Card()
    group: int | None = None
    branch: int | None = None
    target: str = ""

    def allows(self, namespace: str) -> bool:
        if self.namespaces == "##any":
            return True
        if self.namespaces == "##other":
            return namespace not in ("", self.target)
        names = {"##targetNamespace": self.target, "##local": ""}
        return namespace in {names.get(n, n) for n in self.namespaces.split()}


@dataclass
class ComplexType:
    name: str
    fields: list[Field] = field(default_factory=list)
    base: str | None = None
    restriction_of: str | None = None
    abstract: bool = False
    mixed: bool = False
    #: How often each choice occurs, and in which (choice, branch) it stands.
    groups: dict[int, Card] = field(default_factory=dict)
    guards: dict[int, tuple[int, int]] = field(default_factory=dict)
    wildcards: list[Wildcard] = field(default_factory=list)
    doc: str | None = None


@dataclass
class Element:
    qname: str
    type_name: str
    nillable: bool = False
    heads: str | None = None
    default: str | None = None
    fixed: str | None = None
    abstract: bool = False
    doc: str | None = None


@dataclass(frozen=True)
class Diagnostic:
    kind: str
    message: str
    ref: str | None = None


@dataclass
class Schema:
    """A compiled schema set."""

    files: list[str] = field(default_factory=list)
    edges: list[tuple[str, str, str]] = field(default_factory=list)
    namespaces: dict[str, str] = field(default_factory=dict)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    simple: dict[str, SimpleType] = field(default_factory=dict)
    complex: dict[str, ComplexType] = field(default_factory=dict)
    elements: dict[str, Element] = field(default_factory=dict)

    def report(self, kind: str, message: str, ref: str | None = None) -> None:
        found = Diagnostic(kind, message, ref)
        if not any(d.kind == kind and d.message == message for d in self.diagnostics):
            self.diagnostics.append(found)
