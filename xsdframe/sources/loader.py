"""Finding and reading schema files: directories, the import graph, bundles."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from html import escape

from ..errors import XsdFrameError
from ..qname import XML, XSD, clark
from .xmltree import Node, decode_xml, parse_xml

REFERENCES = ("import", "include", "redefine")


@dataclass
class SchemaFile:
    """A schema document in the graph. namespace: its own target namespace, or that of the
    file that includes it (a chameleon). namespaces: prefixes of the schema element."""

    path: str
    root: Node
    namespace: str
    namespaces: dict[str, str]
    element_qualified: bool
    attribute_qualified: bool


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def expand(paths: list[str]) -> list[str]:
    """Directories become the .xsd files below them, sorted; links that lead in a circle are
    entered once; other paths stay as they are, missing ones too."""
    out: list[str] = []
    for path in paths:
        if not os.path.isdir(path):
            out.append(path)
            continue
        found, seen, todo = [], set(), [path]
        while todo:
            folder = todo.pop()
            real = os.path.realpath(folder)
            if real in seen:
                continue
            seen.add(real)
            for name in os.listdir(folder):
                full = os.path.join(folder, name)
                if os.path.isdir(full):
                    todo.append(full)
                elif name.endswith(".xsd"):
                    found.append(full)
        out += sorted(found)
    return out


def read_schema(path: str, inherited: str = "") -> SchemaFile:
    """One schema document."""
    try:
        root = parse_xml(decode_xml(read_bytes(path)))
    except OSError as e:
        raise XsdFrameError(f"cannot read {path}: {e.strerror}", "unreadable", path) from None
    if root.tag != clark(XSD, "schema"):
        raise XsdFrameError(f"{path} has no schema root", "no-schema-root", path)
    get = lambda name: root.attrs.get(clark("", name))
    namespaces = {**root.ns, "xml": XML}
    own = get("targetNamespace")
    if own is None and inherited and not namespaces.get(""):
        namespaces[""] = inherited
    return SchemaFile(
        path, root, own or inherited, namespaces, get("elementFormDefault") == "qualified", get("attributeFormDefault") == "qualified"
    )


def scan(entries: list[str], report, edges: list[tuple[str, str, str]]) -> list[SchemaFile]:
    """All files that the entries reach, dependencies first, each once for every namespace
    it is included into. Unreadable entries raise, others are reported; so are remote
    locations, which are never fetched."""
    out: list[SchemaFile] = []
    seen: set[tuple[str, str]] = set()

    def visit(path: str, inherited: str, entry: bool) -> None:
        key = (os.path.realpath(path), inherited)
        if key in seen:
            return
        seen.add(key)
        try:
            file = read_schema(path, inherited)
        except XsdFrameError as e:
            if entry:
                raise
            report("unresolved-import", str(e), path)
            return
        if inherited and file.root.attrs.get(clark("", "targetNamespace")):
            if (key[0], "") in seen:
                return
            seen.add((key[0], ""))
        for child in file.root.children:
            if child.tag not in {clark(XSD, r) for r in REFERENCES}:
                continue
            where = child.attrs.get(clark("", "schemaLocation"))
            if not where:
                continue
            if re.match(r"https?://", where):
                report("remote-schema-location", f"remote schema {where} is not fetched", where)
                continue
            to = os.path.normpath(os.path.join(os.path.dirname(path), where))
            edges.append((path, to, child.local))
            visit(to, file.namespace if child.local == "include" else "", False)
        out.append(file)

    for path in entries:
        visit(path, "", True)
    return out


def is_library(path: str) -> bool:
    """Whether a schema file declares no global element; unreadable files are not libraries."""
    try:
        root = parse_xml(decode_xml(read_bytes(path)))
    except (OSError, XsdFrameError):
        return False
    return not any(c.tag == clark(XSD, "element") for c in root.children)


def dependencies(entry: str) -> list[str]:
    """The local files that an entry reaches, dependencies first, the entry last."""
    edges: list[tuple[str, str, str]] = []
    return list(dict.fromkeys(f.path for f in scan([entry], lambda *_: None, edges)))


def bundle(entry: str) -> str:
    """The entry with the bodies of all its dependencies in place of its references.

    Prefixes that only a dependency declares are declared for the whole. A dependency that
    means something else by a prefix, or has another target namespace, cannot stand in the
    same schema element: that is an error."""
    own = read_schema(entry)
    bound = {p: uri for p, uri in own.root.ns.items() if p != "xml"}
    bodies, head, tail, more = [], "", "", {}
    for path in dependencies(entry):
        text = re.sub(r"<!--.*?-->", "", decode_xml(read_bytes(path)), flags=re.DOTALL)
        opened = re.search(r"<((?:[\w.-]+:)?)schema\b[^>]*>", text)
        if not opened:
            continue
        there = read_schema(path)
        if there.namespace not in ("", own.namespace):
            raise XsdFrameError(f"{path} is of namespace {there.namespace}, which one schema element cannot hold beside {own.namespace}", "bundle-namespace", path)
        for prefix, uri in there.root.ns.items():
            if prefix == "xml" or (not prefix and not uri):
                continue
            if bound.setdefault(prefix, uri) != uri:
                raise XsdFrameError(f"{path} binds {prefix or 'the default prefix'} to {uri}, others to {bound[prefix]}", "bundle-prefix", path)
            if prefix and prefix not in own.root.ns:
                more[prefix] = uri
        close = f"</{opened[1]}schema>"
        body = text[opened.end() : text.rfind(close)] if close in text else ""
        refs = "|".join(REFERENCES)
        body = re.sub(rf"<(?:[\w.-]+:)?(?:{refs})\b[^>]*/>", "", body)
        body = re.sub(rf"<((?:[\w.-]+:)?)({refs})\b[^>]*>.*?</\1\2>", "", body, flags=re.DOTALL)
        bodies.append(body.strip())
        if path == entry or os.path.realpath(path) == os.path.realpath(entry):
            head, tail = opened[0], close
    added = "".join(f' xmlns:{p}="{escape(uri, quote=True)}"' for p, uri in more.items())
    head = re.sub(r"\s*/?>\Z", lambda m: added + m[0], head)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n{head}\n' + "\n".join(b for b in bodies if b) + f"\n{tail}\n"
