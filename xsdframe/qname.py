"""Qualified names in Clark notation, {namespace}local."""

from __future__ import annotations

XSD = "http://www.w3.org/2001/XMLSchema"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
XML = "http://www.w3.org/XML/1998/namespace"


def clark(namespace: str | None, local: str) -> str:
    return f"{{{namespace or ''}}}{local}"


def split(name: str) -> tuple[str, str]:
    """(namespace, local) of a Clark name; raises on anything else."""
    if not name.startswith("{") or "}" not in name:
        raise ValueError(f"not a Clark name: {name}")
    namespace, _, local = name[1:].partition("}")
    return namespace, local


def local(name: str) -> str:
    """The local part; a plain name is its own."""
    return name.rpartition("}")[2]


def prefixed(name: str) -> tuple[str, str]:
    """(prefix, local) of a lexical QName; no prefix is the empty one."""
    prefix, sep, rest = name.partition(":")
    return (prefix, rest) if sep else ("", name)


def child_name(parent: str, field: str, suffix: str = "Type") -> str:
    """The made-up name of a type that stands inside a field: Parent_field_Type."""
    namespace, name = split(parent)
    return clark(namespace, f"{name}_{field}_{suffix}")
