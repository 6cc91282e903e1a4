"""Open content: elements that no schema describes, as nested data and as text.

Both are made where a document is read, so writing it again needs no Python.
"""

from __future__ import annotations

from ..qname import XML, XSI, split
from ..sources.xmltree import Node


def open_value(node: Node):
    """Any element as nested data: Clark keys, @ before attributes, repeated keys as lists,
    a leaf as its text."""
    out: dict = {f"@{k}": v for k, v in node.attrs.items() if not k.startswith(f"{{{XSI}}}")}
    for child in node.children:
        value = open_value(child)
        if child.tag in out:
            held = out[child.tag]
            out[child.tag] = [*held, value] if isinstance(held, list) else [held, value]
        else:
            out[child.tag] = value
    if not out:
        return node.text
    if node.text.strip():
        out["_text"] = node.text
    return out


def _parts(key: str) -> tuple[str, str]:
    """(namespace, name) of a key, which may be a plain name."""
    return split(key) if key.startswith("{") else ("", key)


def py_escape(text: str, attribute: bool) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#xD;")
    return text.replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;") if attribute else text


def open_xml(key: str, value) -> str:
    """Open content (see open_value) as elements; each declares its own namespace."""
    if isinstance(value, list):
        return "".join(open_xml(key, v) for v in value)
    namespace, name = _parts(key)
    head = f' xmlns="{py_escape(namespace, True)}"'
    if not isinstance(value, dict):
        return f"<{name}{head}>{py_escape('' if value is None else str(value), False)}</{name}>"
    attrs, number = "", 0
    for k, v in value.items():
        if k.startswith("@"):
            ns, local = _parts(k[1:])
            if ns == XML:
                local = f"xml:{local}"
            elif ns:
                attrs += f' xmlns:a{number}="{py_escape(ns, True)}"'
                local, number = f"a{number}:{local}", number + 1
            attrs += f' {local}="{py_escape(str(v), True)}"'
    body = py_escape(value.get("_text", ""), False) + "".join(open_xml(k, v) for k, v in value.items() if k != "_text" and not k.startswith("@"))
    return f"<{name}{head}{attrs}>{body}</{name}>"


def extra_parts(found: dict) -> tuple[str, list[dict]]:
    """Unmatched content as attribute text and single elements, ready to be written."""
    attrs, elements = "", []
    for number, (k, value) in enumerate(found.items()):
        if k.startswith("@"):
            ns, local = _parts(k[1:])
            if ns == XML:
                attrs += f' xml:{local}="{py_escape(value, True)}"'
            elif ns:
                attrs += f' xmlns:x{number}="{py_escape(ns, True)}" x{number}:{local}="{py_escape(value, True)}"'
            else:
                attrs += f' {local}="{py_escape(value, True)}"'
        else:
            for i, one in enumerate(value if isinstance(value, list) else [value]):
                elements.append({"key": k, "index": i, "xml": open_xml(k, one)})
    return attrs, elements
