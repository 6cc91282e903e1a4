"""Text decoding and a small namespace-aware XML tree over expat."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.parsers import expat

from ..errors import XsdFrameError
from ..qname import XML, clark


def decode_xml(data: bytes) -> str:
    """The text of an XML file: byte order mark, UTF-16 without one, or the encoding that the
    first 200 bytes declare; unknown encodings count as UTF-8. The mark goes and the
    declaration then says UTF-8."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = data.decode("utf-16", "replace")
    elif data[:4] == b"<\x00?\x00" or (len(data) > 1 and data[1:2] == b"\x00" and data[:1] != b"\x00"):
        text = data.decode("utf-16-le", "replace")
    elif data[:1] == b"\x00" and data[1:2] not in (b"", b"\x00"):
        text = data.decode("utf-16-be", "replace")
    else:
        told = re.search(rb"""encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", data[:200])
        try:
            text = data.decode(told[1].decode() if told and data[:3] != b"\xef\xbb\xbf" else "utf-8", "replace")
        except LookupError:
            text = data.decode("utf-8", "replace")
    text = text.removeprefix("﻿")
    return re.sub(r"""^(<\?xml[^>]*?encoding\s*=\s*)(["'])[^"']*\2""", r"\1\2UTF-8\2", text)


_CDATA_OR_TAG = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|</?[^\s/>!?][^\s/>]*", re.DOTALL)
_CHAR_REF = re.compile(r"&#(x[0-9A-Fa-f]+|[0-9]+);")


def _char(ref: re.Match) -> str:
    told = ref[1]
    return chr(int(told[1:], 16) if told[0] in "xX" else int(told))


def repair_tag_names(xml: str) -> str:
    """Character references in tag names (<men&#249;>) become the characters; CDATA and
    comments are left alone."""
    if "&#" not in xml:
        return xml
    return _CDATA_OR_TAG.sub(lambda m: m[0] if m[0].startswith("<!") else _CHAR_REF.sub(_char, m[0]), xml)


def decode_entities(text: str) -> str:
    """The five named entities and character references of a text, one after the other; so
    &amp;lt; ends up as <, unlike in the parser."""
    text = _CHAR_REF.sub(_char, text)
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        text = text.replace(f"&{name};", char)
    return text


@dataclass(slots=True)
class Node:
    """An element: Clark name, attributes by Clark name, the prefixes in scope where it stands,
    children, and text. text is all character data in a row; cdata is marked sections,
    which follow it, as values are read text first."""

    tag: str
    attrs: dict[str, str]
    ns: dict[str, str]
    prefix: str = ""
    children: list[Node] = field(default_factory=list)
    chars: list[str] = field(default_factory=list)
    cdata: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.chars) + "".join(self.cdata)

    @property
    def local(self) -> str:
        return self.tag.rpartition("}")[2]


def parse_xml(xml: str | bytes) -> Node:
    """The root of a document. Namespace prefixes are resolved; attribute values are
    normalised and entities expanded as XML says; internal entities are expanded, external
    ones are not read. Raises XsdFrameError with code `malformed`."""
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True
    root: list[Node] = []
    stack: list[Node] = []
    # Of each scope: the prefixes, and the names of elements and of attributes met in it.
    scopes: list[tuple[dict[str, str], dict[str, str], dict[str, str]]] = [({"xml": XML, "": ""}, {}, {})]
    in_cdata = False

    def name(raw: str, scope: dict[str, str], attribute: bool) -> str:
        prefix, sep, local = raw.partition(":")
        if not sep:
            return clark("" if attribute else scope.get("", ""), raw)
        if prefix not in scope:
            raise XsdFrameError(f"prefix {prefix} is not declared", "malformed")
        return clark(scope[prefix], local)

    def start(raw: str, given: list[str]) -> None:
        held = scopes[-1]
        attrs: dict[str, str] = {}
        if given:
            pairs = list(zip(given[::2], given[1::2]))
            declared = {k[6:] if k != "xmlns" else "": v for k, v in pairs if k.startswith("xmlns") and (k == "xmlns" or k[5] == ":")}
            if declared:
                held = ({**held[0], **declared}, {}, {})
            known = held[2]
            for k, v in pairs:
                if not (k.startswith("xmlns") and (k == "xmlns" or k[5] == ":")):
                    told = known.get(k)
                    if told is None:
                        told = known[k] = name(k, held[0], True)
                    attrs[told] = v
        tag = held[1].get(raw)
        if tag is None:
            tag = held[1][raw] = name(raw, held[0], False)
        node = Node(tag, attrs, held[0], raw.partition(":")[0] if ":" in raw else "")
        (stack[-1].children if stack else root).append(node)
        stack.append(node)
        scopes.append(held)

    def end(_: str) -> None:
        stack.pop()
        scopes.pop()

    def chars(data: str) -> None:
        if stack:
            (stack[-1].cdata if in_cdata else stack[-1].chars).append(data)

    def cdata(on: bool):
        def switch() -> None:
            nonlocal in_cdata
            in_cdata = on

        return switch

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = cdata(True), cdata(False)
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass") if isinstance(xml, str) else xml, True)
    except expat.ExpatError as e:
        raise XsdFrameError(f"line {e.lineno}, column {e.offset}: {expat.ErrorString(e.code)}", "malformed") from None
    return root[0]
