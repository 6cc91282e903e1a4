"""XSD regular expressions as Java ones.

The dialects differ in anchoring, in a few escapes, in the names of Unicode blocks and in
class subtraction; the rest is passed on. A pattern that cannot be translated is used as
it stands, and then need not match the whole value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

from .lexical import NAME_MORE, NAME_START

#: Inside a class, without brackets.
_CLASS = {
    "d": r"\p{Nd}",
    "s": r"\t\n\r ",
    "w": r"\P{Z}&&\P{P}&&\P{C}",
    "i": f":{NAME_START}",
    "c": f":{NAME_START}{NAME_MORE}",
}
_SINGLE = set("nrt\\|.?*+(){}[]^-$")
#: Blocks that Java names otherwise.
_BLOCKS = {"greek": "Greek", "privateuse": "PrivateUseArea", "combiningmarksforsymbols": "CombiningMarksforSymbols"}
_CATEGORY = re.compile(r"[LMNPZSC]|L[ultmo]|M[nce]|N[dlo]|P[cdseifo]|Z[slp]|S[mcko]|C[cfon]")


class Untranslatable(ValueError):
    """The pattern is not a regular expression of XSD."""


def _property(text: str, at: int) -> tuple[str, int]:
    """\\p{...} or \\P{...} from the letter on; the Java text and the place after."""
    found = re.compile(r"([pP])\{([A-Za-z0-9-]+)\}").match(text, at)
    if not found:
        raise Untranslatable(text)
    letter, name = found[1], found[2]
    if name.startswith("Is"):
        return f"\\{letter}{{In{_BLOCKS.get(name[2:].lower(), name[2:])}}}", found.end()
    if not _CATEGORY.fullmatch(name):
        raise Untranslatable(text)
    return f"\\{letter}{{{name}}}", found.end()


def _escape(text: str, at: int, inside: bool) -> tuple[str, int]:
    """The escape whose backslash stands before `at`."""
    c = text[at : at + 1]
    if c in _SINGLE and c:
        return f"\\{c}", at + 1
    if c in ("p", "P"):
        return _property(text, at)
    if c.lower() in _CLASS and c:
        body = _CLASS[c.lower()]
        return (f"[^{body}]" if c.lower() != "w" else f"[^[{body}]]") if c.isupper() else f"[{body}]", at + 1
    raise Untranslatable(text)


def _class(text: str, at: int) -> tuple[str, int]:
    """A character class from after its bracket; subtraction becomes an intersection."""
    negated = text.startswith("^", at)
    at += negated
    body, first = [], True
    while True:
        if at >= len(text):
            raise Untranslatable(text)
        c = text[at]
        if c == "]":
            if first:
                raise Untranslatable(text)
            at += 1
            break
        if c == "-" and text.startswith("-[", at) and not first:
            taken, at = _class(text, at + 2)
            if not text.startswith("]", at):
                raise Untranslatable(text)
            whole = f"[^{''.join(body)}]" if negated else f"[{''.join(body)}]"
            return f"[{whole}&&[^{taken}]]", at + 1
        if c == "[":
            raise Untranslatable(text)
        if c == "\\":
            piece, at = _escape(text, at + 1, True)
            body.append(piece)
        else:
            body.append(f"\\{c}" if c in "&^~" or (c == "-" and (first or text.startswith("]", at + 1))) else c)
            at += 1
        first = False
    return (f"[^{''.join(body)}]" if negated else f"[{''.join(body)}]"), at


def translate(pattern: str) -> str:
    """The Java text of an XSD pattern, not anchored; raises Untranslatable."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            piece, at = _escape(pattern, at + 1, False)
            out.append(piece)
        elif c == "[":
            piece, at = _class(pattern, at + 1)
            out.append(piece)
        elif c == ".":
            out.append(r"[^\n\r]")
            at += 1
        elif c == "]" or pattern.startswith("(?", at):
            raise Untranslatable(pattern)
        else:
            out.append(c)
            at += 1
    return "".join(out)


def java_pattern(pattern: str) -> str:
    """What rlike takes: the whole value must match, or the raw pattern where it cannot be
    translated."""
    try:
        return rf"\A(?:{translate(pattern)})\z"
    except Untranslatable:
        return pattern


def xsd_pattern(c: Column, pattern: str) -> Column:
    return c.rlike(java_pattern(pattern))
