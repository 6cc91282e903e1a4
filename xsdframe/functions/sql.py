"""Expressions as SQL text.

A plan for a large schema is an expression of many thousand nodes; made node by node, each
costs a round trip to the JVM. An Expr is the text of an expression with the operators of a
Column, and is parsed once, where a DataFrame takes it. F has the functions of
pyspark.sql.functions that the engine needs: over Exprs and plain values they give Exprs;
given a Column they are the ordinary functions, so the same code serves both. Plain strings
are literals, never column names.
"""

from __future__ import annotations

import inspect
import itertools
import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as _functions
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as _Classic

_PATH = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.`[^`]*`)*|`[^`]*`(?:\.`[^`]*`)*")
_ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\u0000"}
_numbers = itertools.count()


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def ddl(kind: T.DataType | str) -> str:
    """A type's SQL text, with quoted field names."""
    if isinstance(kind, str):
        return kind
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"{quoted(f.name)}:{ddl(f.dataType)}" for f in kind.fields) + ">"
    return f"array<{ddl(kind.elementType)}>" if isinstance(kind, T.ArrayType) else kind.simpleString()


def text_of(value) -> str:
    """SQL text of an Expr or a plain value."""
    if isinstance(value, Expr):
        return value.text
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"({value}L)" if abs(value) >= 1 << 31 else f"({value})" if value < 0 else str(value)
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) and value >= 0 else f"double('{value}')"
    if isinstance(value, str):
        return "'" + "".join(_ESCAPES.get(c, c) for c in value) + "'"
    raise TypeError(f"no SQL text for {type(value).__name__}")


def _plain(value) -> bool:
    """Whether a value is a Column that has no text."""
    return isinstance(value, Column) and not isinstance(value, Expr)


#: How tightly what an expression consists of binds.
OR, AND, NOT, COMPARED, SUM, CASE, ATOM = range(7)
_LEVELS = {"OR": OR, "AND": AND, **dict.fromkeys(("=", "!=", "<", "<=", ">", ">=", "<=>", "RLIKE"), COMPARED), **dict.fromkeys("+-*/%", SUM)}
_METHODS = {
    "AND": "__and__", "OR": "__or__", "=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "+": "__add__",
    "-": "__sub__", "*": "__mul__", "/": "__truediv__", "%": "__mod__", "<=>": "eqNullSafe", "RLIKE": "rlike",
}


class Expr:
    """SQL text with a Column's operators. It counts as a Column wherever one is taken.

    Parentheses stand only where an operator needs them: the parser looks through all that
    stands in a pair before it knows what the pair is."""

    def __init__(self, text: str, name: str | None = None, level: int = ATOM, parts: tuple[str, ...] = ()):
        self._text, self.name, self.level, self.parts, self.literal = text, name, level, parts, None

    @property
    def __class__(self):
        return _Classic

    @property
    def text(self) -> str:
        return self._text

    def at(self, level: int) -> str:
        """The text as an operand of something that binds so tightly."""
        return self.text if self.level >= level else f"({self.text})"

    @property
    def column(self) -> Column:
        made = _functions.expr(self.text)
        return made.alias(self.name) if self.name else made

    @property
    def _jc(self):
        return self.column._jc

    def __repr__(self) -> str:
        return f"Expr<{self.text}>"

    def __bool__(self) -> bool:
        raise ValueError("an expression has no truth value; use &, | and ~")

    __hash__ = None

    def _binary(self, sign: str, other, swap: bool = False):
        if _plain(other):
            mine, yours = self.column, other
            return getattr(yours if swap else mine, _METHODS[sign])(mine if swap else yours)
        level = _LEVELS[sign]
        if level <= AND:  # a chain has no depth
            sides = [e.parts if e.level == level else (e.at(level + 1),) for e in (self, F.lit(other))]
            parts = (*sides[swap], *sides[not swap])
            return Expr(f" {sign} ".join(parts), level=level, parts=parts)
        a, b = (e.at(ATOM if level == SUM else level + 1) for e in (self, F.lit(other)))
        return Expr(f"{b} {sign} {a}" if swap else f"{a} {sign} {b}", level=level)

    def __and__(self, o): return self._binary("AND", o)
    def __or__(self, o): return self._binary("OR", o)
    def __rand__(self, o): return self._binary("AND", o, True)
    def __ror__(self, o): return self._binary("OR", o, True)
    def __invert__(self): return Expr(f"NOT {self.at(COMPARED)}", level=NOT)
    def __eq__(self, o): return self._binary("=", o)
    def __ne__(self, o): return self._binary("!=", o)
    def __lt__(self, o): return self._binary("<", o)
    def __le__(self, o): return self._binary("<=", o)
    def __gt__(self, o): return self._binary(">", o)
    def __ge__(self, o): return self._binary(">=", o)
    def __add__(self, o): return self._binary("+", o)
    def __radd__(self, o): return self._binary("+", o, True)
    def __sub__(self, o): return self._binary("-", o)
    def __rsub__(self, o): return self._binary("-", o, True)
    def __mul__(self, o): return self._binary("*", o)
    def __rmul__(self, o): return self._binary("*", o, True)
    def __truediv__(self, o): return self._binary("/", o)
    def __mod__(self, o): return self._binary("%", o)
    def __neg__(self): return Expr(f"- {self.at(ATOM)}", level=SUM)
    def eqNullSafe(self, o): return self._binary("<=>", o)  # noqa: N802

    def __getitem__(self, key):
        if isinstance(key, str):
            return Expr(f"{self.at(ATOM)}.{quoted(key)}", key)
        return Expr(f"{self.at(ATOM)}[{text_of(key)}]")

    def cast(self, kind): return Expr(f"CAST({self.text} AS {ddl(kind)})")
    def try_cast(self, kind): return Expr(f"TRY_CAST({self.text} AS {ddl(kind)})")
    def isNull(self): return Expr(f"{self.at(SUM)} IS NULL", level=COMPARED)  # noqa: N802
    def isNotNull(self): return Expr(f"{self.at(SUM)} IS NOT NULL", level=COMPARED)  # noqa: N802
    def rlike(self, pattern): return self._binary("RLIKE", pattern)
    def startswith(self, o): return Expr(f"startswith({self.text}, {text_of(o)})")
    def alias(self, name): return Expr(self.text, name, self.level, self.parts)

    def isin(self, *values):
        values = values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values
        return Expr(f"{self.at(SUM)} IN ({', '.join(map(text_of, values))})", level=COMPARED)


class Case(Expr):
    """CASE WHEN ... END, to which branches can be added."""

    def __init__(self, branches: tuple[tuple[str, str], ...]):
        super().__init__("", level=CASE)
        self.branches = branches

    @property
    def text(self) -> str:
        return f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in self.branches)} END"

    def when(self, condition, value):
        if _plain(condition) or _plain(value):
            return self.column.when(condition, value)
        return Case((*self.branches, (text_of(condition), text_of(value))))

    def otherwise(self, value):
        if _plain(value):
            return self.column.otherwise(value)
        return Expr(f"{self.text[:-4]} ELSE {text_of(value)} END", level=CASE)


class Concat(Expr):
    """A concat() of texts, numbers and strings."""

    def __init__(self, args: tuple):
        super().__init__(f"concat({', '.join(map(text_of, args))})")
        self.args = args


class _Functions:
    """The functions of pyspark.sql.functions, over Exprs where there is no Column."""

    def __getattr__(self, name: str):
        plain = getattr(_functions, name)

        def call(*args):
            if any(map(_plain, args)):
                return plain(*args)
            return Expr(f"{name}({', '.join(map(text_of, args))})")

        setattr(self, name, call)
        return call

    def col(self, name: str) -> Expr:
        return Expr(quoted(name), name)

    def lit(self, value):
        if isinstance(value, Column):
            return value
        made = Expr(text_of(value))
        made.literal = value
        return made

    def when(self, condition, value):
        if _plain(condition) or _plain(value):
            return _functions.when(condition, value)
        return Case(((text_of(condition), text_of(value)),))

    def concat(self, *values):
        """One call for nested ones; neighbouring literals are one."""
        if any(map(_plain, values)):
            return _functions.concat(*values)
        args: list = []
        for value in itertools.chain.from_iterable(v.args if isinstance(v, Concat) else (v,) for v in values):
            literal = value.literal if isinstance(value, Expr) else value
            if isinstance(literal, str) and args and isinstance(args[-1], str):
                args[-1] += literal
            else:
                args.append(literal if isinstance(literal, str) else value)
        return Concat(tuple(args))

    def struct(self, *fields):
        if any(map(_plain, fields)):
            return _functions.struct(*fields)
        return Expr("named_struct(" + ", ".join(f"{text_of(f.name)}, {f.text}" for f in fields) + ")")

    def _over(self, name: str, values, body: Callable):
        if _plain(values):
            return getattr(_functions, name)(values, body)
        names = [f"v_{next(_numbers)}" for _ in inspect.signature(body).parameters]
        inner = body(*(Expr(n, n) for n in names))
        head = names[0] if len(names) == 1 else f"({', '.join(names)})"
        return Expr(f"{name}({text_of(values)}, {head} -> {text_of(inner)})")

    def transform(self, values, body): return self._over("transform", values, body)
    def filter(self, values, body): return self._over("filter", values, body)
    def forall(self, values, body): return self._over("forall", values, body)


F = _Functions()


def let(value, body: Callable):
    """The body with the value bound to a name, so it is computed once and does not double
    the expression each time it is used. A name or field, and a value that is used once, need
    no binding (which is a lambda, and so is not compiled)."""
    if _plain(value):
        return _functions.transform(_functions.array(value), body)[0]
    if _PATH.fullmatch(value.text):
        return body(value)
    name = f"v_{next(_numbers)}"
    made = F.lit(body(Expr(name, name)))
    inner = made.text
    uses = re.findall(rf"\b{name}\b", inner)
    if len(uses) <= 1 and "->" not in inner:
        return Expr(re.sub(rf"\b{name}\b", lambda _: value.at(ATOM), inner), level=made.level)
    return Expr(f"transform(array({value.text}), {name} -> {inner})[0]")


def once(value: Expr) -> Expr:
    """The value, computed in the one place where it stands. The optimizer keeps an expression
    that may differ between partitions in its own projection: it neither copies it to each use
    of a column (a filter that an explode infers, a field that is taken), nor moves it into a
    Python call's arguments, which cannot hold lambda expressions. A generator of one row would
    do so too, but what generators take is interpreted, not compiled."""
    return F.when(F.spark_partition_id() >= 0, value)
