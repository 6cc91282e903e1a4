"""Simple types as Spark types, value columns and predicates."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import types as T

from ..functions import F, datetimes, let, lexical, numeric
from ..functions.pattern import java_pattern
from ..ir import Schema
from ..qname import XSD, split

# The ranges of the bounded integer types, and what holds them in Spark.
INTEGERS: dict[str, tuple[int | None, int | None, T.DataType]] = {
    "byte": (-128, 127, T.ByteType()),
    "short": (-32768, 32767, T.ShortType()),
    "int": (-2147483648, 2147483647, T.IntegerType()),
    "long": (-9223372036854775808, 9223372036854775807, T.LongType()),
    "unsignedByte": (0, 255, T.ShortType()),
    "unsignedShort": (0, 65535, T.IntegerType()),
    "unsignedInt": (0, 4294967295, T.LongType()),
    "unsignedLong": (0, 18446744073709551615, T.DecimalType(20, 0)),
    "integer": (None, None, T.DecimalType(38, 0)),
    "nonNegativeInteger": (0, None, T.DecimalType(38, 0)),
    "positiveInteger": (1, None, T.DecimalType(38, 0)),
    "nonPositiveInteger": (None, 0, T.DecimalType(38, 0)),
    "negativeInteger": (None, -1, T.DecimalType(38, 0)),
}
ITEMS = {"NMTOKENS", "IDREFS", "ENTITIES"}
OCTETS = {"hexBinary", "base64Binary"}

_DATE_FIELDS = {"fraction": T.StringType(), "year": T.LongType()}


def structured_type(name: str) -> T.StructType:
    """The struct that a date or time type is parsed into."""
    if name == "duration":
        parts = [T.StructField(n, T.LongType()) for n in datetimes.DURATION_PARTS]
        return T.StructType([T.StructField("negative", T.BooleanType()), *parts, T.StructField("fraction", T.StringType())])
    return T.StructType([T.StructField(n, _DATE_FIELDS.get(n, T.IntegerType())) for n in (*datetimes.FIELDS[name], "tzOffset")])


#: code, predicate over the lexical (true or null: it holds), message
Check = tuple[str, Callable[[Column], Column], str]


@dataclass
class SimplePlan:
    """A resolved simple type.

    kind: atomic, list or union. primitive: the builtin it comes from. space: what is done
    to white space before checks; shown: before the value too (an explicit facet).
    """

    name: str
    kind: str
    primitive: str
    spark: T.DataType
    steps: list[list[tuple[str, str]]] = field(default_factory=list)
    item: SimplePlan | None = None
    members: list[SimplePlan] = field(default_factory=list)
    space: str = "collapse"
    shown: bool = False
    structured: bool = False
    decimal: bool = False

    @property
    def clean(self) -> bool:
        """Whether typed values are written without any character that XML escapes."""
        return self.kind == "atomic" and (self.primitive in INTEGERS or self.primitive in ("boolean", "float", "double", "decimal") or self.structured)

    # White space

    def spaced(self, c: Column) -> Column:
        if self.space == "preserve":
            return c
        c = F.regexp_replace(c, r"[\t\n\r]", " ")
        return F.trim(F.regexp_replace(c, " +", " ")) if self.space == "collapse" else c

    # Values

    def value(self, c: Column) -> Column:
        """The typed value of a lexical; null if it has none."""
        if self.kind == "list":
            return F.transform(_tokens(c), self.item.value)
        if self.kind == "union":
            return self._union_value(c)
        p = self.primitive
        if p == "boolean":
            return numeric.to_boolean(c)
        if p in INTEGERS:
            return numeric.to_integer(c, self.spark.simpleString())
        if p in ("float", "double"):
            return numeric.to_double(c)
        if p == "decimal":
            number = numeric.to_double(c, specials=False)
            return F.when(number.isNotNull(), numeric.trimmed(c).try_cast(self.spark)) if self.decimal else number
        c = self.spaced(c) if self.shown else c
        return datetimes.PARSERS[p](c) if self.structured else c

    def _union_value(self, c: Column) -> Column:
        """The first member that the lexical suits; members of one type share a column, else
        a struct says which member it is."""
        suits = [m.holds for m in self.members]
        if not isinstance(self.spark, T.StructType) or self.spark.names[:1] != ["member"]:
            branches = [F.when(ok(c), m.value(c)) for ok, m in zip(suits, self.members)]
            return F.coalesce(*branches) if branches else c
        which = F.coalesce(*[F.when(ok(c), k) for k, ok in enumerate(suits)])
        return let(which, lambda w: F.struct(
            w.cast("int").alias("member"), c.alias("lexical"),
            *(F.when(w == k, m.value(c)).cast(m.spark).alias(f"m{k}") for k, m in enumerate(self.members)),
        ))

    def text(self, v: Column, member: int | None = None) -> Column:
        """The canonical lexical of a typed value."""
        if self.kind == "list":
            return F.array_join(F.transform(v, self.item.text), " ")
        if self.kind == "union":
            if isinstance(self.spark, T.StructType) and self.spark.names[:1] == ["member"]:
                parts = [F.when(v["member"] == k, m.text(v[f"m{k}"])) for k, m in enumerate(self.members)]
                return F.coalesce(*parts, v["lexical"])
            return self.members[0].text(v) if self.members else v.cast("string")
        p = self.primitive
        if p == "boolean":
            return F.when(v, "true").when(~v, "false")
        if p in ("float", "double") or (p == "decimal" and not self.decimal):
            return numeric.number_text(v)
        if p == "decimal":
            return F.regexp_replace(F.regexp_replace(v.cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
        if self.structured:
            return datetimes.WRITERS[p](v)
        return v.cast("string")

    # Checks

    def holds(self, c: Column) -> Column:
        """Whether a lexical is valid."""
        tests = [F.coalesce(test(c), F.lit(True)) for _, test, _ in self.checks()]
        return reduce(lambda a, b: a & b, tests, c.isNotNull())

    def usual(self, c: Column) -> Column | None:
        """A quick test of an integer type: lexicals that pass hold in every check, others may.
        None for types of more rules than their own."""
        if self.kind != "atomic" or self.steps or self.primitive not in INTEGERS:
            return None
        low, high, _ = INTEGERS[self.primitive]
        if (low or 0) > 0 or (high is not None and high <= 0):
            return None
        return lexical.full(c, f"{'' if low == 0 else '-?'}[0-9]{{1,{18 if high is None else min(18, len(str(high)) - 1)}}}")

    def checks(self) -> list[Check]:
        """All that a lexical must pass: its type's form first, then facets in the order white
        space, patterns, enumeration, bounds, lengths, digits. Vacuous ones are left out."""
        out: list[Check] = []
        p = self.primitive
        if self.kind == "list":
            out.append(("lexical", lambda c: F.forall(_tokens(c), self.item.holds), f"not a list of {self.item.primitive}"))
        elif self.kind == "union":
            out.append(("lexical", lambda c: reduce(lambda a, b: a | b, [m.holds(c) for m in self.members], F.lit(False)), "suits no member of the union"))
        elif p in INTEGERS:
            low, high, _ = INTEGERS[p]
            out.append(("lexical", lambda c: lexical.full(numeric.trimmed(c), numeric.INTEGER), f"not a lexical of {p}"))
            if low is not None:
                out.append(("range", lambda c: numeric.in_range(c, low, None)[0], f"less than {low}"))
            if high is not None:
                out.append(("range", lambda c: numeric.in_range(c, None, high)[1], f"greater than {high}"))
        elif p == "boolean":
            out.append(("lexical", lambda c: numeric.trimmed(c).isin("true", "false", "1", "0"), "not a lexical of boolean"))
        elif p in ("float", "double", "decimal"):
            out.append(("lexical", lambda c: numeric.to_double(c, p != "decimal").isNotNull(), f"not a lexical of {p}"))
        elif p in lexical.VALIDATORS:
            out.append(("lexical", lexical.VALIDATORS[p], f"not a lexical of {p}"))
        for step in self.steps:
            out += self._facets(step)
        return out

    def _facets(self, step: list[tuple[str, str]]) -> list[Check]:
        out: list[Check] = []
        patterns = [v for n, v in step if n == "pattern"]
        if patterns:
            test = lambda c: reduce(lambda a, b: a | b, [self.spaced(c).rlike(java_pattern(x)) for x in patterns])
            out.append(("pattern", test, "matches no pattern of " + " | ".join(patterns)))
        values = [v for n, v in step if n == "enumeration"]
        if values:
            out.append(("enumeration", lambda c: self._among(c, values), "not one of " + ", ".join(values)))
        for name, told in step:
            if name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
                if (test := self._bound(name, told)) is not None:
                    out.append((name, test, f"{name} {told}"))
            elif name in ("length", "minLength", "maxLength"):
                if (test := self._length(name, int(told))) is not None:
                    out.append((name, test, f"{name} {told}"))
            elif name == "totalDigits" and self._numeric():
                out.append((name, lambda c, n=int(told): numeric.has_total_digits(c, n), f"more than {told} digits"))
            elif name == "fractionDigits" and self.primitive in ("decimal", "float", "double"):
                out.append((name, lambda c, n=int(told): numeric.has_fraction_digits(c, n), f"more than {told} fraction digits"))
        return out

    def _numeric(self) -> bool:
        return self.kind == "atomic" and (self.primitive in INTEGERS or self.primitive in ("decimal", "float", "double"))

    def comparable(self, c: Column) -> Column:
        """What equal values have in common: canonical dates, typed values as text, or the string."""
        if self.kind == "atomic" and self.primitive in datetimes.PARSERS:
            good = lexical.VALIDATORS[self.primitive](c)
            return F.when(good, datetimes.canonical(c, self.primitive)).otherwise(c)
        if self.kind == "list":
            return F.array_join(F.transform(_tokens(c), self.item.comparable), " ")
        if self.kind == "union":
            return F.coalesce(*[F.when(m.holds(c), m.comparable(c)) for m in self.members], c)
        if self.primitive == "boolean" or self._numeric():
            return F.coalesce(self.text(self.value(c)), c)
        return self.spaced(c)

    def _among(self, c: Column, values: list[str]) -> Column:
        if self._numeric() and all(re.fullmatch(numeric.FLOAT if self.primitive not in INTEGERS else numeric.INTEGER, x) for x in values):
            return self._equal(c, values)
        plain = self.kind == "atomic" and self.primitive not in datetimes.PARSERS and not self._numeric() and self.primitive != "boolean"
        if plain:
            return self.spaced(c).isin(values)
        return let(self.comparable(c), lambda v: reduce(lambda a, b: a | b, [v == self.comparable(F.lit(x)) for x in values]))

    def same(self, c: Column, told: str) -> Column:
        """Whether a lexical means what another, of the schema, means."""
        if self._numeric() and re.fullmatch(numeric.FLOAT if self.primitive not in INTEGERS else numeric.INTEGER, told):
            return self._equal(c, [told])
        return self.comparable(c) == self.comparable(F.lit(told))

    def _equal(self, c: Column, values: list[str]) -> Column:
        """Whether a lexical is one of some numbers, by value. Equal values have one canonical text
        (see comparable), and only they; zeros, which have two, and numbers beyond the type, which
        have none, are compared as text."""
        if any(self._zero_or_beyond(x) for x in values):
            return let(self.comparable(c), lambda v: reduce(lambda a, b: a | b, [v == self.comparable(F.lit(x)) for x in values]))
        kind = self.spark.simpleString()
        among = reduce(lambda a, b: a | b, [self.value(c) == F.lit(x.strip("+")).cast(kind) for x in values])
        return F.when(c.isNotNull(), F.coalesce(among, F.lit(False)))

    def _zero_or_beyond(self, told: str) -> bool:
        if self.primitive in INTEGERS:
            low, high, _ = INTEGERS[self.primitive]
            return len(told) > numeric.FITS or not (low is None or int(told) >= low) or not (high is None or int(told) <= high)
        return self.decimal or not 1e-300 < abs(float(told)) < 1e300

    def _bound(self, name: str, told: str):
        """Order facets: exact on decimals and integers, by value on floats; others have none."""
        if not self._numeric():
            return None
        way = {"minInclusive": lambda x: x >= 0, "maxInclusive": lambda x: x <= 0, "minExclusive": lambda x: x > 0, "maxExclusive": lambda x: x < 0}[name]
        if self.primitive in ("float", "double"):
            def test(c: Column) -> Column:
                v, b = numeric.to_double(c), numeric.to_double(F.lit(told))
                return ~F.isnan(v) & way(F.when(v < b, -1).when(v > b, 1).otherwise(0))
            return test
        # A lexical with an exponent cannot be ordered exactly and fails.
        return lambda c: F.coalesce(numeric.within(c, name, told), F.lit(False))

    def _length(self, name: str, n: int):
        """Characters, octets of binary types, items of lists; QNames have no length."""
        way = {"length": lambda x: x == n, "minLength": lambda x: x >= n, "maxLength": lambda x: x <= n}[name]
        if self.primitive in ("QName", "NOTATION"):
            return None
        if self.kind == "list" or self.primitive in ITEMS:
            return lambda c: way(F.size(_tokens(c)))
        if self.primitive == "hexBinary":
            return lambda c: way(F.length(self.spaced(c)) / 2)
        if self.primitive == "base64Binary":
            return lambda c: way(F.floor(F.length(F.regexp_replace(c, r"[\t\n\r =]", "")) * 3 / 4))
        return lambda c: way(F.length(self.spaced(c)))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


class SimplePlans:
    """Plans of a schema's simple types, made once each."""

    def __init__(self, schema: Schema, structured: bool = False, decimal: bool = False):
        self.schema, self.structured, self.decimal = schema, structured, decimal
        self.made: dict[str, SimplePlan] = {}

    def get(self, name: str, open: tuple[str, ...] = ()) -> SimplePlan:
        if name not in self.made:
            self.made[name] = self._make(name, open)
        return self.made[name]

    def _make(self, name: str, open: tuple[str, ...]) -> SimplePlan:
        found = self.schema.simple.get(name)
        if found is None or name in open:
            return self._builtin(name)
        open = (*open, name)
        if found.kind == "list":
            item = self.get(found.item, open)
            return SimplePlan(name, "list", item.primitive, T.ArrayType(item.spark), item=item, shown=True)
        if found.kind == "union":
            members = [self.get(m, open) for m in found.members]
            kinds = {m.spark.simpleString() for m in members}
            if len(kinds) == 1:
                spark = members[0].spark
            elif members:
                spark = T.StructType([T.StructField("member", T.IntegerType()), T.StructField("lexical", T.StringType()), *(T.StructField(f"m{k}", m.spark) for k, m in enumerate(members))])
            else:
                spark = T.StringType()
            return SimplePlan(name, "union", "union", spark, members=members, space="preserve")
        base = self.get(found.base, open)
        space, shown = base.space, base.shown
        for facet, told in found.facets:
            if facet == "whiteSpace":
                space, shown = told, told != "preserve" or base.shown
        facets = [f for f in found.facets if f[0] != "whiteSpace"]
        return SimplePlan(
            name, base.kind, base.primitive, base.spark, [*base.steps, facets] if facets else base.steps, base.item, base.members, space, shown,
            base.structured, base.decimal,
        )

    def _builtin(self, name: str) -> SimplePlan:
        namespace, p = split(name)
        p = p if namespace == XSD else "string"
        if p in INTEGERS:
            return SimplePlan(name, "atomic", p, INTEGERS[p][2])
        if p == "boolean":
            return SimplePlan(name, "atomic", p, T.BooleanType())
        if p in ("float", "double"):
            return SimplePlan(name, "atomic", p, T.DoubleType())
        if p == "decimal":
            return SimplePlan(name, "atomic", p, T.DecimalType(38, 18) if self.decimal else T.DoubleType(), decimal=self.decimal)
        if self.structured and p in datetimes.PARSERS:
            return SimplePlan(name, "atomic", p, structured_type(p), structured=True)
        space = "preserve" if p in ("string", "anySimpleType", "anyType") else "replace" if p == "normalizedString" else "collapse"
        return SimplePlan(name, "atomic", p, T.StringType(), space=space)
