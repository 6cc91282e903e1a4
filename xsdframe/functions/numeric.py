"""Numbers: coercion behind lexical guards, digit counts, exact decimal order, canonical text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from .sql import F, let

from .lexical import full

INTEGER = r"[+-]?[0-9]+"
DECIMAL = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
FLOAT = rf"{DECIMAL}(?:[eE][+-]?[0-9]+)?"


#: Digits that DECIMAL(38,18) holds on either side of the point.
FITS = 18


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def to_boolean(c: Column) -> Column:
    """true, false, 1 or 0; null otherwise (a cast would also take yes and t)."""
    t = trimmed(c)
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def to_integer(c: Column, kind: str) -> Column:
    """An integer lexical as a Spark type; null if it is none or does not fit."""
    t = trimmed(c)
    return F.when(full(t, INTEGER), t.try_cast(kind))


def to_double(c: Column, specials: bool = True) -> Column:
    """A float lexical; INF, -INF and NaN for float and double only."""
    t = trimmed(c)
    out = F.when(full(t, FLOAT), t.try_cast("double"))
    return out.when(t == "INF", float("inf")).when(t == "-INF", float("-inf")).when(t == "NaN", float("nan")) if specials else out


def _parts(c: Column) -> Column:
    """(sign, whole, fraction) of a decimal lexical: integer digits without leading zeros and
    fraction digits without trailing zeros; null for other lexicals."""

    def build(t: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(t, r"\A[+-]?([0-9]*)", 1), r"\A0+", "")
        fraction = F.regexp_replace(F.regexp_extract(t, r"\.([0-9]*)\z", 1), r"0+\z", "")
        parts = F.struct(whole.alias("whole"), fraction.alias("fraction"), t.startswith("-").alias("minus"))
        sign = lambda p: F.when((p["whole"] == "") & (p["fraction"] == ""), 0).when(p["minus"], -1).otherwise(1)
        return F.when(full(t, DECIMAL), let(parts, lambda p: F.struct(sign(p).alias("sign"), p["whole"], p["fraction"])))

    return let(trimmed(c), build)


def decimal_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as decimal lexicals order, exactly and at any length; null if either is
    not a decimal lexical (exponents are not)."""
    way = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)

    def order(p: Column) -> Column:
        x, y = p["x"], p["y"]
        width = F.greatest(F.length(x["fraction"]), F.length(y["fraction"]))
        tail = way(F.rpad(x["fraction"], width, "0"), F.rpad(y["fraction"], width, "0"))
        head = F.when(F.length(x["whole"]) != F.length(y["whole"]), way(F.length(x["whole"]), F.length(y["whole"])))
        size = head.when(x["whole"] != y["whole"], way(x["whole"], y["whole"])).otherwise(tail)
        return F.when(x.isNotNull() & y.isNotNull(), F.when(x["sign"] != y["sign"], way(x["sign"], y["sign"])).otherwise(size * x["sign"]))

    return let(F.struct(_parts(a).alias("x"), _parts(b).alias("y")), order)


def within(c: Column, name: str, bound: str) -> Column:
    """Whether a decimal lexical keeps an order facet (minInclusive and the like), exactly; null
    if it is no decimal lexical. Numbers of usual length are compared as Spark decimals."""
    way = {"minInclusive": lambda x, y: x >= y, "maxInclusive": lambda x, y: x <= y, "minExclusive": lambda x, y: x > y, "maxExclusive": lambda x, y: x < y}[name]
    exact = way(decimal_compare(c, F.lit(bound)), 0)
    if len(bound) > FITS or not re.fullmatch(DECIMAL, bound):
        return exact
    t = trimmed(c)
    short = full(t, DECIMAL) & (F.length(t) <= FITS)
    return F.when(short, way(t.try_cast(f"decimal(38,{FITS})"), F.lit(bound).cast(f"decimal(38,{FITS})"))).otherwise(exact)


def in_range(c: Column, low: int | None, high: int | None) -> tuple[Column | None, Column | None]:
    """Whether an integer lexical keeps the least and the largest value of its type; null for
    other lexicals. Beyond what a Spark decimal holds the sign tells."""
    t = trimmed(c)
    n, minus = t.try_cast("decimal(38,0)"), t.startswith("-")
    number = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    least = None if low is None else F.when(full(t, INTEGER), F.coalesce(n >= number(low), ~minus))
    most = None if high is None else F.when(full(t, INTEGER), F.coalesce(n <= number(high), minus))
    return least, most


#: Decimals without white space, plus signs and leading zeros. Their digits are counted without
#: taking them apart, which binds names and so is interpreted.
USUAL = r"-?[1-9][0-9]*(?:\.[0-9]+)?"


def total_digits(c: Column) -> Column:
    """How many digits a decimal lexical has: trailing zeros of an integer count, leading
    zeros do not, nor do zeros between the point and the first digit of a pure fraction."""
    pure = lambda p: F.greatest(F.length(F.regexp_replace(p["fraction"], r"\A0+", "")), F.lit(1))
    count = lambda p: F.when(p["whole"] == "", pure(p)).otherwise(F.length(p["whole"]) + F.length(p["fraction"]))
    pointed = F.length(F.regexp_replace(c, r"\A-|0+\z", "")) - 1
    usual = F.when(F.instr(c, ".") > 0, pointed).otherwise(F.length(F.regexp_replace(c, r"\A-", "")))
    return F.when(full(c, USUAL), usual).otherwise(let(_parts(c), lambda p: F.when(p.isNotNull(), count(p))))


def fraction_digits(c: Column) -> Column:
    """Digits after the point, without trailing zeros."""
    usual = F.when(F.instr(c, ".") > 0, F.length(F.regexp_replace(c, r"0+\z", "")) - F.instr(c, ".")).otherwise(0)
    return F.when(full(c, USUAL), usual).otherwise(let(_parts(c), lambda p: F.length(p["fraction"])))


def has_total_digits(c: Column, most: int) -> Column:
    """Whether a number lexical keeps within `most` digits; INF, NaN and exponents pass."""
    return F.coalesce(total_digits(c) <= most, c.isNotNull())


def has_fraction_digits(c: Column, most: int) -> Column:
    return F.coalesce(fraction_digits(c) <= most, c.isNotNull())


def number_text(c: Column) -> Column:
    """A double as text: INF, -INF, NaN, -0, whole numbers without a point, and else the
    shortest digits, with an exponent from 1e21 up and below 1e-6."""


    def build(v: Column) -> Column:
        java = v["java"]
        mantissa = F.regexp_replace(F.regexp_extract(java, r"\A(-?[0-9.]+)", 1), r"\.0\z", "")
        exponent = F.regexp_extract(java, r"E(-?[0-9]+)\z", 1)
        first = F.struct(v["c"].alias("c"), mantissa.alias("mantissa"), exponent.alias("exponent"), F.nullif(exponent, F.lit("")).cast("int").alias("power"))
        plain = let(first, written)
        return (
            F.when(F.isnan(v["c"]), "NaN").when(v["c"] == float("inf"), "INF").when(v["c"] == float("-inf"), "-INF")
            .when(v["c"] == 0, F.when(java.startswith("-"), "-0").otherwise("0")).when(v["c"].isNotNull(), plain)
        )

    def written(p: Column) -> Column:
        far = F.concat(p["mantissa"], F.lit("e"), F.when(p["power"] > 0, "+").otherwise(""), p["exponent"])
        digits = F.regexp_replace(p["mantissa"], r"[-.]", "")
        point = F.length(F.regexp_extract(p["mantissa"], r"([0-9]+)", 1)) + p["power"]
        near = let(F.struct(digits.alias("digits"), point.alias("point")), moved)
        near = F.concat(F.when(p["c"] < 0, "-").otherwise(""), near)
        return F.when(p["exponent"] == "", p["mantissa"]).when((F.abs(p["c"]) >= 1e21) | (F.abs(p["c"]) < 1e-6), far).otherwise(near)

    def moved(d: Column) -> Column:
        digits, point = d["digits"], d["point"]
        return (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= F.length(digits), F.rpad(digits, point, "0"))
            .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        )

    return let(F.struct(c.alias("c"), c.cast("string").alias("java")), build)
