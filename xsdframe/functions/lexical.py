"""Lexical spaces of the builtin types, as predicates over string columns.

Every predicate collapses white space first and is null for a null input. Patterns are
anchored by \\A and \\z, as $ would let a final line end pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from .sql import F, let


# The building blocks of XSD lexical forms.
TZ = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
YEAR = r"-?(?:[1-9][0-9]{4,}|[0-9]{4})"
MONTH = r"(?:0[1-9]|1[0-2])"
DAY = r"(?:0[1-9]|[12][0-9]|3[01])"
TIME = r"(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"
DURATION = r"-?P(?=[0-9T])(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?=[0-9.])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?"
# Name characters of XML 1.0, fifth edition.
NAME_START = (
    r"A-Z_a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}"
    r"\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
)
NAME_MORE = r"\-.0-9\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}"


def collapse(c: Column) -> Column:
    """White space runs become one blank and end blanks go; the four characters of XSD only."""
    return F.trim(F.regexp_replace(c, r"[\t\n\r ]+", " "))


def full(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def _form(pattern: str) -> Callable[[Column], Column]:
    return lambda c: full(collapse(c), pattern)


def _day_exists(c: Column) -> Column:
    """Whether a year-month-day form of right shape names a day; there is no year 0000."""
    p = rf"\A-?({YEAR[2:]})-([0-9]{{2}})-([0-9]{{2}})"
    part = lambda n: F.regexp_extract(c, p, n)
    # Leap years by the last four digits, so years of any length work.
    found = F.struct(part(1).alias("year"), part(2).alias("month"), part(3).cast("int").alias("day"), F.right(part(1), F.lit(4)).try_cast("int").alias("tail"))

    def check(v: Column) -> Column:
        leap = (v["tail"] % 4 == 0) & ((v["tail"] % 100 != 0) | (v["tail"] % 400 == 0))
        last = F.when(v["month"].isin("04", "06", "09", "11"), 30).when(v["month"] == "02", F.when(leap, 29).otherwise(28)).otherwise(31)
        return (v["year"] != "0000") & (v["day"] <= last)

    return let(found, check)


# Usual years, and days that are in any year, so all but 29 February.
USUAL_YEAR = "(?!0000)[0-9]{4}"
USUAL_DAY = f"(?:{MONTH}-(?:0[1-9]|1[0-9]|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"


def _dated(shape: str, usual: str) -> Callable[[Column], Column]:
    """usual: days that exist without a look at the year, in documents nearly all; compiled, while
    the rule for others binds names, which is interpreted."""
    other = lambda c: let(collapse(c), lambda t: F.when(full(t, shape), _day_exists(t)).when(t.isNotNull(), F.lit(False)))
    return lambda c: F.when(full(c, usual), F.lit(True)).otherwise(other(c))


xsd_date = _dated(f"{YEAR}-{MONTH}-{DAY}{TZ}", f"{USUAL_YEAR}-{USUAL_DAY}{TZ}")
xsd_date_time = _dated(f"{YEAR}-{MONTH}-{DAY}T{TIME}{TZ}", f"{USUAL_YEAR}-{USUAL_DAY}T{TIME}{TZ}")
xsd_time = _form(TIME + TZ)


def _year_not_zero(shape: str) -> Callable[[Column], Column]:
    return _form(rf"(?!-?0000(?![0-9])){shape}")


xsd_gyear = _year_not_zero(YEAR + TZ)
xsd_gyearmonth = _year_not_zero(f"{YEAR}-{MONTH}{TZ}")
xsd_gmonth = _form(f"--{MONTH}(?:--)?{TZ}")
xsd_gmonthday = _form(f"--(?:(?:01|03|05|07|08|10|12)-{DAY}|(?:04|06|09|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|[12][0-9])){TZ}")
xsd_gday = _form(f"---{DAY}{TZ}")
xsd_duration = _form(DURATION)
xsd_hex_binary = _form("(?:[0-9a-fA-F]{2})*")


def xsd_base64_binary(c: Column) -> Column:
    quads = r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"
    return full(F.regexp_replace(c, r"[\t\n\r ]+", ""), quads)


xsd_language = _form("[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*")
xsd_name = _form(f"[:{NAME_START}][:{NAME_START}{NAME_MORE}]*")
xsd_ncname = _form(f"[{NAME_START}][{NAME_START}{NAME_MORE}]*")
xsd_nmtoken = _form(f"[:{NAME_START}{NAME_MORE}]+")


def _list_of(item: str) -> Callable[[Column], Column]:
    return _form(f"{item}(?: {item})*")


xsd_nmtokens = _list_of(f"[:{NAME_START}{NAME_MORE}]+")
xsd_ncnames = _list_of(f"[{NAME_START}][{NAME_START}{NAME_MORE}]*")

#: Builtin types whose lexical form is checked; values stay the strings they are.
VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "date": xsd_date,
    "dateTime": xsd_date_time,
    "time": xsd_time,
    "gYear": xsd_gyear,
    "gYearMonth": xsd_gyearmonth,
    "gMonth": xsd_gmonth,
    "gMonthDay": xsd_gmonthday,
    "gDay": xsd_gday,
    "duration": xsd_duration,
    "hexBinary": xsd_hex_binary,
    "base64Binary": xsd_base64_binary,
    "language": xsd_language,
    "Name": xsd_name,
    "NCName": xsd_ncname,
    "ID": xsd_ncname,
    "IDREF": xsd_ncname,
    "ENTITY": xsd_ncname,
    "NMTOKEN": xsd_nmtoken,
    "NMTOKENS": xsd_nmtokens,
    "IDREFS": xsd_ncnames,
    "ENTITIES": xsd_ncnames,
}
