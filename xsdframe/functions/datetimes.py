"""Dates and times as structs of numbers: parsed, moved to UTC, and written canonically.

Years are signed and there is no year zero; the fraction of a second stays a string of
digits without trailing zeros; tzOffset is 0 for a value with a zone (it is moved to UTC)
and null for one without. Values are taken as lexically right; wrong ones give null
fields, so check with functions.lexical first. 24:00:00 is the next day's midnight, in a
time it wraps. Recurring forms are moved within the year 2000.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from .sql import F, let

from .lexical import MONTH, USUAL_DAY, USUAL_YEAR, YEAR, collapse, full

_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})?"
#: Fields of each type's struct, in order.
FIELDS = {
    "date": ("year", "month", "day"),
    "dateTime": ("year", "month", "day", "hour", "minute", "second", "fraction"),
    "time": ("hour", "minute", "second", "fraction"),
    "gYear": ("year",),
    "gYearMonth": ("year", "month"),
    "gMonth": ("month",),
    "gMonthDay": ("month", "day"),
    "gDay": ("day",),
}
REFERENCE_YEAR = 2000


def zone_minutes(c: Column) -> Column:
    """Minutes east of UTC at the end of a lexical; null without a zone."""
    zone = F.regexp_extract(c, r"(Z|[+-][0-9]{2}:[0-9]{2})\z", 1)
    minutes = F.substr(zone, F.lit(2), F.lit(2)).cast("int") * 60 + F.substr(zone, F.lit(5), F.lit(2)).cast("int")
    return F.when(zone == "Z", 0).when(zone != "", F.when(zone.startswith("-"), -minutes).otherwise(minutes))


def _leap(year: Column) -> Column:
    year = F.when(year < 0, year + 1).otherwise(year)  # 1 BC counts as 0 in the calendar's rule
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def _days(year: Column, month: Column) -> Column:
    return F.when(month == 2, F.when(_leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _moved(year: Column, month: Column, day: Column, by: Column) -> Column:
    """(y, m, d) of a day later or earlier, over months and years, where there is no year zero."""

    def place(r: Column) -> Column:
        under, over = r["to"] < 1, r["to"] > r["last"]
        before, after = F.when(r["y"] == 1, -1).otherwise(r["y"] - 1), F.when(r["y"] == -1, 1).otherwise(r["y"] + 1)
        y = F.when(under & (r["m"] == 1), before).when(over & (r["m"] == 12), after).otherwise(r["y"])
        m = F.when(under, F.when(r["m"] == 1, 12).otherwise(r["m"] - 1)).when(over, F.when(r["m"] == 12, 1).otherwise(r["m"] + 1)).otherwise(r["m"])
        then = F.struct(y.cast("long").alias("y"), m.cast("int").alias("m"), under.alias("under"), over.alias("over"), r["to"].alias("to"))
        return let(then, lambda t: F.struct(t["y"], t["m"], F.when(t["under"], _days(t["y"], t["m"])).when(t["over"], 1).otherwise(t["to"]).alias("d")))

    start = F.struct(year.cast("long").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"), by.cast("int").alias("by"))
    return let(start, lambda s: let(F.struct(s["y"], s["m"], (s["d"] + s["by"]).alias("to"), _days(s["y"], s["m"]).alias("last")), place))


def _group(c: Column, pattern: str, n: int, kind: str = "int") -> Column:
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit("")).cast(kind)


def _offset(zone: Column) -> Column:
    return F.when(zone.isNotNull(), 0)


def _struct(name: str, *values: Column) -> Column:
    kinds = {"fraction": "string", "year": "long"}
    return F.struct(*(v.cast(kinds.get(n, "int")).alias(n) for n, v in zip((*FIELDS[name], "tzOffset"), values)))


def _trim_fraction(digits: Column) -> Column:
    return F.nullif(F.regexp_replace(digits, r"0+\z", ""), F.lit(""))


def _read(c: Column, build: Callable[[Column, Column], Column]) -> Column:
    """The build of a collapsed lexical and its zone, both bound."""
    return let(collapse(c), lambda t: let(zone_minutes(t), lambda zone: build(t, zone)))


def _back(zone: Column) -> Column:
    """Days that the begin of a day with this zone lies off in UTC."""
    return F.floor(-F.coalesce(zone, F.lit(0)) / 1440).cast("int")


def _usual(name: str, form: str, places: dict[str, int], other: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The parser, with a shorter way for forms of fixed places that stay where they are in UTC
    (no zone, or one of nothing). It is compiled; the other way binds names, which is interpreted.
    places: where each field begins, counted from 1; the form's length is the last field's end."""
    kinds = {"year": ("bigint", 4)}

    def parse(c: Column) -> Column:
        parts, end = [], 0
        for field, start in places.items():
            kind, size = kinds.get(field, ("int", 2))
            parts.append(F.substr(c, F.lit(start), F.lit(size)).cast(kind))
            end = start + size - 1
        zone = F.when(F.length(c) > end, F.lit(0))
        return F.when(full(c, rf"{form}(?:Z|[+-]00:00)?"), _struct(name, *parts, zone)).otherwise(other(c))

    return parse


def parse_date_time(c: Column) -> Column:
    p = rf"\A({YEAR})-([0-9]{{2}})-([0-9]{{2}})T([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}})(?:\.([0-9]+))?{_ZONE}\z"

    def build(t: Column, zone: Column) -> Column:
        def day(total: Column) -> Column:
            by = F.floor(total / 1440).cast("int")
            day = _moved(_group(t, p, 1, "long"), _group(t, p, 2), _group(t, p, 3), by)
            rest = total - by * 1440
            clock = (F.floor(rest / 60), rest % 60, _group(t, p, 6), _trim_fraction(F.regexp_extract(t, p, 7)))
            return let(day, lambda d: _struct("dateTime", d["y"], d["m"], d["d"], *clock, _offset(zone)))

        return let(_group(t, p, 4) * 60 + _group(t, p, 5) - F.coalesce(zone, F.lit(0)), day)

    return _read(c, build)


def _parse_date(c: Column) -> Column:
    """A day with a zone is the UTC day in which it begins."""
    p = rf"\A({YEAR})-([0-9]{{2}})-([0-9]{{2}}){_ZONE}\z"
    return _read(c, lambda t, zone: let(
        _moved(_group(t, p, 1, "long"), _group(t, p, 2), _group(t, p, 3), _back(zone)),
        lambda d: _struct("date", d["y"], d["m"], d["d"], _offset(zone)),
    ))


def parse_time(c: Column) -> Column:
    p = rf"\A([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}})(?:\.([0-9]+))?{_ZONE}\z"
    return _read(c, lambda t, zone: let(
        F.pmod(_group(t, p, 1) * 60 + _group(t, p, 2) - F.coalesce(zone, F.lit(0)), F.lit(1440)),
        lambda rest: _struct("time", F.floor(rest / 60), rest % 60, _group(t, p, 3), _trim_fraction(F.regexp_extract(t, p, 4)), _offset(zone)),
    ))


def _recurring(c: Column, name: str, pattern: str, year: int | None = None, month: int | None = None, day: int | None = None) -> Column:
    """A form with some of year, month and day; the others are given, the groups of the
    pattern are the rest in order."""

    def build(t: Column, zone: Column) -> Column:
        n, parts = 0, []
        for given, kind in ((year, "long"), (month, "int"), (day, "int")):
            if given is None:
                n += 1
            parts.append(_group(t, pattern, n, kind) if given is None else F.lit(given))
        keep = {"year": "y", "month": "m", "day": "d"}
        return let(_moved(*parts, _back(zone)), lambda d: _struct(name, *(d[keep[f]] for f in FIELDS[name]), _offset(zone)))

    return _read(c, build)


def _parse_gyear(c: Column) -> Column:
    return _recurring(c, "gYear", rf"\A({YEAR}){_ZONE}\z", month=1, day=1)


def _parse_gyearmonth(c: Column) -> Column:
    return _recurring(c, "gYearMonth", rf"\A({YEAR})-({MONTH}){_ZONE}\z", day=1)


def _parse_gmonth(c: Column) -> Column:
    return _recurring(c, "gMonth", rf"\A--({MONTH})(?:--)?{_ZONE}\z", year=REFERENCE_YEAR, day=1)


def _parse_gmonthday(c: Column) -> Column:
    return _recurring(c, "gMonthDay", rf"\A--([0-9]{{2}})-([0-9]{{2}}){_ZONE}\z", year=REFERENCE_YEAR)


def _parse_gday(c: Column) -> Column:
    return _recurring(c, "gDay", rf"\A---([0-9]{{2}}){_ZONE}\z", year=REFERENCE_YEAR, month=1)


parse_date = _usual("date", f"{USUAL_YEAR}-{USUAL_DAY}", {"year": 1, "month": 6, "day": 9}, _parse_date)
parse_gyear = _usual("gYear", USUAL_YEAR, {"year": 1}, _parse_gyear)
parse_gyearmonth = _usual("gYearMonth", f"{USUAL_YEAR}-{MONTH}", {"year": 1, "month": 6}, _parse_gyearmonth)
parse_gmonth = _usual("gMonth", f"--{MONTH}", {"month": 3}, _parse_gmonth)
parse_gmonthday = _usual("gMonthDay", f"--{USUAL_DAY}", {"month": 3, "day": 6}, _parse_gmonthday)
parse_gday = _usual("gDay", "---(?:0[1-9]|[12][0-9]|3[01])", {"day": 4}, _parse_gday)

DURATION_PARTS = ("years", "months", "days", "hours", "minutes", "seconds")


def parse_duration(c: Column) -> Column:
    """Sign and parts as they are written; nothing is carried between them. A duration of
    zero is not negative."""
    p = r"\A-?P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)(?:\.([0-9]+))?S)?)?\z"

    def build(t: Column) -> Column:
        parts = F.struct(
            *(F.coalesce(_group(t, p, k + 1, "long"), F.lit(0)).alias(n) for k, n in enumerate(DURATION_PARTS)),
            _trim_fraction(F.regexp_extract(t, p, 7)).alias("fraction"),
        )

        def signed(v: Column) -> Column:
            some = v["fraction"].isNotNull()
            for n in DURATION_PARTS:
                some = some | (v[n] != 0)
            return F.struct((t.startswith("-") & some).alias("negative"), *(v[n].alias(n) for n in (*DURATION_PARTS, "fraction")))

        return F.when(t.rlike(p), let(parts, signed))

    usual = F.struct(
        F.lit(False).alias("negative"), *(F.coalesce(_group(c, p, k + 1, "long"), F.lit(0)).cast("bigint").alias(n) for k, n in enumerate(DURATION_PARTS)),
        _trim_fraction(F.regexp_extract(c, p, 7)).alias("fraction"),
    )
    return F.when(c.startswith("P") & c.rlike(p), usual).otherwise(let(collapse(c), build))


def _pad(c: Column, n: int) -> Column:
    text = F.abs(c).cast("string")
    return F.when(F.length(text) < n, F.lpad(text, n, "0")).otherwise(text)


def _year(c: Column) -> Column:
    return F.concat(F.when(c < 0, "-").otherwise(""), _pad(c, 4))


def _zone(v: Column) -> Column:
    return F.when(v["tzOffset"].isNotNull(), "Z").otherwise("")


def _clock(v: Column) -> Column:
    fraction = F.when(v["fraction"].isNotNull(), F.concat(F.lit("."), v["fraction"])).otherwise("")
    return F.concat(_pad(v["hour"], 2), F.lit(":"), _pad(v["minute"], 2), F.lit(":"), _pad(v["second"], 2), fraction)


def _bound(write: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def bound(v: Column) -> Column:
        return let(v, write)

    return bound


write_date = _bound(lambda v: F.concat(_year(v["year"]), F.lit("-"), _pad(v["month"], 2), F.lit("-"), _pad(v["day"], 2), _zone(v)))
write_date_time = _bound(
    lambda v: F.concat(_year(v["year"]), F.lit("-"), _pad(v["month"], 2), F.lit("-"), _pad(v["day"], 2), F.lit("T"), _clock(v), _zone(v))
)
write_time = _bound(lambda v: F.concat(_clock(v), _zone(v)))
write_gyear = _bound(lambda v: F.concat(_year(v["year"]), _zone(v)))
write_gyearmonth = _bound(lambda v: F.concat(_year(v["year"]), F.lit("-"), _pad(v["month"], 2), _zone(v)))
write_gmonth = _bound(lambda v: F.concat(F.lit("--"), _pad(v["month"], 2), _zone(v)))
write_gmonthday = _bound(lambda v: F.concat(F.lit("--"), _pad(v["month"], 2), F.lit("-"), _pad(v["day"], 2), _zone(v)))
write_gday = _bound(lambda v: F.concat(F.lit("---"), _pad(v["day"], 2), _zone(v)))


def _duration_text(v: Column) -> Column:
    part = lambda n, unit: F.when(v[n] != 0, F.concat(v[n].cast("string"), F.lit(unit))).otherwise("")
    some = lambda names: reduce(lambda a, b: a | b, [v[n] != 0 for n in names])
    seconds = F.when(v["fraction"].isNotNull(), F.concat(v["seconds"].cast("string"), F.lit("."), v["fraction"], F.lit("S"))).otherwise(part("seconds", "S"))
    days = F.concat(part("years", "Y"), part("months", "M"), part("days", "D"))
    clock = F.concat(F.lit("T"), part("hours", "H"), part("minutes", "M"), seconds)
    timed = some(DURATION_PARTS[3:]) | v["fraction"].isNotNull()
    body = F.when(timed, F.concat(days, clock)).when(some(DURATION_PARTS[:3]), days).otherwise("T0S")
    return F.concat(F.when(v["negative"], "-").otherwise(""), F.lit("P"), body)


write_duration = _bound(_duration_text)


#: By type: text to struct, and struct to canonical text.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "date": parse_date, "dateTime": parse_date_time, "time": parse_time, "gYear": parse_gyear, "gYearMonth": parse_gyearmonth,
    "gMonth": parse_gmonth, "gMonthDay": parse_gmonthday, "gDay": parse_gday, "duration": parse_duration,
}
WRITERS: dict[str, Callable[[Column], Column]] = {
    "date": write_date, "dateTime": write_date_time, "time": write_time, "gYear": write_gyear, "gYearMonth": write_gyearmonth,
    "gMonth": write_gmonth, "gMonthDay": write_gmonthday, "gDay": write_gday, "duration": write_duration,
}


def canonical(c: Column, datatype: str) -> Column:
    return WRITERS[datatype](PARSERS[datatype](c))
