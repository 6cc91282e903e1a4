import pytest
from pyspark.sql import functions as F

from xsdframe.functions import datetimes as dt
from xsdframe.functions import lexical as lx
from xsdframe.functions import numeric as nm
from xsdframe.functions import pattern as pt

GOOD = {
    "date": ["2024-02-29", " 2023-12-31Z ", "-0044-03-15", "12024-01-01+14:00", "2000-02-29-13:59"],
    "dateTime": ["2024-01-01T24:00:00", "2024-01-01T00:00:00.123Z", "2024-01-01T24:00:00.00-05:00"],
    "time": ["23:59:59.9", "24:00:00", "00:00:00Z"],
    "gYear": ["2024", "-0001", "12345+01:00"],
    "gYearMonth": ["2024-12", "-0001-01Z"],
    "gMonth": ["--01", "--12--", "--05Z"],
    "gMonthDay": ["--02-29", "--12-31Z"],
    "gDay": ["---01", "---31+02:00"],
    "duration": ["P1Y", "-P1Y2M3DT4H5M6.7S", "PT0S", "P0D"],
    "hexBinary": ["", "0aFF"],
    "base64Binary": ["", "YWJj", "YW Jj", "YQ==", "YWI="],
    "language": ["en", "en-US", "x-abcdefgh"],
    "Name": ["a:b", "_x", "é.1-2"],
    "NCName": ["_x", "a.b"],
    "NMTOKEN": ["1a", "-", "a:b"],
    "NMTOKENS": ["1 2", " a "],
    "IDREFS": ["a b"],
}
BAD = {
    "date": ["2023-02-29", "0000-01-01", "2024-13-01", "2024-04-31", "24-01-01", "2024-01-01+14:01", "02024-01-01", "2024-01-01\n2", ""],
    "dateTime": ["2024-01-01T24:00:01", "2024-01-01", "2024-02-30T00:00:00", "2024-01-01T25:00:00"],
    "time": ["24:00:01", "1:00:00", "23:60:00"],
    "gYear": ["0000", "123", "0000Z"],
    "gYearMonth": ["2024-00", "0000-01"],
    "gMonth": ["--13", "-01"],
    "gMonthDay": ["--02-30", "--04-31"],
    "gDay": ["---32", "--01"],
    "duration": ["P", "PT", "1Y", "P1S", "P1YT", "P-1Y"],
    "hexBinary": ["0", "0g"],
    "base64Binary": ["YWJ", "Y===", "YW=j"],
    "language": ["toolonglang", "en_US", ""],
    "Name": ["1a", "-x", ""],
    "NCName": ["a:b", "1"],
    "NMTOKEN": ["a b", ""],
    "NMTOKENS": ["", "a,b"],
    "IDREFS": ["1", "", "a 2"],
}


@pytest.mark.parametrize("name", sorted(GOOD))
def test_lexical(spark, name):
    rows = [(v, True) for v in GOOD[name]] + [(v, False) for v in BAD[name]]
    df = spark.createDataFrame(rows, "v string, ok boolean")
    wrong = df.where(~F.col("ok").eqNullSafe(lx.VALIDATORS[name](F.col("v")))).collect()
    assert not wrong


CANON = [
    ("date", "2024-01-01", "2024-01-01"), ("date", "2024-01-01+01:00", "2023-12-31Z"), ("date", "2024-12-31-05:00", "2024-12-31Z"),
    ("dateTime", "2023-12-31T24:00:00Z", "2024-01-01T00:00:00Z"), ("dateTime", "0001-01-01T00:30:00+01:00", "-0001-12-31T23:30:00Z"),
    ("dateTime", "2024-02-28T23:30:00.500-01:00", "2024-02-29T00:30:00.5Z"), ("dateTime", "2024-01-01T24:00:00", "2024-01-02T00:00:00"),
    ("time", "24:00:00", "00:00:00"), ("time", "00:30:00+01:00", "23:30:00Z"), ("time", "01:02:03.100", "01:02:03.1"),
    ("gYear", "2024", "2024"), ("gYear", "0001+01:00", "-0001Z"), ("gYearMonth", "2024-01+01:00", "2023-12Z"), ("gMonth", "--03--", "--03"),
    ("gMonthDay", "--03-01+01:00", "--02-29Z"), ("gDay", "---05", "---05"), ("duration", "P0Y0M", "PT0S"), ("duration", "-PT0.0S", "PT0S"),
    ("duration", "-P1Y0M3DT4H0M6.70S", "-P1Y3DT4H6.7S"), ("duration", "P14M", "P14M"), ("duration", "PT0.5S", "PT0.5S"),
]


@pytest.mark.parametrize("name", sorted({c[0] for c in CANON}))
def test_canonical_and_again(spark, name):
    df = spark.createDataFrame([(a, b) for n, a, b in CANON if n == name], "v string, want string")
    once = dt.canonical(F.col("v"), name)
    for r in df.select("v", "want", once.alias("got"), dt.canonical(once, name).alias("again")).collect():
        assert r.got == r.want == r.again, r


def test_numbers(spark):
    rows = [("1200", 4, 0), ("0.0012", 2, 4), ("-12.50", 3, 1), ("0", 1, 0), ("007", 1, 0), (".5", 1, 1), ("1e3", None, None), ("x", None, None)]
    df = spark.createDataFrame(rows, "v string, total int, fraction int")
    for r in df.select("*", nm.total_digits(F.col("v")).alias("t"), nm.fraction_digits(F.col("v")).alias("f")).collect():
        assert (r.t, r.f) == (r.total, r.fraction), r
    pairs = [("1", "2", -1), ("-1", "1", -1), ("-0", "0.0", 0), ("10", "9", 1), ("-10", "-9", -1), ("0.1", "0.10", 0), ("1e3", "1", None),
             ("123456789012345678901234567890123456789012345.1", "123456789012345678901234567890123456789012345.2", -1), ("+5", "5.", 0), ("0.09", "0.1", -1)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert not df.where(~F.col("want").eqNullSafe(nm.decimal_compare(F.col("a"), F.col("b")))).collect()


def test_number_text(spark):
    values = [(0.0, "0"), (-0.0, "-0"), (100.0, "100"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (123456789.5, "123456789.5"), (12345678.0, "12345678"), (0.0001, "0.0001"),
              (1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (float("inf"), "INF"), (float("-inf"), "-INF"), (float("nan"), "NaN"), (-1.25e-5, "-0.0000125"), (1e20, "100000000000000000000"), (-12345678.25, "-12345678.25")]
    df = spark.createDataFrame(values, "v double, want string")
    assert not df.where(~F.col("want").eqNullSafe(nm.number_text(F.col("v")))).collect()


def test_coercion(spark):
    df = spark.createDataFrame([("yes",), ("1",), (" true ",), ("false",), (None,), ("+5",), ("007",), ("1.0",), ("INF",), ("1e3",), (" 2.5 ",), ("300",)], "v string")
    c = F.col("v")
    got = df.select(nm.to_boolean(c).alias("b"), nm.to_integer(c, "byte").alias("i"), nm.to_double(c).alias("d"), nm.to_double(c, False).alias("e")).collect()
    assert [r.b for r in got] == [None, True, True, False] + [None] * 8
    assert [r.i for r in got] == [None, 1, None, None, None, 5, 7, None, None, None, None, None]
    assert got[8].d == float("inf") and got[8].e is None and got[9].d == 1000 and got[10].d == 2.5


PATTERNS = [
    (r"\d{3}", "123", True), (r"\d{3}", "1234", False), (r"[a-z-[aeiou]]+", "bcd", True), (r"[a-z-[aeiou]]+", "bad", False), (r"\i\c*", "a-1", True),
    (r"\i\c*", "1a", False), (r"\p{IsBasicLatin}+", "abc", True), (r"\p{IsBasicLatin}+", "é", False), (r"\p{IsGreek}+", "αβ", True), (r"\p{Lu}\P{Lu}", "Ab", True),
    (r".", "\n", False), (r"a|b", "b", True), (r"\w+", "ab1", True), (r"\w+", "a-b", False), (r"\W", "-", True), (r"[\w]", "-", False), (r"[^\d]", "1", False), (r"[\D]", "x", True),
    (r"[a\-b]", "-", True), (r"[-a]", "-", True), (r"a&&b", "a&&b", True), (r"[&]", "&", True), (r"\s", "\t", True), (r"\S+", "x", True), (r"[\s\d]+", "1 2", True),
    (r"(?=x)x", "xx", True), (r"\d", "٣", True), (r"[^a-z-[b]]", "B", True), (r"x{2,}", "xxx", True), (r"\p{IsLatin-1Supplement}", "é", True), (r"a$", "a", True),
]


def test_patterns(spark):
    for p, v, want in PATTERNS:
        got = spark.createDataFrame([(v,)], "v string").select(pt.xsd_pattern(F.col("v"), p).alias("x")).first().x
        assert got == want, (p, v)
