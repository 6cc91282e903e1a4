from pyspark.sql import functions as F

from xsdframe import engine
from xsdframe.functions import F as X
from xsdframe.functions import datetimes, lexical, numeric
from xsdframe.plans.simple import INTEGERS, SimplePlans
from xsdframe.queries import SALES
from xsdframe.qname import XSD
from xsdframe.rule_queries import RULES

ZONES = ["", "Z", "+00:00", "-00:00", "+01:00", "-14:00", " "]
DATES = ["2000-01-01", "1999-02-28", "1999-02-29", "2000-02-29", "2000-04-30", "2000-04-31", "2000-12-31", "2000-13-01", "2000-00-10", "0000-01-01", "-0044-03-15", "12000-05-05", "1-1-1", "x"]
FORMS = {
    "date": DATES, "gYear": ["2000", "0001", "0000", "-0001", "12000", "99"], "gYearMonth": ["2000-01", "0000-01", "2000-13", "-0005-12", "12000-10"],
    "gMonth": ["--01", "--12", "--13", "--05--"], "gMonthDay": ["--02-28", "--02-29", "--02-30", "--04-31", "--12-31", "--1-1"], "gDay": ["---01", "---31", "---32", "---00"],
}


def test_usual_dates_are_read_as_all_others(spark):
    """The compiled way gives what the general one gives, for good lexicals and for bad ones."""
    for name, forms in FORMS.items():
        df = spark.createDataFrame([(f + z,) for f in [*forms, ""] for z in ZONES] + [(None,), ("\n2000-01-01",)], "c string").coalesce(1)
        general = getattr(datetimes, f"_parse_{name.lower()}")
        for c in (F.col("c"), X.col("c")):
            rows = df.select("c", datetimes.PARSERS[name](c).alias("a"), general(c).alias("b")).collect()
            assert [r for r in rows if r.a != r.b] == [] and any(r.a for r in rows)
    df = spark.createDataFrame([(d + t + z,) for d in DATES for t in ("", "T00:00:00", "T24:00:00.0", "T25:00:00") for z in ZONES] + [(None,)], "c string").coalesce(1)
    for check, shape in ((lexical.xsd_date, ""), (lexical.xsd_date_time, f"T{lexical.TIME}")):
        general = lexical._dated(f"{lexical.YEAR}-{lexical.MONTH}-{lexical.DAY}{shape}{lexical.TZ}", "(?!)")
        rows = df.select("c", check(X.col("c")).alias("a"), general(X.col("c")).alias("b")).collect()
        assert [r for r in rows if r.a != r.b] == [] and {r.a for r in rows} == {True, False, None}


def test_durations_written_in_parts(spark):
    told = {
        "P1Y2M3DT4H5M6.70S": "P1Y2M3DT4H5M6.7S", "PT0S": "PT0S", "-P0D": "PT0S", "-PT0.50S": "-PT0.5S", "P0Y0M05DT01H0M0.00S": "P5DT1H", "P2M": "P2M", " P1D ": "P1D", "-P1DT0M": "-P1D", "PT5M": "PT5M",
    }
    df = spark.createDataFrame([(k,) for k in told], "c string").coalesce(1)
    for c in (F.col("c"), X.col("c")):
        assert {r.c: r.d for r in df.select("c", datetimes.canonical(c, "duration").alias("d")).collect()} == told


def test_checks_are_compiled_and_made_once(spark):
    """No check of a flat type is a lambda, and no filter before an explode repeats them."""
    xml = spark.range(3).selectExpr("id", "string(id) AS xml")
    plan = engine.compile(engine.load_xsd(RULES), "dated", datatypes="structured")
    found = engine.validate(xml, "xml", plan, ["id"])
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("expected element day") == 1 and "filter(" not in text
    assert found.count() == 3


NUMBERS = [
    "0", "-0", "+0", "00", "0.0", "-0.0", "1", "+1", "01", "1.0", "1.50", "1.5", "15e-1", "1.5E0", "-1.5", " 1.5 ", "INF", "-INF", "NaN", "abc", "", "1.", ".5", "12", "+012.0", "1e21", "1000000000000000000000",
    "127", "128", "-128", "-129", "99999", "999999999", "2147483647", "2147483648", "-2147483649", "9223372036854775807", "9223372036854775808", "18446744073709551616", "9" * 40, "-" + "9" * 40, "0.1", "0.10000000000000001",
]


def test_equal_numbers_are_those_of_equal_canonical_text(spark):
    plans = SimplePlans(engine.load_xsd(SALES))
    df = spark.createDataFrame([(x,) for x in NUMBERS] + [(None,)], "c string").coalesce(1)
    for name in ("decimal", "double", "float", "byte", "int", "long", "integer", "unsignedLong"):
        p, tests = plans.get(f"{{{XSD}}}{name}"), []
        for told in ("0", "1", "1.5", "+012", "-1.5", "1e21", "INF", "NaN", "x", "128", "9223372036854775808", "9" * 40, "0.1"):
            old = p.comparable(X.col("c")) == p.comparable(X.lit(told))
            tests += [F.struct(p.same(X.col("c"), told).alias("a"), old.alias("b"), p._among(X.col("c"), [told, "2"]).alias("d"), (old | (p.comparable(X.col("c")) == p.comparable(X.lit("2")))).alias("e"))]
        for row in df.select("c", F.array(*tests).alias("t")).collect():
            assert [(name, row.c, k) for k, t in enumerate(row.t) if t.a != t.b or t.d != t.e] == []


def test_usual_integers_hold_in_every_check(spark):
    plans = SimplePlans(engine.load_xsd(SALES))
    df = spark.createDataFrame([(x,) for x in NUMBERS] + [(None,)], "c string").coalesce(1)
    for name in INTEGERS:
        p = plans.get(f"{{{XSD}}}{name}")
        if (usual := p.usual(X.col("c"))) is not None:
            rows = df.select("c", usual.alias("a"), p.holds(X.col("c")).alias("b")).collect()
            assert [r for r in rows if r.a and not r.b] == [] and any(r.a for r in rows)


def test_lines_are_checked_each(spark):
    """One faulty line among good ones gives its violations, in order; good lines give none."""
    good = '<line number="1"><part>1</part><quantity>1.5</quantity></line>'
    bad = ['<line number="x"><part>9223372036854775808</part></line>', '<line><part><b/></part><quantity>q</quantity></line>', f'<line number=" +2 "><part xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:nil="1"/><quantity>INF</quantity></line>']
    want = [
        [("@number", "lexical"), ("part", "range"), ("quantity", "required")], [("@number", "required"), ("part", "content"), ("quantity", "lexical")], [("part", "nil")],
    ]
    head = '<order xmlns="urn:sales" id="1" status="F"><custkey>1</custkey><total>1</total><date>2000-02-29</date>'
    texts = [head + body + "</order>" for body in ("", good * 3, *(good + b + good for b in bad), "".join(bad))]
    xml = spark.createDataFrame(list(enumerate(texts)), "k int, xml string").coalesce(1)
    found = engine.validate(xml, "xml", engine.compile(engine.load_xsd(SALES), "order"), ["k"]).collect()
    by = [sorted((r.path.removeprefix("/order/line/"), r.code) for r in found if r.k == k) for k in range(len(texts))]
    assert by == [[], [], *map(sorted, want), sorted(sum(want, []))]


def test_digits_of_usual_decimals(spark):
    """Counted as they stand, they are as many as with a blank before, which is taken apart."""
    forms = [*NUMBERS, "120", "120.0", "120.00", "-120.40", "100.001", "0.001", "10.", "-.5", "-1", "1.0000", "1" * 30 + ".10"]
    df = spark.createDataFrame([(x,) for x in forms] + [(None,)], "c string").coalesce(1)
    for count in (numeric.total_digits, numeric.fraction_digits):
        for c in (F.col("c"), X.col("c")):
            rows = df.select("c", count(c).alias("a"), count(F.concat(F.lit(" "), F.col("c"))).alias("b")).collect()
            assert [r for r in rows if r.a != r.b] == [] and {r.c: r.a for r in rows}["-120.40"] == (4 if count is numeric.total_digits else 1)
    text = df.select(numeric.total_digits(X.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE(c" in text and text.index("CASE WHEN RLIKE(c") < text.index("lambda")
