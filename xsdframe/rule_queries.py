"""More queries over the synthetic tables, beside those of queries.py: rules that documents
break, and what is written again."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine
from .functions import datetimes, lexical
from .operators.shred import decoded
from .operators.writer import escape_text
from .queries import NS, at, doc, el, money, query, spread, table, txt

RULES = os.path.join(os.path.dirname(__file__), "examples", "rules.xsd")
XSI = "http://www.w3.org/2001/XMLSchema-instance"
ISSUES = ["k", "path", "code"]


def plan(root: str, **options) -> engine.Plan:
    return engine.compile(engine.load_xsd(RULES), root, **options)


def rows_of(spark: SparkSession, sf_dir: str, name: str, key: str, root: str, *parts: Column, attrs: Column | None = None) -> DataFrame:
    """(k, xml): a document for each row of a table."""
    keyed = at("key", F.col(key))
    return spread(table(spark, sf_dir, name)).select(F.col(key).alias("k"), doc(root, keyed if attrs is None else F.concat(keyed, attrs), *parts).alias("xml"))


def issues_of(xml: DataFrame, root: str) -> DataFrame:
    return engine.validate(xml, "xml", plan(root), ["k"]).select(*ISSUES)


def again(xml: DataFrame, root: str, **options) -> DataFrame:
    """k, doc, out: read, written from the values alone, and read again."""
    p = plan(root, **options)
    once = engine.safe_parse_xml(xml, "xml", p).select("k", "doc")
    return engine.safe_parse_xml(engine.to_xml(once, "doc", p, "out").drop("doc"), "out", p)


# Facets


@query("""
    WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS flag, o_orderkey % 4 AS h, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS money,
                      CAST(o_orderkey % 300 - 150 AS INT) AS small, o_orderkey % 3 AS fix, CAST(o_custkey % 60 AS INT) AS level FROM orders),
    m AS (SELECT *, rtrim(split_part(money, '.', 2), '0') AS f, split_part(money, '.', 1) AS w FROM o)
    SELECT k, '/checked/flag' AS path, 'enumeration' AS code FROM m WHERE flag NOT IN ('F', 'O')
    UNION ALL SELECT k, '/checked/half', 'enumeration' FROM m WHERE h = 3
    UNION ALL SELECT k, '/checked/money', 'totalDigits' FROM m WHERE length(w) + length(f) > 7
    UNION ALL SELECT k, '/checked/money', 'fractionDigits' FROM m WHERE length(f) > 1
    UNION ALL SELECT k, '/checked/small', 'range' FROM m WHERE small < -128 OR small > 127
    UNION ALL SELECT k, '/checked/fix', 'fixed' FROM m WHERE fix = 2
    UNION ALL SELECT k, '/checked/level', 'minInclusive' FROM m WHERE level < 5
    UNION ALL SELECT k, '/checked/level', 'maxInclusive' FROM m WHERE level > 50""")
def facet_rules(spark, sf_dir):
    """Enumerations by value, digits, ranges of builtin types, fixed values by value, and a
    redefined type's bounds on top of its original's."""
    k = F.col("o_orderkey")
    half = F.when(k % 4 == 0, "<half>0.50</half>").when(k % 4 == 1, "<half>+012.0</half>").when(k % 4 == 2, "").otherwise("<half>2.5</half>")
    fix = F.when(k % 3 == 0, "<fix>1.5</fix>").when(k % 3 == 1, "<fix/>").otherwise("<fix>1.51</fix>")
    return issues_of(rows_of(
        spark, sf_dir, "orders", "o_orderkey", "checked", txt("flag", F.col("o_orderstatus")), half, txt("money", money("o_totalprice")), F.lit("<word>ABCDEFGHI</word><spaced> a \n b </spaced>"),
        txt("level", F.col("o_custkey") % 60), txt("small", k % 300 - 150), fix,
    ), "checked")


@query("""
    WITH p AS (SELECT p_partkey AS k, upper(left(p_type, 1)) || substr(p_type, 2, 12) AS t, p_size % 4 AS n FROM part)
    SELECT k, '/checked/word' AS path, 'maxLength' AS code FROM p WHERE length(t) > 12
    UNION ALL SELECT k, '/checked/word', 'minLength' FROM p WHERE length(t) < 9
    UNION ALL SELECT k, '/checked/word', 'pattern' FROM p WHERE NOT regexp_full_match(t, '[A-Z].*')
    UNION ALL SELECT k, '/checked/word', 'pattern' FROM p WHERE NOT regexp_full_match(t, '.*[A-M]')
    UNION ALL SELECT k, '/checked/spaced', 'length' FROM p WHERE n <> 1""")
def facet_inheritance(spark, sf_dir):
    """Facets of two derivation steps all count, patterns of each step for themselves; a length
    is that of the collapsed text."""
    t = F.concat(F.upper(F.left("p_type", F.lit(1))), F.substr("p_type", F.lit(2), F.lit(12)))
    spaced = F.concat(F.lit(" \n"), F.array_join(F.array_repeat(F.lit("x"), (F.col("p_size") % 4 + 1).cast("int")), "\t  "), F.lit("  "))
    return issues_of(rows_of(
        spark, sf_dir, "part", "p_partkey", "checked", F.lit("<flag>F</flag><money>1.0</money>"), txt("word", t), txt("spaced", spaced), F.lit("<level>5</level><small>1</small>"),
    ), "checked")


@query("""
    SELECT c_custkey AS k, '/bounds/n' AS path, CASE WHEN c_custkey % 7 < 2 THEN 'min-occurs' ELSE 'max-occurs' END AS code FROM customer WHERE c_custkey % 7 NOT BETWEEN 2 AND 4""")
def cardinality_issues(spark, sf_dir):
    """Too few and too many occurrences."""
    n = F.repeat(F.lit("<n>1</n>"), (F.col("c_custkey") % 7).cast("int"))
    return issues_of(rows_of(spark, sf_dir, "customer", "c_custkey", "bounds", n), "bounds")


@query("""
    WITH e AS (SELECT event_id AS k, event_id % 4 AS m FROM events)
    SELECT k, '/checked/level' AS path, 'required' AS code FROM e WHERE m = 1
    UNION ALL SELECT k, '/checked/small', 'lexical' FROM e WHERE m = 2
    UNION ALL SELECT k, '/checked/small', 'nil' FROM e WHERE m = 3""")
def structural_issues(spark, sf_dir):
    """Missing elements, wrong lexicals, nil where it may not be."""
    m = F.col("event_id") % 4
    small = F.when(m == 2, "<small>1x</small>").when(m == 3, f'<small xmlns:i="{XSI}" i:nil="true"/>').otherwise("<small> +1 </small>")
    level = F.when(m == 1, "").otherwise("<level>5</level>")
    return issues_of(rows_of(
        spark, sf_dir, "events", "event_id", "checked", F.lit("<flag>F</flag><money>1.0</money><word>ABCDEFGHI</word><spaced>a b</spaced>"), level, small,
    ), "checked")


# Choices


@query("""
    WITH c AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS a, c_custkey % 3 = 0 AS b, c_custkey % 5 = 0 AS c FROM customer)
    SELECT k, (a AND b AND NOT c) OR (c AND NOT a AND NOT b) AS ok FROM c""")
def choice_absorb(spark, sf_dir):
    """Of branches (a), (a, b) and (c), a document with a and b has one: the larger one has all
    of the smaller. a alone or b alone is a part of the larger."""
    k = F.col("c_custkey")
    parts = [F.when(k % n == 0, f"<{e}>x</{e}>").otherwise("") for n, e in ((2, "a"), (3, "b"), (5, "c"))]
    got = engine.safe_parse_xml(rows_of(spark, sf_dir, "customer", "c_custkey", "absorb", *parts), "xml", plan("absorb"))
    return got.select("k", (F.size("_issues") == 0).alias("ok"))


@query("SELECT c_custkey AS k, true AS ok, CASE WHEN c_custkey % 3 = 2 THEN 'v' END AS extra FROM customer")
def choice_with_wildcard(spark, sf_dir):
    """A choice with a wildcard branch asks for nothing, and what no field takes is kept."""
    k = F.col("c_custkey")
    part = F.when(k % 3 == 0, "").when(k % 3 == 1, "<a>1</a><b>2</b>").otherwise('<x:o xmlns:x="urn:x">v</x:o>')
    got = engine.safe_parse_xml(rows_of(spark, sf_dir, "customer", "c_custkey", "loose", part), "xml", plan("loose"))
    return got.select("k", (F.size("_issues") == 0).alias("ok"), F.from_json("doc._extra.json", "map<string,string>")["{urn:x}o"].alias("extra"))


# Written again


@query("""
    SELECT p_partkey AS k, CAST(p_size + 1 AS INT) AS total, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS number, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'x' || p_size END AS word,
           p_partkey % 3 = 0 AS is_nil, p_brand || ' b' AS tags, 'plain' AS mode,
           '<ns0:numbers>1 ' || p_size || '</ns0:numbers><ns0:either>' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x' END || p_size || '</ns0:either>'
           || CASE WHEN p_partkey % 3 = 0 THEN '<ns0:gone xsi:nil="true"/>' ELSE '' END AS body, false AS default_written FROM part""")
def lists_unions_nil_written(spark, sf_dir):
    """Lists, unions and nil elements are written canonically, an attribute's default is not."""
    k = F.col("p_partkey")
    either = F.concat(F.when(k % 2 == 0, "").otherwise("x"), F.col("p_size").cast("string"))
    gone = F.when(k % 3 == 0, f'<gone xmlns:i="{XSI}" i:nil="1"/>').otherwise("")
    attrs = F.concat(F.lit(' tags=" '), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit('  b" mode="plain"'))
    xml = rows_of(spark, sf_dir, "part", "p_partkey", "lists", txt("numbers", F.concat(F.lit(" 1\n 0"), F.col("p_size").cast("string"))), txt("either", either), gone, attrs=attrs)
    got = again(xml, "lists")
    return got.select(
        "k", (got.doc.numbers[0] + got.doc.numbers[1]).alias("total"), got.doc.either.m0.alias("number"), got.doc.either.m1.alias("word"),
        got.doc.gone__nil.alias("is_nil"), F.regexp_replace(F.trim(F.regexp_replace(got.doc["@tags"], " +", " ")), "Brand", "Brand#").alias("tags"), got.doc["@mode"].alias("mode"),
        F.regexp_extract("out", r"\A<[^>]*>(.*)</[^>]*>\z", 1).alias("body"), F.contains("out", F.lit("mode=")).alias("default_written"),
    )


@query("""
    SELECT s_suppkey AS k, CAST(n AS INT) AS n, CASE WHEN (s_suppkey + n) % 2 = 0 THEN '{urn:sales}warning' END AS tag, s_name || n AS text,
           CASE WHEN (s_suppkey + n) % 2 = 0 THEN 'warning' ELSE 'remark' END AS written
    FROM supplier, (VALUES (0), (1), (2)) t(n)""")
def subst_leaf(spark, sf_dir):
    """Elements of simple types that stand for a head keep their own tags."""
    def one(n: int) -> Column:
        text = escape_text(F.concat("s_name", F.lit(str(n))))
        return F.when((F.col("s_suppkey") + n) % 2 == 0, el("warning", text)).otherwise(el("remark", text))

    got = again(rows_of(spark, sf_dir, "supplier", "s_suppkey", "noted", *map(one, range(3))), "noted")
    tags = F.regexp_extract_all("out", F.lit(r"<ns0:(warning|remark)>"), F.lit(1))
    each = got.select("k", F.posexplode(F.arrays_zip(got.doc.remark.alias("text"), got.doc["remark__qname"].alias("tag"), tags.alias("written"))).alias("n", "one"))
    return each.select("k", "n", "one.tag", "one.text", "one.written")


@query("""
    SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '{urn:sales}Fancy' WHEN 1 THEN '{urn:new}Odd' END AS type, c_name AS name,
           CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS shade, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS extra,
           CASE WHEN c_custkey % 3 = 1 THEN '7' END AS level FROM customer""")
def unknown_type(spark, sf_dir):
    """Content under a type that the schema does not know is read as declared, and the rest of
    it is kept and written again."""
    k, name = F.col("c_custkey"), txt("name", F.col("c_name"))
    known = el("part", F.concat(name, txt("shade", F.col("c_mktsegment"))), f' xmlns:i="{XSI}" xmlns:t="{NS}" i:type="t:Fancy"')
    odd = el("part", F.concat(txt("o:more", F.col("c_mktsegment")), name), f' xmlns:i="{XSI}" xmlns:o="urn:new" i:type="o:Odd" o:level="7"')
    part = F.when(k % 3 == 0, known).when(k % 3 == 1, odd).otherwise(el("part", name))
    got = again(rows_of(spark, sf_dir, "customer", "c_custkey", "held", part), "held")
    extra = F.from_json("doc.part._extra.json", "map<string,string>")
    return got.select(
        "k", got.doc.part.xsiType.alias("type"), got.doc.part["name"].alias("name"), got.doc.part.shade.alias("shade"), extra["{urn:new}more"].alias("extra"),
        extra["@{urn:new}level"].alias("level"),
    )


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '{urn:sales}toy' ELSE '{urn:sales}thing' END AS tag, CASE WHEN c_custkey % 2 = 0 THEN 's' END AS shade FROM customer")
def tag_beats_type(spark, sf_dir):
    """Where elements may be substituted the tag chooses; xsi:type is ignored."""
    k = F.col("c_custkey")
    told = f' xmlns:i="{XSI}" xmlns:t="{NS}" i:type="t:Fancy"'
    part = F.when(k % 2 == 0, el("toy", F.concat(txt("name", F.col("c_name")), F.lit("<shade>s</shade>")))).otherwise(el("thing", txt("name", F.col("c_name")), told))
    got = engine.safe_parse_xml(rows_of(spark, sf_dir, "customer", "c_custkey", "shop", part), "xml", plan("shop"))
    return got.select("k", got.doc.thing["__qname"].alias("tag"), got.doc.thing.shade.alias("shade"))


@query("""
    SELECT n_nationkey AS k, 'urn:r' || n_regionkey AS space, 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'urn:via' ELSE 'urn:r' || n_regionkey END AS via FROM nation""")
def qname_binding(spark, sf_dir):
    """Names with prefixes mean the same after they are written, whatever prefixes the writer has."""
    prefix = F.element_at(F.array(F.lit("p"), F.lit("ns0"), F.lit("xsi"), F.lit("q0")), F.pmod(F.col("n_nationkey"), F.lit(4)).cast("int") + 1)
    via = F.when(F.col("n_nationkey") % 2 == 0, "urn:via").otherwise(F.concat(F.lit("urn:r"), F.col("n_regionkey").cast("string")))
    attrs = F.concat(F.lit(' xmlns:v="'), via, F.lit('" via="v:x"'))
    to = F.concat(F.lit("<to xmlns:"), prefix, F.lit('="urn:r'), F.col("n_regionkey").cast("string"), F.lit('"> '), prefix, F.lit(":n"), F.col("n_nationkey").cast("string"), F.lit(" </to>"))
    got = again(rows_of(spark, sf_dir, "nation", "n_nationkey", "link", to, attrs=attrs), "link")
    space = lambda c: got.doc["_ns"][F.regexp_extract(c, r"\A\s*([^:]*):", 1)]
    return got.select("k", space(got.doc.to).alias("space"), F.regexp_extract(got.doc.to, r":(\S*)", 1).alias("name"), space(got.doc["@via"]).alias("via"))


@query("""
    SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'one mid two last' ELSE 'mid last' END AS written FROM supplier""")
def wildcard_places(spark, sf_dir):
    """Without a noted order, content goes to the wildcard that takes its namespace."""
    k = F.col("s_suppkey")
    first = F.when(k % 2 == 0, '<x:one xmlns:x="urn:one"/>').otherwise("")
    second = F.when(k % 2 == 0, '<x:two xmlns:x="urn:two"/>').otherwise("")
    p = plan("places")
    got = engine.safe_parse_xml(rows_of(spark, sf_dir, "supplier", "s_suppkey", "places", first, F.lit("<mid>1</mid>"), second, F.lit("<last>2</last>")), "xml", p)
    bare = got.withColumn("doc", got.doc.withField("_order", F.slice(got.doc["_order"], 1, 0)))
    tags = F.regexp_extract_all("out", F.lit(r"<(?:ns0:)?(one|two|mid|last)[ />]"), F.lit(1))
    return engine.to_xml(bare, "doc", p, "out").select("k", F.array_join(tags, " ").alias("written"))


@query("SELECT doc_id AS k, lang, source, '<h xmlns=\"urn:h\">' || source || '</h>' AS part FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def open_content(spark, sf_dir):
    """Elements of any type are nested data to look into, and XML to write again."""
    body = F.concat(F.lit('<body><h xmlns="urn:h">'), escape_text(F.col("source")), F.lit('</h><n:l xmlns:n="urn:n">'), escape_text(F.col("lang")), F.lit("</n:l></body>"))
    rows = spread(table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL"))
    xml = rows.select(F.col("doc_id").alias("k"), doc("anything", at("key", F.col("doc_id")), body).alias("xml"))
    got = again(xml, "anything")
    data = F.from_json("doc.body.json", "map<string,string>")
    return got.select("k", data["{urn:n}l"].alias("lang"), data["{urn:h}h"].alias("source"), F.regexp_extract("out", r"(<h xmlns=.*?</h>)", 1).alias("part"))


@query("""
    SELECT o_orderkey AS k, '00' || o_custkey AS kept, CAST(o_custkey AS VARCHAR) AS canonical FROM orders""")
def lexical_reuse(spark, sf_dir):
    """With the strings kept beside, a value that still means the same is written as it stood."""
    p = plan("bounds")
    n = F.concat(F.lit("00"), F.col("o_custkey").cast("string"))
    xml = rows_of(spark, sf_dir, "orders", "o_orderkey", "bounds", txt("n", n), txt("n", n))
    got = engine.to_xml(engine.safe_parse_xml(xml, "xml", p, raw="raw"), "doc", p, "same", raw="raw")
    first = lambda c: F.regexp_extract(c, r"<ns0:n>([^<]*)<", 1)
    return engine.to_xml(got, "doc", p, "plain").select("k", first("same").alias("kept"), first("plain").alias("canonical"))


@query("""
    WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders)
    SELECT k, strftime(d, '%Y-%m-%d') || 'Z' AS day, strftime(d, '%Y') AS year, strftime(d, '%Y-%m') AS year_month, '--' || strftime(d, '%m') AS month,
           '--' || strftime(d, '%m-%d') || 'Z' AS month_day, '---' || strftime(d, '%d') AS mday, 'P' || day(d) || 'DT1H' AS span, CAST(year(d) AS BIGINT) AS y, CAST(month(d) AS INT) AS m FROM o""")
def structured_dates(spark, sf_dir):
    """Dates and their parts are parsed into numbers and written canonically."""
    d = lambda f: F.date_format("o_orderdate", f)
    parts = [
        F.concat(F.lit("<day>"), d("yyyy-MM-dd"), F.lit("-00:00</day>")), txt("year", d("yyyy")), txt("yearMonth", d("yyyy-MM")), F.concat(F.lit("<month>--"), d("MM"), F.lit("</month>")),
        F.concat(F.lit("<monthDay>--"), d("MM-dd"), F.lit("Z</monthDay>")), F.concat(F.lit("<mday>---"), d("dd"), F.lit("</mday>")),
        F.concat(F.lit("<span>P0Y0M"), d("dd"), F.lit("DT01H0M0.00S</span>")),
    ]
    got = again(rows_of(spark, sf_dir, "orders", "o_orderkey", "dated", *parts), "dated", datatypes="structured")
    text = lambda e: F.regexp_extract("out", f"<ns0:{e}>([^<]*)<", 1)
    names = {"day": "day", "year": "year", "yearMonth": "year_month", "month": "month", "monthDay": "month_day", "mday": "mday", "span": "span"}
    return got.select("k", *(text(e).alias(n) for e, n in names.items()), got.doc.day.year.alias("y"), got.doc["month"].month.alias("m"))


@query("""
    SELECT event_id AS k, strftime(t, '%Y-%m-%d') || 'Z' AS day, strftime(t, '%Y') || 'Z' AS year, strftime(t, '%Y-%m') || 'Z' AS year_month,
           strftime(date_trunc('day', ts) - INTERVAL 1 DAY, '--%m-%d') || 'Z' AS month_day
    FROM (SELECT *, date_trunc('day', ts) - INTERVAL 1 DAY AS t FROM events)""")
def canon_parts_utc(spark, sf_dir):
    """Dates east of Greenwich begin on the day before in UTC, over months and years."""
    d = lambda f: F.date_format("ts", f)
    first = F.concat(d("yyyy-MM-dd"), F.lit("+02:00"))
    day = datetimes.canonical(first, "date")
    month_day = datetimes.canonical(F.concat(F.lit("--"), d("MM-dd"), F.lit("+02:00")), "gMonthDay")
    # A year or month is moved if its first day is.
    year = F.when(d("MM-dd") == "01-01", datetimes.canonical(F.concat(d("yyyy"), F.lit("+02:00")), "gYear")).otherwise(datetimes.canonical(F.concat(d("yyyy"), F.lit("Z")), "gYear"))
    month = F.when(d("dd") == "01", datetimes.canonical(F.concat(d("yyyy-MM"), F.lit("+02:00")), "gYearMonth")).otherwise(datetimes.canonical(F.concat(d("yyyy-MM"), F.lit("Z")), "gYearMonth"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), day.alias("day"), year.alias("year"), month.alias("year_month"), month_day.alias("month_day"))


# Schema composition


@query("""
    SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS alias, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, 'kg' AS unit, p_size AS rank FROM part""")
def redefined_parts(spark, sf_dir):
    """An included file without a namespace takes that of the schema; redefinitions of its type,
    group and attribute group add to the originals."""
    k = F.col("p_partkey")
    alias = F.when(k % 2 == 0, txt("alias", F.col("p_brand"))).otherwise("")
    size = el("size", F.concat(txt("amount", money("p_retailprice")), F.lit("<unit> kg </unit>")))
    got = again(rows_of(spark, sf_dir, "part", "p_partkey", "measured", txt("name", F.col("p_name")), alias, size, attrs=at("rank", F.col("p_size"))), "measured")
    return got.select("k", got.doc["name"].alias("name"), got.doc["alias"].alias("alias"), got.doc.size.amount.alias("amount"), F.trim(got.doc.size.unit).alias("unit"), got.doc["@rank"].alias("rank"))


@query("""
    SELECT c_custkey AS k, c_mktsegment AS text, 'en-' || c_nationkey AS lang, length(c_mktsegment) > 9 AS long FROM customer""")
def derived_simple_content(spark, sf_dir):
    """Text with attributes, restricted: the attributes come along, the facet is added."""
    m = F.concat(F.lit('<m lang="en-'), F.col("c_nationkey").cast("string"), F.lit('">'), escape_text(F.col("c_mktsegment")), F.lit("</m>"))
    p = plan("marked")
    got = engine.safe_parse_xml(rows_of(spark, sf_dir, "customer", "c_custkey", "marked", m), "xml", p, into="strict").drop("xml")
    rows = rows_of(spark, sf_dir, "customer", "c_custkey", "marked", m)
    loose = engine.safe_parse_xml(rows, "xml", p, validate=False)
    both = loose.join(got.select("k", F.col("strict").isNull().alias("long")), "k")
    return both.select("k", both.doc.m[0]["_text"].alias("text"), both.doc.m[0]["@lang"].alias("lang"), "long")


@query("""
    WITH n AS (SELECT n_nationkey AS k, CAST(n_nationkey % 4 AS INT) AS deep FROM nation)
    SELECT k, CASE WHEN deep >= 1 THEN 1 END AS second, CASE WHEN deep >= 2 THEN '2' END AS below, deep + 1 AS written FROM n""")
def recursive_types(spark, sf_dir):
    """A type that holds itself is unrolled to a depth; below, its content is open, and written."""
    deep = (F.col("n_nationkey") % 4).cast("int")
    kids = F.concat(F.lit("<v>0</v>"), *(F.when(deep >= d, f"<kid><v>{d}</v>").otherwise("") for d in (1, 2, 3)), *(F.when(deep >= d, "</kid>").otherwise("") for d in (3, 2, 1)))
    got = again(rows_of(spark, sf_dir, "nation", "n_nationkey", "tree", kids), "tree", max_depth=2)
    below = F.get_json_object("doc.kid.kid.json", "$['{urn:sales}v']")
    return got.select("k", got.doc.kid.v.alias("second"), below.alias("below"), F.size(F.regexp_extract_all("out", F.lit(r"<(?:ns0:)?v[ >]"), F.lit(0))).alias("written"))


# Lexical spaces


@query("""
    SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS ncname, s_suppkey % 3 <> 0 AS ncnames, s_suppkey % 14 BETWEEN 1 AND 12 AS year_month, s_suppkey % 2 = 1 AS hex FROM supplier""")
def lex_more(spark, sf_dir):
    """Names without colons and lists of them, months of years, hexadecimal octets."""
    k = F.col("s_suppkey")
    name = F.regexp_replace("s_name", "[^A-Za-z0-9]", "_")
    return table(spark, sf_dir, "supplier").select(
        k.alias("k"), lexical.xsd_ncname(F.concat(F.when(k % 2 == 0, "").otherwise("a:"), name)).alias("ncname"),
        lexical.xsd_ncnames(F.when(k % 3 == 0, " ").otherwise(F.concat(name, F.lit(" \t"), name))).alias("ncnames"),
        lexical.xsd_gyearmonth(F.format_string("2024-%02d", (k % 14).cast("int"))).alias("year_month"),
        lexical.xsd_hex_binary(F.concat(F.lit("0f"), F.when(k % 2 == 1, "A9").otherwise("A"))).alias("hex"),
    )


# Names, files, numbers

SCOPED = os.path.join(os.path.dirname(__file__), "examples", "scoped.xsd")


def scoped(**options) -> engine.Plan:
    return engine.compile(engine.load_xsd(SCOPED, allow_missing_imports=True), "scoped", **options)


@query("""
    SELECT s_suppkey AS k, s_nationkey AS n, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS times, 's' || s_nationkey AS own,
           CASE WHEN s_suppkey % 3 = 0 THEN CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) END AS other, CASE WHEN s_suppkey % 5 = 0 THEN s_name END AS unknown
    FROM supplier""")
def schema_scopes(spark, sf_dir):
    """Names of a schema resolve by the default namespace and by prefixes bound where they stand;
    neighbours of one name are one repeated field, equal keys of two namespaces get numbers, and
    an element that no file declares is open content."""
    k = F.col("s_suppkey")
    other = F.when(k % 3 == 0, F.concat(F.lit('<b xmlns="urn:other">'), money("s_acctbal"), F.lit("</b>"))).otherwise("")
    gone = F.when(k % 5 == 0, F.concat(F.lit('<g:part xmlns:g="urn:gone">'), escape_text(F.col("s_name")), F.lit("</g:part>"))).otherwise("")
    again_ = F.when(k % 2 == 0, "<a>2</a>").otherwise("")
    parts = [F.lit("<flag>1</flag>"), el("inner", txt("n", F.col("s_nationkey"))), F.lit("<a>1</a>"), again_, el("b", F.concat(F.lit("s"), F.col("s_nationkey").cast("string"))), other, gone]
    p = scoped()
    once = engine.safe_parse_xml(rows_of(spark, sf_dir, "supplier", "s_suppkey", "scoped", *parts), "xml", p).select("k", "doc")
    got = engine.safe_parse_xml(engine.to_xml(once, "doc", p, "out").drop("doc"), "out", p)
    return got.select("k", got.doc.inner.n.alias("n"), F.size(got.doc.a).alias("times"), got.doc.b.alias("own"), got.doc.b2.alias("other"), F.regexp_extract("doc.part.json", r'\A"(.*)"\z', 1).alias("unknown"))


@query("""
    SELECT c_custkey AS k, c_custkey % 6 IN (0, 1, 4) AS flag, c_custkey % 6 = 5 AS bad FROM customer""")
def booleans(spark, sf_dir):
    """true, 1, false and 0 with white space around are booleans, nothing else is."""
    told = F.element_at(F.array(*(F.lit(x) for x in ("true", " 1 ", "false", "0", "\ttrue\n", "yes"))), F.pmod(F.col("c_custkey"), F.lit(6)).cast("int") + 1)
    xml = rows_of(spark, sf_dir, "customer", "c_custkey", "scoped", txt("flag", told), F.lit("<inner><n>1</n></inner><a>1</a><b>x</b>"))
    loose = engine.safe_parse_xml(xml, "xml", scoped(), validate=False)
    strict = engine.safe_parse_xml(loose.select("k", "xml", F.coalesce("doc.flag", F.lit(False)).alias("flag")), "xml", scoped(paths=["flag"]))
    return strict.select("k", "flag", F.exists("_issues", lambda i: i["code"] == "lexical").alias("bad"))


@query("""
    SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'INF' WHEN 1 THEN '-INF' WHEN 2 THEN 'NaN' WHEN 3 THEN '-0' WHEN 4 THEN CAST(p_size AS VARCHAR)
           ELSE rtrim(rtrim(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') END AS written FROM part""")
def canon_numbers(spark, sf_dir):
    """Floating point numbers in their canonical text: specials, minus zero, no needless digits."""
    k = F.col("p_partkey") % 6
    value = F.when(k == 0, "INF").when(k == 1, "-INF").when(k == 2, "NaN").when(k == 3, "-0.0").when(k == 4, F.concat(F.col("p_size").cast("string"), F.lit(".000"))).otherwise(F.concat(money("p_retailprice"), F.lit("0e0")))
    parts = [F.lit("<flag>1</flag><inner><n>1</n></inner><a>1</a><b>x</b>"), F.concat(F.lit('<b xmlns="urn:other">'), value, F.lit("</b>"))]
    p = scoped()
    once = engine.safe_parse_xml(rows_of(spark, sf_dir, "part", "p_partkey", "scoped", *parts), "xml", p).select("k", "doc")
    return engine.to_xml(once, "doc", p, "out").select("k", F.regexp_extract("out", r"<ns\d+:b>([^<x]*)</ns\d+:b></ns0:scoped>", 1).alias("written"))


@query("""
    SELECT n_nationkey AS k, n_name || 'é ' || n_regionkey AS name, n_name || ' x' AS label FROM nation""")
def decoded_files(spark, sf_dir):
    """XML in several encodings, with white space in attributes and references in tag names."""
    k = F.col("n_nationkey")
    name = F.concat("n_name", F.lit("é "), F.col("n_regionkey").cast("string"))
    body = F.concat(
        F.lit('<scoped xmlns="urn:sales"'), at("key", k), F.lit(' label="'), F.col("n_name"), F.lit('\t'), F.lit('x"><flag>0</flag><inner><n>1</n></inner><a>1</a><&#98;>'),
        name, F.lit("</&#x62;></scoped>"),
    )
    told = lambda e: F.concat(F.lit(f'<?xml version="1.0" encoding="{e}"?>'), body)
    data = (
        F.when(k % 4 == 0, F.encode(told("ISO-8859-1"), "ISO-8859-1")).when(k % 4 == 1, F.encode(told("UTF-16"), "UTF-16"))
        .when(k % 4 == 2, F.encode(told("utf-16le"), "UTF-16LE")).otherwise(F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode(told("UTF-8"), "UTF-8")))
    )
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), decoded(data).alias("xml"))
    got = engine.safe_parse_xml(rows, "xml", scoped())
    return got.select("k", got.doc.b.alias("name"), got.doc["@label"].alias("label"))
