"""Queries over the synthetic tables that show the engine's operators, and their SQL.

Most build XML from a table's columns, so that the same relation can be computed from
the columns by DuckDB. Each reads its whole tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine
from .functions import datetimes, lexical, numeric
from .functions.pattern import xsd_pattern
from .operators import catalog, conform, shred
from .operators.writer import escape_attribute, escape_text

SALES = os.path.join(os.path.dirname(__file__), "examples", "sales.xsd")
NS = "urn:sales"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is read by fewer tasks than there are cores, dealt to all of them:
    parsing costs far more than a shuffle of a small table. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new place in the folder that driver and executors share; in local mode, where none is
    told, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="xsdframe-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def plan(root: str, **options) -> engine.Plan:
    return engine.compile(engine.load_xsd(SALES), root, **options)


def el(name: str, value: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attrs}>"), value, F.lit(f"</{name}>"))


def txt(name: str, c: Column) -> Column:
    return el(name, escape_text(c.cast("string")))


def at(name: str, c: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), escape_attribute(c.cast("string")), F.lit('"'))


def doc(name: str, attrs: Column, *parts: Column, prefix: str = "") -> Column:
    p = f"{prefix}:" if prefix else ""
    bind = f"xmlns:{prefix}" if prefix else "xmlns"
    return F.concat(F.lit(f'<{p}{name} {bind}="{NS}"'), attrs, F.lit(">"), *parts, F.lit(f"</{p}{name}>"))


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


# Orders: parsing, writing, repeated elements


def orders_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    xml = doc(
        "order", F.concat(at("id", F.col("o_orderkey")), at("status", F.col("o_orderstatus")), at("priority", F.col("o_orderpriority"))),
        txt("custkey", F.col("o_custkey")), txt("total", money("o_totalprice")), txt("date", day),
    )
    return spread(table(spark, sf_dir, "orders")).select(xml.alias("xml"))


ORDER_COLUMNS = ["doc.`@id` AS id", "doc.`@status` AS status", "doc.`@priority` AS priority", "doc.`@version` AS version", "doc.custkey AS custkey", "doc.total AS total", "doc.date AS day"]
ORDER_SQL = """
    SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, '1.0' AS version, o_custkey AS custkey,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, strftime(o_orderdate, '%Y-%m-%d') AS day
    FROM orders"""


@query(ORDER_SQL)
def parse_orders(spark, sf_dir):
    """Parse, coerce and check one document for each order."""
    return engine.safe_parse_xml(orders_xml(spark, sf_dir), "xml", plan("order")).selectExpr(*ORDER_COLUMNS)


@query(ORDER_SQL)
def roundtrip_orders(spark, sf_dir):
    """Parse, write and parse again."""
    p = plan("order")
    once = engine.safe_parse_xml(orders_xml(spark, sf_dir), "xml", p).select("doc")
    again = engine.to_xml(once, "doc", p).select("xml")
    return engine.safe_parse_xml(again, "xml", p).selectExpr(*ORDER_COLUMNS)


@query("""
    SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total FROM orders""")
def parse_orders_pruned(spark, sf_dir):
    """Only the asked fields are read and checked."""
    p = plan("order", paths=["@id", "total"])
    return engine.safe_parse_xml(orders_xml(spark, sf_dir), "xml", p).selectExpr("doc.`@id` AS id", "doc.total AS total")


def lines_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order with its lines; one order's lines are few, so they are gathered."""
    line = F.struct("l_linenumber", el("line", F.concat(txt("part", F.col("l_partkey")), txt("quantity", money("l_quantity")))).alias("body"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    numbered = F.transform("lines", lambda x: F.replace(x["body"], F.lit("<line>"), F.concat(F.lit('<line number="'), x["l_linenumber"].cast("string"), F.lit('">'))))
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    xml = doc(
        "order", F.concat(at("id", F.col("o_orderkey")), at("status", F.col("o_orderstatus"))), txt("custkey", F.col("o_custkey")),
        txt("total", money("o_totalprice")), txt("date", F.date_format("o_orderdate", "yyyy-MM-dd")), F.array_join(numbered, ""),
    )
    return joined.select(xml.alias("xml"))


@query("""
    SELECT o_orderkey AS id, '5-LOW' AS priority, l_linenumber AS number, l_partkey AS part,
           CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def parse_order_lines(spark, sf_dir):
    """Repeated elements become an array of structs; an absent attribute takes its default."""
    parsed = engine.safe_parse_xml(lines_xml(spark, sf_dir), "xml", plan("order"))
    rows = parsed.selectExpr("doc.`@id` AS id", "doc.`@priority` AS priority", "explode(doc.line) AS l")
    return rows.selectExpr("id", "priority", "l.`@number` AS number", "l.part AS part", "l.quantity AS quantity")


@query("""
    SELECT n_nationkey AS k, '<ns0:nation xmlns:ns0="urn:sales" key="' || n_nationkey || '"><ns0:name>'
           || n_name || '</ns0:name><ns0:region>' || n_regionkey || '</ns0:region></ns0:nation>' AS xml FROM nation""")
def serialize_nation(spark, sf_dir):
    """Typed rows to XML text."""
    p = plan("nation")
    value = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("region"), F.col("n_nationkey").cast("int").alias("@key"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), value.alias("doc"))
    return engine.to_xml(rows, "doc", p).select("k", "xml")


# Absence, defaults, nil


@query("""
    SELECT c_custkey AS k,
           CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NONE' ELSE c_mktsegment END AS segment,
           CASE WHEN c_custkey % 3 = 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END AS balance,
           c_custkey % 3 = 1 AS is_nil
    FROM customer""")
def absent_empty_nil(spark, sf_dir):
    """Absent, present but empty (takes the default) and nil elements are told apart."""
    k = F.col("c_custkey")
    segment = F.when(k % 4 == 0, "").when(k % 4 == 1, "<segment/>").otherwise(txt("segment", F.col("c_mktsegment")))
    nil = '<balance xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:nil="true"/>'
    balance = F.when(k % 3 == 0, txt("balance", money("c_acctbal"))).when(k % 3 == 1, nil).otherwise("")
    xml = spread(table(spark, sf_dir, "customer")).select(doc("customer", at("key", k), txt("name", F.col("c_name")), segment, balance).alias("xml"))
    return engine.safe_parse_xml(xml, "xml", plan("customer")).selectExpr("doc.`@key` AS k", "doc.segment AS segment", "doc.balance AS balance", "doc.balance__nil AS is_nil")


@query("""
    SELECT doc_id AS k, regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(0), '', 'g') AS text FROM documents""")
def escaped_text(spark, sf_dir):
    """Any text survives escaping and parsing, half of them in marked sections."""
    safe = F.coalesce(F.col("text"), F.lit(""))
    cdata = F.concat(F.lit("<![CDATA["), F.replace(safe, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
    body = F.when(F.col("doc_id") % 2 == 0, escape_text(safe)).otherwise(cdata)
    xml = spread(table(spark, sf_dir, "documents")).select(doc("customer", at("key", F.col("doc_id")), el("name", body)).alias("xml"))
    return engine.safe_parse_xml(xml, "xml", plan("customer")).selectExpr("doc.`@key` AS k", "doc.name AS text")


@query("""
    SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'structural' END AS channel FROM customer""")
def ns_resolution(spark, sf_dir):
    """Prefixes resolve to namespaces; a root in no namespace is not the declared one."""
    k = F.col("c_custkey")
    right = F.concat(F.lit(f'<q:customer xmlns:q="{NS}"'), at("key", k), F.lit(">"), txt("q:name", F.col("c_name")), F.lit("</q:customer>"))
    wrong = F.concat(F.lit("<customer"), at("key", k), F.lit(">"), txt("name", F.col("c_name")), F.lit("</customer>"))
    xml = spread(table(spark, sf_dir, "customer")).select("c_custkey", "c_name", F.when(k % 2 == 0, right).otherwise(wrong).alias("xml"))
    got = engine.safe_parse_xml(xml, "xml", plan("customer"))
    return got.select(F.col("c_custkey").alias("k"), F.coalesce("doc.name", "c_name").alias("name"), F.get("_issues", F.lit(0))["channel"].alias("channel"))


# Lexical spaces and values


@query("""
    WITH d AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y, CAST(o_orderkey % 14 AS INT) AS m, CAST(o_custkey % 33 AS INT) AS d FROM orders)
    SELECT k, m BETWEEN 1 AND 12 AND d BETWEEN 1 AND CASE WHEN m IN (4, 6, 9, 11) THEN 30
             WHEN m = 2 THEN CASE WHEN (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 THEN 29 ELSE 28 END ELSE 31 END AS ok FROM d""")
def lex_date(spark, sf_dir):
    """Days that exist, of all months and days that are written."""
    told = F.format_string("%04d-%02d-%02dZ", F.year("o_orderdate"), (F.col("o_orderkey") % 14).cast("int"), (F.col("o_custkey") % 33).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), lexical.xsd_date(told).alias("ok"))


@query("""
    WITH t AS (SELECT event_id AS k, CAST(event_id % 26 AS INT) AS h, CAST(user_id % 62 AS INT) AS m FROM events)
    SELECT k, h <= 23 AND m <= 59 OR h = 24 AND m = 0 AS ok_time, h <= 23 AND m <= 59 OR h = 24 AND m = 0 AS ok_date_time FROM t""")
def lex_time(spark, sf_dir):
    """Times, 24:00:00 being the last one."""
    clock = F.format_string("%02d:%02d:00", (F.col("event_id") % 26).cast("int"), (F.col("user_id") % 62).cast("int"))
    both = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), clock, F.lit("+01:00"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), lexical.xsd_time(clock).alias("ok_time"), lexical.xsd_date_time(both).alias("ok_date_time"))


@query("""
    SELECT p_partkey AS k, p_size % 14 BETWEEN 1 AND 12 AS month, p_size % 33 BETWEEN 1 AND 31 AS day,
           p_size % 33 BETWEEN 1 AND 30 AS month_day, p_size % 3 <> 0 AS year, p_size % 2 = 0 AS duration FROM part""")
def lex_gtypes(spark, sf_dir):
    """Recurring dates and durations."""
    n = F.col("p_size").cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), lexical.xsd_gmonth(F.format_string("--%02d", n % 14)).alias("month"), lexical.xsd_gday(F.format_string("---%02d", n % 33)).alias("day"),
        lexical.xsd_gmonthday(F.format_string("--04-%02d", n % 33)).alias("month_day"), lexical.xsd_gyear(F.format_string("%04d", n % 3)).alias("year"),
        lexical.xsd_duration(F.concat(F.lit("P"), F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit("D"))).otherwise("T"))).alias("duration"),
    )


@query("""
    SELECT p_partkey AS k, regexp_full_match(p_name, '[A-Za-z_:][A-Za-z0-9._:-]*') AS name, regexp_full_match(p_brand, '[A-Za-z0-9._:-]+') AS token,
           regexp_full_match(p_type, '[A-Za-z0-9._:-]+( [A-Za-z0-9._:-]+)*') AS tokens, regexp_full_match(left(p_type, 8), '[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*') AS language,
           true AS hex, p_partkey % 2 = 0 AS base64 FROM part""")
def lex_names(spark, sf_dir):
    """Names, tokens, lists of tokens, languages and binary forms."""
    b64 = F.base64(F.encode("p_name", "utf-8"))
    odd = F.when(F.col("p_partkey") % 2 == 0, b64).otherwise(F.concat(b64, F.lit("=A")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), lexical.xsd_name(F.col("p_name")).alias("name"), lexical.xsd_nmtoken(F.col("p_brand")).alias("token"),
        lexical.xsd_nmtokens(F.col("p_type")).alias("tokens"), lexical.xsd_language(F.left("p_type", F.lit(8))).alias("language"),
        lexical.xsd_hex_binary(F.md5("p_name")).alias("hex"), lexical.xsd_base64_binary(odd).alias("base64"),
    )


@query("""
    SELECT event_id AS k, strftime(CAST(date_trunc('second', ts) AS TIMESTAMP) - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS utc,
           strftime(CAST(date_trunc('second', ts) AS TIMESTAMP) - INTERVAL 90 MINUTE, '%H:%M:%SZ') AS clock FROM events""")
def canon_datetime_utc(spark, sf_dir):
    """Dates and times with a zone, moved to UTC and written canonically."""
    when = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000+01:30"))
    clock = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit("+01:30"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), datetimes.canonical(when, "dateTime").alias("utc"), datetimes.canonical(clock, "time").alias("clock"))


@query("""
    SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN q = 0 AND h = 0 THEN 'PT0S' ELSE 'P' || CASE WHEN q > 0 THEN q || 'D' ELSE '' END
           || CASE WHEN h > 0 THEN 'T' || h || 'H' ELSE '' END END AS duration
    FROM (SELECT *, CAST(l_quantity AS INT) % 5 AS q, l_linenumber % 3 AS h FROM lineitem)""")
def canon_duration(spark, sf_dir):
    """Durations without their zero parts."""
    told = F.format_string("P0Y%dDT%dH0M0.0S", F.col("l_quantity").cast("int") % 5, (F.col("l_linenumber") % 3).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), datetimes.canonical(told, "duration").alias("duration"))


@query("""
    WITH p AS (SELECT p_partkey AS k, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS t FROM part),
    q AS (SELECT k, t, rtrim(split_part(t, '.', 2), '0') AS f, split_part(t, '.', 1) AS w FROM p)
    SELECT k, CAST(length(w) + length(f) AS INT) AS total, CAST(length(f) AS INT) AS fraction,
           CAST(sign(CAST(t AS DECIMAL(18,2)) - 1500) AS INT) AS compared FROM q""")
def digits_and_order(spark, sf_dir):
    """Digit counts and the exact order of decimals."""
    t = F.concat(money("p_retailprice"), F.lit("000"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), numeric.total_digits(t).cast("int").alias("total"), numeric.fraction_digits(t).cast("int").alias("fraction"),
        numeric.decimal_compare(t, F.lit("1500")).cast("int").alias("compared"),
    )


@query("""
    SELECT doc_id AS k, trim(regexp_replace(coalesce(text, ''), '[\t\n\r ]+', ' ', 'g'), ' ') AS text FROM documents""")
def whitespace_collapse(spark, sf_dir):
    """White space collapses to single blanks."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), lexical.collapse(F.coalesce("text", F.lit(""))).alias("text"))


@query("""
    SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS member, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS number,
           CAST(len(string_split(trim(p_type), ' ')) AS INT) AS items, string_split(trim(p_type), ' ')[1] AS first FROM part""")
def list_and_union(spark, sf_dir):
    """Lists split at white space; of a union the first member that suits."""
    either = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("x"), F.col("p_size").cast("string")))
    spaced = F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("\n  ")), F.lit(" "))
    xml = spread(table(spark, sf_dir, "part")).select(doc("words", at("key", F.col("p_partkey")), txt("list", spaced), txt("either", either)).alias("xml"))
    return engine.safe_parse_xml(xml, "xml", plan("words")).selectExpr(
        "doc.`@key` AS k", "doc.either.member AS member", "doc.either.m0 AS number", "size(doc.list) AS items", "doc.list[0] AS first"
    )


# Facets, choices, cardinality


def parts_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = doc(
        "part", at("key", F.col("p_partkey")), txt("brand", F.col("p_brand")), txt("name", F.col("p_name")), txt("size", F.col("p_size")), txt("price", money("p_retailprice"))
    )
    return spread(table(spark, sf_dir, "part")).select("p_partkey", xml.alias("xml"))


PART_RULES = """
    SELECT p_partkey AS k, '/part/brand' AS path, 'pattern' AS code FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]')
    UNION ALL SELECT p_partkey, '/part/brand', 'maxLength' FROM part WHERE length(p_brand) > 8
    UNION ALL SELECT p_partkey, '/part/name', 'minLength' FROM part WHERE length(p_name) < 4
    UNION ALL SELECT p_partkey, '/part/name', 'maxLength' FROM part WHERE length(p_name) > 12
    UNION ALL SELECT p_partkey, '/part/size', 'minInclusive' FROM part WHERE p_size < 1
    UNION ALL SELECT p_partkey, '/part/size', 'maxInclusive' FROM part WHERE p_size > 40
    UNION ALL SELECT p_partkey, '/part/price', 'maxExclusive' FROM part WHERE CAST(p_retailprice AS DECIMAL(18,2)) >= 1500"""


@query(PART_RULES)
def facet_issues(spark, sf_dir):
    """All violations of patterns, lengths and bounds, as rows."""
    found = engine.validate(parts_xml(spark, sf_dir), "xml", plan("part"), ["p_partkey"])
    return found.select(F.col("p_partkey").alias("k"), "path", "code")


@query("""
    SELECT o_orderkey AS k, o_orderstatus IN ('F', 'O') AS listed, o_orderpriority SIMILAR TO '[1-3]-[A-Z]+' AS matched FROM orders""")
def facet_enum_pattern(spark, sf_dir):
    """Enumerations and patterns as predicates."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), status.isin("F", "O").alias("listed"), xsd_pattern(F.col("o_orderpriority"), r"[1-3]-[\p{Lu}-[a-z]]+").alias("matched")
    )


def valid_of(spark: SparkSession, xml: DataFrame, key: str, root: str) -> DataFrame:
    got = engine.safe_parse_xml(xml, "xml", plan(root))
    return got.select(F.col(key).alias("k"), (F.size("_issues") == 0).alias("ok"))


@query("""
    SELECT c_custkey AS k, CAST(c_custkey % 2 = 0 AS INT) + CAST(c_custkey % 3 = 0 AS INT) + CAST(c_custkey % 5 IN (0, 1) AS INT) = 1
           AND c_custkey % 5 <> 2 AS ok FROM customer""")
def choice_exactly_one(spark, sf_dir):
    """One complete branch of three, none partial: mail, phone, or street with city."""
    k = F.col("c_custkey")
    both = "<street>a</street><city>b</city>"
    parts = [F.when(k % 2 == 0, "<mail>m</mail>").otherwise(""), F.when(k % 3 == 0, "<phone>p</phone>").otherwise(""), F.when((k % 5).isin(0, 1), both).when(k % 5 == 2, "<city>b</city>").otherwise("")]
    return valid_of(spark, spread(table(spark, sf_dir, "customer")).select("c_custkey", doc("contact", at("key", k), *parts).alias("xml")), "c_custkey", "contact")


@query("SELECT c_custkey AS k, c_custkey % 4 <> 0 AS ok FROM customer")
def choice_repeated(spark, sf_dir):
    """A repeated choice needs at least one branch."""
    k = F.col("c_custkey")
    parts = F.concat(F.repeat(F.lit("<a>1</a>"), (k % 2).cast("int")), F.repeat(F.lit("<b>2</b>"), F.floor(k / 2).cast("int") % 2))
    return valid_of(spark, spread(table(spark, sf_dir, "customer")).select("c_custkey", doc("bag", at("key", k), parts).alias("xml")), "c_custkey", "bag")


@query("""
    WITH c AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS p, c_custkey % 3 = 0 AS h, c_custkey % 5 = 0 AS l, c_custkey % 7 = 0 AS r FROM customer)
    SELECT k, (p AND NOT h AND NOT l AND NOT r) OR (NOT p AND h AND (l <> r)) AS ok FROM c""")
def choice_nested(spark, sf_dir):
    """A choice in a branch of a choice."""
    k = F.col("c_custkey")
    parts = [F.when(k % n == 0, f"<{e}>x</{e}>").otherwise("") for n, e in ((2, "plain"), (3, "head"), (5, "left"), (7, "right"))]
    return valid_of(spark, spread(table(spark, sf_dir, "customer")).select("c_custkey", doc("nested", at("key", k), *parts).alias("xml")), "c_custkey", "nested")


@query("""
    SELECT o_orderkey AS k, CAST(count(l_linenumber) AS INT) AS n_lines, coalesce(max(l_linenumber), 0) AS last_line
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_linenumber) > 0""")
def cardinality_bounds(spark, sf_dir):
    """How often a repeated element occurs."""
    parsed = engine.safe_parse_xml(lines_xml(spark, sf_dir), "xml", plan("order"))
    return parsed.selectExpr("doc.`@id` AS k", "size(doc.line) AS n_lines", "array_max(transform(doc.line, x -> x.`@number`)) AS last_line")


# Open content, polymorphism, order


@query("""
    SELECT event_id AS k, user_id AS "user", event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'a b' END AS note FROM events""")
def wildcard_sweep(spark, sf_dir):
    """Elements and attributes that no field takes are kept."""
    k = F.col("event_id")
    note = F.when(k % 2 == 0, "<x:note xmlns:x='urn:x'>a b</x:note>").otherwise("")
    xml = spread(table(spark, sf_dir, "events")).select(doc("event", F.concat(at("id", k), at("kind", F.col("event_type"))), txt("user", F.col("user_id")), note).alias("xml"))
    got = engine.safe_parse_xml(xml, "xml", plan("event"))
    extra = F.from_json("doc._extra.json", "map<string,string>")
    return got.select(F.col("doc.`@id`").alias("k"), F.col("doc.user").alias("user"), extra["@{}kind"].alias("kind"), extra["{urn:x}note"].alias("note"))


@query("""
    SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '{urn:sales}buyer' WHEN 1 THEN '{urn:sales}seller' ELSE '{urn:sales}party' END AS tag,
           CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 1 THEN c_nationkey END AS nation,
           CASE WHEN c_custkey % 2 = 0 THEN '{urn:sales}KeyBuyer' END AS agent_type, CASE WHEN c_custkey % 2 = 0 THEN 7 END AS agent_rank FROM customer""")
def polymorphic_dispatch(spark, sf_dir):
    """Substituted elements choose a shape by tag, xsi:type chooses derived types."""
    k = F.col("c_custkey")
    name = txt("name", F.col("c_name"))
    party = F.when(k % 3 == 0, el("buyer", F.concat(name, txt("segment", F.col("c_mktsegment"))))).when(
        k % 3 == 1, el("seller", F.concat(name, txt("nation", F.col("c_nationkey"))))).otherwise(el("party", name))
    agent = F.when(k % 2 == 0, el("agent", F.concat(name, F.lit("<segment>s</segment><rank>7</rank>")), f' xmlns:t="{NS}" xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:type="t:KeyBuyer"')).otherwise(el("agent", name))
    xml = spread(table(spark, sf_dir, "customer")).select(doc("deal", at("key", k), party, agent).alias("xml"))
    p = plan("deal")
    once = engine.safe_parse_xml(xml, "xml", p).select("doc")
    again = engine.safe_parse_xml(engine.to_xml(once, "doc", p), "xml", p)
    return again.selectExpr("doc.`@key` AS k", "doc.party.__qname AS tag", "doc.party.segment AS segment", "doc.party.nation AS nation", "doc.agent.xsiType AS agent_type", "doc.agent.rank AS agent_rank")


@query("""
    SELECT * FROM (VALUES ('Buyer', 'Party', 1), ('Seller', 'Party', 1), ('KeyBuyer', 'Buyer', 1), ('KeyBuyer', 'Party', 2)) t(name, ancestor, steps)""")
def derived_closure(spark, sf_dir):
    """All ancestors of each type, by a recursive query over the schema's catalog."""
    up = catalog.closure(spark, engine.load_xsd(SALES)).where("name LIKE '{urn:sales}%' AND ancestor LIKE '{urn:sales}%'")
    return up.select(F.regexp_replace("name", r"\{.*\}", "").alias("name"), F.regexp_replace("ancestor", r"\{.*\}", "").alias("ancestor"), F.col("steps").cast("int").alias("steps"))


@query("""
    SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'a0 b0 a1' ELSE 'b0 a0 a1' END AS seen, CASE WHEN c_custkey % 2 = 0 THEN '1,2,3' ELSE '2,1,3' END AS written FROM customer""")
def document_order(spark, sf_dir):
    """The order of elements in a repeated choice is noted and written again."""
    k = F.col("c_custkey")
    parts = F.when(k % 2 == 0, "<a>1</a><b>2</b><a>3</a>").otherwise("<b>2</b><a>1</a><a>3</a>")
    p = plan("bag")
    got = engine.safe_parse_xml(spread(table(spark, sf_dir, "customer")).select(doc("bag", at("key", k), parts).alias("xml")), "xml", p)
    seen = F.array_join(F.transform("doc._order", lambda o: F.concat(o["key"], o["index"].cast("string"))), " ")
    written = F.array_join(F.regexp_extract_all("out", F.lit(r">(\d)<"), F.lit(1)), ",")
    return engine.to_xml(got, "doc", p, "out").select(F.col("doc.`@key`").alias("k"), seen.alias("seen"), written.alias("written"))


@query("SELECT c_custkey AS k, c_name || ' in ' || ' here' AS text, c_mktsegment AS em FROM customer")
def mixed_text(spark, sf_dir):
    """Text between elements is joined."""
    k = F.col("c_custkey")
    xml = spread(table(spark, sf_dir, "customer")).select(doc("text", at("key", k), escape_text(F.col("c_name")), F.lit(" in "), txt("em", F.col("c_mktsegment")), F.lit(" here")).alias("xml"))
    return engine.safe_parse_xml(xml, "xml", plan("text")).selectExpr("doc.`@key` AS k", "doc._text AS text", "doc.em[0] AS em")


@query("""
    SELECT o_orderkey AS k, l_linenumber AS n, CAST(l_partkey AS VARCHAR) AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def node_table(spark, sf_dir):
    """All elements of documents as rows, with parents; no schema is needed."""
    nodes = lines_xml(spark, sf_dir).select(shred.nodes(F.col("xml")).alias("nodes"))
    one = nodes.select("nodes", F.explode(F.filter("nodes", lambda n: n["qname"] == f"{{{NS}}}line")).alias("line"))
    part = F.get(F.filter("nodes", lambda n: (n["parent"] == F.col("line.ord")) & (n["qname"] == f"{{{NS}}}part")), F.lit(0))["value"]
    root = F.get("nodes", F.lit(0))["attributes"]["{}id"]
    return one.select(root.cast("long").alias("k"), F.col("line.attributes")["{}number"].cast("int").alias("n"), part.alias("part"))


# Errors, conformance, streams


@query("SELECT page_id AS k, 'structural' AS channel FROM pages")
def malformed_pages(spark, sf_dir):
    """Web pages are not XML: each gives a structural violation, none stops the query."""
    found = engine.validate(table(spark, sf_dir, "pages"), "html", plan("customer"), ["page_id"])
    return found.select(F.col("page_id").alias("k"), "channel")


@query("""
    SELECT p_partkey AS k, regexp_full_match(p_brand, 'Brand#[1-3][0-9]') AND length(p_brand) <= 8 AND length(p_name) BETWEEN 4 AND 12
           AND p_size BETWEEN 1 AND 40 AND CAST(p_retailprice AS DECIMAL(18,2)) < 1500 AS ok FROM part""")
def conformance_rows(spark, sf_dir):
    """Full XSD validation of each row by Spark's own reader."""
    return conform.conform(parts_xml(spark, sf_dir), "xml", SALES).select(F.col("p_partkey").alias("k"), F.col("_conforms").alias("ok"))


@query("SELECT * FROM (VALUES ('elements', CAST(14 AS BIGINT)), ('diagnostics', CAST(0 AS BIGINT))) t(what, n)")
def schema_catalog(spark, sf_dir):
    """The schema itself as tables."""
    schema = engine.load_xsd(SALES)
    parts = [catalog.catalog(spark, schema, k).groupBy().agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k in ("elements", "diagnostics")]
    return parts[0].unionByName(parts[1])


@query(ORDER_SQL)
def stream_parse(spark, sf_dir):
    """The same plan on a stream: orders are read as a stream, parsed, and written once."""
    out, work = shared_path(spark, "stream"), shared_path(spark, "stream")
    schema = table(spark, sf_dir, "orders").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    xml = doc(
        "order", F.concat(at("id", F.col("o_orderkey")), at("status", F.col("o_orderstatus")), at("priority", F.col("o_orderpriority"))),
        txt("custkey", F.col("o_custkey")), txt("total", money("o_totalprice")), txt("date", day),
    )
    parsed = engine.safe_parse_xml(source.select(xml.alias("xml")), "xml", plan("order")).selectExpr(*ORDER_COLUMNS)
    parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", work).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(parsed.schema).parquet(out)
