import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from xsdframe import engine
from xsdframe.__main__ import main
from xsdframe.errors import XsdFrameError
from xsdframe.operators import catalog, conform
from xsdframe.plans.analyzer import derived_types, substitution_members
from xsdframe.queries import SALES
from xsdframe.sources import loader, xmltree
from xsdframe.streaming import parse_stream, read_documents, write_split

HEAD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:t="urn:t" targetNamespace="urn:t" elementFormDefault="qualified">'


def schema_of(tmp_path, body, name="a.xsd", head=HEAD):
    path = tmp_path / name
    path.write_text(head + body + "</xs:schema>", encoding="utf-8")
    return str(path)


def parsed(spark, path, root, *texts, **options):
    p = engine.compile(engine.load_xsd(path), root, **options)
    df = spark.createDataFrame([(t,) for t in texts], "xml string").coalesce(1)
    return p, engine.safe_parse_xml(df, "xml", p, raw="raw")


def test_decoding_and_repair():
    assert xmltree.decode_xml('<?xml version="1.0" encoding="windows-1252"?><a>é</a>'.encode("cp1252")) == '<?xml version="1.0" encoding="UTF-8"?><a>é</a>'
    assert xmltree.decode_xml("<a>é</a>".encode("utf-16")) == "<a>é</a>" == xmltree.decode_xml("﻿<a>é</a>".encode())
    assert xmltree.decode_xml("<?xml version='1.0'?><a/>".encode("utf-16-le")).endswith("<a/>")
    assert xmltree.repair_tag_names("<men&#249;><![CDATA[<x&#249;>]]></men&#xF9;>") == "<menù><![CDATA[<x&#249;>]]></menù>"
    assert xmltree.decode_entities("&amp;lt;&#65;") == "<A"
    root = xmltree.parse_xml('<!DOCTYPE r [<!ENTITY e "x">]><r a="1&#9;2\n3">t&e;<![CDATA[<&]]>u</r>')
    assert root.text == "txu<&" and root.attrs["{}a"] == "1\t2 3"
    with pytest.raises(XsdFrameError):
        xmltree.parse_xml("<a><b></a>")


def test_graph_chameleon_and_redefine(tmp_path):
    schema_of(tmp_path, '<xs:complexType name="P"><xs:sequence><xs:element name="a" type="xs:string"/></xs:sequence></xs:complexType>', "base.xsd", '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" elementFormDefault="qualified">')
    path = schema_of(
        tmp_path,
        '<xs:redefine schemaLocation="base.xsd"><xs:complexType name="P"><xs:complexContent><xs:extension base="t:P"><xs:sequence><xs:element name="b" type="xs:int"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType></xs:redefine>'
        '<xs:include schemaLocation="base.xsd"/><xs:import namespace="urn:z" schemaLocation="http://example.org/z.xsd"/><xs:import namespace="urn:y" schemaLocation="missing.xsd"/>'
        '<xs:element name="r" type="t:P"/>',
    )
    schema = engine.load_xsd(path)
    assert [f.key for f in schema.complex["{urn:t}P"].fields] == ["a", "b"]
    assert {d.kind for d in schema.diagnostics} == {"remote-schema-location", "unresolved-import"}
    assert sorted(k for *_, k in schema.edges) == ["import", "include", "redefine"]
    with pytest.raises(XsdFrameError) as e:
        engine.load_xsd(schema_of(tmp_path, "", "odd.xsd", "<schema>").replace("odd", "none"))
    assert e.value.code == "unreadable"


def test_groups_merging_and_keys(tmp_path):
    path = schema_of(
        tmp_path,
        '<xs:group name="g"><xs:sequence><xs:element name="x" type="xs:int"/><xs:element name="x" type="xs:int" minOccurs="0"/></xs:sequence></xs:group>'
        '<xs:attributeGroup name="ag"><xs:attribute name="p"/><xs:attributeGroup ref="t:ag"/></xs:attributeGroup>'
        '<xs:element name="r"><xs:complexType><xs:sequence maxOccurs="2"><xs:group ref="t:g"/><xs:element ref="t:x"/><xs:element ref="t:nope"/></xs:sequence><xs:attributeGroup ref="t:ag"/><xs:anyAttribute/></xs:complexType></xs:element>'
        '<xs:element name="x" type="xs:string"/>',
    )
    schema = engine.load_xsd(path)
    fields = [(f.key, f.type_name.rpartition("}")[2], f.card.least, f.card.most) for f in schema.complex[schema.elements["{urn:t}r"].type_name].fields]
    # The group's two are one field, twice over; the referenced one has another type. One name, one key.
    assert fields == [("x", "int", 1, 4), ("x", "string", 1, 2), ("@p", "string", 0, 1)]
    assert {d.kind for d in schema.diagnostics} == {"circular-attribute-group-ref", "unresolved-element-ref"}
    with pytest.raises(XsdFrameError):
        engine.load_xsd(schema_of(tmp_path, '<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="a" minOccurs="x"/></xs:sequence></xs:complexType></xs:element>', "bad.xsd"))


def test_lenient_and_strict_outcomes(spark, tmp_path):
    path = schema_of(
        tmp_path,
        '<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="q" type="xs:string"/><xs:element name="n" type="xs:integer" minOccurs="2" maxOccurs="4"/></xs:sequence><xs:attribute name="m" use="required"/></xs:complexType></xs:element>',
    )
    open_ = '<r xmlns="urn:t" m="1">'
    texts = [f"{open_}<q>a</q><n>1</n><n>2</n></r>", f"{open_}<n>1</n><zz/><n>2</n><q>a</q></r>", f"{open_}<q>a</q><n>1</n></r>", f"{open_}<n>1</n><n>2</n></r>",
             f"{open_}<q>a</q>" + "<n>1</n>" * 5 + "</r>", "<r/>", "<r", None, f"{open_}<q>a</q><n>x</n><n></n></r>"]
    p, df = parsed(spark, path, "r", *texts)
    rows = df.collect()
    codes = [[i.code for i in r["_issues"]] for r in rows]
    assert codes[0] == [] == codes[1] and codes[2] == ["min-occurs"] and codes[3] == ["required"] and codes[4] == ["max-occurs"]
    assert codes[5] == ["root"] and codes[6] == ["malformed"] and codes[8] == ["lexical", "lexical"]
    assert rows[0].doc.q == "a" and [int(n) for n in rows[1].doc.n] == [1, 2] and rows[2].doc is None and rows[7].doc is None
    with pytest.raises(Exception, match="min|expected"):
        engine.parse_xml(df.select("xml").where("xml LIKE '%<n>1</n></r>'"), "xml", p).collect()
    loose = engine.safe_parse_xml(df.select("xml"), "xml", p, validate=False).collect()
    assert loose[2].doc.q == "a"


def test_recursion_nil_dates_and_lexicals(spark, tmp_path):
    path = schema_of(
        tmp_path,
        '<xs:complexType name="T"><xs:sequence><xs:element name="v" type="xs:int" nillable="true"/><xs:element name="d" type="xs:dateTime" minOccurs="0"/><xs:element name="k" type="t:T" minOccurs="0"/></xs:sequence></xs:complexType><xs:element name="r" type="t:T"/>',
    )
    nil = '<v xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:nil="true"/>'
    text = f'<r xmlns="urn:t"><v>007</v><d>2024-01-01T24:00:00+01:00</d><k>{nil}<k><v>1</v><k><v>2</v></k></k></k></r>'
    p, df = parsed(spark, path, "r", text, datatypes="structured", max_depth=2)
    row = engine.to_xml(df, "doc", p, "same", raw="raw")
    row = engine.to_xml(row, "doc", p, "canonical").first()
    assert row.doc.v == 7 and row.doc.d.day == 1 and row.doc.d.hour == 23 and row.doc.k.v is None and row.doc.k["v__nil"]
    assert json.loads(row.doc.k.k.json)["{urn:t}v"] == "1"
    assert "<ns0:v>007</ns0:v>" in row.same and "<ns0:v>7</ns0:v>" in row.canonical and 'xsi:nil="true"' in row.canonical
    assert "2024-01-01T23:00:00Z" in row.canonical
    again = engine.safe_parse_xml(spark.createDataFrame([(row.canonical,)], "xml string"), "xml", p).first()
    assert again.doc.v == 7 and not again["_issues"]


def test_wildcards_are_written_again(spark):
    p, df = parsed(spark, SALES, "event", '<event xmlns="urn:sales" id="1" z="&lt;q"><user>5</user><o xmlns="urn:o" w="1">a<i>b</i></o><o xmlns="urn:o"/></event>')
    row = engine.to_xml(df, "doc", p, "out").first()
    again = engine.safe_parse_xml(spark.createDataFrame([(row.out,)], "xml string"), "xml", p).first()
    assert json.loads(row.doc["_extra"].json) == json.loads(again.doc["_extra"].json)
    assert json.loads(row.doc["_extra"].json)["{urn:o}o"][0]["@{}w"] == "1"


def test_closures_and_catalog(spark):
    schema = engine.load_xsd(SALES)
    assert derived_types(schema)["{urn:sales}Party"] == ["{urn:sales}Buyer", "{urn:sales}Seller", "{urn:sales}KeyBuyer"]
    assert substitution_members(schema)["{urn:sales}party"] == ["{urn:sales}buyer", "{urn:sales}seller"]
    for kind in catalog.KINDS:
        assert catalog.catalog(spark, schema, kind).count() >= 0
    assert catalog.closure(spark, schema, "substitutions").count() == 2


def test_conformance(spark, tmp_path):
    good = '<nation xmlns="urn:sales" key="1"><name>x</name><region>2</region></nation>'
    df = spark.createDataFrame([(good,), (good.replace(">2<", ">b<"),), ("<nation",), (None,)], "xml string").coalesce(1)
    assert [r["_conforms"] for r in conform.conform(df, "xml", SALES).collect()] == [True, False, False, None]
    assert conform.violations(spark, good, SALES) == []
    (found,) = conform.violations(spark, good.replace(">2<", ">b<"), SALES)
    assert found.line == 1 and "cvc-" in str(found)
    with pytest.raises(XsdFrameError):
        conform.violations(spark, "<nation", SALES)
    whole = conform.aggregate([SALES], str(tmp_path / "set.xsd"))
    assert conform.violations(spark, good, whole) == []


def split_schema(tmp_path):
    """A schema that redefines a type of a file in a folder below."""
    (tmp_path / "below").mkdir()
    simple = '<xs:simpleType name="Level"><xs:restriction base="{}"><xs:{} value="5"/></xs:restriction></xs:simpleType>'
    schema_of(tmp_path, simple.format("xs:int", "minInclusive"), "below/part.xsd", '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">')
    return schema_of(tmp_path, f'<xs:redefine schemaLocation="below/part.xsd">{simple.format("t:Level", "maxInclusive")}</xs:redefine><xs:element name="a" type="t:Level"/>')


def test_sent_schemas_stand_in_one_folder(spark, tmp_path):
    xsd, there = split_schema(tmp_path), tmp_path / "there"
    there.mkdir()
    files = conform.flat(xsd)
    assert len(files) == 2 and not any("/" in name for name in files) and files == conform.flat(xsd)
    for name, text in files.items():
        (there / name).write_text(text, encoding="utf-8")
    valid = lambda v: conform.violations(spark, f'<a xmlns="urn:t">{v}</a>', str(there / next(iter(files)))) == []
    assert [valid(v) for v in (4, 5, 6)] == [False, True, False]


CLUSTER = """
import sys
from pyspark.sql import SparkSession
from xsdframe.operators import conform
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.sparkContext.parallelize([(f'<a xmlns="urn:t">{v}</a>',) for v in (4, 5, 6)], 1)
df = spark.createDataFrame(rows, "xml string")
for _ in range(2):
    print([r["_conforms"] for r in conform.conform(df, "xml", sys.argv[1]).collect()])
spark.stop()
"""


def test_conformance_on_executors(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": str(tmp_path / "work"), "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, "-c", CLUSTER, split_schema(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.stdout.split("\n")[-3:-1] == ["[False, True, False]"] * 2, done.stderr[-3000:]


def test_stream_splits_good_from_bad(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, v in enumerate(("1", "x", "3")):
        (folder / f"{k}.xml").write_text(f'<nation xmlns="urn:sales" key="{v}"><name>n</name><region>2</region></nation>')
    p = engine.compile(engine.load_xsd(SALES), "nation")
    out = parse_stream(read_documents(spark, str(folder)), "xml", p)
    write_split(out, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_command_line(tmp_path, capsys):
    lib = schema_of(tmp_path, '<xs:simpleType name="S"><xs:restriction base="xs:string"/></xs:simpleType>', "lib.xsd")
    entry = schema_of(tmp_path, '<xs:include schemaLocation="lib.xsd"/><xs:element name="r" type="t:S"/>', "entry.xsd")
    assert loader.is_library(lib) and not loader.is_library(entry) and loader.expand([str(tmp_path)]) == [entry, lib]
    assert main(["bundle", entry]) == 0
    assert engine.load_xsd(str(tmp_path / "entry.bundled.xsd")).elements["{urn:t}r"].type_name == "{urn:t}S"
    assert main(["compile", str(tmp_path / "entry.xsd"), "-o", str(tmp_path / "out"), "-n", "x"]) == 0
    assert json.loads((tmp_path / "out" / "x.schema.json").read_text()) == {"{urn:t}r": "string"}
    assert main(["compile", str(tmp_path / "gone.xsd")]) == 1 and "unreadable" in capsys.readouterr().err


def test_bundles_keep_prefixes(tmp_path):
    """Prefixes of dependencies are declared; what one schema element cannot say is an error."""
    schema_of(tmp_path, '<x:simpleType name="S"><x:restriction base="x:int"/></x:simpleType>', "other.xsd", '<x:schema xmlns:x="http://www.w3.org/2001/XMLSchema" xmlns:me="urn:t" targetNamespace="urn:t">')
    path = tmp_path / "other.xsd"
    path.write_text(path.read_text().replace("</xs:schema>", "</x:schema>"))
    entry = schema_of(tmp_path, '<xs:include schemaLocation="other.xsd"/><xs:element name="r" type="t:S"/>', "entry.xsd")
    out = tmp_path / "whole.xsd"
    out.write_text(loader.bundle(entry))
    schema = engine.load_xsd(str(out))
    assert schema.elements["{urn:t}r"].type_name == "{urn:t}S" and schema.simple["{urn:t}S"].base.endswith("}int") and not schema.diagnostics
    schema_of(tmp_path, "", "clash.xsd", HEAD.replace("xmlns:t=", 'xmlns:z="urn:z" xmlns:t='))
    clash = schema_of(tmp_path, '<xs:include schemaLocation="clash.xsd"/>', "e2.xsd", HEAD.replace("xmlns:t=", 'xmlns:z="urn:y" xmlns:t='))
    with pytest.raises(XsdFrameError) as e:
        loader.bundle(clash)
    assert e.value.code == "bundle-prefix"
    schema_of(tmp_path, "", "far.xsd", HEAD.replace('targetNamespace="urn:t"', 'targetNamespace="urn:far"'))
    with pytest.raises(XsdFrameError) as e:
        loader.bundle(schema_of(tmp_path, '<xs:import namespace="urn:far" schemaLocation="far.xsd"/>', "e3.xsd"))
    assert e.value.code == "bundle-namespace"


def test_validate_command(spark, tmp_path, capsys):
    good = tmp_path / "good.xml"
    good.write_text('<nation xmlns="urn:sales" key="1"><name>x</name><region>2</region></nation>')
    bad = tmp_path / "bad.xml"
    bad.write_text(good.read_text().replace(">2<", ">b<"))
    assert main(["validate", str(good), "--xsd", SALES]) == 0 and json.loads(capsys.readouterr().out)["region"] == 2
    assert main(["validate", str(bad), "--xsd", SALES]) == 1 and "/nation/region" in capsys.readouterr().err
    assert main(["validate", str(good), "--xsd", SALES, "-e", "strict"]) == 0
    assert main(["validate", str(bad), "--xsd", SALES, "-e", "strict"]) == 1 and "line 1" in capsys.readouterr().err
    assert main(["validate", str(tmp_path / "none.xml"), "--xsd", SALES]) == 1


def test_fixed_values_are_written_as_declared(spark, tmp_path):
    path = schema_of(tmp_path, '<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="n" type="xs:decimal" fixed="1.50"/></xs:sequence></xs:complexType></xs:element>')
    p, df = parsed(spark, path, "r", '<r xmlns="urn:t"><n>1.5</n></r>', '<r xmlns="urn:t"><n/></r>')
    assert [r.out for r in engine.to_xml(df, "doc", p, "out").collect()] == ['<ns0:r xmlns:ns0="urn:t"><ns0:n>1.50</ns0:n></ns0:r>'] * 2


def test_plan_is_stateless_and_pruned(spark):
    p = engine.compile(engine.load_xsd(SALES), "order", paths=["line.part"])
    assert p.spark_type().simpleString() == "struct<line:array<struct<part:bigint>>>"
    with pytest.raises(XsdFrameError):
        engine.compile(engine.load_xsd(SALES), "nobody")
    df = spark.createDataFrame([('<order xmlns="urn:sales"><line><part>3</part></line></order>',)], "xml string")
    plan = engine.safe_parse_xml(df, "xml", p).select(F.col("doc.line"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
