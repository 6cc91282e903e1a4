"""What is read comes back when it is written: substitution, unknown types, names with
prefixes, wildcards, large schemas."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from test_engine import schema_of

from xsdframe import engine
from xsdframe.errors import XsdFrameError
from xsdframe.sources.xmltree import parse_xml

XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


def shown(node):
    """A document without its prefixes; xsi:type as a Clark name."""
    attrs = {k: v for k, v in node.attrs.items()}
    told = attrs.pop("{http://www.w3.org/2001/XMLSchema-instance}type", None)
    if told:
        prefix, _, local = told.rpartition(":")
        attrs["type"] = f"{{{node.ns.get(prefix, '')}}}{local}"
    return node.tag, tuple(sorted(attrs.items())), node.text.strip(), tuple(shown(c) for c in node.children)


def both(spark, path, root, *texts, **options):
    """Rows of (doc, out, issues) of the texts, written from the values alone."""
    plan = engine.compile(engine.load_xsd(path), root, **options)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, xml string").coalesce(1)
    rows = engine.to_xml(engine.safe_parse_xml(df, "xml", plan), "doc", plan, "out").orderBy("k").collect()
    return [(r.doc, r.out, r["_issues"]) for r in rows]


def same(spark, path, root, *texts, **options):
    for text, (_, out, issues) in zip(texts, both(spark, path, root, *texts, **options)):
        assert not issues
        assert shown(parse_xml(out)) == shown(parse_xml(text)), out


LIBRARY = """
    <xs:element name="comment" type="xs:string"/>
    <xs:element name="editorNote" type="t:Short" substitutionGroup="t:comment"/>
    <xs:element name="aside" substitutionGroup="t:editorNote"/>
    <xs:simpleType name="Short"><xs:restriction base="xs:string"><xs:maxLength value="5"/></xs:restriction></xs:simpleType>
    <xs:element name="r"><xs:complexType><xs:sequence>
      <xs:element name="a" type="xs:int"/><xs:element ref="t:comment" minOccurs="0"/><xs:element name="b" type="xs:int" minOccurs="0"/>
    </xs:sequence></xs:complexType></xs:element>
    <xs:element name="many"><xs:complexType><xs:sequence><xs:element ref="t:comment" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>"""


def test_substituted_leaves_keep_their_tags(spark, tmp_path):
    path = schema_of(tmp_path, LIBRARY)
    head = '<r xmlns="urn:t"><a>1</a>'
    texts = [f"{head}<comment>long enough</comment></r>", f"{head}<editorNote>note</editorNote><b>2</b></r>", f"{head}<aside>x&lt;</aside></r>", f"{head}</r>"]
    same(spark, path, "r", *texts)
    rows = both(spark, path, "r", *texts)
    assert [r[0]["comment__qname"] for r in rows] == [None, "{urn:t}editorNote", "{urn:t}aside", None]
    same(spark, path, "many", '<many xmlns="urn:t"><editorNote>a</editorNote><comment>bbbbbbb</comment><aside>c</aside></many>', '<many xmlns="urn:t"/>')
    (_, _, issues), = both(spark, path, "r", f"{head}<editorNote>too long</editorNote></r>")
    assert [i.code for i in issues] == ["maxLength"]  # by the member's own type


TYPES = """
    <xs:complexType name="Base"><xs:sequence><xs:element name="n" type="xs:int"/></xs:sequence><xs:attribute name="p"/></xs:complexType>
    <xs:complexType name="More"><xs:complexContent><xs:extension base="t:Base"><xs:sequence><xs:element name="m" type="xs:int"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
    <xs:element name="r"><xs:complexType><xs:sequence><xs:element name="x" type="t:Base" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>"""


def test_unknown_types_are_kept(spark, tmp_path):
    path = schema_of(tmp_path, TYPES)
    head = f'<r xmlns="urn:t" {XSI} xmlns:t="urn:t" xmlns:o="urn:other">'
    odd = '<x xsi:type="o:New" p="1" o:q="2&lt;"><o:z>before</o:z><n>3</n><o:z a="b"><o:y/></o:z></x>'
    same(
        spark, path, "r", f"{head}<x><n>1</n></x></r>", f'{head}<x xsi:type="t:More"><n>1</n><m>2</m></x>{odd}<x p="2"><n>4</n></x></r>',
        f'<r xmlns="urn:t" {XSI}><x xsi:type="t:Lost" xmlns:t="urn:t"><n>1</n><extra/></x></r>',
    )
    ((doc, _, _),) = both(spark, path, "r", f"{head}{odd}</r>")
    assert doc.x[0].xsiType == "{urn:other}New" and json.loads(doc.x[0]["_extra"].json)["{urn:other}z"][0] == "before"


NAMES = """
    <xs:element name="r"><xs:complexType><xs:sequence>
      <xs:element name="q" type="xs:QName" maxOccurs="unbounded"/><xs:element name="k" minOccurs="0"><xs:complexType><xs:attribute name="of" type="xs:QName"/></xs:complexType></xs:element>
    </xs:sequence><xs:attribute name="a" type="xs:QName"/></xs:complexType></xs:element>"""


def meanings(node, names=("q", "of", "a")):
    def of(text, ns):
        prefix, _, local = text.strip().rpartition(":")
        return f"{{{ns.get(prefix, '')}}}{local}"

    out = [of(node.text, node.ns)] if node.local in names else []
    out += [of(v, node.ns) for k, v in sorted(node.attrs.items()) if k.rpartition("}")[2] in names]
    return out + [m for c in node.children for m in meanings(c, names)]


def test_names_stay_bound(spark, tmp_path):
    """A name's prefix still means its namespace, also where prefixes clash, are bound twice or
    are those that the writer uses itself."""
    path = schema_of(tmp_path, NAMES)
    texts = [
        '<r xmlns="urn:t" xmlns:p="urn:p" a="p:x"><q>p:y</q></r>',
        '<r xmlns="urn:t" xmlns:ns0="urn:p" a="ns0:x"><q> ns0:y </q><q xmlns:ns0="urn:second">ns0:z</q></r>',
        '<t:r xmlns:t="urn:t" xmlns="urn:default"><t:q>plain</t:q><t:k xmlns:d="urn:d" of="d:v"/></t:r>',
        '<t:r xmlns:t="urn:t"><t:q>none</t:q><t:q>xml:lang</t:q></t:r>',
    ]
    for text, (_, out, issues) in zip(texts, both(spark, path, "r", *texts)):
        assert not issues and meanings(parse_xml(out)) == meanings(parse_xml(text)), out


WILD = """
    <xs:element name="r"><xs:complexType><xs:sequence>
      <xs:any namespace="urn:one" processContents="lax" minOccurs="0" maxOccurs="unbounded"/><xs:element name="a" type="xs:int"/>
      <xs:any namespace="##other" processContents="lax" minOccurs="0" maxOccurs="unbounded"/><xs:element name="b" type="xs:int"/>
    </xs:sequence></xs:complexType></xs:element>"""


def test_extras_go_to_their_wildcard(spark, tmp_path):
    """Without a recorded order, content goes to the first wildcard that takes its namespace."""
    path = schema_of(tmp_path, WILD)
    text = '<r xmlns="urn:t" xmlns:o="urn:one" xmlns:p="urn:two"><o:x/><a>1</a><p:y>2</p:y><b>3</b></r>'
    same(spark, path, "r", text)
    plan = engine.compile(engine.load_xsd(path), "r")
    df = engine.safe_parse_xml(spark.createDataFrame([(text,)], "xml string"), "xml", plan)
    lost = df.withColumn("doc", df.doc.withField("_order", F.slice(df.doc["_order"], 1, 0)))
    assert shown(parse_xml(engine.to_xml(lost, "doc", plan, "out").first().out)) == shown(parse_xml(text))


def test_only_used_namespaces_are_declared(spark, tmp_path):
    path = schema_of(tmp_path, LIBRARY)
    ((_, out, _),) = both(spark, path, "r", '<r xmlns="urn:t"><a>1</a></r>')
    assert out == '<ns0:r xmlns:ns0="urn:t"><ns0:a>1</ns0:a></ns0:r>'


def many_types(n):
    """A schema of n types that hold each other, each with many optional parts, as business
    document schemas have."""
    rnd = random.Random(4)
    out = ['<xs:complexType name="Text"><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="lang"/><xs:attribute name="scheme"/></xs:extension></xs:simpleContent></xs:complexType>']
    for k in range(n):
        parts = [f'<xs:element name="V{j}" type="{rnd.choice(["t:Text", "xs:decimal", "xs:date", "xs:string"])}" minOccurs="0" maxOccurs="{rnd.choice(["1", "unbounded"])}"/>' for j in range(12)]
        parts += [f'<xs:element name="P{j}" type="t:T{rnd.randrange(n)}" minOccurs="0" maxOccurs="{rnd.choice(["1", "unbounded"])}"/>' for j in range(12)]
        parts.append('<xs:element name="Must" type="xs:string"/>')
        out.append(f'<xs:complexType name="T{k}"><xs:sequence>{"".join(parts)}</xs:sequence></xs:complexType>')
    return "".join(out) + '<xs:element name="doc" type="t:T0"/>'


def test_large_recursive_schema(spark, tmp_path):
    """1500 types that hold each other: the plan has what documents use, in seconds."""
    path = schema_of(tmp_path, many_types(1500))
    schema = engine.load_xsd(path)
    plan = engine.compile(schema, "doc")
    assert plan.slot.shapes and plan.slot.shapes[0].parts[12].slot._made is None  # nothing below is unrolled
    rnd, simple = random.Random(5), {f.qname: f for f in schema.complex["{urn:t}T0"].fields}
    assert len(simple) == 25

    def body(name, depth):
        out = []
        for f in schema.complex[name].fields:
            if f.key == "Must":
                out.append("<Must>m</Must>")
            elif f.key.startswith("V") and rnd.random() < 0.5:
                value = {"decimal": "1.5", "date": "2024-02-29"}.get(f.type_name.rpartition("}")[2], "text &amp; more")
                out.append(f"<{f.key}>{value}</{f.key}>" * (2 if f.card.repeated else 1))
            elif f.key.startswith("P") and depth and rnd.random() < 0.12:
                out.append(f"<{f.key}>{body(f.type_name, depth - 1)}</{f.key}>")
        return "".join(out)

    texts = [f'<doc xmlns="urn:t">{body("{urn:t}T0", 3)}</doc>' for _ in range(2)]
    df = spark.createDataFrame([(t,) for t in texts], "xml string")
    began = time.time()
    seen = engine.paths_in(df, "xml", schema, "doc")
    assert 20 < len(seen) < 500
    same(spark, path, "doc", *texts, seen=seen)
    assert time.time() - began < 60
    lacking = texts[0].replace("<Must>m</Must></doc>", "</doc>")
    ((doc, _, issues),) = both(spark, path, "doc", lacking, seen=[s for s in seen if s != "Must"])
    assert doc is None and [(i.path, i.code) for i in issues] == [("/doc/Must", "required")]
    ((doc, _, issues),) = both(spark, path, "doc", texts[0], seen=["V0"])
    assert doc is None and [i.code for i in issues] == ["unseen"]


def test_schema_errors_and_cycles(tmp_path):
    with pytest.raises(XsdFrameError) as e:
        engine.load_xsd(schema_of(tmp_path, '<xs:simpleType name="T"><xs:restriction base="xs:string"/></xs:simpleType><xs:complexType name="T"/>', "clash.xsd"))
    assert e.value.code == "type-name-collision"
    looped = engine.load_xsd(schema_of(
        tmp_path, '<xs:simpleType name="A"><xs:restriction base="t:B"/></xs:simpleType><xs:simpleType name="B"><xs:restriction base="t:A"/></xs:simpleType>'
        '<xs:simpleType name="U"><xs:union memberTypes="xs:int t:U"/></xs:simpleType><xs:element name="r" type="t:U"/>', "loop.xsd",
    ))
    assert {d.kind for d in looped.diagnostics} == {"circular-derivation", "circular-union-member"}
    path = schema_of(tmp_path, '<xs:element name="r"><xs:complexType><xs:sequence><xs:element ref="t:gone"/></xs:sequence></xs:complexType></xs:element>', "open.xsd")
    assert [d.kind for d in engine.load_xsd(path).diagnostics] == ["unresolved-element-ref"]
    lenient = engine.load_xsd(path, allow_missing_imports=True)
    assert not lenient.diagnostics and lenient.complex[lenient.elements["{urn:t}r"].type_name].fields[0].unknown
