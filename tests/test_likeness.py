from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_type

from xsdframe import engine
from xsdframe.operators import likeness, shred
from xsdframe.queries import SALES
from xsdframe.rule_queries import RULES

XSI = 'xmlns:i="http://www.w3.org/2001/XMLSchema-instance"'
VALUES = [
    "7", "", " ", "\n", "\t", "\r", "\u00e9", "\U0001f600", "\x00", "\x01", "\x7f", "\x85", "\ud800", "\ufffe", "\ufeff", "'", '"', "&amp;", "&#65;", "&", "<", ">", "]]>",
    "<b/>", "<b c='1'/>", "<!-- x -->", "<![CDATA[y]]>", "<?pi x?>", "p:y", "\ue000", "\ue0000\ue001",
]
DOCUMENTS = [
    ("order", '<order xmlns="urn:sales" id="@" status="F"><custkey>@</custkey><total>1</total><date>@</date><line number="@"><part>@</part></line><line number="2"/></order>'),
    ("customer", f'<q:customer xmlns:q="urn:sales" key="@"><q:name>@</q:name><q:segment/><q:balance {XSI} i:nil="true">@</q:balance></q:customer>'),
    ("bag", '<bag xmlns="urn:sales" key="1"><a>@</a> <b>2</b>@<a>@</a></bag>'),
    ("event", '<event xmlns="urn:sales" id="1" kind="@"><user>@</user><x>@</x></event>'),
    ("text", '<text xmlns="urn:sales" key="1">@<em>@</em></text>'),
    ("text", '<text xmlns="urn:sales" key="1">@</text>'),
    ("held", f'<held xmlns="urn:sales" key="1"><part {XSI} xmlns:t="urn:sales" i:type="@"><name>@</name><shade>b</shade></part></held>'),
    ("noted", '<noted xmlns="urn:sales" key="1"><warning>@</warning><remark>@</remark></noted>'),
    ("link", '<link xmlns="urn:sales" xmlns:p="urn:p" key="1" via="@"><to>@</to></link>'),
    ("marked", '<marked xmlns="urn:sales" key="1"><m lang="@">@</m><m>a<b/>@</m></marked>'),
    ("anything", '<anything xmlns="urn:sales" key="1"><body a="@">@</body></anything>'),
]


def reader_of(root, counted):
    plan = engine.compile(engine.load_xsd(SALES if root in ("order", "customer", "bag", "event", "text") else RULES), root)
    kind, full = to_arrow_type(shred.raw_schema(plan.slot)), partial(shred.shred_one, root=plan.root, slot=plan.slot)

    def read(xml):
        counted.append(xml)
        return full(xml)

    return likeness.Reader(read, kind, plan.slot), full, kind


@pytest.mark.parametrize("root, told", DOCUMENTS)
def test_likeness_changes_nothing(root, told):
    """Whatever stands in a value's place, a document is read as it is in full."""
    reader, full, kind = reader_of(root, [])
    texts = [told.replace("@", "v"), None, "<x", told.replace("@", "w")]
    for at in range(told.count("@")):
        head = "v".join(told.split("@")[: at + 1])
        texts += [head + v + "u".join(told.split("@")[at + 1 :]) for v in VALUES]
    want = pa.array([full(x) for x in texts], kind)
    for batch in (texts, texts[::-1], texts):
        assert reader(batch).to_pylist() == (want.to_pylist() if batch is texts else want.to_pylist()[::-1])


def test_documents_of_one_markup_are_read_in_full_once():
    """10,000 orders of 0 to 7 lines: a full reading and a marked one for each number of lines."""
    counted = []
    reader, full, kind = reader_of("order", counted)
    line = '<line number="{}"><part>{}</part><quantity>1.00</quantity></line>'
    texts = [
        f'<order xmlns="urn:sales" id="{i}" status="O"><custkey>{i}</custkey><total>1.5</total><date>2000-01-01</date>' + "".join(line.format(k, i + k) for k in range(i % 8)) + "</order>"
        for i in range(10_000)
    ]
    assert reader(texts).equals(pa.array([full(x) for x in texts], kind)) and len(counted) == 16


def test_documents_that_differ_stay_bounded():
    """Documents that are no templates, or of ever new markup, are read in full and not kept."""
    counted = []
    reader, full, kind = reader_of("text", counted)
    texts = [f'<text xmlns="urn:sales" key="1"><!-- {i} --><em>a</em></text>' for i in range(500)] + ["<text xmlns='urn:sales' key='1'>" + "<em>a</em>" * i + "</text>" for i in range(500)]
    assert reader(texts).equals(pa.array([full(x) for x in texts], kind))
    assert len(counted) <= 1000 + likeness.VAIN and len(reader.bodies) <= likeness.KEPT
