"""Strict conformance: full XSD validation of each row by Spark's own XML reader.

The executors say whether a row conforms; lines, columns and messages of single documents
come from the driver's JVM.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from dataclasses import dataclass
from html import unescape
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import XsdFrameError
from ..sources.loader import dependencies, read_bytes, read_schema
from ..sources.xmltree import decode_xml

_BAD = "_malformed"

#: Folders of the schemas sent, by application and content; executors that come later fetch from
#: them, so they stay until the driver ends.
_sent: dict[tuple[str, str], tempfile.TemporaryDirectory] = {}


def flat(xsd: str) -> dict[str, str]:
    """The text of a schema (first) and of all files that it reaches, by names that can stand in
    one folder, each reference leading to such a name. Equal schemas have equal names."""
    paths = list(dict.fromkeys(os.path.realpath(p) for p in (xsd, *dependencies(xsd))))
    texts = [decode_xml(read_bytes(p)) for p in paths]
    mark = hashlib.sha256("\0".join(x for pair in zip((os.path.relpath(p, os.path.dirname(paths[0])) for p in paths), texts) for x in pair).encode()).hexdigest()[:16]
    names = {p: f"xsd-{mark}-{k}.xsd" for k, p in enumerate(paths)}
    out = {}
    for path, text in zip(paths, texts):
        def led(m: re.Match, folder: str = os.path.dirname(path)) -> str:
            to = names.get(os.path.realpath(os.path.join(folder, unescape(m[3]).strip())))
            return m[0] if to is None else f"{m[1]}{m[2]}{to}{m[2]}"

        out[names[path]] = re.sub(r"""(\sschemaLocation\s*=\s*)(["'])(.*?)\2""", led, text, flags=re.DOTALL)
    return out


def ship(spark: SparkSession, xsd: str) -> str:
    """Send a schema and what it reaches to all executors; the path to give to the reader there.

    Executors find sent files in their working folder, by name alone: Spark sends no local
    folder to them, and its reader looks for no path below."""
    context = spark.sparkContext
    if not context.master.startswith("local-cluster") and context.master.startswith("local"):
        return os.path.abspath(xsd)
    files = flat(xsd)
    entry = next(iter(files))
    if (context.applicationId, entry) not in _sent:
        folder = _sent[context.applicationId, entry] = tempfile.TemporaryDirectory(prefix="xsdframe-", ignore_cleanup_errors=True)
        for name, text in files.items():
            path = os.path.join(folder.name, name)
            with open(path, "w", encoding="utf-8", newline="") as f:
                f.write(text)
            context.addFile(path)
    return entry


def conforms(xml: Column, shipped: str) -> Column:
    """Whether each text is valid; false for malformed texts, null for null."""
    options = {"rowValidationXSDPath": shipped, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    read = F.from_xml(xml, f"{_BAD} STRING", options)
    return F.when(xml.isNotNull(), read[_BAD].isNull())


def conform(df: DataFrame, column: str, xsd: str, into: str = "_conforms") -> DataFrame:
    """df with a boolean column. The schema must be readable where the query is built."""
    if not os.path.exists(xsd):
        raise XsdFrameError(f"cannot read {xsd}", "unreadable", xsd)
    return df.withColumn(into, conforms(F.col(column), ship(df.sparkSession, xsd)))


@dataclass(frozen=True)
class Violation:
    line: int
    column: int
    message: str

    def __str__(self) -> str:
        return f"line {self.line}, column {self.column}: {self.message}"


def violations(spark: SparkSession, xml: str, xsd: str) -> list[Violation]:
    """What is wrong with one document; an empty list if it is valid. A malformed document or
    a broken schema raises."""
    jvm = spark.sparkContext._jvm
    factory = jvm.javax.xml.validation.SchemaFactory.newInstance("http://www.w3.org/2001/XMLSchema")
    try:
        schema = factory.newSchema(jvm.java.io.File(xsd))
    except Exception as e:
        raise XsdFrameError(str(getattr(e, "java_exception", e)), "broken-schema", xsd) from None
    try:
        schema.newValidator().validate(jvm.javax.xml.transform.stream.StreamSource(jvm.java.io.StringReader(xml)))
    except Exception as e:
        cause = getattr(e, "java_exception", None)
        said = str(cause.getMessage()) if cause is not None else str(e)
        if cause is None or not hasattr(cause, "getLineNumber"):
            raise XsdFrameError(said, "malformed") from None
        if not re.match(r"(cvc|src|cos|s4s)-", said):
            raise XsdFrameError(said, "malformed") from None
        return [Violation(cause.getLineNumber(), cause.getColumnNumber(), said)]
    return []


def aggregate(paths: list[str], into: str) -> str:
    """Write a schema that imports all the given ones, as validators take a single one; its
    path. An importing schema's own namespace must differ from those that it imports, so where
    one of them has none the set has one."""
    xs = "{http://www.w3.org/2001/XMLSchema}"
    whole = ElementTree.Element(f"{xs}schema")
    for path in paths:
        place = ElementTree.SubElement(whole, f"{xs}import", schemaLocation=os.path.abspath(path))
        if namespace := read_schema(path).namespace:
            place.set("namespace", namespace)
        else:
            whole.set("targetNamespace", "urn:xsdframe:set")
    ElementTree.ElementTree(whole).write(into, encoding="utf-8", xml_declaration=True)
    return into
