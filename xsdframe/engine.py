"""The public interface: compile schemas, then parse, validate and write XML columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import XsdFrameError
from .functions import F as X
from .functions import once
from .ir import Element, Schema
from .operators import reader, shred
from .operators.writer import Writer
from .plans.analyzer import load_xsd
from .plans.shapes import Shaper, Slot, root_element
from .plans.simple import SimplePlans
from .qname import local

__all__ = ["Plan", "compile", "load_xsd", "parse_xml", "paths_in", "safe_parse_xml", "to_xml", "validate"]


@dataclass
class Plan:
    """A root element ready to be read and written."""

    schema: Schema
    element: Element
    slot: Slot

    @property
    def root(self) -> str:
        return self.element.qname

    def spark_type(self) -> T.DataType:
        return self.slot.spark()

    def shred(self, xml: Column) -> Column:
        """{doc, error} with all values as strings."""
        return shred.shred(xml, self.root, self.slot)

    def typed(self, raw: Column) -> Column:
        return reader.typed(self.slot, raw["doc"])

    def issues(self, raw: Column) -> Column:
        return reader.document_issues(self.slot, raw, local(self.root), self.element.nillable)


def compile(
    schema: Schema, root: str | None = None, datatypes: str = "string", decimal: bool = False, max_depth: int = 4, paths: Iterable[str] | None = None,
    seen: Iterable[str] | None = None,
) -> Plan:
    """A plan for documents with this root.

    datatypes: `string` keeps dates as checked strings, `structured` parses them. decimal:
    xs:decimal as DECIMAL(38,18), not DOUBLE. max_depth: how deep a type may hold itself
    before its content stays open. paths: only these fields (a.b.c) are read, checked and typed.
    seen: the paths that documents use, from paths_in(); the plan then has no other fields (which
    keeps it small for schemas of thousands of types), but still misses required ones, and a
    document with a field that was not seen is a violation `unseen`.
    """
    if datatypes not in ("string", "structured"):
        raise XsdFrameError(f"datatypes is string or structured, not {datatypes}", "bad-option")
    element = root_element(schema, root)
    shaper = Shaper(schema, SimplePlans(schema, datatypes == "structured", decimal), max_depth, None if paths is None else set(paths), None if seen is None else set(seen))
    return Plan(schema, element, shaper.root(element))


def paths_in(df: DataFrame, column: str, schema: Schema, root: str | None = None, max_depth: int = 4) -> list[str]:
    """The paths of fields that the documents of a column use, for compile(seen=). Each path
    comes to the driver once: as many as the schema has in use, however many documents."""
    element = root_element(schema, root)
    slot = Shaper(schema, SimplePlans(schema), max_depth).root(element)
    used = shred.used_paths(element.qname, slot)
    found = df.select(F.explode(used(F.col(column))).alias("path")).distinct()
    return sorted(r.path for r in found.collect())


def safe_parse_xml(df: DataFrame, column: str, plan: Plan, into: str = "doc", issues: str = "_issues", validate: bool = True, raw: str | None = None) -> DataFrame:
    """df with the typed value `into` and all violations `issues`.

    A document with violations has a null value; with validate=False values are typed as far
    as they can be and nothing is checked. raw: keep the strings too, for the writer.
    """
    held = raw or "_raw"
    out = df.withColumn(held, plan.shred(F.col(column)))
    value = plan.typed(X.col(held))
    if validate:
        out = out.withColumn(issues, once(plan.issues(X.col(held))))
        out = out.withColumn(into, F.when(F.size(issues) == 0, value))
    else:
        out = out.withColumn(into, value)
    return out if raw else out.drop(held)


def parse_xml(df: DataFrame, column: str, plan: Plan, into: str = "doc") -> DataFrame:
    """df with the typed value; a violation fails the query and names the first one."""
    out = safe_parse_xml(df, column, plan, into, "_issues")
    first = F.get("_issues", F.lit(0))
    told = F.concat(first["path"], F.lit(": "), first["message"])
    return out.withColumn(into, F.when(F.size("_issues") > 0, F.raise_error(told)).otherwise(F.col(into))).drop("_issues")


def validate(df: DataFrame, column: str, plan: Plan, keep: Iterable[str] = ()) -> DataFrame:
    """A row for each violation: the kept columns, path, code, message and channel."""
    keep = list(keep)
    checked = df.withColumn("_raw", plan.shred(F.col(column))).select(*keep, once(plan.issues(X.col("_raw"))).alias("_issues"))
    return checked.select(*keep, F.explode("_issues").alias("i")).select(*keep, "i.*")


def to_xml(df: DataFrame, column: str, plan: Plan, into: str = "xml", raw: str | None = None) -> DataFrame:
    """df with the XML text of a typed column. raw: the strings that safe_parse_xml kept; a
    value that still means the same is then written as it stood."""
    text = Writer(plan.root, plan.slot).document(X.col(column), X.col(raw)["doc"] if raw else None)
    return df.withColumn(into, once(text))
