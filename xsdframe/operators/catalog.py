"""A compiled schema as DataFrames, for questions about the schema itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..ir import Schema

KINDS = {
    "elements": "qname string, type string, nillable boolean, head string, `default` string, fixed string, abstract boolean, doc string",
    "complex_types": "qname string, base string, restriction_of string, abstract boolean, mixed boolean, doc string",
    "simple_types": "qname string, kind string, base string, item string, members array<string>, doc string",
    "fields": "type string, position int, kind string, qname string, field_type string, column string, least int, most int, nillable boolean, choice int, branch int, `default` string, fixed string, doc string",
    "facets": "type string, position int, facet string, value string",
    "wildcards": "type string, kind string, namespaces string, position int",
    "files": "file string, target string, kind string",
    "diagnostics": "kind string, message string, ref string",
    "derivations": "type string, base string, kind string",
    "substitutions": "member string, head string",
}


def rows(schema: Schema, kind: str) -> list[tuple]:
    s = schema
    if kind == "elements":
        return [(e.qname, e.type_name, e.nillable, e.heads, e.default, e.fixed, e.abstract, e.doc) for e in s.elements.values()]
    if kind == "complex_types":
        return [(t.name, t.base, t.restriction_of, t.abstract, t.mixed, t.doc) for t in s.complex.values()]
    if kind == "simple_types":
        return [(t.name, t.kind, t.base or None, t.item or None, t.members, t.doc) for t in s.simple.values()]
    if kind == "fields":
        return [
            (t.name, k, f.kind, f.qname, f.type_name, f.key, f.card.least, f.card.most, f.nillable, f.group, f.branch, f.default, f.fixed, f.doc)
            for t in s.complex.values() for k, f in enumerate(t.fields)
        ]
    if kind == "facets":
        return [(t.name, k, n, v) for t in s.simple.values() for k, (n, v) in enumerate(t.facets)]
    if kind == "wildcards":
        return [(t.name, w.kind, w.namespaces, w.at) for t in s.complex.values() for w in t.wildcards]
    if kind == "files":
        return list(s.edges)
    if kind == "diagnostics":
        return [(d.kind, d.message, d.ref) for d in s.diagnostics]
    if kind == "derivations":
        pairs = [(t.name, b, k) for t in s.complex.values() for b, k in ((t.base, "extension"), (t.restriction_of, "restriction")) if b]
        return pairs + [(t.name, t.base, "restriction") for t in s.simple.values() if t.kind == "restriction" and t.base]
    return [(e.qname, e.heads) for e in s.elements.values() if e.heads]


def catalog(spark: SparkSession, schema: Schema, kind: str) -> DataFrame:
    """One of KINDS. Schemas are small, so the rows come from the driver."""
    return spark.createDataFrame(rows(schema, kind), KINDS[kind])


def closure(spark: SparkSession, schema: Schema, kind: str = "derivations") -> DataFrame:
    """(name, ancestor, steps): all types that each derives from, or all heads that each element
    may stand for, by a recursive query; circles end."""
    child, parent = ("type", "base") if kind == "derivations" else ("member", "head")
    view = f"_xsdframe_{kind}"
    catalog(spark, schema, kind).createOrReplaceTempView(view)
    most = len(rows(schema, kind)) + 1
    return spark.sql(
        f"""WITH RECURSIVE up (name, ancestor, steps) AS (
              SELECT {child}, {parent}, 1 FROM {view}
              UNION ALL
              SELECT u.name, d.{parent}, u.steps + 1 FROM up u JOIN {view} d ON u.ancestor = d.{child}
              WHERE u.steps < {most})
            SELECT name, ancestor, min(steps) AS steps FROM up WHERE name <> ancestor GROUP BY name, ancestor"""
    )
