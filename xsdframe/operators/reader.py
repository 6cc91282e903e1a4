"""From the shredder's strings to typed values, and to the list of all violations.

Both are Spark expressions over the raw struct. Violations are rows of ISSUE; channel
structural or lexical is what a strict reader stops at, schema what it collects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import types as T

from ..functions import F, let
from ..ir import Field
from ..plans.shapes import BOUND, EXTRA, NIL, ORDER, TAG, TYPE, Part, Shape, Slot
from ..plans.simple import SimplePlan
from . import choice

ISSUE = "struct<path:string,code:string,message:string,channel:string>"


def _lexical(part: Part, v: Column) -> Column:
    """A leaf's lexical with its fixed value or default: attributes when absent, elements when
    present and empty."""
    f = part.field
    instead = f.fixed if f.fixed is not None else f.default
    if instead is None:
        return v
    if f.kind == "attribute":
        return F.coalesce(v, F.lit(instead))
    return F.when(v == "", F.lit(instead)).otherwise(v)


def _leaf(part: Part, raw: Column) -> Column:
    v = raw if part.field.kind != "element" else raw["v"]
    return let(_lexical(part, v), part.slot.simple.value)


def _one(part: Part, raw: Column) -> Column:
    if part.slot.kind == "leaf":
        return _leaf(part, raw)
    return raw if part.slot.kind == "open" else typed(part.slot, raw)


def _each(part: Part):
    return lambda x: _one(part, x)


def typed(slot: Slot, raw: Column) -> Column:
    """The typed value of a raw slot; null where it is absent or nil."""
    if slot.kind == "leaf":
        return slot.simple.value(raw["v"])
    if slot.kind == "open":
        return raw
    fields = []
    for column, part in slot.columns().items():
        value = raw[column]
        if part.repeated:
            inner = F.transform(value, _each(part))
            # An absent repeated element is an empty list where the shape declares it.
            value = F.coalesce(inner, F.array().cast(T.ArrayType(part.slot.spark()))) if not slot.polymorphic and not slot.by_tag else inner
        else:
            value = _one(part, value)
        fields.append(value.alias(column))
        if part.field.nillable and not part.repeated:
            nil = raw[column]["nil"] if part.slot.kind == "leaf" else raw[column]["_nil"] if part.slot.kind == "object" else F.lit(False)
            fields.append(F.coalesce(nil, F.lit(False)).alias(column + NIL))
        if part.slot.leaf_tags:
            tag = F.transform(raw[column], lambda x: x["tag"]) if part.repeated else raw[column]["tag"]
            fields.append(tag.alias(column + TAG))
    if slot.polymorphic:
        fields.append(raw[TYPE].alias(TYPE))
    if slot.by_tag:
        fields.append(raw[TAG].alias(TAG))
    if slot.binds:
        fields.append(raw[BOUND].alias(BOUND))
    if slot.wild:
        fields.append(raw[EXTRA].alias(EXTRA))
    if slot.ordered:
        fields.append(raw[ORDER].alias(ORDER))
    return F.when(raw.isNotNull() & ~F.coalesce(raw["_nil"], F.lit(False)), F.struct(*fields))


def _issue(ok: Column, path: str, code: str, message: str, channel: str) -> Column:
    """An array of the violation where ok is false, else an empty one; null counts as holding."""
    made = F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(channel).alias("channel"))
    ok = F.coalesce(ok, F.lit(True))
    return _sound(F.when(~ok, F.array(made)).otherwise(F.array()), ok)


def _sound(found: Column, ok: Column | None) -> Column:
    """The violations, with whether there are none told beside them where that is known without
    making them. Elements that occur repeatedly are checked in a lambda, which is interpreted: there
    the short answer comes first."""
    if ok is not None:
        found.ok = ok
    return found


def _all_ok(found: list[Column]) -> Column | None:
    oks = [getattr(x, "ok", None) for x in found]
    return None if any(ok is None for ok in oks) else reduce(lambda a, b: a & b, oks, F.lit(True))


def _list(found: list[Column]) -> Column | None:
    # Not an array without its nulls: that is a lambda, which leaves all tests to the interpreter.
    return _sound(F.concat(*found), _all_ok(found)) if found else None


def _leaf_issues(part: Part, raw: Column, path: str) -> list[Column]:
    """Of one present occurrence; raw is the attribute's string or the element's leaf."""
    f, out = part.field, []
    v = raw if f.kind != "element" else raw["v"]
    nil = F.lit(False) if f.kind != "element" else F.coalesce(raw["nil"], F.lit(False))
    if f.kind == "element":
        out.append(_issue(raw["v"].isNotNull() | nil, path, "content", "element content where a simple value belongs", "structural"))
        if not f.nillable:
            out.append(_issue(~nil, path, "nil", "is not nillable", "schema"))
    value = _lexical(part, v)
    for member, plan in _plans(part):
        other = value.isNull() if member is None else value.isNull() | ~raw["tag"].eqNullSafe(F.lit(member or None))
        made = []
        for code, test, message in plan.checks():
            channel = "lexical" if code in ("lexical", "pattern", "enumeration") else "schema"
            made.append(_issue(other | test(value), path, code, message, channel))
        usual = plan.usual(value)
        if usual is not None:  # one test for all
            ok = F.coalesce(usual, F.lit(False)) | _all_ok(made)
            made = [_sound(x, F.lit(True) if k else ok) for k, x in enumerate(made)]
        out += made
    if f.fixed is not None:
        out.append(_issue(value.isNull() | part.slot.simple.same(value, f.fixed), path, "fixed", f"must be {f.fixed}", "schema"))
    return out


def _flat(slot: Slot) -> bool:
    """Whether a leaf, or an object of one shape with single leaves alone."""
    return slot.kind == "leaf" or (slot.kind == "object" and len(slot.shapes) == 1 and all(not p.repeated and p.slot.kind == "leaf" for p in slot.shapes[0].parts))


def _plans(part: Part) -> list[tuple[str | None, SimplePlan]]:
    """The types that a leaf may have: by substituted tag, where they differ (empty: the head)."""
    tags = part.slot.leaf_tags
    if len({plan.name for _, plan in tags}) < 2:
        return [(None, part.slot.simple)]
    return [(m, plan) for m, plan in tags[:-1]] + [("", tags[-1][1])]


def _part_issues(part: Part, raw: Column, path: str) -> list[Column]:
    """Arrays of violations of one field of an object."""
    f, here, out = part.field, f"{path}/{part.column}", []
    if part.slot.kind == "absent":  # no document has it
        if not part.required:
            return []
        code, said = ("min-occurs", f"expected array to have >={f.card.least} items") if part.repeated else ("required", f"expected {f.kind} {f.key}")
        return [_list([_issue(F.lit(False), here, code, said, "schema")])]
    value = raw[part.column]
    if f.kind == "text":
        return [_list(_leaf_issues(part, value, path))] if not _empty(part) else []
    if part.repeated:
        size, counts = F.coalesce(F.size(value), F.lit(0)), []
        if part.required:
            counts.append(_issue(size >= f.card.least, here, "min-occurs", f"expected array to have >={f.card.least} items", "schema"))
        if f.card.most is not None:
            counts.append(_issue(size <= f.card.most, here, "max-occurs", f"expected array to have <={f.card.most} items", "schema"))
        if counts:
            out.append(_list(counts))
        if part.slot.kind == "leaf":
            inner = lambda x: _list(_leaf_issues(part, x, here))
        elif part.slot.kind == "object":
            inner = lambda x: issues(part.slot, x, here, f.nillable)
        else:
            return out
        every = F.flatten(F.transform(value, inner))
        out.append(F.when(F.forall(value, lambda x: inner(x).ok), F.array()).otherwise(every) if _flat(part.slot) else every)
        return out
    if part.required and not (f.kind == "attribute" and (f.fixed is not None or f.default is not None)):
        out.append(_list([_issue(value.isNotNull(), here, "required", f"expected {f.kind} {f.key}", "schema")]))
    if part.slot.kind == "object":
        out.append(issues(part.slot, value, here, f.nillable))
    elif part.slot.kind == "leaf":
        found = _leaf_issues(part, value, here)
        if found and f.kind == "element":
            ok = _all_ok(found)
            out.append(_sound(F.when(value.isNotNull(), _list(found)), None if ok is None else value.isNull() | ok))
        elif found:
            out.append(_list(found))
    return out


def _empty(part: Part) -> bool:
    return not part.slot.simple.checks() and part.field.fixed is None


def _shape_issues(shape: Shape, raw: Column, path: str) -> Column:
    out = [x for part in shape.parts for x in _part_issues(part, raw, path)]
    columns = {p.field: p for p in shape.parts}

    def has(f: Field) -> Column:
        part = columns[f]
        if part.slot.kind == "absent":
            return F.lit(False)
        value = raw[part.column]
        return F.coalesce(F.size(value) > 0, F.lit(False)) if part.repeated else value.isNotNull()

    fields = [p.field for p in shape.parts if p.field.kind == "element"]
    checks = [_issue(ok, path, "choice", message, "schema") for ok, message in choice.checks(shape.type, fields, has)]
    if checks:
        out.append(_list(checks))
    none = F.array().cast(f"array<{ISSUE}>")
    return _sound(F.concat(*(F.coalesce(x, none) for x in out)), _all_ok(out)) if out else _sound(none, F.lit(True))


def issues(slot: Slot, raw: Column, path: str, nillable: bool = True) -> Column:
    """All violations below a raw slot, an empty array if there are none."""
    none = F.array().cast(f"array<{ISSUE}>")
    if slot.kind != "object":
        return none
    nil = F.coalesce(raw["_nil"], F.lit(False))
    if len(slot.shapes) == 1:
        found = _shape_issues(slot.shapes[0], raw, path)
    else:
        which = F.coalesce(raw["_shape"], F.lit(0))
        found = none
        for k, shape in enumerate(slot.shapes):
            found = F.when(which == k, _shape_issues(shape, raw, path)).otherwise(found)
    ok = getattr(found, "ok", None)
    if nillable:
        return _sound(F.when(raw.isNotNull() & ~nil, found).otherwise(none), None if ok is None else raw.isNull() | nil | ok)
    bad = _list([_issue(~nil, path, "nil", "is not nillable", "schema")])
    return _sound(F.when(raw.isNull(), none).when(nil, bad).otherwise(found), None if ok is None else raw.isNull() | (~nil & ok))


def document_issues(slot: Slot, result: Column, root: str, nillable: bool) -> Column:
    """All violations of a shredded {doc, error}."""
    error = F.struct(
        F.lit(f"/{root}").alias("path"), F.substring_index(result["error"], ":", 1).alias("code"), result["error"].alias("message"), F.lit("structural").alias("channel")
    )
    if slot.kind == "leaf":
        part = Part(Field("element", root, "", nillable=nillable), root, slot, [root])
        found = F.when(result["doc"].isNotNull(), _list(_leaf_issues(part, result["doc"], f"/{root}")))
    else:
        found = issues(slot, result["doc"], f"/{root}", nillable)
    none = F.array().cast(f"array<{ISSUE}>")
    return F.when(result["error"].isNotNull(), F.array(error)).otherwise(F.coalesce(found, none))
