"""SimHash near-duplicates by multi-index hashing.

Fingerprints: A-Z of the whole text are lower-cased, words are runs of anything
but ASCII white space, shingles are 3 words joined by one space (fewer words:
the whole sequence), repeats included. A bit of the fingerprint is 1 if it is
set in over half of the shingles' XXH64 (seed 42). Texts that are null, empty or
only white space have no shingle and the fingerprint zero.

Search: fingerprints are cut into two segments of 32 bits. If two of them differ
in 2 bits at most, either the upper segments differ in 1 bit at most, or the
lower ones are equal. So the index has one table for each segment; the upper
table is probed with the whole Hamming ball of radius 1, the lower one with the
segment itself, and complete distances are verified. Of the two fingerprints of
a pair whose upper segments differ in one bit, one has that bit set, so clearing
each set bit (16 on average, not 32) already finds every pair once.

A table's bucket with more than HOT fingerprints (a large group of near copies)
would make pairs with the square of its size. Those fingerprints are linked
exactly another way: two fingerprints are within 2 bits if and only if the balls
of radius 1 around them share a point, and a point is in 65 balls at most, so
grouping the ball points links them through groups of 65 at most.

Equal fingerprints are one class throughout; copies are never expanded to pairs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_slices, materialise, named_by_place, pick
from .graph import components

#: Fingerprints of one segment value that are compared pair by pair.
HOT = 32
SEED, WORDS = 42, 3


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of UTF-8 bytes, unsigned."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - WORDS + 1)
    begins, ends = begins[:last].tolist(), ends[-last:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, last, 1 << 14):
        part = [digest(line[b:e], SEED) for b, e in zip(begins[k : k + (1 << 14)], ends[k : k + (1 << 14)])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", marks: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long; rows are kept as they are.
    marks: and two hashes of the text, h and g."""
    import numpy as np

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t.as_py()) for t in part.column(1)], np.uint64).view(np.int64)
        return pa.record_batch([part.column(0), pa.array(fp), *part.columns[2:]], ["doc_id", "fp", *part.schema.names[2:]])

    rows = pick(docs, id, text).toDF("doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *(_hashes("text") if marks else []))
    return map_slices(rows, "text", work, "doc_id long, fp long" + (", h long, g long" if marks else ""))


def _hashes(text: str) -> list[Column]:
    whole = F.col(text).cast("binary")
    return [F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(SEED), whole).alias("g")]


_UPPER, _LOWER = "shiftrightunsigned(fp, 32)", "fp & 4294967295"


def links(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp that differ in 2 bits
    at most. Pairs from buckets of up to `hot`; stars that reach the same fingerprints
    for the others. An empty table gives none."""
    fps = classes.select("fp")
    tables = fps.select("fp", F.expr(f"explode(array(struct(0 AS seg, {_UPPER} AS val), struct(1 AS seg, {_LOWER} AS val)))").alias("t"))
    index = tables.select("t.seg", "t.val", "fp")
    cleared = F.expr(
        f"explode(concat(array(struct(0 AS seg, {_UPPER} AS val, false AS moved), struct(1 AS seg, {_LOWER} AS val, false AS moved)),"
        f" transform(filter(sequence(0, 31), k -> shiftright({_UPPER}, k) & 1 = 1),"
        f" k -> struct(0 AS seg, {_UPPER} - shiftleft(1L, k) AS val, true AS moved))))"
    )
    probes = fps.select("fp", cleared.alias("t")).select("t.seg", "t.val", "t.moved", F.col("fp").alias("p"))
    crowded = index.groupBy("seg", "val").count().where(F.col("count") > hot).select("seg", "val")

    few = index.join(crowded, ["seg", "val"], "left_anti")
    pairs = (
        few.join(probes, ["seg", "val"])
        .where("fp <> p AND (moved OR fp < p) AND bit_count(fp ^ p) <= 2")
        .select(F.col("fp").alias("a"), F.col("p").alias("b"))
    )
    many = (
        index.join(crowded, ["seg", "val"], "left_semi").select("fp")
        .unionByName(probes.join(crowded, ["seg", "val"], "left_semi").select(F.col("p").alias("fp")))
        .distinct()
    )
    ball = F.expr("explode(concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k))))")
    stars = (
        many.select("fp", ball.alias("point")).groupBy("point").agg(F.collect_set("fp").alias("near"))
        .where("size(near) > 1")
        .select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    )
    return pairs.unionByName(stars)


def _components(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of each fingerprint in rows."""
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    reach = components(links(classes))
    member = classes.join(reach, classes.fp == reach.node)
    smallest = member.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = reach.join(smallest, "label").select(F.col("node").alias("fp"), "component_id")
    of_class = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    of_class = materialise(of_class, "simhash-components")  # so both sides of the join to rows are shuffled, and a hot class can be split
    discard(classes)
    return of_class


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: 16 lowercase hex digits, and the
    smallest doc_id that links reach, the row's own class included.

    Repeated rows come out as often as they came in; null doc_ids never name a
    component (a component of null doc_ids only has a null component_id); an empty
    table gives an empty result.
    """
    rows = materialise(fingerprints(docs, text, id), "simhash")
    return rows.join(_components(rows), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One document of each group of near copies, all columns kept: a row that has the group's
    smallest doc_id, of several with different texts the one with the smallest hash.

    Rows that repeat a doc_id with other texts are documents of their own; of those that
    repeat both id and text one stays. Rows with a null doc_id are kept, as nothing can name
    them. Null, empty and blank texts are one group. Other columns may have any names and
    nulls; an empty table gives an empty one. Decisions are made on ids, fingerprints and
    hashes; texts are shuffled once at most, to meet them.
    """
    rows = materialise(fingerprints(docs, text, id, True), "simhash")
    named = rows.join(_components(rows), "fp").where("doc_id = component_id")
    times = named.groupBy("doc_id", "h", "g").count()
    kept = times.groupBy("doc_id").agg(F.min(F.struct("h", "g", "count")).alias("one"))
    kept = materialise(kept.select(F.col("doc_id").alias("_id"), "one.h", "one.g", "one.count"), "simhash-kept")
    names = docs.columns
    plain = named_by_place(docs)
    own, body = f"_c{names.index(id)}", f"_c{names.index(text)}"
    hashed = plain.select("*", F.col(own).cast("long").alias("_id"), *_hashes(body))
    by = ["_id", "h", "g"]
    out = hashed.join(kept.where("count = 1"), by, "left_semi").select(plain.columns)
    if kept.where("count > 1").take(1):
        repeated = hashed.join(kept.where("count > 1"), by, "left_semi").dropDuplicates(by)
        out = out.unionByName(repeated.select(plain.columns))
    return out.unionByName(plain.where(F.col(own).cast("long").isNull())).toDF(*names)
