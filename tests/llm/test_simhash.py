import random
import re

import pytest
import xxhash

from xsdframe.llm import simhash
from xsdframe.llm.graph import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hs = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_matches_plain():
    for t in ["", None, " \t", "One", "one two", "A b  C\nd É é", "x " * 50, "a b c a b c a b c d"]:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = plain_components(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in fp.items()}
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("hot", [0, 3, 32])
def test_links_reach_the_same_whatever_the_bucket_limit(spark, hot):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(4):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                g ^= 1 << b
            fps.add(g)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.label for r in components(simhash.links(classes, hot)).collect()}
    want = plain_components(signed, lambda i, j: ((i ^ j) & (1 << 64) - 1).bit_count() <= 2)
    assert {i: got.get(i, i) for i in signed} == want


def test_odd_rows(spark):
    rows = [(5, None, 1), (2, "", 2), (7, "   ", 3), (2, "", 2), (None, "alone here in this row", 4), (9, "a b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT long")
    got = sorted(((r.doc_id or -1), r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, False, None), (2, True, 2), (2, True, 2), (5, True, 2), (7, True, 2), (9, False, 9)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.deduplicated(df)  # TEXT beside text
    assert kept.columns == ["doc_id", "text", "TEXT"] and sorted(((r[0] or -1), r[2]) for r in kept.collect()) == [(-1, 4), (2, 2), (9, 5)]
    assert simhash.deduplicated(df.limit(0)).count() == 0


def test_repeated_ids(spark):
    """Rows that share an id are told apart by their texts; of equal rows one stays."""
    a, b, c = "one two three four five", "six seven eight nine ten", "One  two three four FIVE"
    rows = [(5, a, 1), (2, b, 2), (5, b, 3), (7, a, 4), (7, a, 5), (3, c, 6), (3, a, 7), (8, None, 8), (8, "", 9), (9, None, 10), (2, b, 2), (None, b, 11), (None, b, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = [tuple(r) for r in simhash.deduplicated(df).collect()]
    assert sorted(r[0] or -1 for r in got) == [-1, -1, 2, 3, 8]
    assert (2, b, 2) in got and [r[1] in (a, c) for r in got if r[0] == 3] == [True]


def test_chain_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(e).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
