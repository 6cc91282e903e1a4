import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from xsdframe.llm import packing


def test_hilbert_walks_to_neighbours_and_meets_every_cell():
    for dims, bits in [(2, 4), (3, 2), (4, 2)]:
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = packing.hilbert_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check(rows, texts, length):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    assert by_doc.keys() == want.keys()
    for i, docs in want.items():
        if len(docs) > 1:
            assert sum(r.length for r in by_doc[i]) == sum(map(len, docs))
            continue
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            ids = docs[0][at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(docs[0]), zlib.crc32(np.array(ids, "<u4").tobytes()))
            if "ids" in r:
                assert r.ids == ids
            at += r.length
        assert at == len(docs[0])
    for s, parts in by_seq.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or s == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


@pytest.mark.parametrize("length,per_range", [(4096, 1 << 18), (64, 2000)])
def test_documents(spark, monkeypatch, length, per_range):
    monkeypatch.setattr(packing, "LEAST_IDS", per_range)
    monkeypatch.setattr(packing, "MOST_IDS", 2 * per_range)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), length=length, with_ids=True).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], length)


def test_odd_rows(spark):
    data = [(1, None, 0), (2, "", 0), (3, "x", 0), (3, "x", 0), (None, "y z", 0), (5, "a long one " * 900, 0)] + [(k, "same text here", 0) for k in range(10, 60)]
    df = spark.createDataFrame(data, "doc_id long, text string, DOC_ID long")
    check(packing.pack(df, P.path("word_bpe_49k.json"), length=128).collect(), [d[:2] for d in data], 128)
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_neighbours_are_alike(spark):
    words = ["red green blue " * 30, "one two three four " * 30, "cat dog cow hen " * 30]
    df = spark.createDataFrame([(k, words[k % 3]) for k in range(90)], "doc_id long, text string")
    rows = packing.pack(df, P.path("word_bpe_49k.json"), length=256).collect()
    order = [r.doc_id % 3 for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) == 2


def test_ranges_are_bounded():
    """A range has at most about 32 million ids, however many there are; small inputs have few ranges."""
    for total in (0, 1, 10**6, 10**9, 10**13):
        n = packing.ranges_for(total, 200)
        assert total / n <= packing.MOST_IDS and (n == 1 or total / n >= packing.LEAST_IDS)


def test_ranges_are_dealt_evenly(spark):
    """Hashing puts the codes of ranges into partitions in turn."""
    for ranges, parts in ((4, 4), (37, 12), (1, 8), (200, 200)):
        codes = packing.range_codes(spark, ranges, parts)
        df = spark.createDataFrame([(int(c),) for c in codes], "c int").repartition(parts, "c").groupBy(packing.F.spark_partition_id()).count()
        n = [r["count"] for r in df.collect()]
        assert len(set(codes.tolist())) == ranges and len(n) == min(ranges, parts) and max(n) <= -(-ranges // parts)
