import hashlib
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from xsdframe.llm import bpe_ac, token_orc
from xsdframe.llm.common import fresh_path

ROWS = [(3, "Some words, here's   one.", 1), (1, None, 2), (2, "", 3), (3, "Some words, here's   one.", 1), (7, "é\n\n 😀 zz" * 300, 9), (None, "null id", 0), (9, " \t", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string, Text long")
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return made, real


@pytest.mark.parametrize("k", [0, 1])
def test_orc_files(spark, docs, k):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = [(r[0], r[1] or "") for r in docs[k].collect()]
    rows.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    want, start = [], 0
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = fresh_path(spark, "orc")
    token_orc.write(docs[k], path, P.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, token_orc.digest(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    some = token_orc.read(spark, path).where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in some._jdf.queryExecution().toString() and some.count() == 1


def fields(data):
    """A protocol buffer message as {field: [values]}."""
    out, at = {}, 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        elif key & 7 == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        out.setdefault(key >> 3, []).append(value)
    return out


def test_orc_metadata(spark):
    """A file's own metadata: several stripes, row indexes, Bloom filters on doc_id alone, and
    run-length encoding of version 2; and a reader that skips what they exclude."""
    import glob

    rows = [(2 * k, f"some words of document {k} " * 8) for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = fresh_path(spark, "orc")
    token_orc.write(docs.repartition(1), path, P.path("byte_bpe_50k.json"), stripe_bytes=1 << 18, compression="none")
    found = {"stripes": 0, "files": 0}
    for name in glob.glob(f"{path}/part-*.orc"):
        data = open(name, "rb").read()
        post = fields(data[-1 - data[-1] : -1])
        footer = fields(data[-1 - data[-1] - post[1][0] : -1 - data[-1]])
        assert footer[8][0] == 1000  # rows of an index entry
        found["files"] += 1
        for stripe in map(fields, footer[3]):
            found["stripes"] += 1
            begin = stripe[1][0] + stripe[2][0] + stripe[3][0]
            inside = fields(data[begin : begin + stripe[4][0]])
            streams = [(f.get(1, [0])[0], f.get(2, [0])[0]) for f in map(fields, inside[1])]  # kind, column
            assert {c for k, c in streams if k == 6} == {0, 1, 2, 3, 4, 5}  # row indexes
            assert {c for k, c in streams if k in (7, 8)} == {1}  # Bloom filters: doc_id
            assert [fields(e).get(1, [0])[0] for e in inside[2]][1:] == [2, 2, 2, 2, 2]  # direct, version 2
    assert found["stripes"] > found["files"]

    def rows_read(df):
        n = len(df.collect())
        return n, df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    n, read = rows_read(token_orc.read(spark, path).where("doc_id = 20000"))
    assert n == 1 and read <= 2000  # by row groups' least and largest ids
    n, read = rows_read(token_orc.read(spark, path).where("doc_id = 20001"))
    assert n == 0 and read == 0  # in the range of a row group, but not in its Bloom filter


def test_orc_empty(spark, docs):
    path = fresh_path(spark, "orc")
    token_orc.write(docs[0].limit(0), path, P.path("byte_bpe_50k.json"))
    assert token_orc.digest(spark, path).count() == 0


@pytest.mark.parametrize("k", [0, 1])
def test_bpe_same_as_tiktoken(spark, docs, k):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_ac.load_ranks(path), special_tokens={})
    want = []
    for r in docs[k].collect():
        ids = enc.encode_ordinary(r[1] or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, bpe_ac.digest(docs[k], path, P.PATTERN).collect()), key=key) == sorted(want, key=key)
    back = bpe_ac.decode(bpe_ac.encode(docs[k], path, P.PATTERN), path, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r[1] or "").encode() for r in docs[k].collect())


def test_bpe_on_random_bytes():
    import random

    import tiktoken

    ranks = bpe_ac.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    bpe, rnd = bpe_ac.AhoBpe(ranks), random.Random(3)
    for k in range(3000):
        s = "".join(rnd.choice("abcdeinorst ionEÄé中0 \n") for _ in range(rnd.randint(1, 60)))
        assert bpe.encode(s.encode()) == enc.encode_ordinary(s)
    assert bpe.encode(b"a" * 20_000) == enc.encode_ordinary("a" * 20_000)
