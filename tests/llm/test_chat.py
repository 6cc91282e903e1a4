import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")

from xsdframe.llm import chat
from xsdframe.llm.queries import ORACLE_SQL

BITS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/TEXT]", "\\", "\\\\", "<", "[", " ", "\n", "é", "😀", "word ", "<<s>", "/s>"]


def test_any_text_comes_back():
    rnd = random.Random(2)
    for _ in range(2000):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "<s>[ROLE]"]), "".join(rnd.choices(BITS, k=rnd.randint(0, 9)))) for _ in range(rnd.randint(0, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_align_by_brute_force():
    rnd = random.Random(4)
    for _ in range(500):
        cuts = sorted(rnd.sample(range(60), 12))
        offsets = list(zip(cuts, cuts[1:]))
        if rnd.random() < 0.5:
            offsets.insert(4, offsets[4])  # two tokens of one character
        s = sorted(rnd.sample(range(60), 6))
        spans = [(s[0], s[1]), (s[2], s[2]), (s[3], s[5])]
        got = list(zip(*(x.tolist() for x in chat.align(offsets, spans)[1:])))
        want = [(k, max(a, x), min(b, y)) for x, y in spans for k, (a, b) in enumerate(offsets) if max(a, x) < min(b, y)]
        assert got == want
    assert len(chat.align([], [(0, 1)])[0]) == 0 == len(chat.align([(0, 1)], [])[0])


def test_offsets_are_those_of_the_library():
    """Ids and character spans of whole texts, special strings and split characters included."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rnd = random.Random(9)
    texts = ["".join(rnd.choices([*BITS, "don't", "12345", "𝔘", "日本語", "  ", "<|endoftext|>", "\u0301", "ß"], k=rnd.randint(0, 30))) for _ in range(400)]
    ids, count, offsets = chat.encode(texts, path)
    at = base = 0
    for text, n in zip(texts, count.tolist()):
        e = tok.encode(text, add_special_tokens=False)
        assert ids[at : at + n].tolist() == e.ids
        assert [(a - base, b - base) for a, b in offsets[at : at + n].tolist()] == e.offsets
        at, base = at + n, base + len(text)


def test_covered_counts_each_character_once():
    import numpy as np

    for parts in ([], [(1, 3), (3, 5)], [(0, 2), (1, 2), (1, 3), (6, 7)], [(2, 4), (2, 4)]):
        a, b = np.array(parts, np.int64).reshape(-1, 2).T
        marked = {k for x, y in parts for k in range(x, y)}
        assert chat.covered("abcdefgh", a, b) == "".join(c for k, c in enumerate("abcdefgh") if k in marked)


def plain(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "x"), (2, 3, "assistant", "é😀 <s>"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"),
            (3, 1, "assistant", "a"), (None, 0, "assistant", "n"), (4, 0, "tool", "long " * 40_000), (4, 1, "assistant", "中文" * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, TURN int")
    made = chat.format(df, P.path("byte_bpe_50k.json"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(made).collect()}
    assert got == plain(rows)
    assert chat.digest(chat.format(df.limit(0), P.path("byte_bpe_50k.json"))).count() == 0


def test_same_as_sql(spark):
    import duckdb

    df = chat.with_probe(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    got = chat.digest(chat.format(df, P.path("byte_bpe_50k.json"))).drop("n_tokens")
    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op6_chat_masks"])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_sql_counts_escapes(spark):
    import duckdb

    rows = [(1, 0, "user", "a\\b \\\\ [INST] <<SYS>> <</SYS>> </s> [/ROLE] [X] <t>"), (1, 1, "assistant", "\\<s>"), (1, 2, "tool", "é"), (2, 0, "system", "s")]
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.sql(ORACLE_SQL["op6_chat_masks"])
    df = chat.with_probe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.digest(chat.format(df, P.path("byte_bpe_50k.json")))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
