import random

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from xsdframe.llm.spans import SpanEncoder, cut, tokenizer_encoder

ODD = [
    "", None, " ", "  ", "\n\n", "a", "it's we're I'll 'tis ''s 's's 'llama don'T", " 's 't", "x  y", "x \n y\n\nz ", "tab\t's",
    "1234 5'd 6'", "é É ñ ß", "emoji 😀 here", " nbsp em", "\x1c fs \x85 nel", "é combining", "İstanbul ΣΑΣ", "<|endoftext|> x",
    "中文 字 12３", "a'", "'", "' s", "$$$'s ### %%%", "x" * 50, "don't stop'", "\r\n a\r\n\r\nb", "Ⅷ ² ½", "' 're've",
]


@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_same_ids_as_the_library(name, lower):
    import pyarrow.parquet as pq

    tok = Tokenizer.from_file(P.path(name))
    tok.encode_special_tokens = True
    enc = tokenizer_encoder(P.path(name), lower)
    rnd = random.Random(1)
    made = ["".join(rnd.choice(" \t\nab'slvret.,19é$") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    texts = ODD + made + pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    ids, counts = enc.encode(texts)
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t
        at += n
    assert at == len(ids)


def test_long_texts_are_cut_where_tokens_start():
    text = "word " * 3000 + "x" * 500 + " 's y" * 900
    assert "".join(cut(text, 100)) == text and len(cut(text, 100)) > 100
    assert cut("y" * 1000, 100) == ["y" * 1000]


def test_memory_is_bounded():
    enc = SpanEncoder(lambda ws: [[len(w)] for w in ws], lambda t: [], most=10)
    for k in range(30):
        ids, n = enc.encode([f"{'a' * k}b c d e"])
        assert ids.tolist() == [k + 1, 2, 2, 2] and len(enc.known) <= 10
