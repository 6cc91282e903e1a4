import unicodedata
import zlib
from collections import Counter

import numpy as np

from xsdframe.llm import langid


def test_filters_hold_their_grams():
    rnd = np.random.default_rng(0)
    sets = {name: rnd.integers(0, 1 << 63, 5000).astype(np.uint64) for name in "abc"}
    model = langid.Model.build(sets)
    for j, name in enumerate(sorted(sets)):
        mask = model.table[0][langid._places(sets[name], 0)]
        for k in range(1, langid.READS):
            mask &= model.table[0][langid._places(sets[name], k)]
        assert ((mask >> np.uint64(j)) & np.uint64(1)).all()
        other = rnd.integers(0, 1 << 63, 50_000).astype(np.uint64)
        mask = np.bitwise_and.reduce([model.table[0][langid._places(other, k)] for k in range(langid.READS)])
        assert abs(((mask >> np.uint64(j)) & np.uint64(1)).mean() - model.false_positive[j]) < 2e-3


def test_more_than_64_languages():
    sets = {f"l{k:03d}": langid.grams([f"w{chr(0x400 + k)}w{chr(0x500 + k)}x"])[0] for k in range(130)}
    model = langid.Model.build(sets)
    names, share = model.predict([f"w{chr(0x400 + k)}w{chr(0x500 + k)}x" for k in range(130)])
    assert names == sorted(sets) and share.min() > 0.99


def test_grams_of_odd_texts():
    h, owner, has = langid.grams([None, "", " \n", "a", "A", "12 !", "a  b", "a b", "\U00010400 x"])
    assert has.tolist() == [False] * 3 + [True] * 2 + [False] + [True] * 3
    by = {i: sorted(h[owner == i].tolist()) for i in range(9)}
    assert not by[0] and not by[5] and by[3] == by[4] != [] and by[6] == by[7]


def plain_grams(text):
    """The n-grams of one text, in order, as strings."""
    low = (text or "").lower()
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in low).split()
    line = f" {' '.join(words)}   "
    return [line[k : k + 4] for k in range(len(line) - 3) if line[k : k + 4].strip()] if words else []


def plain_sets(rows):
    """Each language's n-grams, learned with dictionaries from (doc_id, text, lang)."""
    counts = {}
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    shares = {lang: {g: n / c.total() for g, n in c.items() if n / c.total() >= langid.LEAST_SHARE} for lang, c in counts.items()}
    peak = Counter()
    for found in shares.values():
        for g, share in found.items():
            peak[g] = max(peak[g], share)
    return {lang: {g for g, share in found.items() if share >= langid.TYPICAL * peak[g]} for lang, found in shares.items()}


def plain_shares(text, sets):
    grams = plain_grams(text)
    return {lang: sum(g in own for g in grams) / max(1, len(grams)) for lang, own in sets.items()}


def test_against_sets_of_strings(spark):
    """The filters learn and count what dictionaries and sets do, but for false positives."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    sets = plain_sets(rows)
    model = langid.fit(docs)
    assert model.languages == sorted(sets)
    shares, has = model.shares([t for _, t, _ in rows])
    said = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for k, (i, text, _) in enumerate(rows):
        want = plain_shares(text, sets)
        assert has[k] == bool(plain_grams(text))
        assert all(abs(shares[k][j] - want[lang]) < 0.03 for j, lang in enumerate(model.languages))
        best = sorted(want.values())[-1]
        assert said[i].lang_pred == "und" if not has[k] else want[said[i].lang_pred] >= best - 0.06


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    right = sum(got[i].lang_pred == lang[i] for i in held) / len(held)
    print("held-out accuracy", right)
    assert right >= 0.97
    scores = sorted(r.score for r in got.values())
    print("lowest scores", scores[:10])


def test_rare_languages_are_learned(spark):
    rows = [(k, f"the cat sat there with number{k}", "en") for k in range(400)]
    rows += [(1000 + k, "der hund sitzt dort auf dem sofa", "de") for k in range(4)] + [(2000, "un chien dort ici", "fr"), (2001, "gatto nero", "it")]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert {r[2] for r in learned} == {"en", "de", "fr", "it"}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = langid._sampled(df, 20).collect()
    assert len(picked) == 26 and sum(r.lang == "en" for r in picked) == 20
    model = langid.fit(df, sample=20)
    assert model.languages == ["de", "en", "fr", "it"]
    texts = ["der hund sitzt dort auf dem sofa", "the cat sat there", "un chien dort ici", "gatto nero"]
    assert model.predict(texts)[0] == ["de", "en", "fr", "it"]


def test_odd_rows(spark):
    rows = [(1, None, "en", 0), (2, "", "en", 0), (3, "the 12", None, 0), (4, "the cat sat there", "en", 0), (5, "der hund sitzt dort", "de", 0), (None, "the cat", "en", 0), (4, "the cat sat there", "en", 0)]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, Lang int")
    model = langid.fit(df)
    got = sorted(((r.doc_id or -1), r.lang_pred) for r in langid.predict(df, model).collect())
    assert len(got) == 21 and (1, "und") in got and (2, "und") in got and (4, "en") in got and (5, "de") in got
    none = langid.fit(df.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, none).collect()} == {("und", 0.0)}
    assert langid.predict(df.limit(0), model).count() == 0
    clash = df.toDF("doc_id", "text", "TEXT", "text")  # names that differ by case, and one that occurs twice
    clean = langid.accepted(clash, model, 0.2)
    assert clean.columns == ["doc_id", "text", "TEXT", "text"]
    kept = sorted((r[0] or -1, r[1], r[2], r[3]) for r in clean.collect())
    assert kept == sorted((r[0] or -1, *r[1:]) for r in rows * 3 if r[0] in (None, 3, 4, 5))
    assert langid.accepted(clash.limit(0), model, 0.2).count() == 0
