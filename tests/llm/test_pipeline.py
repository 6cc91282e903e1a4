from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_langid import plain_grams, plain_sets, plain_shares
from test_quality import plain_score
from test_simhash import plain_components, plain_fingerprint

from xsdframe.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    """Each stage's decisions, held against loops over strings, sets and bytes. Filters have
    false positives and scores are rounded, so documents at a threshold may go either way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality", "near_dedup", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    sets = plain_sets([(i, r.text, r.lang) for i, r in rows.items()])
    share = {i: max(plain_shares(r.text, sets).values()) if plain_grams(r.text) else 0 for i, r in rows.items()}
    got = corpus_pipeline.language_id(spark, docs, SF)
    first = {r.doc_id for r in got.collect()}
    unsure = {i for i, s in share.items() if abs(s - corpus_pipeline.LEAST_SHARE) < 0.03}
    assert got.columns == docs.columns and first - unsure == {i for i, s in share.items() if s >= corpus_pipeline.LEAST_SHARE} - unsure

    kept = docs.where(docs.doc_id.isin(sorted(first)))
    model = quality.fit(kept, labels)
    score = {i: plain_score(model, rows[i].text.encode()) for i in first}
    got = corpus_pipeline.quality_classifier(spark, kept, SF)
    second = {r.doc_id for r in got.collect()}
    unsure = {i for i, s in score.items() if abs(s - quality.THRESHOLD) < 1e-3}
    assert got.columns == docs.columns and second - unsure == {i for i, s in score.items() if s >= quality.THRESHOLD} - unsure

    fp = {i: plain_fingerprint(rows[i].text) for i in second}
    group = plain_components(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    third = {i for i, g in group.items() if i == g}
    got = corpus_pipeline.near_dedup(spark, kept.where(docs.doc_id.isin(sorted(second))), SF)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == third

    ids = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        ids[r.doc_id] += r.length
        assert r.length <= r.doc_tokens
    assert set(ids) == third


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows,
    and columns whose names clash with the documents' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clean = docs.where("length(text) > 400").first()
    long = " ".join([clean.text] * (2_000_000 // len(clean.text)))
    rows = [(9001, None, None, None, None), (9002, "", "en", "web", 0), (9003, " \n", "en", "web", 2), (9004, "12 34 !!", "en", None, 8), (9005, long, clean.lang, "web", len(long)),
            (9006, clean.text, clean.lang, "web", 1), (9006, clean.text, clean.lang, "web", 1), (None, clean.text, None, "web", 1)]
    whole = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    return whole.selectExpr("doc_id", "text", "lang", "source", "n_chars", "upper(source) AS TEXT", "lang AS Doc_Id", "n_chars AS lang"), clean


def test_stages_on_odd_documents(spark, odd):
    docs, clean = odd
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        kept = [r[0] for r in got.collect()]
        assert clean.doc_id in kept or stage is corpus_pipeline.near_dedup
        assert stage(spark, docs.limit(0), SF).count() == 0
    said = [r[0] for r in corpus_pipeline.language_id(spark, docs, SF).collect()]
    assert not {9001, 9002, 9003, 9004} & set(said) and said.count(9005) == 1 and said.count(9006) == 2 and said.count(None) == 1
    alone = [r[0] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert 9006 not in alone and {9001, 9004, 9005} <= set(alone) and not {9002, 9003} & set(alone) and alone.count(None) == 1
    pieces = corpus_pipeline.pack(spark, docs, SF)
    assert pieces.where("start = 0").count() == docs.count() and corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_run_leaves_only_its_result(spark, odd, monkeypatch):
    """Clashing names pass through the files between stages, whose folders go."""
    docs, _ = odd
    import os

    from xsdframe.llm import common

    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: docs if n == "documents" else common.table(s, d, n))
    before = set(os.listdir(common.shared_dir(spark)))
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0
    assert len(set(os.listdir(common.shared_dir(spark))) - before) == 1
