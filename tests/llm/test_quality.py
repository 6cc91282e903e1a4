import re

import numpy as np

from xsdframe.llm import quality as q


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    count = np.array([1, 3, 2])
    x, y = rng.standard_normal((6, q.WIDTH)), np.array([1.0, 0.0, 1.0])
    w = {"W": rng.standard_normal((q.WIDTH, 5)) * 0.1, "b": rng.standard_normal(5), "V": rng.standard_normal((5, 4)), "G": rng.standard_normal((5, 4)), "u": rng.standard_normal(4), "c": rng.standard_normal(5), "d": np.array(0.3)}
    model = q.Model(np.zeros(q.WIDTH), np.ones(q.WIDTH), w)
    loss = lambda: -np.mean(y * np.log((p := model.forward(x, count)["p"])) + (1 - y) * np.log(1 - p))
    got = model.gradient(x, count, y)
    for name in w:
        flat = w[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 7)):
            old = flat[k]
            flat[k] = old + 1e-6
            up = loss()
            flat[k] = old - 1e-6
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-6 - np.asarray(got[name]).reshape(-1)[k]) < 1e-5, name


def test_attention_weights_sum_to_one():
    x, count = q.passages([b"a b c " * 400, None, b"", b"x"])
    assert count.tolist() == [5, 1, 1, 1] and not x[5].any() and not x[6].any()
    model = q.learn(x, count, np.array([1.0, 0, 1, 0]))
    f = model.forward((x - model.mean) / model.scale, count)
    assert np.allclose(np.add.reduceat(f["a"], f["first"]), 1)


def test_repeated_words_show():
    x, _ = q.passages([b"one one one one two two", b"one two three four"])
    assert abs(x[0][q.KINDS + q.PAIRS] - 4 / 6) < 1e-6 and x[1][q.KINDS + q.PAIRS] == 0
    assert abs(x[0][q.KINDS + q.PAIRS + 1] - 2 / 6) < 1e-6 and x[1][q.KINDS + q.PAIRS + 1] == 1


def test_features_do_not_depend_on_neighbours():
    texts = [b"ab", b"c", None, b"ab", b"words of a passage " * 60, b"z"]
    together, _ = q.passages(texts)
    assert (together == np.vstack([q.passages([t])[0] for t in texts])).all()


def plain_passages(text):
    """Features of one text, passage by passage, in loops over bytes and words."""
    data, out = text or b"", []
    words = [(m.start(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    kind = lambda b: (
        6 if b > 127 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 if b == 32 else 4 if b == 10
        else 7 + [c for c in range(33, 127) if not chr(c).isalnum()].index(b) if 33 <= b < 127 else 5
    )
    for at in range(0, max(1, len(data)), q.PASSAGE):
        part = data[at : at + q.PASSAGE]
        kinds, pairs, last = np.zeros(q.KINDS), np.zeros(q.PAIRS), np.zeros(q.WORDS)
        for k, b in enumerate(part):
            kinds[kind(b)] += 1
            if at + k + 1 < len(data):
                pairs[(b * 31 + data[at + k + 1] * 17) % 8191 % q.PAIRS] += 1
        own = [(n, w) for n, (start, w) in enumerate(words) if at <= start < at + q.PASSAGE]
        if data:
            number = max(1, len(own))
            last[0] = sum(n > 0 and words[n - 1][1] == w for n, w in own) / number
            last[1] = len({w for _, w in own}) / number
            last[2] = np.log1p(sum(not (b == 32 or 9 <= b <= 13) for b in part) / number)
            last[3] = np.log1p(len(own))
        out.append(np.concatenate([np.sqrt(kinds / max(1, len(part))), np.sqrt(pairs / max(1, len(part))), last]))
    return np.array(out)


def plain_score(model, text):
    """The attention score of one text, passage by passage."""
    w, total, bag = model.weights, 0.0, []
    for x in plain_passages(text):
        h = np.maximum((x - model.mean) / model.scale @ w["W"] + w["b"], 0)
        bag.append((h, np.exp(w["u"] @ (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["G"])))))))
        total += bag[-1][1]
    z = sum(e / total * h for h, e in bag)
    return 1 / (1 + np.exp(-(w["c"] @ z + w["d"])))


def test_against_loops(spark):
    """Features and scores of every document of a table, held against one document at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = q.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    x, count = q.passages(list(texts.values()))
    assert np.allclose(x, np.vstack([plain_passages(t) for t in texts.values()]), atol=1e-5)
    for r in q.predict(docs, model).collect():
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-3


def test_learning_sample_is_bounded_by_passages(spark):
    """Long texts cannot make the driver's share grow: the sample ends where passages do."""
    rows = [(k, "word " * (5000 if k % 3 == 0 else 20)) for k in range(60)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    few = q.chosen(docs, labels, "text", "doc_id", "quality", 50, 100).collect()
    assert 0 < len(few) <= 50 and all(r.doc_id % 3 for r in few)  # 5000 words are 49 passages, over an eighth
    assert len(q.chosen(docs, labels, "text", "doc_id", "quality", 7, 1 << 17).collect()) == 7


def test_held_out_ranking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = q.fit(docs, labels)
    rows = q.predict(docs, model).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    area = auc(rows.score.to_numpy(), rows.quality.to_numpy())
    kept = rows[rows.quality == 1].predicted.mean()
    gone = 1 - rows[rows.quality == 0].predicted.mean()
    print(f"held-out area {area:.4f}, clean kept {kept:.4f}, junk rejected {gone:.4f}, {len(rows)} rows")
    assert area > 0.95 and kept > 0.98 and gone > 0.7


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "fine words here", 0), (3, "fine words here", 0), (None, "$$$ %%% $$$", 0), (4, "é " * 60_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT int")
    labels = spark.createDataFrame([(3, 1, None), (4, 0, 1), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = q.fit(df, labels)
    got = q.predict(df, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    empty = q.fit(df.limit(0), labels.limit(0))
    assert {r.score for r in q.predict(df, empty).collect()} == {0.5}
    assert q.predict(df.limit(0), model).count() == 0
    kept = q.accepted(df, empty)  # TEXT beside text
    assert kept.count() == 6 and kept.columns == ["doc_id", "text", "TEXT"] and q.accepted(df.limit(0), model).count() == 0
    some = {r[0] for r in q.accepted(df, model).collect()}
    assert some == {r.doc_id for r in got if r.predicted}
