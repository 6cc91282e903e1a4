import numpy as np
import pyarrow as pa
import pytest

from test_simhash import plain_components

from xsdframe.llm import projections as pr


def brute(rows, threshold=0.95):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[k] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    near = lambda a, b: a in ok and b in ok and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold
    comp = plain_components(list(range(len(rows))), near)
    members = {}
    for k, c in comp.items():
        members.setdefault(c, []).append(rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        c = min((m for m in members[comp[k]] if m is not None), default=None)
        out.append((i, sum(near(k, j) for j in range(len(rows)) if j != k), c, i is not None and i == c))
    return sorted(out, key=str)


def test_calibration():
    width, least = pr.calibrated()
    rng = np.random.default_rng(1)
    d, lines = 64, pr._lines(64, pr.LISTS, 1)
    x = pr.unit(rng.standard_normal((20_000, d)))
    y = rng.standard_normal((20_000, d))
    y = pr.unit(y - (x * y).sum(1, keepdims=True) * x)
    z = 0.95 * x + np.sqrt(1 - 0.95**2) * y
    count = (np.abs((x - z) @ lines) <= width).sum(1)
    assert (count >= least).mean() > 0.999
    far = (np.abs((x - x[::-1]) @ lines) <= width).sum(1)
    assert (far >= least).mean() < 1e-3
    bits, tables = pr.layout(51_282)
    assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.999


@pytest.mark.parametrize("block", [2048, 7])
def test_planted_pairs(spark, block):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    for cos in (0.9501, 0.96, 0.99, 0.94):
        for k in range(20):
            u = pr.unit(base[k : k + 1])[0]
            w = rng.standard_normal(16)
            w -= (w @ u) * u
            w /= np.linalg.norm(w)
            rows.append((len(rows), ((cos * u + np.sqrt(1 - cos * cos) * w) * rng.uniform(0.1, 50)).tolist()))
    clique = base[0] * 3
    for _ in range(40):
        rows.append((len(rows), (clique + 0.05 * rng.standard_normal(16)).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pr.near_duplicates(df, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [None, 1.0, 1.0]), (6, [float("inf"), 0.0, 0.0]), (9, v), (8, v), (8, v),
            (None, v), (7, [2.0, 4.0, 6.0]), (10, [1.0, 2.0]), (None, [9.0, 0.0, 0.0]), (11, [-1.0, -2.0, -3.0]), (12, [1e-30, 2e-30, 3e-30])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, Embedding int")
    got = sorted(map(tuple, pr.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert pr.near_duplicates(df.limit(0)).count() == 0


def near_to(u, cos, rng):
    """Vectors at exactly this cosine from the unit vectors, up to rounding."""
    w = rng.standard_normal(u.shape)
    w = pr.unit(w - (w * u).sum(1, keepdims=True) * u)
    return cos * u + np.sqrt(1 - cos * cos) * w


def test_recall_against_brute_force(spark):
    """Every link of 24,000 vectors: pairs near the threshold, a large group of near copies
    whose cells are cut into chunks, exact copies, and vectors without any link."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((14_000, 32))
    pairs = [near_to(pr.unit(base[k : k + 1500]), cos, rng) for k, cos in zip(range(0, 9000, 1500), (0.9501, 0.952, 0.955, 0.96, 0.97, 0.99))]
    group = base[9_500] + 0.02 * rng.standard_normal((700, 32))
    copies = np.repeat(base[9_600:9_601], 300, 0)
    x = np.concatenate([base, *pairs, group, copies]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    assert len(x) == 24_000 and pr.layout(len(x))[0] == 8
    u = pr.unit(x)
    near = np.concatenate([u[k : k + 2000] @ u.T >= 0.95 for k in range(0, len(u), 2000)])
    np.fill_diagonal(near, False)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    rows = sorted(pr.near_duplicates(df.repartition(4), block=256).collect())
    found, all_ = np.array([r.n_links for r in rows]), near.sum(1)
    assert (found <= all_).all() and found.sum() >= 0.999 * all_.sum() and all_.sum() > 500_000
    loose = [k for k in range(len(x)) if 0 < all_[k] < 50]  # the planted pairs, whose cosine is near the threshold
    assert sum(found[k] for k in loose) >= 0.999 * sum(all_[k] for k in loose) and len(loose) > 15_000
    component = pr.stars(len(x), *np.nonzero(near))
    assert np.mean([r.component_id == component[k] for k, r in enumerate(rows)]) >= 0.999


@pytest.mark.parametrize("at_once", [1 << 22, 500])
def test_counted_collisions_are_those_of_all_pairs(monkeypatch, at_once):
    """Windows of sorted lists find the pairs that comparing all projections finds."""
    monkeypatch.setattr(pr, "AT_ONCE", at_once)
    p = np.random.default_rng(2).integers(0, 256, (70, 12)).astype(np.uint8)
    close = (np.abs(p[:, None].astype(int) - p[None]) <= 40).sum(2) >= 6
    for second in (np.zeros(70, bool), np.arange(70) % 3 == 0):
        other = second[:, None] != second[None] if second.any() else np.ones((70, 70), bool)
        want = {(i, j) for i, j in zip(*np.nonzero(close & other)) if i < j}
        got = list(zip(*(c.tolist() for c in pr.passing(p, second, 40, 6))))
        assert set(got) == want and len(got) == len(want) and len(want) > 50


def test_plan_ships_keys_and_bytes(spark):
    """The first pass shuffles no vector."""
    classes = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "key long, vec array<float>")
    crowded = spark.createDataFrame([], "dim int, cell long, parts long")
    found = pr.active(pr._blocks(pr._codes(classes, 4, 7, np.float32, False), crowded), 0.95)
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and "array" not in str(found.schema) and not any("vec" in line for line in shuffled)
