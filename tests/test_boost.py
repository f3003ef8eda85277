"""Boosted trees against a single-table version that sorts nothing into histograms by task."""

import math

import numpy as np
import pytest

from paddock.operators import boost as B, models as MD


def grow(x, y, depth, rate, trees, lam=1.0, min_child=1.0):
    """Plain recursion over rows; x holds bins. Returns margins after every tree."""
    base = math.log(y.sum() / (len(y) - y.sum()))
    score, out = np.full(len(y), base), []

    def node(rows, g, h, level, add):
        total = (g[rows].sum(), h[rows].sum())
        best, gain_of = None, lambda s: s[0] ** 2 / (s[1] + lam)
        if level < depth and total[1] >= 2 * min_child:
            for f in range(x.shape[1]):
                for cut in range(x.max() + 1):
                    right = x[rows, f] > cut
                    a, b = rows[~right], rows[right]
                    left, rest = (g[a].sum(), h[a].sum()), (g[b].sum(), h[b].sum())
                    if left[1] >= min_child and rest[1] >= min_child:
                        gain = gain_of(left) + gain_of(rest) - gain_of(total)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9 * abs(gain)):
                            best = (gain, a, b)
        if best is None:
            add[rows] = -total[0] / (total[1] + lam)
        else:
            node(best[1], g, h, level + 1, add)
            node(best[2], g, h, level + 1, add)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        add = np.zeros(len(y))
        node(np.arange(len(y)), p - y, p * (1 - p), 0, add)
        score = score + rate * add
        out.append(score.copy())
    return out


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "id int, f array<double>, y int").repartition(5)


def losses(score, y):
    p = 1 / (1 + np.exp(-score))
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


@pytest.mark.parametrize("flat,cells", [(16, 200_000), (1, 0)])
def test_equal_to_one_table(spark, monkeypatch, flat, cells):
    monkeypatch.setattr(B, "_FLAT", flat)
    monkeypatch.setattr(B, "PAIR_CELLS", cells)
    monkeypatch.setattr(B, "KEEP", 2)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 2, (400, 4)), rng.integers(0, 6, (400, 2))], axis=1)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 1.5 * x[:, 1] * x[:, 4] / 3 + 0.4 * x[:, 5] - 1)))).astype(int)
    df = table(spark, x, y)
    shapes = [(6, 2, 0.3), (4, 3, 0.1), (3, 5, 0.5)]
    models = B.fit_boosted(df, "f", "y", shapes)
    for model, (trees, depth, rate) in zip(models, shapes):
        want = grow(x, y, depth, rate, trees)
        got = {r["id"]: r["p"] for r in model.predict_proba(df, "f", "p").collect()}
        assert np.allclose([got[k] for k in range(400)], 1 / (1 + np.exp(-want[-1])), atol=1e-10)
        found = B.prefix_losses(df, "f", "y", [model], [1, trees])
        assert found[0, 1] == pytest.approx(losses(want[0], y)) and found[0, trees] == pytest.approx(losses(want[-1], y))


def test_grid_finds_the_best_point_and_ends(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (600, 5))
    y = (rng.random(600) < np.where(x[:, 0] ^ x[:, 1], 0.8, 0.2)).astype(int)
    df = table(spark, x, y)
    train, val = df.where("id < 400"), df.where("id >= 400")
    grid = {"maxIter": [2, 8], "maxDepth": [1, 2], "stepSize": [0.05, 0.5]}
    model, best, results = B.grid_search(train, val, "f", "y", grid)
    want = {}
    for depth in (1, 2):
        for rate in (0.05, 0.5):
            m = B.fit_boosted(train, "f", "y", [(8, depth, rate)])[0]
            for n in (2, 8):
                want[n, depth, rate] = B.prefix_losses(val, "f", "y", [m], [n])[0, n]
    assert {(p["maxIter"], p["maxDepth"], p["stepSize"]): pytest.approx(v) for p, v in results} == want
    assert want[best["maxIter"], best["maxDepth"], best["stepSize"]] == pytest.approx(min(want.values())) and len(model.trees) == best["maxIter"]
    union, _, _ = B.grid_search(train, val, "f", "y", {"maxIter": [2], "maxDepth": [1], "stepSize": [0.5]}, refit_on_union=True)
    assert union.base == pytest.approx(math.log(y.sum() / (600 - y.sum())))


def test_continuous_missing_and_constant_features(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, [float(v), None if k % 7 == 0 else float(v * v), 1.0], int(v > 0.3)) for k, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame([*rows, (999, [0.0, 0.0, 1.0], None)], "id int, f array<double>, y int")
    cuts = B.feature_cuts(df, "f")
    assert cuts[2] == [] and 0 < len(cuts[0]) < B.MAX_BINS
    model = B.fit_boosted(df, "f", "y", [(20, 2, 0.3)])[0]
    scored = model.predict_proba(df, "f", "p")
    got = {r["id"]: r["p"] for r in scored.collect()}
    assert np.mean([(got[k] > 0.5) == bool(t) for k, _, t in rows]) > 0.95 and 0 < got[999] < 1
    MD.save_model(model, str(tmp_path / "m"))
    again = {r["id"]: r["p"] for r in MD.load_model(str(tmp_path / "m")).predict_proba(df, "f", "p").collect()}
    assert again == got


def test_no_features_and_one_class(spark):
    df = spark.createDataFrame([(k, [], k % 4 // 3) for k in range(40)], "id int, f array<double>, y int")
    model = B.fit_boosted(df, "f", "y", [(3, 2, 0.1)])[0]
    assert all(r["p"] == pytest.approx(0.25) for r in model.predict_proba(df, "f", "p").collect())
    with pytest.raises(ValueError):
        B.fit_boosted(df.where("y = 1"), "f", "y", [(3, 2, 0.1)])
