import math

import numpy as np
from pyspark.sql import functions as F

from paddock.functions.stats import chi2_sf_1, normal_cdf, t_two_sided_p
from paddock.operators import choice as CH, embed as EM, isotonic as ISO, models as MD, stats as ST


def _scalar(spark, col):
    return spark.range(1).select(col.alias("o")).collect()[0]["o"]


def test_distribution_functions(spark):
    assert math.isclose(_scalar(spark, normal_cdf(F.lit(1.959963984540054))), 0.975, rel_tol=1e-9)
    assert math.isclose(_scalar(spark, chi2_sf_1(F.lit(3.841458820694124))), 0.05, rel_tol=1e-9)
    # two-sided Student t, 10 degrees of freedom, t = 2.228138851986274 -> 0.05
    assert math.isclose(_scalar(spark, t_two_sided_p(F.lit(2.228138851986274), F.lit(10))), 0.05, rel_tol=1e-7)


def test_yates_chi_square_2x2(spark):
    # table [[10, 20], [30, 15]]: Yates statistic by hand
    rows = [(1, 1)] * 10 + [(1, 0)] * 20 + [(0, 1)] * 30 + [(0, 0)] * 15
    n, a, b, c, d = 75, 10, 20, 30, 15
    want = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    df = spark.createDataFrame([(x, y) for x, y in rows], "x int, y int")
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
               F.sum(F.col("x") * F.col("y")).alias("sxy"))
    got = s.select(ST.yates_chi2(F.col("n"), F.col("sx"), F.col("sy"), F.col("sxy")).alias("c")).collect()[0]["c"]
    assert math.isclose(got, want, rel_tol=1e-12)


def test_paired_t_matches_formula(spark):
    a = [0.3, 0.5, 0.2, 0.9, 0.4]
    b = [0.1, 0.4, 0.3, 0.5, 0.2]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    r = ST.paired_t_test(df, "a", "b").collect()[0]
    d = np.array(a) - np.array(b)
    assert math.isclose(r["t_stat"], d.mean() / (d.std(ddof=1) / math.sqrt(len(d))), rel_tol=1e-12)


def test_conditional_logit_gradient_zero(spark):
    rng = np.random.default_rng(7)
    rows = []
    for r in range(300):
        n = int(rng.integers(2, 7))
        x = rng.normal(size=n)
        u = 0.8 * x
        w = int(rng.choice(n, p=np.exp(u) / np.exp(u).sum()))
        rows += [(r, i, float(x[i]), int(i == w)) for i in range(n)]
    df = spark.createDataFrame(rows, "race_id long, horse_id long, x double, is_winner int")
    fit = CH.fit_conditional_logit(df, ["x"])
    beta = float(fit.params[0])
    # score equation: sum over races of x_winner - E_p[x]
    g = 0.0
    races = {}
    for r, i, x, y in rows:
        races.setdefault(r, []).append((x, y))
    for xs in races.values():
        xv = np.array([x for x, _ in xs])
        p = np.exp(beta * xv) / np.exp(beta * xv).sum()
        g += sum(x for x, y in xs if y) - (p * xv).sum()
    assert abs(g) < 1e-6


def test_bernoulli_nb_against_hand_fit(spark):
    rows = [([1, 0], 1), ([1, 1], 1), ([0, 1], 0), ([0, 0], 0), ([0, 1], 0), ([1, 0], 0)]
    df = spark.createDataFrame(rows, "f array<int>, y int")
    nb = MD.fit_bernoulli_nb(df, "f", "y")
    # class 1: n=2, feature0 ones=2, feature1 ones=1; class 0: n=4, ones 1 and 2
    t1 = [(2 + 1) / (2 + 2), (1 + 1) / (2 + 2)]
    t0 = [(1 + 1) / (4 + 2), (2 + 1) / (4 + 2)]
    x = [1, 0]
    j1 = math.log(2 / 6) + sum(math.log(t if v else 1 - t) for t, v in zip(t1, x))
    j0 = math.log(4 / 6) + sum(math.log(t if v else 1 - t) for t, v in zip(t0, x))
    want = math.exp(j1) / (math.exp(j0) + math.exp(j1))
    got = spark.createDataFrame([(x,)], "f array<int>").select(nb.predict_proba(F.col("f")).alias("p")).collect()[0]["p"]
    assert math.isclose(got, want, rel_tol=1e-12)


def test_isotonic_is_monotone(spark):
    rows = [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 0), (0.5, 1), (0.6, 1), (0.7, 0), (0.8, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    iso = ISO.fit_isotonic(df, "p", "y")
    out = [r["c"] for r in ISO.calibrate(iso, df, "p", "c").orderBy("p").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(out, out[1:]))


def test_encoder_padding_mask(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a"), (3, None)], "doc_id long, text string").coalesce(1)
    masked = {r["doc_id"]: r["embedding"] for r in EM.encode_texts(df, batch_size=8).collect()}
    solo = {r["doc_id"]: r["embedding"] for r in EM.encode_texts(df.filter("doc_id = 2"), batch_size=8).collect()}
    assert np.allclose(masked[2], solo[2])          # masked mean does not depend on the batch
    assert masked[3] is None
    padded = {r["doc_id"]: r["embedding"] for r in EM.encode_texts(df, batch_size=8, include_padding=True).collect()}
    assert not np.allclose(padded[2], masked[2])    # reference mode: padding enters the mean


def test_conditional_logit_dead_heats_match_subset_enumeration(spark):
    """Races with tied winners: the fitted beta zeroes the exact score computed by
    enumerating every k-subset of runners."""
    import itertools

    rng = np.random.default_rng(11)
    rows, races = [], []
    for r in range(120):
        n = int(rng.integers(3, 7))
        x = rng.normal(size=(n, 2))
        k = 1 if r % 3 else int(rng.integers(2, n))
        winners = set(rng.choice(n, size=k, replace=False).tolist())
        rows += [(r, i, float(x[i, 0]), float(x[i, 1]), int(i in winners)) for i in range(n)]
        races.append((x, winners))
    df = spark.createDataFrame(rows, "race_id long, horse_id long, a double, b double, is_winner int")
    fit = CH.fit_conditional_logit(df, ["a", "b"])
    beta = np.array(fit.params, dtype=float)

    def score(bv):
        g = np.zeros(2)
        for x, winners in races:
            w = np.exp(x @ bv)
            k = len(winners)
            subs = list(itertools.combinations(range(len(w)), k))
            ws = np.array([np.prod(w[list(c)]) for c in subs])
            xs = np.array([x[list(c)].sum(axis=0) for c in subs])
            g += x[list(winners)].sum(axis=0) - (ws[:, None] * xs).sum(axis=0) / ws.sum()
        return g

    assert np.max(np.abs(score(beta))) < 1e-6


def test_dead_heats_of_any_size_match_dynamic_programming(spark, monkeypatch):
    """200 tied winners among 900 runners, and races in several parts, against e_k by a plain recurrence in logs."""
    monkeypatch.setattr(CH, "PART", 64)
    monkeypatch.setattr(CH, "FAN", 3)
    rng = np.random.default_rng(12)
    rows, races = [], []
    for r, (n, k, scale) in enumerate([(900, 200, 1.0), (300, 150, 3.0), (10, 3, 1.0), (50, 49, 1.0), (400, 60, 12.0)]):
        x = rng.normal(size=n) * scale
        x -= x.mean()
        won = np.zeros(n, int)
        won[np.argsort(-(0.5 * x + rng.gumbel(size=n)))[:k]] = 1
        rows += [(r, float(a), int(b), k, n) for a, b in zip(x, won)]
        races.append((x, won, k))
    d = spark.createDataFrame(rows, "race long, x0 double, y int, k long, n long").repartition(4).withColumn("id", F.monotonically_increasing_id())

    def loglik(beta):
        total = 0.0
        for x, won, k in races:
            logs = np.full(k + 1, -np.inf)
            logs[0] = 0.0
            for u in beta * x:
                logs[1:] = np.logaddexp(logs[1:], logs[:-1] + u)
            total += beta * x[won == 1].sum() - logs[k]
        return total

    for beta in (0.0, 0.7, 2.0):
        got = CH._dead_heat_terms(d, np.array([beta]), 1).agg(*[F.sum(c).alias(c) for c in ("ll", "g_0", "h_0_0")], F.count("*").alias("n")).first()
        step = 1e-4
        assert got["n"] == len(races) and math.isclose(got["ll"], loglik(beta), rel_tol=1e-10)
        assert math.isclose(got["g_0"], (loglik(beta + step) - loglik(beta - step)) / (2 * step), rel_tol=1e-5, abs_tol=1e-4)
        assert math.isclose(got["h_0_0"], -(loglik(beta + step) - 2 * loglik(beta) + loglik(beta - step)) / step ** 2, rel_tol=1e-3, abs_tol=1e-1)
    panel = spark.createDataFrame([(r, x, y) for r, x, y, _, _ in rows], "race_id long, x double, is_winner int")
    fit = CH.fit_conditional_logit(panel, ["x"])
    best = float(fit.params[0])
    assert fit.converged and loglik(best) >= max(loglik(best - 1e-3), loglik(best + 1e-3))


def test_logistic_newton_counts_missing_rows_and_reports_no_estimate(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-0.8 * x + 0.3))).astype(int)
    rows = [(float(a), int(b)) for a, b in zip(x, y)]
    fit = MD.fit_logistic_newton(spark.createDataFrame([*rows, (None, 1), (float("nan"), 0), (0.5, None)], "x double, y int"), ["x"], "y")
    plain = MD.fit_logistic_newton(spark.createDataFrame(rows, "x double, y int"), ["x"], "y")
    assert (fit.left_out, fit.converged, plain.left_out) == (3, True, 0)
    assert math.isclose(fit.coefficients[0], plain.coefficients[0], rel_tol=1e-9)
    p = 1 / (1 + np.exp(-plain.intercept - plain.coefficients[0] * x))
    assert abs((p - y).sum()) < 1e-8 and abs(((p - y) * x).sum() + plain.coefficients[0]) < 1e-8
    short = MD.fit_logistic_newton(spark.createDataFrame(rows, "x double, y int"), ["x"], "y", max_iter=1)
    assert not short.converged and math.isnan(short.intercept)
