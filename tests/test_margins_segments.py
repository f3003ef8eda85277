"""Margin roots over flat segments: races of any size, at any border of partitions, without a price or a race."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.operators import margins as MG

METHODS = ("power", "odds_ratio", "shin")


def roots_by_bisection(pi, method):
    """One race at a time, 200 halvings; None without a sign change."""
    f = lambda t: float(MG._NP_TERMS[method](pi, t).sum()) - 1.0
    lo, hi = (float(v[0]) for v in MG._NP_BOUNDS[method](np.array([pi.max()])))
    if f(lo) * f(hi) > 0:
        return None
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def expected(odds, method):
    pi = 1.0 / np.array(odds)
    t = roots_by_bisection(pi, method)
    if t is None:
        return pi / pi.sum() if MG.METHODS[method].fallback else [None] * len(pi)
    p = MG._NP_TERMS[method](pi, t)
    return p / p.sum() if MG.METHODS[method].renormalise else p


@pytest.mark.parametrize("method", METHODS)
def test_segments_equal_bisection(method):
    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, 8, 40, 10_000, 1, 5]
    parts = [1.0 / rng.uniform(1.05, 3 + 2 * n, n) for n in sizes]
    got = MG.segment_roots(np.concatenate(parts), np.cumsum([0, *sizes[:-1]]), method)
    for pi, r in zip(parts, got):
        want = roots_by_bisection(pi, method)
        assert np.isnan(r) if want is None else abs(r - want) <= 1e-12 * max(1, abs(want)), (len(pi), r, want)
    assert len(MG.segment_roots(np.array([]), np.array([], np.int64), method)) == 0


def race_rows():
    rng = np.random.default_rng(7)
    rows = [(r, i, float(o)) for r in range(40) for i, o in enumerate(rng.uniform(1.2, 14, 1 + r % 9))]
    rows += [(100, i, float(o)) for i, o in enumerate(rng.uniform(50, 2000, 1500))]  # most of all rows
    rows += [(100, i, 60.0) for i in range(200)]  # repeated rows
    return rows


@pytest.mark.parametrize("segment", [None, 250, 1_000_000])
def test_races_over_borders(spark, segment):
    rows = race_rows()
    df = spark.createDataFrame(rows, "race_id long, horse_id long, sp double").repartition(5)
    got = MG.remove_margins(df, METHODS, max_inline=segment, keep_root=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["race_id"], []).append(r)
    for race, members in by.items():
        for m in METHODS:
            want = expected([r["sp"] for r in members], m)
            for r, w in zip(members, want):
                v = r[f"{m}_win_prob"]
                assert v is None if w is None else abs(v - min(max(w, 1e-12), 1 - 1e-12)) < 1e-11, (race, m, v, w)


def test_rows_without_price_or_race(spark):
    rows = [("a", 2.0, 1), ("a", 3.0, 2), ("a", None, 3), ("a", 4.0, 4), (None, 2.0, 5), (None, None, 6), ("b", None, 7), ("c", 1.5, 8), ("c", 0.0, 9)]
    df = spark.createDataFrame(rows, "race_id string, sp double, id int")
    for segment in (None, 2):
        got = {r["id"]: r["power_win_prob"] for r in MG.remove_margins(df, ["power"], max_inline=segment).collect()}
        assert sorted(got) == list(range(1, 10))
        assert all(got[i] is None for i in (3, 5, 6, 7, 9)) and abs(got[1] + got[2] + got[4] - 1) < 1e-12
    empty = df.where("false")
    assert MG.remove_margins(empty, METHODS).collect() == [] and "shin_win_prob" in MG.remove_margins(empty, METHODS).columns


def test_columns_with_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(1, 2.0, "x", [1]), (1, 3.0, "y", [])], "race_id int, sp double, race string, power_root array<int>").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = MG.remove_margins(df.withColumnRenamed("power_root", "s"), ["power"]).collect()
    assert sorted(r["race"] for r in got) == ["x", "y"] and got[0]["m"] == {"a": 1}
