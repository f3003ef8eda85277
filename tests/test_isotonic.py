import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from paddock.operators import isotonic as ISO


def pooled(x, y):
    """(lo, hi, value) of the blocks, by the plain pooling of one sorted list."""
    blocks = []
    for v in np.unique(x):
        at = x == v
        blocks.append([float(v), float(v), float(y[at].sum()), int(at.sum())])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + s, blocks[-1][3] + n]
    return [(lo, hi, s / n) for lo, hi, s, n in blocks]


def max_min(x, y):
    """f(i) = max over j <= i of min over k >= i of the mean of the scores from j to k."""
    at = np.unique(x)
    s = np.array([y[x == v].sum() for v in at])
    n = np.array([(x == v).sum() for v in at])
    cs, cn = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(n)])
    return at, [max(min((cs[k + 1] - cs[j]) / (cn[k + 1] - cn[j]) for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))]


def steps(fit):
    return [tuple(r) for r in fit.blocks.orderBy("lo").collect()]


def same(got, want):
    # blocks of one mean may be cut or joined by rounding: compare the curve at both ends of every block
    x = np.array([v for lo, hi, _ in got + want for v in (lo, hi)])
    curve = [np.interp(x, [v for b in blocks for v in b[:2]], [b[2] for b in blocks for _ in range(2)]) for blocks in (got, want)]
    return np.allclose(curve[0], curve[1], rtol=1e-12, atol=1e-12) and all(a[1] < b[0] for a, b in zip(got, got[1:]))


CASES = {
    "noise": lambda g, n: (g.random(n), (g.random(n) < 0.3).astype(int)),
    "slope": lambda g, n: (x := g.random(n), (g.random(n) < x).astype(int)),
    "rising": lambda g, n: (np.arange(n) / n, np.arange(n) ** 2),
    "falling": lambda g, n: (np.arange(n) / n, n - np.arange(n)),
    "flat": lambda g, n: (np.arange(n) / n, np.ones(n, int)),
    "saw": lambda g, n: (np.arange(n) / n, np.arange(n) % 7 + np.arange(n) // 50),
    "valley": lambda g, n: (np.arange(n) / n, np.abs(np.arange(n) - n // 2)),
    "ties": lambda g, n: (np.round(g.random(n), 2), (g.random(n) < 0.5).astype(int)),
}


@pytest.mark.parametrize("case", CASES)
def test_borders_of_partitions_leave_no_trace(spark, case):
    x, y = CASES[case](np.random.default_rng(3), 400)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "p double, y int").repartition(3)
    fit = ISO.fit_isotonic(df, "p", "y", rows_per_part=23)
    assert same(steps(fit), pooled(x, y))
    at, want = max_min(x[:60], y[:60])
    part = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x[:60], y[:60])], "p double, y int")
    got = {r["p"]: r["c"] for r in ISO.calibrate(ISO.fit_isotonic(part, "p", "y", rows_per_part=7), part, "p", "c", rows_per_part=5).collect()}
    assert all(math.isclose(got[float(v)], min(1.0, w), rel_tol=1e-12, abs_tol=1e-12) for v, w in zip(at, want))


def test_scores_between_and_outside_of_blocks(spark):
    g = np.random.default_rng(5)
    x, y = np.round(g.random(300), 4), None
    y = (g.random(300) < x).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "p double, y int")
    blocks = pooled(x, y)
    asked = [-1.0, 2.0, *g.random(200).tolist(), *[0.5] * 40]
    rows = spark.createDataFrame([(i, v, "kept") for i, v in enumerate(asked)], "i int, p double, c string")
    for size in (11, 1000):
        got = ISO.calibrate(ISO.fit_isotonic(df, "p", "y", rows_per_part=size), rows, "p", "c", rows_per_part=13)
        assert got.columns == ["i", "p", "c"] and dict(got.dtypes)["c"] == "double"
        got = {r["i"]: r["c"] for r in got.collect()}
        want = np.interp(asked, [v for b in blocks for v in b[:2]], [b[2] for b in blocks for _ in range(2)])
        assert len(got) == len(asked) and np.allclose([got[i] for i in range(len(asked))], want, rtol=1e-12)


def test_missing_values_and_empty_tables(spark):
    odd = [(None, 1), (float("nan"), 0), (float("inf"), 1), (0.4, None), (0.2, 0), (0.6, 1)]
    df = spark.createDataFrame(odd, "p double, y int")
    fit = ISO.fit_isotonic(df, "p", "y")
    assert steps(fit) == [(0.2, 0.2, 0.0), (0.6, 0.6, 1.0)]
    got = [r["c"] for r in ISO.calibrate(fit, df.coalesce(1).withColumn("k", F.monotonically_increasing_id()), "p", "c").orderBy("k").collect()]
    assert got[:3] == [None, None, 1.0] and math.isclose(got[3], 0.5) and got[4:] == [0.0, 1.0]
    none = ISO.fit_isotonic(df.limit(0), "p", "y")
    assert [r["c"] for r in ISO.calibrate(none, df, "p", "c").collect()] == [None] * 6
    assert ISO.calibrate(fit, df.limit(0), "p", "c").count() == 0
    again = ISO.calibrate(fit, df, "p", "p")
    assert again.columns == ["y", "p"] and again.count() == 6


def test_a_million_distinct_scores(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select((F.col("id") / n).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(n)) < F.col("id")).cast("int").alias("y"))
    fit = ISO.fit_isotonic(df, "p", "y", rows_per_part=100_000)
    y = np.array([r["y"] for r in df.orderBy("p").collect()])
    hull = ISO.Hull()
    for i, v in enumerate(y.tolist()):
        hull.add(1.0, float(v), i / n, i / n)
    assert len(fit.parts) > 5
    assert same(steps(fit), [(a, b, s / w) for a, b, s, w in zip(hull.lo, hull.hi, hull.s, hull.w)])
