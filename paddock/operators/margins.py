"""Margin removal: turn a race's inverse odds pi_i (sum > or < 1) into probabilities.

* multiplicative : pi / sum(pi)
* power          : solve sum pi^a = 1 on [0.01, 10], p = pi^a / sum pi^a; no root -> multiplicative
* odds ratio     : solve sum pi / (l + pi) = 1 on [0, 1000 max pi], p = pi / (l + pi)
                   (the form the source data used; no fallback, no root -> null)
* shin           : solve sum (sqrt(z^2 + 4 (1 - z) pi) - z) / 2 = 1 on (1e-6, 1 - 1e-6);
                   no root -> multiplicative

Each f is decreasing in its parameter. All methods are solved in one pass: rows are range-partitioned by
(race, hash of the row) and sorted, so a race of any size spreads over neighbouring partitions. Races inside a
partition are segments of a flat array, and Newton steps within brackets move all of them at once (sums by
``reduceat``). The first and last race of each partition may go on in the next one; a round of theirs is one
job that adds up partial sums at a few points of each bracket. The driver holds brackets of two races per
partition at most. No race is gathered, and nothing is joined back.

``remove_margin_jvm`` bisects instead, with JVM higher-order functions (a second implementation, for tests).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paddock.functions.odds import PROB_EPS, clip_prob
from paddock.operators.common import with_group_stats, written

BISECT_STEPS = 64
GRID_POINTS = 64
GRID_ROUNDS = 9
MAX_INLINE = 10_000  # of the bisection in the JVM
MAX_STEPS = 200  # Newton or halving, at most
EDGE_POINTS, EDGE_ROUNDS = 20, 30  # of races at borders of partitions


@dataclass(frozen=True)
class Method:
    name: str
    term: Callable[[Column, Column], Column]          # per-runner term of sum_i term(pi_i, t)
    lo: Callable[[Column], Column]                    # bracket from max(pi)
    hi: Callable[[Column], Column]
    prob: Callable[[Column, Column], Column]          # probability from (pi, root)
    renormalise: bool
    fallback: bool                                    # no bracketed root -> multiplicative


POWER = Method(
    "power",
    term=lambda pi, a: F.pow(pi, a),
    lo=lambda m: F.lit(0.01), hi=lambda m: F.lit(10.0),
    prob=lambda pi, a: F.pow(pi, a), renormalise=True, fallback=True,
)
ODDS_RATIO = Method(
    "odds_ratio",
    term=lambda pi, l: pi / (l + pi),
    lo=lambda m: F.lit(0.0), hi=lambda m: m * F.lit(1000.0),
    prob=lambda pi, l: pi / (l + pi), renormalise=False, fallback=False,
)
SHIN = Method(
    "shin",
    term=lambda pi, z: (F.sqrt(z * z + F.lit(4.0) * (F.lit(1.0) - z) * pi) - z) / F.lit(2.0),
    lo=lambda m: F.lit(1e-6), hi=lambda m: F.lit(1.0 - 1e-6),
    prob=lambda pi, z: (F.sqrt(z * z + F.lit(4.0) * (F.lit(1.0) - z) * pi) - z) / F.lit(2.0),
    renormalise=False, fallback=True,
)
METHODS = {m.name: m for m in (POWER, ODDS_RATIO, SHIN)}


def _root_expr(fa: Column, fb: Column, lo: Column, hi: Column, root: Column) -> Column:
    """Bracket rule: same sign -> null (no root); zero at an end -> that end; else the bisection root."""
    return (F.when(fa.isNull() | fb.isNull(), F.lit(None).cast("double"))
            .when(fa * fb > 0, F.lit(None).cast("double"))
            .when(fa == 0, lo).when(fb == 0, hi).otherwise(root))


def _solve_inline(races: DataFrame, m: Method) -> DataFrame:
    """races: (race, pis array, pmax) -> + root."""
    pis = F.col("pis")

    def f(t: Column) -> Column:
        return F.aggregate(pis, F.lit(0.0), lambda acc, p: acc + m.term(p, t)) - F.lit(1.0)

    lo, hi = m.lo(F.col("pmax")), m.hi(F.col("pmax"))
    init = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / F.lit(2.0)
        fm = f(mid)
        return F.struct(F.when(fm > 0, mid).otherwise(s["lo"]).alias("lo"),
                        F.when(fm > 0, s["hi"]).otherwise(mid).alias("hi"))

    fin = F.aggregate(F.sequence(F.lit(1), F.lit(BISECT_STEPS)), init, step)
    root = (fin["lo"] + fin["hi"]) / F.lit(2.0)
    return races.withColumn("root", _root_expr(f(lo), f(hi), lo, hi, root))


def _solve_distributed(rows: DataFrame, bounds: DataFrame, m: Method) -> DataFrame:
    """rows: (race, pi); bounds: (race, pmax) -> (race, root).  GRID_ROUNDS aggregates."""
    br = bounds.select("race", m.lo(F.col("pmax")).cast("double").alias("lo"),
                       m.hi(F.col("pmax")).cast("double").alias("hi"))
    ends = rows.join(br, "race").groupBy("race").agg(
        F.sum(m.term(F.col("pi"), F.col("lo"))).alias("fa"), F.sum(m.term(F.col("pi"), F.col("hi"))).alias("fb"),
        F.first("lo").alias("lo0"), F.first("hi").alias("hi0"))
    cur = br
    g = GRID_POINTS
    for _ in range(GRID_ROUNDS):
        pts = [F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(j / (g + 1)) for j in range(1, g + 1)]
        vals = rows.join(cur, "race").groupBy("race").agg(
            F.first("lo").alias("lo"), F.first("hi").alias("hi"),
            *[F.sum(m.term(F.col("pi"), t)).alias(f"f{j}") for j, t in enumerate(pts)])
        # last grid point with f > 1 (f decreasing): the root lies just right of it
        pos = F.array(*[F.when(F.col(f"f{j}") - F.lit(1.0) > 0, F.lit(j)) for j in range(g)])
        last = F.array_max(pos)
        width = (F.col("hi") - F.col("lo")) / F.lit(float(g + 1))
        new_lo = F.when(last.isNull(), F.col("lo")).otherwise(F.col("lo") + width * (last + 1))
        new_hi = F.when(last.isNull(), F.col("lo") + width).otherwise(F.col("lo") + width * (last + 2))
        cur = vals.select("race", new_lo.alias("lo"), new_hi.alias("hi")).checkpoint()
    root = (F.col("lo") + F.col("hi")) / F.lit(2.0)
    out = cur.join(ends, "race").select(
        "race", _root_expr(F.col("fa") - 1, F.col("fb") - 1, F.col("lo0"), F.col("hi0"), root).alias("root"))
    return out


# numpy twins of the per-runner terms and their derivatives in the parameter
_NP_TERMS = {
    "power": lambda pi, t: np.power(pi, t),
    "odds_ratio": lambda pi, t: pi / (t + pi),
    "shin": lambda pi, t: (np.sqrt(t * t + 4.0 * (1.0 - t) * pi) - t) / 2.0,
}
_NP_SLOPES = {
    "power": lambda pi, t: np.power(pi, t) * np.log(pi),
    "odds_ratio": lambda pi, t: -pi / (t + pi) ** 2,
    "shin": lambda pi, t: ((t - 2.0 * pi) / np.sqrt(t * t + 4.0 * (1.0 - t) * pi) - 1.0) / 2.0,
}
_NP_BOUNDS = {
    "power": lambda pmax: (np.full_like(pmax, 0.01), np.full_like(pmax, 10.0)),
    "odds_ratio": lambda pmax: (np.zeros_like(pmax), pmax * 1000.0),
    "shin": lambda pmax: (np.full_like(pmax, 1e-6), np.full_like(pmax, 1.0 - 1e-6)),
}


def _no_root(fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    return ~np.isfinite(fa) | ~np.isfinite(fb) | (fa * fb > 0)


def segment_roots(pi: np.ndarray, starts: np.ndarray, method: str) -> np.ndarray:
    """Root of every segment of the flat array ``pi`` (first places in ``starts``, no segment empty); NaN where
    the bracket holds none. Newton steps inside a bracket that shrinks with each; a step out of it halves it."""
    term, slope = _NP_TERMS[method], _NP_SLOPES[method]
    roots = np.full(len(starts), np.nan)
    if not len(starts):
        return roots
    with np.errstate(all="ignore"):
        sizes = np.diff(np.append(starts, len(pi)))
        lo, hi = _NP_BOUNDS[method](np.maximum.reduceat(pi, starts))
        at = lambda fn, t: np.add.reduceat(fn(pi, np.repeat(t, sizes)), starts)
        fa, fb = at(term, lo) - 1.0, at(term, hi) - 1.0
        live = ~_no_root(fa, fb)
        roots[live & (fb == 0)] = hi[live & (fb == 0)]
        roots[live & (fa == 0)] = lo[live & (fa == 0)]
        where = np.flatnonzero(live & (fa != 0) & (fb != 0))
        t, lo, hi = lo.copy(), lo.copy(), hi.copy()
        for step in range(MAX_STEPS):
            if not len(where):
                break
            # the open segments alone, end to end
            size = sizes[where]
            first = np.cumsum(size) - size
            x = pi[np.repeat(starts[where] - first, size) + np.arange(size.sum())]
            now = t[where]
            wide = np.repeat(now, size)
            f = np.add.reduceat(term(x, wide), first) - 1.0
            up = f > 0
            lo[where] = np.where(up, now, lo[where])
            hi[where] = np.where(up, hi[where], now)
            new = now - f / np.add.reduceat(slope(x, wide), first)
            inside = (new >= lo[where]) & (new <= hi[where])
            new = np.where(inside, new, (lo[where] + hi[where]) / 2.0)
            t[where] = new
            tiny = 4e-15 * np.maximum(np.abs(new), 1e-300)
            done = (f == 0) | (np.abs(new - now) <= tiny) | (hi[where] - lo[where] <= tiny)
            roots[where[f == 0]] = now[f == 0]
            roots[where[done & (f != 0)]] = new[done & (f != 0)]
            where = where[~done]
        roots[where] = t[where]
    return roots


def _runs(keys: pa.Array) -> np.ndarray:
    """First places of the runs of equal values."""
    ends = pc.run_end_encode(keys, run_end_type=pa.int64()).run_ends.to_numpy()
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)


def _inverse(odds: pa.Array) -> np.ndarray:
    """1 / odds; NaN where there is none."""
    x = pc.cast(odds, pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        return 1.0 / np.where(x == 0, np.nan, x)


def _probabilities(pi: np.ndarray, t: np.ndarray, whole: np.ndarray | float, raw_sum: np.ndarray | float, method: str) -> np.ndarray:
    """Probabilities of rows from their race's root, its sum of ``pi`` and, for a method that renormalises,
    its sum of terms."""
    m = METHODS[method]
    with np.errstate(all="ignore"):
        p = _NP_TERMS[method](pi, t)
        if m.renormalise:
            p = p / raw_sum
        p = np.where(np.isnan(t), pi / whole if m.fallback else np.nan, p)
    return np.clip(p, PROB_EPS, 1.0 - PROB_EPS)  # NaN stays


def _solved(pi: np.ndarray, starts: np.ndarray, methods: list[str]) -> list[np.ndarray]:
    """Per method the roots and the probabilities of all rows. Rows without a price count nothing."""
    priced = ~np.isnan(pi)
    sizes = np.diff(np.append(starts, len(pi)))
    seg = np.repeat(np.arange(len(starts)), sizes)
    x, own = pi[priced], seg[priced]
    present, first = np.unique(own, return_index=True)
    whole = np.zeros(len(starts))
    if len(x):
        whole[present] = np.add.reduceat(x, first)
    out = []
    for m in methods:
        root, raw = np.full(len(starts), np.nan), np.full(len(starts), np.nan)
        if len(x):
            root[present] = segment_roots(x, first, m)
            with np.errstate(all="ignore"):
                raw[present] = np.add.reduceat(_NP_TERMS[m](x, root[own]), first)
        out += [root[seg], _probabilities(pi, root[seg], whole[seg], raw[seg], m)]
    return out


def _with(b: pa.RecordBatch, edge: bool, values: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    cols = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in values]
    return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, edge)), *cols], names=names)


def _inner_races(race: str, odds: str, methods: list[str], names: list[str]):
    """Rows of a partition, sorted by race -> the same rows, solved where the race lies within the partition. Rows
    of its first and last race, which may go on in a neighbour, are marked and pass on unsolved."""
    def solved(parts: list[pa.RecordBatch]):
        b = pa.Table.from_batches(parts).combine_chunks()
        if b.num_rows:
            b = b.to_batches()[0]
            yield _with(b, False, _solved(_inverse(b.column(odds)), _runs(b.column(race)), methods), names)

    def edge(b: pa.RecordBatch):
        return _with(b, True, [np.full(b.num_rows, np.nan)] * (2 * len(methods)), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, head = None, [], True
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(race)
            if first is None:
                first = keys[0]
            if head:
                starts = _runs(keys)
                n = 0 if not keys[0].equals(first) else int(starts[1]) if len(starts) > 1 else b.num_rows
                if n:
                    yield edge(b.slice(0, n))
                if n == b.num_rows:
                    continue
                head, b = False, b.slice(n)
                keys = b.column(race)
            cut = int(_runs(keys)[-1])
            if not cut and held and held[-1].column(race)[0].equals(keys[0]):
                held.append(b)
                continue
            yield from solved([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        for b in held:
            yield edge(b)

    return run


def _edge_sums(rows: DataFrame, race: str, odds: str, points: dict, methods: list[str]) -> dict:
    """{race: array[method, point]}: the sums of all terms at the given points of each race, added per task first.
    Races here are at most two per partition."""
    width = len(next(iter(points.values()))[0])

    def run(batches):
        sums = {}
        for b in batches:
            pi = _inverse(b.column(odds))
            starts = _runs(b.column(race)) if b.num_rows else []
            for a, e in zip(starts, [*starts[1:], b.num_rows]):
                key, x = b.column(race)[int(a)].as_py(), pi[a:e]
                x = x[~np.isnan(x)]
                own = sums.setdefault(key, np.zeros((len(methods), width)))
                with np.errstate(all="ignore"):
                    for i, m in enumerate(methods):
                        for j, t in enumerate(points[key][i]):
                            own[i, j] += _NP_TERMS[m](x, t).sum()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array([v.ravel().tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                             names=["race", "s"])

    field = rows.schema[race].dataType
    kind = to_arrow_type(field)
    schema = T.StructType([T.StructField("race", field), T.StructField("s", T.ArrayType(T.DoubleType()))])
    partial = rows.select(race, odds).mapInArrow(run, schema)
    total = partial.groupBy("race").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(methods) * width)])
    return {r[0]: np.array(r[1:], float).reshape(len(methods), width) for r in total.collect()}


def _crossing(p: np.ndarray, f: np.ndarray, lo: float, hi: float, fa: float, fb: float) -> float:
    """Where f crosses 0 between ``lo`` and ``hi``: inverse interpolation through the four points around, else the secant."""
    a = max(0, min(int(np.searchsorted(p, hi)) - 2, len(p) - 4))
    x, y = p[a:a + 4], f[a:a + 4]
    if np.isfinite(y).all() and (np.diff(y) < 0).all():
        guess = sum(x[i] * math.prod(-y[k] / (y[i] - y[k]) for k in range(4) if k != i) for i in range(4))
        if lo < guess < hi:
            return float(guess)
    return lo + (hi - lo) * fa / (fa - fb)


def _narrower(lo: float, hi: float, guess: float, n: int) -> np.ndarray:
    """``n`` sorted points between ``lo`` and ``hi``: evenly spread ones, and some close to ``guess``."""
    off = (hi - lo) * np.array([1e-1, 1e-2, 1e-3, 1e-5, 1e-7])
    even = lo + (hi - lo) * np.arange(1, n - 10) / (n - 10)
    return np.sort(np.clip(np.concatenate([even, [guess], guess - off, guess + off]), lo, hi))


def _edge_roots(rows: DataFrame, race: str, odds: str, methods: list[str]) -> dict:
    """{race: (sum of pi, roots)} of races that lie at borders of partitions. A round is one job that adds up partial
    sums at a few points of every such race; the driver holds a bracket per race and method."""
    x = F.lit(1.0) / F.when(F.col(odds) != 0, F.col(odds).cast("double"))
    facts = {r["race"]: (r["p"], r["m"]) for r in rows.groupBy(F.col(race).alias("race")).agg(
        F.sum(x).alias("p"), F.max(x).alias("m")).where("m is not null and race is not null").collect()}
    if not facts:
        return {}
    rows = rows.where(F.col(race).isNotNull()).where(x.isNotNull())
    brackets = {r: [tuple(float(v[0]) for v in _NP_BOUNDS[m](np.array([top]))) for m in methods] for r, (_, top) in facts.items()}
    # both ends in the first round
    points = {r: np.array([np.linspace(lo, hi, EDGE_POINTS) for lo, hi in b]) for r, b in brackets.items()}
    state: dict = {}  # (race, method): lo, hi, f(lo), f(hi), or a root
    for turn in range(EDGE_ROUNDS):
        got = _edge_sums(rows, race, odds, points, methods)
        still = False
        for r, sums in got.items():
            nxt = []
            for i in range(len(methods)):
                p, f = points[r][i], sums[i] - 1.0
                s = state.get((r, i))
                if turn == 0:
                    fa, fb = f[0], f[-1]
                    if _no_root(np.array(fa), np.array(fb)):
                        s = math.nan
                    elif fa == 0 or fb == 0:
                        s = float(p[0] if fa == 0 else p[-1])
                    else:
                        s = (p[0], p[-1], fa, fb)
                if isinstance(s, tuple):
                    lo, hi, fa, fb = s
                    for t, v in zip(p, f):  # each decides one side of the root
                        if v > 0 and t >= lo:
                            lo, fa = t, v
                        elif v <= 0 and t <= hi:
                            hi, fb = t, v
                            break
                    s = (lo, hi, fa, fb)
                    guess = float(hi) if fb == 0 else _crossing(p, f, *s)
                    if fb == 0 or hi - lo <= 1e-13 * max(abs(hi), 1e-300) or turn == EDGE_ROUNDS - 1:
                        s = guess
                state[r, i] = s
                still |= isinstance(s, tuple)
                nxt.append(_narrower(s[0], s[1], guess, EDGE_POINTS) if isinstance(s, tuple) else np.full(EDGE_POINTS, s))
            points[r] = np.array(nxt)
        if not still:
            break
    return {r: (facts[r][0], np.array([state[r, i] for i in range(len(methods))])) for r in facts}


def remove_margins(df: DataFrame, methods=("power", "odds_ratio", "shin"), odds: str = "sp",
                   race: str = "race_id", max_inline: int | None = None, keep_root: bool = False) -> DataFrame:
    """Add ``{method}_win_prob`` for every method (clipped to [1e-12, 1 - 1e-12]) in one pass.

    ``max_inline``: rows of a range partition; Spark's own number of partitions where it is not given. Rows
    without a price have no probability and count nothing; rows without a race have none either."""
    methods = list(methods)
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    # rows of one race in any order, the same in each run: a race of any size spreads over partitions
    order = [F.col(race), F.xxhash64(*hashed)]
    ranged = df.repartitionByRange(*order) if max_inline is None else df.repartitionByRange(max(1, -(-df.count() // max_inline)), *order)
    added = [T.StructField("_edge", T.BooleanType())]
    for m in methods:
        added += [T.StructField(f"{m}_root", T.DoubleType()), T.StructField(f"{m}_win_prob", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *added])
    names = schema.names
    spare = [] if keep_root else [f"{m}_root" for m in methods]
    rows = written(ranged.sortWithinPartitions(*order).mapInArrow(_inner_races(race, odds, methods, names), schema).drop(*spare), "margins")
    edge = rows.where("_edge").select(*df.columns)
    found = _edge_roots(edge, race, odds, methods)

    def fill(batches):
        for b in batches:
            if not b.num_rows:
                continue
            pi, starts = _inverse(b.column(odds)), _runs(b.column(race))
            values = [np.full(b.num_rows, np.nan) for _ in range(2 * len(methods))]
            for a, e in zip(starts, [*starts[1:], b.num_rows]):
                whole, roots = found.get(b.column(race)[int(a)].as_py(), (None, None))
                if roots is not None:
                    for i, m in enumerate(methods):
                        values[2 * i][a:e] = roots[i]
                        values[2 * i + 1][a:e] = _probabilities(pi[a:e], np.full(e - a, roots[i]), whole, 1.0, m)  # at a root the terms add up to 1
            yield _with(b, True, values, names)

    out = rows.where("not _edge").unionByName(edge.mapInArrow(fill, schema).drop(*spare))
    return out.drop("_edge")


def remove_margin(df: DataFrame, method: str, odds: str = "sp", race: str = "race_id", out: str | None = None,
                  max_inline: int | None = None, keep_root: bool = False) -> DataFrame:
    """Add ``{method}_win_prob`` (clipped to [1e-12, 1 - 1e-12])."""
    d = remove_margins(df, [method], odds, race, max_inline, keep_root)
    return d if out is None else d.withColumnRenamed(f"{method}_win_prob", out)


def remove_margin_jvm(df: DataFrame, method: str, odds: str = "sp", race: str = "race_id", out: str | None = None,
                      max_inline: int = MAX_INLINE, keep_root: bool = False) -> DataFrame:
    """Same as ``remove_margin`` with the bisection as a JVM higher-order function (second implementation)."""
    m = METHODS[method]
    out = out or f"{method}_win_prob"
    d = df.withColumn("_pi", F.lit(1.0) / F.col(odds))
    d = with_group_stats(d, race, F.count(F.lit(1)).alias("_n"), F.max("_pi").alias("_pmax"),
                         F.sum("_pi").alias("_pisum"))
    small = d.filter(F.col("_n") <= max_inline).groupBy(race).agg(
        F.collect_list("_pi").alias("pis"), F.first("_pmax").alias("pmax")).withColumnRenamed(race, "race")
    roots = _solve_inline(small, m).select("race", "root")
    big_rows = d.filter(F.col("_n") > max_inline)
    if big_rows.limit(1).count() > 0:
        rows = big_rows.select(F.col(race).alias("race"), F.col("_pi").alias("pi"))
        bounds = big_rows.groupBy(race).agg(F.first("_pmax").alias("pmax")).withColumnRenamed(race, "race")
        roots = roots.unionByName(_solve_distributed(rows, bounds, m))
    roots = roots.withColumnRenamed("race", race)
    d = d.join(roots, race, "left")
    raw = m.prob(F.col("_pi"), F.col("root"))
    if m.renormalise:
        d = d.withColumn("_raw", raw)
        d = with_group_stats(d, race, F.sum("_raw").alias("_rawsum"))
        raw = F.col("_raw") / F.col("_rawsum")
    naive = F.col("_pi") / F.col("_pisum")
    prob = F.when(F.col("root").isNull(), naive if m.fallback else F.lit(None).cast("double")).otherwise(raw)
    d = d.withColumn(out, clip_prob(prob))
    if keep_root:
        d = d.withColumnRenamed("root", f"{method}_root")
    drop = [c for c in ("_pi", "_n", "_pmax", "_pisum", "root", "_raw", "_rawsum") if c in d.columns]
    return d.drop(*drop)


def multiplicative(df: DataFrame, odds: str = "sp", race: str = "race_id", out: str = "mm_win_prob") -> DataFrame:
    d = with_group_stats(df, race, F.sum(F.lit(1.0) / F.col(odds)).alias("_bs"))
    return d.withColumn(out, clip_prob((F.lit(1.0) / F.col(odds)) / F.col("_bs"))).drop("_bs")
