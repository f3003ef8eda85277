"""Stage 7a: conditional (grouped) logit, fitted by Newton's method.

Likelihood per race r with winner set W (k = |W|):
    sum_{i in W} u_i - log e_k(exp(u_1), ..., exp(u_n)),   u = x . beta
k = 1 is the softmax case; its gradient and Hessian are sums of
exp(u) x and exp(u) x x' per race, computed by one groupBy (combined
map-side, so a very large race is reduced in pieces) and one global sum.
Races with 2 <= k < n (dead heats) get e_k as a coefficient of a product of
polynomials, multiplied in parts and up a tree; races with k = 0 or k = n
carry no information.
Only P + P^2 numbers reach the driver per iteration (P = number of features).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators.common import forget, with_group_stats, written

Z975 = 1.959963984540054


@dataclass
class ChoiceFit:
    features: list[str]
    params: np.ndarray
    cov: np.ndarray
    loglik: float
    iterations: int
    n_races: int
    converged: bool
    history: list[float] = field(default_factory=list)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))


def _prepare(df: DataFrame, features: list[str], y: str, race: str) -> DataFrame:
    """Races with a winner and a loser. A race with a missing value is left out whole: without
    one of its runners it would be another choice set. Features are centred within the race, which
    cancels in the softmax and keeps its exponents small."""
    cols = [F.col(race).alias("race")] + [F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]
    xs = [f"x{j}" for j in range(len(features))]
    d = df.select(*cols, F.col(y).cast("int").alias("y")).where(F.col("race").isNotNull())
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in [*xs, "y"]])
    d = with_group_stats(d, "race", F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"), F.max(missing).alias("gaps"),
                         *[F.avg(c).alias(f"m_{c}") for c in xs], how="inner")
    d = d.filter((F.col("gaps") == 0) & (F.col("k") >= 1) & (F.col("k") < F.col("n")))
    return d.select("race", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in xs], "y", "k", "n")


def _single_winner_terms(d: DataFrame, beta: np.ndarray, p: int):
    u = sum((F.lit(float(beta[j])) * F.col(f"x{j}") for j in range(p)), F.lit(0.0))
    e = F.exp(u)
    aggs = [F.sum(e).alias("s0"), F.sum(F.col("y") * u).alias("uw")]
    aggs += [F.sum(e * F.col(f"x{j}")).alias(f"s1_{j}") for j in range(p)]
    aggs += [F.sum(F.col("y") * F.col(f"x{j}")).alias(f"xw_{j}") for j in range(p)]
    aggs += [F.sum(e * F.col(f"x{j}") * F.col(f"x{l}")).alias(f"s2_{j}_{l}") for j in range(p) for l in range(j, p)]
    per_race = d.filter(F.col("k") == 1).groupBy("race").agg(*aggs)
    tot = [F.sum(F.col("uw") - F.ln("s0")).alias("ll")]
    tot += [F.sum(F.col(f"xw_{j}") - F.col(f"s1_{j}") / F.col("s0")).alias(f"g_{j}") for j in range(p)]
    tot += [F.sum(F.col(f"s2_{j}_{l}") / F.col("s0") - F.col(f"s1_{j}") * F.col(f"s1_{l}") / (F.col("s0") * F.col("s0")))
            .alias(f"h_{j}_{l}") for j in range(p) for l in range(j, p)]
    tot += [F.count(F.lit(1)).alias("n_races")]
    return per_race.agg(*tot)


PART = 4096  # runners whose polynomial one row gets; products then go up a tree of FAN parts a node
FAN = 64
GRID = 40

Jet = tuple  # coefficients of a truncated polynomial, their gradients and Hessians, and a log scale


def _times(a: Jet, b: Jet, k: int) -> Jet:
    """The product of two polynomials with derivatives, up to degree ``k``, scaled to a largest coefficient of 1."""
    (v, g, h, s), (w, d, e, t) = a, b
    p = g.shape[1]
    c = lambda x, y: np.convolve(x, y)[:k + 1]
    value = c(v, w)
    top = value.max()
    grad = np.stack([c(g[:, j], w) + c(v, d[:, j]) for j in range(p)], axis=1)
    hess = np.stack([np.stack([c(h[:, j, l], w) + c(g[:, j], d[:, l]) + c(g[:, l], d[:, j]) + c(v, e[:, j, l]) for l in range(p)], axis=1)
                     for j in range(p)], axis=1)
    return value / top, grad / top, hess / top, s + t + float(np.log(top))


def _product(jets: list[Jet], k: int) -> Jet:
    while len(jets) > 1:
        jets = [_times(*jets[i:i + 2], k) if i + 1 < len(jets) else jets[i] for i in range(0, len(jets), 2)]
    return jets[0]


def _leaves(u: np.ndarray, x: np.ndarray) -> list[Jet]:
    """1 + exp(u) z per runner, scaled, with derivatives in the coefficients that u = x . beta depends on."""
    m = np.maximum(u, 0)
    one, w = np.exp(-m), np.exp(u - m)
    g = np.zeros((len(u), 2, x.shape[1]))
    g[:, 1] = w[:, None] * x
    h = np.zeros((len(u), 2, x.shape[1], x.shape[1]))
    h[:, 1] = w[:, None, None] * x[:, :, None] * x[:, None, :]
    return [(np.array([one[i], w[i]]), g[i], h[i], float(m[i])) for i in range(len(u))]


def _packed(jet: Jet) -> bytes:
    v, g, h, s = jet
    return np.concatenate([[s], v, g.ravel(), h.ravel()]).tobytes()


def _unpacked(data: bytes, p: int) -> Jet:
    x = np.frombuffer(data)
    n = (len(x) - 1) // (1 + p + p * p)
    return x[1:1 + n], x[1 + n:1 + n + n * p].reshape(n, p), x[1 + n + n * p:].reshape(n, p, p), float(x[0])


def _dead_heat_terms(d: DataFrame, beta: np.ndarray, p: int) -> DataFrame:
    """Log-likelihood, gradient and Hessian per race with 2 <= k < n winners, any k.

    e_k(w) is the coefficient of z^k in the product of 1 + w z over the runners, whose factors carry first
    and second derivatives. Runners are dealt into parts of about ``PART``, multiplied by divide and conquer;
    the parts of a race are multiplied up a tree, so a race of any size is many rows. All
    coefficients are positive, so nothing cancels. To keep z^k near the largest coefficient, the weights of
    a race are tilted, exp(u - t), so that the expected number of winners is about k; that changes
    e_k by the factor exp(-k t) only."""
    import pyarrow as pa

    u = sum((F.lit(float(beta[j])) * F.col(f"x{j}") for j in range(p)), F.lit(0.0))
    heats = d.filter(F.col("k") >= 2).withColumn("_u", u)
    heats = with_group_stats(heats, "race", F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
    reach = F.ln(F.col("n").cast("double")) + F.lit(1.0)
    low, width = F.col("_lo") - reach, (F.col("_hi") - F.col("_lo") + 2 * reach) / GRID
    heats = heats.withColumn("_low", low).withColumn("_width", width)
    expected = [F.sum(F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_low") + F.lit(float(j)) * F.col("_width") - F.col("_u")))).alias(f"_e{j}") for j in range(GRID + 1)]
    tilt = heats.groupBy("race").agg(F.first("k").alias("_k"), F.first("_low").alias("_l"), F.first("_width").alias("_w"), *expected)
    above = sum((F.when(F.col(f"_e{j}") >= F.col("_k"), 1).otherwise(0) for j in range(GRID + 1)), F.lit(0))
    tilt = tilt.select("race", (F.col("_l") + F.col("_w") * (above - F.lit(0.5))).alias("t"))
    xs = [f"x{j}" for j in range(p)]
    parts = F.ceil(F.col("n") / PART)
    rows = heats.join(tilt, "race").withColumn("part", F.pmod(F.xxhash64("id"), parts))
    sums = [F.sum(F.col("y") * F.col("_u")).alias("uw"), *[F.sum(F.col("y") * F.col(x)).alias(f"xw_{j}") for j, x in enumerate(xs)]]
    runner = F.struct((F.col("_u") - F.col("t")).alias("u"), F.array(*xs).alias("x"))
    groups = rows.groupBy("race", "part").agg(F.first("k").alias("k"), F.first("t").alias("t"), *sums, F.collect_list(runner).alias("m"))
    kept = ["uw", *[f"xw_{j}" for j in range(p)]]

    def multiply(batches):
        for b in batches:
            out = []
            for k, m in zip(b.column("k").to_pylist(), b.column("m"), strict=True):
                flat = m.values
                out.append(_packed(_product(_leaves(flat.field("u").to_numpy(), flat.field("x").flatten().to_numpy().reshape(-1, p)), k)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("race", "part", "k", "t", *kept)], pa.array(out, pa.binary())],
                                             names=["race", "part", "k", "t", *kept, "jet"])

    def join(batches):
        for b in batches:
            out = [_packed(_product([_unpacked(x, p) for x in jets], k))
                   for k, jets in zip(b.column("k").to_pylist(), b.column("jets").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("race", "part", "k", "t", *kept)], pa.array(out, pa.binary())],
                                             names=["race", "part", "k", "t", *kept, "jet"])

    kind = dict(d.dtypes)["race"]
    shape = f"race {kind}, part bigint, k bigint, t double, {', '.join(f'{c} double' for c in kept)}, jet binary"
    groups = groups.select("race", "part", F.col("k").cast("long").alias("k"), "t", *kept, "m")
    jets = groups.mapInArrow(multiply, shape)
    for _ in range(2):  # FAN parts to one, then whatever is left of a race
        up = F.floor(F.col("part") / FAN) if _ == 0 else F.lit(0).cast("long")
        jets = jets.withColumn("part", up).groupBy("race", "part").agg(
            F.first("k").alias("k"), F.first("t").alias("t"), *[F.sum(c).alias(c) for c in kept], F.collect_list("jet").alias("jets")).mapInArrow(join, shape)

    def solve(batches):
        names = ["ll", *[f"g_{j}" for j in range(p)], *[f"h_{j}_{l}" for j in range(p) for l in range(j, p)]]
        for b in batches:
            out = []
            for r in b.to_pylist():
                v, g, h, s = _unpacked(r["jet"], p)
                k = r["k"]
                mean = g[k] / v[k]
                curve = h[k] / v[k] - np.outer(mean, mean)
                out.append([r["uw"] - (np.log(v[k]) + s + k * r["t"]), *[r[f"xw_{j}"] - mean[j] for j in range(p)],
                            *[curve[j, l] for j in range(p) for l in range(j, p)]])
            cells = np.array(out, float).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cells.T], names=names)

    out_schema = "ll double, " + ", ".join(f"g_{j} double" for j in range(p)) + ", " + ", ".join(
        f"h_{j}_{l} double" for j in range(p) for l in range(j, p))
    return jets.mapInArrow(solve, out_schema)


def fit_conditional_logit(df: DataFrame, features: list[str], y: str = "is_winner", race: str = "race_id",
                          max_iter: int = 50, tol: float = 1e-10, start: list[float] | None = None) -> ChoiceFit:
    p = len(features)
    # reliable cut: every iteration re-reads it, and rows keep the ids that deal them into parts
    d = written(_prepare(df, features, y, race).withColumn("id", F.monotonically_increasing_id()), "races")
    # a feature with no variation inside any race cancels out of every softmax: not identifiable
    spread = d.groupBy("race").agg(*[(F.max(f"x{j}") - F.min(f"x{j}")).alias(f"r{j}") for j in range(p)]) \
        .agg(*[F.max(f"r{j}").alias(f"r{j}") for j in range(p)]).collect()[0]
    if any(not spread[f"r{j}"] for j in range(p)):
        forget(d)
        nan = np.full(p, np.nan)
        return ChoiceFit(list(features), nan, np.full((p, p), np.nan), float("nan"), 0, 0, False)
    has_heats = not d.filter(F.col("k") >= 2).isEmpty()
    beta = np.zeros(p) if start is None else np.array(start, dtype=float)
    before = beta
    hist, converged, it = [], False, 0
    g = np.zeros(p)
    h = np.eye(p)
    ll = float("nan")
    n_races = 0
    for it in range(1, max_iter + 1):
        row = _single_winner_terms(d, beta, p).collect()[0].asDict()
        n_races = int(row["n_races"] or 0)
        ll = float(row["ll"] or 0.0)
        g = np.array([float(row[f"g_{j}"] or 0.0) for j in range(p)])
        h = np.zeros((p, p))
        for j in range(p):
            for l in range(j, p):
                h[j, l] = h[l, j] = float(row[f"h_{j}_{l}"] or 0.0)
        if has_heats:
            extra = _dead_heat_terms(d, beta, p).agg(
                F.sum("ll").alias("ll"), F.count(F.lit(1)).alias("n"),
                *[F.sum(f"g_{j}").alias(f"g_{j}") for j in range(p)],
                *[F.sum(f"h_{j}_{l}").alias(f"h_{j}_{l}") for j in range(p) for l in range(j, p)],
            ).collect()[0].asDict()
            ll += float(extra["ll"] or 0.0)
            n_races += int(extra["n"] or 0)
            g += np.array([float(extra[f"g_{j}"] or 0.0) for j in range(p)])
            for j in range(p):
                for l in range(j, p):
                    h[j, l] += float(extra[f"h_{j}_{l}"] or 0.0)
                    h[l, j] = h[j, l]
        if hist and not ll >= hist[-1] - 1e-9 * abs(hist[-1]):  # the likelihood fell: go half the way
            beta = (beta + before) / 2
            continue
        hist.append(ll)
        try:
            step = np.linalg.solve(h, g)
        except np.linalg.LinAlgError:  # features that depend on each other: no estimate
            forget(d)
            nan = np.full(p, np.nan)
            return ChoiceFit(list(features), nan, np.full((p, p), np.nan), ll, it, n_races, False, hist)
        before, beta = beta, beta + step
        if np.max(np.abs(step)) < tol:
            converged = True
            break
    forget(d)
    cov = np.linalg.inv(h)
    return ChoiceFit(list(features), beta, cov, ll, it, n_races, converged, hist)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def coefficient_row(fit: ChoiceFit, model: str, names: dict[str, str]) -> dict:
    """One result row: model, {name}_{hat,z_stat,se,ci_lower,ci_upper,p_val} per feature."""
    row = {"model": model}
    if not fit.converged:  # no maximum (e.g. separation): report no estimate rather than the last iterate
        return row
    for j, f in enumerate(fit.features):
        b, se = float(fit.params[j]), float(fit.se[j])
        z = b / se if se > 0 else float("nan")
        tag = names.get(f, f)
        row.update({f"{tag}_hat": b, f"{tag}_z_stat": z, f"{tag}_se": se, f"{tag}_ci_lower": b - Z975 * se,
                    f"{tag}_ci_upper": b + Z975 * se, f"{tag}_p_val": normal_two_sided(z)})
    return row


def coefficient_table(spark: SparkSession, rows: list[dict], tags: list[str]) -> DataFrame:
    cols = ["model"] + [f"{t}_{m}" for t in tags for m in ("hat", "z_stat", "se", "ci_lower", "ci_upper", "p_val")]
    schema = "model string, " + ", ".join(f"{c} double" for c in cols[1:])
    data = [tuple([r.get("model")] + [r.get(c) for c in cols[1:]]) for r in rows]
    return spark.createDataFrame(data, schema)


def choice_probabilities(df: DataFrame, features: list[str], beta, race: str = "race_id",
                         out: str = "cl_prob") -> DataFrame:
    """Per-race softmax of x . beta (max-shifted, so large utilities cannot overflow)."""
    u = sum((F.lit(float(b)) * F.col(f).cast("double") for f, b in zip(features, beta)), F.lit(0.0))
    d = df.withColumn("_u", u)
    d = with_group_stats(d, race, F.max("_u").alias("_umax"))
    d = d.withColumn("_e", F.exp(F.col("_u") - F.col("_umax")))
    d = with_group_stats(d, race, F.sum("_e").alias("_esum"))
    return d.withColumn(out, F.col("_e") / F.col("_esum")).drop("_u", "_umax", "_e", "_esum")
