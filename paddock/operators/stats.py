"""Stage 5 and the model comparisons: contingency tables, chi-squared,
correlation, paired t-tests, Brier and log scores.

Every test is one aggregation pass producing a handful of sums (combined
map-side), followed by closed-form arithmetic on a one-row or K-row table.
Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.stats import bonferroni, chi2_sf_1, normal_cdf, one_sided_from_two, t_two_sided_p
from paddock.operators.common import round_to

PROB_EPS = 1e-12


def feature_label_sums(df: DataFrame, arrays: dict[int, str], n_topics: int, label: str = "is_winner") -> DataFrame:
    """One row per (lag, topic): n, sum y, sum y^2, sum x, sum x^2, sum x*y.

    ``arrays`` maps a lag to an array column of K values. Only non-zero entries become rows, which
    combine map-side into K sums per lag; zeros add nothing."""
    y = F.col(label).cast("double")
    entry = F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(c).cast("array<double>").alias("x")) for lag, c in arrays.items()])
    cells = (df.select(y.alias("y"), F.explode(entry).alias("e")).select("y", "e.lag", F.posexplode("e.x").alias("i", "x"))
             .where("x <> 0").groupBy("lag", "i")
             .agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy")))
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
    lags = F.explode(F.array(*[F.lit(lag) for lag in arrays])).alias("lag")
    grid = whole.select("n", "sy", "syy", lags).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_topics - 1))))
    zero = F.lit(0.0)
    return grid.join(cells, ["lag", "i"], "left").select("lag", "i", "n", "sy", "syy", *[
        F.coalesce(c, zero).alias(c) for c in ("sx", "sxx", "sxy")])


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from sums; null when either side is constant."""
    num = n * sxy - sx * sy
    den = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.try_divide(num, F.when(den > 0, den))


def yates_chi2(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    """Chi-squared with Yates' continuity correction for a binary feature x binary label.

    Each |O - E| is reduced by min(0.5, |O - E|).  Null when the table has a
    single row or column.
    """
    cells = [
        (sxy, sx, sy),
        (sx - sxy, sx, n - sy),
        (sy - sxy, n - sx, sy),
        (n - sx - sy + sxy, n - sx, n - sy),
    ]
    stat = None
    for obs, row, col in cells:
        exp = row * col / n
        dev = F.greatest(F.abs(obs - exp) - F.lit(0.5), F.lit(0.0))
        term = dev * dev / exp
        stat = term if stat is None else stat + term
    degenerate = (sx <= 0) | (sx >= n) | (sy <= 0) | (sy >= n)
    return F.when(degenerate, F.lit(None).cast("double")).otherwise(stat)


def topic_tests(df: DataFrame, arrays: dict[int, str], n_topics: int, label: str = "is_winner",
                prefix: str = "topic_") -> DataFrame:
    """Chi-squared (Yates) and Pearson r of each topic flag against the label.

    ``arrays`` maps a lag (0, 1, ...) to an array column of K binary flags.
    Output, one row per topic:
    topic, pval_lag{L}_train, pval_lag{L}_train_corrected, corr_lag{L}_train, chi2_lag{L}_train.
    """
    sums = feature_label_sums(df, arrays, n_topics, label)
    n, sy, syy = F.col("n").cast("double"), F.col("sy"), F.col("syy")
    sx, sxx, sxy = F.col("sx"), F.col("sxx"), F.col("sxy")
    # the p-value is computed once per row, before the lags become columns
    per = sums.select("lag", "i", yates_chi2(n, sx, sy, sxy).alias("stat"),
                      round_to(pearson(n, sx, sy, sxx, syy, sxy), 4).alias("r"))
    per = per.withColumn("p", chi2_sf_1(F.col("stat")))
    wide = []
    for lag in arrays:
        at = lambda c, lag=lag: F.max(F.when(F.col("lag") == lag, F.col(c)))
        wide += [at("stat").alias(f"chi2_lag{lag}_train"), at("p").alias(f"pval_lag{lag}_train"),
                 bonferroni(at("p"), n_topics).alias(f"pval_lag{lag}_train_corrected"), at("r").alias(f"corr_lag{lag}_train")]
    return per.groupBy("i").agg(*wide).withColumn("topic", F.concat(F.lit(prefix), F.col("i").cast("string"))).select(
        "topic", *[c for lag in arrays for c in (f"chi2_lag{lag}_train", f"pval_lag{lag}_train",
                                                 f"pval_lag{lag}_train_corrected", f"corr_lag{lag}_train")])


def contingency(df: DataFrame, arrays: dict[int, str], n_topics: int, label: str = "is_winner") -> DataFrame:
    """Long contingency table: topic, lag, feature value, label, count (binary flags)."""
    sums = feature_label_sums(df, arrays, n_topics, label)
    sx, sxy, sy, n = F.col("sx"), F.col("sxy"), F.col("sy"), F.col("n")
    cells = F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(y).alias("label"), c.cast("long").alias("n"))
                      for x, y, c in ((1, 1, sxy), (1, 0, sx - sxy), (0, 1, sy - sxy), (0, 0, n - sx - sy + sxy))])
    return sums.select(F.col("i").alias("topic"), "lag", F.explode(cells).alias("c")).select("topic", "lag", "c.*")


def significant_features(tests: DataFrame, p_col: str = "pval_lag1_train", alpha: float = 0.05) -> DataFrame:
    return tests.filter(F.col(p_col) < alpha).select("topic")


# ------------------------------------------------------------------ paired tests

def paired_t_test(df: DataFrame, a: str | Column, b: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Paired t-test of a - b (per group in ``by``), one-sided towards a > b.

    Columns: n, mean_diff, sd, se, t_stat, p_value_two_sided, p_val_one_sided, ci_lower, ci_upper.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    d = (a - b).cast("double")
    agg = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    t = F.try_divide(F.col("mean_diff"), F.when(se > 0, se))
    out = agg.withColumn("se", se).withColumn("t_stat", t)
    out = out.withColumn("p_value_two_sided", t_two_sided_p(F.col("t_stat"), F.col("n") - 1))
    out = out.withColumn("p_val_one_sided", one_sided_from_two(F.col("p_value_two_sided"), F.col("mean_diff")))
    return (out.withColumn("ci_lower", F.col("mean_diff") - F.lit(1.96) * F.col("se"))
               .withColumn("ci_upper", F.col("mean_diff") + F.lit(1.96) * F.col("se")))


def brier_binary_sum(p: str | Column, y: str | Column) -> Column:
    """Two-class Brier, summed over both classes: 2 (p - y)^2."""
    p = F.col(p) if isinstance(p, str) else p
    y = F.col(y) if isinstance(y, str) else y
    return (p - y) * (p - y) + ((F.lit(1.0) - p) - (F.lit(1.0) - y)) * ((F.lit(1.0) - p) - (F.lit(1.0) - y))


def brier(p: str | Column, y: str | Column) -> Column:
    """One-class Brier (p - y)^2."""
    p = F.col(p) if isinstance(p, str) else p
    y = F.col(y) if isinstance(y, str) else y
    return (p - y) * (p - y)


def brier_vs_uniform(df: DataFrame, p: str, y: str = "is_winner", by: Sequence[str] = (), n_tests: int = 1) -> DataFrame:
    """Paired t-test of uniform (1/2 each class) Brier minus model Brier, with Bonferroni."""
    scored = df.withColumn("_model", brier_binary_sum(p, y)).withColumn("_uniform", brier_binary_sum(F.lit(0.5), y))
    res = paired_t_test(scored, "_uniform", "_model", by)
    return res.select(*by, F.col("t_stat").alias("t_statistic"), F.col("p_val_one_sided").alias("p_value"),
                      bonferroni(F.col("p_val_one_sided"), n_tests).alias("p_value_bonferroni"),
                      F.col("mean_diff").alias("mean_brier_diff"), "n")


def logscore_test(df: DataFrame, pa: str, pb: str, y: str = "is_winner", alpha: float = 0.05,
                  by: Sequence[str] = ()) -> DataFrame:
    """One-sided z-test that model a has the better log score on the winners.

    mean_logscore_diff = -mean(log pa - log pb) over winning rows (clipped).
    """
    def clip(c):
        return F.greatest(F.lit(PROB_EPS), F.least(F.lit(1 - PROB_EPS), F.col(c)))

    r = F.ln(clip(pa)) - F.ln(clip(pb))
    agg = df.filter(F.col(y) == 1).groupBy(*by).agg(
        F.count(r).alias("n"), (-F.avg(r)).alias("mean_logscore_diff"), F.stddev_samp(r).alias("_sd"))
    se = F.col("_sd") / F.sqrt(F.col("n").cast("double"))
    out = agg.withColumn("standard_error", se).withColumn(
        "z_statistic", F.try_divide(F.col("mean_logscore_diff"), F.when(se > 0, se)))
    out = out.withColumn("p_value", normal_cdf(F.col("z_statistic")))
    return out.select(*by, "n", "mean_logscore_diff", "standard_error", "z_statistic", "p_value",
                      F.lit(alpha).alias("alpha"), (F.col("p_value") < alpha).alias("reject_null"))


def log_loss(df: DataFrame, p: str, y: str = "is_winner", by: Sequence[str] = (), eps: float = PROB_EPS) -> DataFrame:
    pc = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    yy = F.col(y).cast("double")
    ll = -(yy * F.ln(pc) + (F.lit(1.0) - yy) * F.ln(F.lit(1.0) - pc))
    return df.groupBy(*by).agg(F.avg(ll).alias("log_loss"), F.count(F.lit(1)).alias("n"))
