"""The whole study on one panel: topic flags -> lagged features -> feature
selection -> text classifiers -> conditional logit with market and text
signals -> Brier tests -> Kelly back-test of four strategies.

Every step is a DataFrame plan; only fitted parameters (a few numbers per
model), the selected feature list (<= K names) and result tables reach the
driver.  Flags reproduce the reference's choices where they differ from the
sound default:

* ``clip_logit``      clip the text logit (not the probability) to [1e-12, 1 - 1e-12]
* ``refit_on_union``  refit the classifier on train + validation before calibrating on validation
"""

from __future__ import annotations

import warnings

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.odds import PROB_EPS, clip_prob
from paddock.operators import betting, choice as CH, features as FT, isotonic as ISO, models as MD, stats as ST
from paddock.operators.common import forget, with_group_stats, written


def race_normalised_logit(df: DataFrame, prob: str, out_prob: str, out_logit: str, race: str = "race_id",
                          clip_logit: bool = False) -> DataFrame:
    """p / sum(p) per race, clipped, and its logit (optionally the reference's clip of the logit itself)."""
    d = with_group_stats(df, race, F.sum(prob).alias("_ps"))
    p = clip_prob(F.try_divide(F.col(prob), F.col("_ps")))
    lg = F.ln(p / (F.lit(1.0) - p))
    if clip_logit:
        lg = F.greatest(F.lit(PROB_EPS), F.least(F.lit(1.0 - PROB_EPS), lg))
    return d.withColumn(out_prob, p).withColumn(out_logit, lg).drop("_ps")


def selected_topics(tests: DataFrame, p_col: str = "pval_lag1_train", alpha: float = 0.05) -> list[int]:
    """Indices of significant topics (at most K rows reach the driver)."""
    return sorted(int(r["topic"].split("_")[1]) for r in ST.significant_features(tests, p_col, alpha).collect())


def select_flags(col: str, idx: list[int]) -> Column:
    return F.array(*[F.col(col)[i] for i in idx])


@dataclass
class Study:
    panel: DataFrame            # panel with model probabilities
    tests: DataFrame            # chi-squared / correlation per topic
    selected: list[int]
    coefficients: DataFrame
    classifier_tests: DataFrame
    brier_tests: DataFrame
    bets: DataFrame


def run_study(spark: SparkSession, panel: DataFrame, n_topics: int, topics: str = "topics",
              clip_logit: bool = False, refit_on_union: bool = False, threshold: float = 0.15, spent: Sequence[DataFrame] = ()) -> Study:
    """``panel``: clean panel with a K-flag ``topics`` array per runner; ``spent``: written tables behind it that nothing
    else reads. A stage is removed as soon as the next one is written; the results read the last."""
    df = FT.lag_features(panel, [topics], max_lag=1)
    lag = f"{topics}_lag_1"
    train = df.filter(F.col("split") == "train")
    tests = written(ST.topic_tests(train, {0: topics, 1: lag}, n_topics), "tests")
    sel = selected_topics(tests)
    if not sel:
        warnings.warn("no topic is significant; the text models use all of them", stacklevel=2)
        sel = list(range(n_topics))
    df = lagged = written(df.withColumn("_x", select_flags(lag, sel)).drop(topics, lag), "lagged")  # reliable cut before the model fits
    for table in spent:
        forget(table)
    train = df.filter(F.col("split") == "train")
    val = df.filter(F.col("split") == "val")

    nb = MD.fit_bernoulli_nb(train.unionByName(val) if refit_on_union else train, "_x", "is_winner")
    # the flags have done their work: what follows moves rows without them, scored once
    df = plain = written(df.withColumn("nb_prob", nb.predict_proba(F.col("_x"))).drop("_x"), "nb")
    forget(lagged)
    iso = ISO.fit_isotonic(df.filter(F.col("split") == "val"), "nb_prob", "is_winner")
    df = ISO.calibrate(iso, df, "nb_prob", "calibrated_nb_prob")

    text_models = ["nb", "calibrated_nb"]
    for m in text_models:
        df = race_normalised_logit(df, f"{m}_prob", f"{m}_win_prob", f"logit_{m}_win_prob", clip_logit=clip_logit)
    df = scores = written(df, "scored")
    forget(plain)
    train = df.filter(F.col("split") == "train")

    base = CH.fit_conditional_logit(train, ["logit_sp_win_prob"])
    rows = [CH.coefficient_row(base, "baseline", {"logit_sp_win_prob": "beta"})]
    df = CH.choice_probabilities(df, ["logit_sp_win_prob"], base.params, out="cl_baseline")
    fitted = {}
    for m in text_models:
        fitted[m] = fit = CH.fit_conditional_logit(train, ["logit_sp_win_prob", f"logit_{m}_win_prob"])
        rows.append(CH.coefficient_row(fit, m, {"logit_sp_win_prob": "beta", f"logit_{m}_win_prob": "gamma"}))
        df = CH.choice_probabilities(df, ["logit_sp_win_prob", f"logit_{m}_win_prob"], fit.params, out=f"cl_{m}")
    coefs = CH.coefficient_table(spark, rows, ["beta", "gamma"])
    df = written(betting.uniform_probability(df), "chosen")
    forget(scores)

    val = df.filter(F.col("split") == "val")
    ct = None
    for m in text_models:
        t = ST.brier_vs_uniform(val, f"{m}_prob", n_tests=len(text_models)).select(F.lit(m).alias("model"), "*")
        ct = t if ct is None else ct.unionByName(t)
    bt = None
    for m in text_models:
        scored = val.withColumn("b_base", ST.brier("cl_baseline", "is_winner")).withColumn(
            "b_new", ST.brier(f"cl_{m}", "is_winner") if fitted[m].converged else F.lit(None).cast("double"))  # no fit, no test
        t = ST.paired_t_test(scored, "b_base", "b_new").select(
            F.lit(m).alias("model"), "n", "t_stat", "p_val_one_sided", F.col("mean_diff").alias("mean_brier_diff"),
            "se", "ci_lower", "ci_upper")
        bt = t if bt is None else bt.unionByName(t)

    strategies = {"random": ("uniform_prob", "random"), "text": ("nb_win_prob", "argmax"),
                  "market": ("cl_baseline", "argmax"), "full": ("cl_nb", "argmax")}
    bets = betting.backtest(df.filter(F.col("split") == "test"), strategies, threshold=threshold, staking="kelly")
    return Study(df, tests, sel, coefs, ct, bt, bets)
