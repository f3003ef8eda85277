"""Stage 7b: pick a runner per race, stake it, settle it, summarise strategies.

A pick per race is an aggregate, not a window: ``min(struct(key, tiebreak,
payload...))`` grouped by race is combined map-side, so a huge race is
reduced in pieces.  Several strategies are evaluated in one pass by stacking
their scores into a long (strategy, runner) table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.odds import expected_value, kelly_fraction, settle
from paddock.operators.common import round_to, with_group_stats

DEFAULT_CARRY = ("sp", "is_winner", "date", "split")


def random_key(race: str, entity: str, seed: int) -> Column:
    """Deterministic pseudo-random order of runners within a race."""
    return F.md5(F.concat_ws("-", F.col(race).cast("string"), F.col(entity).cast("string"), F.lit(str(seed))))


def pick_per_race(df: DataFrame, key: Column, prob: str, race: str = "race_id", entity: str = "horse_id",
                  carry: Sequence[str] = DEFAULT_CARRY, by: Sequence[str] = ()) -> DataFrame:
    """One row per race (and per ``by``): smallest ``key``, ties to the smallest entity id.
    A runner without a score is never picked; a race without any has no row."""
    df = df.where(F.col(prob).isNotNull())
    payload = [F.col(entity).alias(entity), F.col(prob).alias("prob")] + [F.col(c).alias(c) for c in carry]
    best = F.min(F.struct(key.alias("_k"), *payload)).alias("_best")
    out = df.groupBy(*by, race).agg(best)
    return out.select(*by, race, *[F.col(f"_best.{c}").alias(c) for c in [entity, "prob", *carry]])


def favourite_per_race(df: DataFrame, prob: str = "sp_win_prob", **kw) -> DataFrame:
    """Runner with the highest probability in each race (first row wins ties)."""
    return pick_per_race(df, -F.col(prob), prob, **kw)


def random_per_race(df: DataFrame, prob: str = "uniform_prob", seed: int = 42, race: str = "race_id",
                    entity: str = "horse_id", **kw) -> DataFrame:
    return pick_per_race(df, random_key(race, entity, seed), prob, race=race, entity=entity, **kw)


def uniform_probability(df: DataFrame, race: str = "race_id", out: str = "uniform_prob") -> DataFrame:
    """1 / number of runners in the race."""
    df = with_group_stats(df, race, F.count(F.lit(1)).alias("_n_in_race"))
    return df.withColumn(out, F.lit(1.0) / F.col("_n_in_race")).drop("_n_in_race")


def place_bets(picks: DataFrame, prob: str = "prob", odds: str = "sp", won: str = "is_winner",
               threshold: float = 0.15, staking: str = "kelly", stake: float = 1.0) -> DataFrame:
    """EV gate, stake and settle each pick.

    staking="kelly": wager = stake * max((d p - 1)/(d - 1), 0) when EV > threshold
    staking="flat" : wager = stake when EV > threshold
    """
    ev = expected_value(prob, odds)
    size = kelly_fraction(prob, odds) * F.lit(stake) if staking == "kelly" else F.lit(float(stake))
    out = picks.withColumn("expected_value", ev).withColumn(
        # the gate reads EV at 1e-9 resolution: a sum taken in another order (another
        # partitioning, another engine) must not flip a bet that sits exactly on the threshold
        "wager", F.when(round_to(F.col("expected_value"), 9) > F.lit(threshold), size).otherwise(F.lit(0.0))
    )
    return out.withColumn("pnl", settle("wager", odds, won))


def strategy_stats(bets: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """pnl, number of bets (wager > 0), ROI = pnl / total wagered (0 when nothing wagered)."""
    return bets.groupBy(*by).agg(
        F.sum("pnl").alias("pnl"),
        F.count_if(F.col("wager") > 0).alias("num_bets"),
        F.sum("wager").alias("total_wagered"),
    ).withColumn(
        "roi", F.coalesce(F.try_divide(F.col("pnl"), F.when(F.col("total_wagered") != 0, F.col("total_wagered"))), F.lit(0.0))
    )


def equity_curve(bets: DataFrame, by: Sequence[str] = ("strategy",), date: str = "date") -> DataFrame:
    """Cumulative PnL in date order.  Bets are summed per day first, so the
    running-sum window sees one row per (strategy, day), never one per bet."""
    daily = bets.groupBy(*by, date).agg(F.sum("pnl").alias("daily_pnl"), F.count_if(F.col("wager") > 0).alias("n_bets"))
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cum_pnl", F.sum("daily_pnl").over(w))


def backtest(df: DataFrame, strategies: Mapping[str, tuple[str, str]], threshold: float = 0.15,
             staking: str = "kelly", stake: float = 1.0, seed: int = 42, race: str = "race_id",
             entity: str = "horse_id", carry: Sequence[str] = DEFAULT_CARRY) -> DataFrame:
    """Evaluate several strategies in one pass.

    ``strategies`` maps a name to (probability column, rule) with rule
    "argmax" (bet the most likely runner) or "random" (bet a seeded random
    runner).  Returns one settled pick per (strategy, race).
    """
    # argmax and random keys have different types: keep two key slots
    stacked = []
    for name, (prob, rule) in strategies.items():
        kd = (-F.col(prob)).cast("double") if rule == "argmax" else F.lit(0.0)
        ks = random_key(race, entity, seed) if rule == "random" else F.lit("")
        stacked.append(F.struct(F.lit(name).alias("strategy"), F.col(prob).cast("double").alias("_p"),
                                kd.alias("_kd"), ks.alias("_ks")))
    long = df.select(race, entity, *carry, F.explode(F.array(*stacked)).alias("_s")).select(
        race, entity, *carry, "_s.strategy", F.col("_s._p").alias("_p"), "_s._kd", "_s._ks"
    )
    picks = pick_per_race(long, F.struct("_kd", "_ks"), "_p", race=race, entity=entity, carry=carry,
                          by=("strategy",))
    return place_bets(picks, "prob", threshold=threshold, staking=staking, stake=stake)
