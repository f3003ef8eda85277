"""Stage 1: raw runner panel -> priced, labelled, split panel.

Columns in:  race_id, horse_id, date, sp_raw, pos (+ anything else, carried)
Columns out: + sp, n_runners, booksum, sp_win_prob, logit_sp_win_prob,
             is_winner, split
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.odds import EVENS_PREFIXES, FRACTION_PATTERN, clip_prob, logit, round_half_even
from paddock.operators.common import with_group_stats

# split cut dates of the source data (train before the first, val before the second)
REFERENCE_CUTS = ("2019-01-01", "2022-01-01")
# cut dates that split the driver's fixture panel sensibly
FIXTURE_CUTS = ("1999-01-01", "2000-06-01")


def parse_prices(df: DataFrame, raw_col: str = "sp_raw", out: str = "sp") -> DataFrame:
    """``fractional_to_decimal`` in steps, a column each: the pattern is searched for once a row, not three times."""
    s, found = F.col("_price"), F.col("_fraction")
    value = round_half_even(F.try_divide(F.substring_index(found, "/", 1).cast("double"), F.substring_index(found, "/", -1).cast("double")) + F.lit(1.0))
    evens = s.startswith(EVENS_PREFIXES[0]) | s.startswith(EVENS_PREFIXES[1])
    stepped = df.withColumn("_price", F.lower(F.trim(F.col(raw_col)))).withColumn("_fraction", F.regexp_extract("_price", FRACTION_PATTERN, 0))
    return stepped.withColumn(out, F.when(evens, F.lit(2.0)).when(found != "", value)).drop("_price", "_fraction")


def complete_races(df: DataFrame, race: str = "race_id", price: str = "sp", together: bool = False) -> DataFrame:
    """Keep races in which every runner has a price; null race keys are dropped.

    Adds ``n_runners`` and ``booksum`` (sum of 1/price) from the same aggregate. ``together``: the rows of a
    race already share a partition, sorted by race, as after a window over it; then another window over that order gives
    the same, and what made the rows is neither shuffled nor computed a second time for a join.
    """
    if together:
        w = Window.partitionBy(race)
        counted = df.withColumns({"n_runners": F.count(F.lit(1)).over(w), "_n_priced": F.count(price).over(w),
                                  "booksum": F.sum(F.lit(1.0) / F.col(price)).over(w)})
        counted = counted.filter(F.col(race).isNotNull() & (F.col("n_runners") == F.col("_n_priced")))
        return counted.select(race, *[c for c in df.columns if c != race], "n_runners", "booksum")
    stats = df.groupBy(race).agg(
        F.count(F.lit(1)).alias("n_runners"),
        F.count(price).alias("_n_priced"),
        F.sum(F.lit(1.0) / F.col(price)).alias("booksum"),
    )
    stats = stats.filter(F.col(race).isNotNull() & (F.col("n_runners") == F.col("_n_priced"))).drop("_n_priced")
    return df.join(stats, race, "inner")


def implied_probability(df: DataFrame, price: str = "sp", booksum: str = "booksum",
                        out: str = "sp_win_prob", race: str = "race_id") -> DataFrame:
    """Multiplicative margin removal: (1/price) / sum(1/price) over the race, clipped."""
    if booksum not in df.columns:
        df = with_group_stats(df, race, F.sum(F.lit(1.0) / F.col(price)).alias(booksum))
    return df.withColumn(out, clip_prob((F.lit(1.0) / F.col(price)) / F.col(booksum)))


def add_logit(df: DataFrame, prob: str = "sp_win_prob", out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"logit_{prob}", logit(prob))


def label_winner(df: DataFrame, pos: str = "pos", out: str = "is_winner") -> DataFrame:
    """1 when the finishing position string is exactly "1" (null -> 0)."""
    return df.withColumn(out, F.coalesce(F.col(pos).cast("string") == F.lit("1"), F.lit(False)).cast("int"))


def parse_date(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_date(c.cast("string"))


def assign_split(df: DataFrame, date: str = "date", cuts: Sequence[str] = REFERENCE_CUTS,
                 out: str = "split") -> DataFrame:
    """train before cuts[0], val before cuts[1], test after; null date -> null."""
    d = F.col(date)
    c1 = F.lit(_dt.date.fromisoformat(cuts[0]))
    c2 = F.lit(_dt.date.fromisoformat(cuts[1]))
    return df.withColumn(
        out, F.when(d < c1, "train").when(d < c2, "val").when(d >= c2, "test").otherwise(F.lit(None).cast("string"))
    )


def clean_panel(raw: DataFrame, cuts: Sequence[str] = REFERENCE_CUTS, raw_price: str = "sp_raw", together: bool = False) -> DataFrame:
    """Price parse -> complete-race filter -> implied probability -> logit -> label -> split."""
    df = parse_prices(raw, raw_price, "sp")
    df = complete_races(df, together=together)
    df = implied_probability(df)
    df = add_logit(df, "sp_win_prob")
    df = label_winner(df)
    if dict(df.dtypes)["date"] != "date":
        df = df.withColumn("date", parse_date("date"))
    return assign_split(df, "date", cuts)


def split_counts(df: DataFrame, split: str = "split", race: str = "race_id") -> DataFrame:
    """Distinct races and rows per split (null race keys excluded from the race count)."""
    return df.groupBy(split).agg(
        F.countDistinct(race).alias("n_races"), F.count(F.lit(1)).alias("n_rows")
    )


def entity_ids(df: DataFrame, entity: str = "horse", out: str = "horse_id", order: str = "row_id") -> DataFrame:
    """Dense ids by first appearance (1..n), null entity -> 0.

    The distinct entities are range-partitioned on their first ``order``
    value; ids are a per-partition row number plus the running count of the
    earlier partitions (a table with one row per partition), so no window
    ever runs without a partition key.
    """
    from pyspark.sql import Window

    first = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(order).alias("_first"))
    ranged = first.repartitionByRange("_first", entity).withColumn("_pid", F.spark_partition_id())
    ranged = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid").orderBy("_first", entity))
    ).checkpoint()
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_offset",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("_pid", "_offset")
    ids = ranged.join(F.broadcast(offsets), "_pid").select(
        entity, (F.col("_offset") + F.col("_local")).cast("long").alias(out)
    )
    return df.join(ids, entity, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))
