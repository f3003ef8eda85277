"""Stage 4: per-entity history features and per-race transforms.

Lag and rolling features read only earlier rows of the same entity in
(date, group) order, so no feature sees the current race.

Skew: the entity window is partitioned by (entity, bucket).  Ordinary
entities have one bucket, i.e. the plain window.  The rows of entities with at
least ``hot_rows`` rows (found by a map-side-combined count; the list is at most
N / hot_rows long and its size is checked before broadcasting) are
range-partitioned by (entity, date, group) into segments of about
``hot_rows`` / 2 rows, also within one day, and written; a segment of an
entity is a bucket. The last ``L`` values before each bucket come from a tail
table of at most L rows per bucket and are joined back, so no task holds more
than one segment (rows of an entity that tie in date and group share one).
A null entity is unknown: its rows have no history, and are spread by (date, group).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.common import with_group_stats, written

DEFAULT_HOT_ROWS = 5_000_000
BROADCAST_LIMIT = 1_000_000

# fixed values: price bands of the interaction features
LONGSHOT_MAX = 0.05
SURESHOT_MIN = 0.5
BANDS = ("longshot", "neither", "sureshot")


def select_by_regex(df: DataFrame, pattern: str) -> list[str]:
    """Column names matched by ``re.search`` (so ``^topic_\\d`` also matches lag columns)."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def _cols(df: DataFrame, cols: str | Sequence[str]) -> list[str]:
    return select_by_regex(df, cols) if isinstance(cols, str) else list(cols)


def _hot_entities(df: DataFrame, entity: str, hot_rows: int) -> tuple[DataFrame | None, int]:
    """The hot entities, if any, and the number of their rows."""
    counts = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") >= hot_rows)
    size = hot.agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("rows")).collect()[0]
    if not size["n"]:
        return None, 0
    hot = hot.select(entity, F.lit(True).alias("_hot"))
    return F.broadcast(hot) if size["n"] <= BROADCAST_LIMIT else hot, size["rows"]


def _spread_unknown(entity: str, order: Sequence[str]) -> Column:
    return F.when(F.col(entity).isNull(), F.xxhash64(*order)).otherwise(F.lit(0).cast("long"))


def previous_values(df: DataFrame, cols: Sequence[str], max_lag: int, entity: str = "horse_id",
                    order: Sequence[str] = ("date", "race_id"), hot_rows: int = DEFAULT_HOT_ROWS,
                    prefix: str = "_prev") -> DataFrame:
    """Add ``{prefix}{k}_{col}`` = value of ``col`` k rows earlier for the entity, null if none."""
    hot, n_rows = _hot_entities(df, entity, hot_rows)
    ordering = [F.col(c).asc_nulls_last() for c in order]
    if hot is not None:
        df = df.join(hot, entity, "left")
        segments = df.where("_hot").repartitionByRange(1 + 2 * n_rows // hot_rows, F.col(entity), *ordering)
        # written: both uses below must see the same segments
        segments = written(segments.withColumn("_bucket", F.spark_partition_id().cast("long")), "segments")
        df = df.where("_hot is null").withColumn("_bucket", _spread_unknown(entity, order)).unionByName(segments)
    else:
        df = df.withColumn("_bucket", _spread_unknown(entity, order))
    w = Window.partitionBy(entity, "_bucket").orderBy(*ordering)
    df = df.withColumn("_pos", F.row_number().over(w))
    for c in cols:
        for k in range(1, max_lag + 1):
            df = df.withColumn(f"{prefix}{k}_{c}", F.when(F.col(entity).isNotNull(), F.lag(c, k).over(w)))
    if hot is None:
        return df.drop("_bucket", "_pos")

    # tails of hot buckets: last max_lag rows of each (entity, segment)
    hot_rows_df = df.filter(F.col("_hot"))
    cnt = F.count(F.lit(1)).over(Window.partitionBy(entity, "_bucket"))
    tails = hot_rows_df.withColumn("_cnt", cnt).filter(F.col("_pos") > F.col("_cnt") - max_lag)
    tw = Window.partitionBy(entity).orderBy("_bucket", "_pos").rowsBetween(-max_lag, -1)
    vals = F.struct(*[F.col(c).alias(c) for c in cols])
    carried = (tails.withColumn("_carry", F.collect_list(vals).over(tw))
               .filter(F.col("_pos") == F.greatest(F.col("_cnt") - max_lag + 1, F.lit(1)))
               .select(entity, "_bucket", "_carry"))
    df = df.join(carried, [entity, "_bucket"], "left")
    size = F.size(F.coalesce(F.col("_carry"), F.array()))
    for c in cols:
        for k in range(1, max_lag + 1):
            idx = size - F.lit(k) + F.col("_pos")  # 1-based index of the (k - pos + 1)-th last carried row
            from_tail = F.when((idx >= 1), F.element_at(F.col("_carry"), idx.cast("int"))[c])
            name = f"{prefix}{k}_{c}"
            df = df.withColumn(name, F.when(F.col("_pos") > k, F.col(name)).otherwise(from_tail))
    return df.drop("_bucket", "_pos", "_hot", "_carry")


def lag_features(df: DataFrame, cols: str | Sequence[str], max_lag: int = 1, entity: str = "horse_id",
                 order: Sequence[str] = ("date", "race_id"), hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """``{col}_lag_{k}`` for k = 1..max_lag; no earlier row -> 0 (an array of zeros for arrays)."""
    cols = _cols(df, cols)
    out = previous_values(df, cols, max_lag, entity, order, hot_rows)
    for c in cols:
        dtype = dict(df.dtypes)[c]
        for k in range(1, max_lag + 1):
            prev = F.col(f"_prev{k}_{c}")
            if dtype.startswith("array"):
                zero = F.transform(F.col(c), lambda x: F.lit(0).cast(dtype[6:-1]))
                val = F.coalesce(prev, zero)
            else:
                val = F.coalesce(prev.cast("double"), F.lit(0.0))
            out = out.withColumn(f"{c}_lag_{k}", val).drop(f"_prev{k}_{c}")
    return out


def rolling_mean(df: DataFrame, cols: str | Sequence[str], window: int = 5, entity: str = "horse_id",
                 order: Sequence[str] = ("date", "race_id"), hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """``{col}_rollavg_{w}``: mean of the non-null values among the previous w rows, none -> 0."""
    cols = _cols(df, cols)
    if _hot_entities(df, entity, hot_rows)[0] is None:
        w = (Window.partitionBy(entity, _spread_unknown(entity, order)).orderBy(*[F.col(c).asc_nulls_last() for c in order])
             .rowsBetween(-window, Window.currentRow - 1))
        known = F.col(entity).isNotNull()
        return df.withColumns({f"{c}_rollavg_{window}": F.coalesce(F.when(known, F.avg(F.col(c).cast("double")).over(w)), F.lit(0.0))
                               for c in cols})
    out = previous_values(df, cols, window, entity, order, hot_rows, prefix="_roll")
    for c in cols:
        prev = [F.col(f"_roll{k}_{c}").cast("double") for k in range(1, window + 1)]
        total = sum((F.coalesce(p, F.lit(0.0)) for p in prev), F.lit(0.0))
        n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in prev), F.lit(0))
        out = out.withColumn(f"{c}_rollavg_{window}", F.coalesce(F.try_divide(total, F.when(n > 0, n)), F.lit(0.0)))
        out = out.drop(*[f"_roll{k}_{c}" for k in range(1, window + 1)])
    return out


def race_zscore(df: DataFrame, cols: str | Sequence[str], race: str = "race_id") -> DataFrame:
    """``{col}_z`` = (x - mean) / population sd within the race; 0 when sd = 0; null group stays null."""
    cols = _cols(df, cols)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    out = with_group_stats(df, race, *aggs)
    for c in cols:
        mu, sd = F.col(f"_mu_{c}"), F.col(f"_sd_{c}")
        z = F.when(sd.isNull(), F.lit(None).cast("double")).when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - mu) / sd)
        out = out.withColumn(f"{c}_z", z).drop(f"_mu_{c}", f"_sd_{c}")
    return out


def price_band(prob: str | Column = "sp_win_prob") -> Column:
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(p <= LONGSHOT_MAX, "longshot").when(p >= SURESHOT_MIN, "sureshot").otherwise("neither")


def band_interactions(df: DataFrame, cols: str | Sequence[str], prob: str = "sp_win_prob") -> DataFrame:
    """``{feature}_{band}`` = feature when the runner's band is ``band`` else 0, for the
    probability itself and each feature; all three bands always present (static schema)."""
    feats = [prob] + [c for c in _cols(df, cols) if c != prob]
    out = df.withColumn("sp_bet_type", price_band(prob))
    for b in BANDS:
        for f in feats:
            out = out.withColumn(f"{f}_{b}", F.when(F.col("sp_bet_type") == b, F.col(f).cast("double")).otherwise(F.lit(0.0)))
    return out


def expand_array(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """Array column -> one column per element (at the edge of the engine)."""
    return df.select(*[c for c in df.columns if c != col],
                     *[F.col(col)[i].alias(n) for i, n in enumerate(names)])


def category_flags(docs: DataFrame, col: str, categories: Sequence[str], out: str = "topics",
                   key: str = "doc_id") -> DataFrame:
    """0/1 topic vector from a categorical document attribute (stand-in topics)."""
    arr = F.array(*[(F.col(col) == F.lit(c)).cast("int") for c in categories])
    return docs.select(key, arr.alias(out))

