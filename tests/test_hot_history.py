import random

import pytest

from pyspark.sql import functions as F

from paddock.operators import features as FT


def plain(rows, lag):
    """{id: previous values, nearest first} by one sorted list per entity; an unknown entity has none."""
    out, seen = {}, {}
    for i, who, day, race, x in sorted(rows, key=lambda r: (r[2] is None, r[2] or "", r[3])):
        before = seen.setdefault(who, [])
        out[i] = [None] * lag if who is None else (before[::-1] + [None] * lag)[:lag]
        before.append(x)
    return out


def table(seed, one_day):
    rng = random.Random(seed)
    rows = []
    for race in range(400):
        day = "2020-01-01" if one_day else f"2020-01-{1 + race // 40:02d}"
        for who in (1, None, 2 + race % 7, 100 + race):
            rows.append((len(rows), who, day, race, rng.choice([None, rng.random()])))
    return rows


@pytest.mark.parametrize("one_day", [False, True])
@pytest.mark.parametrize("hot_rows", [30, 10_000])
def test_history_of_hot_and_unknown_entities(spark, one_day, hot_rows):
    rows = table(4, one_day)
    df = spark.createDataFrame(rows, "i int, horse_id int, date string, race_id int, x double")
    want = plain(rows, 3)
    got = FT.previous_values(df, ["x"], 3, hot_rows=hot_rows).collect()
    assert len(got) == len(rows)
    assert {r["i"]: [r[f"_prev{k}_x"] for k in (1, 2, 3)] for r in got} == want
    mean = {r["i"]: r["x_rollavg_3"] for r in FT.rolling_mean(df, ["x"], 3, hot_rows=hot_rows).collect()}
    for i, values in want.items():
        values = [v for v in values if v is not None]
        assert abs(mean[i] - (sum(values) / len(values) if values else 0.0)) < 1e-12
    lag = FT.lag_features(df, ["x"], 1, hot_rows=hot_rows).where(F.col("horse_id").isNull())
    assert {r["x_lag_1"] for r in lag.collect()} == {0.0}


def test_one_day_of_a_hot_entity_is_several_tasks(spark):
    df = spark.range(2000).select(F.lit(1).alias("horse_id"), F.lit("2020-01-01").alias("date"), F.col("id").alias("race_id"),
                                  F.col("id").cast("double").alias("x"))
    hot, n = FT._hot_entities(df, "horse_id", 200)
    assert hot.count() == 1 and n == 2000
    segments = df.repartitionByRange(1 + 2 * n // 200, "horse_id", "date", "race_id").groupBy(F.spark_partition_id().alias("p")).count()
    sizes = sorted(r["count"] for r in segments.collect())
    assert len(sizes) > 10 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = FT.previous_values(df, ["x"], 2, hot_rows=200)
    assert got.where("race_id >= 2 and (_prev1_x != race_id - 1 or _prev2_x != race_id - 2)").count() == 0
    assert got.where("_prev1_x is null").count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "horse_id int, date string, race_id int, x double")
    assert FT.lag_features(df, ["x"], 2).count() == 0 and FT.rolling_mean(df, ["x"]).count() == 0
