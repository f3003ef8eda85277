"""Costs that the driver found by growth: what a plan must not do, and that the cheaper form gives the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.functions.odds import fractional_to_decimal
from paddock.operators import common, embed as EM, isotonic as ISO, panel as P, text as TX
from paddock.plans import queries as Q
from paddock.sources import fixtures

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_rounding_is_not_nested(spark):
    df = spark.createDataFrame([(0.9894875,), (-0.0000004,), (-0.3,), (None,), (5e-7,), (1e16,)], "a double")
    out = common.round_doubles(df)
    got = [r["a"] for r in out.collect()]
    assert got == [0.989488, -4e-7, -0.3, None, 5e-7, 1e16]
    assert plan(out).split("== Physical Plan ==")[1].count("FLOOR") <= 3  # once per rounding, not once per mention


def test_zero_is_positive(spark):
    df = spark.createDataFrame([(-1e-14,), (-0.0,)], "a double")
    assert not any(np.signbit(r["a"]) for r in common.round_doubles(df).collect())


def test_terms_are_split_once(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (1, "a")], "doc_id long, text string")
    bow = TX.bag_of_words(TX.clean_documents(docs))
    assert plan(bow).split("== Physical Plan ==")[1].count("split(") == 1
    bow = TX.bag_of_words(docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("tokens")))
    assert sorted(map(tuple, bow.where("term <> ''").collect())) == [(1, "a", 2), (1, "b", 2)]


def test_mean_pool_moves_vectors_once_a_block(spark):
    weighted = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 6, 1), (None, 6, 4), (2, 99, 1), (3, None, 1), (3, 7, 1)],
                                     "doc_id long, vec_id long, n long")
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0]), (7, [2.0, 2.0]), (7, [4.0, 0.0]), (None, [9.0, 9.0]), (8, None)],
                                    "vec_id long, embedding array<float>")
    out = EM.mean_pool(weighted, vectors, pairs=2)
    assert "Aggregate" not in plan(out).split("== Physical Plan ==")[1].replace("HashAggregate(keys=[at", "")
    got = {r["doc_id"]: r["pooled"] for r in out.collect()}
    assert got == {1: [0.75, 0.25], None: [0.0, 1.0], 3: [3.0, 1.0]}


@pytest.mark.parametrize("limit", [ISO.BROADCAST_SCORES, 0])
def test_few_scores_are_not_dealt(spark, monkeypatch, limit):
    monkeypatch.setattr(ISO, "BROADCAST_SCORES", limit)
    rows = spark.createDataFrame([(i, [0.1, 0.1, 0.1, 0.4][i % 4], int(i % 3 == 0)) for i in range(40)], "i int, p double, y int")
    fit = ISO.fit_isotonic(rows, "p", "y")
    out = ISO.calibrate(fit, rows, "p", "c")
    assert ("BroadcastHashJoin" in plan(out)) or not limit
    want = {p: sum(i % 3 == 0 for i in range(40) if (i % 4 == 3) == (p == 0.4)) / (10 if p == 0.4 else 30) for p in (0.1, 0.4)}
    pooled = sum(i % 3 == 0 for i in range(40)) / 40 if want[0.1] > want[0.4] else None
    for r in out.collect():
        assert r["c"] == pytest.approx(pooled if pooled is not None else want[r["p"]])


def test_prices_are_searched_once_and_equal_the_definition(spark):
    raw = ["5/2", " 5 / 2 ", "EvsF", "evens", "x12\t/\t7F", "a/b", "3/0", "", "  ", None, "1/2/3", "9 9/4", "/4", "7/", "EV 1/1", "5/2 evens",
           "99999999999999999999/3"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, sp_raw string")
    out = P.parse_prices(df)
    want = df.withColumn("sp", fractional_to_decimal("sp_raw"))
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert plan(out).split("== Physical Plan ==")[1].count("regexp_extract") == 1


def test_the_panel_is_read_and_shuffled_once(spark, tmp_path, monkeypatch):
    rows = [(k // 3, k % 5, 1, k % 4, 4.0 + k % 9, 50.0 - k % 7, 0.1 if k % 11 == 0 else 0.0, 0.02, "A") for k in range(60)]
    rows = [(r[0], r[1], r[2], r[3], 49.0 if r[6] == 0.1 else r[4], *r[5:]) for r in rows]  # some without a price
    rows += [(None, 1, 1, 1, 5.0, 1.0, 0.0, 0.0, "N"), rows[0]]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"1998-01-{k + 1:02d}") for k in range(20)], "o_orderkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    raw = fixtures.panel_fixture(spark, str(tmp_path))
    once, joined = P.clean_panel(raw, together=True), P.clean_panel(raw)
    assert once.columns == joined.columns
    got, want = (sorted(map(str, x.collect())) for x in (once, joined))
    assert got == want and 0 < len(got) < 60
    shuffled = lambda df: plan(df).split("== Physical Plan ==")[1].count("REPARTITION_BY_COL")
    assert shuffled(P.clean_panel(raw, together=True)) == 1 and "lineitem" not in plan(Q.clean_fixture_panel(spark, str(tmp_path), "race_id"))
    # what a query asks of the panel is all that is written
    assert Q.clean_fixture_panel(spark, str(tmp_path), "race_id", "date").columns == ["race_id", "date"]
    hits = []
    monkeypatch.setattr(Q, "written", lambda df, name: hits.append((name, df)) or common.written(df, name))
    Q.REGISTRY["vector_join"](spark, SF)
    assert [(n, df.columns) for n, df in hits] == [("panel", ["race_id", "horse_id", "date", "comment_key"])]
    assert shuffled(hits[0][1].select("*")) == 1  # twice before, with different columns
