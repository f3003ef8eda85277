import math

import duckdb
import numpy as np

from pyspark.sql import functions as F

from paddock.llm import topk


def brute(rows, wanted, k=5):
    vectors = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for own, (i, q) in enumerate(vectors):
        if wanted(i):
            best = sorted((-sum(a * b for a, b in zip(q, w)), j) for at, (j, w) in enumerate(vectors) if at != own and len(w) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, **options)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_matches_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in np.round(rng.normal(0, 0.3, 6), 1)], 1) for i in range(120)]
    rows += [(i, rows[0][1], 1) for i in range(120, 170)]  # one vector shared by many
    rows += [(200, None, 1), (205, [], 1), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (215, [float("nan")] * 6, 1),
             (220, [float("inf")] + [0.0] * 5, 1), (225, [0.0] * 6, 1), (230, [1.0, 2.0], 1), (235, [1.0, -2.0], 1), (None, [1.0] * 6, 1),
             (3, [9.0] * 6, 1), (0, rows[0][1], 1)]
    want = brute([(i, v) for i, v, _ in rows], lambda i: i % 5 == 0)
    assert run(spark, rows, block=17, query_block=7) == want
    assert run(spark, rows) == want


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [1.0], 1), (5, [2.0], 1), (7, [-1.0], 1)]
    assert run(spark, rows) == brute([(i, v) for i, v, _ in rows], lambda i: i % 5 == 0)
    assert run(spark, [(0, [1.0], 1)]) == []
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 5 == 0).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1.0e7, 1.0], 1), (1, [1.0e7, 2.0], 1), (2, [1.0e7, 3.0], 1)]
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows], lambda i: i % 5 == 0)
    got = run(spark, rows)
    assert got == want


def test_stops_early_on_structured_lists():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(0, 0.02, (4000, 8)))
    vectors[:20] += 200  # a few clearly better candidates
    lists = topk.Lists(np.arange(4000), np.arange(4000), vectors)
    ids, scores, depth = lists.search(np.full(8, 100.0), -1, 5)
    want = sorted((-s, i) for i, s in enumerate(vectors @ np.full(8, 100.0)))[:5]
    assert [(-s, i) for s, i in zip(scores, ids)] == [(s, i) for s, i in want]
    assert depth < 400


def test_rows_that_repeat_an_id_and_the_twin(spark, tmp_path):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [0.5, 0.5]), (50, [2.0, 2.0]), (50, [2.0, 2.0]),
            (50, None), (100, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in topk.op2_topk_search(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == brute(rows, lambda i: i % 50 == 0) == sorted(con.execute(topk.OP2_SQL).fetchall())
    assert (50, 1, 50, 512 * 512 * 2) in got and len([r for r in got if r[0] == 50]) == 10
