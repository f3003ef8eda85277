"""What a query leaves on disk while it runs, and what it sends to the driver."""

import os

import pytest
from pyspark.sql import functions as F

from paddock.operators import embed as EM, text as TX
from paddock.plans import queries as Q
from paddock.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


def stages(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("stage-")}


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test tables not present")
def test_the_study_keeps_its_last_stage_only(spark):
    before = stages(spark)
    out = Q.REGISTRY["study_classifier_tests"](spark, SF)
    left = sorted(n.split("-")[1] for n in stages(spark) - before)
    assert left == ["asked", "chosen", "knots", "tests"]
    assert {r["model"] for r in out.collect()} == {"nb", "calibrated_nb"}


def test_a_large_dictionary_moves_counts_twice(spark, monkeypatch):
    rows = [(d, f"t{(d * k) % 13}", 1 + (d + k) % 3) for d in range(20) for k in range(1, 6)] + [(None, "t1", 2), (3, "t1", 1)]
    bow = spark.createDataFrame(rows, "doc_id long, term string, n long")
    near = TX.tfidf_filter(bow, 0.3, n_docs=25)
    monkeypatch.setattr(TX, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(TX, "written", lambda df, name: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far = TX.tfidf_filter(bow, 0.3, n_docs=25)
        assert plan(far).count("Exchange hashpartitioning(doc_id") + plan(far).count("REPARTITION_BY_COL") <= 2
        assert plan(far).count("SortMergeJoin") == 1  # the counts are not joined to themselves
        rounded = lambda df: sorted((r["doc_id"], r["term"], r["n"], round(r["weight"], 9)) for r in df.collect())
        assert rounded(far) == rounded(near) and all(r["doc_id"] is not None for r in far.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_reach_the_driver_by_bytes(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "vec_id long, embedding array<float>")
    weighted = spark.range(40).select((F.col("id") % 5).alias("doc_id"), (F.col("id") % 9).alias("vec_id"), F.lit(1).alias("n"))
    limits = []
    monkeypatch.setattr(EM, "_maybe_broadcast", lambda df, limit=None: limits.append(limit) or df)
    out = EM.mean_pool(weighted, vectors)
    assert limits == [EM.BROADCAST_BYTES // 16] and "as array<double>" not in plan(out)
    got = {r["doc_id"]: r["pooled"] for r in out.collect()}
    for d in range(5):
        own = [i % 9 for i in range(40) if i % 5 == d and i % 9 < 8]
        assert got[d] == pytest.approx([sum(own) / len(own), 1.0])
