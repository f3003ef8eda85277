"""The fallback paths taken beyond the size limits give the same answers as the fast paths."""

from pyspark.sql import functions as F

from paddock.operators import embed as EM, text as TX


def test_lemma_join_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "horses raced the horse"), (2, "ponies and a pony raced")], "doc_id long, text string")
    long = TX.explode_terms(TX.clean_documents(docs))
    lemmas = TX.suffix_lemmas(long.select("term"))
    fast = sorted(tuple(r) for r in TX.apply_lemmas(long, lemmas).select("doc_id", "pos", "term").collect())
    monkeypatch.setattr(TX, "BROADCAST_ROWS", 0)
    slow = sorted(tuple(r) for r in TX.apply_lemmas(long, lemmas).select("doc_id", "pos", "term").collect())
    assert fast == slow
    assert ("horse" in {t for _, _, t in fast}) and ("horses" not in {t for _, _, t in fast})


def test_vector_join_without_broadcast(spark, monkeypatch):
    vec = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    rows = spark.createDataFrame([(10, 0), (11, 1), (12, 2)], "row long, key long")
    fast = sorted((r["row"], tuple(r["embedding"] or ())) for r in EM.attach_vectors(rows, vec, F.col("key")).collect())
    monkeypatch.setattr(EM, "BROADCAST_VECTORS", 0)
    slow = sorted((r["row"], tuple(r["embedding"] or ())) for r in
                  EM.attach_vectors(rows, vec, F.col("key")).collect())
    assert fast == slow == [(10, (1.0, 2.0)), (11, (3.0, 4.0)), (12, ())]
