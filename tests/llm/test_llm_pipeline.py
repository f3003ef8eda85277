"""The pipeline against brute-force versions of its stages on a small fixture."""

import random

import corpus_pipeline
from paddock.llm import pieces, secrets, toxicity
from tests.llm.test_llm_decontaminate import brute as brute_hits
from tests.llm.test_llm_dedup import brute as brute_groups


def fixture(spark, path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklm") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        t = text(rng.randint(20, 60))
        if i % 5 == 0:
            t = " ".join(x for w in t.split() for x in ([w, "vilest"] if rng.random() < 0.2 else [w])) + " vilest"
        docs.append((i, t, "en", "s", len(t)))
        if i % 3:
            labels.append((i, 1, int(i % 5 == 0)))
    docs += [(300 + k, docs[1][1] + " tail", "en", "s", 1) for k in range(4)]  # near copies of document 1
    item = text(14)
    docs += [(400, text(20) + " " + item + " " + text(9), "en", "s", 1), (401, "password=abcdefgh1 " + text(30), "en", "s", 1),
             (402, None, None, None, None), (403, "", "en", "s", 0), (404, None, "en", "s", None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, item


def test_stages_match_brute_force(spark, tmp_path):
    path = str(tmp_path)
    docs, item = fixture(spark, path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "sentencepiece"]
    rows = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = rows.columns, {d[0]: d[1] for d in docs}
    rejected = {r["doc_id"] for r in toxicity.score_toxicity(rows, spark.read.parquet(f"{path}/labels.parquet")).collect() if r["rejected"]}
    assert {i for i, t in kept.items() if t and "vilest" in t} == rejected
    want = [
        lambda k: {i: t for i, t in k.items() if i not in rejected},
        lambda k: {i: k[i] for i, _, c in brute_groups(list(k.items()), 5) if i == c},
        lambda k: {i: k[i] for i, _, n, _ in brute_hits(list(k.items()), [(1, item)], 10) if not n},
        lambda k: {i: t if not t or not secrets.find_spans(t) else "[SECRET]" + t[len("password=abcdefgh1"):] for i, t in k.items()}]
    for (name, stage), expect in zip(corpus_pipeline.STAGES, want):
        rows = stage(spark, rows, path)
        rows.write.parquet(f"{path}/{name}")
        rows = spark.read.parquet(f"{path}/{name}")
        kept = expect(kept)
        assert rows.columns == columns
        assert {r["doc_id"]: r["text"] for r in rows.collect()} == kept, name
        assert rows.count() == len(kept)
    last = corpus_pipeline.STAGES[-1][1](spark, rows, path).collect()
    assert len(last) == len(kept) and all(r["lossless"] for r in last)
    v = pieces.Vocabulary(pieces.load(pieces.MODEL))
    for r in last:
        assert (r["ids"] is None) == (kept[r["doc_id"]] is None)
        if r["ids"]:
            spelled = b"".join(v.blob[v.start_of[i]:v.start_of[i] + v.size_of[i]].tobytes() for i in r["ids"]).decode()
            assert spelled[1:] == kept[r["doc_id"]]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()) == sorted(kept)


def test_empty_documents(spark, tmp_path):
    path = str(tmp_path)
    fixture(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0
