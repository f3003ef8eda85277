"""Quality and toxicity: held-out accuracy, their parts against brute force, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def judged(spark, op, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column)
    rows = op(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    found = rows.collect()
    assert len(found) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [r for r in found if r["held_out"] and r["doc_id"] in known]
    return auc([r["score"] for r in held], [known[r["doc_id"]] for r in held]), held, known


def test_quality_on_held_out_rows(spark):
    got, held, known = judged(spark, quality.op4_quality, "quality")
    assert got > 0.95
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held) > 0.93


def test_toxicity_on_held_out_rows(spark):
    got, held, known = judged(spark, toxicity.op8_toxicity, "toxic")
    assert got > 0.85
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held) > 0.85


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 12)
        x, y, w = np.arange(n, dtype=float), rng.random(n), rng.integers(1, 5, n).astype(float)
        mean = lambda a, b: (y[a:b] * w[a:b]).sum() / w[a:b].sum()  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(k + 1, n + 1)) for a in range(k + 1)) for k in range(n)]
        centres, values = quality.isotonic(x, y, w)
        assert np.all(np.diff(values) > 0) and np.allclose(sorted(set(np.round(want, 9))), np.round(values, 9))


def test_normal_equations_are_the_sum_over_partitions(spark):
    rng = np.random.default_rng(2)
    d = len(quality.NAMES)
    x, y, fold = rng.normal(size=(200, d)), rng.integers(0, 2, 200).astype(float), rng.integers(0, 2, 200)
    waves = quality.Waves(np.zeros(d), np.ones(d))
    rows = spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, y, fold)], "x array<double>, y double, fold int").repartition(7)
    sums = quality._sum_equations(rows, waves, 3)
    for k in (0, 1):
        both = np.concatenate([waves(x[fold == k]), y[fold == k][:, None]], axis=1)
        assert np.allclose(sums[k], both.T @ both)
    # the cosine map approximates the Gaussian kernel
    z = waves(x[:40] / 4)[:, 1:]
    gap = ((x[:40, None] - x[None, :40]) / 4) ** 2
    assert np.abs(z @ z.T - np.exp(-gap.sum(axis=2) / (2 * d))).max() < 0.35


def test_statistics_of_a_known_text():
    got = dict(zip(quality.NAMES, quality.statistics(b"Ab AB! ab\nab|12\nab|12\n")))
    assert got["words"] == pytest.approx(np.log1p(5)) and got["different_words"] == 4 / 5 and got["repeated_lines"] == pytest.approx(1 / 3)
    assert got["capital_words"] == 1 / 5 and got["words_ending_in_symbols"] == 1 / 5 and got["digits"] == 4 / 22
    assert quality.statistics(None) == quality.statistics(b"") == [0.0] * len(quality.NAMES)


ROWS = [(1, None, "en"), (2, "", None), (3, "word " * 60000, "xx"), (3, "idiot", "en"), (None, "fine text", "en"), (5, "fine text", "en"), (6, "\n\n", "en")]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (5, 1)], [(1, None), (5, 1), (5, 0), (3, 0), (None, 1), (99, 1)]])
def test_odd_rows(spark, labels):
    docs = spark.createDataFrame([(*r, 0.5) for r in ROWS], "doc_id bigint, text string, lang string, score double")
    marks = spark.createDataFrame([(a, b, b) for a, b in labels], "doc_id bigint, quality int, toxic int")
    good = quality.score_quality(docs, marks).collect()
    bad = toxicity.score_toxicity(docs, marks).collect()
    assert len(good) == len(bad) == len(ROWS)
    assert all(0 <= r["score"] <= 1 for r in good + bad)
    if not labels:
        assert {r["score"] for r in good} == {0.5} and {r["score"] for r in bad} == {0.0}
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert quality.score_quality(docs.limit(0), marks).count() == 0 and toxicity.score_toxicity(docs.limit(0), marks).count() == 0


def test_lookup_equals_the_convolution():
    rng = np.random.default_rng(3)
    words = ["w%d" % k for k in range(30)]
    letters = ["".join("abcdefghij"[int(c)] for c in w[1:]) + "x" for w in words]
    ids = np.array([toxicity.buckets(w) for w in letters[:20]], np.int64)
    net = toxicity.Network(np.unique(ids))
    net.embed[:-1] = rng.normal(size=net.embed[:-1].shape)
    score = toxicity.scorer(net)
    for n in (0, 1, 2, 7, 30):
        text = " ".join(rng.choice(letters, n))
        x = np.zeros((max(1, n) + 2, toxicity.DIM))
        for k, w in enumerate(toxicity.tokens(text)):
            x[k] = sum(net.embed[list(net.rows).index(b)] if b in net.rows else 0 for b in toxicity.buckets(w))
        best, block = [], 0
        for width in toxicity.WIDTHS:
            best.append(np.max([sum(x[t + k] @ net.filters[block + k] for k in range(width)) for t in range(len(x) - 2)], axis=0))
            block += width
        assert score(text) == pytest.approx(net.score(net.logit(np.concatenate(best))), abs=1e-5)


def test_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    net, _ = toxicity.train(docs, labels, max_docs=20, max_words=3000, epochs=1)
    full, _ = toxicity.train(docs, labels, epochs=1)
    assert len(net.rows) < len(full.rows)


def test_a_long_document_does_not_empty_the_sample(spark):
    ids = [r["id"] for r in spark.range(1, 61).orderBy(F.xxhash64("id", F.lit(8))).collect()]
    toxic = {k: n % 2 for n, k in enumerate(ids)}
    texts = {k: ("foul vile rotten " if toxic[k] else "kind calm gentle ") * 4 for k in ids}
    for k in (ids[0], ids[1], ids[7]):  # first in the order of the sample, of both classes
        texts[k] *= 500
    docs = spark.createDataFrame([(k, texts[k], "en") for k in ids], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame(list(toxic.items()), "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score_toxicity(docs, marks, max_words=2000).collect()}
    assert got == {k: bool(y) for k, y in toxic.items()}
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, marks, max_words=2000).collect()} == {k for k, y in toxic.items() if not y}
    with pytest.raises(ValueError, match="max_words"):
        toxicity.train(docs, marks, max_words=80)
    assert toxicity.train(docs, marks.where("toxic = 1"), max_words=80) == (None, {})


def test_threshold_lies_in_the_widest_gap():
    assert toxicity.threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == pytest.approx(0.5)
    assert F.col("x") is not None


def test_every_labelled_row_is_learnt_from(spark):
    """Words of every labelled document count, also beyond 4000 of them and in the longest one."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "kind ").otherwise("vile "), F.translate(
        F.col("id").cast("string"), "0123456789", "abcdefghij"), F.when(F.col("id") == 5, F.repeat(F.lit(" words"), 700_000)).otherwise("")).alias("text"),
        F.lit("en").alias("lang"))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    net, _ = toxicity.train(docs, marks, epochs=1)
    back = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(88)), F.lit(5)) == 0).select("doc_id").collect()}
    texts = docs.where("doc_id <> 5").select("doc_id", "text").collect()
    wanted = {b for r in texts if r["doc_id"] not in back for w in toxicity.tokens(r["text"]) for b in toxicity.buckets(w)}
    assert wanted <= set(net.rows.tolist())
    assert 5 in back or set(toxicity.buckets("words")) <= set(net.rows.tolist())


def test_training_does_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_DOCS", 40)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("length(text) < 2000")
    (one, bars), (two, others) = (toxicity.train(docs.repartition(n), labels.repartition(n), epochs=2) for n in (2, 5))
    assert (one.rows == two.rows).all() and (one.embed == two.embed).all() and (one.filters == two.filters).all()
    assert one.shift == two.shift and bars == others


def test_only_labelled_texts_move(spark, monkeypatch):
    """The join with the labels moves no texts, and of the texts only those that may have a label are dealt."""
    cuts, real = {}, toxicity.cut
    monkeypatch.setattr(toxicity, "cut", lambda df, name: cuts.setdefault(name, df) and real(df, name))
    docs = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "kind ").otherwise(
        "vile "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(docs.where("doc_id in (50, 51)")).unionByName(docs.where("doc_id = 50").withColumn("text", F.lit("kind other")))
    marks = docs.where("doc_id % 50 < 2").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    net, _ = toxicity.train(docs, marks, epochs=1)
    assert net is not None and "text" not in cuts["toxic"].columns
    wanted = marks.select("doc_id").distinct()
    learnt = docs.join(wanted, "doc_id", "left_semi").count()
    assert cuts["toxic"].count() == learnt
    assert sum(len(r["labels"]) for r in cuts["parts"].collect()) == learnt
    found = toxicity._found(docs, wanted, "doc_id", "text", "lang")(True)
    assert learnt <= found.count() < learnt + 20 and set(found.columns) == {"doc_id", "mark", "lang", "tokens"}
    # ids of unlike types
    other, _ = toxicity.train(docs, marks.withColumn("doc_id", F.col("doc_id").cast("int")), epochs=1)
    assert (net.rows == other.rows).all() and (net.embed == other.embed).all() and net.shift == other.shift
