import itertools
import math
import random

from pyspark.sql import functions as F

from paddock.operators import text as TX, topics as TP


def test_tokenizer_rules(spark):
    df = spark.createDataFrame([(1, "The horse's mid-division run, it didn't stay (final furlong). Led up!")],
                               "doc_id long, text string")
    toks = TX.clean_documents(df).collect()[0]["tokens"]
    # stop words and the domain list go, "up" is kept, hyphenated and non-alphabetic tokens vanish
    assert toks == ["horse", "run", "stay", "led", "up"]


def test_greedy_merge_left_to_right(spark):
    ct = spark.createDataFrame([(1, 0, ["a", "b", "c", "b", "c"])], "doc_id long, clause_no int, tokens array<string>")
    ph = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert TX.merge_phrases(ct, ph).collect()[0]["merged"] == ["a_b", "c", "b_c"]
    # a filter that lets everything pass: the exact join decides
    assert TX.merge_phrases(ct, ph, max_bits=64).collect()[0]["merged"] == ["a_b", "c", "b_c"]


def merged_by_loop(tokens, pairs):
    out, i = [], 0
    while i < len(tokens):
        two = i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in pairs
        out.append("_".join(tokens[i:i + 2]) if two else tokens[i])
        i += 2 if two else 1
    return out


def test_merge_against_loop(spark):
    """Many phrases, repeated and null keys, null and empty clauses, a long clause, an extra column."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    pairs = {(rng.choice(words), rng.choice(words)) for _ in range(900)} | {("w0", "w0")}
    rows = [(d, c, [rng.choice(words) for _ in range(rng.randrange(12))], "x") for d in range(60) for c in range(3)]
    rows += [(None, 0, ["w0"] * 5, "x"), (70, None, ["w0"] * 4, "x"), (71, 0, None, "x"), (72, 0, [], "x"), (73, 0, ["w0"] * 30_001, "x"), rows[4], rows[4]]
    ct = spark.createDataFrame(rows, "doc_id long, clause_no int, tokens array<string>, a string")
    # phrases that never occur make the filter large; the others must still be found
    ph = spark.createDataFrame([*sorted(pairs), *sorted(pairs)[:5]], "a string, b string").unionByName(
        spark.range(200_000).select(F.format_string("u%d", "id").alias("a"), F.lit("v").alias("b")))
    want = sorted(repr((d, c, merged_by_loop(t or [], pairs))) for d, c, t, _ in rows)
    for bits in (64, TX.FILTER_BITS):
        got = TX.merge_phrases(ct, ph, max_bits=bits).collect()
        assert sorted(repr((r["doc_id"], r["clause_no"], r["merged"])) for r in got) == want
    none = TX.merge_phrases(ct, ph.where("false")).collect()
    assert sorted(repr((r["doc_id"], r["clause_no"], r["merged"])) for r in none) == sorted(repr((d, c, t or [])) for d, c, t, _ in rows)
    assert TX.merge_phrases(ct.where("false"), ph).collect() == []


def test_phrase_filter_has_few_false_hits(spark):
    ph = spark.range(20_000).select(F.format_string("a%d", "id").alias("a"), F.lit("b").alias("b"))
    other = spark.range(20_000).select(F.array(F.format_string("c%d", "id"), F.lit("b")).alias("tokens"))
    own = ph.select(F.array("a", "b").alias("tokens"))
    words = TX.phrase_filter(ph)
    assert TX._candidates(own, words, "tokens").where("size(_maybe) = 1").count() == 20_000
    assert TX._candidates(other, words, "tokens").where("size(_maybe) = 1").count() < 200


def test_phrase_score_formula(spark):
    ct = spark.createDataFrame([(i, 0, ["new", "york", "city"]) for i in range(6)],
                               "doc_id long, clause_no int, tokens array<string>")
    rows = {(r["a"], r["b"]): r["score"] for r in TX.phrase_scores(ct, min_count=1, threshold=0.0).collect()}
    v = 3 + 2  # distinct unigrams + distinct bigrams
    assert math.isclose(rows[("new", "york")], (6 - 1) * v / (6 * 6))


def _tw(spark):
    rows = [("t0", "a", 0.5), ("t0", "b", 0.3), ("t0", "c", 0.2),
            ("t1", "a", 0.1), ("t1", "d", 0.6), ("t1", "e", 0.3),
            ("t2", "b", 0.4), ("t2", "d", 0.4), ("t2", "f", 0.2)]
    return spark.createDataFrame(rows, "topic string, term string, weight double")


def test_uniqueness_and_similarity_brute_force(spark):
    tw = _tw(spark)
    topn = 2
    top = TP.top_terms(tw, topn)
    sets = {}
    for r in top.collect():
        sets.setdefault(r["topic"], set()).add(r["term"])
    ks = sorted(sets)
    tu = sum(1 - sum(len(sets[i] & sets[j]) / topn for j in ks if j != i) / (len(ks) - 1) for i in ks) / len(ks)
    got = TP.topic_uniqueness(top, topn).collect()[0]["tu_score"]
    assert math.isclose(got, tu)

    vec = {}
    for r in tw.collect():
        vec.setdefault(r["topic"], {})[r["term"]] = r["weight"]

    def cos(x, y):
        dot = sum(x.get(t, 0) * y.get(t, 0) for t in set(x) | set(y))
        return dot / math.sqrt(sum(v * v for v in x.values())) / math.sqrt(sum(v * v for v in y.values()))

    sim = sum(cos(vec[i], vec[j]) for i, j in itertools.permutations(ks, 2)) / (len(ks) * (len(ks) - 1))
    got = TP.topic_similarity(tw).collect()[0]["avg_topic_similarity"]
    assert math.isclose(got, sim, rel_tol=1e-12)


def _cv_brute(topics, texts, w):
    """c_v over explicit boolean sliding windows (every window enumerated)."""
    rel = {t for ws in topics.values() for t in ws}
    windows = []
    for toks in texts:
        if not any(t in rel for t in toks):
            continue
        if len(toks) <= w:
            windows.append(set(toks))
        else:
            windows.extend(set(toks[s:s + w]) for s in range(len(toks) - w + 1))
    n = len(windows)

    def p(*ws):
        return sum(all(x in win for x in ws) for win in windows) / n

    def npmi(a, b):
        pab = p(a, b) if a != b else p(a)
        return math.log((pab + 1e-12) / (p(a) * p(b))) / -math.log(pab + 1e-12)

    out = {}
    for k, ws in topics.items():
        vs = [sum(npmi(wi, wj) for wi in ws) for wj in ws]
        sims = []
        for wi in ws:
            v = [npmi(wi, wj) for wj in ws]
            sims.append(sum(a * b for a, b in zip(v, vs)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(
                sum(b * b for b in vs)))
        out[k] = sum(sims) / len(sims)
    return out


def test_coherence_matches_window_enumeration(spark):
    texts = [["a", "b", "x", "c", "a", "y", "b", "d", "a", "c", "e", "b"],
             ["c", "d", "e", "a"], ["x", "y"], ["b", "a", "a", "d", "c", "e", "d", "b", "e", "c", "a"],
             ["e", "e", "e", "a", "b"]]
    topics = {"t0": ["a", "b", "c"], "t1": ["c", "d", "e"]}
    w = 4
    top = spark.createDataFrame([(k, t) for k, ws in topics.items() for t in ws], "topic string, term string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, tokens array<string>")
    got = {r["topic"]: r["coherence"] for r in TP.coherence_cv(top, docs, window=w).collect()}
    want = _cv_brute(topics, texts, w)
    for k in topics:
        assert math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12), (k, got[k], want[k])


def test_flag_string_merge_equals_sequential_scan(spark):
    """The O(n) flag-string merge equals the left-to-right scan it replaces."""
    from paddock.functions.text import bigrams, greedy_merge, greedy_merge_flags

    rows = [(1, ["a", "b", "c", "d", "e"], [0, 1, 3]), (2, ["x", "y"], [0]), (3, ["q"], []),
            (4, ["a", "b", "c", "d"], [0, 1, 2]), (5, [], [])]
    df = spark.createDataFrame(rows, "id int, t array<string>, f array<int>")
    flagged = F.transform(bigrams(F.col("t")), lambda p, i: F.array_contains(F.col("f"), i))
    out = df.select("id", greedy_merge(F.col("t"), F.col("f")).alias("seq"),
                    greedy_merge_flags(F.col("t"), flagged).alias("fast")).collect()
    for r in out:
        assert r["seq"] == r["fast"], r


def test_lemmas_from_counts_that_are_written_once(spark, sf_dir):
    """The corpus is tokenised once: what the counts and the lemma dictionary read is the written bag of words."""
    from paddock.plans.queries import REGISTRY

    got = REGISTRY["lemma_join"](spark, sf_dir)
    assert got.inputFiles() and all("stage-bow" in f for f in got.inputFiles())
    bow = REGISTRY["bag_of_words"](spark, sf_dir)
    assert got.agg(F.sum("n")).first()[0] == bow.agg(F.sum("n")).first()[0]
