"""Stage 2b: topic models and their quality metrics.

A topic model is held as a long table ``(topic, term, weight)``: from a
fitted model (``lda.TopicModels.topic_terms``) or from any grouping of the
corpus (``grouped_topic_terms``: the term distribution of each group).

Metrics are aggregations over that table, written so that no pairs of topics
are ever emitted:

* topic uniqueness  1 - mean_{i != j} |W_i & W_j| / n.  Sum over ordered pairs
  of |W_i & W_j| equals sum over terms of c_t (c_t - 1), c_t = number of
  top-n sets holding t: one groupBy on term.
* topic similarity  mean off-diagonal cosine of the topic-term rows.  With
  unit rows u_i, sum_{i != j} u_i . u_j = sum_t (sum_i u_it)^2 - K: one
  groupBy on term.
* c_v coherence (Roeder et al. 2015): boolean sliding windows, NPMI context
  vectors over each topic's top-n words, cosine against the topic vector.
  Window counts come from interval arithmetic per (document, word): an
  occurrence at position p lies in window starts [p - w + 1, p], so the
  windows holding a word are a union of intervals.  Pair counts use
  |A & B| = |A| + |B| - |A | B| over the union of the two words' intervals;
  only pairs of words sharing a topic's top-n list are formed (bounded by
  K * n^2, a parameter, not by the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.common import written

EPSILON = 1e-12


def grouped_topic_terms(bow: DataFrame, doc_groups: DataFrame, key: str = "doc_id", group: str = "topic") -> DataFrame:
    """(topic, term, weight): each group's term distribution, sum n / total n."""
    counts = bow.join(doc_groups.select(key, F.col(group).alias("topic")), key).groupBy("topic", "term").agg(
        F.sum("n").alias("n"))
    totals = counts.groupBy("topic").agg(F.sum("n").alias("_tot"))
    return counts.join(totals, "topic").select(
        "topic", "term", (F.col("n").cast("double") / F.col("_tot")).alias("weight"))


def top_terms(tw: DataFrame, n: int = 15) -> DataFrame:
    """(topic, rank, term, weight): the n heaviest terms of each topic, ties by term."""
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return tw.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "topic", "rank", "term", "weight")


def topic_uniqueness(top: DataFrame, topn: int = 15) -> DataFrame:
    """One row: n_topics, tu_score (Nan et al. 2019).

    One aggregate over the union of per-term shares and per-topic markers."""
    per_term = top.groupBy("term").agg(F.count(F.lit(1)).alias("c")).select(
        (F.col("c") * (F.col("c") - 1)).alias("shared"), F.lit(0).alias("t"))
    topics = top.select("topic").distinct().select(F.lit(0).cast("long").alias("shared"), F.lit(1).alias("t"))
    agg = per_term.unionByName(topics).agg(F.sum("shared").alias("shared"), F.sum("t").alias("n_topics"))
    denom = F.lit(float(topn)) * F.col("n_topics") * (F.col("n_topics") - 1)
    return agg.select(
        F.col("n_topics").cast("long").alias("n_topics"),
        (F.lit(1.0) - F.try_divide(F.coalesce(F.col("shared"), F.lit(0)).cast("double"),
                                   F.when(denom > 0, denom))).alias("tu_score"))


def topic_similarity(tw: DataFrame) -> DataFrame:
    """One row: n_topics, avg_topic_similarity (mean cosine over ordered pairs i != j; 0 for one topic)."""
    norms = tw.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    unit = tw.join(norms, "topic").select("term", F.try_divide(F.col("weight"), F.col("_norm")).alias("u"))
    col_sums = unit.groupBy("term").agg(F.sum("u").alias("s")).select(
        (F.col("s") * F.col("s")).alias("ss"), F.lit(0).alias("t"))
    agg = col_sums.unionByName(norms.select(F.lit(0.0).alias("ss"), F.lit(1).alias("t"))).agg(
        F.sum("ss").alias("ss"), F.sum("t").alias("n_topics"))
    pairs = F.col("n_topics") * (F.col("n_topics") - 1)
    return agg.select(
        F.col("n_topics").cast("long").alias("n_topics"),
        F.when(pairs > 0, (F.col("ss") - F.col("n_topics")) / pairs).otherwise(F.lit(0.0)).alias(
            "avg_topic_similarity"))


def _union_size(iv: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: size of the union of integer intervals [start, end] (sorted sweep, running max end)."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.max("end").over(w)
    lo = F.greatest(F.col("start"), F.coalesce(prev + 1, F.col("start")))
    return iv.withColumn("_c", F.greatest(F.lit(0), F.col("end") - lo + 1)).groupBy(*keys).agg(
        F.sum("_c").alias("covered"))


def window_islands(texts: DataFrame, relevant: DataFrame, window: int = 110, tokens: str = "tokens",
                   key: str = "doc_id") -> DataFrame:
    """Window-start intervals of each relevant word per document, merged into islands.

    A document of L tokens has max(L - w + 1, 1) windows (a short document is
    one window).  Returns islands(doc, term, start, end, nwin).
    """
    n = F.size(tokens)
    nwin = F.greatest(n - F.lit(window) + 1, F.lit(1))
    occ = texts.select(key, nwin.alias("nwin"), F.posexplode(tokens).alias("pos", "term"))
    occ = occ.join(relevant.select("term"), "term")
    occ = occ.select(key, "term", "nwin",
                     F.greatest(F.lit(0), F.col("pos") - F.lit(window - 1)).alias("start"),
                     F.least(F.col("pos"), F.col("nwin") - 1).alias("end"))
    w = Window.partitionBy(key, "term").orderBy("start", "end")
    prev_end = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(prev_end.isNull() | (F.col("start") > prev_end + 1), 1).otherwise(0)
    isl = occ.withColumn("_new", new).withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = isl.groupBy(key, "term", "_isl").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                                    F.max("nwin").alias("nwin"))
    return islands.drop("_isl")


def coherence_cv(top: DataFrame, texts: DataFrame, window: int = 110, tokens: str = "tokens",
                 key: str = "doc_id") -> DataFrame:
    """(topic, coherence): c_v of each topic's top words over ``texts`` (token arrays)."""
    # the top-n lists as a table, so that the many uses below don't re-run the topic model
    words = written(top.select("topic", "term"), "top")
    relevant = words.select("term").distinct()
    # reliable cut: the islands feed four branches below
    islands = window_islands(texts, relevant, window, tokens, key).checkpoint()
    n_windows = islands.groupBy(key).agg(F.max("nwin").alias("nwin")).agg(F.sum("nwin").alias("N")).collect()[0]["N"]
    n_windows = float(n_windows or 0)

    occ = islands.groupBy("term").agg(F.sum(F.col("end") - F.col("start") + 1).alias("occ"))

    pairs = (words.alias("a").join(words.alias("b"), "topic")
             .where(F.col("a.term") < F.col("b.term"))
             .select(F.col("a.term").alias("u"), F.col("b.term").alias("v")).distinct())
    both = (islands.join(pairs, islands["term"] == pairs["u"]).select(key, "u", "v", "start", "end")
            .unionByName(islands.join(pairs, islands["term"] == pairs["v"]).select(key, "u", "v", "start", "end")))
    union = _union_size(both, [key, "u", "v"]).groupBy("u", "v").agg(F.sum("covered").alias("uni"))
    ou = occ.select(F.col("term").alias("u"), F.col("occ").alias("occ_u"))
    ov = occ.select(F.col("term").alias("v"), F.col("occ").alias("occ_v"))
    co = union.join(ou, "u").join(ov, "v").select(
        "u", "v", (F.col("occ_u") + F.col("occ_v") - F.col("uni")).alias("co"))
    co_sym = co.unionByName(co.select(F.col("v").alias("u"), F.col("u").alias("v"), "co")).unionByName(
        occ.select(F.col("term").alias("u"), F.col("term").alias("v"), F.col("occ").alias("co")))

    # every ordered (wi, wj) of a topic, diagonal included; unseen pairs co-occur 0 times
    grid = (words.select("topic", F.col("term").alias("wi"))
            .join(words.select("topic", F.col("term").alias("wj")), "topic"))
    g = (grid.join(co_sym.select(F.col("u").alias("wi"), F.col("v").alias("wj"), "co"), ["wi", "wj"], "left")
         .join(occ.select(F.col("term").alias("wi"), F.col("occ").alias("ci")), "wi", "left")
         .join(occ.select(F.col("term").alias("wj"), F.col("occ").alias("cj")), "wj", "left")
         .withColumn("N", F.lit(n_windows)))
    p_ij = F.coalesce(F.col("co"), F.lit(0)).cast("double") / F.col("N")
    p_i = F.col("ci").cast("double") / F.col("N")
    p_j = F.col("cj").cast("double") / F.col("N")
    npmi = F.try_divide(F.ln(F.try_divide(p_ij + F.lit(EPSILON), p_i * p_j)), -F.ln(p_ij + F.lit(EPSILON)))
    g = g.select("topic", "wi", "wj", npmi.alias("x"))

    vstar = g.groupBy("topic", "wj").agg(F.sum("x").alias("vs"))
    star_norm = vstar.groupBy("topic").agg(F.sqrt(F.sum(F.col("vs") * F.col("vs"))).alias("ns"))
    seg = g.join(vstar, ["topic", "wj"]).groupBy("topic", "wi").agg(
        F.sum(F.col("x") * F.col("vs")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("ni"))
    cos = seg.join(star_norm, "topic").select(
        "topic", F.try_divide(F.col("dot"), F.col("ni") * F.col("ns")).alias("cos"))
    return cos.groupBy("topic").agg(F.avg("cos").alias("coherence"))
