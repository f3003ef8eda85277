"""Stage 2: comments -> tokens -> dictionary, bag of words, phrases, TF-IDF filter.

Layout: one row per clause with a token array (narrow work, no shuffle);
counts come from exploding to (doc, term) and a map-side-combined groupBy.
The phrase set joins by equality, after a Bloom filter; the lemma dictionary is
broadcast only after its row count is checked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.functions.text import bigrams, greedy_merge_marks, position_marks, tokenize
from paddock.operators.common import written

BROADCAST_ROWS = 2_000_000
FILTER_BITS = 1 << 27  # of the phrase filter: 16 MB
FILTER_HASHES = 5


def _maybe_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast hint only when the row count is at most ``limit`` (checked with a bounded count)."""
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def clauses(docs: DataFrame, text: str = "text", key: str = "doc_id", separator: str = r"\n") -> DataFrame:
    """doc -> (doc_id, clause_no, clause text); separator is a regex."""
    return docs.select(key, F.posexplode(F.split(F.col(text), separator)).alias("clause_no", "clause"))


def flatten_clauses(clause_tokens: DataFrame, keys=("doc_id",), order: str = "clause_no", tokens: str = "tokens",
                    separator: str = "-", out: str = "tokens") -> DataFrame:
    """One token list per document: clauses in order with a separator token between them.

    Gathers one document's clauses (bounded by that document's length)."""
    keys = list(keys)
    g = clause_tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, tokens))).alias("_c"))
    parts = F.transform("_c", lambda c, i: F.when(i > 0, F.concat(F.array(F.lit(separator)), c[tokens]))
                        .otherwise(c[tokens]))
    return g.select(*keys, F.flatten(parts).alias(out))


def clean_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add a token array; null text -> empty array."""
    return df.withColumn(out, tokenize(F.coalesce(F.col(text), F.lit(""))))


def clean_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, tokens, preprocessed text (space-joined, '' when nothing survives)."""
    df = clean_tokens(docs.select(key, text), text)
    return df.select(key, "tokens", F.array_join("tokens", " ").alias("preprocessed"))


def suffix_lemmas(vocab: DataFrame, term: str = "term") -> DataFrame:
    """A lemma dictionary derived from the corpus itself: a word ending in
    ``s``/``es``/``ies`` maps to its stem when the stem is also a word of the corpus."""
    v = vocab.select(F.col(term).alias("stem")).distinct()
    cands = vocab.select(F.col(term).alias("surface")).distinct().select(
        "surface",
        F.explode(F.array(
            F.struct(F.lit(1).alias("rank"), F.when(F.col("surface").endswith("ies"),
                     F.concat(F.expr("substring(surface, 1, length(surface) - 3)"), F.lit("y"))).alias("stem")),
            F.struct(F.lit(2).alias("rank"), F.when(F.col("surface").endswith("es"),
                     F.expr("substring(surface, 1, length(surface) - 2)")).alias("stem")),
            F.struct(F.lit(3).alias("rank"), F.when(F.col("surface").endswith("s") & ~F.col("surface").endswith("ss"),
                     F.expr("substring(surface, 1, length(surface) - 1)")).alias("stem")),
        )).alias("c"),
    ).select("surface", "c.rank", "c.stem").filter(F.col("stem").isNotNull() & (F.length("stem") > 1))
    hits = cands.join(v, "stem", "inner")
    return hits.groupBy("surface").agg(F.min(F.struct("rank", "stem"))["stem"].alias("lemma"))


def apply_lemmas(tokens_long: DataFrame, lemmas: DataFrame, term: str = "term") -> DataFrame:
    """Replace each term by its lemma; unknown terms stay as they are."""
    lem = _maybe_broadcast(lemmas.select(F.col("surface").alias(term), "lemma"))
    return tokens_long.join(lem, term, "left").withColumn(term, F.coalesce("lemma", term)).drop("lemma")


def explode_terms(df: DataFrame, tokens: str = "tokens", keys=("doc_id",)) -> DataFrame:
    # outer, then without the empty rows: before an inner one Spark filters by the size of the array, for which
    # all texts are split a second time
    return df.select(*keys, F.posexplode_outer(tokens).alias("pos", "term")).where("pos is not null")


def bag_of_words(df: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(doc_id, term, n)."""
    return explode_terms(df, tokens, (key,)).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(bow: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, cf): documents containing the term and total occurrences."""
    return bow.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def dictionary_join(bow: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc2bow against a fixed dictionary (term, term_id): unknown terms dropped."""
    return bow.join(_maybe_broadcast(vocab.select("term", "term_id")), "term", "inner")


def dictionary(df_table: DataFrame, min_df: int = 1) -> DataFrame:
    """term -> dense id in term order (ids are labels only; compare by term)."""
    kept = df_table.filter(F.col("df") >= min_df)
    # cut: both reads below must see the same partition ids
    ranged = written(kept.repartitionByRange("term").withColumn("_pid", F.spark_partition_id()), "ranged")
    ranged = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy("term")))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid").select(
        "term", (F.col("_off") + F.col("_local") - 1).cast("int").alias("term_id"), "df")


def phrase_scores(clause_tokens: DataFrame, min_count: int = 100, threshold: float = 10.0,
                  tokens: str = "tokens") -> DataFrame:
    """Bigram phrase scores (Mikolov et al. 2013):
    score = (n_ab - min_count) * V / (n_a * n_b), V = distinct unigrams + distinct bigrams.
    Returns (a, b, n_ab, score) with score > threshold."""
    # unigrams (b = null) and bigrams counted in one exchange; the three uses below share it
    items = F.concat(F.transform(F.col(tokens), lambda t: F.struct(t.alias("a"), F.lit(None).cast("string").alias("b"))),
                     F.transform(bigrams(F.col(tokens)), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))
    counts = written(clause_tokens.select(F.explode_outer(items).alias("it")).where("it is not null").groupBy("it.a", "it.b").agg(
        F.count(F.lit(1)).alias("n")), "counts")  # reliable cut: V and both joins read it
    vocab_size = counts.count()
    uni = counts.filter(F.col("b").isNull()).select(F.col("a").alias("w"), "n")
    bi = counts.filter(F.col("b").isNotNull()).select("a", "b", F.col("n").alias("n_ab"))
    cand = bi.filter(F.col("n_ab") > min_count)
    ua = uni.select(F.col("w").alias("a"), F.col("n").alias("n_a"))
    ub = uni.select(F.col("w").alias("b"), F.col("n").alias("n_b"))
    scored = cand.join(ua, "a").join(ub, "b")
    scored = scored.withColumn("score", (F.col("n_ab") - F.lit(min_count)).cast("double") * F.lit(float(vocab_size))
                               / (F.col("n_a").cast("double") * F.col("n_b")))
    return scored.filter(F.col("score") > threshold).select("a", "b", "n_ab", "score")


def phrase_filter(phrases: DataFrame, max_bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter of (a, b) pairs as 64-bit words: 16 bits a phrase, rounded up to a power of two, at most
    ``max_bits`` in all. A set beyond that only lets more pairs pass to the exact join."""
    n = phrases.count()
    bits = min(max_bits, 1 << max(6, math.ceil(math.log2(max(1, 16 * n)))))
    places = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), "a", "b"), F.lit(bits)) for k in range(FILTER_HASHES)]))
    words = phrases.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("x"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("x").to_numpy()
    return out.view(np.uint64)


def _candidates(rows: DataFrame, words: np.ndarray, tokens: str) -> DataFrame:
    """``rows`` with ``_maybe``: the places of adjacent pairs that the filter lets pass."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    bits = len(words) * 64
    hashed = F.flatten(F.transform(bigrams(F.col(tokens)), lambda p: F.array(*[
        F.pmod(F.xxhash64(F.lit(k), p["a"], p["b"]), F.lit(bits)) for k in range(FILTER_HASHES)])))
    to = T.StructType([*rows.schema.fields, T.StructField("_maybe", T.ArrayType(T.IntegerType()))])

    def run(batches):
        table = shared.value
        for b in batches:
            places = b.column("_places")
            at = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, FILTER_HASHES)
            hit = ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            sizes = pc.fill_null(pc.list_value_length(places), 0).to_numpy().astype(np.int64) // FILTER_HASHES
            row = np.repeat(np.arange(b.num_rows), sizes)
            place = np.arange(len(hit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=b.num_rows))])
            maybe = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[hit], pa.int32()))
            rest = b.drop_columns(["_places"])
            yield pa.RecordBatch.from_arrays([*rest.columns, maybe], names=[*rest.schema.names, "_maybe"])

    return rows.withColumn("_places", hashed).mapInArrow(run, to)


def merge_phrases(clause_tokens: DataFrame, phrases: DataFrame, keys=("doc_id", "clause_no"),
                  tokens: str = "tokens", out: str = "merged", max_bits: int = FILTER_BITS) -> DataFrame:
    """Greedy left-to-right bigram merge per clause against a phrase table (a, b) of any size.

    A Bloom filter of the phrases, of bounded size, marks the adjacent pairs that may be phrases; these alone move, to
    an exact join with the phrase table, and come back as sorted places. Clauses without such a pair stay where
    they are. ``keys`` name a clause; rows that repeat a key share its text. Null tokens give no tokens."""
    keys = list(keys)
    phrases = written(phrases.select("a", "b").distinct(), "phrases")
    rows = written(_candidates(clause_tokens, phrase_filter(phrases, max_bits), tokens), "candidates")
    some = rows.where(F.size("_maybe") > 0)
    at = some.select(*keys, F.explode(F.transform("_maybe", lambda i: F.struct(
        i.alias("i"), F.get(F.col(tokens), i).alias("a"), F.get(F.col(tokens), i + 1).alias("b")))).alias("p"))
    hits = at.select(*keys, "p.*").join(phrases, ["a", "b"], "left_semi").groupBy(*keys).agg(
        F.sort_array(F.collect_set("i")).alias("_hits"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    joined = some.alias("s").join(hits.alias("h"), same, "left").select("s.*", "h._hits")
    marks = position_marks(F.col("_hits"), F.greatest(F.size(tokens) - 1, F.lit(0)))
    merged = joined.withColumn(out, F.when(F.col("_hits").isNull(), F.col(tokens)).otherwise(greedy_merge_marks(F.col(tokens), marks)))
    plain = rows.where(F.size("_maybe") <= 0).withColumn(out, F.coalesce(F.col(tokens), F.array().cast("array<string>")))
    return merged.drop("_maybe", "_hits").unionByName(plain.drop("_maybe"))


def tfidf_filter(bow: DataFrame, threshold: float = 0.05, key: str = "doc_id", n_docs: int | None = None) -> DataFrame:
    """Keep (doc, term, n) whose L2-normalised tf * log2(N / df) weight is >= threshold.

    Terms in every document have weight 0 and are dropped.  Joined by term, so
    counts and weights cannot be misaligned.
    """
    if n_docs is None:  # documents with no surviving token still count when given explicitly
        n_docs = bow.select(key).distinct().count()
    dfreq = written(bow.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")  # counted, then joined
    near = _maybe_broadcast(dfreq)
    # a small dictionary goes to the rows; else they move to their terms first, and to their documents with what they need
    w = (bow.repartition(key) if near is not dfreq else bow).join(near, "term").withColumn(
        "w", F.col("n").cast("double") * F.log2(F.lit(float(n_docs)) / F.col("df"))).drop("df")
    w = (w if near is not dfreq else w.repartition(key)).where(F.col(key).isNotNull())
    # dealt by document once: the norm is a sum over the rows that are there, without a second copy of the long table
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    w = w.withColumn("_norm", norm).withColumn("weight", F.try_divide(F.col("w"), F.when(F.col("_norm") > 0, F.col("_norm"))))
    return w.filter((F.abs(F.col("w")) > 1e-12) & (F.col("weight") >= threshold)).select(key, "term", "n", "weight")
