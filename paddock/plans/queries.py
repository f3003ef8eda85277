"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (whole tables) and derives its inputs
with Spark.  Column names and rounding match the SQL twins in
``paddock.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators import betting, panel as P
from paddock.operators.common import round_doubles, written
from paddock.sources.fixtures import panel_fixture

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def clean_fixture_panel(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Stage 1 output (all columns, or ``cols``), written once, as Parquet, to the reliable checkpoint folder.

    Every later stage branches several times off the panel (group statistics
    joined back, fits, tests); the cut keeps those branches from re-running
    the scan and the de-duplication windows and makes the stage boundary
    survive lost executors, like the written stage file of the source
    pipeline. A cut table has no known partitioning: later per-race
    aggregates shuffle again.
    """
    panel = P.clean_panel(panel_fixture(spark, sf_dir), cuts=P.FIXTURE_CUTS, together=True)  # the fixture's windows run over races
    return written(panel.select(*cols) if cols else panel, "panel")


# ---------------------------------------------------------------- stage 1: panel

@register("odds_decimal")
def q_odds_decimal(spark, sf_dir):
    df = P.parse_prices(panel_fixture(spark, sf_dir))
    return round_doubles(df.select("race_id", "horse_id", "sp_raw", "sp"))


@register("race_complete_filter")
def q_race_complete_filter(spark, sf_dir):
    df = P.complete_races(P.parse_prices(panel_fixture(spark, sf_dir)))
    return round_doubles(df.select("race_id", "horse_id", "sp", "n_runners", "booksum"))


@register("winner_label")
def q_winner_label(spark, sf_dir):
    return P.label_winner(panel_fixture(spark, sf_dir)).select("race_id", "horse_id", "pos", "is_winner")


@register("split_counts")
def q_split_counts(spark, sf_dir):
    return P.split_counts(clean_fixture_panel(spark, sf_dir))


@register("implied_prob")
def q_implied_prob(spark, sf_dir):
    return round_doubles(clean_fixture_panel(spark, sf_dir).select("race_id", "horse_id", "sp", "sp_win_prob"))


@register("logit_prob")
def q_logit_prob(spark, sf_dir):
    return round_doubles(clean_fixture_panel(spark, sf_dir).select("race_id", "horse_id", "logit_sp_win_prob"))


@register("overround")
def q_overround(spark, sf_dir):
    df = P.complete_races(P.parse_prices(panel_fixture(spark, sf_dir)))
    races = df.select("race_id", "n_runners", "booksum").dropDuplicates(["race_id"])
    return round_doubles(races.withColumn("overround", F.col("booksum") - 1))


# ---------------------------------------------------------------- betting

@register("favourite_per_race")
def q_favourite_per_race(spark, sf_dir):
    fav = betting.favourite_per_race(clean_fixture_panel(spark, sf_dir))
    return round_doubles(fav.select("race_id", "horse_id", "prob", "sp", "is_winner"))


@register("favourite_flat_stats")
def q_favourite_flat_stats(spark, sf_dir):
    """Minimum slice: favourite of every fully priced race, stake 1, by split."""
    fav = betting.favourite_per_race(clean_fixture_panel(spark, sf_dir))
    bets = betting.place_bets(fav, threshold=-1.0, staking="flat", stake=1.0)
    return round_doubles(betting.strategy_stats(bets, by=["split"]).select("split", "num_bets", "pnl"))


@register("kelly_wagers")
def q_kelly_wagers(spark, sf_dir):
    fav = betting.favourite_per_race(clean_fixture_panel(spark, sf_dir))
    bets = betting.place_bets(fav, threshold=0.15, staking="kelly")
    return round_doubles(bets.select("race_id", "horse_id", "split", "prob", "expected_value", "wager", "pnl"))


def _market_and_random(spark, sf_dir):
    panel = clean_fixture_panel(spark, sf_dir).filter(F.col("split") == "test")  # a race lies in one split
    return betting.backtest(betting.uniform_probability(panel),
                            {"random": ("uniform_prob", "random"), "market": ("sp_win_prob", "argmax")},
                            threshold=0.15, staking="kelly")


@register("strategy_stats")
def q_strategy_stats(spark, sf_dir):
    stats = betting.strategy_stats(_market_and_random(spark, sf_dir), by=["strategy"])
    return round_doubles(stats.select("strategy", "pnl", "num_bets", "roi"))


@register("equity_curve")
def q_equity_curve(spark, sf_dir):
    curve = betting.equity_curve(_market_and_random(spark, sf_dir), by=["strategy"])
    return round_doubles(curve.select("strategy", F.col("date").cast("string").alias("date"), "daily_pnl", "cum_pnl"))


@register("random_pick")
def q_random_pick(spark, sf_dir):
    df = betting.uniform_probability(clean_fixture_panel(spark, sf_dir))
    picks = betting.random_per_race(df, prob="uniform_prob", seed=42)
    return round_doubles(picks.select("race_id", "horse_id", F.col("prob").alias("uniform_prob")))


@register("uniform_prob")
def q_uniform_prob(spark, sf_dir):
    df = betting.uniform_probability(clean_fixture_panel(spark, sf_dir))
    return round_doubles(df.select("race_id", "horse_id", "uniform_prob"))


# ---------------------------------------------------------------- features

from paddock.operators import features as FT  # noqa: E402
from paddock.operators import stats as ST  # noqa: E402
from paddock.sources.fixtures import attach_comments, read_documents, read_table  # noqa: E402


def categories(spark: SparkSession, sf_dir: str, attr: str) -> list[str]:
    """Distinct values of a document attribute, sorted: the topics of a stand-in model, one flag each."""
    return sorted(r[0] for r in read_table(spark, sf_dir, "documents").select(attr).where(F.col(attr).isNotNull()).distinct().collect())


def topic_panel(spark: SparkSession, sf_dir: str, attr: str = "source", *cols: str) -> tuple[DataFrame, int]:
    """Clean panel (all columns, or ``cols`` and the key of the comment) + ``topics`` array of stand-in topic flags from the runner's comment."""
    return _with_topics(spark, sf_dir, clean_fixture_panel(spark, sf_dir, *cols, *(["comment_key"] if cols else [])), attr)


def _with_topics(spark: SparkSession, sf_dir: str, panel: DataFrame, attr: str) -> tuple[DataFrame, int]:
    cats = categories(spark, sf_dir, attr)
    docs = read_table(spark, sf_dir, "documents")
    flags = FT.category_flags(docs, attr, cats)
    n_docs = docs.count()
    none = F.array_repeat(F.lit(0), len(cats))  # a runner without a comment has no topic
    return attach_comments(panel, flags, n_docs, fill={"topics": none}), len(cats)


def _names(k: int, suffix: str = "") -> list[str]:
    return [f"topic_{i}{suffix}" for i in range(k)]


@register("lag_features")
def q_lag_features(spark, sf_dir):
    df, k = topic_panel(spark, sf_dir, "source", "race_id", "horse_id", "date")
    df = FT.lag_features(df, ["topics"], max_lag=1)
    df = FT.expand_array(df.select("race_id", "horse_id", "topics_lag_1"), "topics_lag_1", _names(k, "_lag_1"))
    return df.select("race_id", "horse_id", *[F.col(c).cast("double").alias(c) for c in _names(k, "_lag_1")])


@register("rolling_mean")
def q_rolling_mean(spark, sf_dir):
    df, k = topic_panel(spark, sf_dir, "lang", "race_id", "horse_id", "date")
    df = FT.expand_array(df, "topics", _names(k))
    df = FT.rolling_mean(df, r"^topic_\d+$", window=5)
    return round_doubles(df.select("race_id", "horse_id", *_names(k, "_rollavg_5")))


@register("race_zscore")
def q_race_zscore(spark, sf_dir):
    df = FT.race_zscore(clean_fixture_panel(spark, sf_dir), ["sp", "sp_win_prob"])
    return round_doubles(df.select("race_id", "horse_id", "sp_z", "sp_win_prob_z"))


@register("band_interactions")
def q_band_interactions(spark, sf_dir):
    df, k = topic_panel(spark, sf_dir, "lang")
    df = FT.band_interactions(FT.expand_array(df, "topics", _names(k)), r"^topic_\d+$")
    cols = [f"{f}_{b}" for b in FT.BANDS for f in ["sp_win_prob", *_names(k)]]
    return round_doubles(df.select("race_id", "horse_id", "sp_bet_type", *cols))


# ---------------------------------------------------------------- stats

def _lagged_train(spark, sf_dir):
    df, k = topic_panel(spark, sf_dir, "source")
    df = FT.lag_features(df, ["topics"], max_lag=1)
    return df.filter(F.col("split") == "train"), k


@register("contingency")
def q_contingency(spark, sf_dir):
    df, k = _lagged_train(spark, sf_dir)
    return ST.contingency(df, {0: "topics", 1: "topics_lag_1"}, k)


@register("chisq_yates")
def q_chisq_yates(spark, sf_dir):
    df, k = _lagged_train(spark, sf_dir)
    t = ST.topic_tests(df, {0: "topics", 1: "topics_lag_1"}, k)
    cols = [f"{m}_lag{l}_train{s}" for l in (0, 1) for m, s in (("chi2", ""), ("pval", ""), ("pval", "_corrected"))]
    return round_doubles(t.select("topic", *cols))


@register("feature_correlation")
def q_feature_correlation(spark, sf_dir):
    df, k = _lagged_train(spark, sf_dir)
    t = ST.topic_tests(df, {0: "topics", 1: "topics_lag_1"}, k)
    return t.select("topic", "corr_lag0_train", "corr_lag1_train")


@register("significant_features")
def q_significant_features(spark, sf_dir):
    df, k = _lagged_train(spark, sf_dir)
    return ST.significant_features(ST.topic_tests(df, {0: "topics", 1: "topics_lag_1"}, k), "pval_lag1_train", 0.05)


def _val_with_uniform(spark, sf_dir):
    df = betting.uniform_probability(clean_fixture_panel(spark, sf_dir))
    return df.filter(F.col("split") == "val")


@register("paired_brier_test")
def q_paired_brier_test(spark, sf_dir):
    """Uniform-choice Brier minus market Brier on validation rows (improvement test)."""
    df = _val_with_uniform(spark, sf_dir)
    df = df.withColumn("b_base", ST.brier("uniform_prob", "is_winner")).withColumn("b_new", ST.brier("sp_win_prob", "is_winner"))
    res = ST.paired_t_test(df, "b_base", "b_new")
    return round_doubles(res.select("n", "t_stat", "se", "ci_lower", "ci_upper", "p_val_one_sided",
                                    F.col("mean_diff").alias("mean_brier_diff")))


@register("brier_vs_uniform")
def q_brier_vs_uniform(spark, sf_dir):
    res = ST.brier_vs_uniform(_val_with_uniform(spark, sf_dir), "sp_win_prob", n_tests=4)
    return round_doubles(res)


@register("logscore_test")
def q_logscore_test(spark, sf_dir):
    res = ST.logscore_test(_val_with_uniform(spark, sf_dir), "sp_win_prob", "uniform_prob")
    return round_doubles(res)


@register("logloss")
def q_logloss(spark, sf_dir):
    return round_doubles(ST.log_loss(clean_fixture_panel(spark, sf_dir), "sp_win_prob", by=["split"]))


# ---------------------------------------------------------------- text

from paddock.operators import text as TX  # noqa: E402

PHRASE_MIN_COUNT = 5  # scaled down from 100 for the small fixture corpus
PHRASE_THRESHOLD = 10.0


def _docs(spark, sf_dir):
    return read_documents(spark, sf_dir, "doc_id", "text")


def _clause_tokens(spark, sf_dir):
    return TX.clean_tokens(TX.clauses(_docs(spark, sf_dir)), "clause").select("doc_id", "clause_no", "tokens")


@register("token_clean")
def q_token_clean(spark, sf_dir):
    d = TX.clean_documents(_docs(spark, sf_dir))
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "preprocessed")


@register("bag_of_words")
def q_bag_of_words(spark, sf_dir):
    return TX.bag_of_words(TX.clean_documents(_docs(spark, sf_dir)))


@register("document_frequency")
def q_document_frequency(spark, sf_dir):
    return TX.document_frequency(TX.bag_of_words(TX.clean_documents(_docs(spark, sf_dir))))


@register("lemma_join")
def q_lemma_join(spark, sf_dir):
    bow = written(TX.bag_of_words(TX.clean_documents(_docs(spark, sf_dir))), "bow")  # tokens once, read three times
    lem = TX.apply_lemmas(bow, TX.suffix_lemmas(bow.select("term")))
    return lem.groupBy("doc_id", "term").agg(F.sum("n").alias("n"))


@register("bigram_scores")
def q_bigram_scores(spark, sf_dir):
    ph = TX.phrase_scores(_clause_tokens(spark, sf_dir), PHRASE_MIN_COUNT, PHRASE_THRESHOLD)
    return round_doubles(ph)


@register("phrase_merge")
def q_phrase_merge(spark, sf_dir):
    ct = _clause_tokens(spark, sf_dir)
    ph = TX.phrase_scores(ct, PHRASE_MIN_COUNT, PHRASE_THRESHOLD)
    merged = TX.merge_phrases(ct, ph)
    return merged.select("doc_id", "clause_no", F.array_join("merged", " ").alias("merged"))


@register("tfidf_filter")
def q_tfidf_filter(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    bow = written(TX.bag_of_words(TX.clean_documents(docs)), "bow")  # the corpus as (doc, term, n), read twice
    return round_doubles(TX.tfidf_filter(bow, 0.05, n_docs=docs.count()))


# ---------------------------------------------------------------- choice model and margins

from paddock.operators import choice as CH  # noqa: E402
from paddock.operators import margins as MG  # noqa: E402

COEF_COLS = ["model"] + [f"beta_{m}" for m in ("hat", "z_stat", "se", "ci_lower", "ci_upper", "p_val")]


def _baseline_fit(spark, sf_dir):
    panel = clean_fixture_panel(spark, sf_dir)
    fit = CH.fit_conditional_logit(panel.filter(F.col("split") == "train"), ["logit_sp_win_prob"])
    return panel, fit


@register("choice_fit")
def q_choice_fit(spark, sf_dir):
    _, fit = _baseline_fit(spark, sf_dir)
    row = CH.coefficient_row(fit, "baseline", {"logit_sp_win_prob": "beta"})
    return round_doubles(CH.coefficient_table(spark, [row], ["beta"]))


@register("choice_probs")
def q_choice_probs(spark, sf_dir):
    panel, fit = _baseline_fit(spark, sf_dir)
    probs = CH.choice_probabilities(panel, ["logit_sp_win_prob"], fit.params)
    return round_doubles(probs.select("race_id", "horse_id", "cl_prob"))


@register("choice_fit_form")
def q_choice_fit_form(spark, sf_dir):
    """Market logit plus the runner's recent win rate (mean of its previous 5 results)."""
    panel = FT.rolling_mean(clean_fixture_panel(spark, sf_dir), ["is_winner"], window=5)
    train = panel.filter(F.col("split") == "train")
    fit = CH.fit_conditional_logit(train, ["logit_sp_win_prob", "is_winner_rollavg_5"])
    row = CH.coefficient_row(fit, "form", {"logit_sp_win_prob": "beta", "is_winner_rollavg_5": "gamma"})
    return round_doubles(CH.coefficient_table(spark, [row], ["beta", "gamma"]))


def _margin(spark, sf_dir, method):
    df = MG.remove_margin(clean_fixture_panel(spark, sf_dir), method)
    return round_doubles(df.select("race_id", "horse_id", f"{method}_win_prob"))


@register("margin_power")
def q_margin_power(spark, sf_dir):
    return _margin(spark, sf_dir, "power")


@register("margin_odds_ratio")
def q_margin_odds_ratio(spark, sf_dir):
    return _margin(spark, sf_dir, "odds_ratio")


@register("margin_shin")
def q_margin_shin(spark, sf_dir):
    return _margin(spark, sf_dir, "shin")


# ---------------------------------------------------------------- topics

from paddock.operators import lda as LD, topics as TP  # noqa: E402

TOPN = 15
COHERENCE_WINDOW = 110


def _source_topics(spark, sf_dir):
    """Clean corpus and a stand-in topic model: each ``source``'s term distribution."""
    docs = read_documents(spark, sf_dir, "doc_id", "text", "source")
    clean = TX.clean_documents(docs.select("doc_id", "text"))
    tw = TP.grouped_topic_terms(TX.bag_of_words(clean), docs.select("doc_id", F.col("source").alias("topic")))
    # the topic-term table is the model: written once, read by every metric branch
    return clean, written(tw, "topics")


@register("top_terms")
def q_top_terms(spark, sf_dir):
    _, tw = _source_topics(spark, sf_dir)
    top = TP.top_terms(tw, TOPN)
    return round_doubles(top.select("topic", F.col("rank").cast("long").alias("rank"), "term", "weight"))


@register("topic_uniqueness")
def q_topic_uniqueness(spark, sf_dir):
    _, tw = _source_topics(spark, sf_dir)
    return round_doubles(TP.topic_uniqueness(TP.top_terms(tw, TOPN), TOPN))


@register("topic_similarity")
def q_topic_similarity(spark, sf_dir):
    _, tw = _source_topics(spark, sf_dir)
    return round_doubles(TP.topic_similarity(tw))


@register("topic_coherence")
def q_topic_coherence(spark, sf_dir):
    clean, tw = _source_topics(spark, sf_dir)
    coh = TP.coherence_cv(TP.top_terms(tw, TOPN), clean, window=COHERENCE_WINDOW)
    return round_doubles(coh)


LDA_K = 10
LDA_SWEEP = (10, 20, 30, 40, 50)
LDA_PASSES = 10
TFIDF_THRESHOLD = 0.05


def _source_table(spark, sf_dir):
    """Bag of words and the stand-in topic model (source -> term distribution), with the topics in order."""
    docs = read_documents(spark, sf_dir, "doc_id", "text", "source")
    bow = written(TX.bag_of_words(TX.clean_documents(docs.select("doc_id", "text"))), "bow")
    tw = written(TP.grouped_topic_terms(bow, docs.select("doc_id", F.col("source").alias("topic"))), "topics")
    topics = sorted(r["topic"] for r in tw.select("topic").distinct().where("topic is not null").collect())
    return bow, tw, topics


@register("topic_fold_in")
def q_topic_fold_in(spark, sf_dir):
    """Posterior topic shares of every document against a given topic-term table."""
    bow, tw, topics = _source_table(spark, sf_dir)
    names = F.array(*[F.lit(t) for t in topics])
    total = F.aggregate("gamma", F.lit(0.0), lambda s, g: s + g)
    rows = LD.fold_in(bow, tw, topics).withColumn("t", total).select("doc_id", "t", F.posexplode("gamma").alias("i", "g"))
    return round_doubles(rows.select("doc_id", F.element_at(names, F.col("i") + 1).alias("topic"), (F.col("g") / F.col("t")).alias("share")))


@register("topic_perplexity")
def q_topic_perplexity(spark, sf_dir):
    """Variational bound per word and perplexity of the corpus against a given topic-term table."""
    bow, tw, topics = _source_table(spark, sf_dir)
    return round_doubles(LD.perplexity_bound(LD.fold_in(bow, tw, topics), len(topics)))


_FITTED: dict[tuple, tuple] = {}


def _lda(spark, sf_dir):
    """Bag of words of the whole corpus and a fitted model of LDA_K topics: written tables, which the
    queries that read the same model share within a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        bow = written(TX.bag_of_words(TX.clean_documents(_docs(spark, sf_dir))), "bow")
        _FITTED[key] = bow, LD.fit_lda(bow, [LDA_K], passes=LDA_PASSES, seed=42)
    return _FITTED[key]


def _flags(model: LD.TopicModels, bow: DataFrame) -> DataFrame:
    """(doc_id, m, topics): 1 where a document's share of a topic is 1 / K or more."""
    return LD.document_shares(model, bow).select(
        "doc_id", "m", F.transform("shares", lambda p: (p >= F.lit(1.0) / F.size("shares")).cast("int")).alias("topics"))


@register("lda_flags")
def q_lda_flags(spark, sf_dir):
    """Topic flags of every document; one without words has none."""
    bow, model = _lda(spark, sf_dir)
    flags = _flags(model, bow).select("doc_id", "topics")
    every = _docs(spark, sf_dir).select("doc_id").join(flags, "doc_id", "left").withColumn(
        "topics", F.coalesce("topics", F.array_repeat(F.lit(0), LDA_K)))
    return FT.expand_array(every, "topics", _names(LDA_K)).select("doc_id", *_names(LDA_K))


@register("lda_perplexity")
def q_lda_perplexity(spark, sf_dir):
    _, model = _lda(spark, sf_dir)
    tw = written(model.topic_terms(0), "topics")
    m = TP.topic_uniqueness(TP.top_terms(tw, TOPN), TOPN).join(TP.topic_similarity(tw), "n_topics")
    return round_doubles(m.withColumn("perplexity", F.lit(2.0 ** -model.bounds[-1][0])))


def _corpus_split(spark, sf_dir, split: str):
    """Documents are dealt by a hash of their ids: 3 of 5 to train, 1 to val, 1 to test."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    return _docs(spark, sf_dir).where(part < 3 if split == "train" else part == (3 if split == "val" else 4))


def _lda_models(spark, sf_dir):
    """All numbers of topics fitted together on the train documents, after phrase merge and TF-IDF filter, and the
    bound per word of validation documents: shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "sweep")
    if key not in _FITTED:
        train = _corpus_split(spark, sf_dir, "train")
        ct = TX.clean_tokens(TX.clauses(train), "clause").select("doc_id", "clause_no", "tokens")
        merged = TX.merge_phrases(ct, TX.phrase_scores(ct, PHRASE_MIN_COUNT, PHRASE_THRESHOLD)).select("doc_id", "clause_no", F.col("merged").alias("tokens"))
        bow = written(TX.bag_of_words(TX.flatten_clauses(merged)), "bow")
        kept = written(TX.tfidf_filter(bow, TFIDF_THRESHOLD).select("doc_id", "term", "n"), "kept")
        model = LD.fit_lda(kept, LDA_SWEEP, passes=LDA_PASSES, seed=42)
        val = written(TX.bag_of_words(TX.clean_documents(_corpus_split(spark, sf_dir, "val"))), "bow")
        _FITTED[key] = model, LD.held_out_bound(model, val)
    return _FITTED[key]


@register("lda_sweep")
def q_lda_sweep(spark, sf_dir):
    """All numbers of topics fitted together on the train documents, after phrase merge and TF-IDF filter:
    bound per word of the first and last pass, and the perplexity of train and of validation documents."""
    model, held = _lda_models(spark, sf_dir)
    rows = [("lda", k, model.bounds[0][m], model.bounds[-1][m], 2.0 ** -model.bounds[-1][m], 2.0 ** -held[m]) for m, k in enumerate(model.sizes)]
    return round_doubles(spark.createDataFrame(
        rows, "model_type string, num_topics int, bound_first double, bound_last double, perplexity_train double, perplexity_val double"))


# ---------------------------------------------------------------- classifiers

from paddock.operators import boost as BO, isotonic as ISO, models as MD  # noqa: E402
from paddock.sources.fixtures import vector_fixture  # noqa: E402


def _lagged_splits(spark, sf_dir):
    df, k = topic_panel(spark, sf_dir, "source", "race_id", "horse_id", "date", "split", "is_winner", "sp_win_prob")
    df = FT.lag_features(df, ["topics"], max_lag=1).select(
        "race_id", "horse_id", "split", "is_winner", "sp_win_prob", "topics_lag_1")
    return df.filter(F.col("split") == "train"), df.filter(F.col("split") == "val"), k


@register("bernoulli_nb")
def q_bernoulli_nb(spark, sf_dir):
    """Lag-1 topic flags -> P(win), fitted on train, scored on validation rows."""
    train, val, _ = _lagged_splits(spark, sf_dir)
    nb = MD.fit_bernoulli_nb(train, "topics_lag_1", "is_winner")
    return round_doubles(val.select("race_id", "horse_id", nb.predict_proba(F.col("topics_lag_1")).alias("nb_prob")))


@register("gaussian_nb")
def q_gaussian_nb(spark, sf_dir):
    """64-dim vectors -> P(label < 5), fitted and scored on the whole table."""
    vec = vector_fixture(spark, sf_dir)
    nb = MD.fit_gaussian_nb(vec, "embedding", "y")
    return round_doubles(vec.select("vec_id", nb.predict_proba(F.col("embedding")).alias("gnb_prob")))


@register("isotonic")
def q_isotonic(spark, sf_dir):
    """Bernoulli NB validation scores calibrated by isotonic regression on the same rows."""
    train, val, _ = _lagged_splits(spark, sf_dir)
    nb = MD.fit_bernoulli_nb(train, "topics_lag_1", "is_winner")
    scored = val.select("race_id", "horse_id", "is_winner", nb.predict_proba(F.col("topics_lag_1")).alias("nb_prob"))
    scored = written(scored, "scored")  # read by the fit and twice by the calibration
    iso = ISO.fit_isotonic(scored, "nb_prob", "is_winner")
    cal = ISO.calibrate(iso, scored, "nb_prob", "calibrated_nb_prob")
    return round_doubles(cal.select("race_id", "horse_id", "nb_prob", "calibrated_nb_prob"))


@register("gbt_grid")
def q_gbt_grid(spark, sf_dir):
    """Boosted trees on lag-1 topic flags: validation log-loss of every grid point."""
    train, val, _ = _lagged_splits(spark, sf_dir)
    _, best, results = BO.grid_search(train, val, "topics_lag_1", "is_winner", MD.REFERENCE_GBT_GRID)
    rows = [(p["maxIter"], p["maxDepth"], float(p["stepSize"]), float(ll), p == best) for p, ll in results]
    return round_doubles(spark.createDataFrame(
        rows, "max_iter int, max_depth int, step_size double, val_log_loss double, is_best boolean"))


@register("margin_logit")
def q_margin_logit(spark, sf_dir):
    """Logistic regression on each margin method's logit (train); log-score test vs uniform (validation)."""
    from paddock.functions.odds import logit

    panel = clean_fixture_panel(spark, sf_dir, "race_id", "horse_id", "split", "is_winner", "sp", "sp_win_prob")
    df = MG.remove_margins(panel, ("power", "odds_ratio", "shin"))
    df = df.withColumnRenamed("sp_win_prob", "mm_win_prob")
    methods = ["mm", "odds_ratio", "shin", "power"]
    for m in methods:
        df = df.withColumn(f"logit_{m}", logit(F.col(f"{m}_win_prob")))
    df = df.select("race_id", "split", "is_winner", *[f"logit_{m}" for m in methods])
    df = written(betting.uniform_probability(df), "margins")  # every Newton step reads it
    train = df.filter(F.col("split") == "train")
    val = df.filter(F.col("split") == "val")
    out = None
    for m in methods:
        lr = MD.fit_logistic_newton(train, [f"logit_{m}"], "is_winner")
        v = val.withColumn("_p", MD.logistic_prob(lr, [f"logit_{m}"]))
        v = v.join(v.groupBy("race_id").agg(F.sum("_p").alias("_ps")), "race_id").withColumn(
            "prob_a", F.col("_p") / F.col("_ps"))
        t = ST.logscore_test(v, "prob_a", "uniform_prob").select(
            F.lit(m).alias("method"), F.lit(float(lr.intercept)).alias("intercept"),
            F.lit(float(lr.coefficients[0])).alias("coef"), "n", "mean_logscore_diff", "standard_error",
            "z_statistic", "p_value", "reject_null")
        out = t if out is None else out.unionByName(t)
    return round_doubles(out)


# ---------------------------------------------------------------- embeddings

from paddock.operators import embed as EM  # noqa: E402


@register("mean_pool")
def q_mean_pool(spark, sf_dir):
    """Each document = mean of its tokens' vectors (token -> vector row by md5 key)."""
    vec = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vecs = vec.count()
    bow = TX.bag_of_words(TX.clean_documents(_docs(spark, sf_dir)))
    keyed = bow.select("doc_id", EM.hashed_key(F.col("term"), n_vecs).alias("vec_id"), "n")  # keys repeat: their counts add up
    pooled = EM.mean_pool(keyed, vec)
    long = EM.to_long(pooled, "pooled")
    return round_doubles(long.select("doc_id", F.col("dim").cast("long").alias("dim"), "value"))


EMB_DIM = 64


@register("vector_join")
def q_vector_join(spark, sf_dir):
    """Each runner's comment vector (by key), lagged one race per entity, one column per dimension.

    The key is lagged, not the vector: the entity window sorts narrow rows and
    the 64-float payload is joined on afterwards."""
    vec = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vecs = vec.count()
    panel = clean_fixture_panel(spark, sf_dir, "race_id", "horse_id", "date", "comment_key")
    keyed = panel.withColumn("vec_key", F.pmod(F.col("comment_key"), F.lit(n_vecs)))
    prev = FT.previous_values(keyed, ["vec_key"], 1).withColumnRenamed("_prev1_vec_key", "prev_key")
    rows = EM.attach_vectors(prev, vec, F.col("prev_key"), out="embedding_lag_1")
    # the vectors pass through unchanged (float -> double is exact): nothing to round
    cols = [F.coalesce(F.col("embedding_lag_1")[i].cast("double"), F.lit(0.0)).alias(f"e_{i}_lag_1")
            for i in range(EMB_DIM)]
    return rows.select("race_id", "horse_id", *cols)


# ---------------------------------------------------------------- the whole study

from paddock.plans import study as SD  # noqa: E402


def _study(spark, sf_dir):
    clean = clean_fixture_panel(spark, sf_dir, "race_id", "horse_id", "date", "split", "is_winner", "sp", "sp_win_prob",
                                "logit_sp_win_prob", "comment_key")
    panel, k = _with_topics(spark, sf_dir, clean, "source")
    # the flags, the key and the probability have done their work once the rows are lagged
    return SD.run_study(spark, panel.drop("comment_key", "doc_id", "sp_win_prob"), k, spent=[clean])


@register("text_choice_fit")
def q_text_choice_fit(spark, sf_dir):
    """Baseline and market + text conditional logits (text = Naive Bayes, raw and calibrated)."""
    return round_doubles(_study(spark, sf_dir).coefficients)


@register("strategy_backtest")
def q_strategy_backtest(spark, sf_dir):
    """Random, text, market and full-model Kelly strategies on the test split."""
    stats = betting.strategy_stats(_study(spark, sf_dir).bets, by=["strategy"])
    return round_doubles(stats.select("strategy", "pnl", "num_bets", "roi"))


@register("study_equity_curve")
def q_study_equity_curve(spark, sf_dir):
    """Cumulative PnL of the four strategies by day."""
    curve = betting.equity_curve(_study(spark, sf_dir).bets, by=["strategy"])
    return round_doubles(curve.select("strategy", F.col("date").cast("string").alias("date"), "daily_pnl", "cum_pnl"))


@register("study_classifier_tests")
def q_study_classifier_tests(spark, sf_dir):
    """Text models against the uniform guess on validation rows."""
    return round_doubles(_study(spark, sf_dir).classifier_tests)


@register("study_brier_tests")
def q_study_brier_tests(spark, sf_dir):
    """Market + text choice models against the market alone on validation rows."""
    return round_doubles(_study(spark, sf_dir).brier_tests)


# ---------------------------------------------------------------- sweep over topic models, entity ids


from paddock.operators import sparse_topics as SP  # noqa: E402

SWEEP_COLUMNS = [f"{c}_lag0_train" for c in ("chi2", "pval")] + [f"{c}_lag1_train" for c in ("chi2", "pval")] + [
    "pval_lag1_train_corrected", "corr_lag1_train"]


def _sweep(panel: DataFrame, flags: DataFrame, n_docs: int, dictionary: DataFrame) -> DataFrame:
    """Tests of all topics of all models on train rows: one lag and one aggregate."""
    rows = SP.lag_flags(attach_comments(panel, flags, n_docs, fill={"flags": SP.no_topics()}))
    tests = SP.sweep_tests(rows.filter(F.col("split") == "train"), dictionary, {0: "flags", 1: "flags_lag_1"})
    return round_doubles(tests.select("model_type", "num_topics", F.concat(F.lit("topic_"), F.col("topic").cast("string")).alias("topic"), *SWEEP_COLUMNS))


@register("topic_sweep")
def q_topic_sweep(spark, sf_dir):
    """Chi-squared and correlation tests for two stand-in topic models (document attributes) in one table
    keyed by (model_type, num_topics), from sparse flags of both at once."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    named = SP.attribute_topics(docs, ["source", "lang"])
    dictionary = SP.topic_dictionary(named)
    return _sweep(clean_fixture_panel(spark, sf_dir), SP.named_flags(named, dictionary), docs.count(), dictionary)


def _comment_flags(spark, sf_dir):
    """The fitted models (train documents, all K) and the flags of every document with a known term: written once
    per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "flags")
    if key not in _FITTED:
        model, _ = _lda_models(spark, sf_dir)
        docs = _docs(spark, sf_dir)
        bow = written(TX.bag_of_words(TX.clean_documents(docs)), "bow")
        _FITTED[key] = model, written(SP.fitted_flags(model, bow), "flags"), docs.count()
    return _FITTED[key]


@register("lda_topic_tests")
def q_lda_topic_tests(spark, sf_dir):
    """The topic chain with fitted models: topics of K = 10 to 50 (fitted on train documents after phrase merge and
    TF-IDF filter) flag every runner's comment, the flags are lagged per entity, and all topics of all K
    are tested against the win on train rows at once."""
    model, flags, n_docs = _comment_flags(spark, sf_dir)
    return _sweep(clean_fixture_panel(spark, sf_dir), flags, n_docs, SP.fitted_dictionary(model, spark))


@register("lda_runner_flags")
def q_lda_runner_flags(spark, sf_dir):
    """Every runner's topics in the fitted models, and those of its entity's race before: one row per runner and K."""
    model, flags, n_docs = _comment_flags(spark, sf_dir)
    panel = attach_comments(clean_fixture_panel(spark, sf_dir), flags, n_docs, fill={"flags": SP.no_topics()})
    rows = SP.lag_flags(panel)
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("num_topics"), F.lit(a).alias("a")) for k, a in zip(model.sizes, model.starts)]))
    rows = rows.select("race_id", "horse_id", "flags", "flags_lag_1", spans.alias("m"))
    own = lambda c: F.array_join(F.transform(F.filter(c, lambda i: (i >= F.col("m.a")) & (i < F.col("m.a") + F.col("m.num_topics"))),
                                             lambda i: (i - F.col("m.a")).cast("string")), ",")
    return rows.select("race_id", "horse_id", "m.num_topics", own("flags").alias("topics"), own("flags_lag_1").alias("topics_lag_1"))


@register("entity_ids")
def q_entity_ids(spark, sf_dir):
    """Dense entity ids by first appearance in (date, race) order."""
    raw = panel_fixture(spark, sf_dir).withColumn("_order", F.struct("date", "race_id"))
    ids = P.entity_ids(raw, entity="horse_id", out="entity_id", order="_order")
    return ids.select("race_id", "horse_id", "entity_id")


@register("flatten_clauses")
def q_flatten_clauses(spark, sf_dir):
    """Clause token lists joined back into one list per document with a separator token."""
    flat = TX.flatten_clauses(_clause_tokens(spark, sf_dir), separator="-")
    return flat.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                       F.array_join("tokens", " ").alias("flattened"))


@register("lda_evaluation")
def q_lda_evaluation(spark, sf_dir):
    """One metrics row for a fitted LDA model: mean c_v coherence, perplexity,
    topic uniqueness and mean topic similarity."""
    bow, model = _lda(spark, sf_dir)
    clean = TX.clean_documents(_docs(spark, sf_dir))
    tw = written(model.topic_terms(0), "topics")
    top = TP.top_terms(tw, TOPN)
    coherence = TP.coherence_cv(top, clean, window=COHERENCE_WINDOW).agg(F.avg("coherence").alias("coherence"))
    m = TP.topic_uniqueness(top, TOPN).join(TP.topic_similarity(tw), "n_topics")
    m = m.withColumn("perplexity", F.lit(2.0 ** -model.bounds[-1][0])).withColumn("coherence", F.lit(coherence.first()["coherence"]))
    return round_doubles(m.select(F.lit("lda").alias("model_type"), "n_topics", "coherence", "perplexity",
                                  "tu_score", "avg_topic_similarity"))


@register("dictionary")
def q_dictionary(spark, sf_dir):
    """Dense term ids in term order with document frequencies (no single-partition window)."""
    bow = TX.bag_of_words(TX.clean_documents(_docs(spark, sf_dir)))
    d = TX.dictionary(TX.document_frequency(bow))
    return d.select("term", F.col("term_id").cast("long").alias("term_id"), F.col("df").cast("long").alias("df"))


@register("doc2bow")
def q_doc2bow(spark, sf_dir):
    """Bag of words against the corpus dictionary: (doc_id, term_id, n); unknown terms dropped."""
    bow = written(TX.bag_of_words(TX.clean_documents(_docs(spark, sf_dir))), "bow")
    vocab = TX.dictionary(TX.document_frequency(bow))
    return TX.dictionary_join(bow, vocab).select(
        "doc_id", F.col("term_id").cast("long").alias("term_id"), F.col("n").cast("long").alias("n"))
