"""ANSI SQL twins of the registered queries, for DuckDB.

They start from the same driver tables and re-derive everything, so they are
an independent check of the DataFrame plans.  Computed doubles are rounded
to 6 decimals, and to 12 below 0.001, on both sides.
"""

from __future__ import annotations

# The driver's panel fixture (race = order, runner = part), verbatim.
FIXTURE = r"""
l AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_partkey
           ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber, l_quantity) AS rn
  FROM lineitem l),
r AS (
  SELECT l_orderkey AS race_id, l_partkey AS horse_id, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN l_discount = 0.1 AND l_quantity > 48 THEN NULL
         WHEN l_discount = 0.0 AND l_quantity < 3 THEN 'EvsF'
         ELSE concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(10)), '/', CAST(l_linenumber + 1 AS VARCHAR(10)),
                     CASE WHEN l_returnflag = 'A' THEN 'F' ELSE '' END) END AS sp_raw,
    CASE WHEN l_returnflag = 'R' AND l_tax = 0.08 THEN 'PU'
         ELSE CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS VARCHAR(10)) END AS pos,
    l_orderkey * 7 + l_partkey AS comment_key
  FROM l JOIN orders ON o_orderkey = l_orderkey WHERE rn = 1)
"""

PRICED = FIXTURE + r""",
p0 AS (
  SELECT r.*, lower(trim(sp_raw)) AS s FROM r),
p1 AS (
  SELECT race_id, horse_id, date, sp_raw, pos, comment_key,
    CASE WHEN s IS NULL THEN NULL
         WHEN s LIKE 'evs%' OR s LIKE 'evens%' THEN 2.0
         WHEN regexp_matches(s, '(\d+)\s*/\s*(\d+)')
           THEN round_even(CAST(regexp_extract(s, '(\d+)\s*/\s*(\d+)', 1) AS DOUBLE)
                 / nullif(CAST(regexp_extract(s, '(\d+)\s*/\s*(\d+)', 2) AS DOUBLE), 0) + 1, 2)
         ELSE NULL END AS sp
  FROM p0)
"""

# cleaned panel with the fixture's split cuts
PANEL = PRICED + r""",
rs AS (
  SELECT race_id, count(*) AS n_runners, count(sp) AS n_priced, sum(1.0 / sp) AS booksum
  FROM p1 WHERE race_id IS NOT NULL GROUP BY race_id),
panel AS (
  SELECT p1.race_id, p1.horse_id, p1.date, p1.sp_raw, p1.pos, p1.comment_key, p1.sp,
    rs.n_runners, rs.booksum,
    greatest(1e-12, least(1 - 1e-12, (1.0 / p1.sp) / rs.booksum)) AS sp_win_prob,
    CAST(coalesce(p1.pos = '1', false) AS INTEGER) AS is_winner,
    CASE WHEN p1.date < DATE '1999-01-01' THEN 'train'
         WHEN p1.date < DATE '2000-06-01' THEN 'val'
         WHEN p1.date >= DATE '2000-06-01' THEN 'test' END AS split
  FROM p1 JOIN rs ON p1.race_id = rs.race_id
  WHERE rs.n_runners = rs.n_priced),
panel2 AS (
  SELECT *, ln(sp_win_prob / (1 - sp_win_prob)) AS logit_sp_win_prob FROM panel)
"""


def _snap(sql: str, digits: int = 6) -> str:
    """Rewrite every ``round(expr, 6)`` as ``round(round(expr, 9), 6)``, with twice the decimals below 0.001."""
    out, i, token = [], 0, "round("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(token)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(token):k - 1]
        head, sep, tail = inner.rpartition(",")
        if sep and tail.strip() == str(digits):
            out.append(f"list_transform([CAST({_snap(head)} AS DOUBLE)], lambda v: CASE WHEN abs(v) < 0.001 THEN "
                       f"round(v, {2 * digits}) ELSE round(round(v, {digits + 3}), {digits}) END)[1]")
        else:
            out.append(f"round({_snap(inner)})")
        i = k


def _with(body: str, base: str = PANEL) -> str:
    return "WITH " + base + body


SQL: dict[str, str] = {}

SQL["odds_decimal"] = _with("""
SELECT race_id, horse_id, sp_raw, round(sp, 6) AS sp FROM p1
""", PRICED)

SQL["race_complete_filter"] = _with("""
SELECT race_id, horse_id, round(sp, 6) AS sp, CAST(n_runners AS BIGINT) AS n_runners,
       round(booksum, 6) AS booksum FROM panel
""")

SQL["winner_label"] = _with("""
SELECT race_id, horse_id, pos, CAST(coalesce(pos = '1', false) AS INTEGER) AS is_winner FROM r
""", FIXTURE)

SQL["split_counts"] = _with("""
SELECT split, CAST(count(DISTINCT race_id) AS BIGINT) AS n_races, CAST(count(*) AS BIGINT) AS n_rows
FROM panel GROUP BY split
""")

SQL["implied_prob"] = _with("""
SELECT race_id, horse_id, round(sp, 6) AS sp, round(sp_win_prob, 6) AS sp_win_prob FROM panel
""")

SQL["logit_prob"] = _with("""
SELECT race_id, horse_id, round(logit_sp_win_prob, 6) AS logit_sp_win_prob FROM panel2
""")

SQL["overround"] = _with("""
SELECT race_id, CAST(count(*) AS BIGINT) AS n_runners, round(sum(1.0 / sp), 6) AS booksum,
       round(sum(1.0 / sp) - 1, 6) AS overround
FROM p1 WHERE race_id IS NOT NULL GROUP BY race_id HAVING count(*) = count(sp)
""", PRICED)

_FAV = """,
fav AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY sp_win_prob DESC, horse_id) AS rk FROM panel)
  WHERE rk = 1)
"""

SQL["favourite_per_race"] = _with(_FAV + """
SELECT race_id, horse_id, round(sp_win_prob, 6) AS prob, round(sp, 6) AS sp, is_winner FROM fav
""")

SQL["favourite_flat_stats"] = _with(_FAV + """
SELECT split, CAST(count(*) AS BIGINT) AS num_bets,
       round(sum(CASE WHEN is_winner = 1 THEN sp - 1 ELSE -1 END), 6) AS pnl
FROM fav WHERE round(round(sp_win_prob * (sp - 1) - (1 - sp_win_prob), 12), 9) > -1 GROUP BY split
""")

_KELLY = _FAV + """,
kel AS (
  SELECT race_id, horse_id, date, split, sp, is_winner, sp_win_prob AS prob,
    sp_win_prob * (sp - 1) - (1 - sp_win_prob) AS ev,
    coalesce(greatest((sp * sp_win_prob - 1) / nullif(sp - 1, 0), 0), 0) AS kf
  FROM fav),
bets AS (
  SELECT *, CASE WHEN round(round(ev, 12), 9) > 0.15 THEN kf ELSE 0.0 END AS wager FROM kel),
settled AS (
  SELECT *, CASE WHEN wager > 0 THEN (CASE WHEN is_winner = 1 THEN wager * (sp - 1) ELSE -wager END)
                 ELSE 0.0 END AS pnl FROM bets)
"""

SQL["kelly_wagers"] = _with(_KELLY + """
SELECT race_id, horse_id, split, round(prob, 6) AS prob, round(ev, 6) AS expected_value,
       round(wager, 6) AS wager, round(pnl, 6) AS pnl FROM settled
""")

_STRATS = """,
u AS (
  SELECT panel.*, 1.0 / count(*) OVER (PARTITION BY race_id) AS uniform_prob FROM panel),
rnd AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY race_id
             ORDER BY md5(concat_ws('-', CAST(race_id AS VARCHAR), CAST(horse_id AS VARCHAR), '42')), horse_id) AS rk
    FROM u) WHERE rk = 1),
mkt AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY sp_win_prob DESC, horse_id) AS rk FROM u)
  WHERE rk = 1),
picks AS (
  SELECT 'random' AS strategy, race_id, horse_id, date, split, sp, is_winner, uniform_prob AS prob FROM rnd
  UNION ALL
  SELECT 'market' AS strategy, race_id, horse_id, date, split, sp, is_winner, sp_win_prob AS prob FROM mkt),
st AS (
  SELECT *, CASE WHEN round(round(prob * (sp - 1) - (1 - prob), 12), 9) > 0.15
                 THEN coalesce(greatest((sp * prob - 1) / nullif(sp - 1, 0), 0), 0) ELSE 0.0 END AS wager
  FROM picks WHERE split = 'test'),
st2 AS (
  SELECT *, CASE WHEN wager > 0 THEN (CASE WHEN is_winner = 1 THEN wager * (sp - 1) ELSE -wager END)
                 ELSE 0.0 END AS pnl FROM st)
"""

SQL["strategy_stats"] = _with(_STRATS + """
SELECT strategy, round(sum(pnl), 6) AS pnl, CAST(count(*) FILTER (WHERE wager > 0) AS BIGINT) AS num_bets,
       round(coalesce(sum(pnl) / nullif(sum(wager), 0), 0), 6) AS roi
FROM st2 GROUP BY strategy
""")

SQL["equity_curve"] = _with(_STRATS + """,
daily AS (
  SELECT strategy, date, sum(pnl) AS daily_pnl FROM st2 GROUP BY strategy, date)
SELECT strategy, CAST(date AS VARCHAR) AS date, round(daily_pnl, 6) AS daily_pnl,
       round(sum(daily_pnl) OVER (PARTITION BY strategy ORDER BY date
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_pnl
FROM daily
""")

SQL["random_pick"] = _with(_STRATS + """
SELECT race_id, horse_id, round(uniform_prob, 6) AS uniform_prob FROM rnd
""")

SQL["uniform_prob"] = _with("""
SELECT race_id, horse_id, round(1.0 / count(*) OVER (PARTITION BY race_id), 6) AS uniform_prob FROM panel
""")


# ------------------------------------------------------------------ math in SQL

def sql_erfc(x: str) -> str:
    """erfc via the positive-term series of erf (same series as the Spark side)."""
    ax = f"abs({x})"
    erf = (f"(SELECT 2 / sqrt(pi()) * sum(exp(2 * n * ln(2) + lgamma(n + 1) + (2 * n + 1) * ln({ax}) "
           f"- lgamma(2 * n + 2) - {ax} * {ax})) FROM range(0, 201) s(n))")
    e = f"(CASE WHEN {ax} = 0 THEN 0.0 WHEN {ax} > 6 THEN 1.0 ELSE {erf} END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0 THEN 1 - {e} ELSE 1 + {e} END)"


def sql_chi2_sf1(stat: str) -> str:
    return f"(CASE WHEN {stat} IS NULL THEN NULL ELSE greatest(0.0, {sql_erfc(f'sqrt(greatest({stat}, 0) / 2)')}) END)"


def sql_normal_cdf(z: str) -> str:
    return f"(0.5 * {sql_erfc(f'(-({z}) / sqrt(2))')})"


def sql_t_two_sided(t: str, nu: str) -> str:
    """Abramowitz & Stegun 26.7.3-4 finite sums, closed-form coefficients."""
    th = f"atan(abs({t}) / sqrt({nu}))"
    even = (f"(sin({th}) * (SELECT sum(exp(lgamma(2 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1) "
            f"+ 2 * j * ln(cos({th})))) FROM range(0, 200001) s(j) WHERE j <= ({nu} - 2) // 2))")
    odd_sum = (f"(SELECT sum(exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2) "
               f"+ (2 * j + 1) * ln(cos({th})))) FROM range(0, 200001) s(j) WHERE j <= ({nu} - 3) // 2)")
    odd = f"(2 / pi() * ({th} + CASE WHEN {nu} > 1 THEN sin({th}) * {odd_sum} ELSE 0 END))"
    a = f"(CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"
    return f"(CASE WHEN {t} IS NULL OR {nu} < 1 THEN NULL ELSE least(1.0, greatest(0.0, 1 - {a})) END)"


# ------------------------------------------------------------------ features

def _topics(attr: str) -> str:
    return f""",
cats_{attr} AS (
  SELECT {attr} AS cat, CAST(row_number() OVER (ORDER BY {attr}) - 1 AS INTEGER) AS t
  FROM (SELECT DISTINCT {attr} FROM documents)),
doct_{attr} AS (
  SELECT d.doc_id, c.t FROM documents d JOIN cats_{attr} c ON d.{attr} = c.cat),
pt_{attr} AS (
  SELECT panel.*, doct_{attr}.t FROM panel
  LEFT JOIN doct_{attr} ON doct_{attr}.doc_id = panel.comment_key % (SELECT count(*) FROM documents))
"""


N_SOURCES = 20  # the fixture has 20 sources and 4 languages; the SQL derives the ids itself
N_LANGS = 4

_LAG = _topics("source") + """,
lagged AS (
  SELECT pt_source.*, lag(t) OVER (PARTITION BY horse_id ORDER BY date, race_id) AS prev_t,
         row_number() OVER (PARTITION BY horse_id ORDER BY date, race_id) AS hrn
  FROM pt_source)
"""

SQL["lag_features"] = _with(_LAG + "SELECT race_id, horse_id, " + ", ".join(
    f"CAST(CASE WHEN hrn > 1 AND prev_t = {i} THEN 1 ELSE 0 END AS DOUBLE) AS topic_{i}_lag_1" for i in range(N_SOURCES)
) + " FROM lagged")

SQL["rolling_mean"] = _with(_topics("lang") + ", rl AS (SELECT race_id, horse_id, " + ", ".join(
    f"coalesce(avg(CAST(t = {i} AS INTEGER)) OVER (PARTITION BY horse_id ORDER BY date, race_id "
    f"ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS topic_{i}_rollavg_5" for i in range(N_LANGS)
) + " FROM pt_lang) SELECT race_id, horse_id, " + ", ".join(
    f"round(CAST(topic_{i}_rollavg_5 AS DOUBLE), 6) AS topic_{i}_rollavg_5" for i in range(N_LANGS)) + " FROM rl")

SQL["race_zscore"] = _with(""",
zs AS (
  SELECT race_id, avg(sp) AS mu1, stddev_pop(sp) AS sd1, avg(sp_win_prob) AS mu2, stddev_pop(sp_win_prob) AS sd2
  FROM panel GROUP BY race_id)
SELECT race_id, horse_id,
  round(CASE WHEN sd1 IS NULL THEN NULL WHEN sd1 = 0 THEN 0.0 ELSE (sp - mu1) / sd1 END, 6) AS sp_z,
  round(CASE WHEN sd2 IS NULL THEN NULL WHEN sd2 = 0 THEN 0.0 ELSE (sp_win_prob - mu2) / sd2 END, 6) AS sp_win_prob_z
FROM panel JOIN zs USING (race_id)
""")

_BANDS = ("longshot", "neither", "sureshot")
_band = "CASE WHEN sp_win_prob <= 0.05 THEN 'longshot' WHEN sp_win_prob >= 0.5 THEN 'sureshot' ELSE 'neither' END"
SQL["band_interactions"] = _with(_topics("lang") + f", bd AS (SELECT *, {_band} AS sp_bet_type FROM pt_lang) "
    "SELECT race_id, horse_id, sp_bet_type, " + ", ".join(
        [f"round(CASE WHEN sp_bet_type = '{b}' THEN sp_win_prob ELSE 0.0 END, 6) AS sp_win_prob_{b}" for b in _BANDS]
        + [f"round(CASE WHEN sp_bet_type = '{b}' THEN CAST(coalesce(t = {i}, false) AS DOUBLE) ELSE 0.0 END, 6) AS topic_{i}_{b}"
           for b in _BANDS for i in range(N_LANGS)]
    ) + " FROM bd")

# ------------------------------------------------------------------ stats

_TRAIN = _LAG + """,
tr AS (SELECT * FROM lagged WHERE split = 'train'),
ids AS (SELECT CAST(range AS INTEGER) AS i FROM range(0, (SELECT count(*) FROM cats_source))),
cells AS (
  SELECT ids.i, l.lag,
    count(*) AS n,
    sum(is_winner) AS sy,
    sum(CASE WHEN l.lag = 0 THEN CAST(coalesce(t = ids.i, false) AS INTEGER)
             ELSE CAST(hrn > 1 AND coalesce(prev_t = ids.i, false) AS INTEGER) END) AS sx,
    sum(is_winner * CASE WHEN l.lag = 0 THEN CAST(coalesce(t = ids.i, false) AS INTEGER)
             ELSE CAST(hrn > 1 AND coalesce(prev_t = ids.i, false) AS INTEGER) END) AS sxy
  FROM tr CROSS JOIN ids CROSS JOIN (VALUES (0), (1)) l(lag)
  GROUP BY ids.i, l.lag),
chi AS (
  SELECT i, lag, n, sx, sy, sxy,
    CASE WHEN sx <= 0 OR sx >= n OR sy <= 0 OR sy >= n THEN NULL ELSE
      pow(greatest(abs(sxy - sx * sy / n) - 0.5, 0), 2) / (sx * sy / n)
    + pow(greatest(abs((sx - sxy) - sx * (n - sy) / n) - 0.5, 0), 2) / (sx * (n - sy) / n)
    + pow(greatest(abs((sy - sxy) - (n - sx) * sy / n) - 0.5, 0), 2) / ((n - sx) * sy / n)
    + pow(greatest(abs((n - sx - sy + sxy) - (n - sx) * (n - sy) / n) - 0.5, 0), 2) / ((n - sx) * (n - sy) / n)
    END AS stat,
    (n * sxy - sx * sy) / nullif(sqrt((n * sx - sx * sx) * (n * sy - sy * sy)), 0) AS r
  FROM (SELECT i, lag, CAST(n AS DOUBLE) AS n, CAST(sx AS DOUBLE) AS sx, CAST(sy AS DOUBLE) AS sy,
               CAST(sxy AS DOUBLE) AS sxy FROM cells)),
chp AS (SELECT *, """ + sql_chi2_sf1("stat") + """ AS p FROM chi)
"""

SQL["contingency"] = _with(_TRAIN + """
SELECT CAST(i AS INTEGER) AS topic, CAST(lag AS INTEGER) AS lag, f.feature, f.label,
  CAST(CASE WHEN f.feature = 1 AND f.label = 1 THEN sxy WHEN f.feature = 1 THEN sx - sxy
            WHEN f.label = 1 THEN sy - sxy ELSE n - sx - sy + sxy END AS BIGINT) AS n
FROM chi CROSS JOIN (VALUES (1, 1), (1, 0), (0, 1), (0, 0)) f(feature, label)
""")

SQL["chisq_yates"] = _with(_TRAIN + """
SELECT 'topic_' || CAST(a.i AS VARCHAR) AS topic,
  round(a.stat, 6) AS chi2_lag0_train, round(a.p, 6) AS pval_lag0_train,
  round(least(a.p * (SELECT count(*) FROM cats_source), 1.0), 6) AS pval_lag0_train_corrected,
  round(b.stat, 6) AS chi2_lag1_train, round(b.p, 6) AS pval_lag1_train,
  round(least(b.p * (SELECT count(*) FROM cats_source), 1.0), 6) AS pval_lag1_train_corrected
FROM chp a JOIN chp b ON a.i = b.i AND a.lag = 0 AND b.lag = 1
""")

SQL["feature_correlation"] = _with(_TRAIN + """
SELECT 'topic_' || CAST(a.i AS VARCHAR) AS topic, round(a.r, 4) AS corr_lag0_train, round(b.r, 4) AS corr_lag1_train
FROM chi a JOIN chi b ON a.i = b.i AND a.lag = 0 AND b.lag = 1
""")

SQL["significant_features"] = _with(_TRAIN + """
SELECT 'topic_' || CAST(i AS VARCHAR) AS topic FROM chp WHERE lag = 1 AND p < 0.05
""")

_VAL = """,
vu AS (
  SELECT panel.*, 1.0 / count(*) OVER (PARTITION BY race_id) AS uniform_prob FROM panel),
v AS (SELECT * FROM vu WHERE split = 'val')
"""

SQL["paired_brier_test"] = _with(_VAL + """,
d AS (SELECT pow(uniform_prob - is_winner, 2) - pow(sp_win_prob - is_winner, 2) AS d FROM v),
m AS (SELECT count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM d),
t AS (SELECT *, sd / sqrt(n) AS se, mean_diff / nullif(sd / sqrt(n), 0) AS t_stat FROM m),
p AS (SELECT *, """ + sql_t_two_sided("t_stat", "(n - 1)") + """ AS p2 FROM t)
SELECT CAST(n AS BIGINT) AS n, round(t_stat, 6) AS t_stat, round(se, 6) AS se,
  round(mean_diff - 1.96 * se, 6) AS ci_lower, round(mean_diff + 1.96 * se, 6) AS ci_upper,
  round(CASE WHEN mean_diff > 0 THEN p2 / 2 ELSE 1 - p2 / 2 END, 6) AS p_val_one_sided,
  round(mean_diff, 6) AS mean_brier_diff
FROM p
""")

SQL["brier_vs_uniform"] = _with(_VAL + """,
d AS (SELECT 0.5 - (pow(sp_win_prob - is_winner, 2) + pow((1 - sp_win_prob) - (1 - is_winner), 2)) AS d FROM v),
m AS (SELECT count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM d),
t AS (SELECT *, mean_diff / nullif(sd / sqrt(n), 0) AS t_stat FROM m),
p AS (SELECT *, """ + sql_t_two_sided("t_stat", "(n - 1)") + """ AS p2 FROM t),
q AS (SELECT *, CASE WHEN mean_diff > 0 THEN p2 / 2 ELSE 1 - p2 / 2 END AS p1 FROM p)
SELECT round(t_stat, 6) AS t_statistic, round(p1, 6) AS p_value, round(least(p1 * 4, 1.0), 6) AS p_value_bonferroni,
  round(mean_diff, 6) AS mean_brier_diff, CAST(n AS BIGINT) AS n
FROM q
""")

SQL["logscore_test"] = _with(_VAL + """,
w AS (SELECT ln(greatest(1e-12, least(1 - 1e-12, sp_win_prob))) - ln(greatest(1e-12, least(1 - 1e-12, uniform_prob))) AS r
      FROM v WHERE is_winner = 1),
m AS (SELECT count(r) AS n, -avg(r) AS md, stddev_samp(r) / sqrt(count(r)) AS se FROM w),
z AS (SELECT *, md / nullif(se, 0) AS z FROM m),
p AS (SELECT *, """ + sql_normal_cdf("z") + """ AS p FROM z)
SELECT CAST(n AS BIGINT) AS n, round(md, 6) AS mean_logscore_diff, round(se, 6) AS standard_error,
  round(z, 6) AS z_statistic, round(p, 6) AS p_value, CAST(0.05 AS DOUBLE) AS alpha, p < 0.05 AS reject_null
FROM p
""")

SQL["logloss"] = _with("""
SELECT split, round(avg(-(is_winner * ln(greatest(1e-12, least(1 - 1e-12, sp_win_prob)))
       + (1 - is_winner) * ln(1 - greatest(1e-12, least(1 - 1e-12, sp_win_prob))))), 6) AS log_loss,
       CAST(count(*) AS BIGINT) AS n
FROM panel GROUP BY split
""")


# ------------------------------------------------------------------ text

def _stop_list() -> str:
    from paddock.functions.text import stop_words

    return "[" + ", ".join(f"'{w}'" for w in stop_words()) + "]"


def _tok(expr: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({expr}), "
            r"""'[,;:?!()\[\]{}"]', ' ', 'g'), '\s+'), """
            r"""lambda x: regexp_replace(regexp_replace(x, '\.+$', ''), '(''s|''re|''ve|''ll|''d|''m|n''t)$', '')), """
            rf"""lambda x: regexp_matches(x, '^\p{{L}}+$') AND NOT list_contains({_stop_list()}, x))""")


TOK = f"""
tok AS (SELECT doc_id, {_tok('text')} AS tokens FROM documents),
bow AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY doc_id, term)
"""

SQL["token_clean"] = "WITH " + TOK + """
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS preprocessed FROM tok
"""

SQL["bag_of_words"] = "WITH " + TOK + "SELECT doc_id, term, CAST(n AS BIGINT) AS n FROM bow"

SQL["document_frequency"] = "WITH " + TOK + """
SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(n) AS BIGINT) AS cf FROM bow GROUP BY term
"""

SQL["lemma_join"] = "WITH " + TOK + r""",
v AS (SELECT DISTINCT term FROM bow),
cand AS (
  SELECT term AS surface, 1 AS rank, CASE WHEN term LIKE '%ies' THEN substr(term, 1, length(term) - 3) || 'y' END AS stem FROM v
  UNION ALL
  SELECT term, 2, CASE WHEN term LIKE '%es' THEN substr(term, 1, length(term) - 2) END FROM v
  UNION ALL
  SELECT term, 3, CASE WHEN term LIKE '%s' AND term NOT LIKE '%ss' THEN substr(term, 1, length(term) - 1) END FROM v),
hits AS (SELECT c.* FROM cand c JOIN v ON v.term = c.stem WHERE c.stem IS NOT NULL AND length(c.stem) > 1),
lem AS (SELECT surface, arg_min(stem, rank) AS lemma FROM hits GROUP BY surface)
SELECT doc_id, coalesce(lemma, term) AS term, CAST(sum(n) AS BIGINT) AS n
FROM bow LEFT JOIN lem ON bow.term = lem.surface GROUP BY doc_id, coalesce(lemma, term)
"""

CLAUSES = f"""
cl AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS clause_no,
              unnest(string_split(text, chr(10))) AS clause FROM documents),
ctok AS (SELECT doc_id, clause_no, {_tok('clause')} AS tokens FROM cl),
cpos AS (SELECT doc_id, clause_no, unnest(range(len(tokens))) AS j, unnest(tokens) AS term FROM ctok),
pairs AS (SELECT doc_id, clause_no, j AS i, term AS a, lead(term) OVER (PARTITION BY doc_id, clause_no ORDER BY j) AS b FROM cpos),
uni AS (SELECT term AS w, count(*) AS n FROM cpos GROUP BY term),
bi AS (SELECT a, b, count(*) AS n_ab FROM pairs WHERE b IS NOT NULL GROUP BY a, b),
vs AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM bi) AS V),
ph AS (
  SELECT bi.a, bi.b, bi.n_ab, (bi.n_ab - 5) * vs.V / (CAST(ua.n AS DOUBLE) * ub.n) AS score
  FROM bi JOIN uni ua ON ua.w = bi.a JOIN uni ub ON ub.w = bi.b CROSS JOIN vs
  WHERE bi.n_ab > 5 AND (bi.n_ab - 5) * vs.V / (CAST(ua.n AS DOUBLE) * ub.n) > 10)
"""

SQL["bigram_scores"] = "WITH " + CLAUSES + "SELECT a, b, CAST(n_ab AS BIGINT) AS n_ab, round(score, 6) AS score FROM ph"

SQL["phrase_merge"] = "WITH " + CLAUSES + """,
fl AS (SELECT p.doc_id, p.clause_no, p.i, p.a, p.b FROM pairs p JOIN ph ON ph.a = p.a AND ph.b = p.b),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, clause_no ORDER BY i) AS g FROM fl),
taken AS (SELECT * FROM (SELECT *, i - min(i) OVER (PARTITION BY doc_id, clause_no, g) AS off FROM isl) WHERE off % 2 = 0),
em AS (
  SELECT c.doc_id, c.clause_no, c.j,
    CASE WHEN t1.i IS NOT NULL THEN t1.a || '_' || t1.b WHEN t2.i IS NOT NULL THEN NULL ELSE c.term END AS tok
  FROM cpos c
  LEFT JOIN taken t1 ON t1.doc_id = c.doc_id AND t1.clause_no = c.clause_no AND t1.i = c.j
  LEFT JOIN taken t2 ON t2.doc_id = c.doc_id AND t2.clause_no = c.clause_no AND t2.i = c.j - 1),
agg AS (SELECT doc_id, clause_no, string_agg(tok, ' ' ORDER BY j) AS merged FROM em GROUP BY doc_id, clause_no)
SELECT ctok.doc_id, CAST(ctok.clause_no AS INTEGER) AS clause_no, coalesce(agg.merged, '') AS merged
FROM ctok LEFT JOIN agg ON agg.doc_id = ctok.doc_id AND agg.clause_no = ctok.clause_no
"""

SQL["tfidf_filter"] = "WITH " + TOK + """,
dfq AS (SELECT term, count(*) AS df FROM bow GROUP BY term),
w AS (SELECT bow.doc_id, bow.term, bow.n, bow.n * log2((SELECT count(*) FROM documents) / CAST(dfq.df AS DOUBLE)) AS w
      FROM bow JOIN dfq USING (term)),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
ww AS (SELECT w.*, w.w / nullif(nr.norm, 0) AS weight FROM w JOIN nr USING (doc_id))
SELECT doc_id, term, CAST(n AS BIGINT) AS n, round(weight, 6) AS weight FROM ww WHERE abs(w) > 1e-12 AND weight >= 0.05
"""


def _fold_in(iterations: int = 10) -> str:
    """The fixed-point iterations of topic shares, unrolled: g is the share's parameter, e its weight."""
    from paddock.functions.special import sql_digamma

    steps = """,
kk AS (SELECT count(DISTINCT topic) AS k FROM tw),
ws AS MATERIALIZED (SELECT b.doc_id, b.term, CAST(b.n AS DOUBLE) AS n FROM bow b WHERE b.term IN (SELECT term FROM tw)),
g0 AS MATERIALIZED (SELECT doc_id, topic, 1.0 / k + n / k AS g
  FROM (SELECT doc_id, sum(n) AS n FROM ws GROUP BY doc_id), (SELECT DISTINCT topic FROM tw), kk)"""
    for i in range(iterations + 1):
        steps += f""",
e{i} AS MATERIALIZED (SELECT doc_id, topic, g, {sql_digamma('g')} - {sql_digamma('t')} AS l
  FROM (SELECT *, sum(g) OVER (PARTITION BY doc_id) AS t FROM g{i})),
p{i} AS MATERIALIZED (SELECT ws.doc_id, ws.term, any_value(ws.n) AS n, sum(exp(e.l) * tw.weight) AS phi
  FROM ws JOIN tw USING (term) JOIN e{i} e ON e.doc_id = ws.doc_id AND e.topic = tw.topic GROUP BY ws.doc_id, ws.term)"""
        if i < iterations:
            steps += f""",
g{i + 1} AS MATERIALIZED (SELECT e.doc_id, e.topic, 1.0 / any_value(k) + any_value(exp(e.l)) * coalesce(sum(p.n / p.phi * tw.weight), 0) AS g
  FROM kk, e{i} e LEFT JOIN (p{i} p JOIN tw USING (term)) ON p.doc_id = e.doc_id AND tw.topic = e.topic GROUP BY e.doc_id, e.topic)"""
    return steps


def _topic_twins() -> None:
    from paddock.functions.special import sql_lgamma

    SQL["topic_fold_in"] = "WITH " + TOK + _TOPICS + _fold_in() + """
SELECT doc_id, topic, round(g / sum(g) OVER (PARTITION BY doc_id), 6) AS share FROM g10"""
    SQL["topic_perplexity"] = "WITH " + TOK + _TOPICS + _fold_in() + f""",
db AS (SELECT doc_id, sum((1.0 / k - g) * l + {sql_lgamma('g')}) AS own, sum(g) AS t FROM e10, kk GROUP BY doc_id),
dw AS (SELECT doc_id, sum(n * ln(phi)) AS lik, sum(n) AS n FROM p10 GROUP BY doc_id),
db2 AS (SELECT n, lik + own - {sql_lgamma('t')} + {sql_lgamma('1.0')} - k * {sql_lgamma('(1.0 / k)')} AS bound
  FROM db JOIN dw USING (doc_id), kk)
SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words, round(sum(bound) / sum(n), 6) AS bound_per_word,
  round(pow(2.0, -sum(bound) / sum(n)), 6) AS perplexity FROM db2"""


def finalize() -> dict[str, str]:
    """Every SQL twin with the two-step 6-digit rounding applied."""
    _topic_twins()
    return {k: _snap(v) for k, v in SQL.items()}


# ------------------------------------------------------------------ choice model (recursive Newton)

_NEWTON = """,
tr AS (SELECT race_id, logit_sp_win_prob AS x, is_winner AS y FROM panel2 WHERE split = 'train'),
k1 AS (SELECT race_id FROM tr GROUP BY race_id HAVING sum(y) = 1 AND count(*) > 1),
d AS (SELECT tr.* FROM tr JOIN k1 USING (race_id)),
nt(it, beta, g, h) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT it + 1, beta + sum(xw - s1 / s0) / sum(s2 / s0 - (s1 / s0) * (s1 / s0)),
         sum(xw - s1 / s0), sum(s2 / s0 - (s1 / s0) * (s1 / s0))
  FROM (SELECT nt.it, nt.beta, d.race_id, sum(exp(nt.beta * d.x)) AS s0, sum(d.x * exp(nt.beta * d.x)) AS s1,
               sum(d.x * d.x * exp(nt.beta * d.x)) AS s2, sum(d.y * d.x) AS xw
        FROM nt, d WHERE nt.it < 30 GROUP BY nt.it, nt.beta, d.race_id) per
  GROUP BY it, beta),
fin AS (SELECT beta, h FROM nt WHERE it = 30),
coef AS (SELECT beta, 1 / sqrt(h) AS se FROM fin)
"""

SQL["choice_fit"] = "WITH RECURSIVE " + PANEL + _NEWTON + """
SELECT 'baseline' AS model, round(beta, 6) AS beta_hat, round(beta / se, 6) AS beta_z_stat, round(se, 6) AS beta_se,
  round(beta - 1.959963984540054 * se, 6) AS beta_ci_lower, round(beta + 1.959963984540054 * se, 6) AS beta_ci_upper,
  round(""" + sql_erfc("abs(beta / se) / sqrt(2)") + """, 6) AS beta_p_val
FROM coef
"""

SQL["choice_probs"] = "WITH RECURSIVE " + PANEL + _NEWTON + """,
u AS (SELECT race_id, horse_id, (SELECT beta FROM coef) * logit_sp_win_prob AS u FROM panel2),
m AS (SELECT race_id, max(u) AS umax FROM u GROUP BY race_id),
e AS (SELECT u.race_id, u.horse_id, exp(u.u - m.umax) AS e FROM u JOIN m USING (race_id)),
s AS (SELECT race_id, sum(e) AS es FROM e GROUP BY race_id)
SELECT e.race_id, e.horse_id, round(e.e / s.es, 6) AS cl_prob FROM e JOIN s USING (race_id)
"""


# ------------------------------------------------------------------ margins (recursive bisection)

def _bisect_sql(name: str, term: str, lo: str, hi: str, prob: str, renorm: bool, fallback: bool) -> str:
    t = lambda v: term.replace("{t}", v)
    body = f""",
rr AS (SELECT race_id, horse_id, 1.0 / sp AS pi FROM panel),
rb AS (SELECT race_id, max(pi) AS pmax, sum(pi) AS pisum FROM rr GROUP BY race_id),
ends AS (
  SELECT rb.race_id, {lo} AS lo0, {hi} AS hi0,
         sum({t(lo.replace('pmax', 'rb.pmax'))}) - 1 AS fa, sum({t(hi.replace('pmax', 'rb.pmax'))}) - 1 AS fb
  FROM rb JOIN rr USING (race_id) GROUP BY rb.race_id, rb.pmax),
bis(race_id, it, lo, hi) AS (
  SELECT race_id, 0, CAST(lo0 AS DOUBLE), CAST(hi0 AS DOUBLE) FROM ends
  UNION ALL
  SELECT race_id, it + 1, CASE WHEN f > 0 THEN mid ELSE lo END, CASE WHEN f > 0 THEN hi ELSE mid END
  FROM (SELECT bis.race_id, bis.it, bis.lo, bis.hi, (bis.lo + bis.hi) / 2 AS mid,
               sum({t('((bis.lo + bis.hi) / 2)')}) - 1 AS f
        FROM bis JOIN rr ON rr.race_id = bis.race_id WHERE bis.it < 64
        GROUP BY bis.race_id, bis.it, bis.lo, bis.hi)),
root AS (
  SELECT e.race_id, CASE WHEN e.fa * e.fb > 0 THEN NULL WHEN e.fa = 0 THEN e.lo0 WHEN e.fb = 0 THEN e.hi0
                         ELSE (b.lo + b.hi) / 2 END AS r
  FROM ends e JOIN bis b ON b.race_id = e.race_id AND b.it = 64),
raw AS (SELECT rr.*, rb.pisum, root.r, {prob.replace('{t}', 'root.r')} AS q
        FROM rr JOIN rb USING (race_id) JOIN root USING (race_id)),
nrm AS (SELECT race_id, sum(q) AS qs FROM raw GROUP BY race_id)
SELECT raw.race_id, raw.horse_id, round(CASE WHEN raw.r IS NULL AND {'FALSE' if fallback else 'TRUE'} THEN NULL
  ELSE greatest(1e-12, least(1 - 1e-12,
  CASE WHEN raw.r IS NULL THEN {'pi / pisum' if fallback else 'NULL'}
       ELSE {'q / nrm.qs' if renorm else 'q'} END)) END, 6) AS {name}_win_prob
FROM raw JOIN nrm USING (race_id)
"""
    return "WITH RECURSIVE " + PANEL + body


SQL["margin_power"] = _bisect_sql("power", "pow(pi, {t})", "0.01", "10.0", "pow(pi, {t})", True, True)
SQL["margin_odds_ratio"] = _bisect_sql("odds_ratio", "pi / ({t} + pi)", "0.0", "pmax * 1000.0", "pi / ({t} + pi)",
                                       False, False)
SQL["margin_shin"] = _bisect_sql("shin", "(sqrt({t} * {t} + 4 * (1 - {t}) * pi) - {t}) / 2", "1e-6", "(1 - 1e-6)",
                                 "(sqrt({t} * {t} + 4 * (1 - {t}) * pi) - {t}) / 2", False, True)


# ------------------------------------------------------------------ topics (source groups as topics)

_TOPICS = """,
tw0 AS (SELECT d.source AS topic, b.term, sum(b.n) AS n FROM bow b JOIN documents d USING (doc_id) GROUP BY 1, 2),
tw AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS weight FROM tw0),
top AS (SELECT * FROM (SELECT topic, term, weight,
          row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM tw) WHERE rank <= 15)
"""

SQL["top_terms"] = "WITH " + TOK + _TOPICS + """
SELECT topic, CAST(rank AS BIGINT) AS rank, term, round(weight, 6) AS weight FROM top
"""

SQL["topic_uniqueness"] = "WITH " + TOK + _TOPICS + """,
k AS (SELECT count(DISTINCT topic) AS k FROM top),
c AS (SELECT term, count(*) AS c FROM top GROUP BY term)
SELECT CAST(k.k AS BIGINT) AS n_topics,
       round(1 - (SELECT sum(c * (c - 1)) FROM c) / nullif(15.0 * k.k * (k.k - 1), 0), 6) AS tu_score
FROM k
"""

SQL["topic_similarity"] = "WITH " + TOK + _TOPICS + """,
nr AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM tw GROUP BY topic),
u AS (SELECT tw.term, tw.weight / nr.norm AS u FROM tw JOIN nr USING (topic)),
s AS (SELECT term, sum(u) AS s FROM u GROUP BY term),
k AS (SELECT count(*) AS k FROM nr)
SELECT CAST(k.k AS BIGINT) AS n_topics,
       round(CASE WHEN k.k > 1 THEN ((SELECT sum(s * s) FROM s) - k.k) / (k.k * (k.k - 1)) ELSE 0.0 END, 6)
         AS avg_topic_similarity
FROM k
"""

SQL["topic_coherence"] = "WITH " + TOK + _TOPICS + """,
rel AS (SELECT DISTINCT term FROM top),
ex AS (SELECT doc_id, len(tokens) AS l, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM tok),
occ AS (SELECT doc_id, term, greatest(l - 110 + 1, 1) AS nwin, pos FROM ex WHERE term IN (SELECT term FROM rel)),
iv AS (SELECT doc_id, term, nwin, greatest(0, pos - 109) AS s, least(pos, nwin - 1) AS e FROM occ),
iv2 AS (SELECT *, max(e) OVER (PARTITION BY doc_id, term ORDER BY s, e
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
iv3 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, term
          ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM iv2),
isl AS (SELECT doc_id, term, min(s) AS s, max(e) AS e FROM iv3 GROUP BY doc_id, term, isl),
nw AS (SELECT sum(nwin) AS n FROM (SELECT doc_id, max(nwin) AS nwin FROM occ GROUP BY doc_id)),
oc AS (SELECT term, sum(e - s + 1) AS occ FROM isl GROUP BY term),
pr AS (SELECT DISTINCT a.term AS u, b.term AS v FROM top a JOIN top b ON a.topic = b.topic AND a.term < b.term),
bo AS (SELECT i.doc_id, p.u, p.v, i.s, i.e FROM isl i JOIN pr p ON i.term = p.u
       UNION ALL SELECT i.doc_id, p.u, p.v, i.s, i.e FROM isl i JOIN pr p ON i.term = p.v),
bo2 AS (SELECT *, max(e) OVER (PARTITION BY doc_id, u, v ORDER BY s, e
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM bo),
un AS (SELECT u, v, sum(greatest(0, e - greatest(s, coalesce(pe + 1, s)) + 1)) AS uni FROM bo2 GROUP BY u, v),
co AS (SELECT un.u, un.v, ou.occ + ov.occ - un.uni AS co FROM un JOIN oc ou ON ou.term = un.u JOIN oc ov ON ov.term = un.v),
cs AS (SELECT u, v, co FROM co UNION ALL SELECT v, u, co FROM co UNION ALL SELECT term, term, occ FROM oc),
gr AS (SELECT a.topic, a.term AS wi, b.term AS wj FROM top a JOIN top b ON a.topic = b.topic),
g AS (SELECT gr.topic, gr.wi, gr.wj,
        ln((coalesce(cs.co, 0) / nw.n + 1e-12) / nullif((oi.occ / nw.n) * (oj.occ / nw.n), 0))
          / nullif(-ln(coalesce(cs.co, 0) / nw.n + 1e-12), 0) AS x
      FROM gr LEFT JOIN cs ON cs.u = gr.wi AND cs.v = gr.wj
      LEFT JOIN oc oi ON oi.term = gr.wi LEFT JOIN oc oj ON oj.term = gr.wj CROSS JOIN nw),
vs AS (SELECT topic, wj, sum(x) AS vs FROM g GROUP BY topic, wj),
ns AS (SELECT topic, sqrt(sum(vs * vs)) AS ns FROM vs GROUP BY topic),
seg AS (SELECT g.topic, g.wi, sum(g.x * vs.vs) AS dot, sqrt(sum(g.x * g.x)) AS ni
        FROM g JOIN vs USING (topic, wj) GROUP BY g.topic, g.wi),
cosr AS (SELECT seg.topic, seg.dot / nullif(seg.ni * ns.ns, 0) AS cos FROM seg JOIN ns USING (topic))
SELECT topic, round(avg(cos), 6) AS coherence FROM cosr GROUP BY topic
"""


# ------------------------------------------------------------------ classifiers

SQL["bernoulli_nb"] = _with(_LAG + """,
tr AS (SELECT * FROM lagged WHERE split = 'train'),
va AS (SELECT * FROM lagged WHERE split = 'val'),
ids AS (SELECT CAST(range AS INTEGER) AS j FROM range(0, (SELECT count(*) FROM cats_source))),
nc AS (SELECT is_winner AS y, count(*) AS n FROM tr GROUP BY is_winner),
kc AS (SELECT is_winner AS y, prev_t AS j, count(*) AS k FROM tr WHERE hrn > 1 AND prev_t IS NOT NULL GROUP BY 1, 2),
th AS (SELECT ids.j, nc.y, (coalesce(kc.k, 0) + 1.0) / (nc.n + 2.0) AS theta
       FROM ids CROSS JOIN nc LEFT JOIN kc ON kc.j = ids.j AND kc.y = nc.y),
base AS (SELECT y, sum(ln(1 - theta)) AS b FROM th GROUP BY y),
pri AS (SELECT y, ln(n / (SELECT sum(n) FROM nc)) AS lp FROM nc),
jl AS (SELECT va.race_id, va.horse_id, pri.y,
              pri.lp + base.b + coalesce(ln(th.theta) - ln(1 - th.theta), 0) AS jl
       FROM va CROSS JOIN pri JOIN base ON base.y = pri.y
       LEFT JOIN th ON th.y = pri.y AND va.hrn > 1 AND th.j = va.prev_t)
SELECT race_id, horse_id,
       round(1 / (1 + exp(greatest(-700, least(700, max(jl) FILTER (WHERE y = 0) - max(jl) FILTER (WHERE y = 1))))), 6)
         AS nb_prob
FROM jl GROUP BY race_id, horse_id
""")

SQL["gaussian_nb"] = """
WITH e AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS y, embedding FROM embeddings),
ex AS (SELECT vec_id, y, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM e),
allv AS (SELECT j, var_pop(x) AS v FROM ex GROUP BY j),
eps AS (SELECT 1e-9 * max(v) AS eps FROM allv),
nc AS (SELECT y, count(*) AS n FROM e GROUP BY y),
par AS (SELECT y, j, avg(x) AS mu, var_pop(x) + (SELECT eps FROM eps) AS var FROM ex GROUP BY y, j),
ll AS (SELECT ex.vec_id, par.y, sum(-0.5 * ln(2 * pi() * par.var) - 0.5 * (ex.x - par.mu) * (ex.x - par.mu) / par.var) AS s
       FROM ex JOIN par ON ex.j = par.j GROUP BY ex.vec_id, par.y),
jl AS (SELECT ll.vec_id, ll.y, ll.s + ln(nc.n / (SELECT sum(n) FROM nc)) AS jl FROM ll JOIN nc USING (y))
SELECT vec_id,
       round(1 / (1 + exp(greatest(-700, least(700, max(jl) FILTER (WHERE y = 0) - max(jl) FILTER (WHERE y = 1))))), 6)
         AS gnb_prob
FROM jl GROUP BY vec_id
"""


# ------------------------------------------------------------------ embeddings

SQL["mean_pool"] = "WITH " + TOK + """,
nv AS (SELECT count(*) AS n FROM embeddings),
bv AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % nv.n AS vec_id, sum(bow.n) AS n
       FROM bow CROSS JOIN nv GROUP BY 1, 2),
ex AS (SELECT bv.doc_id, bv.n, generate_subscripts(e.embedding, 1) - 1 AS dim, CAST(unnest(e.embedding) AS DOUBLE) AS x
       FROM bv JOIN embeddings e USING (vec_id))
SELECT doc_id, CAST(dim AS BIGINT) AS dim, round(sum(n * x) / sum(n), 6) AS value FROM ex GROUP BY doc_id, dim
"""

SQL["vector_join"] = _with(""",
nv AS (SELECT count(*) AS n FROM embeddings),
pv AS (SELECT panel.race_id, panel.horse_id, panel.date, e.embedding
       FROM panel CROSS JOIN nv LEFT JOIN embeddings e ON e.vec_id = panel.comment_key % nv.n),
lg AS (SELECT race_id, horse_id, lag(embedding) OVER (PARTITION BY horse_id ORDER BY date, race_id) AS prev FROM pv)
SELECT race_id, horse_id, """ + ", ".join(
    f"coalesce(CAST(prev[{i + 1}] AS DOUBLE), 0.0) AS e_{i}_lag_1" for i in range(64)) + " FROM lg")


# ------------------------------------------------------------------ sweep over topic models, entity ids

def _train_for(attr: str) -> str:
    """The training-split test CTEs of ``_TRAIN`` for another stand-in topic model."""
    import re

    body = _TRAIN[len(_topics("source")):].replace("pt_source", f"pt_{attr}").replace("cats_source", f"cats_{attr}")
    body = re.sub(r"\b(lagged|tr|ids|cells|chi|chp)\b", lambda m: f"{m.group(1)}_{attr}", body)
    return _topics(attr) + body


def _sweep_select(attr: str) -> str:
    return f"""
SELECT '{attr}' AS model_type, CAST((SELECT count(*) FROM cats_{attr}) AS BIGINT) AS num_topics,
  'topic_' || CAST(a.i AS VARCHAR) AS topic,
  round(a.stat, 6) AS chi2_lag0_train, round(a.p, 6) AS pval_lag0_train,
  round(b.stat, 6) AS chi2_lag1_train, round(b.p, 6) AS pval_lag1_train,
  round(least(b.p * (SELECT count(*) FROM cats_{attr}), 1.0), 6) AS pval_lag1_train_corrected,
  round(b.r, 4) AS corr_lag1_train
FROM chp_{attr} a JOIN chp_{attr} b ON a.i = b.i AND a.lag = 0 AND b.lag = 1"""


SQL["topic_sweep"] = _with(_train_for("source") + _train_for("lang") + _sweep_select("source")
                           + "\nUNION ALL" + _sweep_select("lang"))

SQL["entity_ids"] = _with(""",
raw AS (SELECT DISTINCT race_id, horse_id, date FROM p1),
fr AS (SELECT horse_id, date, race_id,
              row_number() OVER (PARTITION BY horse_id ORDER BY date, race_id) AS k FROM raw),
ids AS (SELECT horse_id, row_number() OVER (ORDER BY date, race_id, horse_id) AS entity_id FROM fr WHERE k = 1)
SELECT raw.race_id, raw.horse_id, CAST(ids.entity_id AS BIGINT) AS entity_id FROM raw JOIN ids USING (horse_id)
""", base=PRICED)

SQL["flatten_clauses"] = "WITH " + CLAUSES + """,
fl AS (SELECT doc_id, flatten(list(CASE WHEN clause_no > 0 THEN list_prepend('-', tokens) ELSE tokens END
                                   ORDER BY clause_no)) AS t FROM ctok GROUP BY doc_id)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS flattened FROM fl
"""


# ------------------------------------------------------------------ two-feature conditional logit (recursive Newton)

def _coef_cols(tag: str, b: str, se: str) -> str:
    return (f"round({b}, 6) AS {tag}_hat, round({b} / {se}, 6) AS {tag}_z_stat, round({se}, 6) AS {tag}_se, "
            f"round({b} - 1.959963984540054 * {se}, 6) AS {tag}_ci_lower, "
            f"round({b} + 1.959963984540054 * {se}, 6) AS {tag}_ci_upper, "
            f"round({sql_erfc(f'abs({b} / {se}) / sqrt(2)')}, 6) AS {tag}_p_val")


SQL["choice_fit_form"] = "WITH RECURSIVE " + PANEL + """,
fm AS (SELECT race_id, split, is_winner, logit_sp_win_prob AS x1,
         coalesce(avg(CAST(is_winner AS DOUBLE)) OVER (PARTITION BY horse_id ORDER BY date, race_id
                  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.0) AS x2
       FROM panel2),
tr AS (SELECT race_id, x1, x2, is_winner AS y FROM fm WHERE split = 'train'),
k1 AS (SELECT race_id FROM tr GROUP BY race_id HAVING sum(y) = 1 AND count(*) > 1),
d AS (SELECT tr.* FROM tr JOIN k1 USING (race_id)),
nt(it, b1, b2, h11, h12, h22) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT it + 1, b1 + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12),
         b2 + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12), h11, h12, h22
  FROM (SELECT it, b1, b2, sum(xw1 - s1a / s0) AS g1, sum(xw2 - s1b / s0) AS g2,
               sum(s2aa / s0 - s1a * s1a / (s0 * s0)) AS h11, sum(s2ab / s0 - s1a * s1b / (s0 * s0)) AS h12,
               sum(s2bb / s0 - s1b * s1b / (s0 * s0)) AS h22
        FROM (SELECT nt.it, nt.b1, nt.b2, d.race_id,
                     sum(exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s0,
                     sum(d.x1 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s1a,
                     sum(d.x2 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s1b,
                     sum(d.x1 * d.x1 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s2aa,
                     sum(d.x1 * d.x2 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s2ab,
                     sum(d.x2 * d.x2 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s2bb,
                     sum(d.y * d.x1) AS xw1, sum(d.y * d.x2) AS xw2
              FROM nt, d WHERE nt.it < 30 GROUP BY nt.it, nt.b1, nt.b2, d.race_id) per
        GROUP BY it, b1, b2) agg),
fin AS (SELECT b1, b2, sqrt(h22 / (h11 * h22 - h12 * h12)) AS se1, sqrt(h11 / (h11 * h22 - h12 * h12)) AS se2
        FROM nt WHERE it = 30)
SELECT 'form' AS model, """ + _coef_cols("beta", "b1", "se1") + ", " + _coef_cols("gamma", "b2", "se2") + """
FROM fin
"""


# ------------------------------------------------------------------ isotonic calibration (min-max formula)

_NB_ROWS = _LAG + """,
tr AS (SELECT * FROM lagged WHERE split = 'train'),
va AS (SELECT * FROM lagged WHERE split = 'val'),
ids AS (SELECT CAST(range AS INTEGER) AS j FROM range(0, (SELECT count(*) FROM cats_source))),
nc AS (SELECT is_winner AS y, count(*) AS n FROM tr GROUP BY is_winner),
kc AS (SELECT is_winner AS y, prev_t AS j, count(*) AS k FROM tr WHERE hrn > 1 AND prev_t IS NOT NULL GROUP BY 1, 2),
th AS (SELECT ids.j, nc.y, (coalesce(kc.k, 0) + 1.0) / (nc.n + 2.0) AS theta
       FROM ids CROSS JOIN nc LEFT JOIN kc ON kc.j = ids.j AND kc.y = nc.y),
base AS (SELECT y, sum(ln(1 - theta)) AS b FROM th GROUP BY y),
pri AS (SELECT y, ln(n / (SELECT sum(n) FROM nc)) AS lp FROM nc),
jl AS (SELECT va.race_id, va.horse_id, va.is_winner, pri.y,
              pri.lp + base.b + coalesce(ln(th.theta) - ln(1 - th.theta), 0) AS jl
       FROM va CROSS JOIN pri JOIN base ON base.y = pri.y
       LEFT JOIN th ON th.y = pri.y AND va.hrn > 1 AND th.j = va.prev_t),
nbp AS (SELECT race_id, horse_id, is_winner,
               1 / (1 + exp(greatest(-700, least(700, max(jl) FILTER (WHERE y = 0) - max(jl) FILTER (WHERE y = 1)))))
                 AS p
        FROM jl GROUP BY race_id, horse_id, is_winner)
"""

# isotonic fit at the distinct scores (ties pooled): f(i) = max_{j<=i} min_{k>=i} mean(y over blocks j..k)
SQL["isotonic"] = _with(_NB_ROWS + """,
pts AS (SELECT p AS x, count(*) AS n, sum(is_winner) AS sy FROM nbp GROUP BY p),
pc AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(sy) OVER (ORDER BY x) AS csy,
              sum(n) OVER (ORDER BY x) AS cn FROM pts),
sg AS (SELECT a.i AS j, b.i AS k, (b.csy - a.csy + a.sy) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m
       FROM pc a JOIN pc b ON a.i <= b.i),
mn AS (SELECT pc.i, s.j, min(s.m) AS mn FROM pc JOIN sg s ON s.j <= pc.i AND s.k >= pc.i GROUP BY pc.i, s.j),
fit AS (SELECT i, max(mn) AS f FROM mn GROUP BY i)
SELECT nbp.race_id, nbp.horse_id, round(nbp.p, 6) AS nb_prob, round(least(1.0, fit.f), 6) AS calibrated_nb_prob
FROM nbp JOIN pc ON pc.x = nbp.p JOIN fit ON fit.i = pc.i
""")


# ------------------------------------------------------------------ margin methods compared by logistic regression

def _margin_cte(name: str, term: str, lo: str, hi: str, prob: str, renorm: bool, fallback: bool) -> str:
    """Per-race bisection for one method as CTEs suffixed ``_{name}``; ends in
    ``mg_{name}(race_id, horse_id, p)`` with the clipped, unrounded probability."""
    t = lambda v: term.replace("{t}", v)
    s = name
    return f""",
rr_{s} AS (SELECT race_id, horse_id, 1.0 / sp AS pi FROM panel),
rb_{s} AS (SELECT race_id, max(pi) AS pmax, sum(pi) AS pisum FROM rr_{s} GROUP BY race_id),
ends_{s} AS (
  SELECT rb.race_id, {lo.replace('pmax', 'rb.pmax')} AS lo0, {hi.replace('pmax', 'rb.pmax')} AS hi0,
         sum({t(lo.replace('pmax', 'rb.pmax'))}) - 1 AS fa, sum({t(hi.replace('pmax', 'rb.pmax'))}) - 1 AS fb
  FROM rb_{s} rb JOIN rr_{s} rr USING (race_id) GROUP BY rb.race_id, rb.pmax),
bis_{s}(race_id, it, lo, hi) AS (
  SELECT race_id, 0, CAST(lo0 AS DOUBLE), CAST(hi0 AS DOUBLE) FROM ends_{s}
  UNION ALL
  SELECT race_id, it + 1, CASE WHEN f > 0 THEN mid ELSE lo END, CASE WHEN f > 0 THEN hi ELSE mid END
  FROM (SELECT bis.race_id, bis.it, bis.lo, bis.hi, (bis.lo + bis.hi) / 2 AS mid,
               sum({t('((bis.lo + bis.hi) / 2)')}) - 1 AS f
        FROM bis_{s} bis JOIN rr_{s} rr ON rr.race_id = bis.race_id WHERE bis.it < 64
        GROUP BY bis.race_id, bis.it, bis.lo, bis.hi)),
root_{s} AS (
  SELECT e.race_id, CASE WHEN e.fa * e.fb > 0 THEN NULL WHEN e.fa = 0 THEN e.lo0 WHEN e.fb = 0 THEN e.hi0
                         ELSE (b.lo + b.hi) / 2 END AS r
  FROM ends_{s} e JOIN bis_{s} b ON b.race_id = e.race_id AND b.it = 64),
raw_{s} AS (SELECT rr.*, rb.pisum, root.r, {prob.replace('{t}', 'root.r')} AS q
            FROM rr_{s} rr JOIN rb_{s} rb USING (race_id) JOIN root_{s} root USING (race_id)),
nrm_{s} AS (SELECT race_id, sum(q) AS qs FROM raw_{s} GROUP BY race_id),
mg_{s} AS (SELECT raw.race_id, raw.horse_id, CASE WHEN raw.r IS NULL AND {'FALSE' if fallback else 'TRUE'} THEN NULL
  ELSE greatest(1e-12, least(1 - 1e-12,
  CASE WHEN raw.r IS NULL THEN {'pi / pisum' if fallback else 'NULL'}
       ELSE {'q / nrm.qs' if renorm else 'q'} END)) END AS p
  FROM raw_{s} raw JOIN nrm_{s} nrm USING (race_id))"""


def _logit_fit(m: str) -> str:
    """Newton for L2 logistic regression (C = 1, intercept unpenalised) on one margin logit."""
    return f""",
tr_{m} AS (SELECT x_{m} AS x, CAST(is_winner AS DOUBLE) AS y FROM lg WHERE split = 'train' AND x_{m} IS NOT NULL),
nt_{m}(it, a, b) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE)
  UNION ALL
  SELECT it + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT it, a, b, sum(pp - y) AS ga, sum((pp - y) * x) + b AS gb, sum(pp * (1 - pp)) AS haa,
               sum(pp * (1 - pp) * x) AS hab, sum(pp * (1 - pp) * x * x) + 1 AS hbb
        FROM (SELECT nt.it, nt.a, nt.b, t.x, t.y, 1 / (1 + exp(-(nt.a + nt.b * t.x))) AS pp
              FROM nt_{m} nt, tr_{m} t WHERE nt.it < 25) s
        GROUP BY it, a, b) g),
fit_{m} AS (SELECT a, b FROM nt_{m} WHERE it = 25),
va_{m} AS (SELECT lg.race_id, lg.is_winner, lg.uniform_prob, 1 / (1 + exp(-(f.a + f.b * lg.x_{m}))) AS pr
           FROM lg CROSS JOIN fit_{m} f WHERE lg.split = 'val'),
vn_{m} AS (SELECT va.*, va.pr / s.ps AS pa FROM va_{m} va JOIN (SELECT race_id, sum(pr) AS ps FROM va_{m} GROUP BY race_id) s
           USING (race_id)),
ls_{m} AS (SELECT ln(greatest(1e-12, least(1 - 1e-12, pa))) - ln(greatest(1e-12, least(1 - 1e-12, uniform_prob))) AS r
           FROM vn_{m} WHERE is_winner = 1),
st_{m} AS (SELECT '{m}' AS method, (SELECT a FROM fit_{m}) AS intercept, (SELECT b FROM fit_{m}) AS coef,
                  count(r) AS n, -avg(r) AS d, stddev_samp(r) / sqrt(count(r)) AS se FROM ls_{m})"""


_MARGINS = (_margin_cte("power", "pow(pi, {t})", "0.01", "10.0", "pow(pi, {t})", True, True)
            + _margin_cte("odds_ratio", "pi / ({t} + pi)", "0.0", "pmax * 1000.0", "pi / ({t} + pi)", False, False)
            + _margin_cte("shin", "(sqrt({t} * {t} + 4 * (1 - {t}) * pi) - {t}) / 2", "1e-6", "(1 - 1e-6)",
                          "(sqrt({t} * {t} + 4 * (1 - {t}) * pi) - {t}) / 2", False, True))

_METHODS = ("mm", "odds_ratio", "shin", "power")

SQL["margin_logit"] = "WITH RECURSIVE " + PANEL + _MARGINS + """,
un AS (SELECT race_id, 1.0 / count(*) AS uniform_prob FROM panel GROUP BY race_id),
lg AS (SELECT p.race_id, p.horse_id, p.split, p.is_winner, un.uniform_prob,
              ln(p.sp_win_prob / (1 - p.sp_win_prob)) AS x_mm,
              ln(a.p / (1 - a.p)) AS x_power, ln(b.p / (1 - b.p)) AS x_odds_ratio, ln(c.p / (1 - c.p)) AS x_shin
       FROM panel p JOIN un USING (race_id)
       JOIN mg_power a USING (race_id, horse_id) JOIN mg_odds_ratio b USING (race_id, horse_id)
       JOIN mg_shin c USING (race_id, horse_id))""" + "".join(_logit_fit(m) for m in _METHODS) + """
SELECT method, round(intercept, 6) AS intercept, round(coef, 6) AS coef, CAST(n AS BIGINT) AS n,
       round(d, 6) AS mean_logscore_diff, round(se, 6) AS standard_error,
       round(d / nullif(se, 0), 6) AS z_statistic, round(""" + sql_normal_cdf("d / nullif(se, 0)") + """, 6) AS p_value,
       """ + sql_normal_cdf("d / nullif(se, 0)") + """ < 0.05 AS reject_null
FROM (""" + " UNION ALL ".join(f"SELECT * FROM st_{m}" for m in _METHODS) + ")"


# ------------------------------------------------------------------ the whole study: market + text conditional logits

_STUDY = _TRAIN + """,
sel0 AS (SELECT i FROM chp WHERE lag = 1 AND p < 0.05),
sel AS (SELECT i FROM sel0 UNION ALL SELECT i FROM ids WHERE NOT EXISTS (SELECT 1 FROM sel0)),
rw AS (SELECT l.race_id, l.horse_id, l.split, l.is_winner, ln(l.sp_win_prob / (1 - l.sp_win_prob)) AS logit_sp_win_prob,
              CASE WHEN l.hrn > 1 AND l.prev_t IN (SELECT i FROM sel) THEN l.prev_t END AS f FROM lagged l),
tv AS (SELECT * FROM rw WHERE split = 'train'),
nbc AS (SELECT is_winner AS y, count(*) AS n FROM tv GROUP BY is_winner),
nbk AS (SELECT is_winner AS y, f AS j, count(*) AS k FROM tv WHERE f IS NOT NULL GROUP BY 1, 2),
nbt AS (SELECT sel.i AS j, nbc.y, (coalesce(nbk.k, 0) + 1.0) / (nbc.n + 2.0) AS theta
        FROM sel CROSS JOIN nbc LEFT JOIN nbk ON nbk.j = sel.i AND nbk.y = nbc.y),
nbb AS (SELECT y, sum(ln(1 - theta)) AS b FROM nbt GROUP BY y),
nbpr AS (SELECT y, ln(n / (SELECT sum(n) FROM nbc)) AS lp FROM nbc),
nbj AS (SELECT r.race_id, r.horse_id, pr.y, pr.lp + bb.b + coalesce(ln(t.theta) - ln(1 - t.theta), 0) AS jl
        FROM rw r CROSS JOIN nbpr pr JOIN nbb bb ON bb.y = pr.y LEFT JOIN nbt t ON t.y = pr.y AND t.j = r.f),
nbp AS (SELECT race_id, horse_id,
          1 / (1 + exp(greatest(-700, least(700, max(jl) FILTER (WHERE y = 0) - max(jl) FILTER (WHERE y = 1))))) AS nb
        FROM nbj GROUP BY race_id, horse_id),
vp AS (SELECT r.is_winner, n.nb AS x FROM rw r JOIN nbp n USING (race_id, horse_id) WHERE r.split = 'val'),
ipts AS (SELECT x, count(*) AS n, sum(is_winner) AS sy FROM vp GROUP BY x),
ipc AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(sy) OVER (ORDER BY x) AS csy,
               sum(n) OVER (ORDER BY x) AS cn FROM ipts),
isg AS (SELECT a.i AS j, b.i AS k, (b.csy - a.csy + a.sy) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m
        FROM ipc a JOIN ipc b ON a.i <= b.i),
imn AS (SELECT ipc.i, s.j, min(s.m) AS mn FROM ipc JOIN isg s ON s.j <= ipc.i AND s.k >= ipc.i GROUP BY ipc.i, s.j),
ifit AS (SELECT ipc.x, max(imn.mn) AS f FROM imn JOIN ipc USING (i) GROUP BY ipc.x),
idv AS (SELECT DISTINCT nb AS v FROM nbp),
inb AS (SELECT idv.v, (SELECT max(x) FROM ifit WHERE x <= idv.v) AS lox, (SELECT min(x) FROM ifit WHERE x >= idv.v) AS hix
        FROM idv),
ical AS (SELECT inb.v, CASE WHEN inb.lox IS NULL THEN fh.f WHEN inb.hix IS NULL THEN fl.f WHEN inb.lox = inb.hix THEN fl.f
                            ELSE fl.f + (fh.f - fl.f) * (inb.v - inb.lox) / (inb.hix - inb.lox) END AS c
         FROM inb LEFT JOIN ifit fl ON fl.x = inb.lox LEFT JOIN ifit fh ON fh.x = inb.hix),
rn AS (SELECT r.race_id, r.horse_id, r.split, r.is_winner, r.logit_sp_win_prob, n.nb, least(1.0, ical.c) AS cnb
       FROM rw r JOIN nbp n USING (race_id, horse_id) JOIN ical ON ical.v = n.nb),
rsum AS (SELECT race_id, sum(nb) AS s1, sum(cnb) AS s2 FROM rn GROUP BY race_id),
lx AS (SELECT rn.*, rn.nb / nullif(rsum.s1, 0) AS q1, rn.cnb / nullif(rsum.s2, 0) AS q2 FROM rn JOIN rsum USING (race_id)),
lz AS (SELECT lx.*,
         CASE WHEN q1 IS NULL THEN NULL ELSE greatest(1e-12, least(1 - 1e-12, q1)) END AS p1,
         CASE WHEN q2 IS NULL THEN NULL ELSE greatest(1e-12, least(1 - 1e-12, q2)) END AS p2 FROM lx),
st AS (SELECT race_id, split, is_winner, logit_sp_win_prob AS xs, ln(p1 / (1 - p1)) AS x_nb, ln(p2 / (1 - p2)) AS x_cnb
       FROM lz)
"""


def _cl1(s: str, x: str) -> str:
    """One-feature Newton fit that stops like the Spark fit (|step| < 1e-10, at most 50 steps);
    a fit that does not converge reports NULL."""
    return f""",
tr_{s} AS (SELECT race_id, {x} AS x, is_winner AS y FROM st WHERE split = 'train' AND {x} IS NOT NULL),
k1_{s} AS (SELECT race_id FROM tr_{s} GROUP BY race_id HAVING sum(y) = 1 AND count(*) > 1),
d_{s} AS (SELECT tr_{s}.* FROM tr_{s} JOIN k1_{s} USING (race_id)),
nt_{s}(it, b1, h, stp) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT it + 1, b1 + g / hh, hh, abs(g / hh)
  FROM (SELECT it, b1, sum(xw - s1 / s0) AS g, sum(s2 / s0 - (s1 / s0) * (s1 / s0)) AS hh
        FROM (SELECT nt.it, nt.b1, d.race_id, sum(exp(nt.b1 * d.x)) AS s0, sum(d.x * exp(nt.b1 * d.x)) AS s1,
                     sum(d.x * d.x * exp(nt.b1 * d.x)) AS s2, sum(d.y * d.x) AS xw
              FROM nt_{s} nt, d_{s} d WHERE nt.it < 50 AND (nt.stp IS NULL OR nt.stp >= 1e-10)
              GROUP BY nt.it, nt.b1, d.race_id) per
        GROUP BY it, b1) agg),
var_{s} AS (SELECT max(r1) > 0 AS ok FROM (SELECT race_id, max(x) - min(x) AS r1 FROM d_{s} GROUP BY race_id)),
fin_{s} AS (SELECT CASE WHEN stp < 1e-10 THEN b1 END AS b1, CASE WHEN stp < 1e-10 THEN 1 / sqrt(h) END AS se1,
                   CAST(NULL AS DOUBLE) AS b2, CAST(NULL AS DOUBLE) AS se2
            FROM nt_{s} WHERE it = (SELECT max(it) FROM nt_{s}) AND (SELECT ok FROM var_{s})
            UNION ALL
            SELECT NULL, NULL, NULL, NULL WHERE NOT coalesce((SELECT ok FROM var_{s}), false))"""


def _cl2(s: str, x1: str, x2: str) -> str:
    """Two-feature Newton fit with the Spark fit's stopping rule; NULL when it does not converge."""
    return f""",
tr_{s} AS (SELECT race_id, {x1} AS x1, {x2} AS x2, is_winner AS y FROM st
           WHERE split = 'train' AND {x1} IS NOT NULL AND {x2} IS NOT NULL),
k1_{s} AS (SELECT race_id FROM tr_{s} GROUP BY race_id HAVING sum(y) = 1 AND count(*) > 1),
d_{s} AS (SELECT tr_{s}.* FROM tr_{s} JOIN k1_{s} USING (race_id)),
nt_{s}(it, b1, b2, h11, h12, h22, stp) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
         CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT it + 1, b1 + d1, b2 + d2, h11, h12, h22, greatest(abs(d1), abs(d2))
  FROM (SELECT *, (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS d1, (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS d2
        FROM (SELECT it, b1, b2, sum(xw1 - s1a / s0) AS g1, sum(xw2 - s1b / s0) AS g2,
                     sum(s2aa / s0 - s1a * s1a / (s0 * s0)) AS h11, sum(s2ab / s0 - s1a * s1b / (s0 * s0)) AS h12,
                     sum(s2bb / s0 - s1b * s1b / (s0 * s0)) AS h22
              FROM (SELECT nt.it, nt.b1, nt.b2, d.race_id,
                           sum(exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s0,
                           sum(d.x1 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s1a,
                           sum(d.x2 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s1b,
                           sum(d.x1 * d.x1 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s2aa,
                           sum(d.x1 * d.x2 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s2ab,
                           sum(d.x2 * d.x2 * exp(nt.b1 * d.x1 + nt.b2 * d.x2)) AS s2bb,
                           sum(d.y * d.x1) AS xw1, sum(d.y * d.x2) AS xw2
                    FROM nt_{s} nt, d_{s} d WHERE nt.it < 50 AND (nt.stp IS NULL OR nt.stp >= 1e-10)
                    GROUP BY nt.it, nt.b1, nt.b2, d.race_id) per
              GROUP BY it, b1, b2) agg) st2),
var_{s} AS (SELECT max(r1) > 0 AND max(r2) > 0 AS ok
            FROM (SELECT race_id, max(x1) - min(x1) AS r1, max(x2) - min(x2) AS r2 FROM d_{s} GROUP BY race_id)),
fin_{s} AS (SELECT CASE WHEN stp < 1e-10 THEN b1 END AS b1,
                   CASE WHEN stp < 1e-10 THEN sqrt(h22 / (h11 * h22 - h12 * h12)) END AS se1,
                   CASE WHEN stp < 1e-10 THEN b2 END AS b2,
                   CASE WHEN stp < 1e-10 THEN sqrt(h11 / (h11 * h22 - h12 * h12)) END AS se2
            FROM nt_{s} WHERE it = (SELECT max(it) FROM nt_{s}) AND (SELECT ok FROM var_{s})
            UNION ALL
            SELECT NULL, NULL, NULL, NULL WHERE NOT coalesce((SELECT ok FROM var_{s}), false))"""


def _coef_row(model: str, s: str) -> str:
    return f"SELECT '{model}' AS model, " + _coef_cols("beta", "b1", "se1") + ", " + _coef_cols("gamma", "b2", "se2") \
        + f" FROM fin_{s}"


SQL["text_choice_fit"] = _with(_STUDY + _cl1("base", "xs") + _cl2("nb", "xs", "x_nb") + _cl2("cnb", "xs", "x_cnb") + "\n"
                               + "\nUNION ALL ".join([_coef_row("baseline", "base"), _coef_row("nb", "nb"),
                                                      _coef_row("calibrated_nb", "cnb")]),
                               base="RECURSIVE " + PANEL)


def _raw_params(s: str, col: str) -> str:
    return f"(SELECT {col} FROM nt_{s} WHERE it = (SELECT max(it) FROM nt_{s}))"


_BETS = (_STUDY + _cl1("base", "xs") + _cl2("nb", "xs", "x_nb") + """,
bt AS (SELECT lz.race_id, lz.horse_id, lz.split, lz.is_winner, p.sp, p.date, lz.p1 AS text_prob,
              lz.logit_sp_win_prob AS xs, ln(lz.p1 / (1 - lz.p1)) AS x_nb,
              1.0 / count(*) OVER (PARTITION BY lz.race_id) AS uniform_prob
       FROM lz JOIN panel p USING (race_id, horse_id)),
bu AS (SELECT bt.*, """ + _raw_params("base", "b1") + """ * xs AS u0,
              """ + _raw_params("nb", "b1") + " * xs + " + _raw_params("nb", "b2") + """ * x_nb AS u1 FROM bt),
bm AS (SELECT bu.*, max(u0) OVER (PARTITION BY race_id) AS m0, max(u1) OVER (PARTITION BY race_id) AS m1 FROM bu),
be AS (SELECT bm.*, exp(u0 - m0) AS e0, exp(u1 - m1) AS e1 FROM bm),
bp AS (SELECT be.*, e0 / sum(e0) OVER (PARTITION BY race_id) AS market_prob,
              e1 / sum(e1) OVER (PARTITION BY race_id) AS full_prob FROM be),
ranked AS (SELECT bp.*,
   row_number() OVER (PARTITION BY race_id
     ORDER BY md5(concat_ws('-', CAST(race_id AS VARCHAR), CAST(horse_id AS VARCHAR), '42')), horse_id) AS rk_random,
   row_number() OVER (PARTITION BY race_id ORDER BY text_prob DESC, horse_id) AS rk_text,
   row_number() OVER (PARTITION BY race_id ORDER BY market_prob DESC, horse_id) AS rk_market,
   row_number() OVER (PARTITION BY race_id ORDER BY full_prob DESC, horse_id) AS rk_full
   FROM bp WHERE split = 'test'),
picks AS (
  SELECT 'random' AS strategy, date, sp, is_winner, uniform_prob AS prob FROM ranked WHERE rk_random = 1
  UNION ALL SELECT 'text', date, sp, is_winner, text_prob FROM ranked WHERE rk_text = 1
  UNION ALL SELECT 'market', date, sp, is_winner, market_prob FROM ranked WHERE rk_market = 1
  UNION ALL SELECT 'full', date, sp, is_winner, full_prob FROM ranked WHERE rk_full = 1),
wg AS (SELECT *, CASE WHEN round(round(prob * (sp - 1) - (1 - prob), 12), 9) > 0.15
                      THEN coalesce(greatest((sp * prob - 1) / nullif(sp - 1, 0), 0), 0) ELSE 0.0 END AS wager FROM picks),
pl AS (SELECT *, CASE WHEN wager > 0 THEN (CASE WHEN is_winner = 1 THEN wager * (sp - 1) ELSE -wager END)
                      ELSE 0.0 END AS pnl FROM wg)
""")

SQL["strategy_backtest"] = _with(_BETS + """
SELECT strategy, round(sum(pnl), 6) AS pnl, CAST(count(*) FILTER (WHERE wager > 0) AS BIGINT) AS num_bets,
       round(coalesce(sum(pnl) / nullif(sum(wager), 0), 0), 6) AS roi
FROM pl GROUP BY strategy
""", base="RECURSIVE " + PANEL)

SQL["study_equity_curve"] = _with(_BETS + """,
daily AS (SELECT strategy, date, sum(pnl) AS daily_pnl FROM pl GROUP BY strategy, date)
SELECT strategy, CAST(date AS VARCHAR) AS date, round(daily_pnl, 6) AS daily_pnl,
       round(sum(daily_pnl) OVER (PARTITION BY strategy ORDER BY date
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_pnl
FROM daily""", base="RECURSIVE " + PANEL)

_TESTED = """,
tm AS (SELECT model, count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM td GROUP BY model),
tt AS (SELECT *, sd / sqrt(n) AS se, mean_diff / nullif(sd / sqrt(n), 0) AS t_stat FROM tm),
tp AS (SELECT *, """ + sql_t_two_sided("t_stat", "(n - 1)") + """ AS p2 FROM tt),
tq AS (SELECT *, CASE WHEN mean_diff > 0 THEN p2 / 2 ELSE 1 - p2 / 2 END AS p1 FROM tp)
"""

SQL["study_classifier_tests"] = _with(_STUDY + """,
td AS (SELECT m.model, 0.5 - 2 * pow(m.p - is_winner, 2) AS d
       FROM (SELECT 'nb' AS model, nb AS p, is_winner FROM rn WHERE split = 'val'
             UNION ALL SELECT 'calibrated_nb', cnb, is_winner FROM rn WHERE split = 'val') m)""" + _TESTED + """
SELECT model, round(t_stat, 6) AS t_statistic, round(p1, 6) AS p_value, round(least(p1 * 2, 1.0), 6) AS p_value_bonferroni,
       round(mean_diff, 6) AS mean_brier_diff, CAST(n AS BIGINT) AS n FROM tq""", base="RECURSIVE " + PANEL)

SQL["study_brier_tests"] = _with(_STUDY + _cl1("base", "xs") + _cl2("nb", "xs", "x_nb") + _cl2("cnb", "xs", "x_cnb") + """,
bt AS (SELECT race_id, is_winner, logit_sp_win_prob AS xs, ln(p1 / (1 - p1)) AS x_nb, ln(p2 / (1 - p2)) AS x_cnb
       FROM lz WHERE split = 'val'),
bu AS (SELECT bt.*, """ + _raw_params("base", "b1") + " * xs AS u0, " + _raw_params("nb", "b1") + " * xs + "
    + _raw_params("nb", "b2") + " * x_nb AS u1, " + _raw_params("cnb", "b1") + " * xs + " + _raw_params("cnb", "b2")
    + """ * x_cnb AS u2 FROM bt),
be AS (SELECT race_id, is_winner, exp(u0 - max(u0) OVER w) AS e0, exp(u1 - max(u1) OVER w) AS e1, exp(u2 - max(u2) OVER w) AS e2
       FROM bu WINDOW w AS (PARTITION BY race_id)),
bp AS (SELECT is_winner, e0 / sum(e0) OVER w AS q0, e1 / sum(e1) OVER w AS q1, e2 / sum(e2) OVER w AS q2
       FROM be WINDOW w AS (PARTITION BY race_id)),
td AS (SELECT 'nb' AS model, CASE WHEN (SELECT b1 FROM fin_nb) IS NOT NULL
                                  THEN pow(q0 - is_winner, 2) - pow(q1 - is_winner, 2) END AS d FROM bp
       UNION ALL SELECT 'calibrated_nb', CASE WHEN (SELECT b1 FROM fin_cnb) IS NOT NULL
                                              THEN pow(q0 - is_winner, 2) - pow(q2 - is_winner, 2) END FROM bp)""" + _TESTED + """
SELECT model, CAST(n AS BIGINT) AS n, round(t_stat, 6) AS t_stat, round(p1, 6) AS p_val_one_sided,
       round(mean_diff, 6) AS mean_brier_diff, round(se, 6) AS se, round(mean_diff - 1.96 * se, 6) AS ci_lower,
       round(mean_diff + 1.96 * se, 6) AS ci_upper FROM tq""", base="RECURSIVE " + PANEL)

SQL["dictionary"] = "WITH " + TOK + """
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id, CAST(count(*) AS BIGINT) AS df
FROM bow GROUP BY term
"""

SQL["doc2bow"] = "WITH " + TOK + """,
voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id
        FROM (SELECT DISTINCT term FROM bow))
SELECT bow.doc_id, CAST(voc.term_id AS BIGINT) AS term_id, CAST(bow.n AS BIGINT) AS n FROM bow JOIN voc USING (term)
"""
