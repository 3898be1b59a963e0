"""Named queries: summaries, backtests, earlier-rules replay and the monthly report."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.functions.classify import SPLIT_RATIOS
from folioflux.operators import consensus as S
from folioflux.operators import coverage as G
from folioflux.operators import eligibility as E
from folioflux.operators import legacy as L
from folioflux.operators import research as R
from folioflux.operators import summary as T
from folioflux.plans.audit import window_of
from folioflux.plans.base import SCHEME_LABEL, STOCK_LABEL, cte, half_up, query, r, rupees
from folioflux.plans.comparison import eligible_of, pairs_of
from folioflux.plans.signals import consensus_of, ranked_of
from folioflux.sources.staging import cut

TODAY = "2001-10-20"
ITERATIONS = 5_000


# -- summaries ------------------------------------------------------------------------------------

cte("v_assess", """
WITH f AS (SELECT scheme_id, report_month, count(*) FILTER (WHERE instrument_type = 'equity') AS eq, bool_or(instrument_type IS NULL) AS untyped,
   bool_or(instrument_type = 'equity' AND (qty_change IS NULL OR action NOT IN ('new', 'added', 'trimmed', 'exited', 'unchanged'))) AS invalid
  FROM v_deltas LEFT JOIN v_stock USING (isin) GROUP BY ALL)
SELECT w.scheme_id, w.report_month, CASE WHEN wh_now OR (f.eq IS NOT NULL AND wh_prev) THEN 'quarantined' WHEN coalesce(invalid, false) THEN 'nonfinite_or_invalid_data'
  WHEN coalesce(status_now, '') <> 'ok' THEN 'unvalidated' WHEN coalesce(untyped, false) THEN 'unknown_instrument_type' WHEN coalesce(eq, 0) = 0 THEN 'no_data' END AS reason
FROM v_winflags w LEFT JOIN f USING (scheme_id, report_month) WHERE held_now""")


@query("assess_summary", "SELECT * FROM v_assess")
def _(d):
    return T.assess_summary(d.deltas, d.stocks, window_of(d))


def _top(action, order):
    return f"""t_{action} AS (SELECT scheme_id, report_month, stock_name, qty_change FROM e WHERE action = '{action}'
  QUALIFY row_number() OVER (PARTITION BY scheme_id, report_month ORDER BY CASE WHEN nf > 0 THEN flow_lakhs ELSE value_change_lakhs END {order} NULLS LAST, isin) = 1)"""


@query("summary_facts", f"""
WITH e AS (SELECT d.*, trim(regexp_replace(name, '^EQ *- *', '')) AS stock_name, count(flow_lakhs) OVER (PARTITION BY scheme_id, report_month, action) AS nf
   FROM v_deltas d JOIN v_stock USING (isin) WHERE instrument_type = 'equity'),
 {_top('new', 'DESC')}, {_top('added', 'DESC')}, {_top('trimmed', 'ASC')},
 x AS (SELECT scheme_id, report_month, stock_name, row_number() OVER (PARTITION BY scheme_id, report_month ORDER BY
   CASE WHEN nf > 0 THEN flow_lakhs ELSE value_change_lakhs END NULLS LAST, isin) AS rn FROM e WHERE action = 'exited'),
 xn AS (SELECT scheme_id, report_month, string_agg(stock_name, ', ' ORDER BY rn) FILTER (WHERE rn <= 5) AS names FROM x GROUP BY ALL),
 c AS (SELECT scheme_id, report_month, count(*) FILTER (WHERE action = 'new') AS n_new, count(*) FILTER (WHERE action = 'added') AS n_added,
   count(*) FILTER (WHERE action = 'trimmed') AS n_trimmed, count(*) FILTER (WHERE action = 'exited') AS n_exited,
   bool_and(flow_lakhs IS NOT NULL) FILTER (WHERE action = 'added') AS added_priced FROM e GROUP BY ALL)
SELECT c.scheme_id, c.report_month, n_new, n_added, n_trimmed, n_exited, a.stock_name AS largest_new, b.stock_name AS largest_added, t.stock_name AS largest_trimmed,
  t.qty_change AS trimmed_shares, coalesce(names, '') AS exit_names, greatest(0, n_exited - 5) AS exits_more, coalesce(added_priced, true) AS priced_added
FROM c LEFT JOIN t_new a USING (scheme_id, report_month) LEFT JOIN t_added b USING (scheme_id, report_month)
LEFT JOIN t_trimmed t USING (scheme_id, report_month) LEFT JOIN xn USING (scheme_id, report_month)""")
def _(d):
    f = T.summary_facts(d.deltas, d.stocks)
    return f.select("scheme_id", "report_month", "n_new", "n_added", "n_trimmed", "n_exited", F.col("top_new.stock_name").alias("largest_new"),
                    F.col("top_added.stock_name").alias("largest_added"), F.col("top_trimmed.stock_name").alias("largest_trimmed"),
                    F.col("top_trimmed.qty_change").alias("trimmed_shares"), F.concat_ws(", ", "exit_names").alias("exit_names"), "exits_more", "priced_added")


def _facts(where):
    def leader(action, order):
        known = "CASE WHEN nf > 0 THEN flow_lakhs ELSE value_change_lakhs END"
        return f"""l_{action} AS (SELECT scheme_id, report_month, stock_name, qty_change, flow_lakhs AS flow, value_change_lakhs AS val, price_effect_lakhs AS price, pct_nav_change AS nav,
    CASE WHEN nf > 0 THEN nf ELSE nv END = n AS priced FROM e WHERE action = '{action}' QUALIFY row_number() OVER (PARTITION BY scheme_id, report_month ORDER BY {known} {order} NULLS LAST, isin) = 1)"""

    def detail(t, with_price=False):
        both = f"{t}.flow IS NOT NULL AND {t}.val IS NOT NULL"
        flow, val, price = rupees(f"{t}.flow"), rupees(f"{t}.val"), rupees(f"{t}.price")
        full = f"WHEN {both} AND abs({t}.price) >= 5 THEN ' (' || {flow} || ' flow, ' || {price} || ' price effect, ' || {val} || ' value change)'" if with_price else ""
        return f"""CASE {full} WHEN {both} THEN ' (' || {flow} || ' flow, ' || {val} || ' value change)' WHEN {t}.val IS NOT NULL THEN ' (' || {val} || ')'
    WHEN {t}.flow IS NOT NULL THEN ' (' || {flow} || ' flow)' ELSE '' END"""

    def moved(t, n, verb, best, one, way):
        return f"""CASE WHEN {n} > 0 THEN '- {verb} ' || {n} || CASE WHEN {t}.priced THEN '{best}' ELSE '{one}' END || {t}.stock_name || ', {way} ' || format('{{:,.0f}}', abs({t}.qty_change)) || ' shares'
    || {detail(t, True)} || '.' END"""
    value = "coalesce(a.flow, a.val)"
    return f"""
WITH e AS (SELECT d.*, {STOCK_LABEL} AS stock_name, count(flow_lakhs) OVER k AS nf, count(value_change_lakhs) OVER k AS nv, count(*) OVER k AS n
   FROM v_deltas d JOIN v_stock USING (isin) WHERE {where} WINDOW k AS (PARTITION BY scheme_id, report_month, action)),
 {leader('new', 'DESC')}, {leader('added', 'DESC')}, {leader('trimmed', 'ASC')},
 x AS (SELECT scheme_id, report_month, stock_name, row_number() OVER (PARTITION BY scheme_id, report_month ORDER BY CASE WHEN nf > 0 THEN flow_lakhs ELSE value_change_lakhs END NULLS LAST, isin) AS rn
   FROM e WHERE action = 'exited'),
 xn AS (SELECT scheme_id, report_month, string_agg(stock_name, ', ' ORDER BY rn) FILTER (WHERE rn <= 5) || CASE WHEN count(*) > 5 THEN ', and ' || (count(*) - 5) || ' more' ELSE '' END || '.' AS gone FROM x GROUP BY ALL),
 c AS (SELECT scheme_id, report_month, count(*) AS n_rows, count(*) FILTER (WHERE action = 'new') AS n_new, count(*) FILTER (WHERE action = 'added') AS n_added,
   count(*) FILTER (WHERE action = 'trimmed') AS n_trimmed, count(*) FILTER (WHERE action = 'exited') AS n_exited FROM e GROUP BY ALL)
SELECT c.*, gone, concat_ws(chr(10), CASE WHEN n_new > 0 THEN '- Opened ' || n_new || CASE WHEN a.priced THEN ' new position(s). The largest new entry was ' ELSE ' new position(s). One new entry was ' END || a.stock_name || ', '
   || CASE WHEN {value} IS NOT NULL THEN 'a ₹' || {half_up(f'{value} / 100.0::DOUBLE', 1)} || ' Cr position' ELSE format('{{:,.0f}}', a.qty_change) || ' shares; value unavailable' END
   || ' (' || coalesce({half_up('a.nav', 2)} || '% of NAV', 'NAV weight unavailable') || ')' || {detail('a')} || '.' END,
  {moved('b', 'n_added', 'Added to', ' existing position(s). The biggest addition was ', ' existing position(s). One addition was ', 'up')},
  {moved('t', 'n_trimmed', 'Trimmed', ' position(s). The largest cut was ', ' position(s). One cut was ', 'down')}, '- Fully exited: ' || gone) AS lines
FROM c LEFT JOIN l_new a USING (scheme_id, report_month) LEFT JOIN l_added b USING (scheme_id, report_month) LEFT JOIN l_trimmed t USING (scheme_id, report_month)
LEFT JOIN xn USING (scheme_id, report_month)"""


cte("v_facts_equity", _facts("instrument_type = 'equity'"))
cte("v_facts_other", _facts("instrument_type <> 'equity'"))
HEAD = f"{SCHEME_LABEL} || ' (' || amc_name || ') — ' || report_month"
QUIET = "'- No material changes versus the previous month.'"
cte("v_summaries", f"""
SELECT scheme_id, report_month, CASE WHEN reason IN ('quarantined', 'nonfinite_or_invalid_data') THEN {HEAD} || ' data withheld: ' || CASE reason WHEN 'quarantined'
    THEN 'the current or referenced previous month is quarantined' ELSE 'holding-change data contains invalid numeric values or actions' END || '. Not zero activity — the numbers did not pass checks.'
  WHEN n_rows IS NULL THEN 'No holding-change data available for ' || {SCHEME_LABEL} || ' in ' || report_month || ' yet (data may not have been ingested for this month, or this is the first month tracked).'
  ELSE {HEAD} || ' portfolio changes:' || chr(10) || CASE WHEN lines = '' THEN {QUIET} ELSE lines END END AS text, reason IS NULL AS eligible, reason
FROM v_assess JOIN v_scheme USING (scheme_id) LEFT JOIN v_facts_equity USING (scheme_id, report_month)""")


@query("scheme_summaries", "SELECT * FROM v_summaries")
def _(d):
    return T.scheme_summaries(d.deltas, d.stocks, d.schemes, window_of(d))


@query("summaries_all_instruments", f"""
SELECT scheme_id, report_month, concat_ws(chr(10), {HEAD} || ' portfolio changes:', CASE WHEN q.n_rows IS NULL THEN '- No material equity changes versus the previous month.'
   WHEN q.lines = '' THEN {QUIET} ELSE q.lines END,
  '- Non-equity holdings (money-market/bond maturities, not equity calls): ' || o.n_rows || ' change(s) (' || o.n_new || ' new, ' || o.n_added || ' added, ' || o.n_trimmed || ' trimmed, ' || o.n_exited || ' exited).',
  '- Non-equity exits (maturities, not equity exits): ' || o.gone) AS text
FROM v_facts_equity q FULL JOIN v_facts_other o USING (scheme_id, report_month) JOIN v_scheme USING (scheme_id)""")
def _(d):
    equity = T.summary_facts(d.deltas, d.stocks)
    other = T.summary_facts(d.deltas, d.stocks.filter(F.col("instrument_type") != "equity"), None)
    return T.render_summary(equity, d.schemes, other)


@query("digest", """
SELECT report_month, scheme_id, 'Monthly digest — ' || report_month || ' (' || count(*) OVER (PARTITION BY report_month) || ' scheme(s))' AS header, text
FROM v_summaries JOIN v_scheme USING (scheme_id) WHERE is_active_equity = 1""")
def _(d):
    return T.digest(T.scheme_summaries(d.deltas, d.stocks, d.schemes, window_of(d)),
                    E.active_equity(d.schemes).select("scheme_id"))


# -- monthly ranking backtest --------------------------------------------------------------------------

def periods_of(d):
    return R.holding_periods(d.deltas.select("report_month").distinct(), d.prices_daily, TODAY)


def panel_of(d):
    return cut(R.build_panel(S.with_filings(consensus_of(d), d.filings), periods_of(d), d.prices_daily)
               .select("report_month", "isin", "ret", "group", "active_group", "partial_period", "is_new_to_universe"))


cte("v_days", "SELECT DISTINCT trade_date AS day FROM v_prices_daily")
cte("v_periods", f"""
WITH m AS (SELECT DISTINCT report_month, last_day((report_month || '-01')::DATE) + 11 AS entry_target,
   last_day((report_month || '-01')::DATE + INTERVAL 1 MONTH) + 11 AS exit_target FROM v_deltas),
 x AS (SELECT *, exit_target > DATE '{TODAY}' AS partial_period, (SELECT min(day) FROM v_days WHERE day BETWEEN entry_target AND entry_target + 10) AS entry_date,
   (SELECT min(day) FROM v_days WHERE day BETWEEN exit_target AND exit_target + 10) AS exit0 FROM m),
 y AS (SELECT *, CASE WHEN exit0 IS NULL AND partial_period THEN (SELECT max(day) FROM v_days) ELSE exit0 END AS exit1 FROM x),
 z AS (SELECT *, CASE WHEN entry_date IS NULL OR exit1 > entry_date THEN exit1 END AS exit_date FROM y)
SELECT report_month, entry_target, exit_target, partial_period, entry_date, exit_date, CASE WHEN entry_target > DATE '{TODAY}' THEN 'not_public_yet'
  WHEN entry_date IS NULL THEN 'no_entry_close' WHEN exit_date IS NULL THEN 'no_exit_close' END AS reason FROM z""")
cte("v_entry", """
SELECT report_month, partial_period, isin, close_price AS px_in FROM v_periods JOIN v_prices_daily ON trade_date = entry_date WHERE reason IS NULL""")
cte("v_exit", "SELECT report_month, isin, close_price AS px_out FROM v_periods JOIN v_prices_daily ON trade_date = exit_date WHERE reason IS NULL")
cte("v_panel", """
SELECT j.report_month, j.isin, is_new_to_universe, partial_period, px_out / px_in - 1 AS ret,
  CASE WHEN net_amc_count > 0 THEN CASE WHEN is_common THEN 'mf_and_fii' ELSE 'mf_only' END WHEN net_amc_count = 0 THEN 'mf_neutral' ELSE 'mf_selling' END AS grp,
  CASE WHEN coalesce(net_active_amc_count, 0) > 0 THEN CASE WHEN is_common AND net_amc_count > 0 THEN 'active_and_fii' ELSE 'active_only' END
    WHEN coalesce(net_active_amc_count, 0) = 0 THEN 'active_neutral' ELSE 'active_selling' END AS active_grp
FROM v_joined j JOIN v_entry i ON i.isin = j.isin AND i.report_month = j.report_month
JOIN v_exit o ON o.isin = j.isin AND o.report_month = j.report_month""")
cte("v_bygroup", """
SELECT report_month, isin, ret, grp AS group_name FROM v_panel UNION ALL SELECT report_month, isin, ret, active_grp FROM v_panel""")
cte("v_results", """
WITH u AS (SELECT report_month, count(*) AS universe_n, avg(ret) AS um, median(ret) AS umd, bool_or(partial_period) AS partial_period FROM v_panel GROUP BY 1),
 g AS (SELECT b.report_month, group_name, count(*) AS n, avg(ret) AS mean, median(ret) AS median, avg((ret > 0)::INT) AS win_rate, avg((ret > umd)::INT) AS beat
  FROM v_bygroup b JOIN u USING (report_month) GROUP BY ALL)
SELECT u.report_month, n.g AS group_name, universe_n, um AS universe_mean, umd AS universe_median, partial_period, coalesce(g.n, 0) AS n, mean, median, win_rate,
  beat AS beat_universe_rate, mean - um AS excess_mean, median - umd AS excess_median
FROM u CROSS JOIN (SELECT unnest(['mf_and_fii', 'mf_only', 'mf_neutral', 'mf_selling', 'active_and_fii', 'active_only', 'active_neutral', 'active_selling']) AS g) n
LEFT JOIN g ON g.report_month = u.report_month AND g.group_name = n.g""")


@query("signal_groups", """
SELECT report_month, isin, CASE WHEN net_amc_count > 0 THEN CASE WHEN is_common THEN 'mf_and_fii' ELSE 'mf_only' END WHEN net_amc_count = 0 THEN 'mf_neutral' ELSE 'mf_selling' END AS grp,
  CASE WHEN coalesce(net_active_amc_count, 0) > 0 THEN CASE WHEN is_common AND net_amc_count > 0 THEN 'active_and_fii' ELSE 'active_only' END
    WHEN coalesce(net_active_amc_count, 0) = 0 THEN 'active_neutral' ELSE 'active_selling' END AS active_grp FROM v_joined""")
def _(d):
    return R.signal_groups(S.with_filings(consensus_of(d), d.filings)).select("report_month", "isin", F.col("group").alias("grp"), F.col("active_group").alias("active_grp"))


@query("holding_periods", "SELECT * FROM v_periods")
def _(d):
    return periods_of(d).drop("missing_date")


@query("forward_return_panel", f"SELECT report_month, isin, {r('ret', 8)} AS ret, grp, active_grp, partial_period FROM v_panel")
def _(d):
    return C.rounded(panel_of(d).select("report_month", "isin", "ret", F.col("group").alias("grp"), F.col("active_group").alias("active_grp"), "partial_period"), 8)


RESULT_NUMBERS = ("universe_mean", "universe_median", "mean", "median", "win_rate", "beat_universe_rate", "excess_mean", "excess_median")


@query("evaluate_groups", f"SELECT report_month, group_name, universe_n, n, partial_period, {', '.join(f'{r(c, 8)} AS {c}' for c in RESULT_NUMBERS)} FROM v_results")
def _(d):
    return C.rounded(R.evaluate(panel_of(d)).select("report_month", "group_name", "universe_n", "n", "partial_period", *RESULT_NUMBERS), 8)


@query("new_listing_returns", f"""
SELECT report_month, count(*) FILTER (WHERE is_new_to_universe) AS n, {r('avg(ret) FILTER (WHERE is_new_to_universe)', 8)} AS mean FROM v_panel GROUP BY 1""")
def _(d):
    return C.rounded(R.new_listings(panel_of(d)), 8)


@query("permutation_p", f"""
WITH g AS (SELECT report_month, group_name, count(*) AS n, round(avg(ret), 12) AS observed FROM v_bygroup GROUP BY ALL),
 t AS (SELECT report_month, count(*) AS total FROM v_panel GROUP BY 1),
 d AS (SELECT report_month, i, ret, row_number() OVER w AS n, sum(ret) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM v_panel, range(1, {ITERATIONS + 1}) r(i)
  WINDOW w AS (PARTITION BY report_month, i ORDER BY md5('0|' || i || '|' || isin), isin))
SELECT g.report_month, g.group_name, count(*) FILTER (WHERE round(d.s / d.n, 12) >= observed)::DOUBLE / {ITERATIONS} AS p_vs_random
FROM g JOIN t USING (report_month) JOIN d ON d.report_month = g.report_month AND d.n = g.n WHERE g.n < total GROUP BY ALL""")
def _(d):
    return R.permutation_p(panel_of(d), ITERATIONS)


POOLED_SQL = """SELECT group_name, count({x}) FILTER (WHERE NOT partial_period AND {n} > 0) AS periods, avg({x}) FILTER (WHERE NOT partial_period AND {n} > 0) AS m,
  count(*) FILTER (WHERE NOT partial_period AND {n} > 0 AND round({x}, 12) > 0) AS periods_won, stddev_samp({x}) FILTER (WHERE NOT partial_period AND {n} > 0) AS sd FROM {t} GROUP BY 1"""


@query("pooled_track_record", f"""
SELECT group_name, periods, {r('m', 8)} AS mean_excess, periods_won, {r('CASE WHEN periods >= 2 AND sd > 0 THEN m / (sd / sqrt(periods)) END', 5)} AS t_stat
FROM ({POOLED_SQL.format(x='excess_mean', n='n', t='v_results')})""")
def _(d):
    return C.rounded(R.pooled(R.evaluate(panel_of(d)), R.GROUPS + R.ACTIVE_GROUPS), 8, t_stat=5)


@query("track_record", f"""
SELECT v.report_month, entry_date, exit_date, v.partial_period, group_name, n, {r('excess_mean', 8)} AS excess_mean, NULL AS reason, NULL::DATE AS missing_date
FROM v_results v JOIN v_periods USING (report_month) WHERE n > 0
UNION ALL SELECT report_month, entry_date, exit_date, partial_period, NULL, NULL, NULL, reason, CASE WHEN reason = 'no_entry_close' THEN entry_target
  WHEN reason = 'no_exit_close' THEN CASE WHEN partial_period THEN DATE '{TODAY}' ELSE exit_target END END FROM v_periods WHERE reason IS NOT NULL""")
def _(d):
    return C.rounded(R.track_record(R.evaluate(panel_of(d)), periods_of(d)), 8)


# -- quarterly ownership test -----------------------------------------------------------------------------

def quarter_panel_of(d):
    return R.quarter_panel(d.filings)


def quarter_results_of(d):
    panel = quarter_panel_of(d)
    return cut(R.score_quarters(panel, R.quarter_periods(panel, d.prices_daily, TODAY), d.prices_daily))


cte("v_qpanel", """
SELECT c.quarter_end, c.isin, c.mf_pct - p.mf_pct AS d_mf, c.fii_pct - p.fii_pct AS d_fii,
  CASE WHEN c.mf_pct - p.mf_pct >= 0.25 THEN CASE WHEN c.fii_pct - p.fii_pct >= 0.25 THEN 'mf_up_fii_up' ELSE 'mf_up_only' END
   WHEN c.mf_pct - p.mf_pct <= -0.25 THEN 'mf_down' ELSE 'mf_flat' END AS grp
FROM v_quarterly c JOIN v_quarterly p ON p.isin = c.isin AND p.quarter_end = last_day(c.quarter_end - INTERVAL 3 MONTH)
WHERE c.published <= c.quarter_end + 30 AND p.published <= c.quarter_end + 30 AND c.mf_pct IS NOT NULL AND p.mf_pct IS NOT NULL""")
cte("v_qperiods", f"""
WITH m AS (SELECT DISTINCT quarter_end, quarter_end + 30 AS decision, quarter_end + 31 AS entry_target, (last_day(quarter_end + INTERVAL 3 MONTH) + 31)::DATE AS exit_target FROM v_qpanel),
 x AS (SELECT *, exit_target > DATE '{TODAY}' AS partial_period, (SELECT min(day) FROM v_days WHERE day BETWEEN entry_target AND entry_target + 10) AS entry_date,
   (SELECT min(day) FROM v_days WHERE day BETWEEN exit_target AND exit_target + 10) AS exit0 FROM m),
 y AS (SELECT *, CASE WHEN exit0 IS NULL AND partial_period THEN (SELECT max(day) FROM v_days) ELSE exit0 END AS exit1 FROM x),
 z AS (SELECT *, CASE WHEN entry_date IS NULL OR exit1 > entry_date THEN exit1 END AS exit_date FROM y)
SELECT quarter_end, decision, partial_period, entry_date, exit_date, CASE WHEN decision >= DATE '{TODAY}' THEN 'decision_not_reached' WHEN entry_target > DATE '{TODAY}' THEN 'not_public_yet'
  WHEN entry_date IS NULL THEN 'no_entry_close' WHEN exit_date IS NULL THEN 'no_exit_close' END AS reason FROM z""")
cte("v_qentry", """
SELECT quarter_end, partial_period, isin, close_price AS px_in, traded_value FROM v_qperiods JOIN v_prices_daily ON trade_date = entry_date WHERE reason IS NULL""")
cte("v_qexit", "SELECT quarter_end, isin, close_price AS px_out FROM v_qperiods JOIN v_prices_daily ON trade_date = exit_date WHERE reason IS NULL")
cte("v_qresults", """
WITH p AS (SELECT q.*, partial_period, px_out / px_in - 1 AS ret, i.traded_value FROM v_qpanel q
  JOIN v_qentry i ON i.isin = q.isin AND i.quarter_end = q.quarter_end JOIN v_qexit o ON o.isin = q.isin AND o.quarter_end = q.quarter_end),
 k AS (SELECT *, count(*) OVER (PARTITION BY quarter_end) AS nn, row_number() OVER (PARTITION BY quarter_end ORDER BY d_mf, isin) AS rk,
   row_number() OVER (PARTITION BY quarter_end ORDER BY traded_value, isin) AS srk, avg(ret) OVER (PARTITION BY quarter_end) AS base FROM p),
 b AS (SELECT *, CASE WHEN nn >= 5 THEN greatest(0, ((rk - 1) * 5 + nn - 2) // (nn - 1) - 1) ELSE -1 END AS fifth,
   CASE WHEN nn >= 15 THEN greatest(0, ((srk - 1) * 3 + nn - 2) // (nn - 1) - 1) END AS band FROM k),
 a AS (SELECT *, CASE WHEN band IS NOT NULL THEN ret - avg(ret) OVER (PARTITION BY quarter_end, band) END AS adj FROM b),
 g AS (SELECT *, grp AS group_name FROM a UNION ALL SELECT *, 'mf_top_q' FROM a WHERE fifth = 4 UNION ALL SELECT *, 'mf_bottom_q' FROM a WHERE fifth = 0)
SELECT quarter_end, group_name, count(*) AS n, avg(ret) AS mean, avg(ret) - max(base) AS excess_mean, count(adj) AS n_size, avg(adj) AS excess_size,
  bool_or(partial_period) AS partial_period, max(nn) AS universe_n FROM g GROUP BY ALL""")


@query("quarter_signal_panel", f"SELECT quarter_end, isin, {r('d_mf')} AS d_mf, {r('d_fii')} AS d_fii, grp FROM v_qpanel")
def _(d):
    return C.rounded(quarter_panel_of(d).withColumnRenamed("group", "grp"), 6)


@query("quarter_signal_audit", """
SELECT quarter_end, count(*) AS filed, count(*) FILTER (WHERE published <= quarter_end + 30) AS public_by_decision,
  count(*) FILTER (WHERE published > quarter_end + 30) AS late_excluded, count(*) FILTER (WHERE published <= quarter_end + 30 AND basis <> 'observed') AS deadline_basis
FROM v_quarterly GROUP BY 1""")
def _(d):
    return R.quarter_audit(d.filings)


@query("quarter_periods", "SELECT quarter_end, decision, partial_period, entry_date, exit_date, reason FROM v_qperiods")
def _(d):
    return R.quarter_periods(quarter_panel_of(d), d.prices_daily, TODAY).select("quarter_end", "decision", "partial_period", "entry_date", "exit_date", "reason")


@query("score_quarters", f"""
SELECT quarter_end, group_name, n, universe_n, n_size, partial_period, {r('mean', 8)} AS mean, {r('excess_mean', 8)} AS excess_mean, {r('excess_size', 8)} AS excess_size FROM v_qresults""")
def _(d):
    return C.rounded(quarter_results_of(d).drop("universe_mean"), 8)


@query("evidence_table", f"""
WITH a AS ({POOLED_SQL.format(x='excess_mean', n='n', t='v_qresults')}), b AS ({POOLED_SQL.format(x='excess_size', n='n_size', t='v_qresults')}),
 s AS (SELECT a.group_name, a.periods, a.m AS raw_mean, CASE WHEN a.periods >= 2 AND a.sd > 0 THEN a.m / (a.sd / sqrt(a.periods)) END AS raw_t, b.periods AS sized_periods, b.m AS sized_mean,
  CASE WHEN b.periods >= 2 AND b.sd > 0 THEN b.m / (b.sd / sqrt(b.periods)) END AS sized_t FROM a JOIN b USING (group_name) WHERE group_name IN ('mf_up_fii_up', 'mf_up_only', 'mf_down'))
SELECT group_name, periods, {r('raw_mean', 8)} AS raw_mean, {r('raw_t', 5)} AS raw_t, sized_periods, {r('sized_mean', 8)} AS sized_mean, {r('sized_t', 5)} AS sized_t,
  CASE WHEN abs(sized_t) >= 2 THEN CASE WHEN sized_t > 0 THEN 'beats' ELSE 'lags' END END AS finding FROM s""")
def _(d):
    return C.rounded(R.evidence_table(quarter_results_of(d)), 8, raw_t=5, sized_t=5)


# -- monthly report ---------------------------------------------------------------------------------------

def report_lists(d) -> dict:
    """Broadest buying and selling; both come from one ranking."""
    ranked = cut(ranked_of(d).select("report_month", "isin", "stock_name", "rank", "net_amc_count", "net_active_amc_count",
                                     "accumulation_flow_lakhs", "fii_direction", "dii_direction"))
    return {"buying": S.page(ranked, 1, S.TOP_ROWS), "selling": S.page(S.broadest_selling(ranked), 1, S.TOP_ROWS, "sell_rank")}


def monthly_report(d) -> dict:
    """The frames of the monthly report, one per section."""
    results = cut(R.evaluate(panel_of(d)))
    return {"coverage": G.month_coverage(window_of(d), d.schemes, d.deltas, E.voting_schemes(eligible_of(d))), **report_lists(d),
            "evidence": R.evidence_table(quarter_results_of(d)), "track_record": R.track_record(results, periods_of(d)),
            "pooled": R.pooled(results, R.GROUPS + R.ACTIVE_GROUPS)}


@query("monthly_report", f"""
SELECT 'coverage' AS section, m.report_month AS period, NULL AS name, count(DISTINCT scheme_id) AS number FROM (SELECT DISTINCT report_month FROM v_months) m LEFT JOIN v_eligible e USING (report_month) GROUP BY m.report_month
UNION ALL SELECT 'buying', report_month, isin, rank FROM v_ranked WHERE rank <= 15
UNION ALL SELECT 'selling', report_month, isin, p FROM (SELECT *, row_number() OVER (PARTITION BY report_month ORDER BY net_amc_count, accumulation_flow_lakhs NULLS LAST, rank) AS p FROM v_ranked) WHERE p <= 15
UNION ALL SELECT 'evidence', NULL, group_name, count(excess_mean) FILTER (WHERE NOT partial_period AND n > 0) FROM v_qresults WHERE group_name IN ('mf_up_fii_up', 'mf_up_only', 'mf_down') GROUP BY group_name
UNION ALL SELECT 'pooled', NULL, group_name, count(excess_mean) FILTER (WHERE NOT partial_period AND n > 0) FROM v_results GROUP BY group_name
UNION ALL SELECT 'track_record', report_month, group_name, n FROM v_results WHERE n > 0
UNION ALL SELECT 'track_record', report_month, reason, NULL FROM v_periods WHERE reason IS NOT NULL""")
def _(d):
    """All sections of the report as one long frame, each with its leading number."""
    frames = monthly_report(d)
    out = None
    for section, period, name, number in (
            ("coverage", "report_month", None, "compared"), ("buying", "report_month", "isin", "rank"), ("selling", "report_month", "isin", "sell_rank"),
            ("evidence", None, "group_name", "periods"), ("pooled", None, "group_name", "periods"), ("track_record", "report_month", ("group_name", "reason"), "n")):
        label = F.coalesce(*name) if isinstance(name, tuple) else F.col(name) if name else F.lit(None)
        part = frames[section].select(F.lit(section).alias("section"), (F.col(period) if period else F.lit(None)).cast("string").alias("period"),
                                      label.cast("string").alias("name"), F.col(number).cast("bigint").alias("number"))
        out = part if out is None else out.unionByName(part)
    return out


@query("monthly_report_lists", """
SELECT report_month, 'buying' AS section, rank AS position, isin, net_amc_count FROM v_ranked WHERE rank <= 15
UNION ALL SELECT report_month, 'selling', p, isin, net_amc_count FROM (SELECT *, row_number() OVER (PARTITION BY report_month
  ORDER BY net_amc_count, accumulation_flow_lakhs NULLS LAST, rank) AS p FROM v_ranked) WHERE p <= 15""")
def _(d):
    frames = report_lists(d)
    return (frames["buying"].select("report_month", F.lit("buying").alias("section"), F.col("rank").alias("position"), "isin", "net_amc_count")
            .unionAll(frames["selling"].select("report_month", F.lit("selling"), "sell_rank", "isin", "net_amc_count")))


# -- earlier rules ------------------------------------------------------------------------------------------

def old_status_of(d):
    """Statuses as the earlier gate stored them: only the NAV rule withholds."""
    nav = d.holdings.groupBy("scheme_id", "report_month").agg(F.sum("pct_nav").alias("nav"))
    return nav.select("scheme_id", "report_month", F.when(F.col("nav") > 110, "quarantined").otherwise("ok").alias("status"))


cte("v_old_status", "SELECT scheme_id, report_month, CASE WHEN sum(pct_nav) > 110 THEN 'quarantined' ELSE 'ok' END AS status FROM v_holdings GROUP BY ALL")
cte("v_old_raw", """
SELECT p.report_month, p.prev_month, p.scheme_id, p.isin, amc_name, in_prev, in_curr, quantity_prev AS rq0, quantity_curr AS rq1,
  coalesce(quantity_prev, 0) AS q0, coalesce(quantity_curr, 0) AS q1, market_value_lakhs_prev AS v0, market_value_lakhs_curr AS v1
FROM v_pairs p JOIN v_stock s USING (isin) JOIN v_scheme k ON k.scheme_id = p.scheme_id
JOIN v_old_status a ON a.scheme_id = p.scheme_id AND a.report_month = p.report_month AND a.status = 'ok'
JOIN v_old_status b ON b.scheme_id = p.scheme_id AND b.report_month = p.prev_month AND b.status = 'ok' WHERE instrument_type = 'equity' AND is_active_equity = 1""")
# One row for each security and month: the widest gap to each ratio as a column of its own, the first ratio that fits counts.
_FITS = [f"WHEN g{i} <= 0.02 AND round(abs(px * {k} - 1), 9) <= 0.15 THEN {k}" for i, k in enumerate(SPLIT_RATIOS)]
cte("v_old_split", f"""
SELECT report_month, isin, ratio FROM (SELECT report_month, isin, (CASE {' '.join(_FITS)} END)::DOUBLE AS ratio FROM (
  SELECT report_month, isin, (sum(v1) / sum(q1)) / (sum(v0) / sum(q0)) AS px, {', '.join(f"max(round(abs(q1 / q0 - {k}) / {k}, 9)) AS g{i}" for i, k in enumerate(SPLIT_RATIOS))}
  FROM v_old_raw WHERE q0 > 0 AND q1 > 0 AND v0 > 0 AND v1 > 0 GROUP BY report_month, isin)) WHERE ratio IS NOT NULL""")


@query("comparison_rows_earlier_rules", f"""
SELECT r.report_month, r.scheme_id, r.isin, {r('q0 * coalesce(a.ratio, s.ratio, 1)', 4)} AS quantity_prev, q1 AS quantity_curr, coalesce(a.ratio, s.ratio, 1) AS split_ratio,
  CASE WHEN a.ratio IS NOT NULL THEN 'confirmed' WHEN s.ratio IS NOT NULL THEN 'inferred' ELSE 'none' END AS adjustment_basis, {r('q1 - q0 * coalesce(a.ratio, s.ratio, 1)', 4)} AS qty_change,
  {r('''CASE WHEN a.ratio IS NOT NULL OR s.ratio IS NOT NULL THEN CASE WHEN q0 <= 0 AND q1 <= 0 THEN 0 WHEN q1 <= 0 THEN -v0 ELSE (q1 - q0 * coalesce(a.ratio, s.ratio)) * (v1 / q1) END
   WHEN NOT in_prev THEN v1 WHEN q0 <= 0 AND q1 <= 0 THEN 0 WHEN NOT in_curr OR q1 <= 0 THEN -v0 ELSE (q1 - q0) * (v1 / q1) END''', 4)} AS flow_lakhs
FROM v_old_raw r LEFT JOIN v_old_split s ON s.report_month = r.report_month AND s.isin = r.isin LEFT JOIN v_actions a ON a.effective_month = r.report_month AND a.isin = r.isin""")
def _(d):
    return C.rounded(L.comparison_rows(pairs_of(d), d.schemes, d.stocks, old_status_of(d), d.actions).select(
        "report_month", "scheme_id", "isin", "quantity_prev", "quantity_curr", "split_ratio", "adjustment_basis", "qty_change", "flow_lakhs"), 4)


@query("earlier_rules_guard", """
WITH f AS (SELECT report_month, rq0 IS NULL OR rq1 IS NULL OR (isin = 'INE005A01015' AND in_curr AND report_month LIKE '%-07') AS bad FROM v_old_raw
 UNION ALL SELECT report_month, quantity_prev IS NULL OR quantity_curr IS NULL OR qty_change IS NULL OR flow_lakhs IS NULL FROM v_deltas JOIN v_pairs USING (scheme_id, isin, report_month))
SELECT report_month, count(*) FILTER (WHERE bad) AS unavailable_inputs, CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 'refused' ELSE 'reproducible' END AS replay FROM f GROUP BY 1""")
def _(d):
    """Unknown values of an unrequested security do not refuse, those of a requested one do, as do unknown stored quantities, changes and flows of any month."""
    lost = (F.col("isin") == "INE003A01013") | ((F.col("isin") == "INE005A01015") & F.col("report_month").endswith("-07"))
    pairs = pairs_of(d).withColumn("market_value_lakhs_curr", F.when(~(lost & F.col("in_curr")), F.col("market_value_lakhs_curr")))
    keys = ["scheme_id", "isin", "report_month"]
    stored = d.deltas.select(*keys, "qty_change", "flow_lakhs").join(d.pairs.select(*keys, "quantity_prev", "quantity_curr"), keys)
    return L.guard(pairs, d.schemes, d.stocks, old_status_of(d), requested=d.stocks.filter(F.col("isin").isin("INE005A01015", "INE006A01016")), stored=stored)
