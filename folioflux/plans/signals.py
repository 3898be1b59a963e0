"""Named queries: discretionary trading, consensus, filing overlap, notable lists, house activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.operators import active as A
from folioflux.operators import consensus as S
from folioflux.operators import eligibility as E
from folioflux.operators import houses as H
from folioflux.plans.base import cte, index_of, query, r, strict
from folioflux.plans.comparison import RATIOS, comparison_of, eligible_of, pairs_of
from folioflux.sources.staging import cut

POS = ("quantity_prev > 0 AND quantity_curr > 0 AND market_value_lakhs_prev > 0 AND market_value_lakhs_curr > 0")


def scored_of(d):
    return A.scored_pairs(pairs_of(d), E.compared_voters(d.deltas, d.schemes, d.stocks, d.status, d.bad_quantity), d.stocks)


def changes_of(d):
    return d.derived("active_changes", lambda: A.active_weight_changes(scored_of(d), closes=d.prices_monthly, actions=d.actions, infer_splits=True))


def active_of(d):
    return d.derived("active_by_stock", lambda: A.aggregate_by_stock(changes_of(d), d.schemes))


def consensus_of(d):
    def make():
        eligible = eligible_of(d)
        # Months x securities rows, read twice: cut once.
        return S.rank_consensus(eligible, cut(S.previous_universe(eligible, d.holdings)), active_of(d))
    return d.derived("consensus", make)


def ranked_of(d):
    return d.derived("ranked", lambda: S.ranked_consensus(consensus_of(d), d.filings))


def activity_of(d):
    return H.fund_house_activity(comparison_of(d), H.loaded_schemes(d.holdings, d.schemes, d.stocks))


cte("v_scored", """
SELECT p.* FROM v_pairs p JOIN v_stock s USING (isin)
JOIN (SELECT DISTINCT scheme_id, report_month FROM v_eligible_any) e ON e.scheme_id = p.scheme_id AND e.report_month = p.report_month
WHERE s.instrument_type = 'equity'""")
cte("v_inferred_act", f"""
SELECT report_month, isin, k AS split_ratio FROM (
 SELECT report_month, isin, k, ord, bool_or(quantity_prev IS NULL OR quantity_curr IS NULL) AS veto,
  max(round(abs(quantity_curr / quantity_prev - k) / k, 9)) FILTER (WHERE {POS}) AS gap,
  (sum(market_value_lakhs_curr) FILTER (WHERE {POS}) / sum(quantity_curr) FILTER (WHERE {POS}))
   / (sum(market_value_lakhs_prev) FILTER (WHERE {POS}) / sum(quantity_prev) FILTER (WHERE {POS})) AS px
 FROM v_scored, (SELECT unnest({RATIOS}) AS k, generate_subscripts({RATIOS}, 1) AS ord) ks
 WHERE in_prev AND in_curr GROUP BY ALL)
WHERE NOT veto AND gap <= 0.02 AND round(abs(px * k - 1), 9) <= 0.15
QUALIFY row_number() OVER (PARTITION BY report_month, isin ORDER BY ord) = 1""")
cte("v_weights", """
WITH flagged AS (SELECT p.*,
   bool_or(in_prev) OVER w AND bool_or(in_curr) OVER w AND
     bool_or((in_prev AND (quantity_prev IS NULL)) OR (in_curr AND (quantity_curr IS NULL))) OVER w AS unsafe
  FROM v_scored p WINDOW w AS (PARTITION BY report_month, scheme_id)),
 safe AS (SELECT report_month, scheme_id, isin,
   CASE WHEN in_prev AND quantity_prev > 0 AND market_value_lakhs_prev > 0 THEN quantity_prev END AS q0,
   CASE WHEN in_prev AND quantity_prev > 0 AND market_value_lakhs_prev > 0 THEN market_value_lakhs_prev END AS v0,
   CASE WHEN in_curr AND quantity_curr > 0 AND market_value_lakhs_curr > 0 THEN quantity_curr END AS q1,
   CASE WHEN in_curr AND quantity_curr > 0 AND market_value_lakhs_curr > 0 THEN market_value_lakhs_curr END AS v1
  FROM flagged WHERE NOT unsafe),
 shared AS (SELECT report_month, scheme_id FROM safe GROUP BY ALL HAVING count(q0) > 0 AND count(q1) > 0),
 kept AS (SELECT s.* FROM safe s JOIN shared USING (report_month, scheme_id) WHERE q0 IS NOT NULL OR q1 IS NOT NULL),
 px AS (SELECT report_month, isin, sum(v1) / sum(q1) AS market_px FROM kept GROUP BY ALL),
 drifted AS (SELECT k.*, CASE WHEN q0 IS NULL THEN 'new_position' WHEN q1 IS NOT NULL THEN 'own'
    WHEN market_px IS NOT NULL THEN 'cross_scheme' WHEN close_price IS NOT NULL THEN 'exchange_close' ELSE 'assumed_flat' END AS price_basis,
   CASE WHEN q0 IS NULL THEN 0.0 ELSE q0 * coalesce(a.ratio, i.split_ratio, 1.0)
     * coalesce(v1 / q1, market_px, close_price / 100000.0, v0 / q0 / coalesce(a.ratio, i.split_ratio, 1.0)) END AS drift
  FROM kept k LEFT JOIN px ON px.report_month = k.report_month AND px.isin = k.isin
  LEFT JOIN v_inferred_act i ON i.report_month = k.report_month AND i.isin = k.isin
  LEFT JOIN v_actions a ON a.effective_month = k.report_month AND a.isin = k.isin
  LEFT JOIN v_prices_monthly m ON m.report_month = k.report_month AND m.isin = k.isin AND m.close_price > 0),
 totals AS (SELECT *, sum(drift) OVER w AS td, sum(v1) OVER w AS tc FROM drifted WINDOW w AS (PARTITION BY report_month, scheme_id))
SELECT report_month, scheme_id, isin, 100 * drift / td AS w_drift_pp, 100 * coalesce(v1, 0) / tc AS w_curr_pp,
  100 * (coalesce(v1, 0) / tc - drift / td) AS active_weight_change_pp,
  (coalesce(v1, 0) / tc - drift / td) * tc AS discretionary_flow_lakhs, price_basis FROM totals WHERE td > 0 AND tc > 0
UNION ALL SELECT report_month, scheme_id, isin, NULL, NULL, NULL, NULL, 'unavailable' FROM flagged WHERE unsafe""")
cte("v_active", f"""
WITH votes AS (SELECT w.report_month, isin, amc_name,
   sum(discretionary_flow_lakhs) FILTER (WHERE abs(round(active_weight_change_pp, 9)) >= 0.05) AS f
  FROM v_weights w JOIN v_scheme USING (scheme_id) GROUP BY ALL),
 counts AS (SELECT report_month, isin, count(*) FILTER (WHERE f > 0) AS b, count(*) FILTER (WHERE f < 0) AS s FROM votes GROUP BY ALL),
 sums AS (SELECT report_month, isin, {strict('discretionary_flow_lakhs')} AS flow, {strict('active_weight_change_pp')} AS change
  FROM v_weights GROUP BY ALL)
SELECT report_month, isin, CASE WHEN flow IS NOT NULL THEN b END AS active_amcs_buying,
  CASE WHEN flow IS NOT NULL THEN s END AS active_amcs_selling, CASE WHEN flow IS NOT NULL THEN b - s END AS net_active_amc_count,
  flow AS discretionary_flow_lakhs, change AS active_weight_change_pp_sum
FROM counts JOIN sums USING (report_month, isin)""")
cte("v_universe", """
SELECT DISTINCT e.report_month, h.isin FROM (SELECT DISTINCT report_month, prev_month FROM v_eligible) e
JOIN v_holdings h ON h.report_month = e.prev_month""")
cte("v_consensus", f"""
WITH c AS (SELECT report_month, isin, min(stock_name) AS stock_name, min(industry) AS industry, min(instrument_type) AS instrument_type,
   count(DISTINCT amc_name) FILTER (WHERE action IN ('new', 'added')) AS amcs_buying,
   count(DISTINCT amc_name) FILTER (WHERE action IN ('trimmed', 'exited')) AS amcs_selling,
   count(DISTINCT amc_name) FILTER (WHERE action = 'new') AS amcs_opening,
   count(DISTINCT amc_name) FILTER (WHERE action = 'exited') AS amcs_exiting,
   count(DISTINCT scheme_id) FILTER (WHERE action IN ('new', 'added')) AS schemes_buying,
   count(DISTINCT scheme_id) FILTER (WHERE action IN ('trimmed', 'exited')) AS schemes_selling,
   {strict('flow_lakhs')} AS total_flow_lakhs, {strict('price_effect_lakhs')} AS total_price_effect_lakhs,
   CASE WHEN count(*) FILTER (WHERE action = 'new') = 0 THEN 0.0 ELSE {strict('flow_lakhs', "action = 'new'")} END AS new_position_flow_lakhs,
   CASE WHEN count(*) FILTER (WHERE action <> 'new') = 0 THEN 0.0 ELSE {strict('flow_lakhs', "action <> 'new'")} END AS accumulation_flow_lakhs
  FROM v_eligible GROUP BY report_month, isin)
SELECT c.*, schemes_buying - schemes_selling AS net_scheme_count, amcs_buying - amcs_selling AS net_amc_count,
  amcs_buying / greatest(1, amcs_buying + amcs_selling) AS buying_ratio,
  CASE WHEN u.isin IS NULL THEN 'new_listing' ELSE 'established' END AS universe_status, u.isin IS NULL AS is_new_to_universe,
  CASE WHEN a.isin IS NULL THEN 0 ELSE a.active_amcs_buying END AS active_amcs_buying,
  CASE WHEN a.isin IS NULL THEN 0 ELSE a.active_amcs_selling END AS active_amcs_selling,
  CASE WHEN a.isin IS NULL THEN 0 ELSE a.net_active_amc_count END AS net_active_amc_count,
  a.discretionary_flow_lakhs, a.active_weight_change_pp_sum,
  row_number() OVER (PARTITION BY c.report_month ORDER BY amcs_buying - amcs_selling DESC, u.isin IS NULL,
    accumulation_flow_lakhs DESC NULLS LAST, c.isin) AS rank
FROM c LEFT JOIN v_universe u ON u.report_month = c.report_month AND u.isin = c.isin
LEFT JOIN v_active a ON a.report_month = c.report_month AND a.isin = c.isin""")
cte("v_quarterly", """
SELECT *, coalesce(published_at::DATE, quarter_end + 21) AS published,
  CASE WHEN published_at IS NULL THEN 'regulatory_deadline' ELSE 'observed' END AS basis
FROM v_filings WHERE coalesce(filing_type = 'quarterly', strftime(quarter_end, '%m-%d') IN ('03-31', '06-30', '09-30', '12-31'))""")
cte("v_asof", """
SELECT report_month, isin, max(quarter_end) FILTER (WHERE rn = 1) AS shareholding_quarter_end,
  max(quarter_end) FILTER (WHERE rn = 2) AS previous_shareholding_quarter_end,
  max(fii_pct) FILTER (WHERE rn = 1) AS fii_pct, max(fii_pct) FILTER (WHERE rn = 2) AS previous_fii_pct,
  max(dii_pct) FILTER (WHERE rn = 1) AS dii_pct, max(dii_pct) FILTER (WHERE rn = 2) AS previous_dii_pct,
  max(basis) FILTER (WHERE rn = 1) AS shareholding_published_basis
FROM (SELECT m.report_month, f.*, row_number() OVER (PARTITION BY m.report_month, f.isin ORDER BY f.quarter_end DESC) AS rn
  FROM (SELECT DISTINCT report_month FROM v_holdings) m JOIN v_quarterly f
   ON f.published <= last_day((m.report_month || '-01')::DATE) + 10) GROUP BY ALL""")
cte("v_joined", """
SELECT *, CASE WHEN fii_pct_change IS NULL THEN 'no_data' WHEN fii_pct_change > 0 THEN 'increased' ELSE 'decreased' END AS fii_direction,
  CASE WHEN dii_pct_change IS NULL THEN 'no_data' WHEN dii_pct_change > 0 THEN 'increased' ELSE 'decreased' END AS dii_direction,
  net_amc_count > 0 AND (coalesce(fii_pct_change > 0, false) OR coalesce(dii_pct_change > 0, false)) AS is_common,
  coalesce(staleness_days > 200, true) AS shareholding_stale
FROM (SELECT c.*, a.* EXCLUDE (report_month, isin), fii_pct - previous_fii_pct AS fii_pct_change, dii_pct - previous_dii_pct AS dii_pct_change,
   (last_day((c.report_month || '-01')::DATE) + 10 - shareholding_quarter_end)::INT AS staleness_days
  FROM v_consensus c LEFT JOIN v_asof a ON a.report_month = c.report_month AND a.isin = c.isin)""")
cte("v_ranked", """
SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY report_month ORDER BY rank) AS rank,
  CASE WHEN shareholding_quarter_end IS NULL THEN 'missing' WHEN previous_shareholding_quarter_end IS NULL THEN 'single_quarter'
    ELSE 'available' END AS shareholding_status
FROM v_joined WHERE schemes_buying + schemes_selling > 0""")


@query("active_weight_changes", f"""
SELECT report_month, scheme_id, isin, {r('w_drift_pp', 5)} AS w_drift_pp, {r('w_curr_pp', 5)} AS w_curr_pp,
  {r('active_weight_change_pp', 5)} AS active_weight_change_pp, {r('discretionary_flow_lakhs', 3)} AS discretionary_flow_lakhs, price_basis
FROM v_weights""")
def _(d):
    return C.rounded(changes_of(d), 5, discretionary_flow_lakhs=3)


@query("active_by_stock", f"""
SELECT report_month, isin, active_amcs_buying, active_amcs_selling, net_active_amc_count,
  {r('discretionary_flow_lakhs', 3)} AS discretionary_flow_lakhs, {r('active_weight_change_pp_sum', 5)} AS active_weight_change_pp_sum FROM v_active""")
def _(d):
    return C.rounded(active_of(d), 5, discretionary_flow_lakhs=3)


@query("previous_universe", "SELECT report_month, isin FROM v_universe")
def _(d):
    return S.previous_universe(eligible_of(d), d.holdings)


CONSENSUS_COLUMNS = ("report_month", "isin", "rank", "stock_name", "industry", "schemes_buying", "schemes_selling", "net_scheme_count",
                     "amcs_buying", "amcs_selling", "amcs_opening", "amcs_exiting", "net_amc_count", "universe_status",
                     "is_new_to_universe", "active_amcs_buying", "active_amcs_selling", "net_active_amc_count")
CONSENSUS_SUMS = ("total_flow_lakhs", "new_position_flow_lakhs", "accumulation_flow_lakhs", "total_price_effect_lakhs",
                  "buying_ratio", "discretionary_flow_lakhs")


@query("consensus", f"SELECT {', '.join(CONSENSUS_COLUMNS)}, {', '.join(f'{r(c, 3)} AS {c}' for c in CONSENSUS_SUMS)} FROM v_consensus")
def _(d):
    return C.rounded(consensus_of(d).select(*CONSENSUS_COLUMNS, *CONSENSUS_SUMS), 3)


PAIR_SQL = ("shareholding_quarter_end, previous_shareholding_quarter_end, shareholding_published_basis, "
            + ", ".join(f"{r(c, 6)} AS {c}" for c in ("fii_pct", "previous_fii_pct", "dii_pct", "previous_dii_pct")))
PAIR_COLUMNS = ("shareholding_quarter_end", "previous_shareholding_quarter_end", "shareholding_published_basis",
                "fii_pct", "previous_fii_pct", "dii_pct", "previous_dii_pct")


@query("latest_filing_pair", f"""
SELECT h.report_month, h.isin, {PAIR_SQL} FROM (SELECT DISTINCT report_month, isin FROM v_holdings) h
LEFT JOIN v_asof a ON a.report_month = h.report_month AND a.isin = h.isin""")
def _(d):
    rows = d.holdings.select("report_month", "isin").distinct()
    return C.rounded(S.latest_filing_pair(rows, d.filings, C.mf_deadline("report_month"))
                     .select("report_month", "isin", *PAIR_COLUMNS), 6)


SIGNAL_COLUMNS = ("report_month", "isin", "net_amc_count", "fii_direction", "dii_direction", "is_common", "staleness_days", "shareholding_stale")


@query("shareholding_signal", f"""
SELECT {', '.join(SIGNAL_COLUMNS)}, {r('fii_pct_change')} AS fii_pct_change, {r('dii_pct_change')} AS dii_pct_change,
  row_number() OVER (PARTITION BY report_month ORDER BY is_common DESC, net_amc_count DESC, rank) AS common_position FROM v_joined""")
def _(d):
    return C.rounded(S.with_filings(consensus_of(d), d.filings)
                     .select(*SIGNAL_COLUMNS, "fii_pct_change", "dii_pct_change", "common_position"), 6)


RANKED_COLUMNS = ("report_month", "rank", "isin", "stock_name", "net_amc_count", "net_active_amc_count", "universe_status",
                  "fii_direction", "dii_direction", "is_common", "shareholding_status", "shareholding_stale")


@query("ranked_consensus", f"SELECT {', '.join(RANKED_COLUMNS)}, {r('accumulation_flow_lakhs', 3)} AS accumulation_flow_lakhs FROM v_ranked")
def _(d):
    return C.rounded(ranked_of(d).select(*RANKED_COLUMNS, "accumulation_flow_lakhs"), 3)


@query("broadest_selling", """
SELECT report_month, isin, rank, net_amc_count, row_number() OVER (PARTITION BY report_month
  ORDER BY net_amc_count, accumulation_flow_lakhs NULLS LAST, rank) AS sell_rank FROM v_ranked""")
def _(d):
    return S.broadest_selling(ranked_of(d)).select("report_month", "isin", "rank", "net_amc_count", "sell_rank")


@query("ranking_top", "SELECT report_month, rank, isin, net_amc_count FROM v_ranked WHERE rank <= 15")
def _(d):
    return S.page(ranked_of(d), 1, S.TOP_ROWS).select("report_month", "rank", "isin", "net_amc_count")


@query("ranking_page_two", "SELECT report_month, rank, isin FROM v_ranked WHERE rank BETWEEN 11 AND 20")
def _(d):
    return S.page(ranked_of(d), 2, 10).select("report_month", "rank", "isin")


@query("overlap_view", "SELECT report_month, isin, net_amc_count, fii_direction, dii_direction FROM v_joined WHERE is_common")
def _(d):
    return (S.with_filings(consensus_of(d), d.filings).filter("is_common")
            .select("report_month", "isin", "net_amc_count", "fii_direction", "dii_direction"))


@query("overlap_summary", """
SELECT m.report_month, CASE WHEN count(j.isin) = 0 THEN 'no_consensus' ELSE 'ok' END AS status,
  count(*) FILTER (WHERE is_common) AS common_count, CASE WHEN count(j.isin) > 0 THEN count(j.isin) END AS consensus_count,
  CASE WHEN count(j.isin) > 0 THEN count(*) FILTER (WHERE shareholding_stale) END AS stale_count,
  CASE WHEN count(j.isin) > 0 THEN count(*) FILTER (WHERE shareholding_quarter_end IS NULL) END AS missing_shareholding_count
FROM (SELECT DISTINCT report_month FROM v_months) m LEFT JOIN v_joined j ON j.report_month = m.report_month GROUP BY m.report_month""")
def _(d):
    return S.overlap_status(d.scheme_months.select("report_month").distinct(), consensus_of(d), d.filings)


@query("filing_freshness", """
SELECT report_month, max(shareholding_quarter_end) AS latest_quarter, count(*) FILTER (WHERE shareholding_status = 'missing') AS missing,
  count(*) FILTER (WHERE shareholding_status = 'single_quarter') AS single_quarter,
  count(*) FILTER (WHERE shareholding_stale AND shareholding_status <> 'missing') AS stale,
  count(*) FILTER (WHERE shareholding_published_basis = 'regulatory_deadline') AS deadline_basis FROM v_ranked GROUP BY report_month""")
def _(d):
    return S.filing_freshness(ranked_of(d))


def _notable_sql(side: str) -> str:
    sign, position = (1, "rank") if side == "buy" else (-1, "sell_rank")
    fresh = "amcs_opening >= 2 AND universe_status <> 'new_listing'" if side == "buy" else "amcs_exiting >= 2"
    count, name = ("amcs_opening", "opened") if side == "buy" else ("amcs_exiting", "exited")
    return f"""
WITH cmp AS (SELECT DISTINCT {index_of('report_month')} AS i FROM v_deltas),
 t AS (SELECT v.*, {index_of('v.report_month')} AS i,
   row_number() OVER (PARTITION BY report_month ORDER BY net_amc_count, accumulation_flow_lakhs NULLS LAST, rank) AS sell_rank FROM v_ranked v),
 h AS (SELECT t.*, t.net_amc_count * {sign} AS net, coalesce(a.net_amc_count, 0) AS net_before,
   coalesce(a.net_amc_count, 0) * {sign} AS b1, coalesce(b.net_amc_count, 0) * {sign} AS b2,
   t.i - 1 IN (SELECT i FROM cmp) AS has1, t.i - 2 IN (SELECT i FROM cmp) AS has2
  FROM t LEFT JOIN t a ON a.isin = t.isin AND a.i = t.i - 1 LEFT JOIN t b ON b.isin = t.isin AND b.i = t.i - 2),
 l AS (SELECT *, 'turnaround' AS list, net - b1 AS strength, 0.0::DOUBLE AS tie FROM h WHERE has1 AND net >= 2 AND b1 <= -1
  UNION ALL SELECT *, '{name}', {count}, 0 FROM h WHERE {fresh}
  UNION ALL SELECT *, 'active', coalesce(net_active_amc_count, 0) * {sign}, 0 FROM h WHERE coalesce(net_active_amc_count, 0) * {sign} >= 2
  UNION ALL SELECT *, 'streak', least(net, b1, b2), 0 FROM h WHERE has1 AND has2 AND least(net, b1, b2) >= 1
  UNION ALL SELECT *, 'fii', net, fii_pct_change * {sign} FROM h WHERE net >= 2 AND fii_pct_change * {sign} > 0
    AND shareholding_status <> 'missing' AND NOT shareholding_stale)
SELECT report_month, '{side}' AS side, list, row_number() OVER (PARTITION BY report_month, list ORDER BY strength DESC, tie DESC, {position}) AS position,
  isin, stock_name, net_amc_count, net_before, strength::DOUBLE AS strength, instrument_type = 'equity' AS followable FROM l WHERE net > 0"""


@query("notable_buying", _notable_sql("buy"))
def _(d):
    return S.notable_lists(ranked_of(d), d.deltas, "buy")


@query("notable_selling", _notable_sql("sell"))
def _(d):
    return S.notable_lists(S.broadest_selling(ranked_of(d)), d.deltas, "sell", "sell_rank")


@query("notable_needs", f"""
WITH cmp AS (SELECT DISTINCT {index_of('report_month')} AS i FROM v_deltas), m AS (SELECT DISTINCT report_month FROM v_ranked)
SELECT report_month, 'turnaround' AS list, strftime((report_month || '-01')::DATE - INTERVAL 1 MONTH, '%Y-%m') AS needs FROM m
WHERE {index_of('report_month')} - 1 NOT IN (SELECT i FROM cmp)
UNION ALL SELECT report_month, 'streak', CASE WHEN {index_of('report_month')} - 1 NOT IN (SELECT i FROM cmp)
  THEN strftime((report_month || '-01')::DATE - INTERVAL 1 MONTH, '%Y-%m') ELSE strftime((report_month || '-01')::DATE - INTERVAL 2 MONTH, '%Y-%m') END
FROM m WHERE {index_of('report_month')} - 1 NOT IN (SELECT i FROM cmp) OR {index_of('report_month')} - 2 NOT IN (SELECT i FROM cmp)""")
def _(d):
    return S.notable_needs(ranked_of(d), d.deltas)


cte("v_house_stock", f"""
SELECT report_month, amc_name, isin, sum(qp) AS q0, sum(qty_change) AS net, {strict('flow_lakhs')} AS flow FROM v_cmp GROUP BY ALL""")
cte("v_activity", """
WITH loaded AS (SELECT report_month, amc_name, count(DISTINCT h.scheme_id) AS loaded FROM v_months h JOIN v_scheme s ON s.scheme_id = h.scheme_id
  WHERE is_active_equity = 1 AND EXISTS (SELECT 1 FROM v_holdings e JOIN v_stock k USING (isin) WHERE e.scheme_id = h.scheme_id
    AND k.instrument_type = 'equity' AND e.report_month IN (h.report_month, strftime((h.report_month || '-01')::DATE - INTERVAL 1 MONTH, '%Y-%m'))) GROUP BY ALL),
 cmp AS (SELECT report_month, amc_name, count(DISTINCT scheme_id) AS compared FROM v_cmp GROUP BY ALL),
 net AS (SELECT report_month, amc_name, count(*) FILTER (WHERE net > 1e-6) AS increased, count(*) FILTER (WHERE net < -1e-6) AS reduced,
   count(*) FILTER (WHERE abs(net) > 1e-6 AND flow IS NULL) AS unpriced FROM v_house_stock GROUP BY ALL),
 big AS (SELECT * FROM v_house_stock WHERE abs(net) > 1e-6 AND flow IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY report_month, amc_name ORDER BY abs(flow) DESC, isin) = 1)
SELECT report_month, amc_name, coalesce(loaded, 0) AS loaded, coalesce(compared, 0) AS compared, coalesce(increased, 0) AS increased,
  coalesce(reduced, 0) AS reduced, coalesce(unpriced, 0) AS unpriced, big.isin AS biggest_isin, big.net AS biggest_qty_change,
  big.flow AS biggest_flow_lakhs, CASE WHEN q0 > 0 THEN 100 * big.net / q0 END AS biggest_change_pct
FROM loaded FULL JOIN cmp USING (report_month, amc_name) LEFT JOIN net USING (report_month, amc_name) LEFT JOIN big USING (report_month, amc_name)""")


@query("fund_house_activity", f"""
SELECT report_month, amc_name, loaded, compared, increased, reduced, unpriced, biggest_isin, {r('biggest_qty_change', 5)} AS biggest_qty_change,
  {r('biggest_flow_lakhs', 3)} AS biggest_flow_lakhs, {r('biggest_change_pct', 5)} AS biggest_change_pct FROM v_activity""")
def _(d):
    return C.rounded(activity_of(d), 5, biggest_flow_lakhs=3)
