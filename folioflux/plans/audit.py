"""Named queries: coverage, provenance, evidence, history, watchlist, lookups and releases."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.operators import coverage as G
from folioflux.operators import eligibility as E
from folioflux.operators import evidence as P
from folioflux.operators import houses as H
from folioflux.operators import releases as R
from folioflux.plans.base import cte, query, r, strict
from folioflux.plans.comparison import bad_of, comparison_of, eligible_of
from folioflux.plans.signals import activity_of
from folioflux.sources.staging import cut, required_folder
from folioflux.sources.tables import write_months

HISTORY = ("1998-01", "1998-06")


def window_of(d):
    return G.scheme_window(d.scheme_months, d.status, bad_of(d))


def backed_of(d):
    return G.source_backed(d.holdings, d.stocks, d.status, d.snapshot_sources, d.disclosure_sources, d.evidence)


def prev(month):
    return f"strftime(({month} || '-01')::DATE - INTERVAL 1 MONTH, '%Y-%m')"


cte("v_window", f"""
WITH m AS (SELECT DISTINCT scheme_id, report_month FROM v_holdings),
 k AS (SELECT scheme_id, report_month FROM m UNION SELECT scheme_id, strftime((report_month || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m') FROM m)
SELECT k.scheme_id, k.report_month, a.scheme_id IS NOT NULL AS held_now, b.scheme_id IS NOT NULL AS held_prev, sa.status AS status_now,
  sb.status AS status_prev, ba.scheme_id IS NOT NULL AS bad_now, bb.scheme_id IS NOT NULL AS bad_prev
FROM k LEFT JOIN m a ON a.scheme_id = k.scheme_id AND a.report_month = k.report_month
LEFT JOIN m b ON b.scheme_id = k.scheme_id AND b.report_month = {prev('k.report_month')}
LEFT JOIN v_status sa ON sa.scheme_id = k.scheme_id AND sa.report_month = k.report_month
LEFT JOIN v_status sb ON sb.scheme_id = k.scheme_id AND sb.report_month = {prev('k.report_month')}
LEFT JOIN v_bad ba ON ba.scheme_id = k.scheme_id AND ba.report_month = k.report_month
LEFT JOIN v_bad bb ON bb.scheme_id = k.scheme_id AND bb.report_month = {prev('k.report_month')}""")
cte("v_winflags", """
SELECT *, coalesce(status_now = 'quarantined', false) OR bad_now AS wh_now, coalesce(status_prev = 'quarantined', false) OR bad_prev AS wh_prev,
  coalesce(status_now = 'ok', false) AND NOT bad_now AS pass_now FROM v_window""")
cte("v_disclosures", """
SELECT DISTINCT sha256(amc_name || '|' || report_month) AS sha256, amc_name || '-' || report_month || '.xlsx' AS workbook_name,
  (CASE WHEN house_no % 3 = 0 THEN 'file:///' ELSE 'https://example.com/' END) || lower(amc_name) AS source_url, report_month || '-28' AS retrieved_at,
  CASE WHEN house_no % 4 <> 0 THEN strftime(last_day((report_month || '-01')::DATE) + 8, '%Y-%m-%d') END AS published_at
FROM v_months JOIN v_scheme USING (scheme_id)""")
cte("v_snapkeys", """
SELECT scheme_id, report_month, substr(report_month, 1, 4)::INT * 12 + substr(report_month, 6, 2)::INT - 1 AS midx,
  sha256(amc_name || '|' || report_month) AS sha, sha256(amc_name || '|' || report_month || '|v1') AS old_sha
FROM v_months JOIN v_scheme USING (scheme_id)""")
cte("v_snapsources", "SELECT scheme_id, report_month, sha AS source_sha256 FROM v_snapkeys WHERE (scheme_id + midx) % 19 <> 0")
cte("v_evidence", """
SELECT scheme_id, report_month, isin, sha AS source_sha256 FROM v_holdings JOIN v_snapkeys USING (scheme_id, report_month) WHERE (scheme_id + midx) % 5 <> 0
UNION ALL SELECT scheme_id, report_month, isin, old_sha FROM v_holdings JOIN v_snapkeys USING (scheme_id, report_month)
WHERE (scheme_id + midx) % 5 <> 0 AND midx % 11 = 0""")


@query("month_coverage", f"""
WITH d AS (SELECT scheme_id, report_month, max(prev_month) AS pm FROM v_deltas GROUP BY ALL),
 pm AS (SELECT report_month, max(pm) AS prev_month FROM d GROUP BY 1),
 f AS (SELECT w.*, s.amc_name, is_active_equity = 1 AS act, held_now AND is_active_equity = 1 AS sc, d.pm IS NOT NULL AS wd, pm.prev_month AS month_prev,
   EXISTS (SELECT 1 FROM v_eligible e WHERE e.scheme_id = w.scheme_id AND e.report_month = w.report_month) AS cmp
  FROM v_winflags w JOIN v_scheme s ON s.scheme_id = w.scheme_id LEFT JOIN d ON d.scheme_id = w.scheme_id AND d.report_month = w.report_month
  LEFT JOIN pm ON pm.report_month = w.report_month)
SELECT report_month, count(*) FILTER (WHERE sc) AS in_scope, count(*) FILTER (WHERE held_now) AS loaded, count(*) FILTER (WHERE cmp) AS compared,
  count(DISTINCT amc_name) FILTER (WHERE cmp) AS compared_amcs, count(*) FILTER (WHERE sc AND wh_now) AS withheld,
  count(*) FILTER (WHERE sc AND NOT wd AND NOT wh_now) AS no_previous, count(*) FILTER (WHERE sc AND wd AND wh_prev AND NOT wh_now) AS prev_withheld,
  count(*) FILTER (WHERE sc AND NOT cmp AND NOT wh_now AND wd AND NOT wh_prev) AS no_equity,
  count(*) FILTER (WHERE act AND held_prev AND NOT held_now AND month_prev IS NOT NULL) AS dropped_out,
  count(*) FILTER (WHERE sc AND pass_now) AS passed, count(*) FILTER (WHERE sc AND status_now IS NULL) AS not_validated,
  max(month_prev) AS prev_month, last_day((report_month || '-01')::DATE) + 10 AS public_on,
  CASE WHEN count(*) FILTER (WHERE cmp) > 0 THEN 'unknown_completeness' ELSE 'unavailable' END AS coverage_state,
  (SELECT max(retrieved_at) FROM v_disclosures) AS last_ingest
FROM f GROUP BY report_month HAVING count(*) FILTER (WHERE held_now) > 0""")
def _(d):
    return G.month_coverage(window_of(d), d.schemes, d.deltas, E.voting_schemes(eligible_of(d)),
                            d.disclosure_sources.select(F.col("retrieved_at").alias("started_at")))


cte("v_invflags", f"""
WITH k AS (SELECT amc_name, report_month FROM v_inventory UNION SELECT amc_name, strftime((report_month || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m') FROM v_inventory)
SELECT k.amc_name, k.report_month, coalesce(a.exhaustive = 1, false) AS now_full, coalesce(a.exhaustive = 1, false) AND coalesce(b.exhaustive = 1, false) AS known, a.source_url
FROM k LEFT JOIN v_inventory a ON a.amc_name = k.amc_name AND a.report_month = k.report_month
LEFT JOIN v_inventory b ON b.amc_name = k.amc_name AND b.report_month = {prev('k.report_month')}""")
cte("v_funds", f"""
WITH e AS (SELECT *, coalesce('s' || scheme_id, 'k' || official_key) AS key, equity_eligible = 1 AND active_eligible = 1 AS elig FROM v_expected),
 cur AS (SELECT * FROM e WHERE elig),
 pri AS (SELECT amc_name, strftime((report_month || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m') AS report_month, official_key, official_name, scheme_id, key, elig, exclusion_reason FROM e),
 f AS (SELECT amc_name, report_month, official_key, official_name, scheme_id, key, exclusion_reason, true AS is_current FROM cur
  UNION ALL SELECT p.amc_name, p.report_month, p.official_key, p.official_name, p.scheme_id, p.key, p.exclusion_reason, false FROM pri p
   WHERE p.elig AND NOT EXISTS (SELECT 1 FROM cur c WHERE c.amc_name = p.amc_name AND c.report_month = p.report_month AND c.key = p.key))
SELECT f.amc_name, f.report_month, f.official_key, f.official_name, f.scheme_id, f.is_current,
  CASE WHEN f.scheme_id IS NULL THEN 'identity_unresolved'
   WHEN NOT coalesce(w.held_now AND s.is_active_equity = 1 AND s.amc_name = f.amc_name, false) THEN 'missing_current'
   WHEN NOT w.held_prev AND i.known AND NOT EXISTS (SELECT 1 FROM pri p WHERE p.amc_name = f.amc_name AND p.report_month = f.report_month AND p.scheme_id = f.scheme_id) THEN 'not_in_previous_official_inventory'
   WHEN NOT w.held_prev THEN 'missing_previous' WHEN wh_now OR wh_prev THEN 'withheld'
   WHEN coalesce(status_now, '') <> 'ok' OR coalesce(status_prev, '') <> 'ok' THEN 'not_validated'
   WHEN NOT EXISTS (SELECT 1 FROM v_cmp c WHERE c.scheme_id = f.scheme_id AND c.report_month = f.report_month) THEN 'no_usable_comparison' ELSE 'compared' END AS state
FROM f JOIN v_invflags i ON i.amc_name = f.amc_name AND i.report_month = f.report_month
LEFT JOIN v_winflags w ON w.scheme_id = f.scheme_id AND w.report_month = f.report_month LEFT JOIN v_scheme s ON s.scheme_id = f.scheme_id""")


@query("expected_fund_states", "SELECT amc_name, report_month, official_key, scheme_id, is_current, state FROM v_funds")
def _(d):
    return (G.expected_fund_states(window_of(d), d.schemes, d.inventories, d.expected_funds, comparison_of(d))
            .select("amc_name", "report_month", "official_key", "scheme_id", "is_current", "state"))


@query("house_coverage", """
WITH cmp AS (SELECT DISTINCT amc_name, report_month, scheme_id FROM v_cmp),
 c AS (SELECT amc_name, report_month, count(*) AS compared, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v_funds f
    WHERE f.amc_name = cmp.amc_name AND f.report_month = cmp.report_month AND f.scheme_id = cmp.scheme_id)) AS extra FROM cmp GROUP BY ALL),
 p AS (SELECT amc_name, report_month, count(*) AS n, count(*) FILTER (WHERE is_current) AS nc, bool_and(state = 'compared') AS allc FROM v_funds GROUP BY ALL),
 l AS (SELECT amc_name, report_month, count(*) AS loaded, count(*) FILTER (WHERE pass_now) AS validated_count, count(*) FILTER (WHERE NOT held_prev) AS missing_previous,
   count(*) FILTER (WHERE wh_now OR wh_prev) AS withheld_count, count(*) FILTER (WHERE NOT pass_now) AS not_validated_count
  FROM v_winflags JOIN v_scheme USING (scheme_id) WHERE held_now AND is_active_equity = 1 GROUP BY ALL),
 o AS (SELECT amc_name, report_month, count(*) AS out_of_scope FROM v_expected WHERE NOT (equity_eligible = 1 AND active_eligible = 1) GROUP BY ALL),
 spine AS (SELECT amc_name, report_month FROM (SELECT DISTINCT amc_name FROM v_scheme), (SELECT DISTINCT report_month FROM v_months))
SELECT amc_name, report_month, CASE WHEN coalesce(compared, 0) = 0 THEN 'unavailable' WHEN NOT coalesce(known, false) THEN 'unknown_completeness'
   WHEN coalesce(allc, false) AND coalesce(extra, 0) = 0 THEN 'complete' ELSE 'partial' END AS coverage_state, coalesce(known, false) AS inventory_known,
  CASE WHEN known THEN coalesce(n, 0) END AS expected, CASE WHEN now_full THEN coalesce(nc, 0) END AS expected_current, coalesce(loaded, 0) AS loaded,
  coalesce(validated_count, 0) AS validated_count, coalesce(compared, 0) AS compared, CASE WHEN known THEN coalesce(extra, 0) ELSE 0 END AS outside_inventory,
  coalesce(out_of_scope, 0) AS out_of_scope, coalesce(missing_previous, 0) AS missing_previous, coalesce(withheld_count, 0) AS withheld_count,
  coalesce(not_validated_count, 0) AS not_validated_count, source_url AS inventory_source
FROM spine LEFT JOIN v_invflags USING (amc_name, report_month) LEFT JOIN p USING (amc_name, report_month) LEFT JOIN l USING (amc_name, report_month)
LEFT JOIN c USING (amc_name, report_month) LEFT JOIN o USING (amc_name, report_month)""")
def _(d):
    return G.house_coverage(window_of(d), d.schemes, d.inventories, d.expected_funds, comparison_of(d))


@query("coverage_audit_funds", """
SELECT amc_name, report_month, scheme_id, is_active_equity = 1 AS active, coalesce(st.status, 'not_validated') AS validation,
  EXISTS (SELECT 1 FROM v_cmp c WHERE c.scheme_id = m.scheme_id AND c.report_month = m.report_month) AS compared
FROM v_months m JOIN v_scheme USING (scheme_id) LEFT JOIN v_status st USING (scheme_id, report_month)""")
def _(d):
    return (G.loaded_fund_list(d.scheme_months, d.schemes, d.status, comparison_of(d))
            .select("amc_name", "report_month", "scheme_id", "active", "validation", "compared"))


@query("data_inventory", """
SELECT report_month, count(DISTINCT scheme_id) AS schemes, count(*) AS holdings, report_month IN (SELECT report_month FROM v_deltas) AS has_deltas
FROM v_holdings GROUP BY report_month""")
def _(d):
    return G.data_inventory(d.holdings, d.deltas)


def _periods(part, source, column):
    return f"SELECT '{part}' AS part, p::VARCHAR AS period, NULL::BIGINT AS scheme_id, p = max(p) OVER () AS latest FROM (SELECT DISTINCT {column} AS p FROM {source})"


@query("data_inventory_lists", f"""
{_periods("month", "v_holdings", "report_month")} UNION ALL {_periods("delta_month", "v_deltas", "report_month")} UNION ALL {_periods("quarter", "v_filings", "quarter_end")}
UNION ALL SELECT 'quarantined', report_month, scheme_id, false FROM v_status WHERE status = 'quarantined'""")
def _(d):
    return G.inventory_lists(d.holdings, d.deltas, d.filings, E.quarantined(d.status))


@query("snapshot_evidence", """
WITH req AS (SELECT scheme_id, report_month, isin FROM v_deltas),
 e AS (SELECT e.scheme_id, e.report_month, e.isin, count(*) AS n FROM v_evidence e JOIN v_snapsources s USING (scheme_id, report_month, source_sha256) GROUP BY ALL)
SELECT q.scheme_id, q.report_month, q.isin, coalesce(st.status, 'not_validated') AS validation, count(d.sha256) AS n_sources, coalesce(max(e.n), 0) AS n_rows,
  max(CASE WHEN d.source_url LIKE 'http%' THEN d.source_url END) AS url, CASE WHEN count(d.sha256) = 0 THEN 'unavailable' WHEN max(e.n) > 0 THEN 'available'
  WHEN count(h.isin) > 0 THEN 'incomplete' ELSE 'absent_from_loaded_snapshot' END AS provenance_status
FROM req q LEFT JOIN v_status st USING (scheme_id, report_month) LEFT JOIN v_snapsources s USING (scheme_id, report_month)
LEFT JOIN v_disclosures d ON d.sha256 = s.source_sha256 LEFT JOIN e ON e.scheme_id = q.scheme_id AND e.report_month = q.report_month AND e.isin = q.isin
LEFT JOIN v_holdings h ON h.scheme_id = q.scheme_id AND h.report_month = q.report_month AND h.isin = q.isin GROUP BY ALL""")
def _(d):
    asked = d.deltas.select("scheme_id", "report_month", "isin")
    out = P.snapshot_evidence(asked, d.holdings, d.status, d.snapshot_sources, d.disclosure_sources, d.evidence)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("bigint")
    return out.select("scheme_id", "report_month", "isin", "validation", size("sources").alias("n_sources"), size("rows").alias("n_rows"),
                      F.get("sources", F.lit(0))["url"].alias("url"), "provenance_status")


EVIDENCE_SQL = f"""count(*) AS funds, sum(raw_quantity_prev) AS raw_previous_shares, {r('sum(qp)', 3)} AS adjusted_previous_shares, sum(qc) AS current_shares,
  {r('sum(qty_change)', 3)} AS net_share_change, {r('sum(greatest(qty_change, 0))', 3)} AS gross_added_shares,
  {r('sum(greatest(-qty_change, 0))', 3)} AS gross_reduced_shares,
  {r(strict('flow_lakhs'), 3)} AS net_flow_lakhs"""


@query("stock_evidence", f"SELECT report_month, isin, {EVIDENCE_SQL} FROM v_cmp GROUP BY report_month, isin")
def _(d):
    return C.rounded(P.stock_evidence(comparison_of(d)), 3)


@query("stock_evidence_by_house", f"SELECT report_month, isin, amc_name, {EVIDENCE_SQL} FROM v_cmp GROUP BY report_month, isin, amc_name")
def _(d):
    return C.rounded(P.stock_evidence(comparison_of(d), by_house=True), 3)


cte("v_dirs", """
SELECT report_month, isin, count(*) FILTER (WHERE n > 1e-6) AS houses_buying, count(*) FILTER (WHERE n < -1e-6) AS houses_selling
FROM (SELECT report_month, isin, amc_name, sum(qty_change) AS n FROM v_cmp GROUP BY ALL) GROUP BY ALL""")


@query("watchlist_report", f"""
WITH req AS (SELECT report_month, isin FROM (SELECT DISTINCT report_month FROM v_months), (SELECT isin FROM v_stock UNION ALL SELECT 'INE999X01019')),
 e AS (SELECT report_month, isin, {EVIDENCE_SQL}, count(*) FILTER (WHERE qp = 0 AND qc > 0) AS additions, count(*) FILTER (WHERE qp > 0 AND qc = 0) AS exits
  FROM v_cmp GROUP BY report_month, isin)
SELECT q.report_month, q.isin, coalesce(s.name, q.isin) AS name, CASE WHEN s.isin IS NULL THEN 'unknown_stock' WHEN funds IS NULL THEN 'unavailable'
   WHEN abs(net_share_change) <= 1e-6 AND gross_added_shares + gross_reduced_shares > 1e-6 THEN 'net_unchanged_with_opposing_changes'
   WHEN abs(net_share_change) <= 1e-6 THEN 'unchanged_in_compared_funds' ELSE 'changed' END AS status,
  houses_buying, houses_selling, net_share_change, net_flow_lakhs, additions, exits, CASE WHEN funds IS NOT NULL THEN least(funds, 3) END AS n_largest
FROM req q LEFT JOIN v_stock s USING (isin) LEFT JOIN e USING (report_month, isin) LEFT JOIN v_dirs USING (report_month, isin)""")
def _(d):
    months = d.scheme_months.agg(F.collect_set("report_month")).scalar()
    asked = (d.stocks.select("isin").unionAll(d.stocks.select(F.lit("INE999X01019")).distinct())
             .select("isin", F.explode(months).alias("report_month")))
    out = P.watchlist_report(asked, comparison_of(d), d.stocks)
    largest = F.when(F.col("largest_compared_changes").isNotNull(), F.size("largest_compared_changes")).cast("bigint")
    return C.rounded(out.withColumn("n_largest", largest).drop("largest_compared_changes"), 3)


@query("watchlist_largest_changes", f"""
SELECT report_month, isin, row_number() OVER (PARTITION BY report_month, isin ORDER BY abs(qty_change) DESC, scheme_id) AS position, scheme_id, {r('qty_change', 3)} AS qty_change,
  {r('flow_lakhs', 3)} AS flow_lakhs FROM v_cmp QUALIFY position <= 3""")
def _(d):
    return C.rounded(P.largest_changes(comparison_of(d)), 3)


@query("stock_history", f"""
WITH months AS (SELECT strftime(m, '%Y-%m') AS report_month FROM generate_series('{HISTORY[0]}-01'::TIMESTAMP, '{HISTORY[1]}-01'::TIMESTAMP, INTERVAL 1 MONTH) t(m)),
 later AS (SELECT * FROM months WHERE report_month > '{HISTORY[0]}'),
 cohort AS (SELECT scheme_id FROM v_cmp WHERE report_month IN (SELECT * FROM later) GROUP BY 1 HAVING count(DISTINCT report_month) = (SELECT count(*) FROM later)),
 sh AS (SELECT report_month, isin, sum(quantity) AS s FROM v_holdings WHERE scheme_id IN (SELECT * FROM cohort) GROUP BY ALL),
 inside AS (SELECT * FROM v_cmp WHERE scheme_id IN (SELECT * FROM cohort) AND report_month IN (SELECT * FROM later)),
 mv AS (SELECT report_month, isin, sum(qty_change) AS net, {strict('flow_lakhs')} AS flow, count(DISTINCT adjustment_basis) FILTER (WHERE adjustment_basis <> 'none') AS na FROM inside GROUP BY ALL),
 dir AS (SELECT report_month, isin, count(*) FILTER (WHERE n > 1e-6) AS hb, count(*) FILTER (WHERE n < -1e-6) AS hs
   FROM (SELECT report_month, isin, amc_name, sum(qty_change) AS n FROM inside GROUP BY ALL) GROUP BY ALL),
 rev AS (SELECT DISTINCT report_month, isin FROM v_evidence e WHERE scheme_id IN (SELECT * FROM cohort) AND NOT EXISTS (SELECT 1 FROM v_snapsources s
   WHERE s.scheme_id = e.scheme_id AND s.report_month = e.report_month AND s.source_sha256 = e.source_sha256)),
 t AS (SELECT m.report_month, k.isin, k.instrument_type = 'equity' AND (SELECT count(*) FROM cohort) > 0 AS u, coalesce(s, 0) AS s, net, flow, mv.isin AS any_isin, hb, hs, na, rev.isin AS r
  FROM months m, v_stock k LEFT JOIN sh ON sh.report_month = m.report_month AND sh.isin = k.isin LEFT JOIN mv ON mv.report_month = m.report_month AND mv.isin = k.isin
  LEFT JOIN dir ON dir.report_month = m.report_month AND dir.isin = k.isin LEFT JOIN rev ON rev.report_month = m.report_month AND rev.isin = k.isin)
SELECT report_month, isin, CASE WHEN u THEN 'validated_fixed_cohort' ELSE 'unavailable' END AS status, CASE WHEN u THEN s END AS shares,
  CASE WHEN u THEN (SELECT count(*) FROM cohort) ELSE 0 END AS funds, CASE WHEN u AND report_month > '{HISTORY[0]}' THEN {r('coalesce(net, 0)', 3)} END AS net_share_change,
  CASE WHEN u AND report_month > '{HISTORY[0]}' THEN {r("CASE WHEN any_isin IS NULL THEN 0 ELSE flow END", 3)} END AS net_flow_lakhs,
  CASE WHEN u AND report_month > '{HISTORY[0]}' THEN coalesce(hb, 0) END AS houses_buying, CASE WHEN u AND report_month > '{HISTORY[0]}' THEN coalesce(hs, 0) END AS houses_selling,
  CASE WHEN u THEN coalesce(na, 0) ELSE 0 END AS n_adjustments, u AND r IS NOT NULL AS source_revision,
  {r("CASE WHEN u AND max(CASE WHEN u THEN s END) OVER (PARTITION BY isin) > 0 THEN 100 * s / max(CASE WHEN u THEN s END) OVER (PARTITION BY isin) ELSE 0 END", 3)} AS bar_percent FROM t""")
def _(d):
    out = P.stock_history(comparison_of(d), d.holdings, d.stocks, *HISTORY, d.evidence, d.snapshot_sources)
    return C.rounded(out.withColumn("n_adjustments", F.size("adjustments").cast("bigint")).drop("adjustments"), 3)


cte("v_cohort", f"""
SELECT scheme_id FROM v_cmp WHERE report_month > '{HISTORY[0]}' AND report_month <= '{HISTORY[1]}' GROUP BY 1
HAVING count(DISTINCT report_month) = {len(C.month_list(*HISTORY)) - 1}""")
EVIDENCE_NUMBERS = ("funds", "raw_previous_shares", "adjusted_previous_shares", "current_shares", "net_share_change", "gross_added_shares",
                    "gross_reduced_shares", "net_flow_lakhs")


@query("history_evidence", f"""
WITH e AS (SELECT isin, {EVIDENCE_SQL} FROM v_cmp WHERE report_month = '{HISTORY[1]}' AND scheme_id IN (SELECT scheme_id FROM v_cohort) GROUP BY isin)
SELECT '{HISTORY[1]}' AS report_month, isin, {', '.join(f'CASE WHEN funds IS NULL THEN 0 ELSE {c} END AS {c}' for c in EVIDENCE_NUMBERS)}
FROM v_stock LEFT JOIN e USING (isin) WHERE instrument_type = 'equity'""")
def _(d):
    return C.rounded(P.history_evidence(comparison_of(d), d.holdings, d.stocks, *HISTORY, HISTORY[1]), 3)


@query("history_scope_token", f"""
SELECT count(*) AS cohort_count, sha256('{{"release":"latest","start":"{HISTORY[0]}","end":"{HISTORY[1]}","active":true,"cohort_count":' || count(*)
  || coalesce(',"digest":"' || sum(('0x' || substr(md5(scheme_id::VARCHAR), 1, 15))::BIGINT)::VARCHAR || '"', '') || '}}') AS token FROM v_cohort""")
def _(d):
    return P.cohort_token(P.history_cohort(comparison_of(d), C.month_list(*HISTORY)), "latest", *HISTORY)


@query("stock_detail", f"""
SELECT h.scheme_id, h.report_month, h.isin, h.quantity, coalesce(status_now, 'not_validated') AS validation_status, comparison_status,
  CASE WHEN comparison_status = 'available' THEN action END AS action, CASE WHEN comparison_status = 'available' THEN qty_change END AS qty_change,
  CASE WHEN comparison_status = 'available' THEN {r('flow_lakhs', 3)} END AS flow_lakhs
FROM (SELECT h.*, w.status_now, d.action, d.qty_change, d.flow_lakhs, CASE WHEN status_now = 'quarantined' OR (d.prev_month IS NOT NULL AND status_prev = 'quarantined') THEN 'withheld'
   WHEN bad_now OR (d.prev_month IS NOT NULL AND bad_prev) THEN 'withheld' WHEN d.prev_month IS NULL OR NOT held_prev THEN 'unavailable'
   WHEN coalesce(status_now, '') <> 'ok' OR coalesce(status_prev, '') <> 'ok' THEN 'not_validated' WHEN d.action IS NULL THEN 'unavailable' ELSE 'available' END AS comparison_status
  FROM v_holdings h LEFT JOIN v_deltas d USING (scheme_id, isin, report_month) LEFT JOIN v_window w USING (scheme_id, report_month)) h""")
def _(d):
    return C.rounded(P.stock_detail(d.holdings, d.deltas, window_of(d), d.schemes).select(
        "scheme_id", "report_month", "isin", "quantity", "validation_status", "comparison_status", "action", "qty_change", "flow_lakhs"), 3)


@query("filings_of_stock", f"""
SELECT isin, quarter_end, {r('promoter_pct')} AS promoter_pct, {r('fii_pct')} AS fii_pct, {r('dii_pct')} AS dii_pct, {r('public_pct')} AS public_pct,
  published AS published_on, basis AS published_basis, row_number() OVER (PARTITION BY isin ORDER BY quarter_end DESC) AS position FROM v_quarterly""")
def _(d):
    return C.rounded(P.filings_of_stock(d.filings), 6)


def _find_sql(text, month=""):
    return f"""
SELECT isin, trim(regexp_replace(name, '^EQ *- *', '')) AS name, industry, coalesce(n, 0) AS schemes_holding FROM v_stock
LEFT JOIN (SELECT isin, count(DISTINCT scheme_id) AS n FROM v_holdings {month} GROUP BY 1) USING (isin) WHERE name ILIKE '%{text}%' OR isin ILIKE '{text}%'
ORDER BY trim(regexp_replace(name, '^EQ *- *', '')) ILIKE '{text}%' DESC, instrument_type = 'equity' DESC, schemes_holding DESC, v_stock.name, isin LIMIT 12"""


def search_of(d):
    return d.derived("name_postings", lambda: P.name_postings(d.stocks)), d.derived("holder_counts", lambda: P.holder_counts(d.holdings))


@query("find_stocks_by_name", _find_sql("brand#1"))
def _(d):
    return P.find_stocks(d.stocks, *search_of(d), "brand#1")


@query("find_stocks_by_isin", _find_sql("ine01", "WHERE report_month = '1998-06'"))
def _(d):
    return P.find_stocks(d.stocks, *search_of(d), "ine01", "1998-06")


@query("name_postings", """
SELECT DISTINCT substr(t, i, n) AS gram, field, isin FROM (SELECT *, unnest(range(1, length(t) - n + 2)) AS i FROM (SELECT *, unnest([2, 3]) AS n FROM (
  SELECT isin, 'name' AS field, lower(name) AS t FROM v_stock UNION ALL SELECT isin, 'isin', lower(isin) FROM v_stock)))""")
def _(d):
    return search_of(d)[0]


@query("holder_counts", """
SELECT report_month, isin, count(DISTINCT scheme_id) AS n FROM v_holdings GROUP BY 1, 2 UNION ALL SELECT NULL, isin, count(DISTINCT scheme_id) FROM v_holdings GROUP BY isin""")
def _(d):
    return search_of(d)[1]


@query("scheme_catalog", """
SELECT report_month, scheme_id, amc_name, scheme_name, scheme_title AS label, is_active_equity <> 0 AS votes FROM v_scheme JOIN v_months USING (scheme_id)""")
def _(d):
    return P.scheme_catalog(d.schemes, d.scheme_months)


TEST_GROUPS = (("Large", tuple((f"House {k}", (f"HOUSE_{k}", f"NATION_{k}")) for k in range(5))),
               ("Foreign", tuple((f"House {k}", (f"NATION_{k}",)) for k in range(5, 8))))


@query("selected_house_groups", """
SELECT m.report_month, CASE WHEN k < 5 THEN 1 ELSE 2 END AS group_no, CASE WHEN k < 5 THEN k + 1 ELSE k - 4 END AS position, 'House ' || k AS display_name,
  coalesce(loaded, 0) AS loaded, coalesce(compared, 0) AS compared, coalesce(increased, 0) AS increased, coalesce(reduced, 0) AS reduced, biggest_isin
FROM (SELECT DISTINCT report_month FROM v_activity) m CROSS JOIN range(8) t(k) LEFT JOIN v_activity a ON a.report_month = m.report_month AND a.amc_name = 'NATION_' || k""")
def _(d):
    return H.selected_house_groups(activity_of(d), TEST_GROUPS).drop("group_title", "amc_name")


@query("source_backed", """
SELECT scheme_id, report_month FROM v_status s WHERE status = 'ok' AND EXISTS (SELECT 1 FROM v_snapsources n WHERE n.scheme_id = s.scheme_id AND n.report_month = s.report_month)
AND EXISTS (SELECT 1 FROM v_holdings h JOIN v_stock USING (isin) WHERE h.scheme_id = s.scheme_id AND h.report_month = s.report_month AND instrument_type = 'equity')
AND NOT EXISTS (SELECT 1 FROM v_holdings h JOIN v_stock USING (isin) WHERE h.scheme_id = s.scheme_id AND h.report_month = s.report_month AND instrument_type = 'equity'
 AND NOT EXISTS (SELECT 1 FROM v_evidence e JOIN v_snapsources n USING (scheme_id, report_month, source_sha256) WHERE e.scheme_id = h.scheme_id AND e.report_month = h.report_month AND e.isin = h.isin))""")
def _(d):
    return backed_of(d)


cte("v_backed", """
SELECT s.scheme_id, s.report_month FROM v_status s JOIN v_snapkeys k USING (scheme_id, report_month)
WHERE status = 'ok' AND (k.scheme_id + midx) % 19 <> 0 AND (k.scheme_id + midx) % 5 <> 0
AND (s.scheme_id, s.report_month) IN (SELECT (h.scheme_id, h.report_month) FROM v_holdings h JOIN v_stock USING (isin) WHERE instrument_type = 'equity')""")


@query("activation_candidates", """
SELECT c.report_month, c.scheme_id, CASE WHEN n.scheme_id IS NULL THEN 'current_not_source_backed' WHEN p.scheme_id IS NULL THEN 'previous_not_source_backed' ELSE 'usable' END AS state
FROM (SELECT DISTINCT scheme_id, report_month, prev_month FROM v_cmp) c LEFT JOIN v_backed n ON n.scheme_id = c.scheme_id AND n.report_month = c.report_month
LEFT JOIN v_backed p ON p.scheme_id = c.scheme_id AND p.report_month = c.prev_month""")
def _(d):
    return G.activation_candidates(comparison_of(d), backed_of(d))


# Columns that read the same in every engine, and numbers with the decimals at which they are compared.
CONTENT = {
    "schemes": ("v_scheme", "scheme_id amc_name scheme_name scheme_title is_active_equity", {}),
    "stocks": ("v_stock", "isin name industry instrument_type", {}),
    "mf_holdings_monthly": ("v_holdings", "scheme_id isin report_month", {"quantity": 0, "market_value_lakhs": 2, "pct_nav": 5}),
    "mf_holding_deltas": ("v_deltas", "scheme_id isin report_month prev_month action",
                          {"qty_change": 0, "value_change_lakhs": 2, "flow_lakhs": 4, "price_effect_lakhs": 4, "pct_nav_change": 5}),
    "scheme_month_status": ("v_status", "scheme_id report_month status", {}),
    "corporate_actions": ("v_actions", "isin effective_month kind detected_by confirmed", {"ratio": 4}),
    "security_prices_monthly": ("v_prices_monthly", "isin report_month trade_date", {"close_price": 5}),
    "shareholding_quarterly": ("v_filings", "isin quarter_end filing_type published_at",
                               {"promoter_pct": 6, "fii_pct": 6, "dii_pct": 6, "public_pct": 6, "mf_pct": 6}),
    "coverage_inventories": ("v_inventory", "amc_name report_month source_url exhaustive", {}),
    "expected_funds": ("v_expected", "amc_name report_month official_key official_name scheme_id active_eligible equity_eligible exclusion_reason", {}),
    "disclosure_sources": ("v_disclosures", "sha256 workbook_name source_url retrieved_at published_at", {}),
    "snapshot_sources": ("v_snapsources", "scheme_id report_month source_sha256", {}),
    "holding_evidence": ("v_evidence", "scheme_id report_month isin source_sha256", {}),
}


def _digest(table):
    source, texts, numbers = CONTENT[table]
    cells = {c: f"{c}::VARCHAR" for c in texts.split()} | {c: f"floor({c} * 1e{places} + 0.3217)::BIGINT::VARCHAR" for c, places in numbers.items()}
    text = " || '|' || ".join(f"coalesce(length({x}) || ':' || {x}, '-')" for _, x in sorted(cells.items()))
    columns = [*texts.split(), *numbers]
    month = next((f"coalesce(substr({c}::VARCHAR, 1, 7), '')" for c in R.MONTH_COLUMNS if c in columns), "''")
    sums = " || ':' || ".join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT)::VARCHAR" for i in range(4))
    return f"SELECT '{table}' AS table_name, month, count(*) AS n_rows, sha256(count(*)::VARCHAR || ':' || {sums}) AS digest FROM (SELECT {month} AS month, sha256({text}) AS h FROM {source}) GROUP BY month"


def _table_digest(table):
    return f"SELECT '{table}' AS table_name, coalesce(sum(n_rows), 0)::BIGINT AS n_rows, sha256(coalesce(string_agg(month || ':' || digest, chr(10) ORDER BY month || ':' || digest), '')) AS digest FROM ({_digest(table)})"


FINGERPRINT_SQL = " UNION ALL ".join(map(_table_digest, CONTENT))


def tables_of(d):
    return {"schemes": d.schemes, "stocks": d.stocks, "mf_holdings_monthly": d.holdings, "mf_holding_deltas": d.deltas, "scheme_month_status": d.status,
            "corporate_actions": d.actions, "security_prices_monthly": d.prices_monthly, "shareholding_quarterly": d.filings,
            "coverage_inventories": d.inventories, "expected_funds": d.expected_funds, "disclosure_sources": d.disclosure_sources,
            "snapshot_sources": d.snapshot_sources, "holding_evidence": d.evidence}


def comparable(tables):
    def grid(c, places):
        return F.floor(F.col(c) * F.lit(10.0 ** places) + C.SNAP_OFFSET).alias(c)
    return {name: tables[name].select(*texts.split(), *[grid(c, places) for c, places in numbers.items()])
            for name, (_, texts, numbers) in CONTENT.items()}


@query("content_fingerprint", FINGERPRINT_SQL)
def _(d):
    return R.content_fingerprint(comparable(tables_of(d)))


@query("month_digests", " UNION ALL ".join(map(_digest, CONTENT)))
def _(d):
    return reduce(DataFrame.unionByName, [R.month_digests(df, name) for name, df in sorted(comparable(tables_of(d)).items())])


@query("changed_months", """
SELECT report_month AS month, CASE WHEN report_month = '1996-03' THEN 'changed' WHEN report_month = '1997-05' THEN 'removed' END AS change, report_month = '1996-03' AS read_now FROM (SELECT DISTINCT report_month FROM v_holdings)""")
def _(d):
    """A stored table by month, of which one month is corrected and one emptied: only the corrected one is read again."""
    path = f"{required_folder(d.spark)}/by_month/{uuid.uuid4().hex}"
    write_months(d.spark, path, d.holdings)
    before = cut(R.stored_leaves(d.spark, path, "holdings"))
    corrected = d.holdings.filter("report_month = '1996-03'").withColumn("quantity", F.coalesce("quantity", F.lit(0.0)) + 1)
    write_months(d.spark, path, corrected, ["1997-05"])
    after = cut(R.stored_leaves(d.spark, path, "holdings", before))
    months = before.select("month").join(R.changed_months(before, after).select("month", "change"), "month", "left")
    return months.join(after.select("month", "read_now"), "month", "left").withColumn("read_now", F.coalesce("read_now", F.lit(False)))


@query("release_roundtrip", FINGERPRINT_SQL)
def _(d):
    """Write a release of the stored tables, read it back by id and fingerprint what was read."""
    root = f"{required_folder(d.spark)}/releases"
    rid = R.write_release(d.spark, root, tables_of(d))
    return R.content_fingerprint(comparable(R.read_release(d.spark, root, rid)))
