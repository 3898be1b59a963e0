"""Named queries: domain tables, eligibility and month-over-month comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflux.functions import classify as K
from folioflux.functions import columns as C
from folioflux.operators import compare as D
from folioflux.operators import eligibility as E
from folioflux.plans.base import cte, half_up, index_of, month_of, query, r, rupees


def pairs_of(d):
    return d.pairs


def bad_of(d):
    return d.bad_quantity


def eligible_of(d, instrument="equity"):
    return d.derived(f"eligible_{instrument}", lambda: E.eligible_deltas(d.deltas, d.schemes, d.stocks, d.status, bad_of(d), instrument))


def comparison_of(d):
    return d.derived("comparison", lambda: D.comparison_rows(pairs_of(d), d.schemes, d.stocks, d.status, bad_of(d), d.actions))


@query("holdings_table", f"SELECT scheme_id, isin, report_month, quantity, {r('market_value_lakhs', 2)} AS market_value_lakhs, "
       f"{r('pct_nav', 5)} AS pct_nav FROM v_holdings")
def _(d):
    return C.rounded(d.build_holdings(), 5, market_value_lakhs=2)


@query("classify_isin", "SELECT isin, instrument_type FROM v_stock")
def _(d):
    return d.stocks.select("isin", K.classify_isin("isin").alias("instrument_type"))


@query("scheme_classification", """
SELECT scheme_id, scheme_key, is_active_equity,
  CASE WHEN regexp_matches(lower(scheme_name), 'etf|index|nifty|sensex|bse|fof|sdl|gsec|liquid|overnight|arbitrage|debt|bond|money market|gilt|target maturity|savings')
    THEN 0 ELSE 1 END AS active_by_name FROM v_scheme""")
def _(d):
    return d.schemes.select("scheme_id", "scheme_key", "is_active_equity",
                            K.active_by_name("scheme_name").alias("active_by_name"))


@query("display_names", """
SELECT isin AS id, trim(regexp_replace(name, '^EQ *- *', '')) AS label FROM v_stock
UNION ALL SELECT scheme_id::VARCHAR, trim(split_part(scheme_title, ' (', 1)) FROM v_scheme""")
def _(d):
    return (d.stocks.select(F.col("isin").alias("id"), K.stock_label("name").alias("label"))
            .unionAll(d.schemes.select(F.col("scheme_id").cast("string"), K.scheme_label("scheme_name", "scheme_title"))))


@query("month_calendar", """
SELECT report_month, last_day((report_month || '-01')::DATE) AS month_end,
  strftime((report_month || '-01')::DATE - INTERVAL 1 MONTH, '%Y-%m') AS prev_month,
  last_day((report_month || '-01')::DATE) + 10 AS public_on, last_day((report_month || '-01')::DATE) + 11 AS entry_date,
  coalesce(strftime((lag(report_month) OVER (ORDER BY report_month) || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m') = report_month,
    false) AS follows_loaded_month
FROM (SELECT DISTINCT report_month FROM v_months)""")
def _(d):
    months = d.scheme_months.select("report_month").distinct()
    loaded_before = months.select(C.next_month("report_month").alias("report_month"), F.lit(True).alias("_f"))
    return (months.join(loaded_before, "report_month", "left")
            .select("report_month", C.month_end("report_month").alias("month_end"),
                    C.prev_month("report_month").alias("prev_month"), C.mf_deadline("report_month").alias("public_on"),
                    C.mf_entry_date("report_month").alias("entry_date"),
                    F.coalesce("_f", F.lit(False)).alias("follows_loaded_month")))


@query("filing_publication", """
SELECT isin, quarter_end, coalesce(published_at::DATE, quarter_end + 21) AS published_on,
  CASE WHEN published_at IS NULL THEN 'regulatory_deadline' ELSE 'observed' END AS published_basis,
  coalesce(published_at::DATE, quarter_end + 21) + 1 AS first_tradable,
  CASE WHEN strftime(quarter_end, '%m-%d') IN ('03-31', '06-30', '09-30', '12-31') THEN 'quarterly' ELSE 'interim' END AS derived_type,
  coalesce(filing_type = 'quarterly', strftime(quarter_end, '%m-%d') IN ('03-31', '06-30', '09-30', '12-31')) AS is_quarterly,
  last_day(quarter_end - INTERVAL 3 MONTH) AS previous_quarter, last_day(quarter_end + INTERVAL 3 MONTH) AS next_quarter,
  quarter_end + 30 AS decision_on FROM v_filings""")
def _(d):
    q = "quarter_end"
    return d.filings.select(
        "isin", q, C.filing_published(q, "published_at").alias("published_on"),
        C.filing_basis("published_at").alias("published_basis"),
        C.first_tradable(C.filing_published(q, "published_at")).alias("first_tradable"),
        C.filing_type_of(q).alias("derived_type"), C.is_quarterly_filing(q, "filing_type").alias("is_quarterly"),
        C.shift_quarter(q, -1).alias("previous_quarter"), C.shift_quarter(q, 1).alias("next_quarter"),
        C.decision_date(q).alias("decision_on"))


# Watch requests, one for each scheme and month: its holdings in any case and spacing, some named twice; every seventh scheme names a
# code that is none, every eleventh more codes than a request may hold.
def requests_of(d):
    many = F.transform(F.sequence(F.lit(1), F.lit(101)), lambda i: F.concat(F.lit("INE"), F.lpad(i.cast("string"), 3, "0"), F.lit("A01011")))
    codes = F.array_sort(F.collect_set(F.concat(F.lit(" "), F.lower("isin"))))
    asked = d.holdings.groupBy("scheme_id", "report_month").agg(codes.alias("c"))
    text = F.concat_ws(" , ", "c", F.get("c", F.lit(0)), F.lit(""), F.when(F.col("scheme_id") % 7 == 3, F.lit("INE-1")))
    return asked.select("scheme_id", "report_month", F.when(F.col("scheme_id") % 11 == 4, F.concat_ws(",", many)).otherwise(text).alias("stocks"))


@query("parse_stocks", """
SELECT scheme_id, report_month, scheme_id % 7 <> 3 AND scheme_id % 11 <> 4 AS valid, CASE WHEN scheme_id % 7 <> 3 AND scheme_id % 11 <> 4 THEN isin END AS isin FROM v_holdings GROUP BY ALL""")
def _(d):
    return K.parse_stocks(requests_of(d), key_cols=("scheme_id", "report_month"))


def _compact(x):
    text = f"CASE WHEN {x} > 0 THEN '+' WHEN {x} < 0 THEN '\u2212' ELSE '' END || format('{{:,.0f}}', abs({x}))"
    for unit, suffix in (("1e3", "K"), ("1e6", "M"), ("1e9", "B")):
        size = f"abs({x}) / {unit}::DOUBLE"
        text = f"""CASE WHEN abs({x}) >= {unit} OR round({size} * 1000, 1) >= 1000
  THEN CASE WHEN {x} > 0 THEN '+' ELSE '\u2212' END || regexp_replace({half_up(size, 1)}, '[.]0$', '') || '{suffix}' ELSE {text} END"""
    return f"coalesce({text}, '\u2013')"


@query("display_amounts", f"""
SELECT scheme_id, isin, report_month, coalesce(CASE WHEN crore < 0 THEN '\u2212' ELSE '' END || CASE WHEN abs(crore) >= 10 THEN format('{{:,.0f}}', abs(crore)) ELSE format('{{:,.1f}}', abs(crore)) END, '\u2013') AS flow_crore,
  {rupees('value_change_lakhs')} AS value_crore, coalesce(CASE WHEN nav > 0 THEN '+' WHEN nav < 0 THEN '\u2212' ELSE '' END || format('{{:,.2f}}', abs(nav)), '\u2013') AS nav_change, {_compact('qty_change')} AS shares
FROM (SELECT *, flow_lakhs / 100.0::DOUBLE AS crore, ({half_up('pct_nav_change', 2)})::DOUBLE AS nav FROM v_deltas)""")
def _(d):
    return d.deltas.select("scheme_id", "isin", "report_month", K.crore_text("flow_lakhs").alias("flow_crore"),
                           K.rupee_crore("value_change_lakhs").alias("value_crore"),
                           K.signed_text("pct_nav_change", 2).alias("nav_change"),
                           K.compact_shares("qty_change").alias("shares"))


# -- eligibility ------------------------------------------------------------------------

@query("bad_domestic_quantity", "SELECT scheme_id, report_month FROM v_bad")
def _(d):
    return E.bad_domestic_quantity(d.holdings, d.stocks)


@query("quarantined_scheme_months", "SELECT scheme_id, report_month FROM v_status WHERE status = 'quarantined'")
def _(d):
    return E.quarantined(d.status)


@query("active_equity_schemes", "SELECT scheme_id, amc_name FROM v_scheme WHERE is_active_equity = 1")
def _(d):
    return E.active_equity(d.schemes).select("scheme_id", "amc_name")


@query("eligible_deltas", f"""
SELECT scheme_id, isin, report_month, prev_month, amc_name, action, qty_change, {r('flow_lakhs', 4)} AS flow_lakhs FROM v_eligible""")
def _(d):
    return C.rounded(eligible_of(d).select("scheme_id", "isin", "report_month", "prev_month", "amc_name", "action",
                                           "qty_change", "flow_lakhs"), 4)


@query("voting_schemes", "SELECT DISTINCT report_month, scheme_id, amc_name FROM v_eligible")
def _(d):
    return E.voting_schemes(eligible_of(d))


@query("unmatched_schemes", f"""
WITH m AS (SELECT scheme_id, {index_of('report_month')} AS i FROM v_months),
 p AS (SELECT DISTINCT a.i FROM m a JOIN m b ON b.i = a.i - 1)
SELECT {month_of('m.i')} AS report_month, 'only_curr' AS side, scheme_id FROM m JOIN p ON p.i = m.i
WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.scheme_id = m.scheme_id AND o.i = m.i - 1)
UNION ALL SELECT {month_of('m.i + 1')}, 'only_prev', scheme_id FROM m JOIN p ON p.i = m.i + 1
WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.scheme_id = m.scheme_id AND o.i = m.i + 1)""")
def _(d):
    return D.unmatched_schemes(d.holdings)


@query("excluded_passive", """
SELECT DISTINCT report_month, scheme_id, amc_name, scheme_name FROM v_deltas JOIN v_scheme USING (scheme_id)
WHERE is_active_equity = 0""")
def _(d):
    return E.excluded_passive(d.deltas, d.schemes)


# -- deltas and splits ---------------------------------------------------------------------

DELTA_SQL = (f"SELECT scheme_id, isin, report_month, prev_month, qty_change, {r('value_change_lakhs', 4)} AS value_change_lakhs, "
             f"{r('flow_lakhs', 4)} AS flow_lakhs, {r('price_effect_lakhs', 4)} AS price_effect_lakhs, "
             f"{r('pct_nav_change', 5)} AS pct_nav_change, action FROM v_deltas")


@query("deltas_all_months", DELTA_SQL)
def _(d):
    return C.rounded(D.deltas_all_months(d.holdings), 4, pct_nav_change=5)


@query("deltas_one_month", DELTA_SQL + " WHERE report_month = '1998-06'")
def _(d):
    return C.rounded(D.compute_deltas(d.holdings, "1998-05", "1998-06"), 4, pct_nav_change=5)


def _gap(x, k):
    return f"round(abs(({x}) - {k}) / {k}, 9)"


# First matching ratio as a SQL list filter, independent of the CASE chains used on the Spark side.
RATIOS = "[1.25, 1.5, 2.0, 3.0, 4.0, 5.0, 10.0, 0.5, 0.2, 0.1]::DOUBLE[]"

cte("v_inferred_cmp", f"""
SELECT report_month, isin, k AS split_ratio FROM (
 SELECT report_month, isin, k, ord, bool_or(quantity_prev IS NULL OR quantity_curr IS NULL OR market_value_lakhs_prev IS NULL
    OR market_value_lakhs_curr IS NULL) AS veto,
  max({_gap('quantity_curr / quantity_prev', 'k')}) FILTER (WHERE quantity_prev > 0 AND quantity_curr > 0 AND market_value_lakhs_prev > 0 AND market_value_lakhs_curr > 0) AS gap,
  (sum(market_value_lakhs_curr) FILTER (WHERE quantity_prev > 0 AND quantity_curr > 0 AND market_value_lakhs_prev > 0 AND market_value_lakhs_curr > 0)
   / sum(quantity_curr) FILTER (WHERE quantity_prev > 0 AND quantity_curr > 0 AND market_value_lakhs_prev > 0 AND market_value_lakhs_curr > 0))
  / (sum(market_value_lakhs_prev) FILTER (WHERE quantity_prev > 0 AND quantity_curr > 0 AND market_value_lakhs_prev > 0 AND market_value_lakhs_curr > 0)
   / sum(quantity_prev) FILTER (WHERE quantity_prev > 0 AND quantity_curr > 0 AND market_value_lakhs_prev > 0 AND market_value_lakhs_curr > 0)) AS px
 FROM v_cmp_raw, (SELECT unnest({RATIOS}) AS k, generate_subscripts({RATIOS}, 1) AS ord) ks GROUP BY ALL)
WHERE NOT veto AND gap <= 0.02 AND round(abs(px * k - 1), 9) <= 0.15
QUALIFY row_number() OVER (PARTITION BY report_month, isin ORDER BY ord) = 1""")
cte("v_cmp_raw", """
SELECT p.*, sch.amc_name, s.name AS stock_name FROM v_pairs p JOIN v_stock s USING (isin)
JOIN v_scheme sch ON sch.scheme_id = p.scheme_id
JOIN v_status a ON a.scheme_id = p.scheme_id AND a.report_month = p.report_month AND a.status = 'ok'
JOIN v_status b ON b.scheme_id = p.scheme_id AND b.report_month = p.prev_month AND b.status = 'ok'
WHERE s.instrument_type = 'equity' AND sch.is_active_equity = 1
  AND NOT EXISTS (SELECT 1 FROM v_bad w WHERE w.scheme_id = p.scheme_id AND w.report_month IN (p.report_month, p.prev_month))""")
cte("v_cmp", """
SELECT *, qc - qp AS qty_change, vc - vp AS value_change_lakhs,
  CASE WHEN qc <= 0 AND vc = 0 AND flow_lakhs IS NOT NULL THEN 0.0 ELSE vc - vp - flow_lakhs END AS price_effect_lakhs
FROM (SELECT *, CASE WHEN qp <= 0 AND qc <= 0 THEN 0.0 WHEN qc <= 0 THEN -vp ELSE (qc - qp) * (vc / qc) END AS flow_lakhs
 FROM (SELECT r.report_month, r.prev_month, r.scheme_id, r.isin, amc_name, stock_name, in_prev, in_curr,
   quantity_prev AS raw_quantity_prev, quantity_prev * coalesce(a.ratio, i.split_ratio, 1.0) AS qp, quantity_curr AS qc,
   market_value_lakhs_prev AS vp, market_value_lakhs_curr AS vc, coalesce(a.ratio, i.split_ratio, 1.0) AS split_ratio,
   pct_nav_curr - pct_nav_prev AS pct_nav_change,
   CASE WHEN a.ratio IS NOT NULL THEN 'confirmed' WHEN i.split_ratio IS NOT NULL THEN 'inferred' ELSE 'none' END AS adjustment_basis
  FROM v_cmp_raw r LEFT JOIN v_inferred_cmp i ON i.report_month = r.report_month AND i.isin = r.isin
  LEFT JOIN v_actions a ON a.isin = r.isin AND a.effective_month = r.report_month))""")


@query("infer_split_ratios", "SELECT report_month, isin, split_ratio FROM v_inferred_cmp")
def _(d):
    votes = E.active_equity(d.schemes)
    rows = (pairs_of(d).join(E.comparable_scheme_months(d.status, bad_of(d)), ["scheme_id", "report_month"], "left_semi")
            .join(votes.select("scheme_id"), "scheme_id", "left_semi")
            .join(d.stocks.filter(F.col("instrument_type") == "equity").select("isin"), "isin", "left_semi"))
    return D.infer_split_ratios(rows.withColumn("in_prev", F.lit(True)).withColumn("in_curr", F.lit(True)))


@query("comparison_rows", f"""
SELECT report_month, scheme_id, isin, amc_name, raw_quantity_prev, {r('qp', 4)} AS quantity_prev, qc AS quantity_curr, split_ratio,
  adjustment_basis, {r('qty_change', 4)} AS qty_change, {r('flow_lakhs', 4)} AS flow_lakhs, {r('value_change_lakhs', 4)} AS value_change_lakhs,
  {r('price_effect_lakhs', 4)} AS price_effect_lakhs, {r('pct_nav_change', 4)} AS pct_nav_change FROM v_cmp""")
def _(d):
    return C.rounded(comparison_of(d).select(
        "report_month", "scheme_id", "isin", "amc_name", "raw_quantity_prev", "quantity_prev", "quantity_curr",
        "split_ratio", "adjustment_basis", "qty_change", "flow_lakhs", "value_change_lakhs", "price_effect_lakhs",
        "pct_nav_change"), 4)
