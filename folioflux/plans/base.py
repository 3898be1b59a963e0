"""Query registry: each named query pairs a Spark plan with independent SQL.

The SQL is written against shared common table expressions that restate the
domain tables; only those a query names (directly or indirectly) are included.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from folioflux.sources.domain import Domain
from folioflux.sources.staging import folder_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


@lru_cache(maxsize=8)
def _domain(app: str, spark: SparkSession, folder: str, state: str) -> Domain:
    return Domain(spark, folder, state=state)


def domain(spark: SparkSession, folder: str) -> Domain:
    """The domain of a folder as it is now: changed input files are a new domain."""
    return _domain(spark.sparkContext.applicationId, spark, folder, folder_state(spark, folder))


def query(name: str, sql: str | None = None):
    """Register ``fn(domain) -> DataFrame`` with its oracle."""
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(domain(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# Computed once on the SQL side, so joins above them are not reordered into their inputs.
FENCES = {"v_holdings", "v_pairs", "v_deltas", "v_eligible_any", "v_cmp", "v_weights", "v_consensus", "v_joined", "v_periods", "v_entry",
          "v_exit", "v_panel", "v_qperiods", "v_qentry", "v_qexit", "v_qpanel", "v_prices_daily", "v_filings", "v_old_raw", "v_old_split", "v_old_status"}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """Prefix the query with the CTEs it uses, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(CTES.keys() & set(re.findall(r"[a-z_0-9]+", text))):
            if name not in ordered:
                visit(CTES[name])
                ordered.append(name)
    visit(sql)
    parts = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in FENCES else ''}({CTES[name]})" for name in ordered)
    if not parts:
        return sql
    body = sql.strip()
    return f"WITH {parts},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {parts}\n{body}"


# -- the domain tables ------------------------------------------------------------------

ISIN = """CASE WHEN b <= 20 THEN 'INE' || lpad(b::VARCHAR, 3, '0') || 'A0101' || (b % 10)::VARCHAR
  WHEN b = 21 THEN 'INE021A07011' WHEN b = 22 THEN 'INE022A02012' WHEN b = 23 THEN 'IN0020230013'
  WHEN b = 24 THEN 'US0240000014' ELSE 'INF025A01015' END"""


def month_of(index: str) -> str:
    return f"printf('%04d-%02d', ({index}) // 12, ({index}) % 12 + 1)"


def index_of(month: str) -> str:
    return f"(substr({month}, 1, 4)::INT * 12 + substr({month}, 6, 2)::INT - 1)"


def strict(x: str, where: str | None = None) -> str:
    if where is None:
        return f"CASE WHEN count(*) = count({x}) THEN sum({x}) END"
    return (f"CASE WHEN count(*) FILTER (WHERE {where}) = count({x}) FILTER (WHERE {where}) "
            f"THEN sum({x}) FILTER (WHERE {where}) END")


def r(x: str, places: int = 6) -> str:
    scale = f"1e{places}"
    return f"(floor(({x})::DOUBLE * {scale} + 0.3217) / {scale})"


def half_up(x: str, places: int) -> str:
    """Text of a number rounded half up on its shortest decimal form."""
    return f"round(({x})::DOUBLE::VARCHAR::DECIMAL(38,20), {places})::DECIMAL(38,{places})::VARCHAR"


def rupees(x: str) -> str:
    return f"(CASE WHEN {x} / 100.0::DOUBLE >= 0 THEN '+' ELSE '-' END || '₹' || {half_up(f'abs({x} / 100.0::DOUBLE)', 1)} || ' Cr')"


SCHEME_LABEL = "trim(split_part(scheme_title, ' (', 1))"
STOCK_LABEL = "trim(regexp_replace(name, '^EQ *- *', ''))"

cte("v_scheme", """
SELECT s_suppkey::BIGINT AS scheme_id, n_name AS amc_name, s_name AS scheme_name,
  trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS scheme_key,
  n_name || ' ' || CASE s_suppkey % 10 WHEN 0 THEN 'Index Fund' WHEN 1 THEN 'Arbitrage Fund'
    WHEN 2 THEN 'Liquid Fund' WHEN 3 THEN 'Savings Fund' WHEN 4 THEN 'Regular Savings Fund'
    ELSE 'Flexi Cap Fund' END AS scheme_title,
  CASE WHEN s_suppkey % 10 IN (0, 1, 2, 3) THEN 0 ELSE 1 END AS is_active_equity, n_nationkey AS house_no
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
cte("v_stock", f"""
SELECT {ISIN} AS isin, CASE WHEN b % 3 = 0 THEN 'EQ - ' || p_brand ELSE p_brand END AS name, industry,
  CASE WHEN b <= 20 THEN 'equity' WHEN b = 21 THEN 'ncd' WHEN b = 22 THEN 'preference'
    WHEN b = 23 THEN 'tbill_or_gsec' WHEN b = 24 THEN 'foreign' ELSE 'mf_units' END AS instrument_type
FROM (SELECT p_brand, substr(p_brand, 7)::INT AS b, min(p_type) AS industry FROM part GROUP BY p_brand)""")
cte("v_lines", """
SELECT l.*, substr(p_brand, 7)::INT AS b, round(l_extendedprice * 100)::BIGINT AS line_cents
FROM lineitem l JOIN part ON l_partkey = p_partkey""")
cte("v_lots", """
SELECT l_suppkey::BIGINT AS scheme_id, b, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS midx,
  sum(l_quantity::BIGINT)::BIGINT AS q, sum(line_cents)::BIGINT AS cents
FROM v_lines GROUP BY ALL""")
cte("v_injected", """
SELECT * FROM v_lots WHERE NOT (b = 9 AND midx = 1998 * 12 + 5)
UNION ALL SELECT scheme_id, b, midx + 1, q * 5, cents FROM v_lots WHERE b = 9 AND midx = 1998 * 12 + 4""")
cte("v_holdings", f"""
SELECT scheme_id, {ISIN} AS isin, {month_of('midx')} AS report_month,
  CASE WHEN b <> 9 AND (scheme_id * 7 + b * 13 + midx) % 97 = 0 THEN NULL ELSE q END::DOUBLE AS quantity,
  cents / 100.0 AS market_value_lakhs,
  100.0 * cents / sum(cents) OVER (PARTITION BY scheme_id, midx)
    * CASE WHEN (scheme_id + midx % 12 + 1) % 13 = 0 THEN 1.2 WHEN (scheme_id + midx % 12 + 1) % 7 = 0 THEN 0.9
      ELSE 1.0 END AS pct_nav
FROM v_injected""")
cte("v_status", f"""
SELECT h.scheme_id, report_month, CASE WHEN sum(pct_nav) > 110
    OR count(*) FILTER (WHERE quantity IS NULL AND instrument_type = 'equity') > 0
  THEN 'quarantined' ELSE 'ok' END AS status
FROM v_holdings h LEFT JOIN v_stock USING (isin)
WHERE (h.scheme_id + {index_of('report_month')}) % 29 <> 0 GROUP BY ALL""")
cte("v_months", "SELECT DISTINCT scheme_id, report_month FROM v_holdings")
cte("v_pairs", f"""
WITH idx AS (SELECT *, {index_of('report_month')} AS i FROM v_holdings),
 live AS (SELECT DISTINCT scheme_id, i FROM idx),
 both_sides AS (SELECT a.scheme_id, a.i FROM live a JOIN live b ON a.scheme_id = b.scheme_id AND b.i = a.i - 1)
SELECT coalesce(c.scheme_id, p.scheme_id) AS scheme_id, coalesce(c.isin, p.isin) AS isin,
  {month_of('coalesce(c.i, p.i + 1)')} AS report_month, {month_of('coalesce(c.i - 1, p.i)')} AS prev_month,
  p.scheme_id IS NOT NULL AS in_prev, c.scheme_id IS NOT NULL AS in_curr,
  CASE WHEN p.scheme_id IS NULL THEN 0 ELSE p.quantity END AS quantity_prev,
  CASE WHEN c.scheme_id IS NULL THEN 0 ELSE c.quantity END AS quantity_curr,
  CASE WHEN p.scheme_id IS NULL THEN 0 ELSE p.market_value_lakhs END AS market_value_lakhs_prev,
  CASE WHEN c.scheme_id IS NULL THEN 0 ELSE c.market_value_lakhs END AS market_value_lakhs_curr,
  CASE WHEN p.scheme_id IS NULL THEN 0 ELSE p.pct_nav END AS pct_nav_prev,
  CASE WHEN c.scheme_id IS NULL THEN 0 ELSE c.pct_nav END AS pct_nav_curr
FROM idx c FULL OUTER JOIN idx p ON c.scheme_id = p.scheme_id AND c.isin = p.isin AND p.i = c.i - 1
JOIN both_sides s ON s.scheme_id = coalesce(c.scheme_id, p.scheme_id) AND s.i = coalesce(c.i, p.i + 1)""")
cte("v_deltas", """
SELECT scheme_id, isin, report_month, prev_month, qc - qp AS qty_change, vc - vp AS value_change_lakhs, flow_lakhs,
  CASE WHEN qc <= 0 AND vc = 0 AND vp IS NOT NULL AND flow_lakhs IS NOT NULL THEN 0.0
    ELSE vc - vp - flow_lakhs END AS price_effect_lakhs,
  pct_nav_curr - pct_nav_prev AS pct_nav_change,
  CASE WHEN qp IS NULL OR qc IS NULL THEN 'unavailable' WHEN NOT in_prev THEN 'new' WHEN NOT in_curr THEN 'exited'
    WHEN qc > qp THEN 'added' WHEN qc < qp THEN 'trimmed' ELSE 'unchanged' END AS action
FROM (SELECT *, CASE WHEN qp IS NULL OR qc IS NULL THEN NULL WHEN NOT in_prev THEN vc
    WHEN qp <= 0 AND qc <= 0 THEN 0.0 WHEN NOT in_curr OR qc <= 0 THEN -vp ELSE (qc - qp) * (vc / qc) END AS flow_lakhs
  FROM (SELECT *, quantity_prev AS qp, quantity_curr AS qc, market_value_lakhs_prev AS vp,
          market_value_lakhs_curr AS vc FROM v_pairs))""")
cte("v_bad", """
SELECT DISTINCT scheme_id, report_month FROM v_holdings JOIN v_stock USING (isin)
WHERE instrument_type = 'equity' AND quantity IS NULL""")
cte("v_withheld", """
SELECT scheme_id, report_month FROM v_status WHERE status = 'quarantined'
UNION SELECT scheme_id, report_month FROM v_bad""")
cte("v_eligible_any", """
SELECT d.*, sch.amc_name, s.name AS stock_name, s.industry, s.instrument_type FROM v_deltas d
JOIN v_stock s USING (isin) JOIN v_scheme sch ON sch.scheme_id = d.scheme_id
WHERE sch.is_active_equity = 1
  AND NOT EXISTS (SELECT 1 FROM v_withheld w WHERE w.scheme_id = d.scheme_id AND w.report_month = d.report_month)
  AND NOT EXISTS (SELECT 1 FROM v_withheld w WHERE w.scheme_id = d.scheme_id AND w.report_month = d.prev_month)""")
cte("v_eligible", "SELECT * FROM v_eligible_any WHERE instrument_type = 'equity'")
cte("v_actions", """
SELECT isin, '1998-06' AS effective_month, 'split' AS kind, 2.0::DOUBLE AS ratio, 'operator' AS detected_by,
  1 AS confirmed FROM v_stock WHERE isin = 'INE007A01017'""")
cte("v_filings", f"""
WITH f AS (SELECT b, last_day(date_trunc('quarter', o_orderdate)::DATE + INTERVAL 2 MONTH) AS quarter_end,
   sum(line_cents) AS t,
   sum(line_cents) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS pr, sum(line_cents) FILTER (WHERE c_mktsegment = 'BUILDING') AS fi,
   sum(line_cents) FILTER (WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY')) AS di,
   sum(line_cents) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS pu, sum(line_cents) FILTER (WHERE c_mktsegment = 'MACHINERY') AS mf
  FROM v_lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 g AS (SELECT *, quarter(quarter_end) AS q, CASE WHEN (b + quarter(quarter_end)) % 9 = 0 THEN 0.95 ELSE 1.0 END::DOUBLE AS k FROM f),
 n AS (SELECT *, 'quarterly' AS kind, quarter_end AS day FROM g
   UNION ALL SELECT *, 'interim', quarter_end - 15 FROM g WHERE (b + q) % 6 = 0)
SELECT {ISIN} AS isin, day::DATE AS quarter_end, coalesce(pr, 0) * 100.0::DOUBLE / t * k AS promoter_pct,
  coalesce(fi, 0) * 100.0::DOUBLE / t * k AS fii_pct, coalesce(di, 0) * 100.0::DOUBLE / t * k AS dii_pct,
  coalesce(pu, 0) * 100.0::DOUBLE / t * k AS public_pct,
  CASE WHEN b % 11 <> 0 THEN coalesce(mf, 0) * 100.0::DOUBLE / t * k END AS mf_pct,
  CASE WHEN b % 8 <> 0 THEN kind END AS filing_type,
  CASE WHEN (b + q) % 5 <> 0 THEN strftime(quarter_end + ((b * 7 + q * 3) % 45)::INT, '%Y-%m-%d') END AS published_at
FROM n""")
cte("v_prices_daily", f"""
SELECT {ISIN} AS isin, day AS trade_date, cents::DOUBLE / q / 100 AS close_price, cents::DOUBLE / 100 AS traded_value
FROM (SELECT b, l_shipdate::DATE AS day, sum(line_cents) AS cents, sum(l_quantity::BIGINT) AS q FROM v_lines
  WHERE b <= 20 AND isodow(l_shipdate) <= 5 GROUP BY ALL)""")
cte("v_prices_monthly", """
SELECT isin, strftime(trade_date, '%Y-%m') AS report_month, max(trade_date) AS trade_date,
  max_by(close_price, trade_date) AS close_price FROM v_prices_daily GROUP BY ALL""")
cte("v_expected", """
SELECT s.amc_name, m.report_month, 'F' || s.scheme_id AS official_key, scheme_title AS official_name,
  CASE WHEN s.scheme_id % 17 <> 0 THEN s.scheme_id END AS scheme_id, is_active_equity AS active_eligible,
  CASE WHEN s.scheme_id % 10 = 2 THEN 0 ELSE 1 END AS equity_eligible,
  CASE WHEN s.scheme_id % 10 = 2 THEN 'debt portfolio' END AS exclusion_reason
FROM v_scheme s JOIN (SELECT DISTINCT amc_name, report_month FROM v_months JOIN v_scheme USING (scheme_id)) m
  ON m.amc_name = s.amc_name""")
cte("v_inventory", """
SELECT amc_name, report_month, 'https://example.com/' || lower(amc_name) AS source_url,
  max(CASE WHEN house_no % 2 = 0 THEN 1 ELSE 0 END) AS exhaustive
FROM v_months JOIN v_scheme USING (scheme_id) GROUP BY 1, 2, 3""")
