"""Named queries: disclosure normalisation, filings, scheme identity and keyed table updates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.operators import filings as B
from folioflux.operators import gate as V
from folioflux.operators import identity as I
from folioflux.operators import intake as K
from folioflux.operators import normalize as N
from folioflux.plans.base import cte, half_up, query, r
from folioflux.sources import tables as T
from folioflux.sources.staging import cut, required_folder

cte("v_sheets", "SELECT scheme_id, amc_name, report_month, scheme_name AS sheet, scheme_title FROM v_months JOIN v_scheme USING (scheme_id)")
cte("v_sheet_rows", """
SELECT h.scheme_id, amc_name, h.report_month, scheme_name AS sheet, isin, quantity, market_value_lakhs, floor(pct_nav * 10000 + 0.3217) AS nv,
  CASE WHEN h.scheme_id % 3 = 0 THEN 1e-6 ELSE 1e-4 END::DOUBLE AS unit, row_number() OVER (PARTITION BY h.scheme_id, h.report_month ORDER BY isin) + 3 AS row_number
FROM v_holdings h JOIN v_scheme USING (scheme_id)""")
cte("v_sheet_totals", """
SELECT amc_name, report_month, sheet, max(scheme_id) AS scheme_id, count(*) AS n, sum(nv) AS nv, max(unit) AS unit, (sum(nv) + 20000) * max(unit) AS total FROM v_sheet_rows GROUP BY ALL""")
cte("v_sheet_scale", """
SELECT *, CASE WHEN total BETWEEN 0.95 AND 1.05 THEN 'fraction' WHEN total BETWEEN 95 AND 105 THEN 'percent' ELSE 'unknown' END AS scale FROM v_sheet_totals""")


def headers_of(d):
    return N.find_header_row(d.raw_rows)


def typed_of(d):
    headers = headers_of(d)
    return N.typed_rows(N.canonical_rows(d.raw_rows, headers, N.match_columns(d.raw_rows, headers)))


def portfolio_of(d):
    typed = typed_of(d)
    return N.portfolio_rows(typed, N.portfolio_boundary(typed))


@query("find_header_row", "SELECT amc_name, report_month, sheet, 3 AS header_row FROM v_sheets")
def _(d):
    return headers_of(d)


@query("match_columns", """
SELECT amc_name, report_month, sheet, CASE WHEN scheme_id % 2 = 1 THEN 0 ELSE 1 END AS isin, CASE WHEN scheme_id % 2 = 1 THEN 1 ELSE 0 END AS instrument_name,
  2 AS industry, 3 AS quantity, 4 AS market_value_lakhs, 5 AS pct_nav FROM v_sheets""")
def _(d):
    return N.match_columns(d.raw_rows, headers_of(d)).drop("missing")


@query("isin_hygiene", """
SELECT amc_name, report_month, sheet, row_number, isin FROM v_sheet_rows
UNION ALL SELECT amc_name, report_month, sheet, n + 7, 'INE001A01011' FROM v_sheet_totals WHERE scheme_id % 5 = 0""")
def _(d):
    return typed_of(d).filter("valid").select(*N.SHEET, "row_number", F.upper("isin").alias("isin"))


@query("holding_detail_rows", "SELECT amc_name, report_month, sheet, n + 4 AS row_number, 'TREPS' AS instrument_name FROM v_sheet_totals")
def _(d):
    return typed_of(d).filter("detail").select(*N.SHEET, "row_number", "instrument_name")


@query("portfolio_boundary", """
SELECT amc_name, report_month, sheet, 4 AS first_holding, CASE WHEN scheme_id % 5 <> 4 THEN n + 6 END AS end_row FROM v_sheet_totals""")
def _(d):
    return N.portfolio_boundary(typed_of(d)).select(*N.SHEET, "first_holding", "end_row")


@query("sheet_totals", f"""
SELECT amc_name, report_month, sheet, n AS kept, 1 AS dropped_non_isin_count, scale AS pct_nav_scale, {r('CASE WHEN scheme_id % 5 <> 4 AND scale <> ' + "'unknown'" + ' THEN total END', 5)} AS reported_total,
  {r("20000 * unit * CASE WHEN scale = 'fraction' THEN 100 ELSE 1 END", 5)} AS dropped_non_isin_pct_nav FROM v_sheet_scale""")
def _(d):
    return C.rounded(N.sheet_totals(portfolio_of(d)), 5)


cte("v_parsed", """
SELECT amc_name, report_month, sheet, row_number, isin, quantity, market_value_lakhs, nv * s.unit AS pct_nav_raw, nv * s.unit * CASE WHEN scale = 'fraction' THEN 100 ELSE 1 END AS pct_nav,
  scale AS pct_nav_scale FROM (SELECT * EXCLUDE (unit, scheme_id) FROM v_sheet_rows) JOIN (SELECT amc_name, report_month, sheet, unit, scale FROM v_sheet_scale) s USING (amc_name, report_month, sheet)""")


@query("parsed_holdings", f"""
SELECT amc_name, report_month, sheet, row_number, isin, quantity, {r('market_value_lakhs', 3)} AS market_value_lakhs, {r('pct_nav_raw', 5)} AS pct_nav_raw, {r('pct_nav', 5)} AS pct_nav, pct_nav_scale FROM v_parsed""")
def _(d):
    return C.rounded(N.parsed_holdings(d.raw_rows).select(*N.SHEET, "row_number", "isin", "quantity", "market_value_lakhs", "pct_nav_raw", "pct_nav", "pct_nav_scale"),
                     5, market_value_lakhs=3)


# Holding lines as older files carry them: some NAV columns as fractions, some holdings in several lots or with notes.
def lines_of(d):
    cents = F.round(F.col("market_value_lakhs") * 100).cast("bigint")
    nav = F.when(F.col("scheme_id") % 3 == 0, F.col("pct_nav") / 100).otherwise(F.col("pct_nav"))
    none = F.lit(None).cast("double")

    def line(no, q, v, n):
        return F.struct(F.lit(no).alias("line_no"), q.alias("quantity"), v.alias("market_value_lakhs"), n.alias("pct_nav"))
    base = d.holdings.withColumn("c", cents).withColumn("nav", nav)
    lots = F.array_compact(F.array(
        line(1, F.col("quantity"), F.col("market_value_lakhs"), F.col("nav")),
        F.when(F.col("c") % 3 == 0, line(2, F.floor(F.col("quantity") / 2).cast("double"), F.lit(1.0), F.lit(0.5))),
        F.when(F.col("c") % 5 == 0, line(3, F.lit(0.0), none, none)), F.when(F.col("c") % 7 == 0, line(4, none, F.lit(0.0), F.lit(0.0)))))
    lots = F.when(F.col("c") % 11 == 0, F.array(line(1, F.lit(0.0), F.lit(0.0), F.lit(0.0)), line(2, none, none, none))).otherwise(lots)
    return (base.select("scheme_id", "isin", "report_month", F.explode(lots).alias("l")).select("scheme_id", "isin", "report_month", "l.*")
            .withColumn("pct_nav_raw", F.col("pct_nav")).withColumn("pct_nav_scale", F.lit(None).cast("string")))


cte("v_file_lines", """
WITH b AS (SELECT *, round(market_value_lakhs * 100)::BIGINT AS c, CASE WHEN scheme_id % 3 = 0 THEN pct_nav / 100 ELSE pct_nav END AS nav FROM v_holdings)
SELECT scheme_id, isin, report_month, 1 AS line_no, quantity, market_value_lakhs, nav AS pct_nav FROM b WHERE c % 11 <> 0
UNION ALL SELECT scheme_id, isin, report_month, 2, floor(quantity / 2), 1.0, 0.5 FROM b WHERE c % 11 <> 0 AND c % 3 = 0
UNION ALL SELECT scheme_id, isin, report_month, 3, 0.0, NULL, NULL FROM b WHERE c % 11 <> 0 AND c % 5 = 0
UNION ALL SELECT scheme_id, isin, report_month, 4, NULL, 0.0, 0.0 FROM b WHERE c % 11 <> 0 AND c % 7 = 0
UNION ALL SELECT scheme_id, isin, report_month, 1, 0.0, 0.0, 0.0 FROM b WHERE c % 11 = 0
UNION ALL SELECT scheme_id, isin, report_month, 2, NULL, NULL, NULL FROM b WHERE c % 11 = 0""")


@query("loader_nav_rescale", f"""
SELECT scheme_id, isin, report_month, line_no, {r('CASE WHEN round(coalesce(sum(pct_nav) OVER (PARTITION BY scheme_id, report_month), 0), 9) <= 2 THEN pct_nav * 100 ELSE pct_nav END', 4)} AS pct_nav FROM v_file_lines""")
def _(d):
    return C.rounded(N.loader_nav_rescale(lines_of(d), ["scheme_id", "report_month"]).select("scheme_id", "isin", "report_month", "line_no", "pct_nav"), 4)


@query("combine_lots", f"""
WITH l AS (SELECT *, coalesce(quantity > 0, false) OR (quantity IS NULL AND (coalesce(market_value_lakhs <> 0, false) OR coalesce(pct_nav <> 0, false))) AS held,
   quantity IS NOT NULL OR market_value_lakhs IS NOT NULL OR pct_nav IS NOT NULL AS valued FROM v_file_lines),
 h AS (SELECT scheme_id, isin, report_month, count(*) AS n, CASE WHEN count(*) = count(quantity) THEN sum(quantity) END AS q,
   CASE WHEN count(*) = count(market_value_lakhs) THEN sum(market_value_lakhs) END AS v, CASE WHEN count(*) = count(pct_nav) THEN sum(pct_nav) END AS p FROM l WHERE held GROUP BY ALL),
 s AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY scheme_id, isin, report_month ORDER BY valued DESC, line_no DESC) = 1)
SELECT s.scheme_id, s.isin, s.report_month, CASE WHEN h.n > 0 THEN q ELSE s.quantity END AS quantity,
  {r('CASE WHEN h.n > 0 THEN v ELSE s.market_value_lakhs END', 3)} AS market_value_lakhs, {r('CASE WHEN h.n > 0 THEN p ELSE s.pct_nav END', 5)} AS pct_nav
FROM s LEFT JOIN h USING (scheme_id, isin, report_month)""")
def _(d):
    return C.rounded(N.combine_lots(lines_of(d), ["scheme_id", "isin", "report_month"], "line_no")
                     .select("scheme_id", "isin", "report_month", "quantity", "market_value_lakhs", "pct_nav"), 5, market_value_lakhs=3)


@query("scheme_titles", "SELECT amc_name, report_month, sheet, scheme_title FROM v_sheets")
def _(d):
    return N.scheme_titles(d.raw_rows, headers_of(d))


@query("months_named", "SELECT amc_name, report_month, sheet, report_month AS named_month FROM v_sheets WHERE report_month >= '2000'")
def _(d):
    return N.months_named(d.raw_rows)


# A stacked workbook per (house, month): every sheet becomes a marked section; some markers are faulty.
def stacked_of(d):
    code = F.regexp_replace("sheet", "[^0-9]", "")
    base = d.raw_rows.join(d.schemes.select(F.col("scheme_name").alias("sheet"), "scheme_id"), "sheet").withColumn("code", code)
    mark = lambda text, at: F.struct(at.alias("o"), F.array(text).alias("c"))
    first = F.col("row_number") == 1
    start = F.concat(F.lit("SCHEME CODE"), "code", F.lit("STARTS"))
    end = F.concat(F.lit("SCHEME CODE"), "code", F.when(F.col("scheme_id") % 13 == 0, "9ENDS").otherwise("ENDS"))
    title = F.concat(F.lit("SCHEME: "), "sheet")
    at = F.col("scheme_id") * 1000 + F.col("row_number") + 10
    rows = base.select("amc_name", "report_month", "code", F.explode(F.when(first, F.array(
        mark(start, F.col("scheme_id") * 1000), mark(title, F.col("scheme_id") * 1000 + 1), F.struct(at.alias("o"), F.col("cells").alias("c")),
        mark(end, F.col("scheme_id") * 1000 + 999))).otherwise(F.array(F.struct(at.alias("o"), F.col("cells").alias("c"))))).alias("e"))
    return rows.select("amc_name", "report_month", F.col("e.o").alias("row_number"), F.col("e.c").alias("cells"))


@query("stacked_sections", """
SELECT amc_name, report_month, sheet AS title, count(*) + 1 AS n_rows FROM (SELECT amc_name, report_month, sheet, scheme_id, n + 3 + 2 + CASE WHEN scheme_id % 5 <> 4 THEN 1 ELSE 0 END + CASE WHEN scheme_id % 5 = 0 THEN 1 ELSE 0 END AS k FROM v_sheet_totals), range(100) t(i)
WHERE scheme_id % 13 <> 0 AND i < k GROUP BY ALL""")
def _(d):
    good, _bad = N.stacked_sections(stacked_of(d), ["amc_name", "report_month"])
    return good.groupBy("amc_name", "report_month", "title").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stacked_sections_refused", """
SELECT amc_name, report_month, 'unmatched_end' AS error, count(*) AS n FROM v_sheet_totals WHERE scheme_id % 13 = 0 GROUP BY ALL""")
def _(d):
    _good, bad = N.stacked_sections(stacked_of(d), ["amc_name", "report_month"])
    return bad.groupBy("amc_name", "report_month", "error").agg(F.count(F.lit(1)).alias("n"))


# The layout with section headings in the first columns: holdings of every third security class sit below a futures heading.
def headed_of(d):
    kind = F.substring("isin", 6, 1).cast("int") % 3
    heading = F.when(kind == 0, "Equity").when(kind == 1, "Futures").otherwise("Debt")
    rows = d.holdings.withColumn("s", heading).withColumn("k", kind * 1000)
    body = rows.select("scheme_id", "report_month", (F.col("k") + 1 + F.row_number().over(_w())).alias("row_number"),
                       F.array(F.lit(""), F.lit(None).cast("string"), F.col("isin"), F.col("isin"), F.lit("Industry")).alias("cells"))
    heads = rows.select("scheme_id", "report_month", F.col("k").alias("row_number"), F.array(F.col("s"), F.lit(""), F.lit(""), F.lit(""), F.lit("")).alias("cells")).distinct()
    total = rows.select("scheme_id", "report_month").distinct().select(
        "scheme_id", "report_month", F.lit(1999).alias("row_number"), F.array(F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit("Grand Total")).alias("cells"))
    return body.unionByName(heads).unionByName(total)


def _w():
    from pyspark.sql import Window as W
    return W.partitionBy("scheme_id", "report_month", "k").orderBy("isin")


@query("derivative_section_filter", """
SELECT scheme_id, report_month, count(*) + count(DISTINCT CASE WHEN substr(isin, 6, 1)::INT % 3 <> 1 THEN substr(isin, 6, 1)::INT % 3 END)
  - count(*) FILTER (WHERE substr(isin, 6, 1)::INT % 3 = 1) + 1 AS kept FROM v_holdings GROUP BY ALL""")
def _(d):
    kept = N.derivative_section_filter(headed_of(d), ["scheme_id", "report_month"])
    return kept.groupBy("scheme_id", "report_month").agg(F.count(F.lit(1)).alias("kept"))


# Deliveries: the folders of house and month with their workbooks. Some schemes come twice or under a neighbour's title, some folders
# have a name of their own, and some workbooks are dated wrong, unreadable, without a scheme or notes from an archive.
def deliveries_of(d):
    """(folders, files, sheets, named) of every house and month."""
    rows = (d.scheme_months.join(d.schemes, "scheme_id")
            .select("scheme_id", "house_no", "report_month", F.substring("report_month", 6, 2).alias("mm"),
                    F.when(F.col("scheme_id") % 23 == 0, F.concat("amc_name", F.lit("X"))).otherwise(F.col("amc_name")).alias("amc_name"), F.col("scheme_name").alias("sheet"),
                    F.when(F.col("scheme_id") % 19 == 0, "Nation-0 Flexi Fund").otherwise(F.translate("scheme_title", "_", " ")).alias("scheme_title")))
    mm, house = F.col("mm"), F.col("house_no")
    empty = ((mm == "11") & (house % 5 == 3)) | ((mm == "12") & (house % 7 == 4))
    folders = rows.select("amc_name", "report_month", "house_no", "mm", empty.alias("_empty")).distinct()
    places = F.when(F.col("scheme_id") % 17 == 0, F.array(F.lit("a.xlsx"), F.lit("b.xlsx"))).otherwise(F.array(F.lit("a.xlsx")))
    sheets = rows.filter(~empty).select("amc_name", "report_month", F.explode(places).alias("file"), "sheet", "scheme_title", F.lit(3).alias("n_rows"))
    book = lambda name, archived, error: F.struct(F.lit(name).alias("file"), F.lit(archived).alias("archived"), F.lit(error).cast("string").alias("error"))
    more = F.array_compact(F.array(
        F.when((mm == "04") | (mm == "12") & (house % 7 == 4), book("notes.xlsx", True, None)), F.when((mm == "05") & (house % 4 == 1), book("index.xlsx", False, None)),
        F.when((mm == "06") & (house % 6 == 2), book("broken.xlsx", False, "BadZipFile"))))
    added = folders.select("amc_name", "report_month", F.explode(more).alias("b")).select("amc_name", "report_month", "b.*")
    loose = folders.filter(F.col("house_no") == 1).select(F.lit(None).cast("string").alias("amc_name"), "report_month", F.lit("readme.txt").alias("file"),
                                                          F.lit(False).alias("archived"), F.lit(None).cast("string").alias("error")).distinct()
    files = (sheets.select("amc_name", "report_month", "file").distinct().withColumn("archived", F.lit(False)).withColumn("error", F.lit(None).cast("string"))
             .unionByName(added).unionByName(loose))
    dated = F.when(F.substring("report_month", 6, 2) == "07", C.prev_month("report_month")).otherwise(F.col("report_month"))
    named = sheets.filter("file = 'a.xlsx'").select("amc_name", "report_month", "file").distinct().withColumn("named_month", dated)
    return folders.select("amc_name", "report_month"), files, sheets, named


def registry_of(d):
    """The nations in order; houses 6 and 13 deliver archives of which only the workbooks named a* hold portfolios."""
    rule = F.when(F.col("n_nationkey").isin(6, 13), "^a")
    return d.raw("nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("amc_name"),
                                  F.array(F.translate(F.lower("n_name"), "_", " "), F.lit("nation first")).alias("brands"), rule.alias("holdings_file"))


cte("v_delivered", """
SELECT scheme_id, house_no AS h, report_month, substr(report_month, 6, 2) AS mm, CASE WHEN scheme_id % 23 = 0 THEN amc_name || 'X' ELSE amc_name END AS amc_name, scheme_id % 23 = 0 AS strange,
  scheme_name AS sheet, scheme_key, CASE WHEN scheme_id % 19 = 0 THEN 0 ELSE house_no END AS brand, (substr(report_month, 6, 2) = '11' AND house_no % 5 = 3) OR (substr(report_month, 6, 2) = '12' AND house_no % 7 = 4) AS empty
FROM v_months JOIN v_scheme USING (scheme_id)""")
cte("v_taken", """
SELECT amc_name, report_month, sheet, scheme_key, mm, f AS file, h, scheme_id FROM (SELECT *, unnest(CASE WHEN scheme_id % 17 = 0 THEN ['a.xlsx', 'b.xlsx'] ELSE ['a.xlsx'] END) AS f FROM v_delivered
 WHERE NOT strange AND NOT empty) WHERE NOT (f = 'a.xlsx' AND mm = '07') AND NOT (f = 'b.xlsx' AND h IN (6, 13))""")
cte("v_intake", """
WITH hm AS (SELECT DISTINCT amc_name, report_month, h, mm, strange, empty FROM v_delivered),
 two AS (SELECT amc_name, report_month, 'scheme_in_two_files' AS problem, 'a.xlsx [' || sheet || '] and b.xlsx [' || sheet || ']' AS detail FROM v_taken GROUP BY amc_name, report_month, sheet HAVING count(*) > 1)
SELECT * FROM two
UNION ALL SELECT DISTINCT amc_name, report_month, 'belongs_to_another_house', sheet || ': NATION_0' FROM v_taken WHERE h <> 0 AND scheme_id % 19 = 0
UNION ALL SELECT amc_name, report_month, 'unknown_house', NULL FROM hm WHERE strange
UNION ALL SELECT DISTINCT amc_name, report_month, 'dated_another_month', 'a.xlsx: ' || substr(report_month, 1, 5) || '06' FROM hm WHERE NOT strange AND NOT empty AND mm = '07'
UNION ALL SELECT amc_name, report_month, 'no_workbook', NULL FROM hm WHERE NOT strange AND empty AND mm = '11'
UNION ALL SELECT amc_name, report_month, 'no_portfolio', NULL FROM hm WHERE NOT strange AND empty AND mm = '12' AND h NOT IN (6, 13)
UNION ALL SELECT amc_name, report_month, 'no_scheme_sheets', 'index.xlsx' FROM hm WHERE NOT strange AND mm = '05' AND h % 4 = 1 AND h NOT IN (6, 13)
UNION ALL SELECT amc_name, report_month, 'unreadable_workbook', 'broken.xlsx: BadZipFile' FROM hm WHERE NOT strange AND mm = '06' AND h % 6 = 2 AND h NOT IN (6, 13)
UNION ALL SELECT DISTINCT NULL, report_month, 'file_outside_a_folder', 'readme.txt' FROM hm WHERE h = 1""")


def intake_of(d):
    made = []

    def part(i):
        made[:] = made or K.intake(*deliveries_of(d), registry_of(d))
        return made[i]
    return d.derived("intake_problems", lambda: part(0)), d.derived("intake_verdicts", lambda: part(1))


@query("intake_checks", "SELECT * FROM v_intake")
def _(d):
    return intake_of(d)[0]


@query("intake_verdicts", """
WITH hm AS (SELECT DISTINCT amc_name, report_month, h, mm, strange, empty FROM v_delivered),
 t AS (SELECT amc_name, report_month, count(DISTINCT sheet) AS n_schemes, 3 * count(*) AS n_rows FROM v_taken GROUP BY ALL),
 f AS (SELECT amc_name, report_month, count(DISTINCT CASE WHEN h NOT IN (6, 13) OR f = 'a.xlsx' THEN f END) AS n FROM (SELECT *, unnest(CASE WHEN scheme_id % 17 = 0 THEN ['a.xlsx', 'b.xlsx'] ELSE ['a.xlsx'] END) AS f
   FROM v_delivered WHERE NOT strange AND NOT empty) GROUP BY ALL),
 p AS (SELECT amc_name, report_month, string_agg(problem, ',' ORDER BY problem, detail) AS problems FROM v_intake GROUP BY ALL)
SELECT amc_name, report_month, CASE WHEN strange THEN 'unknown' WHEN problems IS NOT NULL THEN 'refused' ELSE 'ok' END AS status,
  CASE WHEN strange THEN 0 ELSE coalesce(f.n, 0) + CASE WHEN h NOT IN (6, 13) AND (mm = '05' AND h % 4 = 1 OR mm = '06' AND h % 6 = 2) THEN 1 ELSE 0 END END AS n_files,
  CASE WHEN NOT strange AND h NOT IN (6, 13) AND (mm = '04' OR mm = '12' AND h % 7 = 4) THEN 1 ELSE 0 END AS n_skipped, coalesce(n_schemes, 0) AS n_schemes, coalesce(n_rows, 0) AS n_rows, coalesce(problems, '') AS problems
FROM hm LEFT JOIN t USING (amc_name, report_month) LEFT JOIN f USING (amc_name, report_month) LEFT JOIN p USING (amc_name, report_month)
UNION ALL SELECT n_name, x.report_month, 'missing', 0, 0, 0, 0, '' FROM nation, (SELECT DISTINCT report_month FROM v_months) x
WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.amc_name = n_name AND hm.report_month = x.report_month)""")
def _(d):
    return intake_of(d)[1].withColumn("problems", F.array_join(F.transform("problems", lambda p: p["problem"]), ","))


@query("missing_houses", """
SELECT n_name AS amc_name, x.report_month FROM nation, (SELECT DISTINCT report_month FROM v_months) x
WHERE NOT EXISTS (SELECT 1 FROM v_delivered v WHERE v.amc_name = n_name AND v.report_month = x.report_month)""")
def _(d):
    return intake_of(d)[1].filter("status = 'missing'").select("amc_name", "report_month")


@query("brand_owners", """
SELECT scheme_id, CASE WHEN scheme_id % 3 = 0 THEN 'NATION_0' WHEN scheme_id % 3 = 1 THEN amc_name END AS owner FROM v_scheme WHERE scheme_id % 3 < 2""")
def _(d):
    """Titles of a third of the schemes begin with a word that several brands share, a third with the house's own, the others with no brand."""
    text = (F.when(F.col("scheme_id") % 3 == 0, F.concat(F.lit("Shared "), "amc_name", F.lit(" Fund"))).when(F.col("scheme_id") % 3 == 1, F.concat(F.translate("amc_name", "_", "-"), F.lit("  Fund")))
            .otherwise(F.concat(F.lit("Sharedly "), "amc_name")))
    registry = registry_of(d).withColumn("brands", F.array(F.element_at("brands", 1), F.lit("shared"), F.lit("no such brand")))
    return K.brand_owners(d.schemes.withColumn("scheme_title", text), registry, ["scheme_id"])


# -- ownership filings --------------------------------------------------------------------------------

def documents_of(d):
    """Each filing as an ownership document; every third states fractions, some have no promoter line or an odd total."""
    n = F.dayofyear("quarter_end") + F.substring("isin", 4, 3).cast("int")
    k = F.when(n % 3 == 0, 0.01).otherwise(1.0)

    def element(context, value):
        text = F.format_string("%.10f", value)
        return F.concat(F.lit(f'<in:{B.PERCENT_ELEMENT} contextRef="{context}">'), text, F.lit(f"</in:{B.PERCENT_ELEMENT}>"))
    body = F.concat(
        F.when(n % 7 != 0, element("ShareholdingOfPromoterAndPromoterGroup_ContextI", F.col("promoter_pct") * k)).otherwise(""),
        element("PublicShareholding_ContextI", (100 - F.when(n % 7 != 0, F.col("promoter_pct")).otherwise(0.0)) * k),
        element("ShareholdingPattern_ContextI", F.when(n % 11 == 0, F.lit(50.0)).otherwise(100 * k)),
        element("MutualFundsOrUTI_ContextI", F.col("dii_pct") * k / 2), element("Banks_ContextI", F.col("dii_pct") * k / 4),
        element("InstitutionsForeignPortfolioInvestorCategoryOne_ContextI", F.col("fii_pct") * k / 2),
        element("InstitutionsForeignPortfolioInvestorCategoryTwo_ContextI", F.col("fii_pct") * k / 4),
        element("InstitutionsForeignPortfolioInvestor_ContextI", F.col("fii_pct") * k),
        F.when(n % 13 == 0, element("Banks_ContextI", F.lit(0.5))).otherwise(""), element("MutualFundsOrUTI_Context15", F.lit(99.0)))
    whole = F.concat(F.lit('\ufeff\n<xbrl xmlns:in="urn:in">'), body, F.lit("</xbrl>"))
    xml = (F.when(n % 17 == 3, F.substring_index(whole, "</xbrl>", 1)).when(n % 17 == 5, '<xbrl xmlns:in="urn:in"><in:Name>x</in:Name></xbrl>')
           .when(n % 17 == 7, F.lit(None).cast("string")).when(n % 17 == 9, F.concat(F.lit('<xbrl xmlns:in="urn:in">'), element("Banks_Context2", F.lit(1.0)), F.lit("</xbrl>"))).otherwise(whole))
    return d.filings.select("isin", "quarter_end", xml.alias("xml"))


def context_values_of(d):
    keys = ["isin", "quarter_end"]
    return B.context_values(B.xbrl_facts(documents_of(d), keys), keys)


cte("v_doc", """
SELECT isin, quarter_end, dayofyear(quarter_end) + substr(isin, 4, 3)::INT AS n, promoter_pct, fii_pct, dii_pct FROM v_filings""")


XBRL_REASON = "CASE n % 17 WHEN 3 THEN 'not_well_formed' WHEN 5 THEN 'no_percentages' WHEN 7 THEN 'no_document' END"


@query("xbrl_facts", f"""
SELECT isin, quarter_end, CASE WHEN n % 17 IN (3, 5, 7, 9) THEN 0 ELSE 7 + CASE WHEN n % 7 <> 0 THEN 1 ELSE 0 END END AS names, CASE WHEN n % 13 = 0 AND n % 17 NOT IN (3, 5, 7, 9) THEN 1 ELSE 0 END AS conflicts,
  {XBRL_REASON} AS reason FROM v_doc""")
def _(d):
    named = F.col("name").isNotNull()
    return context_values_of(d).groupBy("isin", "quarter_end").agg(F.count("name").alias("names"), F.count(F.when(named, F.col("error"))).alias("conflicts"),
                                                                   F.max(F.when(~named, F.col("error"))).alias("reason"))


def _printed(x):
    """A percentage as the document prints it, with ten decimals, every third one as a fraction of one; then at four."""
    return f"(CASE WHEN n % 3 = 0 THEN round({half_up(x, 8)}::DECIMAL(38,8), 4) ELSE round({half_up(x, 10)}::DECIMAL(38,10), 4) END)::DOUBLE"


_XBRL_ERROR = f"coalesce({XBRL_REASON}, CASE WHEN n % 17 = 9 THEN 'no_aggregate_rows' WHEN n % 13 = 0 THEN 'conflicting_percentages' WHEN n % 11 = 0 THEN 'unreadable_total' END)"
_XBRL_PARTS = {"promoter_pct": "CASE WHEN n % 7 <> 0 THEN promoter_pct ELSE 0 END", "fii_pct": "fii_pct * 0.75", "dii_pct": "dii_pct * 0.75",
               "public_pct": "100 - CASE WHEN n % 7 <> 0 THEN promoter_pct ELSE 0 END", "mf_pct": "dii_pct * 0.5"}


@query("xbrl_resolve", f"""
SELECT isin, quarter_end, {_XBRL_ERROR} AS error, {', '.join(f"CASE WHEN {_XBRL_ERROR} IS NULL THEN floor({_printed(x)} * 1e4 + 0.3217) / 1e4 END AS {c}" for c, x in _XBRL_PARTS.items())} FROM v_doc""")
def _(d):
    return C.rounded(B.xbrl_resolve(context_values_of(d), ["isin", "quarter_end"]), 4)


TABLE_LABELS = (("Total Shareholding of Promoter and Promoter Group (A)", "promoter_pct", 1.0), ("(B)=(B)(1)+(B)(2)", "public_pct", 1.0),
                ("Mutual Funds", "dii_pct", 0.5), ("Banks", "dii_pct", 0.25), ("Insurance Companies", "dii_pct", 0.25),
                ("Foreign Portfolio Investors Category I", "fii_pct", 0.5), ("Foreign Portfolio Investors (Category II)", "fii_pct", 0.25),
                ("Foreign Portfolio Investors", "fii_pct", 1.0), ("Mutual  Funds", "dii_pct", 0.1))


@query("table_resolve", f"""
SELECT isin, quarter_end, CASE WHEN month(quarter_end) = 3 THEN 'no_aggregate_rows' END AS error, {', '.join(f"CASE WHEN month(quarter_end) <> 3 THEN {r(f'round({x}, 4)', 4)} END AS {c}" for c, x in (
  ("promoter_pct", "promoter_pct"), ("fii_pct", "fii_pct * 0.75"), ("dii_pct", "dii_pct"), ("public_pct", "public_pct"), ("mf_pct", "dii_pct * 0.5")))} FROM v_filings""")
def _(d):
    keys = ["isin", "quarter_end"]
    entries = F.array(*[F.struct(F.lit(i).alias("row_no"), F.lit(label).alias("label"), (F.col(c) * k).alias("v")) for i, (label, c, k) in enumerate(TABLE_LABELS)])
    rows = d.filings.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    # Filings of March lack the promoters' row.
    rows = rows.filter((F.col("row_no") > 0) | (F.month("quarter_end") != 3))
    tag = F.array(F.struct(F.lit("in-bse-shp:ShareholdingAsAPercentageOfTotalNumberOfShares").alias("tag"), F.format_string("%.10f", "v").alias("text")),
                  F.struct(F.lit("in-bse-shp:ShareholdingAsAPercentageAssumingFullConversion").alias("tag"), F.lit("1.0").alias("text")))
    tags = rows.select(*keys, "row_no", F.explode(tag).alias("t")).select(*keys, "row_no", "t.*")
    return C.rounded(B.table_resolve(rows.select(*keys, "row_no", "label"), B.row_percentages(tags, keys), keys), 4)


@query("filing_index_earliest", """
SELECT isin AS company, quarter_end, CASE WHEN strftime(quarter_end, '%m-%d') IN ('03-31', '06-30', '09-30', '12-31') THEN 'quarterly' ELSE 'interim' END AS filing_type,
  strftime(quarter_end + 5, '%Y-%m-%d') || 'T09:30' AS published_at FROM v_filings QUALIFY row_number() OVER (PARTITION BY isin ORDER BY quarter_end DESC) <= 4""")
def _(d):
    sent = F.array(*[F.concat(F.date_format(F.date_add("quarter_end", days), "dd-MMM-yyyy"), F.lit(" 09:30:00")) for days in (12, 5, 40)])
    index = d.filings.select(F.col("isin").alias("company"), F.date_format("quarter_end", "dd-MMM-yyyy").alias("date"), F.explode(sent).alias("broadcast"),
                             F.lit("https://example.com/x.xml").alias("url"))
    return B.earliest_broadcasts(index, 4).drop("url")


@query("filing_index_first", """
SELECT isin AS company, quarter_end, 'https://www.bseindia.com/XBRL/2.xml' AS url FROM v_filings QUALIFY row_number() OVER (PARTITION BY isin ORDER BY quarter_end DESC) <= 2""")
def _(d):
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(a).alias("attachment"), F.lit(x).alias("is_xbrl"))
                     for i, (a, x) in enumerate((("/XBRL/", True), ("/XBRL/1.xml", False), ("/XBRL/2.xml", True), ("/XBRL/3.xml", True)))])
    index = d.filings.select(F.col("isin").alias("company"), F.col("quarter_end").cast("string").alias("end_date"), "published_at", F.explode(rows).alias("r"))
    return B.usable_attachments(index.select("company", "end_date", "published_at", "r.*"), 2).select("company", "quarter_end", "url")


@query("filing_backlog", """
SELECT DISTINCT isin FROM v_holdings h WHERE isin NOT IN (SELECT isin FROM v_filings GROUP BY 1 HAVING count(*) >= 20 AND count(*) = count(mf_pct) AND count(*) = count(published_at))""")
def _(d):
    return B.filing_backlog(d.holdings.select("isin"), d.filings, 20)


# -- scheme identity --------------------------------------------------------------------------------------

def aliases_of(d):
    _keyed, own = I.backfill_identity(d.schemes)
    old = d.schemes.filter(F.col("scheme_id") % 7 == 2).select(
        "scheme_id", F.concat(F.lit("Old "), "scheme_name").alias("alias"), I.normalize_scheme_name(F.concat(F.lit("Old "), "scheme_name")).alias("alias_normalized"), F.lit("operator").alias("source"))
    return own.unionByName(old)


def known_aliases_of(d):
    """Some schemes lack their own name as an alias, others share one alias."""
    twins = d.schemes.filter(F.col("scheme_id") % 7 == 5).select("scheme_id", F.lit("Twin Fund").alias("alias"), I.normalize_scheme_name(F.lit("Twin Fund")).alias("alias_normalized"), F.lit("operator").alias("source"))
    return aliases_of(d).filter((F.col("source") != "self") | (F.col("scheme_id") % 5 != 1)).unionByName(twins)


def raw_names_of(d):
    v = F.col("scheme_id") % 7
    name = (F.when(v == 2, F.concat(F.lit("OLD "), "scheme_name")).when(v == 3, F.concat(F.lit("New "), "scheme_name")).when(v == 5, "TWIN fund")
            .when(F.col("scheme_id") % 2 == 0, F.upper(F.translate("scheme_name", "#", "-"))).otherwise(F.col("scheme_name")))
    return d.scheme_months.join(d.schemes, "scheme_id").select("amc_name", name.alias("raw_name"))


@query("resolve_scheme_id", """
SELECT amc_name, raw_name, matched_by, CASE WHEN matched_by = 'new' THEN (SELECT max(scheme_id) FROM v_scheme) + row_number() OVER (PARTITION BY matched_by ORDER BY amc_name, 'new ' || scheme_key) ELSE scheme_id END AS scheme_id
FROM (SELECT *, CASE WHEN scheme_id % 7 = 2 THEN 'OLD ' || scheme_name WHEN scheme_id % 7 = 3 THEN 'New ' || scheme_name WHEN scheme_id % 2 = 0 THEN upper(replace(scheme_name, '#', '-')) ELSE scheme_name END AS raw_name,
  CASE WHEN scheme_id % 7 = 2 THEN 'alias' WHEN scheme_id % 7 = 3 THEN 'new' WHEN scheme_id % 2 = 0 THEN CASE WHEN scheme_id % 5 = 1 THEN 'key' ELSE 'alias' END ELSE 'exact' END AS matched_by
  FROM v_scheme WHERE scheme_id % 7 <> 5 AND scheme_id IN (SELECT scheme_id FROM v_months))
UNION ALL SELECT amc_name, 'TWIN fund', CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'alias' END, CASE WHEN count(*) = 1 THEN min(scheme_id) END
FROM v_scheme WHERE scheme_id % 7 = 5 GROUP BY amc_name HAVING bool_or(scheme_id IN (SELECT scheme_id FROM v_months))""")
def _(d):
    return I.resolve_schemes(raw_names_of(d), d.schemes, known_aliases_of(d))


@query("backfill_identity", "SELECT scheme_id, scheme_name AS alias, scheme_key AS alias_normalized, 'self' AS source FROM v_scheme")
def _(d):
    return I.backfill_identity(d.schemes)[1]


@query("alias_clashes", """
SELECT s.scheme_id, o.scheme_name AS alias, CASE WHEN o.scheme_id <> s.scheme_id THEN 'resolves_to_another_scheme' END AS refused FROM v_scheme s
JOIN (SELECT amc_name, min(scheme_id) AS scheme_id, min_by(scheme_name, scheme_id) AS scheme_name FROM v_scheme GROUP BY 1) o ON o.amc_name = s.amc_name""")
def _(d):
    first = d.schemes.groupBy("amc_name").agg(F.min_by("scheme_name", "scheme_id").alias("alias"))
    proposed = d.schemes.select("scheme_id", "amc_name").join(first, "amc_name").select("scheme_id", "alias")
    return I.alias_clashes(proposed, d.schemes, aliases_of(d)).select("scheme_id", "alias", "refused")


@query("list_schemes", """
SELECT scheme_id, CASE WHEN scheme_id % 7 = 2 THEN 'Old ' || scheme_name ELSE '' END AS aliases, coalesce(m, '') AS months FROM v_scheme
LEFT JOIN (SELECT scheme_id, string_agg(report_month, ',' ORDER BY report_month) AS m FROM v_months GROUP BY 1) USING (scheme_id)""")
def _(d):
    return I.list_schemes(d.schemes, aliases_of(d), d.scheme_months).select("scheme_id", F.concat_ws(",", "aliases").alias("aliases"), F.concat_ws(",", "months").alias("months"))


def merges_of(d):
    """Every scheme proposed into the next id, and the first into itself: all of them to be refused."""
    one = d.schemes.agg(F.min("scheme_id").alias("source_id")).withColumn("target_id", F.col("source_id"))
    return d.schemes.select(F.col("scheme_id").alias("source_id"), (F.col("scheme_id") + 1).alias("target_id")).unionAll(one)


def keyed_tables(holdings, status):
    return {"mf_holdings_monthly": (holdings, ["isin", "report_month"]), "scheme_month_status": (status, ["report_month"])}


def _both_sides(table, source, keys):
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys.split())
    return f"SELECT source_id, target_id, 'same_key_on_both', '{table}', count(*) FROM m JOIN {source} a ON a.scheme_id = source_id JOIN {source} b ON b.scheme_id = target_id AND {same} WHERE source_id <> target_id GROUP BY ALL"


@query("merge_conflicts", f"""
WITH m AS (SELECT scheme_id AS source_id, scheme_id + 1 AS target_id FROM v_scheme UNION ALL SELECT min(scheme_id), min(scheme_id) FROM v_scheme),
 u AS (SELECT s, sum(a) AS sources, count(*) AS uses FROM (SELECT source_id AS s, 1 AS a FROM m UNION ALL SELECT target_id, 0 FROM m) GROUP BY s)
SELECT * FROM (SELECT source_id, target_id, CASE WHEN source_id = target_id THEN 'same_scheme' WHEN b.scheme_id IS NULL THEN 'unknown_scheme'
   WHEN a.amc_name <> b.amc_name THEN 'different_house' WHEN sources > 1 OR uses > sources THEN 'named_again' END AS reason, NULL::VARCHAR AS table_name, 1::BIGINT AS rows
 FROM m JOIN v_scheme a ON a.scheme_id = source_id LEFT JOIN v_scheme b ON b.scheme_id = target_id JOIN u ON s = source_id) WHERE reason IS NOT NULL
UNION ALL {_both_sides("mf_holdings_monthly", "v_holdings", "isin report_month")} UNION ALL {_both_sides("scheme_month_status", "v_status", "report_month")}""")
def _(d):
    return I.merge_problems(merges_of(d), d.schemes, keyed_tables(d.holdings, d.status))


@query("merge_schemes", """
SELECT 'mf_holdings_monthly' AS part, scheme_id, report_month, isin AS name FROM v_holdings UNION ALL SELECT 'scheme_month_status', scheme_id, report_month, status FROM v_status
UNION ALL SELECT 'schemes', scheme_id, NULL, scheme_name FROM v_scheme UNION ALL SELECT 'aliases', scheme_id, source, alias FROM (
 SELECT scheme_id, 'self' AS source, scheme_name AS alias FROM v_scheme UNION ALL SELECT scheme_id, 'operator', 'Old ' || scheme_name FROM v_scheme WHERE scheme_id % 7 = 2
 UNION ALL SELECT scheme_id, 'merge', 'Drifted ' || scheme_name FROM v_scheme WHERE scheme_id % 10 = 9)
UNION ALL SELECT 'refused', NULL, NULL, NULL""")
def _(d):
    """A tenth of the schemes had drifted to a second id from 1996 on and is merged back; a batch with problems is refused whole."""
    away = F.when((F.col("scheme_id") % 10 == 9) & (F.col("report_month") >= "1996-01"), F.col("scheme_id") + 1_000_000).otherwise(F.col("scheme_id"))
    second = d.schemes.filter(F.col("scheme_id") % 10 == 9).withColumn("scheme_id", F.col("scheme_id") + 1_000_000) \
        .withColumn("scheme_name", F.concat(F.lit("Drifted "), "scheme_name"))
    merges = second.select(F.col("scheme_id").alias("source_id"), (F.col("scheme_id") - 1_000_000).alias("target_id"))
    drifted = keyed_tables(d.holdings.withColumn("scheme_id", away), d.status.withColumn("scheme_id", away))
    schemes, aliases, tables = I.merge_all(merges, d.schemes.unionByName(second), aliases_of(d), drifted)
    text = F.lit(None).cast("string")
    out = (tables["mf_holdings_monthly"].select(F.lit("mf_holdings_monthly").alias("part"), "scheme_id", "report_month", F.col("isin").alias("name"))
           .unionAll(tables["scheme_month_status"].select(F.lit("scheme_month_status"), "scheme_id", "report_month", "status"))
           .unionAll(schemes.select(F.lit("schemes"), "scheme_id", text, "scheme_name"))
           .unionAll(aliases.select(F.lit("aliases"), "scheme_id", "source", "alias")))
    try:
        I.merge_all(merges_of(d), d.schemes, aliases_of(d), keyed_tables(d.holdings, d.status))
    except T.RefusedInput:
        refused = d.schemes.agg(F.lit("refused"), F.lit(None).cast("bigint"), text, text)
        out = out.unionAll(refused)
    return out


@query("title_changes", """
SELECT scheme_id, scheme_title AS title, 1 AS old_flag, is_active_equity AS new_flag FROM v_scheme WHERE is_active_equity = 0""")
def _(d):
    by_name = d.schemes.withColumn("is_active_equity", I.classify_scheme("scheme_name", F.lit(None).cast("string")))
    return I.title_changes(by_name, d.schemes.select("scheme_id", F.concat(F.lit("  "), "scheme_title").alias("title")))


@query("backfill_active_flag", "SELECT scheme_id, is_active_equity, is_active_equity = 0 AS newly_excluded FROM v_scheme")
def _(d):
    return I.backfill_active_flag(d.schemes.withColumn("is_active_equity", F.lit(None).cast("int"))).select("scheme_id", "is_active_equity", "newly_excluded")


# -- keyed table updates --------------------------------------------------------------------------------------

def folder_of(d, name):
    return f"{required_folder(d.spark)}/folioflux/files/{uuid.uuid4().hex}/{name}"


@query("read_parsed_holdings", f"""
SELECT scheme_name, amc_name, report_month, isin, quantity, {r('market_value_lakhs', 3)} AS market_value_lakhs, {r('pct_nav', 5)} AS pct_nav,
  CASE WHEN scheme_id % 2 = 0 THEN 'Sector, "' || (scheme_id % 5) || '"' END AS industry FROM v_holdings JOIN v_scheme USING (scheme_id)""")
def _(d):
    """Files in a folder with spaces in its name: half of the schemes with an extra column and their columns the other way round, half with a byte order mark."""
    named = (d.holdings.join(d.schemes.select("scheme_id", "amc_name", "scheme_name"), "scheme_id").withColumn("instrument_name", F.col("isin"))
             .withColumn("industry", F.concat(F.lit('Sector, "'), F.col("scheme_id") % 5, F.lit('"'))))
    path = folder_of(d, "HDFC AMC files")
    more = [*reversed(T.PARSED_REQUIRED), "industry", "checked by"]
    named.filter("scheme_id % 2 = 0").withColumn("checked by", F.lit("x")).select(*more).write.option("header", True).option("escape", '"').csv(f"{path}/with sector")
    named.filter("scheme_id % 2 = 1").select(F.col(T.PARSED_REQUIRED[0]).alias("\ufeff" + T.PARSED_REQUIRED[0]), *T.PARSED_REQUIRED[1:]).write.option("header", True).csv(f"{path}/bom")
    rows = T.read_parsed_holdings(d.spark, [f"{path}/with sector", f"{path}/bom"])
    return C.rounded(rows.select("scheme_name", "amc_name", "report_month", "isin", "quantity", "market_value_lakhs", "pct_nav", "industry"), 5, market_value_lakhs=3)


def bhavcopy_of(d, layout):
    """Exchange rows in one layout: two series per security and day, one unlisted series, one unusable close."""
    isin, symbol, series, close, volume, value = layout.values()
    rows = F.array(*[F.struct(F.lit(s).alias(series), (F.col("close_price") * k).cast("string").alias(close), (F.col("traded_value") * v).cast("string").alias(volume))
                     for s, k, v in (("EQ", 1.0, 1.0), ("BE", 1.1, 0.1), ("GB", 1.2, 9.0), (" BZ ", 0.0, 5.0))])
    return d.prices_daily.select("trade_date", F.concat(F.lit(" "), F.lower("isin")).alias(isin), F.lit("SYM").alias(symbol), F.explode(rows).alias("r"),
                                 F.when(F.dayofmonth("trade_date") % 2 == 0, "-1").otherwise(F.col("traded_value").cast("string")).alias(value)).select("trade_date", isin, symbol, "r.*", value)


BHAV_SQL = f"""SELECT trade_date, isin, {r('close_price', 5)} AS close_price, CASE WHEN day(trade_date) % 2 <> 0 THEN {r('traded_value', 2)} END AS traded_value, 'EQ' AS series FROM v_prices_daily"""


@query("bhavcopy_current_layout", BHAV_SQL)
def _(d):
    return C.rounded(T.normalize_closes(bhavcopy_of(d, T.LAYOUTS[0])).drop("symbol", "source"), 5, traded_value=2)


@query("bhavcopy_older_layout", BHAV_SQL)
def _(d):
    return C.rounded(T.normalize_closes(bhavcopy_of(d, T.LAYOUTS[1])).drop("symbol", "source"), 5, traded_value=2)


@query("read_bhavcopy", BHAV_SQL)
def _(d):
    """Days of odd months in one layout, of even months in the other with its columns the other way round, all in one folder."""
    path = folder_of(d, "daily files")
    old = bhavcopy_of(d, T.LAYOUTS[1]).filter(F.month("trade_date") % 2 == 0).withColumn("TradDt", F.col("trade_date").cast("string")).drop("trade_date")
    new = bhavcopy_of(d, T.LAYOUTS[0]).filter(F.month("trade_date") % 2 == 1).withColumn("TradDt", F.col("trade_date").cast("string")).drop("trade_date")
    for rows in (new, old.select(*reversed(old.columns))):
        rows.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return C.rounded(T.read_bhavcopy(d.spark, path).drop("symbol", "source"), 5, traded_value=2)


@query("merge_prices", f"""
SELECT isin, trade_date, {r('CASE WHEN month(trade_date) = 3 THEN close_price * 2 ELSE close_price END', 5)} AS close_price, month(trade_date) = 3 AS rewritten FROM v_prices_daily""")
def _(d):
    """Two corrections of each March close in one batch, the later one counts; merged twice. Other months keep their files."""
    path, keys = folder_of(d, "prices"), ["isin", "trade_date"]
    T.merge_prices(d.spark, path, d.prices_daily, keys, parts=1)
    before = cut(d.spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file")).distinct()).withColumn("kept", F.lit(True))
    march = d.prices_daily.filter(F.month("trade_date") == 3)
    batch = march.withColumn("fetched_at", F.lit("2002-01-02")).withColumn("close_price", F.col("close_price") * 2) \
        .unionByName(march.withColumn("fetched_at", F.lit("2002-01-01")).withColumn("close_price", F.col("close_price") * 3))
    for _ in range(2):
        T.merge_prices(d.spark, path, batch, keys, ["fetched_at"], parts=1)
    rows = d.spark.read.parquet(path).select(*keys, "close_price", F.col("_metadata.file_name").alias("file"))
    return C.rounded(rows.join(before, "file", "left").select(*keys, "close_price", F.col("kept").isNull().alias("rewritten")), 5)


@query("merge_shareholding", f"""
SELECT isin, quarter_end, {r('CASE WHEN month(quarter_end) = 6 THEN 2 ELSE fii_pct END', 5)} AS fii_pct, CASE WHEN month(quarter_end) = 6 THEN 'x' END AS source_sha256 FROM v_filings""")
def _(d):
    """Filings of June corrected twice in one batch and merged into the table by quarter and key digest."""
    path = folder_of(d, "filings")
    T.merge_shareholding(d.spark, path, d.filings.withColumn("source", F.lit("test")))
    new = d.filings.filter(F.month("quarter_end") == 6).withColumn("source", F.lit("test")).withColumn("ixbrl_sha256", F.lit("x")).withColumn(
        "at", F.explode(F.array(F.lit(2), F.lit(1)))).withColumn("fii_pct", F.col("at").cast("double"))
    T.merge_shareholding(d.spark, path, new, ["at"])
    return C.rounded(T.read_keyed(d.spark, path).select("isin", "quarter_end", "fii_pct", "source_sha256"), 5)


@query("upsert_prices", f"SELECT isin, trade_date, {r('CASE WHEN month(trade_date) = 3 THEN close_price * 2 ELSE close_price END', 5)} AS close_price FROM v_prices_daily")
def _(d):
    corrected = d.prices_daily.filter(F.month("trade_date") == 3).withColumn("close_price", F.col("close_price") * 2)
    return C.rounded(T.upsert_prices(d.prices_daily, corrected, ["isin", "trade_date"]).select("isin", "trade_date", "close_price"), 5)


@query("upsert_shareholding", f"SELECT isin, quarter_end, {r('CASE WHEN month(quarter_end) = 6 THEN 1 ELSE fii_pct END', 5)} AS fii_pct, CASE WHEN month(quarter_end) = 6 THEN 'x' END AS source_sha256 FROM v_filings")
def _(d):
    new = d.filings.filter(F.month("quarter_end") == 6).withColumn("fii_pct", F.lit(1.0)).withColumn("source", F.lit("test")).withColumn("ixbrl_sha256", F.lit("x"))
    return C.rounded(T.upsert_shareholding(d.filings, new).select("isin", "quarter_end", "fii_pct", "source_sha256"), 5)


@query("replace_delta_months", """
SELECT scheme_id, isin, report_month, action FROM v_deltas WHERE report_month <> '1998-07' AND NOT (report_month = '1998-06' AND action = 'new')""")
def _(d):
    rerun = d.deltas.filter((F.col("report_month") == "1998-06") & (F.col("action") != "new"))
    return T.replace_months(d.deltas, rerun, ["1998-07"]).select("scheme_id", "isin", "report_month", "action")


def documents_inventory(d):
    fund = F.struct("official_key", "official_name", "scheme_id", (F.col("active_eligible") == 1).alias("active_eligible"), (F.col("equity_eligible") == 1).alias("equity_eligible"), "exclusion_reason")
    funds = d.expected_funds.groupBy("amc_name", "report_month").agg(F.collect_list(fund).alias("funds"))
    return (d.inventories.join(funds, ["amc_name", "report_month"])
            .withColumn("exhaustive", F.col("exhaustive") == 1).withColumn("reviewed_at", F.lit("2002-01-01")))


@query("import_inventory", """
SELECT amc_name, report_month, official_key, scheme_id, active_eligible, equity_eligible FROM v_expected""")
def _(d):
    _head, funds = T.import_inventory(d.inventories, d.expected_funds, documents_inventory(d), d.schemes)
    return funds.select("amc_name", "report_month", "official_key", "scheme_id", "active_eligible", "equity_eligible")


@query("inventory_problems", """
SELECT amc_name, report_month, 'not_https' AS problem FROM v_inventory WHERE exhaustive = 1 UNION ALL SELECT amc_name, report_month, 'missing_exclusion_reason' FROM v_inventory
WHERE (amc_name, report_month) IN (SELECT (amc_name, report_month) FROM v_expected WHERE equity_eligible = 0)""")
def _(d):
    docs = documents_inventory(d).withColumn("source_url", F.when(F.col("exhaustive"), "http://example.com").otherwise(F.col("source_url")))
    blank = F.transform("funds", lambda f: f.withField("exclusion_reason", F.lit(None).cast("string")))
    return T.inventory_problems(docs.withColumn("funds", blank), d.schemes)


@query("evidence_append", """
SELECT 'evidence' AS part, count(*) + count(*) FILTER (WHERE scheme_id % 2 = 0) AS n FROM v_evidence UNION ALL SELECT 'changed', count(*) FROM v_evidence WHERE scheme_id % 2 = 0
UNION ALL SELECT 'snapshots', count(*) FROM v_snapsources UNION ALL SELECT 'replaced', count(*) FROM v_snapsources WHERE scheme_id % 3 = 0
UNION ALL SELECT 'sources', count(*) FROM v_disclosures UNION ALL SELECT 'published', count(*) FROM v_disclosures WHERE published_at IS NOT NULL""")
def _(d):
    """Known keys stay as they are, those of a new parser are added; a third of the snapshots get new sources."""
    parser = F.when(F.col("scheme_id") % 2 == 0, "p3").otherwise(F.col("parser_version"))
    rows = T.append_evidence(d.evidence, d.evidence.withColumn("raw_json", F.lit("changed")).withColumn("parser_version", parser))
    snapshots = T.replace_snapshot_sources(d.snapshot_sources, d.snapshot_sources.filter(F.col("scheme_id") % 3 == 0).withColumn("parser_version", F.lit("p3")))
    merged = T.merge_disclosure_sources(d.disclosure_sources, d.disclosure_sources.withColumn("published_at", F.lit(None).cast("string")))
    return (rows.agg(F.lit("evidence").alias("part"), F.count(F.lit(1)).alias("n")).unionAll(rows.agg(F.lit("changed"), F.count_if(F.col("raw_json") == "changed")))
            .unionAll(snapshots.agg(F.lit("snapshots"), F.count(F.lit(1)))).unionAll(snapshots.agg(F.lit("replaced"), F.count_if(F.col("parser_version") == "p3")))
            .unionAll(merged.agg(F.lit("sources"), F.count(F.lit(1))))
            .unionAll(merged.agg(F.lit("published"), F.count("published_at"))))


@query("track_source", """
SELECT amc_name, sheet AS scheme_name, report_month, CASE WHEN error IS NULL THEN 1 END AS dropped_non_isin_count, error
FROM (SELECT t.*, CASE WHEN report_month LIKE '%-03' AND n > 1 THEN 'inconsistent' WHEN report_month LIKE '%-05' THEN 'non_finite' END AS error FROM v_sheet_totals t)""")
def _(d):
    """March weights differ from line to line, those of May have no number."""
    parsed = N.parsed_holdings(d.raw_rows).withColumnRenamed("sheet", "scheme_name").withColumn("source_sha256", F.sha2(F.concat_ws("|", "amc_name", "report_month"), 256))
    weight = (F.when(F.col("report_month").endswith("-03"), F.col("row_number").cast("double")).when(F.col("report_month").endswith("-05"), float("inf"))
              .otherwise(F.col("dropped_non_isin_pct_nav")))
    parsed = parsed.withColumn("dropped_non_isin_pct_nav", weight)
    return V.track_source(parsed).select("amc_name", "scheme_name", "report_month", "dropped_non_isin_count", "error")


@query("export_json", """
SELECT scheme_id, to_json(struct_pack(scheme_id := scheme_id, amc_name := amc_name, scheme_name := scheme_name, scheme_key := scheme_key,
  scheme_title := scheme_title, is_active_equity := is_active_equity, house_no := house_no))::VARCHAR AS document FROM v_scheme""")
def _(d):
    """The schemes' JSON lines, written and read back."""
    path = f"{required_folder(d.spark)}/exports/{uuid.uuid4().hex}"
    T.export_json(d.schemes, path)
    return T.json_documents(d.spark.read.schema(d.schemes.schema).json(path), "scheme_id")
