"""Disclosure sheets (raw cell rows) to holdings.

Input rows are (amc_name, report_month, sheet, row_number, cells ARRAY<STRING>).
Per-sheet decisions -- header row, column positions, where the portfolio ends,
the NAV scale -- are grouped minima and sums with map-side combining, joined
back on the sheet key, so no sheet is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.functions.classify import is_holding_isin
from folioflux.operators.running import last_marker
from folioflux.sources.staging import cut

SHEET = ["amc_name", "report_month", "sheet"]

# Column-name synonyms, in matching order.
COLUMN_SYNONYMS = {
    "isin": ["isin", "isin no", "isin number", "isin code"],
    "instrument_name": ["name of the instrument", "name of instrument", "instrument name", "security name"],
    "industry": ["industry", "industry / rating", "sector", "industry+/rating"],
    "quantity": ["quantity", "qty", "no of shares", "no. of shares"],
    "market_value_lakhs": [
        "market value", "market value (rs. in lakhs)", "market value (rs in lakhs)", "market/fair value(rs. in lakhs)",
        "market value(rs in lacs)", "market value (rs lacs)", "market/ fair value (rs. in lacs.)",
        "exposure/market value(rs.lakh)", "market/fair value ( rs. in lacs)", "market/fair value (rs. in lakhs)",
        "market/fair value (rs. in lacs)", "market-value"],
    "pct_nav": ["% to nav", "% to net assets", "percentage to nav", "percentage to net assets", "% to net asset", "% to aum"],
}
REQUIRED_COLUMNS = ("isin", "instrument_name", "quantity", "market_value_lakhs", "pct_nav")
HEADER_ROWS = 10

# Labels of totals, category headings and non-titles (patterns).
PORTFOLIO_TOTAL = r"(?i)^(?:grand\s*total(?:\s*\(.*\))?|total\s+net\s+assets|net\s+assets|net\s+asset\s+value)$"
SUMMARY_NAME = r"(?i)\b(?:sub\s*[- ]?total|total|net\s+assets?|net\s+asset\s+value)\b"
CATEGORY_NAME = (
    r"(?i)^(?:equity & equity related instruments(?: \(.*\))?|debt instruments|"
    r"listed / awaiting listing on stock exchanges|government securities|"
    r"non-convertible debentures / bonds|securitized debt instruments|"
    r"money market instruments|certificate of deposits|treasury bills|"
    r"zero coupon bonds / deep discount bonds|privately placed/unlisted|"
    r"units of real estate investment trust \(REITs\)|"
    r"units of infrastructure investment trusts \(InvITs\))$")
NOT_A_TITLE = (
    r"(?i)^(?:portfolio\b|monthly portfolio|back to index$|index$|scheme name\s*:?$|"
    r"(?:.*\s)?mutual fund$|as on\b|statement of|\d|[a-z]*\d[a-z0-9]*$)")
DATED_TITLE = r"(?i)^portfolio of (.+?)\s+as on\s+.+$"
NAMED_TITLE = r"(?i)^scheme\s*name\s*:?\s*"
DERIVATIVE_HEADINGS = ("futures", "options", "derivatives")
FRACTION_BAND, PERCENT_BAND = (0.95, 1.05), (95.0, 105.0)
LOADER_FRACTION_LIMIT = 2.0
TOTAL_TOLERANCE = 1e-6
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
               "october", "november", "december")


def normalize_header(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(cell), r"\s+", " "))


def find_header_row(raw: DataFrame) -> DataFrame:
    """First of a sheet's first ten rows with an ISIN column label."""
    has_isin = F.exists("cells", lambda c: F.coalesce(normalize_header(c).isin(*COLUMN_SYNONYMS["isin"]), F.lit(False)))
    return (raw.filter((F.col("row_number") <= HEADER_ROWS) & has_isin)
            .groupBy(*SHEET).agg(F.min("row_number").alias("header_row")))


def match_columns(raw: DataFrame, headers: DataFrame) -> DataFrame:
    """0-based position of each canonical column; exact synonyms first, then substrings; plus what is missing."""
    cells = (raw.filter(F.col("row_number") <= HEADER_ROWS).join(headers, SHEET).filter(F.col("row_number") == F.col("header_row"))
             .select(*SHEET, F.posexplode(F.transform("cells", normalize_header)).alias("position", "label")))
    best = []
    for name, synonyms in COLUMN_SYNONYMS.items():
        order = F.lit(None).cast("int")
        for i, synonym in reversed(list(enumerate(synonyms))):
            order = F.when(F.col("label") == synonym, F.lit(i)).otherwise(order)
        partial = F.lit(False)
        for synonym in synonyms:
            partial = partial | F.contains(F.col("label"), F.lit(synonym))
        score = (F.when(order.isNotNull(), F.struct(F.lit(0).alias("k"), order.alias("o"), F.col("position").alias("p")))
                 .when(partial, F.struct(F.lit(1).alias("k"), F.col("position").alias("o"), F.col("position").alias("p"))))
        best.append(F.min(score)["p"].alias(name))
    mapped = cells.groupBy(*SHEET).agg(*best)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_COLUMNS]))
    return mapped.withColumn("missing", missing)


def canonical_rows(raw: DataFrame, headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows below the header with their canonical cells; sheets lacking a required column are left out."""
    cell = lambda name: F.trim(F.get("cells", F.col(f"m.{name}")))
    places = mapping.filter(F.size("missing") == 0).select(*SHEET, F.struct(*COLUMN_SYNONYMS).alias("m"))
    rows = raw.join(headers.join(places, SHEET), SHEET).filter(F.col("row_number") > F.col("header_row"))
    any_total = F.exists("cells", lambda c: F.coalesce(F.trim(c).rlike(PORTFOLIO_TOTAL), F.lit(False)))
    return rows.select(*SHEET, "row_number", cell("isin").alias("isin"), F.coalesce(cell("instrument_name"), F.lit("")).alias("instrument_name"),
                       cell("industry").alias("industry"), cell("quantity").alias("quantity_text"),
                       cell("market_value_lakhs").alias("value_text"), cell("pct_nav").alias("nav_text"), any_total.alias("is_total"))


def typed_rows(rows: DataFrame) -> DataFrame:
    """Numbers parsed, holding and omitted-detail rows marked."""
    typed = (rows.withColumn("quantity", C.finite("quantity_text")).withColumn("market_value_lakhs", C.finite("value_text"))
             .withColumn("pct_nav_raw", C.finite("nav_text")).withColumn("valid", is_holding_isin("isin")))
    return typed.withColumn("detail", holding_detail())


def holding_detail() -> Column:
    name = F.col("instrument_name")
    numeric = F.col("quantity").isNotNull() | F.col("market_value_lakhs").isNotNull() | F.col("pct_nav_raw").isNotNull()
    category = name.rlike(CATEGORY_NAME) & F.coalesce(F.col("quantity_text") == "", F.lit(True))
    return ~F.col("valid") & (name != "") & ~name.rlike(SUMMARY_NAME) & ~category & numeric


def portfolio_boundary(typed: DataFrame) -> DataFrame:
    """Per sheet: the row ending the portfolio, by any total cell and by the name cell alone."""
    holding = F.col("valid") | F.col("detail")
    first = typed.filter(holding).groupBy(*SHEET).agg(F.min("row_number").alias("first_holding"))
    named = F.col("instrument_name").rlike(PORTFOLIO_TOTAL)
    totals = typed.filter(F.col("is_total") | named).select(*SHEET, "row_number", "is_total", named.alias("named"))
    after = F.col("row_number") > F.col("first_holding")
    ends = totals.join(first, SHEET).groupBy(*SHEET).agg(
        F.min(F.when(after & F.col("is_total"), F.col("row_number"))).alias("end_row"),
        F.min(F.when(after & F.col("named"), F.col("row_number"))).alias("named_end_row"))
    return first.join(ends, SHEET, "left")


def portfolio_rows(typed: DataFrame, boundary: DataFrame) -> DataFrame:
    """Rows with notes after the portfolio removed and the omitted detail rows marked."""
    rows = typed.join(boundary, SHEET, "left")
    note = F.col("valid") & F.coalesce(F.col("row_number") > F.col("end_row"), F.lit(False))
    return (rows.filter(~note).withColumn("dropped", F.col("detail") & F.coalesce(F.col("row_number") < F.col("named_end_row"), F.lit(True)))
            .drop("first_holding", "end_row", "named_end_row"))


def nav_scale(total: Column) -> Column:
    return (F.when(total.between(*FRACTION_BAND), "fraction").when(total.between(*PERCENT_BAND), "percent").otherwise("unknown"))


def sheet_totals(rows: DataFrame) -> DataFrame:
    """Printed total, omitted rows and the NAV scale of each sheet."""
    nav = F.col("pct_nav_raw")
    printed = F.col("instrument_name").rlike(PORTFOLIO_TOTAL) & nav.isNotNull()
    stats = rows.groupBy(*SHEET).agg(
        F.min_by(F.when(printed, nav), F.when(printed, F.col("row_number"))).alias("_first"),
        F.max(F.when(printed, nav)).alias("_max"), F.min(F.when(printed, nav)).alias("_min"),
        F.count_if(F.col("valid")).alias("kept"), F.count(F.when(F.col("valid"), nav)).alias("_known"),
        F.sum(F.when(F.col("valid"), nav)).alias("_accepted"), F.count_if(F.col("dropped")).alias("dropped_non_isin_count"),
        F.sum(F.when(F.col("dropped"), nav)).alias("_omitted"))
    agreed = (F.abs(F.col("_max") - F.col("_first")) <= TOTAL_TOLERANCE) & (F.abs(F.col("_min") - F.col("_first")) <= TOTAL_TOLERANCE)
    stats = stats.withColumn("reported_total", F.when(agreed & (nav_scale(F.col("_first")) != "unknown"), F.col("_first")))
    omitted = F.when(F.col("dropped_non_isin_count") == 0, F.lit(0.0)).otherwise(F.col("_omitted"))
    accepted = F.coalesce("_accepted", F.lit(0.0))
    reconciled = (F.col("reported_total").isNotNull() & (F.col("dropped_non_isin_count") > 0) & (F.col("_known") == F.col("kept"))
                  & F.col("_omitted").isNotNull() & (accepted <= F.col("reported_total")))
    stats = stats.withColumn("_dropped_nav", F.when(reconciled, F.col("reported_total") - accepted).otherwise(omitted))
    row_total = F.coalesce(F.col("_accepted") + F.col("_dropped_nav"), "_accepted", "_dropped_nav")
    scale = nav_scale(F.coalesce("reported_total", row_total))
    factor = F.when(scale == "fraction", 100.0).otherwise(1.0)
    return stats.select(*SHEET, "kept", "reported_total", "dropped_non_isin_count", scale.alias("pct_nav_scale"),
                        (F.col("_dropped_nav") * factor).alias("dropped_non_isin_pct_nav"))


def parsed_holdings(raw: DataFrame) -> DataFrame:
    """The whole normalisation: raw sheet rows to parsed holding lines on the percent scale."""
    # Headers are looked for in the few top rows of each sheet, which are read once.
    top = cut(raw.filter(F.col("row_number") <= HEADER_ROWS))
    headers = find_header_row(top)
    # Typed rows feed the boundary, the totals and the result: computed once.
    typed = cut(typed_rows(canonical_rows(raw, headers, match_columns(top, headers))))
    boundary = cut(portfolio_boundary(typed))
    # A row for each sheet, with all that its holdings need.
    totals = sheet_totals(portfolio_rows(typed, boundary)).join(boundary.select(*SHEET, "end_row"), SHEET, "left")
    factor = F.when(F.col("pct_nav_scale") == "fraction", 100.0).otherwise(1.0)
    note = F.coalesce(F.col("row_number") > F.col("end_row"), F.lit(False))
    return (typed.filter("valid").join(totals, SHEET).filter(~note)
            .select(*SHEET, "row_number", F.upper("isin").alias("isin"), "instrument_name", "industry", "quantity", "market_value_lakhs",
                    (F.col("pct_nav_raw") * factor).alias("pct_nav"), "pct_nav_raw", "pct_nav_scale", "dropped_non_isin_count",
                    "dropped_non_isin_pct_nav"))


def loader_nav_rescale(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Second scale rule at load: no parser scale on every line and a NAV sum of at most 2 -> fractions."""
    stats = lines.groupBy(*keys).agg(F.sum("pct_nav").alias("_sum"), F.bool_and(F.col("pct_nav_scale").isNotNull()).alias("_scaled"))
    fractions = ~F.col("_scaled") & (F.round(F.coalesce("_sum", F.lit(0.0)), 9) <= LOADER_FRACTION_LIMIT)
    return (lines.join(stats, keys).withColumn("pct_nav", F.when(fractions, F.col("pct_nav") * 100.0).otherwise(F.col("pct_nav")))
            .drop("_sum", "_scaled"))


def combine_lots(lines: DataFrame, keys: list[str], line_no: str) -> DataFrame:
    """One holding per security from all its lines: strict sums of the lines holding something.

    With no such line, the last line carrying any number stands, else the last line.
    """
    q, numbers = F.col("quantity"), ("quantity", "market_value_lakhs", "pct_nav", "pct_nav_raw")
    other = F.lit(False)
    for name in numbers[1:]:
        other = other | F.coalesce(F.col(name) != 0, F.lit(False))
    held = F.coalesce(q > 0, F.lit(False)) | (q.isNull() & other)
    valued = F.col("quantity").isNotNull() | F.col("market_value_lakhs").isNotNull() | F.col("pct_nav").isNotNull()
    line = F.struct(*numbers, "pct_nav_scale")
    rows = lines.withColumn("_held", held)
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_lines"), F.count_if("_held").alias("_n"),
        *[C.strict_sum(name, F.col("_held")).alias(f"_{name}") for name in numbers],
        F.min_by(F.when(F.col("_held"), F.col("pct_nav_scale")), F.when(F.col("_held") & F.col("pct_nav_scale").isNotNull(), F.col(line_no))).alias("_scale"),
        F.max_by(F.when(valued, line), F.when(valued, F.col(line_no))).alias("_valued"), F.max_by(line, line_no).alias("_last"))
    stands = F.coalesce("_valued", "_last")
    return stats.select(*keys, *[F.when(F.col("_n") > 0, F.col(f"_{n}")).otherwise(stands[n]).alias(n) for n in numbers],
                        F.when(F.col("_n") > 0, F.col("_scale")).otherwise(stands["pct_nav_scale"]).alias("pct_nav_scale"),
                        F.col("_lines").alias("n_lines"))


def scheme_titles(raw: DataFrame, headers: DataFrame) -> DataFrame:
    """The scheme's full name from the rows above the header, NULL when there is none."""
    lines = F.filter(F.transform(F.flatten(F.transform("cells", lambda c: F.split(F.coalesce(c, F.lit("")), r"\n"))), F.trim), lambda c: c != "")
    cells = (raw.filter(F.col("row_number") <= HEADER_ROWS).join(headers, SHEET)
             .filter(F.col("row_number") < F.col("header_row")).withColumn("_l", lines)
             .select(*SHEET, "row_number", "_l", F.posexplode("_l").alias("pos", "cell")))
    cell, at = F.col("cell"), F.struct("row_number", "pos")
    dated, named = cell.rlike(DATED_TITLE), cell.rlike(NAMED_TITLE)
    rest = F.regexp_replace(cell, NAMED_TITLE, "")
    found = F.when(dated, F.trim(F.regexp_extract(cell, DATED_TITLE, 1))).when(
        named, F.when(rest != "", rest).otherwise(F.get("_l", F.col("pos") + 1)))
    plain = (F.length(cell) > 3) & ~cell.rlike(NOT_A_TITLE)
    squeezed = F.regexp_replace(cell, r"\s+", " ")
    stats = cells.select("*", (dated | named).alias("_m"), found.alias("_f"), plain.alias("_p"), squeezed.alias("_s")).groupBy(*SHEET).agg(
        F.min_by(F.when(F.col("_m"), F.struct("_f")), F.when(F.col("_m"), at)).alias("_t"),
        F.min_by(F.when(F.col("_p"), F.col("_s")), F.when(F.col("_p"), at)).alias("_u"))
    return stats.select(*SHEET, F.when(F.col("_t").isNotNull(), F.col("_t._f")).otherwise(F.col("_u")).alias("scheme_title"))


def stacked_sections(raw: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sheets stacking several schemes between STARTS / ENDS markers: (section rows, refused sections).

    Section rows carry the section's title and its row offset. Nested, unmatched
    or unclosed sections and sections without exactly one title are refused.
    """
    text = F.trim(F.get("cells", F.lit(0)))
    kind = F.when(text.rlike(r"^SCHEME CODE\d+STARTS$"), "start").when(text.rlike(r"^SCHEME CODE\d+ENDS$"), "end")
    code = F.regexp_extract(text, r"^SCHEME CODE(\d+)", 1)
    marker = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), code.alias("code"), F.col("row_number").alias("row")))
    rows = last_marker(raw.withColumn("_mark", marker), keys, "row_number", "_mark", "_state")
    own = W.partitionBy(*keys).orderBy("row_number")
    marks = (rows.filter(F.col("_mark").isNotNull()).select(*keys, "row_number", "_mark")
             .withColumn("_prev", F.lag("_mark").over(own)).withColumn("_next", F.lead("_mark").over(own)))
    start, end = F.col("_mark.kind") == "start", F.col("_mark.kind") == "end"
    error = (F.when(start & (F.col("_prev.kind") == "start"), "nested_section")
             .when(end & ~F.coalesce((F.col("_prev.kind") == "start") & (F.col("_prev.code") == F.col("_mark.code")), F.lit(False)), "unmatched_end")
             .when(start & F.col("_next").isNull(), "unclosed_section"))
    inside = rows.filter(F.col("_mark").isNull() & (F.col("_state.kind") == "start")).withColumn("section", F.col("_state.code")) \
        .withColumn("_start", F.col("_state.row"))
    title = F.when((F.col("row_number") <= F.col("_start") + 5) & text.startswith("SCHEME:"), F.trim(F.substring_index(text, ":", -1)))
    titles = inside.groupBy(*keys, "section", "_start").agg(F.count(title).alias("_n"), F.min(title).alias("title"))
    opened = F.when(end & (F.col("_prev.kind") == "start"), F.col("_prev.code")).otherwise(F.col("_mark.code"))
    bad = (marks.withColumn("error", error).filter(F.col("error").isNotNull()).select(*keys, opened.alias("section"), "error")
           .unionByName(titles.filter(F.col("_n") != 1).select(*keys, "section", F.lit("no_unique_title").alias("error"))))
    good = (inside.join(titles.filter(F.col("_n") == 1), [*keys, "section", "_start"]).join(bad.select(*keys, "section"), [*keys, "section"], "left_anti")
            .select(*keys, "section", "title", "row_number", (F.col("row_number") - F.col("_start")).alias("section_row"), "cells"))
    return good, bad


def derivative_section_filter(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows below a futures, options or derivatives heading (first two cells), keeping the final total."""
    pick = F.filter(F.slice("cells", 1, 2), lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
    heading = F.lower(F.trim(F.get(pick, F.lit(0))))
    total = F.coalesce(F.trim(F.get("cells", F.lit(4))).rlike(PORTFOLIO_TOTAL), F.lit(False))
    rows = last_marker(raw.withColumn("_heading", heading), keys, "row_number", "_heading", "_section")
    return (rows.filter(~F.coalesce(F.col("_section").isin(*DERIVATIVE_HEADINGS), F.lit(False)) | total)
            .drop("_heading", "_section"))


def normalise_text(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ")
    return F.trim(F.regexp_replace(spaced, r"[^a-z0-9]+", " "))


def months_named(raw: DataFrame) -> DataFrame:
    """(sheet, month) named in the text of a sheet's first ten rows."""
    names = "|".join(sorted({n for m in MONTH_NAMES for n in (m, m[:3])}, key=len, reverse=True))
    pattern = rf"\b({names})(?: \d{{1,2}}(?: (?:st|nd|rd|th))?)? (20\d\d)\b"
    text = normalise_text(F.concat_ws(" ", "cells"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = F.create_map(*[x for i, m in enumerate(MONTH_NAMES, 1) for x in (F.lit(m[:3]), F.lit(f"{i:02d}"))])
    hits = raw.filter(F.col("row_number") <= HEADER_ROWS).select(*SHEET, F.explode(found).alias("hit"))
    return hits.select(*SHEET, F.concat(F.substring(F.col("hit"), -4, 4), F.lit("-"), number[F.substring("hit", 1, 3)]).alias("named_month")).distinct()
