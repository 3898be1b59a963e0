"""Validation gate: issues per scheme-month, and the status they imply.

Every check returns issue rows with the same columns; the gate is their union
reduced per scheme-month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.functions.classify import classify_isin
from folioflux.operators.actions import previous_snapshots

# Gate limits.
CELLS = ("quantity", "market_value_lakhs", "pct_nav")
NAV_MIN, NAV_MAX, NAV_QUARANTINE = 95.0, 105.0, 110.0
PRICE_CV_WARN = 0.01
QTY_RATIO_LOW, QTY_RATIO_HIGH = 0.5, 2.0
PEER_AGREEMENT = 0.05
SHAREHOLDING_TOLERANCE = 2.0

KEYS = ["scheme_id", "report_month"]
ISSUE_FIELDS = ("code", "severity", "message", "isin", "value", "peer_median_ratio", "prev_month")


def _issue(code, severity, message: Column, isin=None, value=None, peer=None, prev=None) -> list[Column]:
    def text(x, kind="string"):
        return (F.lit(None) if x is None else F.lit(x) if isinstance(x, str) else x).cast(kind)
    return [text(code).alias("code"), text(severity).alias("severity"), message.alias("message"),
            text(isin).alias("isin"), text(value, "double").alias("value"),
            text(peer, "double").alias("peer_median_ratio"), text(prev).alias("prev_month")]


def nav_sum(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy(*KEYS).agg(F.sum(F.when(~F.isnan("pct_nav"), F.col("pct_nav"))).alias("nav_sum"))


def nav_issues(sums: DataFrame) -> DataFrame:
    total = F.col("nav_sum")
    outside = F.struct(*_issue("nav_sum_out_of_band", "warn",
                               F.format_string("pct_nav sum %.2f outside 95-105 (may be partial sheet)", total), value=total))
    over = F.struct(*_issue("nav_sum_quarantine", "error", F.format_string(
        "pct_nav sum %.2f exceeds 110 (possible duplicate rows or scale error)", total), value=total))
    missing = F.struct(*_issue("nav_sum_missing", "warn", F.lit("no valid pct_nav values to sum (may be partial sheet)")))
    found = (F.when(total.isNull(), F.array(missing)).when(total > NAV_QUARANTINE, F.array(outside, over))
             .when((total < NAV_MIN) | (total > NAV_MAX), F.array(outside)))
    return sums.select(*KEYS, F.explode(found).alias("i")).select(*KEYS, "i.*")


def unavailable_cells(holdings: DataFrame, stocks: DataFrame) -> DataFrame:
    """One issue per unreadable quantity, value or NAV cell; an error only for an equity quantity."""
    kind = F.coalesce("instrument_type", classify_isin("isin"))
    checks = [("quantity", C.non_negative("quantity"), kind == "equity"),
              ("market_value_lakhs", C.finite("market_value_lakhs"), F.lit(False)),
              ("pct_nav", C.finite("pct_nav"), F.lit(False))]
    entries = F.filter(F.array(*[F.when(clean.isNull(), F.struct(*_issue(
        f"{name}_unavailable", F.when(critical, "error").otherwise("warn"),
        F.concat("isin", F.lit(f": {name} is unavailable; it is not zero")), isin=F.col("isin"))))
        for name, clean, critical in checks]), lambda e: e.isNotNull())
    unreadable = (C.non_negative("quantity").isNull() | C.finite("market_value_lakhs").isNull() | C.finite("pct_nav").isNull())
    named = F.trim(F.coalesce("isin", F.lit(""))) != ""
    return (holdings.filter(unreadable & named).join(stocks.select("isin", "instrument_type"), "isin", "left")
            .select(*KEYS, F.explode(entries).alias("i")).select(*KEYS, "i.*"))


def _cv(px: Column) -> Column:
    return F.stddev_pop(px) / F.nullif(F.abs(F.avg(px)), F.lit(0.0))


def implied_price_cv(holdings: DataFrame, keys: list[str], positive_only: bool) -> DataFrame:
    """keys, n, cv where the implied price varies by 1% or more across at least two rows."""
    px = C.finite(F.try_divide("market_value_lakhs", "quantity"))
    rows = holdings.filter(C.non_negative("quantity") > 0) if positive_only else holdings
    stats = rows.groupBy(*keys).agg(F.count(px).alias("n"), _cv(px).alias("cv"))
    return stats.filter((F.col("n") >= 2) & (F.round("cv", 9) >= PRICE_CV_WARN))


def in_scheme_price_issues(holdings: DataFrame) -> DataFrame:
    found = implied_price_cv(holdings, [*KEYS, "isin"], positive_only=True)
    return found.select(*KEYS, *_issue("price_cv_high", "warn", F.format_string(
        "%s: implied-price CV %.4f >= 1%% across holders", "isin", "cv"), isin=F.col("isin"), value=F.col("cv")))


def cross_scheme_price_warnings(holdings: DataFrame) -> DataFrame:
    return implied_price_cv(holdings, ["report_month", "isin"], positive_only=False)


def quantity_ratios(holdings: DataFrame) -> DataFrame:
    """Quantity ratio of each holding against the scheme's latest earlier snapshot.

    A lag over the security's own months gives its previous row; it counts
    only when that row belongs to the scheme's previous snapshot.
    """
    own = W.partitionBy("scheme_id", "isin").orderBy("report_month")
    rows = holdings.select(*KEYS, "isin", C.non_negative("quantity").alias("quantity"), F.lag("report_month").over(own).alias("_m"),
                           F.lag(C.non_negative("quantity")).over(own).alias("_q"))
    return (rows.join(previous_snapshots(holdings), KEYS)
            .filter((F.col("_m") == F.col("prev_month")) & (F.col("quantity") > 0) & (F.col("_q") > 0))
            .select(*KEYS, "isin", "prev_month", C.finite(F.col("quantity") / F.col("_q")).alias("ratio"))
            .filter(F.col("ratio").isNotNull()))


def quantity_ratio_issues(holdings: DataFrame, peers: DataFrame, actions: DataFrame) -> DataFrame:
    confirmed = (actions.filter(F.col("confirmed") == 1)
                 .select(F.col("effective_month").alias("report_month"), "isin", F.lit(True).alias("_ca")).distinct())
    outside = quantity_ratios(holdings).filter(~F.col("ratio").between(QTY_RATIO_LOW, QTY_RATIO_HIGH))
    # Both sides grow with the holdings, and written peers are far larger than their files: never broadcast.
    rows = (outside.join(peers.select(*KEYS, "isin", "peer_median_ratio").hint("merge"), [*KEYS, "isin"], "left")
            .join(confirmed, ["report_month", "isin"], "left"))
    ratio, peer = F.col("ratio"), F.col("peer_median_ratio")
    agrees = F.coalesce(F.round(F.abs(peer - ratio) - PEER_AGREEMENT * ratio, 9) <= 0, F.lit(False))
    code = (F.when(F.col("_ca").isNotNull(), "qty_ratio_corporate_action")
            .when(agrees, "qty_ratio_corporate_action_candidate").otherwise("qty_ratio_out_of_band"))
    note = (F.when(F.col("_ca").isNotNull(), " but corporate action present")
            .when(agrees, F.format_string("; peer median %.3f agrees (corporate-action candidate)", peer))
            .otherwise("; may reflect ordinary trading"))
    message = F.concat(F.format_string("qty ratio %.3f %s outside 0.5-2.0", ratio, "isin"), note)
    return rows.select(*KEYS, *_issue(code, "warn", message, isin=F.col("isin"), value=ratio, peer=peer,
                                      prev=F.col("prev_month")))


def delivered_cells(delivered: DataFrame) -> DataFrame:
    """Holdings as they came, cells as text, with numbers in place of the cells and ``unreadable`` beside them.

    A blank cell is unknown; any other that is no number is unknown too, and ``unreadable`` lists it as (cell, text). No
    cell can stop the run.
    """
    text = lambda c: F.trim(F.col(c).cast("string"))
    bad = F.array_compact(F.array(*[F.when((text(c) != "") & text(c).try_cast("double").isNull(), F.struct(F.lit(c).alias("cell"), text(c).alias("text")))
                                    for c in CELLS]))
    return delivered.withColumn("unreadable", bad).withColumns({c: text(c).try_cast("double") for c in CELLS})


def crashed_checks(cells: DataFrame) -> DataFrame:
    """Issues of the checks that could not run: one error for each scheme-month and check.

    The quantity ratio needs the number of every security that the snapshot and the one before it share; where one of the
    two quantities is no number it has not validated the month. The other checks pass over cells that are no numbers,
    which ``unavailable_cells`` reports. A row that no check can place, without security, is a crash of the gate itself.
    """
    own = W.partitionBy("scheme_id", "isin").orderBy("report_month")
    text = F.get(F.filter("unreadable", lambda u: u["cell"] == "quantity"), F.lit(0))["text"]
    nameless = F.trim(F.coalesce("isin", F.lit(""))) == ""
    rows = cells.select(*KEYS, "isin", text.alias("_text"), F.lag("report_month").over(own).alias("_m"), F.lag(text).over(own).alias("_before"))
    # Only snapshots with such a cell, and the ones after them, are looked up.
    found = rows.filter(~nameless & F.col("_m").isNotNull() & (F.col("_text").isNotNull() | F.col("_before").isNotNull())) \
        .join(previous_snapshots(cells), KEYS).filter(F.col("_m") == F.col("prev_month"))
    first = found.groupBy(*KEYS).agg(F.min(F.struct("isin", F.coalesce("_text", "_before").alias("text"), "prev_month")).alias("f"))
    ratio = first.select(*KEYS, *_issue("qty_ratio_crashed", "error", F.concat(F.lit("qty_ratio check: "), "f.isin", F.lit(": "), "f.text", F.lit(" is no number")),
                                        isin=F.col("f.isin"), prev=F.col("f.prev_month")))
    # Counted, so that an unreadable name does not end the reduction.
    whole = cells.filter(nameless & (F.size("unreadable") > 0)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return ratio.unionByName(whole.select(*KEYS, *_issue("gate_crashed", "error", F.format_string("%d rows without security hold cells that are no numbers", "n"))))


def isolated(issues: DataFrame, crashed: DataFrame) -> DataFrame:
    """The issues with each crashed check's own findings replaced by its crash; other scheme-months keep theirs."""
    ratio = crashed.filter(F.col("code") == "qty_ratio_crashed").select(*KEYS).withColumn("_x", F.lit(True))
    kept = issues.join(ratio, KEYS, "left").filter(F.col("_x").isNull() | ~F.startswith(F.col("code"), F.lit("qty_ratio"))).drop("_x")
    return kept.unionByName(crashed)


def gate_issues(holdings: DataFrame, stocks: DataFrame, actions: DataFrame, peers: DataFrame) -> DataFrame:
    parts = [unavailable_cells(holdings, stocks), nav_issues(nav_sum(holdings)), in_scheme_price_issues(holdings),
             quantity_ratio_issues(holdings, peers, actions)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def statuses(holdings: DataFrame, stocks: DataFrame) -> DataFrame:
    """(scheme_id, report_month, status) of ``run_gate`` without its issues: the price and ratio checks only warn, so only the
    checks that can fail a scheme-month are run."""
    errors = (unavailable_cells(holdings, stocks).unionByName(nav_issues(nav_sum(holdings)))
              .filter(F.col("severity") == "error").groupBy(*KEYS).agg(F.max(F.lit(True)).alias("_failed")))
    return (holdings.select(*KEYS).distinct().join(errors, KEYS, "left")
            .select(*KEYS, F.when(F.coalesce("_failed", F.lit(False)), "quarantined").otherwise("ok").alias("status")))


def run_gate(holdings: DataFrame, issues: DataFrame, touched: DataFrame | None = None,
             provenance: DataFrame | None = None) -> DataFrame:
    """One report per touched scheme-month: status, issues, previous snapshot and NAV sum.

    ``provenance`` optionally adds dropped_non_isin_count, dropped_non_isin_pct_nav and source_data_hash.
    """
    touched = nav_sum(holdings) if touched is None else touched.join(nav_sum(holdings), KEYS, "left")
    found = issues.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct(*ISSUE_FIELDS))).alias("issues"),
        F.bool_or(F.col("severity") == "error").alias("_failed"))
    report = (touched.join(previous_snapshots(holdings), KEYS, "left").join(found, KEYS, "left")
              .withColumn("status", F.when(F.coalesce("_failed", F.lit(False)), "quarantined").otherwise("ok")).drop("_failed"))
    if provenance is not None:
        report = report.join(provenance, KEYS, "left")
    return report


def revalidate(report: DataFrame, stored: DataFrame) -> DataFrame:
    """Scheme-months whose status differs from the stored one (either may be absent)."""
    old = stored.select(*KEYS, F.col("status").alias("old_status"))
    new = report.select(*KEYS, F.col("status").alias("new_status"))
    return old.join(new, KEYS, "full_outer").filter(~F.col("old_status").eqNullSafe(F.col("new_status")))


def status_counts(report: DataFrame, stored: DataFrame) -> DataFrame:
    return (stored.select("status", F.lit(1).alias("before"), F.lit(0).alias("after"))
            .unionAll(report.select("status", F.lit(0), F.lit(1)))
            .groupBy("status").agg(F.sum("before").alias("before"), F.sum("after").alias("after")))


def shareholding_check(filings: DataFrame) -> DataFrame:
    """code and total per filing: NULL code when the known buckets sum to 100 within 2."""
    parts = ("promoter_pct", "public_pct", "fii_pct", "dii_pct")
    texts = [F.col(c).cast("string") for c in parts]
    numbers = [F.col(c).try_cast("double") for c in parts]
    invalid = F.lit(False)
    total, any_known = F.lit(0.0), F.lit(False)
    for text, number in zip(texts, numbers):
        invalid = invalid | (text.isNotNull() & number.isNull())
        known = number.isNotNull() & ~F.isnan(number)
        total = total + F.when(known, number).otherwise(0.0)
        any_known = any_known | known
    code = (F.when(invalid, "shareholding_invalid").when(~any_known, "shareholding_missing")
            .when(F.round(F.abs(total - 100.0), 9) > SHAREHOLDING_TOLERANCE, "shareholding_out_of_band"))
    return filings.select("isin", "quarter_end", code.alias("code"), F.when(any_known & ~invalid, total).alias("total"),
                          F.coalesce(~code.isin("shareholding_invalid", "shareholding_out_of_band"), F.lit(True)).alias("passed"))


def track_source(parsed: DataFrame) -> DataFrame:
    """One provenance value per (amc, scheme, month); several distinct or non-finite values are reported as an error."""
    keys = ["amc_name", "scheme_name", "report_month"]
    count, weight = F.col("dropped_non_isin_count").try_cast("double"), F.col("dropped_non_isin_pct_nav").try_cast("double")

    def known(x):
        return F.when(~F.isnan(x), x)
    stats = parsed.groupBy(*keys).agg(
        F.min(known(count)).alias("_c0"), F.max(known(count)).alias("_c1"),
        F.min(known(weight)).alias("_w0"), F.max(known(weight)).alias("_w1"),
        F.sort_array(F.collect_set("source_sha256")).alias("hashes"))
    infinite = F.lit(float("inf"))
    error = (F.when((F.col("_c0") != F.col("_c1")) | (F.col("_w0") != F.col("_w1")), "inconsistent")
             .when((F.abs("_c1") == infinite) | (F.abs("_w1") == infinite), "non_finite"))
    return stats.select(*keys, F.when(error.isNull(), F.col("_c0").cast("bigint")).alias("dropped_non_isin_count"),
                        F.when(error.isNull(), F.col("_w0")).alias("dropped_non_isin_pct_nav"),
                        F.concat_ws("+", "hashes").alias("source_data_hash"), error.alias("error"))
