"""Replay of the earlier calculation rules, and the guard that refuses unsafe replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.operators.compare import CELLS, change_columns, split_ratios
from folioflux.operators.eligibility import comparable_scheme_months


def comparison_rows(pairs: DataFrame, schemes: DataFrame, stocks: DataFrame, status: DataFrame,
                    actions: DataFrame | None = None, active_only: bool = True) -> DataFrame:
    """The comparison under the earlier rules: unknown cells count as zero and no quantity check withholds a scheme.

    Flow is recomputed only for split-adjusted securities; elsewhere it is the
    plain month-over-month flow, with opened and closed positions recognised.
    """
    votes = schemes.filter(F.col("is_active_equity") == 1) if active_only else schemes
    equity = stocks.filter(F.col("instrument_type") == "equity").select("isin", F.col("name").alias("stock_name"))
    none_bad = status.select("scheme_id", "report_month").limit(0)
    rows = (pairs.join(comparable_scheme_months(status, none_bad), ["scheme_id", "report_month"], "left_semi")
            .join(equity, "isin").join(votes.select("scheme_id", "amc_name"), "scheme_id"))
    rows = rows.withColumns({f"{c}_{side}": F.coalesce(f"{c}_{side}", F.lit(0.0)) for c in CELLS for side in ("prev", "curr")})
    plain = change_columns(F.col("quantity_prev"), F.col("quantity_curr"), F.col("in_prev"), F.col("in_curr"))
    rows = rows.withColumn("_plain_flow", plain["flow_lakhs"])
    matched = rows.withColumn("in_prev", F.lit(True)).withColumn("in_curr", F.lit(True))
    rows = rows.join(split_ratios(matched, actions, unreadable_veto=False), ["report_month", "isin"], "left")
    adjusted = F.col("split_ratio").isNotNull()
    ratio = F.coalesce("split_ratio", F.lit(1.0))
    rows = rows.withColumn("raw_quantity_prev", F.col("quantity_prev")).withColumn("quantity_prev", F.col("quantity_prev") * ratio)
    legs = change_columns(F.col("quantity_prev"), F.col("quantity_curr"), F.lit(True), F.lit(True))
    return rows.select(
        "report_month", "prev_month", "scheme_id", "isin", "amc_name", "stock_name", "raw_quantity_prev", "quantity_prev",
        "quantity_curr", ratio.alias("split_ratio"), F.coalesce("adjustment_basis", F.lit("none")).alias("adjustment_basis"),
        legs["qty_change"].alias("qty_change"), F.when(adjusted, legs["flow_lakhs"]).otherwise(F.col("_plain_flow")).alias("flow_lakhs"))


def guard(pairs: DataFrame, schemes: DataFrame, stocks: DataFrame, status: DataFrame, include_nav: bool = False,
          requested: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Per month: whether an earlier-rules replay would conceal an unavailable input.

    Quantities of every compared equity count; values (and NAV weights) count for the ``requested`` securities (isin;
    default all). ``stored`` comparison rows count when a quantity, change or flow of theirs is no finite number.
    """
    votes = schemes.filter(F.col("is_active_equity") == 1).select("scheme_id")
    equity = stocks.filter(F.col("instrument_type") == "equity").select("isin")
    none_bad = status.select("scheme_id", "report_month").limit(0)
    rows = (pairs.join(comparable_scheme_months(status, none_bad), ["scheme_id", "report_month"], "left_semi")
            .join(equity, "isin", "left_semi").join(votes, "scheme_id", "left_semi"))
    asked = F.lit(True)
    if requested is not None:
        rows = rows.join(requested.select("isin").distinct().withColumn("_asked", F.lit(True)), "isin", "left")
        asked = F.col("_asked").isNotNull()
    bad = F.lit(False)
    for side in ("prev", "curr"):
        for name in ("quantity", "market_value_lakhs", *(["pct_nav"] if include_nav else [])):
            unknown = F.col(f"in_{side}") & C.non_negative(f"{name}_{side}").isNull()
            bad = bad | (unknown if name == "quantity" else asked & unknown)
    found = rows.select("report_month", bad.alias("_bad"))
    if stored is not None:
        lost = F.lit(False)
        for name in ("quantity_prev", "quantity_curr", "qty_change", "flow_lakhs"):
            lost = lost | C.finite(name).isNull()
        found = found.unionAll(stored.select("report_month", lost))
    return (found.groupBy("report_month").agg(C.flag_count(F.col("_bad")).alias("unavailable_inputs"))
            .withColumn("replay", F.when(F.col("unavailable_inputs") > 0, "refused").otherwise("reproducible")))
