"""Discretionary versus inflow-driven trading, per scheme and per security."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.operators.compare import agreed_ratio, confirmed_splits, split_statistics

# Votes below this weight change (percentage points) are noise; rupees per lakh.
NOISE_FLOOR_PP = 0.05
RUPEES_PER_LAKH = 1e5


def scored_pairs(pairs: DataFrame, voters: DataFrame, stocks: DataFrame,
                 instrument: str | None = "equity") -> DataFrame:
    """Paired holdings of the voting schemes, restricted to one instrument class.

    The voting set is taken before the instrument filter: a scheme compared on
    any holding is scored on its equity sleeve.
    """
    listed = stocks if instrument is None else stocks.filter(F.col("instrument_type") == instrument)
    return (pairs.join(voters, ["scheme_id", "report_month"], "left_semi")
            .join(listed.select("isin"), "isin", "left_semi"))


def active_weight_changes(pairs: DataFrame, splits: DataFrame | None = None, closes: DataFrame | None = None,
                          actions: DataFrame | None = None, infer_splits: bool = False) -> DataFrame:
    """Weight change of each (month, scheme, isin) against an untraded portfolio.

    ``pairs``: in_prev/in_curr and both sides' quantity and value. ``splits``:
    (report_month, isin, split_ratio), or ``infer_splits`` to derive them here
    with confirmed ``actions`` overriding. ``closes``: (report_month, isin,
    close_price) in rupees per share. Windows are keyed on (month, scheme), at
    most one portfolio of rows. What a security needs -- market price and split
    ratio -- is one aggregate over the same flagged rows it is joined back to,
    so both sides share one exchange.
    """
    one_scheme = W.partitionBy("report_month", "scheme_id")
    q0, v0 = F.col("quantity_prev"), F.col("market_value_lakhs_prev")
    q1, v1 = F.col("quantity_curr"), F.col("market_value_lakhs_curr")

    def faulty(q, v):
        return F.coalesce((q < 0) | (v < 0) | F.isnan(q) | F.isnan(v), F.lit(True))
    held0, held1 = F.col("in_prev"), F.col("in_curr")
    usable0, usable1 = held0 & (q0 > 0) & (v0 > 0), held1 & (q1 > 0) & (v1 > 0)

    def anywhere(condition):
        return F.coalesce(F.bool_or(condition).over(one_scheme), F.lit(False))
    flagged = pairs.select(
        "report_month", "scheme_id", "isin", held0, held1, q0, v0, q1, v1,
        (anywhere(held0) & anywhere(held1)
         & anywhere((held0 & faulty(q0, v0)) | (held1 & faulty(q1, v1)))).alias("unsafe"),
        (anywhere(usable0) & anywhere(usable1)).alias("shared"))
    scored = ~F.col("unsafe") & F.col("shared")
    own1 = scored & usable1
    security = flagged.groupBy("report_month", "isin").agg(
        (F.sum(F.when(own1, v1)) / F.sum(F.when(own1, q1))).alias("market_px"),
        *(split_statistics(held0 & held1) if infer_splits else []))
    keys = ["report_month", "isin"]
    nothing = F.lit(None).cast("double")
    security = security.select(*keys, "market_px", (agreed_ratio() if infer_splits else nothing).alias("split_ratio"))
    if infer_splits and actions is not None:
        security = (security.join(confirmed_splits(actions), keys, "left")
                    .withColumn("split_ratio", F.coalesce("confirmed_ratio", "split_ratio")).drop("confirmed_ratio"))
    if splits is not None:
        security = security.drop("split_ratio").join(splits.select(*keys, "split_ratio"), keys, "left")
    if closes is not None:
        security = security.join(closes.filter(F.col("close_price") > 0).select(
            *keys, (F.col("close_price") / RUPEES_PER_LAKH).alias("close_px")), keys, "left")
    else:
        security = security.withColumn("close_px", nothing)

    def unsafe_null(value):
        return F.when(~F.col("unsafe"), value)
    rows = flagged.filter(F.col("unsafe") | (F.col("shared") & (usable0 | usable1))).select(
        *keys, "scheme_id", "unsafe", F.when(usable0, q0).alias("q0"), F.when(usable0, v0).alias("v0"),
        F.when(usable1, q1).alias("q1"), F.when(usable1, v1).alias("v1")).join(security, keys)
    ratio = F.coalesce("split_ratio", F.lit(1.0))
    px = F.coalesce(F.col("v1") / F.col("q1"), "market_px", "close_px", F.col("v0") / F.col("q0") / ratio)
    basis = (F.when(F.col("unsafe"), "unavailable").when(F.col("q0").isNull(), "new_position")
             .when(F.col("q1").isNotNull(), "own").when(F.col("market_px").isNotNull(), "cross_scheme")
             .when(F.col("close_px").isNotNull(), "exchange_close").otherwise("assumed_flat"))
    drift = F.when(F.col("q0").isNull(), F.lit(0.0)).otherwise(F.col("q0") * ratio * px)
    rows = (rows.withColumn("price_basis", basis).withColumn("drift", drift)
            .withColumn("total_drift", F.sum("drift").over(one_scheme))
            .withColumn("total_curr", F.sum("v1").over(one_scheme))
            .filter(F.col("unsafe") | ((F.col("total_drift") > 0) & (F.col("total_curr") > 0))))
    w_drift = F.col("drift") / F.col("total_drift")
    w_curr = F.coalesce("v1", F.lit(0.0)) / F.col("total_curr")
    return rows.select(
        "report_month", "scheme_id", "isin",
        unsafe_null(100.0 * w_drift).alias("w_drift_pp"), unsafe_null(100.0 * w_curr).alias("w_curr_pp"),
        unsafe_null(100.0 * (w_curr - w_drift)).alias("active_weight_change_pp"),
        unsafe_null((w_curr - w_drift) * F.col("total_curr")).alias("discretionary_flow_lakhs"), "price_basis")


def aggregate_by_stock(changes: DataFrame, schemes: DataFrame, noise_floor: float = NOISE_FLOOR_PP) -> DataFrame:
    """Houses actively buying and selling each security; a house counts once, by its net flow.

    Two-level aggregate: (month, isin, house) first, so no task ever holds all
    holders of a popular security. A scheme without a house fails the query.
    """
    house = F.coalesce("amc_name", F.raise_error(F.lit("no house recorded for a voting scheme")))
    change, flow = C.finite("active_weight_change_pp"), C.finite("discretionary_flow_lakhs")
    rows = (changes.join(schemes.select("scheme_id", "amc_name"), "scheme_id", "left")
            .select("report_month", "isin", house.alias("amc_name"), change.alias("change"), flow.alias("flow"),
                    (F.abs(F.round(change, 9)) >= noise_floor).alias("decided")))
    decided = F.coalesce("decided", F.lit(False))
    by_house = rows.groupBy("report_month", "isin", "amc_name").agg(
        C.strict_sum("flow", decided).alias("decided_flow"),
        F.sum("flow").alias("flow"), F.sum("change").alias("change"),
        F.count_if(F.col("flow").isNull()).alias("no_flow"), F.count_if(F.col("change").isNull()).alias("no_change"))
    stats = by_house.groupBy("report_month", "isin").agg(
        C.flag_count(F.col("decided_flow") > 0).alias("buying"), C.flag_count(F.col("decided_flow") < 0).alias("selling"),
        F.when(F.sum("no_flow") == 0, F.sum("flow")).alias("discretionary_flow_lakhs"),
        F.when(F.sum("no_change") == 0, F.sum("change")).alias("active_weight_change_pp_sum"))
    known = F.col("discretionary_flow_lakhs").isNotNull() & F.col("active_weight_change_pp_sum").isNotNull()
    return stats.select(
        "report_month", "isin", F.when(known, F.col("buying")).alias("active_amcs_buying"),
        F.when(known, F.col("selling")).alias("active_amcs_selling"),
        F.when(known, F.col("buying") - F.col("selling")).alias("net_active_amc_count"),
        "discretionary_flow_lakhs", "active_weight_change_pp_sum")


def active_consensus(pairs: DataFrame, voters: DataFrame, schemes: DataFrame, stocks: DataFrame,
                     actions: DataFrame | None = None, closes: DataFrame | None = None,
                     instrument: str | None = "equity") -> DataFrame:
    scored = scored_pairs(pairs, voters, stocks, instrument)
    changes = active_weight_changes(scored, closes=closes, actions=actions, infer_splits=True)
    return aggregate_by_stock(changes, schemes)
