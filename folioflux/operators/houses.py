"""Fund-house activity and the fixed house roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.operators.compare import NET_TOLERANCE


def loaded_schemes(holdings: DataFrame, schemes: DataFrame, stocks: DataFrame, active_only: bool = True) -> DataFrame:
    """(report_month, scheme_id, amc_name) loaded with an equity holding in the month or the month before."""
    votes = schemes.filter(F.col("is_active_equity") == 1) if active_only else schemes
    equity = stocks.filter(F.col("instrument_type") == "equity").select("isin", F.lit(True).alias("_eq"))
    sides = (holdings.join(equity, "isin", "left")
             .groupBy("scheme_id", "report_month").agg(F.bool_or(F.coalesce("_eq", F.lit(False))).alias("_eq"))
             .select("scheme_id", F.explode(F.array(
                 F.struct(F.col("report_month").alias("m"), F.lit(True).alias("now"), F.col("_eq").alias("eq")),
                 F.struct(C.next_month("report_month").alias("m"), F.lit(False).alias("now"), F.col("_eq").alias("eq"))))
                 .alias("s")))
    return (sides.groupBy("scheme_id", F.col("s.m").alias("report_month"))
            .agg(F.bool_or("s.now").alias("_now"), F.bool_or("s.eq").alias("_eq"))
            .filter(F.col("_now") & F.col("_eq"))
            .join(votes.select("scheme_id", "amc_name"), "scheme_id").select("report_month", "scheme_id", "amc_name"))


def fund_house_activity(comparison: DataFrame, loaded: DataFrame) -> DataFrame:
    """Per (month, house): schemes loaded and compared, securities increased and reduced, biggest move."""
    keys = ["report_month", "amc_name"]
    by_stock = comparison.groupBy(*keys, "isin").agg(
        F.min("stock_name").alias("stock_name"), F.sum("quantity_prev").alias("q0"),
        F.sum("qty_change").alias("net"), C.strict_sum("flow_lakhs").alias("flow"))
    changed = F.abs("net") > NET_TOLERANCE
    move = F.struct("isin", "stock_name", F.col("net").alias("qty_change"), F.col("flow").alias("flow_lakhs"),
                    F.when(F.col("q0") > 0, 100 * F.col("net") / F.col("q0")).alias("change_pct"))
    size = F.struct(-F.abs("flow"), F.col("isin"))
    priced = changed & F.col("flow").isNotNull()
    activity = by_stock.groupBy(*keys).agg(
        C.flag_count(changed & (F.col("net") > 0)).alias("increased"),
        C.flag_count(changed & (F.col("net") < 0)).alias("reduced"),
        C.flag_count(changed & F.col("flow").isNull()).alias("unpriced"),
        F.min_by(F.when(priced, move), F.when(priced, size)).alias("biggest"))
    compared = (comparison.select(*keys, "scheme_id").distinct().groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("compared")))
    counts = loaded.groupBy(*keys).agg(F.count(F.lit(1)).alias("loaded"))
    joined = counts.join(compared, keys, "full_outer").join(activity, keys, "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(*keys, *[F.coalesce(c, zero).alias(c) for c in
                                  ("loaded", "compared", "increased", "reduced", "unpriced")],
                         F.col("biggest.isin").alias("biggest_isin"), F.col("biggest.qty_change").alias("biggest_qty_change"),
                         F.col("biggest.flow_lakhs").alias("biggest_flow_lakhs"),
                         F.col("biggest.change_pct").alias("biggest_change_pct"))


# The eight selected houses in their two groups, with the names each is stored under.
HOUSE_GROUPS = (
    ("India’s five largest fund houses", (
        ("SBI Mutual Fund", ("SBI AMC", "SBI Mutual Fund")),
        ("ICICI Prudential Mutual Fund", ("ICICI Prudential AMC", "ICICI Prudential Mutual Fund")),
        ("HDFC Mutual Fund", ("HDFC AMC", "HDFC Mutual Fund")),
        ("Nippon India Mutual Fund", ("Nippon India AMC", "Nippon India Mutual Fund")),
        ("Kotak Mahindra Mutual Fund", ("Kotak Mahindra AMC", "Kotak AMC", "Kotak Mahindra Mutual Fund")),
    )),
    ("Three more foreign-owned fund houses in India", (
        ("Mirae Asset Mutual Fund", ("Mirae Asset AMC", "Mirae Asset Mutual Fund")),
        ("Franklin Templeton Mutual Fund", ("Franklin Templeton AMC", "Franklin Templeton Mutual Fund")),
        ("HSBC Mutual Fund", ("HSBC AMC", "HSBC Mutual Fund")),
    )),
)


def selected_house_groups(activity: DataFrame, groups=HOUSE_GROUPS) -> DataFrame:
    """The fixed roster per month, each house under its first loaded alias; unloaded houses show zeros."""
    entries = F.array(*[F.struct(F.lit(g).alias("group_no"), F.lit(title).alias("group_title"), F.lit(p).alias("position"),
                                 F.lit(name).alias("display_name"), F.lit(a).alias("alias_no"), F.lit(alias).alias("amc_name"))
                        for g, (title, houses) in enumerate(groups, 1)
                        for p, (name, aliases) in enumerate(houses, 1) for a, alias in enumerate(aliases, 1)])
    wanted = activity.select("report_month").distinct().select("report_month", F.explode(entries).alias("e")).select("report_month", "e.*")
    values = ("loaded", "compared", "increased", "reduced", "biggest_isin")
    found = wanted.join(activity.select("report_month", "amc_name", *values, F.lit(1).alias("_f")), ["report_month", "amc_name"], "left")
    first = F.struct(F.col("_f").isNull(), F.col("alias_no"))
    picked = found.groupBy("report_month", "group_no", "group_title", "position", "display_name").agg(
        F.min_by(F.struct("amc_name", *values), first).alias("h"))
    zero = F.lit(0).cast("bigint")
    return picked.select("report_month", "group_no", "group_title", "position", "display_name", "h.amc_name",
                         *[F.coalesce(f"h.{c}", zero).alias(c) for c in values[:4]], "h.biggest_isin")
