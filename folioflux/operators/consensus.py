"""Cross-house agreement per security, ranking and ownership-filing overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import columns as C

# Filing staleness, notable-list thresholds and page size.
STALE_AFTER_DAYS = 200
MIN_HOUSES = 2
STREAK_MONTHS = 3
PAGE_ROWS = 50
TOP_ROWS = 15

ACTIVE_COLUMNS = ("active_amcs_buying", "active_amcs_selling", "net_active_amc_count",
                  "discretionary_flow_lakhs", "active_weight_change_pp_sum")


def previous_universe(eligible: DataFrame, holdings: DataFrame) -> DataFrame:
    """(report_month, isin): securities any scheme held in the compared previous month(s)."""
    compared = eligible.filter(F.col("prev_month").isNotNull()).select("report_month", "prev_month").distinct()
    held = holdings.select(F.col("report_month").alias("prev_month"), "isin").distinct()
    return held.join(compared, "prev_month").select("report_month", "isin").distinct()


def rank_consensus(eligible: DataFrame, universe: DataFrame, active: DataFrame) -> DataFrame:
    """Buying and selling breadth per (month, security), with the rank position.

    Reduced to (month, isin, house) flags first and then to (month, isin), so
    distinct house counts are plain sums and a popular security never gathers
    its holders in one task. Ranks run over one month's securities: one row
    per security, whatever the number of holders.
    """
    action = F.col("action")
    buying, selling = action.isin("new", "added"), action.isin("trimmed", "exited")
    opening, exiting = action == "new", action == "exited"
    flow, effect = C.finite("flow_lakhs"), C.finite("price_effect_lakhs")
    one = lambda condition: F.max(F.when(condition, 1).otherwise(0))
    by_house = eligible.groupBy("report_month", "isin", "amc_name").agg(
        F.min("stock_name").alias("stock_name"), F.min("industry").alias("industry"),
        F.min("instrument_type").alias("instrument_type"),
        one(buying).alias("b"), one(selling).alias("s"), one(opening).alias("o"), one(exiting).alias("x"),
        F.count_if(buying).alias("nb"), F.count_if(selling).alias("ns"),
        F.count(F.lit(1)).alias("n"), F.count(flow).alias("n_flow"), F.sum(flow).alias("flow"),
        F.count_if(opening).alias("n_new"), F.count(F.when(opening, flow)).alias("n_new_flow"),
        F.sum(F.when(opening, flow)).alias("new_flow"),
        F.count(F.when(~opening, flow)).alias("n_old_flow"), F.sum(F.when(~opening, flow)).alias("old_flow"),
        F.count(effect).alias("n_effect"), F.sum(effect).alias("effect"))

    def whole(count: str | Column, known: str, total: str) -> Column:
        expected = F.sum(count)
        return (F.when(expected == 0, F.lit(0.0)).when(expected == F.sum(known), F.sum(total)))
    stats = by_house.groupBy("report_month", "isin").agg(
        F.min("stock_name").alias("stock_name"), F.min("industry").alias("industry"),
        F.min("instrument_type").alias("instrument_type"),
        F.sum("nb").alias("schemes_buying"), F.sum("ns").alias("schemes_selling"),
        F.sum("b").cast("bigint").alias("amcs_buying"), F.sum("s").cast("bigint").alias("amcs_selling"),
        F.sum("o").cast("bigint").alias("amcs_opening"), F.sum("x").cast("bigint").alias("amcs_exiting"),
        whole("n", "n_flow", "flow").alias("total_flow_lakhs"),
        whole("n_new", "n_new_flow", "new_flow").alias("new_position_flow_lakhs"),
        whole(F.col("n") - F.col("n_new"), "n_old_flow", "old_flow").alias("accumulation_flow_lakhs"),
        whole("n", "n_effect", "effect").alias("total_price_effect_lakhs"))
    known_months = universe.select("report_month").distinct().withColumn("_known", F.lit(True))
    status = (F.when(F.col("_known").isNull(), "unknown").when(F.col("_held").isNotNull(), "established")
              .otherwise("new_listing"))
    out = (stats.join(universe.withColumn("_held", F.lit(True)), ["report_month", "isin"], "left")
           .join(known_months, "report_month", "left")
           .withColumn("universe_status", status).drop("_held", "_known")
           .withColumn("is_new_to_universe", F.col("universe_status") == "new_listing")
           .withColumn("net_scheme_count", F.col("schemes_buying") - F.col("schemes_selling"))
           .withColumn("net_amc_count", F.col("amcs_buying") - F.col("amcs_selling"))
           .withColumn("buying_ratio", F.col("amcs_buying")
                       / F.greatest(F.lit(1), F.col("amcs_buying") + F.col("amcs_selling")))
           .join(active.withColumn("_scored", F.lit(True)), ["report_month", "isin"], "left"))
    for name in ACTIVE_COLUMNS[:3]:
        out = out.withColumn(name, F.when(F.col("_scored").isNull(), F.lit(0)).otherwise(F.col(name)).cast("bigint"))
    return out.drop("_scored").withColumn("rank", F.row_number().over(_month_order(buy_order())))


def buy_order() -> list[Column]:
    return [F.desc_nulls_last("net_amc_count"), F.asc("is_new_to_universe"),
            F.desc_nulls_last("accumulation_flow_lakhs"), F.asc("isin")]


def _month_order(order: list[Column]):
    return W.partitionBy("report_month").orderBy(*order)


# -- ownership filings --------------------------------------------------------------------

def filing_history(filings: DataFrame) -> DataFrame:
    """Quarterly filings of each security as one array, newest quarter first.

    A security files once per quarter, so the array is bounded by the number of quarters.
    """
    return (filings.filter(C.is_quarterly_filing("quarter_end", "filing_type"))
            .groupBy("isin").agg(F.sort_array(F.collect_list(F.struct(
                "quarter_end", C.filing_published("quarter_end", "published_at").alias("published"),
                "fii_pct", "dii_pct", C.filing_basis("published_at").alias("basis"))), asc=False).alias("_filings")))


def latest_filing_pair(rows: DataFrame, filings: DataFrame, cutoff: Column | None) -> DataFrame:
    """Add the two newest filings public on ``cutoff`` (every filing when None)."""
    visible = F.col("_filings")
    joined = rows.join(filing_history(filings), "isin", "left")
    if cutoff is not None:
        joined = joined.withColumn("_cutoff", cutoff)
        visible = F.filter("_filings", lambda f: f["published"] <= F.col("_cutoff"))
    latest, before = F.get("_v", F.lit(0)), F.get("_v", F.lit(1))
    joined = joined.withColumn("_v", visible).withColumn("_a", latest).withColumn("_b", before)
    return (joined.withColumn("shareholding_quarter_end", F.col("_a.quarter_end"))
            .withColumn("previous_shareholding_quarter_end", F.col("_b.quarter_end"))
            .withColumn("fii_pct", F.col("_a.fii_pct")).withColumn("previous_fii_pct", F.col("_b.fii_pct"))
            .withColumn("fii_pct_change", F.col("_a.fii_pct") - F.col("_b.fii_pct"))
            .withColumn("dii_pct", F.col("_a.dii_pct")).withColumn("previous_dii_pct", F.col("_b.dii_pct"))
            .withColumn("dii_pct_change", F.col("_a.dii_pct") - F.col("_b.dii_pct"))
            .withColumn("shareholding_published_basis", F.col("_a.basis"))
            .drop("_filings", "_cutoff", "_v", "_a", "_b"))


def direction(change: Column | str) -> Column:
    change = C.as_col(change)
    return F.when(change.isNull(), "no_data").when(change > 0, "increased").otherwise("decreased")


def add_shareholding_signal(rows: DataFrame, reference: Column) -> DataFrame:
    """Directions, the common-signal flag and staleness; a missing filing is no_data, never zero."""
    age = F.datediff(reference, F.col("shareholding_quarter_end"))
    return (rows.withColumn("mf_increased", F.coalesce(F.col("net_amc_count") > 0, F.lit(False)))
            .withColumn("fii_direction", direction("fii_pct_change"))
            .withColumn("dii_direction", direction("dii_pct_change"))
            .withColumn("fii_increased", F.col("fii_direction") == "increased")
            .withColumn("dii_increased", F.col("dii_direction") == "increased")
            .withColumn("fii_or_dii_increased", F.col("fii_increased") | F.col("dii_increased"))
            .withColumn("is_common", F.col("mf_increased") & F.col("fii_or_dii_increased"))
            .withColumn("is_common_with_fii_increase", F.col("is_common"))
            .withColumn("staleness_days", age.cast("double"))
            .withColumn("shareholding_stale", F.coalesce(age > STALE_AFTER_DAYS, F.lit(True))))


def with_filings(consensus: DataFrame, filings: DataFrame, as_of_date: str | None = None) -> DataFrame:
    """Consensus plus the newest filings public by each month's disclosure deadline (or a given day)."""
    cutoff = F.lit(as_of_date).cast("date") if as_of_date else C.mf_deadline("report_month")
    joined = add_shareholding_signal(latest_filing_pair(consensus, filings, cutoff), cutoff)
    return joined.withColumn("common_position", F.row_number().over(_month_order(
        [F.desc("is_common"), F.desc_nulls_last("net_amc_count"), F.asc("rank")])))


def ranked_consensus(consensus: DataFrame, filings: DataFrame) -> DataFrame:
    """Securities someone bought or sold, in rank order, with their filing signal."""
    moved = consensus.filter(F.col("schemes_buying") + F.col("schemes_selling") > 0)
    status = (F.when(F.col("shareholding_quarter_end").isNull(), "missing")
              .when(F.col("previous_shareholding_quarter_end").isNull(), "single_quarter").otherwise("available"))
    return (with_filings(moved, filings).withColumn("shareholding_status", status)
            .withColumn("rank", F.row_number().over(_month_order([F.asc("rank")]))))


def broadest_selling(ranked: DataFrame) -> DataFrame:
    order = [F.asc_nulls_last("net_amc_count"), F.asc_nulls_last("accumulation_flow_lakhs"), F.asc("rank")]
    return ranked.withColumn("sell_rank", F.row_number().over(_month_order(order)))


def page(ranked: DataFrame, number: int = 1, rows: int = PAGE_ROWS, position: str = "rank") -> DataFrame:
    return ranked.filter(F.col(position).between((number - 1) * rows + 1, number * rows))


def overlap_summary(joined: DataFrame) -> DataFrame:
    """Counts of one overlap view per month."""
    return joined.groupBy("report_month").agg(
        F.lit("ok").alias("status"), C.flag_count(F.col("is_common")).alias("common_count"),
        F.count(F.lit(1)).alias("consensus_count"), C.flag_count(F.col("shareholding_stale")).alias("stale_count"),
        C.flag_count(F.col("shareholding_quarter_end").isNull()).alias("missing_shareholding_count"))


def overlap_status(months: DataFrame, consensus: DataFrame | None, filings: DataFrame | None) -> DataFrame:
    """Overlap counts for every requested month, with no_consensus / unavailable where degraded."""
    if consensus is None:
        return months.select("report_month", F.lit("no_consensus").alias("status"),
                             F.lit(0).cast("bigint").alias("common_count"))
    if filings is None:
        return (months.join(consensus.select("report_month").distinct().withColumn("_c", F.lit(1)), "report_month", "left")
                .select("report_month", F.when(F.col("_c").isNull(), "no_consensus").otherwise("unavailable").alias("status"),
                        F.lit(0).cast("bigint").alias("common_count")))
    found = overlap_summary(with_filings(consensus, filings))
    return (months.join(found, "report_month", "left")
            .withColumn("status", F.coalesce("status", F.lit("no_consensus")))
            .withColumn("common_count", F.coalesce("common_count", F.lit(0).cast("bigint"))))


def filing_freshness(ranked: DataFrame) -> DataFrame:
    missing = F.col("shareholding_status") == "missing"
    return ranked.groupBy("report_month").agg(
        F.max("shareholding_quarter_end").alias("latest_quarter"), C.flag_count(missing).alias("missing"),
        C.flag_count(F.col("shareholding_status") == "single_quarter").alias("single_quarter"),
        C.flag_count(F.col("shareholding_stale") & ~missing).alias("stale"),
        C.flag_count(F.col("shareholding_published_basis") == "regulatory_deadline").alias("deadline_basis"))


# -- notable lists ---------------------------------------------------------------------------

def notable_lists(ranked: DataFrame, compared_months: DataFrame, side: str = "buy",
                  position: str = "rank") -> DataFrame:
    """Five rule-based lists per month in one direction, strongest first.

    ``compared_months``: months that were compared at all. A rule whose earlier
    month was never compared returns no stocks (see ``notable_needs``). Earlier
    months are looked up with a lag over the security's own months, which are
    few; a month in which the security was not ranked counts as zero.
    """
    sign = 1 if side != "sell" else -1
    own = W.partitionBy("isin").orderBy("_i")
    frame = ranked.withColumn("_i", C.month_index("report_month"))

    def earlier(back: int) -> Column:
        found = F.lit(0)
        for step in range(1, back + 1):
            found = F.when(F.lag("_i", step).over(own) == F.col("_i") - back,
                           F.lag("net_amc_count", step).over(own)).otherwise(found)
        return found
    months = compared_months.select(C.month_index("report_month").alias("_m")).distinct()
    for back in (1, 2):
        frame = (frame.withColumn(f"_n{back}", earlier(back))
                 .join(months.select((F.col("_m") + back).alias("_i"), F.lit(True).alias(f"_has{back}")), "_i", "left"))
    net = F.col("net_amc_count") * sign
    before, before2 = F.col("_n1") * sign, F.col("_n2") * sign
    has1, has2 = F.col("_has1").isNotNull(), F.col("_has2").isNotNull()
    count = F.col("amcs_opening" if sign > 0 else "amcs_exiting")
    fresh = (count >= MIN_HOUSES) & ((F.col("universe_status") != "new_listing") if sign > 0 else F.lit(True))
    choice = F.coalesce("net_active_amc_count", F.lit(0)) * sign
    weakest = F.least(net, before, before2)
    fii = F.col("fii_pct_change") * sign
    rules = [
        ("turnaround", has1 & (net >= MIN_HOUSES) & (before <= -1), net - before, F.lit(0.0)),
        ("opened" if sign > 0 else "exited", fresh, count, F.lit(0.0)),
        ("active", choice >= MIN_HOUSES, choice, F.lit(0.0)),
        ("streak", has1 & has2 & (weakest >= 1), weakest, F.lit(0.0)),
        ("fii", (net >= MIN_HOUSES) & (fii > 0) & (F.col("shareholding_status") != "missing")
         & ~F.col("shareholding_stale"), net, fii),
    ]
    entries = F.array(*[F.when(F.coalesce(mask & (net > 0), F.lit(False)), F.struct(
        F.lit(name).alias("list"), first.cast("double").alias("strength"), second.cast("double").alias("tie")))
        for name, mask, first, second in rules])
    picked = (frame.select("report_month", "isin", "stock_name", "instrument_type", "net_amc_count",
                           F.col("_n1").alias("net_before"), F.col(position).alias("_p"),
                           F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
              .select("*", "e.list", "e.strength", "e.tie"))
    order = W.partitionBy("report_month", "list").orderBy(F.desc("strength"), F.desc("tie"), F.asc("_p"))
    return picked.select("report_month", F.lit(side).alias("side"), "list", F.row_number().over(order).alias("position"),
                         "isin", "stock_name", "net_amc_count", "net_before", "strength",
                         (F.col("instrument_type") == "equity").alias("followable"))


def notable_needs(ranked: DataFrame, compared_months: DataFrame) -> DataFrame:
    """The newest earlier month each month-history rule could not read."""
    months = compared_months.select("report_month").distinct()
    asked = ranked.select("report_month").distinct()
    for back in (1, 2):
        asked = asked.join(months.select(C.shift_month("report_month", back).alias("report_month"),
                                         F.lit(True).alias(f"_has{back}")), "report_month", "left")
    turn = F.when(F.col("_has1").isNull(), C.prev_month("report_month"))
    streak = F.coalesce(turn, F.when(F.col("_has2").isNull(), C.shift_month("report_month", -2)))
    rows = F.array(F.struct(F.lit("turnaround").alias("list"), turn.alias("needs")),
                   F.struct(F.lit("streak").alias("list"), streak.alias("needs")))
    return (asked.select("report_month", F.explode(rows).alias("r")).select("report_month", "r.*")
            .filter(F.col("needs").isNotNull()))
