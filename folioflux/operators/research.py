"""Look-ahead-free backtests of the monthly ranking and of quarterly ownership changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.operators.exact import exact_median
from folioflux.sources.staging import cut

# Group names, thresholds and bands of the two tests.
GROUPS = ("mf_and_fii", "mf_only", "mf_neutral", "mf_selling")
ACTIVE_GROUPS = ("active_and_fii", "active_only", "active_neutral", "active_selling")
QUARTER_GROUPS = ("mf_up_fii_up", "mf_up_only", "mf_flat", "mf_down", "mf_top_q", "mf_bottom_q")
EVIDENCE_GROUPS = ("mf_up_fii_up", "mf_up_only", "mf_down")
DECISION_LAG_DAYS = 30
THRESHOLD_PP = 0.25
FIFTHS, SIZE_BANDS, MIN_SIZED = 5, 3, 15
ITERATIONS = 5000
ITERATION_RANGE = 100    # iterations of a month dealt to a task together
UNIVERSE = "universe"    # all securities of a month as a group
FINDING_T = 2.0


# -- holding periods ------------------------------------------------------------------------

def close_days(targets: DataFrame, prices_daily: DataFrame, target: str, out: str, latest_ok: Column | None = None) -> DataFrame:
    """First trading day on or after ``target`` and at most ten days later; optionally the latest stored day.

    Prices are first reduced to their distinct trading days, a calendar-sized
    table; each target then looks up its eleven candidate days by equality.
    """
    days = prices_daily.select(F.col("trade_date").alias("_day")).distinct()
    window = F.sequence(F.col(target), F.date_add(target, C.MAX_TRADING_GAP_DAYS))
    wanted = targets.select(target).distinct()
    found = (wanted.select(target, F.explode(window).alias("_day")).join(days, "_day")
             .groupBy(target).agg(F.min("_day").alias(out)))
    joined = targets.join(found, target, "left")
    if latest_ok is None:
        return joined
    latest = days.agg(F.max("_day")).scalar()
    return joined.withColumn(out, F.coalesce(F.col(out), F.when(latest_ok, latest)))


def holding_periods(months: DataFrame, prices_daily: DataFrame, today: str) -> DataFrame:
    """Entry and exit days of each signal month, with the reason when it cannot be scored."""
    now = F.lit(today).cast("date")
    rows = months.select("report_month", C.mf_entry_date("report_month").alias("entry_target"),
                         C.mf_entry_date(C.next_month("report_month")).alias("exit_target")).distinct()
    rows = rows.withColumn("partial_period", F.col("exit_target") > now)
    rows = close_days(rows, prices_daily, "entry_target", "entry_date")
    rows = close_days(rows, prices_daily, "exit_target", "exit_date", F.col("partial_period"))
    return _with_reason(rows, now)


def _with_reason(rows: DataFrame, now: Column) -> DataFrame:
    rows = rows.withColumn("exit_date", F.when(F.col("entry_date").isNull() | (F.col("exit_date") > F.col("entry_date")), F.col("exit_date")))
    reason = (F.when(F.col("entry_target") > now, "not_public_yet").when(F.col("entry_date").isNull(), "no_entry_close")
              .when(F.col("exit_date").isNull(), "no_exit_close"))
    missing = (F.when(reason == "no_entry_close", F.col("entry_target"))
               .when(reason == "no_exit_close", F.when(F.col("partial_period"), now).otherwise(F.col("exit_target"))))
    return rows.withColumn("reason", reason).withColumn("missing_date", missing)


def priced_panel(rows: DataFrame, periods: DataFrame, key: str, prices_daily: DataFrame, with_turnover: bool = False) -> DataFrame:
    """Rows of scorable periods with their entry and exit closes; unpriced securities are dropped, not zeroed."""
    scored = periods.filter(F.col("reason").isNull()).select(key, "entry_date", "exit_date", "partial_period")
    entry = prices_daily.filter(F.col("close_price") > 0).select(
        "isin", F.col("trade_date").alias("entry_date"), F.col("close_price").alias("px_in"),
        *([F.col("traded_value")] if with_turnover else []))
    exit_ = prices_daily.filter(F.col("close_price") > 0).select(
        "isin", F.col("trade_date").alias("exit_date"), F.col("close_price").alias("px_out"))
    return (rows.join(scored, key).join(entry, ["isin", "entry_date"]).join(exit_, ["isin", "exit_date"])
            .withColumn("ret", F.col("px_out") / F.col("px_in") - 1.0))


# -- monthly ranking ------------------------------------------------------------------------------

def signal_group() -> Column:
    net = F.col("net_amc_count")
    return F.when(net > 0, F.when(F.col("is_common"), "mf_and_fii").otherwise("mf_only")).when(net == 0, "mf_neutral").otherwise("mf_selling")


def active_group() -> Column:
    net = F.coalesce("net_active_amc_count", F.lit(0))
    return (F.when(net > 0, F.when(F.col("is_common") & (F.col("net_amc_count") > 0), "active_and_fii").otherwise("active_only"))
            .when(net == 0, "active_neutral").otherwise("active_selling"))


def signal_groups(joined: DataFrame) -> DataFrame:
    return joined.withColumn("group", signal_group()).withColumn("active_group", active_group())


def build_panel(joined: DataFrame, periods: DataFrame, prices_daily: DataFrame) -> DataFrame:
    return priced_panel(signal_groups(joined), periods, "report_month", prices_daily)


def by_group(panel: DataFrame, *columns: str) -> DataFrame:
    """One row per (security, group name)."""
    return panel.withColumn("group_name", F.explode(F.array(*columns)))


def evaluate(panel: DataFrame) -> DataFrame:
    """Per (month, group): size, mean, median, excess over the universe, win and beat-median rates."""
    key = ["report_month"]
    # The universe is a group like the others, so one selection gives every median.
    rows = cut(panel.select(*key, "ret", "partial_period", F.explode(F.array(F.lit(UNIVERSE), "group", "active_group")).alias("group_name")))
    medians = cut(exact_median(rows, [*key, "group_name"], "ret").drop("n"))
    universe = medians.filter(F.col("group_name") == UNIVERSE).select(*key, F.col("median").alias("universe_median"))
    stats = rows.join(universe, key).groupBy(*key, "group_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(F.when(F.col("ret") > F.col("universe_median"), 1.0).otherwise(0.0)).alias("beat_universe_rate"),
        F.first("partial_period").alias("partial_period")).join(medians, [*key, "group_name"])
    stats = cut(stats)
    base = stats.filter(F.col("group_name") == UNIVERSE).select(
        *key, F.col("n").alias("universe_n"), F.col("mean").alias("universe_mean"), "partial_period", F.col("median").alias("universe_median"))
    spine = base.select("*", F.explode(F.array(*map(F.lit, GROUPS + ACTIVE_GROUPS))).alias("group_name"))
    return (spine.join(stats.drop("partial_period"), [*key, "group_name"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
            .withColumn("excess_mean", F.col("mean") - F.col("universe_mean"))
            .withColumn("excess_median", F.col("median") - F.col("universe_median")))


def new_listings(panel: DataFrame) -> DataFrame:
    new = F.coalesce("is_new_to_universe", F.lit(False))
    return panel.groupBy("report_month").agg(C.flag_count(new).alias("n"), F.avg(F.when(new, F.col("ret"))).alias("mean"))


def permutation_p(panel: DataFrame, iterations: int = ITERATIONS, seed: int = 0) -> DataFrame:
    """Share of random same-size subsets whose mean return reaches the group's.

    Every iteration orders a month's securities by a seeded digest; the sum of the first n is a random subset of size n,
    so one ordering serves all groups of the month. A month is one universe of securities, held in a row; rows are dealt
    by month and range of iterations, ordered and added up inside the row, and only hits are shuffled.
    """
    key = ["report_month"]
    groups = by_group(panel, "group", "active_group").groupBy(*key, "group_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 12).alias("observed"))
    months = panel.groupBy(*key).agg(F.collect_list(F.struct("isin", "ret")).alias("rows"))
    groups = groups.join(months.select(*key, F.size("rows").alias("total")), key).filter(F.col("n") < F.col("total"))
    wanted = groups.groupBy(*key).agg(F.collect_list(F.struct("group_name", "n", "observed")).alias("groups"))
    ranges = F.sequence(F.lit(1), F.lit(iterations), F.lit(ITERATION_RANGE))
    last = F.least(F.col("first") + (ITERATION_RANGE - 1), F.lit(iterations))
    dealt = months.join(wanted, key).withColumn("first", F.explode(ranges)).repartition(*key, "first") \
        .select(*key, "rows", "groups", F.explode(F.sequence("first", last)).alias("iteration"))
    digest = lambda x: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("iteration").cast("string"), x["isin"]))
    order = F.array_sort(F.transform("rows", lambda x: F.struct(digest(x).alias("h"), x["isin"].alias("isin"), x["ret"].alias("ret"))))
    total = lambda n: F.aggregate(F.slice("order", 1, n), F.lit(0.0), lambda a, x: a + x["ret"])
    hits = F.transform("groups", lambda g: F.struct(
        g["group_name"].alias("group_name"), F.when(F.round(total(g["n"].cast("int")) / g["n"], 12) >= g["observed"], 1).otherwise(0).alias("hit")))
    drawn = dealt.withColumn("order", order).select(*key, F.explode(hits).alias("h"))
    return drawn.groupBy(*key, F.col("h.group_name").alias("group_name")).agg((F.sum("h.hit") / F.lit(iterations)).alias("p_vs_random"))


def pooled(results: DataFrame, names: tuple[str, ...], excess: str = "excess_mean", size: str = "n") -> DataFrame:
    """Across complete periods: mean excess, periods won and the t statistic of each group."""
    usable = (~F.col("partial_period")) & (F.col(size) > 0)
    x = F.when(usable, F.col(excess))
    stats = results.filter(F.col("group_name").isin(*names)).groupBy("group_name").agg(
        F.count(x).alias("periods"), F.avg(x).alias("mean_excess"), C.flag_count(F.round(x, 12) > 0).alias("periods_won"), F.stddev_samp(x).alias("_sd"))
    t = F.col("mean_excess") / (F.col("_sd") / F.sqrt(F.col("periods")))
    return stats.select("group_name", "periods", "mean_excess", "periods_won",
                        F.when((F.col("periods") >= 2) & (F.col("_sd") > 0), t).alias("t_stat"))


def track_record(results: DataFrame, periods: DataFrame) -> DataFrame:
    """Every compared month: its scored groups, or the reason and the missing date."""
    dates = periods.select("report_month", "entry_date", "exit_date")
    scored = (results.filter(F.col("n") > 0).join(dates, "report_month")
              .select("report_month", "entry_date", "exit_date", "partial_period", "group_name", "n", "excess_mean",
                      F.lit(None).cast("string").alias("reason"), F.lit(None).cast("date").alias("missing_date")))
    none = F.lit(None)
    unscored = (periods.filter(F.col("reason").isNotNull())
                .select("report_month", "entry_date", "exit_date", "partial_period", none.cast("string").alias("group_name"),
                        none.cast("bigint").alias("n"), none.cast("double").alias("excess_mean"), "reason", "missing_date"))
    return scored.unionByName(unscored)


# -- quarterly ownership ---------------------------------------------------------------------------------

def quarterly_history(filings: DataFrame) -> DataFrame:
    return (filings.filter(C.is_quarterly_filing("quarter_end", "filing_type"))
            .select("isin", "quarter_end", "mf_pct", "fii_pct", C.filing_published("quarter_end", "published_at").alias("published"),
                    C.filing_basis("published_at").alias("basis")))


def quarter_panel(filings: DataFrame, lag_days: int = DECISION_LAG_DAYS, threshold: float = THRESHOLD_PP,
                  require_observed: bool = False) -> DataFrame:
    """Ownership changes and group of each (quarter, security), from filings public on the decision day."""
    own = W.partitionBy("isin").orderBy("quarter_end")
    fields = F.struct("quarter_end", "mf_pct", "fii_pct", "published", "basis")
    rows = quarterly_history(filings).withColumn("_p", F.lag(fields).over(own)).withColumn("_d", C.decision_date("quarter_end", lag_days))
    usable = (F.col("published") <= F.col("_d")) & (F.col("_p.published") <= F.col("_d"))
    if require_observed:
        usable = usable & (F.col("basis") == "observed") & (F.col("_p.basis") == "observed")
    rows = rows.filter(usable & (F.col("_p.quarter_end") == C.shift_quarter("quarter_end", -1))
                       & F.col("mf_pct").isNotNull() & F.col("_p.mf_pct").isNotNull())
    d_mf, d_fii = F.col("mf_pct") - F.col("_p.mf_pct"), F.col("fii_pct") - F.col("_p.fii_pct")
    fii_up = F.coalesce(F.col("d_fii") >= threshold, F.lit(False))
    group = (F.when(F.col("d_mf") >= threshold, F.when(fii_up, "mf_up_fii_up").otherwise("mf_up_only"))
             .when(F.col("d_mf") <= -threshold, "mf_down").otherwise("mf_flat"))
    return rows.select("quarter_end", "isin", d_mf.alias("d_mf"), d_fii.alias("d_fii")).withColumn("group", group)


def quarter_audit(filings: DataFrame, lag_days: int = DECISION_LAG_DAYS, require_observed: bool = False) -> DataFrame:
    in_time = F.col("published") <= C.decision_date("quarter_end", lag_days)
    observed = F.col("basis") == "observed"
    public = in_time & observed if require_observed else in_time
    return quarterly_history(filings).groupBy("quarter_end").agg(
        F.count(F.lit(1)).alias("filed"), C.flag_count(public).alias("public_by_decision"), C.flag_count(~in_time).alias("late_excluded"),
        C.flag_count(public & ~observed).alias("deadline_basis"))


def quarter_periods(quarters: DataFrame, prices_daily: DataFrame, today: str, lag_days: int = DECISION_LAG_DAYS) -> DataFrame:
    now = F.lit(today).cast("date")
    rows = quarters.select("quarter_end").distinct().select(
        "quarter_end", C.decision_date("quarter_end", lag_days).alias("decision"),
        C.first_tradable(C.decision_date("quarter_end", lag_days)).alias("entry_target"),
        C.first_tradable(C.decision_date(C.shift_quarter("quarter_end", 1), lag_days)).alias("exit_target"))
    rows = rows.withColumn("partial_period", F.col("exit_target") > now)
    rows = close_days(rows, prices_daily, "entry_target", "entry_date")
    rows = close_days(rows, prices_daily, "exit_target", "exit_date", F.col("partial_period"))
    out = _with_reason(rows, now)
    return out.withColumn("reason", F.when(F.col("decision") >= now, "decision_not_reached").otherwise(F.col("reason")))


def equal_bins(rank: Column, n: Column, bins: int) -> Column:
    """0-based quantile bin of a 1-based rank among n, edges included in the lower bin."""
    return F.greatest(F.lit(0), F.floor(((rank - 1) * bins + n - 2) / (n - 1)).cast("int") - 1)


def score_quarters(panel: DataFrame, periods: DataFrame, prices_daily: DataFrame) -> DataFrame:
    """Per (quarter, group): size, mean return, excess, and excess against the same turnover band.

    Ranks run over one quarter's priced securities (one row per security).
    """
    priced = priced_panel(panel, periods, "quarter_end", prices_daily, with_turnover=True)
    quarter = W.partitionBy("quarter_end")
    sized = F.col("traded_value") > 0
    rows = (priced.withColumn("_n", F.count(F.lit(1)).over(quarter))
            .withColumn("_rank", F.row_number().over(quarter.orderBy("d_mf", "isin")))
            .withColumn("_sized", F.coalesce(sized, F.lit(False)))
            .withColumn("_ns", F.sum(F.col("_sized").cast("int")).over(quarter))
            .withColumn("_srank", F.row_number().over(W.partitionBy("quarter_end", "_sized").orderBy("traded_value", "isin")))
            .withColumn("_fifth", F.when(F.col("_n") >= FIFTHS, equal_bins(F.col("_rank"), F.col("_n"), FIFTHS)).otherwise(-1))
            .withColumn("_band", F.when(F.col("_sized") & (F.col("_ns") >= MIN_SIZED), equal_bins(F.col("_srank"), F.col("_ns"), SIZE_BANDS)))
            .withColumn("_adj", F.when(F.col("_band").isNotNull(), F.col("ret") - F.avg("ret").over(W.partitionBy("quarter_end", "_band"))))
            .withColumn("_base", F.avg("ret").over(quarter)))
    names = F.array_compact(F.array(F.col("group"), F.when(F.col("_fifth") == FIFTHS - 1, "mf_top_q"), F.when(F.col("_fifth") == 0, "mf_bottom_q")))
    stats = (rows.withColumn("group_name", F.explode(names)).groupBy("quarter_end", "group_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), (F.avg("ret") - F.first("_base")).alias("excess_mean"),
        F.count("_adj").alias("n_size"), F.avg("_adj").alias("excess_size"), F.first("partial_period").alias("partial_period"),
        F.first("_n").alias("universe_n"), F.first("_base").alias("universe_mean")))
    return stats


def size_neutral(results: DataFrame) -> DataFrame:
    """The same results with each group's excess replaced by its size-adjusted one."""
    return results.withColumn("n", F.col("n_size")).withColumn("excess_mean", F.col("excess_size"))


def evidence_table(results: DataFrame) -> DataFrame:
    """Pooled raw and size-neutral excess of the evidence groups, and whether it is a finding."""
    raw = pooled(results, EVIDENCE_GROUPS).select("group_name", "periods", F.col("mean_excess").alias("raw_mean"), F.col("t_stat").alias("raw_t"))
    sized = pooled(size_neutral(results), EVIDENCE_GROUPS).select(
        "group_name", F.col("periods").alias("sized_periods"), F.col("mean_excess").alias("sized_mean"), F.col("t_stat").alias("sized_t"))
    return raw.join(sized, "group_name", "left").withColumn(
        "finding", F.when(F.abs("sized_t") >= FINDING_T, F.when(F.col("sized_t") > 0, "beats").otherwise("lags")))
