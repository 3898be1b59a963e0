"""Month-over-month comparison of holdings (all adjacent months in one job)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.functions.classify import SPLIT_RATIOS

CELLS = ("quantity", "market_value_lakhs", "pct_nav")
NET_TOLERANCE = 1e-6

# Tolerances of split detection.
CANDIDATE_TOLERANCE = 0.05
SPLIT_QTY_TOLERANCE = 0.02
SPLIT_PRICE_TOLERANCE = 0.15

DELTA_COLUMNS = ("scheme_id", "isin", "report_month", "prev_month", "qty_change", "value_change_lakhs",
                 "flow_lakhs", "price_effect_lakhs", "pct_nav_change", "action")


def _cell(side: str, column: str) -> Column:
    """Absent row -> 0; unreadable cell of a present row -> NULL."""
    value = F.col(f"{side}.{column}")
    clean = C.non_negative(value) if column == "quantity" else C.finite(value)
    return F.when(F.col(side).isNull(), F.lit(0.0)).otherwise(clean)


def pair_months(holdings: DataFrame) -> DataFrame:
    """One row per (scheme, isin, month) held in the month or the calendar month before.

    Only schemes with a snapshot in both months are paired. Holdings are exchanged
    once, by scheme: whether the neighbouring months are loaded is a count over a
    scheme's rows of that month, and each security's own months are put side by
    side with one lag/lead pass -- instead of joining the table with itself.
    """
    scheme = W.partitionBy("scheme_id").orderBy("_i")
    own = W.partitionBy("scheme_id", "isin").orderBy("_i")
    here = F.struct(*CELLS)

    def loaded(by: int) -> Column:
        return F.count(F.lit(1)).over(scheme.rangeBetween(by, by)) > 0
    rows = (holdings.select("scheme_id", "isin", C.month_index("report_month").alias("_i"), *CELLS)
            .filter(F.col("scheme_id").isNotNull() & F.col("_i").isNotNull()).repartition("scheme_id")
            .withColumns({"_loaded_before": loaded(-1), "_loaded_after": loaded(1)})
            .select("scheme_id", "isin", "_i", "_loaded_before", "_loaded_after", here.alias("_h"))
            .withColumn("_before", F.when(F.lag("_i").over(own) == F.col("_i") - 1, F.lag("_h").over(own)))
            .withColumn("_last", F.coalesce(F.lead("_i").over(own) != F.col("_i") + 1, F.lit(True))))
    nothing = F.lit(None).cast(rows.schema["_h"].dataType)
    held = F.struct(F.col("_i").alias("i"), F.col("_before").alias("prev"), F.col("_h").alias("curr"))
    gone = F.struct((F.col("_i") + 1).alias("i"), F.col("_h").alias("prev"), nothing.alias("curr"))
    sides = F.array_compact(F.array(F.when(F.col("_loaded_before"), held), F.when(F.col("_last") & F.col("_loaded_after"), gone)))
    paired = rows.withColumn("_pair", F.explode(sides)).select("scheme_id", "isin", "_pair.*")

    def month_text(i: Column) -> Column:
        return F.format_string("%04d-%02d", F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"))
    return paired.select(
        "scheme_id", "isin", month_text(F.col("i")).alias("report_month"),
        month_text(F.col("i") - 1).alias("prev_month"),
        F.col("prev").isNotNull().alias("in_prev"), F.col("curr").isNotNull().alias("in_curr"),
        *[_cell("prev", c).alias(f"{c}_prev") for c in CELLS],
        *[_cell("curr", c).alias(f"{c}_curr") for c in CELLS])


def change_columns(q_prev: Column, q_curr: Column, in_prev: Column, in_curr: Column) -> dict[str, Column]:
    """The change legs of paired rows, given (possibly split-adjusted) quantities."""
    v_prev, v_curr = F.col("market_value_lakhs_prev"), F.col("market_value_lakhs_curr")
    unknown = q_prev.isNull() | q_curr.isNull()
    qty_change = q_curr - q_prev
    value_change = v_curr - v_prev
    opened, closed = in_curr & ~in_prev, in_prev & ~in_curr
    both_zero = (q_prev <= 0) & (q_curr <= 0)
    action = (F.when(unknown, "unavailable").when(opened, "new").when(closed, "exited")
              .when(qty_change > 0, "added").when(qty_change < 0, "trimmed").otherwise("unchanged"))
    flow = (F.when(unknown, F.lit(None).cast("double"))
            .when(both_zero & (v_prev.isNull() | v_curr.isNull()), F.lit(None).cast("double"))
            .when(opened, v_curr)
            .when(both_zero, F.lit(0.0))
            .when(closed | (q_curr <= 0), -v_prev)
            .otherwise(qty_change * (v_curr / F.when(q_curr > 0, q_curr))))
    clean_exit = (q_curr <= 0) & (v_curr == 0) & value_change.isNotNull() & flow.isNotNull()
    effect = F.when(clean_exit, F.lit(0.0)).otherwise(value_change - flow)
    return {"qty_change": qty_change, "value_change_lakhs": value_change, "flow_lakhs": flow,
            "price_effect_lakhs": effect, "pct_nav_change": F.col("pct_nav_curr") - F.col("pct_nav_prev"),
            "action": action}


def diff_pairs(pairs: DataFrame) -> DataFrame:
    legs = change_columns(F.col("quantity_prev"), F.col("quantity_curr"), F.col("in_prev"), F.col("in_curr"))
    return pairs.select("scheme_id", "isin", "report_month", "prev_month",
                        *[expr.alias(name) for name, expr in legs.items()])


def deltas_all_months(holdings: DataFrame) -> DataFrame:
    return diff_pairs(pair_months(holdings))


def diff_holdings(prev: DataFrame, curr: DataFrame, prev_label: str, curr_label: str) -> DataFrame:
    """Compare two given snapshots (schemes present in both)."""
    keys = ["scheme_id", "isin"]
    both = prev.select("scheme_id").distinct().join(curr.select("scheme_id").distinct(), "scheme_id", "left_semi")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*CELLS).alias(name))
    pairs = (side(prev, "prev").join(side(curr, "curr"), keys, "full_outer").join(both, "scheme_id", "left_semi")
             .select(*keys, F.lit(curr_label).alias("report_month"), F.lit(prev_label).alias("prev_month"),
                     F.col("prev").isNotNull().alias("in_prev"), F.col("curr").isNotNull().alias("in_curr"),
                     *[_cell("prev", c).alias(f"{c}_prev") for c in CELLS],
                     *[_cell("curr", c).alias(f"{c}_curr") for c in CELLS]))
    return diff_pairs(pairs)


def compute_deltas(holdings: DataFrame, prev_label: str, curr_label: str) -> DataFrame:
    """diff_holdings over two stored months; the months must be adjacent."""
    require_adjacent(prev_label, curr_label)
    return diff_holdings(holdings.filter(F.col("report_month") == prev_label),
                         holdings.filter(F.col("report_month") == curr_label), prev_label, curr_label)


def require_adjacent(previous: str, current: str) -> None:
    year, month = int(current[:4]), int(current[5:7])
    before = f"{year - (month == 1):04d}-{(month - 2) % 12 + 1:02d}"
    if previous != before:
        raise ValueError(f"{previous} is not the calendar month before {current}")


def unmatched_schemes(holdings: DataFrame) -> DataFrame:
    """Per month: schemes with a snapshot in only one of the month and the month before.

    Months are the adjacent calendar pairs in which at least one scheme is loaded on each side.
    """
    months = (holdings.select("scheme_id", "report_month").distinct()
              .withColumn("i", C.month_index("report_month")))
    loaded = months.select("i").distinct()
    pairs = loaded.join(loaded.select((F.col("i") + 1).alias("i")), "i", "left_semi")
    sides = (months.select("scheme_id", F.explode(F.array(
        F.struct(F.col("i").alias("i"), F.lit(1).alias("curr")),
        F.struct((F.col("i") + 1).alias("i"), F.lit(0).alias("curr")))).alias("s"))
        .groupBy("scheme_id", "s.i").agg(F.max("s.curr").alias("in_curr"), F.min("s.curr").alias("lowest")))
    side = F.when((F.col("in_curr") == 1) & (F.col("lowest") == 1), "only_curr").when(F.col("in_curr") == 0, "only_prev")
    return (sides.withColumn("side", side).filter(F.col("side").isNotNull())
            .join(pairs, "i", "left_semi")
            .select(F.format_string("%04d-%02d", F.floor(F.col("i") / 12).cast("int"),
                                    (F.col("i") % 12 + 1).cast("int")).alias("report_month"), "side", "scheme_id"))


# -- splits ------------------------------------------------------------------------

def split_candidate(prev_qty: Column, prev_px: Column, curr_qty: Column, curr_px: Column,
                    tolerance: float = CANDIDATE_TOLERANCE) -> Column:
    """First split ratio matched by both the quantity and the price move, else NULL."""
    usable = (prev_qty > 0) & (prev_px > 0) & (curr_qty > 0) & (curr_px > 0)
    qty_ratio, px_ratio = curr_qty / prev_qty, curr_px / prev_px
    found = F.lit(None).cast("double")
    for k in reversed(SPLIT_RATIOS):
        near = ((F.round(F.abs(qty_ratio - k) / k, 9) <= tolerance)
                & (F.round(F.abs(px_ratio - 1 / k) / (1 / k), 9) <= tolerance))
        found = F.when(usable & near, F.lit(k)).otherwise(found)
    return found


def split_statistics(matched: Column) -> list[Column]:
    """Aggregates that decide a split, over the rows of one (month, security) held on both sides."""
    q0, q1 = F.col("quantity_prev"), F.col("quantity_curr")
    v0, v1 = F.col("market_value_lakhs_prev"), F.col("market_value_lakhs_curr")
    unreadable = F.coalesce((q0 < 0) | (q1 < 0) | (v0 < 0) | (v1 < 0), F.lit(True))
    considered = matched & (q0 > 0) & (v0 > 0) & (q1 > 0) & (v1 > 0)
    ratio = F.when(considered, q1 / q0)
    return [F.bool_or(matched & unreadable).alias("veto"), F.count(ratio).alias("n"),
            *[F.sum(F.when(considered, c)).alias(n) for n, c in (("q0", q0), ("q1", q1), ("v0", v0), ("v1", v1))],
            *[F.max(F.round(F.abs(ratio - k) / k, 9)).alias(f"gap{i}") for i, k in enumerate(SPLIT_RATIOS)]]


def agreed_ratio(unreadable_veto: bool = True) -> Column:
    """First ratio all holders and the price agree on, from ``split_statistics`` columns; NULL when none."""
    price_ratio = (F.col("v1") / F.col("q1")) / (F.col("v0") / F.col("q0"))
    found = F.lit(None).cast("double")
    for i, k in reversed(list(enumerate(SPLIT_RATIOS))):
        agreed = ((F.col(f"gap{i}") <= SPLIT_QTY_TOLERANCE)
                  & (F.round(F.abs(price_ratio * k - 1.0), 9) <= SPLIT_PRICE_TOLERANCE))
        found = F.when(agreed, F.lit(k)).otherwise(found)
    allowed = ~F.col("veto") if unreadable_veto else F.lit(True)
    return F.when(allowed & (F.col("n") > 0), found)


def infer_split_ratios(pairs: DataFrame, unreadable_veto: bool = True) -> DataFrame:
    """(report_month, isin, split_ratio) shared by every holder of both months.

    ``pairs`` carries in_prev/in_curr and both sides' quantity and value as
    reported; one unreadable holder vetoes the inference (not under the legacy rules). Everything is a
    map-side-combined aggregate, so a security held by most schemes is reduced
    to one partial row per task before the shuffle.
    """
    stats = pairs.filter(F.col("in_prev") & F.col("in_curr")).groupBy("report_month", "isin").agg(*split_statistics(F.lit(True)))
    return (stats.withColumn("split_ratio", agreed_ratio(unreadable_veto))
            .filter(F.col("split_ratio").isNotNull()).select("report_month", "isin", "split_ratio"))


def confirmed_splits(actions: DataFrame) -> DataFrame:
    return (actions.filter((F.col("confirmed") == 1) & (F.col("ratio") > 0))
            .groupBy(F.col("effective_month").alias("report_month"), "isin")
            .agg(F.max("ratio").alias("confirmed_ratio")))


def split_ratios(pairs: DataFrame, actions: DataFrame | None, unreadable_veto: bool = True) -> DataFrame:
    """Inferred ratios overridden by confirmed ones: (report_month, isin, split_ratio, adjustment_basis)."""
    inferred = infer_split_ratios(pairs, unreadable_veto)
    if actions is None:
        return inferred.withColumn("adjustment_basis", F.lit("inferred"))
    both = inferred.join(confirmed_splits(actions), ["report_month", "isin"], "full_outer")
    return both.select("report_month", "isin",
                       F.coalesce("confirmed_ratio", "split_ratio").alias("split_ratio"),
                       F.when(F.col("confirmed_ratio").isNotNull(), "confirmed").otherwise("inferred")
                       .alias("adjustment_basis"))


# -- validated comparison ----------------------------------------------------------------

def comparison_rows(pairs: DataFrame, schemes: DataFrame, stocks: DataFrame, status: DataFrame,
                    bad_quantity: DataFrame, actions: DataFrame | None = None,
                    active_only: bool = True) -> DataFrame:
    """Split-adjusted contributions of every validated equity comparison, all months.

    Both months of a scheme must be stored as ok and free of unreadable equity quantities. A scheme's comparable months are
    one array, so the pairs are exchanged at most once, by scheme.
    """
    from folioflux.operators.eligibility import comparable_months
    votes = schemes.filter(F.col("is_active_equity") == 1) if active_only else schemes
    equity = stocks.filter(F.col("instrument_type") == "equity").select("isin", F.col("name").alias("stock_name"))
    voters = votes.select("scheme_id", "amc_name").join(comparable_months(status, bad_quantity), "scheme_id")
    rows = (pairs.join(equity, "isin").join(voters, "scheme_id")
            .filter(F.array_contains("_months", F.col("report_month"))).drop("_months"))
    # An absent side counts as a zero holding here, so every row is matched.
    matched = rows.withColumn("in_prev", F.lit(True)).withColumn("in_curr", F.lit(True))
    ratios = split_ratios(matched, actions)
    ratio = F.coalesce("split_ratio", F.lit(1.0))
    rows = (rows.join(ratios, ["report_month", "isin"], "left")
            .withColumn("raw_quantity_prev", F.col("quantity_prev"))
            .withColumn("quantity_prev", F.col("quantity_prev") * ratio)
            .withColumn("split_ratio", ratio)
            .withColumn("adjustment_basis", F.coalesce("adjustment_basis", F.lit("none"))))
    # Both sides of a compared pair are rows here, absent ones holding zeros,
    # so no leg is treated as newly opened: a zero side gives the same flow.
    legs = change_columns(F.col("quantity_prev"), F.col("quantity_curr"), F.lit(True), F.lit(True))
    legs.pop("action")
    return rows.select(
        "report_month", "prev_month", "scheme_id", "isin", "amc_name", "stock_name", "in_prev", "in_curr",
        "raw_quantity_prev", "quantity_prev", "quantity_curr",
        "market_value_lakhs_prev", "market_value_lakhs_curr", "split_ratio", "adjustment_basis",
        *[expr.alias(name) for name, expr in legs.items()])
