"""Plain-language summaries of one scheme-month, and the facts behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import classify as K
from folioflux.functions import columns as C
from folioflux.operators.coverage import withheld_now, withheld_prev

KEYS = ["scheme_id", "report_month"]

# Actions a summary may describe, names listed per exit line, smallest price effect told (lakhs).
VALID_ACTIONS = ("new", "added", "trimmed", "exited", "unchanged")
NAMES_SHOWN = 5
MATERIAL_PRICE_LAKHS = 5.0


def assess_summary(deltas: DataFrame, stocks: DataFrame, window: DataFrame) -> DataFrame:
    """Why each compared or loaded scheme-month may not be summarised; NULL reason = eligible.

    ``window``: presence, status and readability of each scheme in a month and the month before.
    """
    optional = ("value_change_lakhs", "pct_nav_change", "flow_lakhs", "price_effect_lakhs")
    broken = C.finite("qty_change").isNull() | ~F.coalesce(F.col("action").isin(*VALID_ACTIONS), F.lit(False))
    for name in optional:
        broken = broken | (F.col(name).isNotNull() & C.finite(name).isNull())
    equity = F.coalesce(F.col("instrument_type") == "equity", F.lit(False))
    facts = (deltas.join(stocks.select("isin", "instrument_type"), "isin", "left").groupBy(*KEYS).agg(
        F.lit(True).alias("_any"), F.bool_or(equity & broken).alias("_invalid"),
        F.bool_or(F.col("instrument_type").isNull()).alias("_untyped"), C.flag_count(equity).alias("_equity")))
    rows = window.filter(F.col("held_now")).join(facts, KEYS, "left")
    no = F.lit(False)
    any_ = F.coalesce("_any", no)
    reason = (F.when(withheld_now() | (any_ & withheld_prev()), "quarantined")
              .when(F.coalesce("_invalid", no), "nonfinite_or_invalid_data")
              .when(~F.coalesce(F.col("status_now") == "ok", no), "unvalidated")
              .when(F.coalesce("_untyped", no), "unknown_instrument_type")
              .when(F.coalesce("_equity", F.lit(0)) == 0, "no_data"))
    return rows.select(*KEYS, reason.alias("reason"))


def _leader(action: str, largest: bool) -> list[Column]:
    """Count, leading row and pricing flag of one action; flow leads, value change stands in when no flow is known."""
    is_action = F.col("action") == action
    fields = F.struct("stock_name", "qty_change", "flow_lakhs", "value_change_lakhs", "price_effect_lakhs", "pct_nav_change")
    sign = -1.0 if largest else 1.0

    def first_by(value: str) -> Column:
        known = is_action & F.col(value).isNotNull()
        return F.min_by(F.when(known, fields), F.when(known, F.struct(F.col(value) * sign, F.col("isin"))))
    any_row = F.min_by(F.when(is_action, fields), F.when(is_action, F.col("isin")))
    n = F.count_if(is_action)
    n_flow, n_value = F.count_if(is_action & F.col("flow_lakhs").isNotNull()), F.count_if(is_action & F.col("value_change_lakhs").isNotNull())
    return [n.alias(f"n_{action}"), F.coalesce(first_by("flow_lakhs"), first_by("value_change_lakhs"), any_row).alias(f"top_{action}"),
            (F.when(n_flow > 0, n_flow).otherwise(n_value) == n).alias(f"priced_{action}")]


def summary_facts(deltas: DataFrame, stocks: DataFrame, instrument: str | None = "equity") -> DataFrame:
    """Per scheme-month: counts and leaders of each action, and the exits by size (five names and the rest)."""
    listed = stocks if instrument is None else stocks.filter(F.col("instrument_type") == instrument)
    rows = deltas.join(listed.select("isin", K.stock_label("name").alias("stock_name")), "isin")
    gone = F.col("action") == "exited"
    stats = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"), *_leader("new", True), *_leader("added", True), *_leader("trimmed", False),
        F.count_if(gone).alias("n_exited"), F.max(F.when(gone, F.col("flow_lakhs").isNotNull())).alias("_flow"))
    # Flow orders the exits where any is known; all but the first names are left behind before anything is gathered.
    exits = rows.filter(gone).join(stats.select(*KEYS, "_flow"), KEYS)
    amount = F.when(F.col("_flow"), F.col("flow_lakhs")).otherwise(F.col("value_change_lakhs"))
    order = W.partitionBy(*KEYS).orderBy(amount.isNull(), amount, "isin", "stock_name")
    first = exits.withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= NAMES_SHOWN).groupBy(*KEYS).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_p", "stock_name"))), lambda x: x["stock_name"]).alias("exit_names"))
    return (stats.drop("_flow").join(first, KEYS, "left").withColumn("exit_names", F.coalesce("exit_names", F.array().cast("array<string>")))
            .withColumn("exits_more", F.greatest(F.lit(0), F.col("n_exited") - NAMES_SHOWN).cast("bigint")))


def _detail(top: str, with_price: bool) -> Column:
    flow, value, price = F.col(f"{top}.flow_lakhs"), F.col(f"{top}.value_change_lakhs"), F.col(f"{top}.price_effect_lakhs")
    text = (F.when(flow.isNotNull() & value.isNotNull(), F.concat(F.lit(" ("), K.rupee_crore(flow), F.lit(" flow, "), K.rupee_crore(value), F.lit(" value change)")))
            .when(value.isNotNull(), F.concat(F.lit(" ("), K.rupee_crore(value), F.lit(")")))
            .when(flow.isNotNull(), F.concat(F.lit(" ("), K.rupee_crore(flow), F.lit(" flow)"))).otherwise(""))
    if not with_price:
        return text
    full = F.concat(F.lit(" ("), K.rupee_crore(flow), F.lit(" flow, "), K.rupee_crore(price), F.lit(" price effect, "),
                    K.rupee_crore(value), F.lit(" value change)"))
    return F.when(flow.isNotNull() & value.isNotNull() & (F.abs(price) >= MATERIAL_PRICE_LAKHS), full).otherwise(text)


def _exit_line(prefix: str) -> Column:
    names = F.concat_ws(", ", "exit_names")
    more = F.when(F.col("exits_more") > 0, F.concat(F.lit(", and "), F.col("exits_more").cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.col("n_exited") > 0, F.concat(F.lit(f"- {prefix}: "), names, more, F.lit(".")))


def _action_lines() -> list[Column]:
    value = F.coalesce("top_new.flow_lakhs", "top_new.value_change_lakhs")
    position = F.when(value.isNotNull(), F.format_string("a ₹%.1f Cr position", value / K.LAKHS_PER_CRORE)).otherwise(
        F.concat(F.format_number("top_new.qty_change", 0), F.lit(" shares; value unavailable")))
    weight = F.when(F.col("top_new.pct_nav_change").isNotNull(), F.format_string("%.2f%% of NAV", "top_new.pct_nav_change")).otherwise("NAV weight unavailable")

    def count(name: str) -> Column:
        return F.col(f"n_{name}").cast("string")

    def shares(name: str) -> Column:
        return F.format_number(F.abs(F.col(f"top_{name}.qty_change")), 0)
    opened = F.concat(F.lit("- Opened "), count("new"), F.lit(" new position(s). "),
                      F.when(F.col("priced_new"), "The largest new entry was ").otherwise("One new entry was "),
                      F.col("top_new.stock_name"), F.lit(", "), position, F.lit(" ("), weight, F.lit(")"), _detail("top_new", False), F.lit("."))
    added = F.concat(F.lit("- Added to "), count("added"), F.lit(" existing position(s). "),
                     F.when(F.col("priced_added"), "The biggest addition was ").otherwise("One addition was "),
                     F.col("top_added.stock_name"), F.lit(", up "), shares("added"), F.lit(" shares"), _detail("top_added", True), F.lit("."))
    trimmed = F.concat(F.lit("- Trimmed "), count("trimmed"), F.lit(" position(s). "),
                       F.when(F.col("priced_trimmed"), "The largest cut was ").otherwise("One cut was "),
                       F.col("top_trimmed.stock_name"), F.lit(", down "), shares("trimmed"), F.lit(" shares"), _detail("top_trimmed", True), F.lit("."))
    return [F.when(F.col("n_new") > 0, opened), F.when(F.col("n_added") > 0, added),
            F.when(F.col("n_trimmed") > 0, trimmed), _exit_line("Fully exited")]


def render_summary(facts: DataFrame, schemes: DataFrame, other_facts: DataFrame | None = None) -> DataFrame:
    """Summary text per scheme-month. ``other_facts``: facts of the non-equity rows, told apart from equity activity."""
    label = K.scheme_label("scheme_name", "scheme_title")
    title = F.concat(label, F.lit(" ("), F.col("amc_name"), F.lit(") — "), F.col("report_month"), F.lit(" portfolio changes:"))
    rows = facts
    lines = F.array_compact(F.array(*_action_lines()))
    quiet = F.array(F.lit("- No material changes versus the previous month."))
    body = F.when(F.size(lines) > 0, lines).otherwise(quiet)
    rows = rows.withColumn("_body", body)
    if other_facts is not None:
        changed = F.concat(
            F.lit("- Non-equity holdings (money-market/bond maturities, not equity calls): "), F.col("n_rows").cast("string"), F.lit(" change(s) ("),
            F.col("n_new").cast("string"), F.lit(" new, "), F.col("n_added").cast("string"), F.lit(" added, "),
            F.col("n_trimmed").cast("string"), F.lit(" trimmed, "), F.col("n_exited").cast("string"), F.lit(" exited)."))
        other = other_facts.select(*KEYS, F.array_compact(F.array(changed, _exit_line("Non-equity exits (maturities, not equity exits)"))).alias("_other"))
        none = F.array().cast("array<string>")
        rows = rows.select(*KEYS, "_body").join(other, KEYS, "full_outer").withColumn("_body", F.concat(
            F.coalesce("_body", F.array(F.lit("- No material equity changes versus the previous month."))), F.coalesce("_other", none)))
    return (rows.join(schemes.select("scheme_id", "amc_name", "scheme_name", "scheme_title"), "scheme_id")
            .select(*KEYS, F.concat_ws("\n", F.concat(F.array(title), F.col("_body"))).alias("text")))


def scheme_summaries(deltas: DataFrame, stocks: DataFrame, schemes: DataFrame, window: DataFrame) -> DataFrame:
    """Text, eligibility and reason of every loaded scheme-month; withheld months say why instead of showing numbers."""
    state = assess_summary(deltas, stocks, window)
    told = render_summary(summary_facts(deltas, stocks), schemes)
    label = K.scheme_label("scheme_name", "scheme_title")
    head = F.concat(label, F.lit(" ("), F.col("amc_name"), F.lit(") — "), F.col("report_month"))
    cause = F.when(F.col("reason") == "quarantined", "the current or referenced previous month is quarantined").otherwise(
        "holding-change data contains invalid numeric values or actions")
    withheld = F.concat(head, F.lit(" data withheld: "), cause, F.lit(". Not zero activity — the numbers did not pass checks."))
    empty = F.concat(F.lit("No holding-change data available for "), label, F.lit(" in "), F.col("report_month"),
                     F.lit(" yet (data may not have been ingested for this month, or this is the first month tracked)."))
    rows = (state.join(told, KEYS, "left")
            .join(schemes.select("scheme_id", "amc_name", "scheme_name", "scheme_title"), "scheme_id"))
    text = (F.when(F.col("reason").isin("quarantined", "nonfinite_or_invalid_data"), withheld)
            .otherwise(F.coalesce("text", empty)))
    return rows.select(*KEYS, text.alias("text"), F.col("reason").isNull().alias("eligible"), "reason")


def digest(summaries: DataFrame, scheme_ids: DataFrame | None = None) -> DataFrame:
    """Summaries of the chosen schemes with their order in the month's digest; the text stays one row per scheme."""
    chosen = summaries if scheme_ids is None else summaries.join(scheme_ids, "scheme_id", "left_semi")
    counts = chosen.groupBy("report_month").agg(F.count(F.lit(1)).alias("_n"))
    head = F.concat(F.lit("Monthly digest — "), F.col("report_month"), F.lit(" ("), F.col("_n").cast("string"), F.lit(" scheme(s))"))
    return chosen.join(counts, "report_month").select("report_month", "scheme_id", head.alias("header"), "text")
