"""Who is in a month's comparison, who is left out and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import columns as C

KEYS = ["scheme_id", "report_month"]


def scheme_window(scheme_months: DataFrame, status: DataFrame, bad_quantity: DataFrame) -> DataFrame:
    """Presence, status and readability of each scheme in a month and in the calendar month before.

    Every fact votes once for its own month and once for the next, so the two
    months meet in one grouped pass over scheme-month rows.
    """
    none_text, none = F.lit(None).cast("string"), F.lit(False)
    facts = (scheme_months.select(*KEYS, F.lit(True).alias("held"), none_text.alias("status"), none.alias("bad"))
             .unionAll(status.select(*KEYS, none, F.col("status"), none))
             .unionAll(bad_quantity.select(*KEYS, none, none_text, F.lit(True))))
    votes = facts.select("scheme_id", "held", "status", "bad", F.explode(F.array(
        F.struct(F.col("report_month").alias("m"), F.lit(True).alias("now")),
        F.struct(C.next_month("report_month").alias("m"), F.lit(False).alias("now")))).alias("v"))
    now = F.col("v.now")
    return votes.groupBy("scheme_id", F.col("v.m").alias("report_month")).agg(
        F.bool_or(F.col("held") & now).alias("held_now"), F.bool_or(F.col("held") & ~now).alias("held_prev"),
        F.max(F.when(now, F.col("status"))).alias("status_now"), F.max(F.when(~now, F.col("status"))).alias("status_prev"),
        F.bool_or(F.col("bad") & now).alias("bad_now"), F.bool_or(F.col("bad") & ~now).alias("bad_prev"))


def withheld_now():
    return F.coalesce(F.col("status_now") == "quarantined", F.lit(False)) | F.col("bad_now")


def withheld_prev():
    return F.coalesce(F.col("status_prev") == "quarantined", F.lit(False)) | F.col("bad_prev")


def month_coverage(window: DataFrame, schemes: DataFrame, deltas: DataFrame, voting: DataFrame,
                   ingest_runs: DataFrame | None = None) -> DataFrame:
    """One row per loaded month: how many schemes are compared and why the others are not."""
    compared = voting.select(*KEYS, F.lit(True).alias("_cmp"))
    paired = deltas.groupBy(*KEYS).agg(F.max("prev_month").alias("_pm"))
    months = paired.groupBy("report_month").agg(F.max("_pm").alias("prev_month"))
    rows = (window.join(schemes.select("scheme_id", "amc_name", "is_active_equity"), "scheme_id")
            .join(compared, KEYS, "left").join(paired, KEYS, "left")
            .join(months, "report_month", "left"))
    active = F.col("is_active_equity") == 1
    in_scope = F.col("held_now") & active
    cmp_ = F.col("_cmp").isNotNull()
    with_deltas = F.col("_pm").isNotNull()
    withheld = in_scope & withheld_now()
    no_previous = in_scope & ~with_deltas & ~withheld
    prev_withheld = in_scope & with_deltas & withheld_prev() & ~withheld
    count = lambda condition, name: C.flag_count(condition).alias(name)
    out = rows.groupBy("report_month").agg(
        count(in_scope, "in_scope"), count(F.col("held_now"), "loaded"), count(cmp_, "compared"),
        F.count_distinct(F.when(cmp_, F.col("amc_name"))).alias("compared_amcs"), count(withheld, "withheld"),
        count(no_previous, "no_previous"), count(prev_withheld, "prev_withheld"),
        count(in_scope & ~cmp_ & ~withheld & ~no_previous & ~prev_withheld, "no_equity"),
        count(active & F.col("held_prev") & ~F.col("held_now") & F.col("prev_month").isNotNull(), "dropped_out"),
        count(in_scope & (F.col("status_now") == "ok") & ~F.col("bad_now"), "passed"),
        count(in_scope & F.col("status_now").isNull(), "not_validated"), F.max("prev_month").alias("prev_month"))
    out = (out.filter(F.col("loaded") > 0).withColumn("public_on", C.mf_deadline("report_month"))
           .withColumn("coverage_state", F.when(F.col("compared") > 0, "unknown_completeness").otherwise("unavailable")))
    if ingest_runs is not None:
        out = out.withColumn("last_ingest", ingest_runs.agg(F.max("started_at")).scalar())
    return out


def expected_fund_states(window: DataFrame, schemes: DataFrame, inventories: DataFrame, expected: DataFrame,
                         compared: DataFrame) -> DataFrame:
    """State of every eligible fund of an official inventory, per (house, month).

    A month's funds are its own eligible entries plus the previous month's
    entries not listed again. ``compared``: (scheme_id, report_month) of the
    validated comparison.
    """
    house = ["amc_name", "report_month"]
    listed = (expected.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("scheme_id").cast("string")),
                                                     F.concat(F.lit("k"), "official_key")))
              .withColumn("_eligible", (F.col("equity_eligible") == 1) & (F.col("active_eligible") == 1)))
    votes = listed.select("amc_name", "_key", "official_key", "official_name", "scheme_id", "exclusion_reason", "_eligible",
                          F.explode(F.array(F.struct(F.col("report_month").alias("m"), F.lit(0).alias("age")),
                                            F.struct(C.next_month("report_month").alias("m"), F.lit(1).alias("age")))).alias("v"))
    facts = F.struct("official_key", "official_name", "scheme_id", "exclusion_reason")
    age, eligible = F.col("v.age"), F.col("_eligible")
    funds = votes.groupBy("amc_name", F.col("v.m").alias("report_month"), "_key").agg(
        F.min_by(F.when(eligible, facts), F.when(eligible, age)).alias("f"),
        F.bool_or(eligible & (age == 0)).alias("is_current"), F.bool_or(age == 1).alias("in_prior")).filter(F.col("f").isNotNull())
    known = inventory_flags(inventories)
    active = schemes.filter(F.col("is_active_equity") == 1).select("scheme_id", F.col("amc_name").alias("_house"))
    marks = compared.select(*KEYS).distinct().withColumn("_cmp", F.lit(True))
    rows = (funds.select(*house, "f.*", "is_current", "in_prior").join(known, house)
            .join(window, KEYS, "left").join(active, "scheme_id", "left").join(marks, KEYS, "left"))
    no = F.lit(False)
    loaded = F.coalesce(F.col("held_now") & (F.col("_house") == F.col("amc_name")), no)
    held_prev = F.coalesce("held_prev", no)
    not_ok = ~(F.coalesce(F.col("status_now") == "ok", no) & F.coalesce(F.col("status_prev") == "ok", no))
    state = (F.when(F.col("scheme_id").isNull(), "identity_unresolved").when(~loaded, "missing_current")
             .when(~held_prev & F.col("inventory_known") & ~F.col("in_prior"), "not_in_previous_official_inventory")
             .when(~held_prev, "missing_previous").when(withheld_now() | withheld_prev(), "withheld")
             .when(not_ok, "not_validated").when(F.col("_cmp").isNull(), "no_usable_comparison").otherwise("compared"))
    return rows.select(*house, "official_key", "official_name", "scheme_id", "exclusion_reason", "is_current", state.alias("state"))


def inventory_flags(inventories: DataFrame) -> DataFrame:
    """(amc_name, report_month) with an inventory in the month or the month before, and how exhaustive they are."""
    sides = inventories.select("amc_name", "exhaustive", "source_url", F.explode(F.array(
        F.struct(F.col("report_month").alias("m"), F.lit(True).alias("now")),
        F.struct(C.next_month("report_month").alias("m"), F.lit(False).alias("now")))).alias("v"))
    full, now = F.col("exhaustive") == 1, F.col("v.now")
    return (sides.groupBy("amc_name", F.col("v.m").alias("report_month"))
            .agg(F.bool_or(full & now).alias("now_full"), F.bool_or(full & ~now).alias("prev_full"),
                 F.max(F.when(now, F.col("source_url"))).alias("inventory_source"))
            .withColumn("inventory_known", F.col("now_full") & F.col("prev_full")))


def house_coverage(window: DataFrame, schemes: DataFrame, inventories: DataFrame, expected: DataFrame,
                   comparison: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Official inventory against loaded, validated and compared funds for every house and loaded month."""
    house = ["amc_name", "report_month"]
    compared = comparison.select(*KEYS, "amc_name").distinct()
    states = expected_fund_states(window, schemes, inventories, expected, compared)
    per_house = states.groupBy(*house).agg(
        F.count(F.lit(1)).alias("n_expected"), C.flag_count(F.col("is_current")).alias("n_current"),
        F.bool_and(F.col("state") == "compared").alias("all_compared"))
    active = (window.join(schemes.filter(F.col("is_active_equity") == 1).select("scheme_id", "amc_name"), "scheme_id")
              .filter(F.col("held_now")))
    passed = F.coalesce(F.col("status_now") == "ok", F.lit(False)) & ~F.col("bad_now")
    loaded = active.groupBy(*house).agg(
        F.count(F.lit(1)).alias("loaded"), C.flag_count(passed).alias("validated_count"),
        C.flag_count(~F.col("held_prev")).alias("missing_previous"),
        C.flag_count(withheld_now() | withheld_prev()).alias("withheld_count"), C.flag_count(~passed).alias("not_validated_count"))
    expected_ids = states.filter(F.col("scheme_id").isNotNull()).select(*house, "scheme_id", F.lit(True).alias("_e")).distinct()
    counts = (compared.join(expected_ids, [*house, "scheme_id"], "left").groupBy(*house)
              .agg(F.count(F.lit(1)).alias("compared"), C.flag_count(F.col("_e").isNull()).alias("n_extra")))
    out_of_scope = (expected.filter(~((F.col("equity_eligible") == 1) & (F.col("active_eligible") == 1)))
                    .groupBy(*house).agg(F.count(F.lit(1)).alias("out_of_scope")))
    names = schemes.select("amc_name").unionAll(inventories.select("amc_name"))
    if registry is not None:
        names = names.unionAll(registry.select("amc_name"))
    months = window.filter(F.col("held_now")).agg(F.collect_set("report_month").alias("m")).scalar()
    spine = names.distinct().select("amc_name", F.explode(months).alias("report_month"))
    zero = F.lit(0).cast("bigint")
    joined = spine
    for part in (inventory_flags(inventories), per_house, loaded, counts, out_of_scope):
        joined = joined.join(part, house, "left")
    known = F.coalesce("inventory_known", F.lit(False))
    compared_n = F.coalesce("compared", zero)
    extras = F.when(known, F.coalesce("n_extra", zero)).otherwise(zero)
    state = (F.when(compared_n == 0, "unavailable").when(~known, "unknown_completeness")
             .when(F.coalesce("all_compared", F.lit(False)) & (extras == 0), "complete").otherwise("partial"))
    return joined.select(
        *house, state.alias("coverage_state"), known.alias("inventory_known"),
        F.when(known, F.coalesce("n_expected", zero)).alias("expected"),
        F.when(F.coalesce("now_full", F.lit(False)), F.coalesce("n_current", zero)).alias("expected_current"),
        *[F.coalesce(c, zero).alias(c) for c in ("loaded", "validated_count")], compared_n.alias("compared"),
        extras.alias("outside_inventory"),
        *[F.coalesce(c, zero).alias(c) for c in ("out_of_scope", "missing_previous", "withheld_count", "not_validated_count")],
        "inventory_source")


def loaded_fund_list(scheme_months: DataFrame, schemes: DataFrame, status: DataFrame, comparison: DataFrame) -> DataFrame:
    """Every loaded fund of the audit with its validation state and whether it was compared."""
    marks = comparison.select(*KEYS).distinct().withColumn("_c", F.lit(True))
    return (scheme_months.join(schemes, "scheme_id").join(status, KEYS, "left").join(marks, KEYS, "left")
            .select("amc_name", "report_month", "scheme_id", "scheme_name", "scheme_title",
                    (F.col("is_active_equity") == 1).alias("active"),
                    F.coalesce("status", F.lit("not_validated")).alias("validation"), F.col("_c").isNotNull().alias("compared")))


def data_inventory(holdings: DataFrame, deltas: DataFrame) -> DataFrame:
    counts = (holdings.groupBy("report_month", "scheme_id").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("report_month").agg(F.count(F.lit(1)).alias("schemes"), F.sum("n").alias("holdings")))
    marks = deltas.select("report_month").distinct().withColumn("_d", F.lit(True))
    return counts.join(marks, "report_month", "left").select("report_month", "schemes", "holdings", F.col("_d").isNotNull().alias("has_deltas"))


def inventory_lists(holdings: DataFrame, deltas: DataFrame, filings: DataFrame, withheld: DataFrame) -> DataFrame:
    """(part, period, scheme_id, latest): loaded and compared months, filing quarters and quarantined scheme-months."""
    none = F.lit(None).cast("bigint")

    def listed(part: str, df: DataFrame, column: str) -> DataFrame:
        period = F.col(column).cast("string")
        last = df.agg(F.max(period)).scalar()
        return df.filter(period.isNotNull()).select(period.alias("period")).distinct().select(
            F.lit(part).alias("part"), "period", none.alias("scheme_id"), (F.col("period") == last).alias("latest"))
    return (listed("month", holdings, "report_month").unionByName(listed("delta_month", deltas, "report_month"))
            .unionByName(listed("quarter", filings, "quarter_end"))
            .unionByName(withheld.select(F.lit("quarantined").alias("part"), F.col("report_month").alias("period"), "scheme_id", F.lit(False).alias("latest"))))


# -- source backing ---------------------------------------------------------------------------------

def source_backed(holdings: DataFrame, stocks: DataFrame, status: DataFrame, snapshot_sources: DataFrame,
                  disclosure_sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Validated scheme-months whose every held equity has an original row in a recorded workbook."""
    recorded = snapshot_sources.join(disclosure_sources.select(F.col("sha256").alias("source_sha256")), "source_sha256", "left_semi")
    rows = (evidence.join(recorded, [*KEYS, "source_sha256", "parser_version"], "left_semi")
            .select(*KEYS, "isin").distinct())
    equity = stocks.filter(F.col("instrument_type") == "equity").select("isin")
    held = holdings.select(*KEYS, "isin").join(equity, "isin", "left_semi")
    candidates = status.filter(F.col("status") == "ok").select(*KEYS).join(recorded, KEYS, "left_semi")
    unbacked = held.join(rows, [*KEYS, "isin"], "left_anti")
    return candidates.join(held, KEYS, "left_semi").join(unbacked, KEYS, "left_anti")


def activation_candidates(comparison: DataFrame, backed: DataFrame) -> DataFrame:
    """Compared funds of each month: usable when both snapshots are source-backed, else the reason."""
    compared = comparison.select(*KEYS, "prev_month").distinct()
    now = backed.select(*KEYS).withColumn("_n", F.lit(True))
    before = backed.select("scheme_id", F.col("report_month").alias("prev_month")).withColumn("_p", F.lit(True))
    joined = compared.join(now, KEYS, "left").join(before, ["scheme_id", "prev_month"], "left")
    state = (F.when(F.col("_n").isNull(), "current_not_source_backed")
             .when(F.col("_p").isNull(), "previous_not_source_backed").otherwise("usable"))
    return joined.select("report_month", "scheme_id", state.alias("state"))
