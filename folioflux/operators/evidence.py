"""Auditable views of the adjusted comparison: evidence, watchlist, history and stock detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import classify as K
from folioflux.functions import columns as C
from folioflux.operators.compare import NET_TOLERANCE
from folioflux.operators.coverage import withheld_now, withheld_prev

KEYS = ["scheme_id", "report_month"]
LARGEST_CHANGES = 3
MIN_SEARCH_CHARS = 2


def public_url(url: Column | str) -> Column:
    """Only web links are published, never file paths."""
    url = C.as_col(url)
    return F.when(url.rlike(r"^https?://[^/]+"), url)


def snapshot_evidence(requests: DataFrame, holdings: DataFrame, status: DataFrame, snapshot_sources: DataFrame,
                      disclosure_sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sources and original rows for each requested (scheme_id, report_month, isin).

    Arrays stay small: the workbooks behind one snapshot, and the rows of one security in it.
    """
    key3 = [*KEYS, "isin"]
    sources = (snapshot_sources.join(disclosure_sources.withColumnRenamed("sha256", "source_sha256"), "source_sha256")
               .groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(
                   F.col("source_sha256").alias("sha256"), F.col("workbook_name").alias("workbook"),
                   public_url("source_url").alias("url"), "retrieved_at", "published_at",
                   F.when(F.coalesce(F.col("published_at") != "", F.lit(False)), "observed").otherwise("unknown").alias("publication_basis"),
                   "parser_version"))).alias("sources")))
    rows = (evidence.join(snapshot_sources, [*KEYS, "source_sha256", "parser_version"], "left_semi")
            .groupBy(*key3).agg(F.sort_array(F.collect_list(F.struct(
                F.col("source_sha256").alias("sha256"), "sheet", F.col("row_number").alias("row"),
                F.col("raw_json").alias("raw"), F.col("normalized_json").alias("normalized")))).alias("rows")))
    held = holdings.select(*key3, F.lit(True).alias("_held"))
    joined = (requests.join(status.withColumnRenamed("status", "_status"), KEYS, "left").join(sources, KEYS, "left")
              .join(rows, key3, "left").join(held, key3, "left"))
    provenance = (F.when(F.col("sources").isNull(), "unavailable").when(F.col("rows").isNotNull(), "available")
                  .when(F.col("_held").isNotNull(), "incomplete").otherwise("absent_from_loaded_snapshot"))
    return joined.select(*key3, F.coalesce("_status", F.lit("not_validated")).alias("validation"), "sources", "rows",
                         provenance.alias("provenance_status"))


def stock_evidence(comparison: DataFrame, by_house: bool = False) -> DataFrame:
    """Totals of the compared contributions per (month, isin) or (month, isin, house)."""
    keys = ["report_month", "isin", *(["amc_name"] if by_house else [])]
    change = F.col("qty_change")
    return comparison.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("funds"), F.sum("raw_quantity_prev").alias("raw_previous_shares"),
        F.sum("quantity_prev").alias("adjusted_previous_shares"), F.sum("quantity_curr").alias("current_shares"),
        F.sum(change).alias("net_share_change"), F.sum(F.greatest(change, F.lit(0.0))).alias("gross_added_shares"),
        F.sum(F.greatest(-change, F.lit(0.0))).alias("gross_reduced_shares"), C.strict_sum("flow_lakhs").alias("net_flow_lakhs"))


def house_directions(comparison: DataFrame) -> DataFrame:
    """Houses buying and selling per (month, isin), schemes netted within each house."""
    net = comparison.groupBy("report_month", "isin", "amc_name").agg(F.sum("qty_change").alias("n"))
    return net.groupBy("report_month", "isin").agg(
        C.flag_count(F.col("n") > NET_TOLERANCE).alias("houses_buying"),
        C.flag_count(F.col("n") < -NET_TOLERANCE).alias("houses_selling"))


def largest_changes(comparison: DataFrame, n: int = LARGEST_CHANGES) -> DataFrame:
    """The n largest share changes per (month, isin).

    The rank filter is applied per task before the shuffle, so a popular
    security ships n rows per task, not all its holders.
    """
    order = W.partitionBy("report_month", "isin").orderBy(F.desc(F.abs("qty_change")), F.asc("scheme_id"))
    return (comparison.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
            .select("report_month", "isin", "position", "scheme_id", "qty_change", "flow_lakhs"))


def watchlist_report(requests: DataFrame, comparison: DataFrame, stocks: DataFrame) -> DataFrame:
    """Status and totals of each requested (report_month, isin)."""
    keys = ["report_month", "isin"]
    moves = comparison.groupBy(*keys).agg(
        C.flag_count((F.col("quantity_prev") == 0) & (F.col("quantity_curr") > 0)).alias("additions"),
        C.flag_count((F.col("quantity_prev") > 0) & (F.col("quantity_curr") == 0)).alias("exits"))
    top = largest_changes(comparison).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "position", "scheme_id", F.col("qty_change").alias("shares"), "flow_lakhs"))).alias("largest_compared_changes"))
    joined = (requests.join(stocks.select("isin", "name"), "isin", "left").join(stock_evidence(comparison), keys, "left")
              .join(house_directions(comparison), keys, "left").join(moves, keys, "left").join(top, keys, "left"))
    still = F.abs("net_share_change") <= NET_TOLERANCE
    state = (F.when(F.col("name").isNull(), "unknown_stock").when(F.col("funds").isNull(), "unavailable")
             .when(still & (F.col("gross_added_shares") + F.col("gross_reduced_shares") > NET_TOLERANCE),
                   "net_unchanged_with_opposing_changes")
             .when(still, "unchanged_in_compared_funds").otherwise("changed"))
    return joined.select(*keys, F.coalesce("name", "isin").alias("name"), state.alias("status"), "houses_buying", "houses_selling",
                         "net_share_change", "net_flow_lakhs", "additions", "exits", "largest_compared_changes")


# -- fixed-cohort history ---------------------------------------------------------------------------

def history_cohort(comparison: DataFrame, months: list[str]) -> DataFrame:
    """Schemes with a usable comparison in every month after the first."""
    return (comparison.filter(F.col("report_month").isin(months[1:])).select(*KEYS).distinct()
            .groupBy("scheme_id").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == len(months) - 1).select("scheme_id"))


def cohort_token(cohort: DataFrame, release_id: str, start: str, end: str, active_only: bool = True,
                 amc: str | None = None) -> DataFrame:
    """A one-row scope token: order-independent digest of the cohort with the request's parameters."""
    half = F.conv(F.substring(F.md5(F.col("scheme_id").cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    digest = cohort.agg(F.count(F.lit(1)).alias("cohort_count"), F.sum(half).alias("_sum"))
    scope = F.to_json(F.struct(F.lit(release_id).alias("release"), F.lit(start).alias("start"), F.lit(end).alias("end"),
                               F.lit(active_only).alias("active"), F.lit(amc).alias("amc"), "cohort_count",
                               F.col("_sum").cast("string").alias("digest")))
    return digest.select("cohort_count", F.sha2(scope, 256).alias("token"))


def stock_history(comparison: DataFrame, holdings: DataFrame, stocks: DataFrame, start: str, end: str,
                  evidence: DataFrame | None = None, snapshot_sources: DataFrame | None = None) -> DataFrame:
    """Monthly shares and net changes of every security over one fixed cohort."""
    months = C.month_list(start, end)
    keys = ["report_month", "isin"]
    cohort = history_cohort(comparison, months)
    inside = comparison.filter(F.col("report_month").isin(months[1:])).join(cohort, "scheme_id", "left_semi")
    shares = (holdings.filter(F.col("report_month").isin(months)).join(cohort, "scheme_id", "left_semi")
              .groupBy(*keys).agg(F.sum("quantity").alias("_shares")))
    moves = inside.groupBy(*keys).agg(
        F.sum("qty_change").alias("_net"), C.strict_sum("flow_lakhs").alias("_flow"), F.lit(True).alias("_any"),
        F.sort_array(F.collect_set(F.when(F.col("adjustment_basis") != "none", F.col("adjustment_basis")))).alias("_adj"))
    spine = stocks.select("isin", "instrument_type", F.explode(F.array(*map(F.lit, months))).alias("report_month"))
    rows = (spine.join(shares, keys, "left").join(moves, keys, "left").join(house_directions(inside), keys, "left")
            .withColumn("funds", cohort.agg(F.count(F.lit(1))).scalar()))
    if evidence is not None and snapshot_sources is not None:
        revised = (evidence.filter(F.col("report_month").isin(months)).join(cohort, "scheme_id", "left_semi")
                   .join(snapshot_sources.select(*KEYS, "source_sha256"), [*KEYS, "source_sha256"], "left_anti")
                   .select(*keys).distinct().withColumn("_rev", F.lit(True)))
        rows = rows.join(revised, keys, "left")
    else:
        rows = rows.withColumn("_rev", F.lit(None).cast("boolean"))
    usable = (F.col("funds") > 0) & (F.col("instrument_type") == "equity")
    later = usable & (F.col("report_month") != start)
    held = F.coalesce("_shares", F.lit(0.0))
    zero = F.lit(0).cast("bigint")
    out = rows.select(
        *keys, F.when(usable, "validated_fixed_cohort").otherwise("unavailable").alias("status"),
        F.when(usable, held).alias("shares"), F.when(usable, F.col("funds")).otherwise(zero).alias("funds"),
        F.when(later, F.coalesce("_net", F.lit(0.0))).alias("net_share_change"),
        F.when(later, F.when(F.col("_any").isNull(), F.lit(0.0)).otherwise(F.col("_flow"))).alias("net_flow_lakhs"),
        F.when(later, F.coalesce("houses_buying", zero)).alias("houses_buying"),
        F.when(later, F.coalesce("houses_selling", zero)).alias("houses_selling"),
        F.when(usable, F.coalesce("_adj", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("adjustments"),
        (usable & F.col("_rev").isNotNull()).alias("source_revision"))
    most = F.max("shares").over(W.partitionBy("isin"))
    return out.withColumn("bar_percent", F.when((most > 0) & F.col("shares").isNotNull(), 100 * F.col("shares") / most).otherwise(F.lit(0.0)))


def history_evidence(comparison: DataFrame, holdings: DataFrame, stocks: DataFrame, start: str, end: str,
                     month: str) -> DataFrame:
    """Evidence totals of one month restricted to the cohort; the first month lists holdings only."""
    months = C.month_list(start, end)
    cohort = history_cohort(comparison, months)
    equity = stocks.filter(F.col("instrument_type") == "equity").select("isin")
    if month == start:
        return (holdings.filter(F.col("report_month") == month).join(cohort, "scheme_id", "left_semi")
                .groupBy("report_month", "isin").agg(F.count(F.lit(1)).alias("funds"), F.sum("quantity").alias("current_shares"))
                .join(equity, "isin", "left_semi"))
    inside = comparison.filter(F.col("report_month") == month).join(cohort, "scheme_id", "left_semi")
    totals = stock_evidence(inside).drop("report_month")
    numbers = [c for c in totals.columns if c != "isin"]
    joined = equity.join(totals, "isin", "left")
    seen = F.col("funds").isNotNull()
    return joined.select(F.lit(month).alias("report_month"), "isin",
                         *[F.when(seen, F.col(c)).otherwise(F.lit(0).cast(joined.schema[c].dataType)).alias(c) for c in numbers])


# -- stock detail and lookups ----------------------------------------------------------------------------

def stock_detail(holdings: DataFrame, deltas: DataFrame, window: DataFrame, schemes: DataFrame, validated: bool = True) -> DataFrame:
    """Every holding with its change, or the reason the change may not be shown."""
    keys = [*KEYS, "isin"]
    change = deltas.select(*keys, "prev_month", "action", "qty_change", "flow_lakhs", "value_change_lakhs")
    before = holdings.select("scheme_id", "isin", C.next_month("report_month").alias("report_month"),
                             F.lit(True).alias("_had"), F.col("market_value_lakhs").alias("_v0"))
    rows = (holdings.join(change, keys, "left").join(before, keys, "left").join(window, KEYS, "left")
            .join(schemes.select("scheme_id", "amc_name", K.scheme_label("scheme_name", "scheme_title").alias("label")), "scheme_id"))
    adjacent = F.coalesce(F.col("prev_month") == C.prev_month("report_month"), F.lit(False))
    has_prev = F.col("prev_month").isNotNull()
    now = F.coalesce("status_now", F.lit("not_validated"))
    prior = F.when(has_prev, F.coalesce("status_prev", F.lit("not_validated"))).otherwise("not_validated")
    state = (F.when((now == "quarantined") | (prior == "quarantined"), "withheld")
             .when(F.col("bad_now") | (has_prev & F.col("bad_prev")), "withheld")
             .when(~adjacent | ~F.col("held_prev"), "unavailable")
             .when(F.lit(validated) & ((now != "ok") | (prior != "ok")), "not_validated")
             .when(F.col("action").isNull(), "unavailable")
             .otherwise("available" if validated else "not_run"))
    shown = F.col("comparison_status").isin("available", "not_run")
    value, old = C.non_negative("market_value_lakhs"), C.non_negative("_v0")
    priced = value.isNotNull() & (F.col("_had").isNull() | ~has_prev | old.isNotNull())
    rows = rows.withColumn("comparison_status", state)
    return rows.select(
        *keys, "amc_name", "label", "quantity", "market_value_lakhs", "pct_nav", now.alias("validation_status"),
        prior.alias("previous_validation_status"), "comparison_status",
        F.when(shown, F.col("action")).alias("action"), F.when(shown, F.col("qty_change")).alias("qty_change"),
        F.when(shown & priced, F.col("flow_lakhs")).alias("flow_lakhs"),
        F.when(shown & priced, F.col("value_change_lakhs")).alias("value_change_lakhs"))


def filings_of_stock(filings: DataFrame) -> DataFrame:
    """Quarterly filings with their publication date, newest first within a security."""
    order = W.partitionBy("isin").orderBy(F.desc("quarter_end"))
    return (filings.filter(C.is_quarterly_filing("quarter_end", "filing_type"))
            .select("isin", "quarter_end", "promoter_pct", "fii_pct", "dii_pct", "public_pct",
                    C.filing_published("quarter_end", "published_at").alias("published_on"),
                    C.filing_basis("published_at").alias("published_basis"), F.row_number().over(order).alias("position")))


GRAMS = (2, 3)      # lengths of the pieces names and ISINs are looked up by


def name_postings(stocks: DataFrame) -> DataFrame:
    """(gram, field, isin): the pieces of two and three characters of every security's lower-cased name and ISIN.

    Stored in order of the piece, so that a search reads only the files and row groups of its own pieces.
    """
    def pieces(of: Column, n: int) -> Column:
        starts = F.when(F.length(of) >= n, F.sequence(F.lit(1), F.length(of) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(of, i, F.lit(n)))
    rows = stocks.select("isin", F.explode(F.array(F.struct(F.lit("name").alias("field"), F.lower("name").alias("text")), F.struct(F.lit("isin").alias("field"), F.lower("isin").alias("text")))).alias("f"))
    grams = rows.filter(F.col("f.text").isNotNull()).select(
        F.explode(F.concat(*[pieces(F.col("f.text"), n) for n in GRAMS])).alias("gram"), "f.field", "isin").distinct()
    return grams.repartitionByRange("gram").sortWithinPartitions("gram")


def holder_counts(holdings: DataFrame) -> DataFrame:
    """(report_month, isin, n): schemes holding each security in each month, and in any month where the month is NULL."""
    rows = holdings.select("report_month", "isin", "scheme_id").distinct()
    ever = rows.select("isin", "scheme_id").distinct().groupBy("isin").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("report_month", "isin").agg(F.count(F.lit(1)).alias("n")).unionByName(ever.withColumn("report_month", F.lit(None).cast("string")))


def name_candidates(postings: DataFrame, text: str) -> DataFrame:
    """(isin): securities whose name or ISIN has every piece of the text; few, and a superset of those that match."""
    lowered = text.lower()
    size = min(len(lowered), GRAMS[-1])
    grams = sorted({lowered[i:i + size] for i in range(len(lowered) - size + 1)})
    found = postings.filter(F.col("gram").isin(*grams)).groupBy("field", "isin").agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") == len(grams)).select("isin").distinct()


def find_stocks(stocks: DataFrame, postings: DataFrame, counts: DataFrame, text: str, month: str | None = None, limit: int = 12) -> DataFrame:
    """Securities whose name contains the text or whose ISIN starts with it, best match first.

    ``postings`` and ``counts`` are the stored ``name_postings`` and ``holder_counts``: a request looks its pieces up,
    verifies the candidates and reads their counts.
    """
    wanted = text.strip().replace("%", "").replace("_", "")
    label = K.stock_label("name")
    pattern = wanted.replace("\\", "\\\\")
    if len(wanted) < MIN_SEARCH_CHARS:
        matches = stocks.limit(0)
    else:
        matches = stocks.join(name_candidates(postings, wanted), "isin", "left_semi").filter(
            F.col("name").ilike(f"%{pattern}%") | F.col("isin").ilike(f"{pattern}%"))
    held = counts.filter(F.col("report_month").isNull() if month is None else F.col("report_month") == month).select("isin", F.col("n").alias("_n"))
    return (matches.join(held, "isin", "left")
            .select("isin", label.alias("name"), "industry", F.coalesce("_n", F.lit(0).cast("bigint")).alias("schemes_holding"),
                    label.ilike(f"{pattern}%").alias("_starts"), (F.col("instrument_type") == "equity").alias("_eq"), F.col("name").alias("_raw"))
            .orderBy(F.desc("_starts"), F.desc("_eq"), F.desc("schemes_holding"), F.asc("_raw"), F.asc("isin")).limit(limit)
            .select("isin", "name", "industry", "schemes_holding"))


def scheme_catalog(schemes: DataFrame, scheme_months: DataFrame | None = None) -> DataFrame:
    """Schemes (held in each month when given) with their label and whether they vote."""
    base = schemes if scheme_months is None else schemes.join(scheme_months, "scheme_id")
    extra = [] if scheme_months is None else ["report_month"]
    return base.select(*extra, "scheme_id", "amc_name", "scheme_name", K.scheme_label("scheme_name", "scheme_title").alias("label"),
                       F.coalesce(F.col("is_active_equity") != 0, F.lit(True)).alias("votes"))
