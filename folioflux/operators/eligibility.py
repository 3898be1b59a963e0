"""Which scheme-months and which comparisons may count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import columns as C

KEYS = ["scheme_id", "report_month"]


def bad_domestic_quantity(holdings: DataFrame, stocks: DataFrame) -> DataFrame:
    """Scheme-months with an unreadable equity quantity, whatever their stored status."""
    equity = stocks.filter(F.col("instrument_type") == "equity").select("isin")
    return (holdings.filter(C.non_negative("quantity").isNull())
            .join(equity, "isin", "left_semi").select(*KEYS).distinct())


def quarantined(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status") == "quarantined").select(*KEYS)


def withheld_scheme_months(status: DataFrame | None, bad_quantity: DataFrame) -> DataFrame:
    if status is None:
        return bad_quantity
    return quarantined(status).unionByName(bad_quantity)


def comparable_scheme_months(status: DataFrame, bad_quantity: DataFrame) -> DataFrame:
    """(scheme, month) whose month and calendar-previous month are both ok and readable.

    Each passing month votes for itself and for the month after it; a key with
    both votes is comparable. One small aggregate, no self-join.
    """
    passing = status.filter(F.col("status") == "ok").join(bad_quantity, KEYS, "left_anti")
    votes = passing.select("scheme_id", F.explode(F.array(
        F.col("report_month"), C.next_month("report_month"))).alias("report_month"))
    return votes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 2).select(*KEYS)


def comparable_months(status: DataFrame, bad_quantity: DataFrame) -> DataFrame:
    """(scheme_id, _months): the comparable months of each scheme in one array."""
    return comparable_scheme_months(status, bad_quantity).groupBy("scheme_id").agg(F.collect_set("report_month").alias("_months"))


def free_to_vote(rows: DataFrame, votes: DataFrame, status: DataFrame | None, bad_quantity: DataFrame) -> DataFrame:
    """Rows of the schemes in ``votes``, with their columns, of which neither month is withheld.

    A scheme's withheld months are one array: the rows are exchanged at most once, by scheme, and not for each of the months.
    """
    withheld = (withheld_scheme_months(status, bad_quantity).groupBy("scheme_id")
                .agg(F.collect_set("report_month").alias("_withheld")))

    def barred(month: str):
        return F.coalesce(F.array_contains("_withheld", F.col(month)), F.lit(False))
    return (rows.join(votes.join(withheld, "scheme_id", "left"), "scheme_id")
            .filter(~barred("report_month") & ~barred("prev_month")).drop("_withheld"))


def active_equity(schemes: DataFrame) -> DataFrame:
    return schemes.filter(F.col("is_active_equity") == 1)


def eligible_deltas(deltas: DataFrame, schemes: DataFrame, stocks: DataFrame, status: DataFrame | None,
                    bad_quantity: DataFrame, instrument: str | None = "equity",
                    active_only: bool = True) -> DataFrame:
    """Delta rows that vote, with stock and house attributes. A withheld month bars both its comparisons."""
    votes = active_equity(schemes) if active_only else schemes
    listed = stocks if instrument is None else stocks.filter(F.col("instrument_type") == instrument)
    rows = deltas.join(listed.select("isin", F.col("name").alias("stock_name"), "industry", "instrument_type"), "isin")
    return free_to_vote(rows, votes.select("scheme_id", "amc_name"), status, bad_quantity)


def compared_voters(deltas: DataFrame, schemes: DataFrame, stocks: DataFrame, status: DataFrame | None,
                    bad_quantity: DataFrame, active_only: bool = True) -> DataFrame:
    """(scheme_id, report_month) compared on any instrument and free to vote.

    Deltas are reduced to scheme-months before the eligibility joins.
    """
    votes = active_equity(schemes) if active_only else schemes
    months = (deltas.filter(F.col("prev_month").isNotNull()).join(stocks.select("isin"), "isin", "left_semi")
              .select(*KEYS, "prev_month").distinct())
    return free_to_vote(months, votes.select("scheme_id").distinct(), status, bad_quantity).select(*KEYS)


def voting_schemes(eligible: DataFrame) -> DataFrame:
    return eligible.select("report_month", "scheme_id", "amc_name").distinct()


def excluded_passive(deltas: DataFrame, schemes: DataFrame) -> DataFrame:
    """Passive schemes that had deltas in the month (audit list)."""
    passive = schemes.filter(F.col("is_active_equity") == 0).select("scheme_id", "amc_name", "scheme_name")
    return deltas.select(*KEYS).distinct().join(passive, "scheme_id")
