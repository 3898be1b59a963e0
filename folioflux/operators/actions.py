"""Corporate-action evidence, price coverage and staleness of derived results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import columns as C
from folioflux.operators.compare import split_candidate
from folioflux.operators.exact import leave_one_out_median
from folioflux.sources.staging import cut

# Detector label of a peer-agreed candidate.
PEER_DETECTOR = "peer_ratio_agreement"


def previous_snapshots(holdings: DataFrame) -> DataFrame:
    """(scheme_id, report_month, prev_month): each snapshot's latest earlier one, adjacent or not."""
    own = W.partitionBy("scheme_id").orderBy("report_month")
    return (holdings.select("scheme_id", "report_month").distinct()
            .withColumn("prev_month", F.lag("report_month").over(own)))


def peer_median_ratios(holdings: DataFrame) -> DataFrame:
    """(scheme_id, isin, report_month, prev_month, ratio, peer_median_ratio).

    Peers of a row are the other schemes holding the security in the same two
    months. The leave-one-out median comes from order statistics of the whole
    group, so the work is linear in the holders of a security.
    """
    wanted = cut(previous_snapshots(holdings).filter(F.col("prev_month").isNotNull()))
    pairs = wanted.select("report_month", "prev_month").distinct()
    adjacent = F.col("prev_month") == C.prev_month("report_month")
    positive = holdings.select("scheme_id", "isin", "report_month", C.non_negative("quantity").alias("quantity")).filter(F.col("quantity") > 0)
    own = W.partitionBy("scheme_id", "isin").orderBy("report_month")
    lagged = positive.withColumn("prev_month", F.lag("report_month").over(own)).withColumn("q0", F.lag("quantity").over(own))
    # Neighbouring months come from the row before; only comparisons over a gap, which few months have, are looked up.
    near = lagged.filter(adjacent).join(pairs, ["report_month", "prev_month"], "left_semi")
    before = positive.select("scheme_id", "isin", F.col("report_month").alias("prev_month"), F.col("quantity").alias("q0"))
    far = positive.join(pairs.filter(~adjacent), "report_month").join(before, ["scheme_id", "isin", "prev_month"])
    columns = ["scheme_id", "isin", "report_month", "prev_month", C.finite(F.col("quantity") / F.col("q0")).alias("ratio")]
    # Counted and ordered: computed once.
    ratios = cut(near.select(*columns).unionByName(far.select(*columns)).filter(F.col("ratio").isNotNull()))
    medians = leave_one_out_median(ratios, ["isin", "report_month", "prev_month"], "ratio", "peer_median_ratio")
    # A row a snapshot, yet a fraction of a byte each once written: by its file's size it would be broadcast with millions of rows.
    return medians.join(wanted.hint("merge"), ["scheme_id", "report_month", "prev_month"], "left_semi")


def corporate_action_candidates(issues: DataFrame, holdings: DataFrame, actions: DataFrame) -> DataFrame:
    """New unconfirmed split candidates: peer agreement plus an inverse price move.

    ``issues`` are gate issues carrying isin and prev_month. A stored record of
    the same security and month is never overridden; of several agreeing
    schemes the lowest scheme_id's ratio is stored.
    """
    agreed = (issues.filter(F.col("code") == "qty_ratio_corporate_action_candidate")
              .select("scheme_id", "isin", "report_month", "prev_month", "peer_median_ratio"))
    cells = holdings.select("scheme_id", "isin", "report_month", C.finite("quantity").alias("q"),
                            C.finite("market_value_lakhs").alias("v"))
    both = (agreed.join(cells.withColumnsRenamed({"q": "q1", "v": "v1"}), ["scheme_id", "isin", "report_month"])
            .join(cells.withColumnsRenamed({"q": "q0", "v": "v0", "report_month": "prev_month"}),
                  ["scheme_id", "isin", "prev_month"]))
    px0, px1 = F.col("v0") / F.col("q0"), F.col("v1") / F.col("q1")
    found = (both.withColumn("ratio", F.when((F.col("q0") > 0) & (F.col("q1") > 0),
                                             split_candidate(F.col("q0"), px0, F.col("q1"), px1)))
             .filter(F.col("ratio").isNotNull()))
    return (found.join(actions.select("isin", F.col("effective_month").alias("report_month")),
                       ["isin", "report_month"], "left_anti")
            .groupBy("isin", F.col("report_month").alias("effective_month"))
            .agg(F.lit("split_candidate").alias("kind"), F.min_by("ratio", "scheme_id").alias("ratio"))
            .withColumn("detected_by", F.lit(PEER_DETECTOR)).withColumn("confirmed", F.lit(0)))


def priced_coverage(holdings: DataFrame, stocks: DataFrame, prices_monthly: DataFrame) -> DataFrame:
    """Per month: held equities, how many have a month-end close, and the share."""
    equity = stocks.filter(F.col("instrument_type") == "equity").select("isin")
    held = holdings.select("report_month", "isin").distinct().join(equity, "isin", "left_semi")
    priced = prices_monthly.select("report_month", "isin").distinct().withColumn("_p", F.lit(1))
    counts = held.join(priced, ["report_month", "isin"], "left").groupBy("report_month").agg(
        F.count(F.lit(1)).alias("held_equities"), F.count("_p").alias("priced"))
    return counts.select("report_month", "held_equities", "priced",
                         (F.col("held_equities") - F.col("priced")).alias("unpriced"),
                         (100.0 * F.col("priced") / F.col("held_equities")).alias("pct"))


def changed_snapshots(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Scheme-months of ``loaded`` whose isin/quantity/value/NAV rows differ from what is stored."""
    columns = ["scheme_id", "report_month", "isin", "quantity", "market_value_lakhs", "pct_nav"]
    touched = loaded.select("scheme_id", "report_month").distinct()
    # Written first: a union of two joins that adaptive execution changes apart fails with unequal partitions.
    old = cut(stored.select(*columns).join(touched, ["scheme_id", "report_month"], "left_semi"))
    # One grouped pass instead of two set differences: identical rows from both sides cancel.
    signed = old.withColumn("_s", F.lit(-1)).unionByName(loaded.select(*columns).withColumn("_s", F.lit(1)))
    return (signed.groupBy(*columns).agg(F.sum("_s").alias("_d")).filter(F.col("_d") != 0)
            .select("scheme_id", "report_month").distinct())


def drop_derived(status: DataFrame, deltas: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Status and deltas without anything derived from changed snapshots, and the later months to re-run."""
    keys = ["scheme_id", "report_month"]
    # Joined three times: computed once.
    changed = cut(changed)
    as_prev = changed.withColumnRenamed("report_month", "prev_month")
    kept = deltas.join(changed, keys, "left_anti").join(as_prev, ["scheme_id", "prev_month"], "left_anti")
    later = deltas.join(as_prev, ["scheme_id", "prev_month"], "left_semi").select(*keys).distinct()
    return status.join(changed, keys, "left_anti"), kept.select(*deltas.columns), later
