"""Comparison rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from folioflux.operators import active as A
from folioflux.operators import compare as D
from folioflux.operators import eligibility as E

H = "scheme_id bigint, isin string, quantity double, market_value_lakhs double, pct_nav double"


def diff(spark, prev, curr):
    out = D.diff_holdings(spark.createDataFrame(prev, H), spark.createDataFrame(curr, H), "2026-07", "2026-08")
    return {(r.scheme_id, r.isin): r for r in out.collect()}


def test_golden_row_flow_positive_while_value_falls(spark):
    row = diff(spark, [(44, "X", 295465251.0, 2210523.28, 5.0)], [(44, "X", 297027438.0, 2105924.54, 5.0)])[(44, "X")]
    assert row.action == "added" and row.flow_lakhs > 0 > row.value_change_lakhs
    assert row.flow_lakhs + row.price_effect_lakhs == pytest.approx(row.value_change_lakhs)


def test_absent_row_is_zero_but_unknown_cell_poisons(spark):
    out = diff(spark, [(1, "A", 10.0, 100.0, 1.0), (1, "B", None, 50.0, 1.0), (1, "D", 5.0, 20.0, 1.0)],
               [(1, "A", 20.0, None, 1.0), (1, "B", 5.0, 50.0, 1.0), (1, "C", 3.0, 30.0, 2.0)])
    assert out[1, "A"].action == "added" and out[1, "A"].flow_lakhs is None
    assert out[1, "B"].action == "unavailable" and out[1, "B"].flow_lakhs is None and out[1, "B"].qty_change is None
    assert (out[1, "C"].action, out[1, "C"].flow_lakhs, out[1, "C"].price_effect_lakhs) == ("new", 30.0, 0.0)
    assert (out[1, "D"].action, out[1, "D"].flow_lakhs, out[1, "D"].price_effect_lakhs) == ("exited", -20.0, 0.0)


def test_negative_and_infinite_quantities_are_unknown(spark):
    out = diff(spark, [(1, "A", -1.0, 1.0, 1.0), (1, "B", float("inf"), 1.0, 1.0)], [(1, "A", 1.0, 1.0, 1.0), (1, "B", 1.0, 1.0, 1.0)])
    assert {r.action for r in out.values()} == {"unavailable"}


def test_scheme_in_one_month_only_is_left_out(spark):
    assert diff(spark, [(1, "A", 1.0, 1.0, 1.0)], [(2, "A", 1.0, 1.0, 1.0)]) == {}


def test_zero_quantity_rows(spark):
    out = diff(spark, [(1, "A", 5.0, 9.0, 1.0), (1, "B", 0.0, None, 1.0)], [(1, "A", 0.0, 2.0, 1.0), (1, "B", 0.0, 1.0, 1.0)])
    assert out[1, "A"].action == "trimmed" and out[1, "A"].flow_lakhs == -9.0 and out[1, "A"].price_effect_lakhs == 2.0
    assert out[1, "B"].action == "unchanged" and out[1, "B"].flow_lakhs is None


def test_batch_form_matches_two_snapshots_and_skips_gaps(spark):
    rows = [(1, "A", "2026-01", 10.0, 1.0, 1.0), (1, "B", "2026-01", 4.0, 1.0, 1.0), (1, "A", "2026-02", 12.0, 1.0, 1.0),
            (1, "A", "2026-04", 1.0, 1.0, 1.0), (2, "A", "2026-02", 1.0, 1.0, 1.0)]
    holdings = spark.createDataFrame(rows, "scheme_id bigint, isin string, report_month string, quantity double, market_value_lakhs double, pct_nav double")
    out = {(r.scheme_id, r.isin, r.report_month): r.action for r in D.deltas_all_months(holdings).collect()}
    assert out == {(1, "A", "2026-02"): "added", (1, "B", "2026-02"): "exited"}


def test_months_must_be_adjacent(spark):
    D.require_adjacent("2025-12", "2026-01")
    with pytest.raises(ValueError):
        D.require_adjacent("2026-01", "2025-12")


def pairs(spark, rows):
    """(scheme, isin, q0, v0, q1, v1); None pair = absent side."""
    out = [("2026-08", s, i, q0 is not None or v0 is not None, q1 is not None or v1 is not None, float(q0 or 0) if q0 != "?" else None,
            float(v0 or 0), float(q1 or 0) if q1 != "?" else None, float(v1 or 0)) for s, i, q0, v0, q1, v1 in rows]
    return spark.createDataFrame(out, "report_month string, scheme_id bigint, isin string, in_prev boolean, in_curr boolean, quantity_prev double, "
                                      "market_value_lakhs_prev double, quantity_curr double, market_value_lakhs_curr double")


def test_split_needs_every_holder_and_the_price(spark):
    both = [(1, "S", 100, 100, 200, 100), (2, "S", 50, 50, 100, 51)]
    crash = [(1, "C", 100, 100, 100, 50)]
    split = {r.isin: r.split_ratio for r in D.infer_split_ratios(pairs(spark, both + crash)).collect()}
    assert split == {"S": 2.0}
    assert D.infer_split_ratios(pairs(spark, both + [(3, "S", 10, 10, 11, 5)])).count() == 0
    assert D.infer_split_ratios(pairs(spark, both + [(3, "S", 10, 10, "?", 5)])).count() == 0


def test_confirmed_split_wins(spark):
    actions = spark.createDataFrame([("S", "2026-08", 5.0, 1)], "isin string, effective_month string, ratio double, confirmed int")
    got = D.split_ratios(pairs(spark, [(1, "S", 100, 100, 200, 100)]), actions).collect()
    assert [(r.split_ratio, r.adjustment_basis) for r in got] == [(5.0, "confirmed")]


def changes(spark, rows, **kw):
    return {(r.scheme_id, r.isin): r for r in A.active_weight_changes(pairs(spark, rows), **kw).collect()}


def test_pro_rata_inflow_is_no_decision(spark):
    out = changes(spark, [(1, "A", 100, 100, 110, 110), (1, "B", 100, 100, 110, 110)])
    assert all(abs(r.active_weight_change_pp) < 1e-9 for r in out.values())


def test_rotation_is_25_points(spark):
    out = changes(spark, [(1, "A", 50, 50, 75, 75), (1, "B", 50, 50, 25, 25)])
    assert out[1, "A"].active_weight_change_pp == pytest.approx(25) and out[1, "B"].active_weight_change_pp == pytest.approx(-25)


def test_price_fallback_chain(spark):
    rows = [(1, "A", 10, 10, None, None), (1, "K", 10, 10, 10, 10), (2, "A", 10, 10, 10, 20), (2, "K", 1, 1, 1, 1), (1, "Z", 10, 10, None, None), (1, "Y", 10, 10, None, None)]
    closes = spark.createDataFrame([("2026-08", "Z", 300000.0)], "report_month string, isin string, close_price double")
    out = changes(spark, rows, closes=closes)
    assert {i: out[1, i].price_basis for i in "AKZY"} == {"A": "cross_scheme", "K": "own", "Z": "exchange_close", "Y": "assumed_flat"}
    assert out[1, "Z"].w_drift_pp == pytest.approx(100 * 30 / (20 + 10 + 30 + 10))


def test_unsafe_scheme_has_no_numbers_and_blanks_the_stock(spark):
    rows = [(1, "A", 10, 10, "?", 10), (1, "B", 10, 10, 10, 10), (2, "A", 10, 10, 20, 20), (2, "B", 10, 10, 10, 10)]
    frame = A.active_weight_changes(pairs(spark, rows))
    assert {r.price_basis for r in frame.filter("scheme_id = 1").collect()} == {"unavailable"}
    schemes = spark.createDataFrame([(1, "H"), (2, "G")], "scheme_id bigint, amc_name string")
    totals = A.aggregate_by_stock(frame, schemes).collect()
    assert all(r.net_active_amc_count is None and r.discretionary_flow_lakhs is None for r in totals)


def test_scheme_without_house_fails(spark):
    frame = A.active_weight_changes(pairs(spark, [(9, "A", 50, 50, 75, 75), (9, "B", 50, 50, 25, 25)]))
    with pytest.raises(Exception, match="no house recorded"):
        A.aggregate_by_stock(frame, spark.createDataFrame([(1, "H")], "scheme_id bigint, amc_name string")).collect()


def test_split_candidate_boundary(spark):
    df = spark.createDataFrame([(100.0, 10.0, 500.0, 2.0), (100.0, 10.0, 500.0, 9.0), (0.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(D.split_candidate(*map(F.col, "abcd"))).collect()] == [5.0, None, None]


def plan_of(spark, make):
    """The physical plan with joins as on tables too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_holdings_are_exchanged_once_to_pair_their_months(spark):
    rows = [(1, "A", 1.0, 1.0, 1.0, "2026-01"), (1, "B", 2.0, 1.0, 1.0, "2026-01"), (1, "A", 3.0, 1.0, 1.0, "2026-02"), (1, "C", 5.0, 1.0, 1.0, "2026-04"),
            (2, "A", 1.0, 1.0, 1.0, "2026-02"), (None, "A", 1.0, 1.0, 1.0, "2026-02"), (None, "A", 1.0, 1.0, 1.0, "2026-03"), (3, "A", 1.0, 1.0, 1.0, None), (3, "B", 1.0, 1.0, 1.0, None)]
    holdings = spark.createDataFrame(rows, H + ", report_month string")
    got = {(r.scheme_id, r.isin, r.report_month, r.prev_month, r.quantity_prev, r.quantity_curr) for r in D.pair_months(holdings).collect()}
    assert got == {(1, "A", "2026-02", "2026-01", 1.0, 3.0), (1, "B", "2026-02", "2026-01", 2.0, 0.0)}
    assert plan_of(spark, lambda: D.pair_months(holdings)).count("Exchange hashpartitioning") == 1


STATUS, BAD = "scheme_id bigint, report_month string, status string", "scheme_id bigint, report_month string"
STOCKS = "isin string, name string, industry string, instrument_type string"


def test_comparisons_are_exchanged_by_scheme_and_not_for_each_of_their_months(spark):
    deltas = spark.createDataFrame([(s, "A", m, p) for s in (1, 2, 3) for m, p in (("2026-02", "2026-01"), ("2026-03", "2026-02"), ("2026-04", "2026-03"), ("2026-05", None))],
                                   "scheme_id bigint, isin string, report_month string, prev_month string")
    schemes = spark.createDataFrame([(1, "X", 1), (2, "Y", 1), (3, "Z", 0)], "scheme_id bigint, amc_name string, is_active_equity int")
    stocks = spark.createDataFrame([("A", "a", "i", "equity")], STOCKS)
    status = spark.createDataFrame([(1, "2026-02", "quarantined"), (2, "2026-04", "ok")], STATUS)
    bad = spark.createDataFrame([(2, "2026-05")], BAD)
    want = {(1, "2026-04"), (1, "2026-05"), (2, "2026-02"), (2, "2026-03"), (2, "2026-04")}
    for make in (E.eligible_deltas, E.compared_voters):
        got = {(r.scheme_id, r.report_month) for r in make(deltas, schemes, stocks, status, bad).collect()}
        assert got == (want if make is E.eligible_deltas else want - {(1, "2026-05")})
    exchanges = [x for x in plan_of(spark, lambda: E.eligible_deltas(deltas, schemes, stocks, status, bad)).splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("prev_month" in x for x in exchanges)


def test_validated_pairs_are_exchanged_by_scheme(spark):
    holdings = spark.createDataFrame([(s, "A", 1.0 + s, 1.0, 1.0, m) for s in (1, 2, 3) for m in ("2026-01", "2026-02", "2026-03")], H + ", report_month string")
    schemes = spark.createDataFrame([(1, "X", 1), (2, "Y", 1), (3, "Z", 0)], "scheme_id bigint, amc_name string, is_active_equity int")
    stocks = spark.createDataFrame([("A", "a", "i", "equity")], STOCKS)
    status = spark.createDataFrame([(s, m, "ok") for s in (1, 2, 3) for m in ("2026-01", "2026-02", "2026-03")], STATUS)
    bad = spark.createDataFrame([(2, "2026-01")], BAD)
    pairs = D.pair_months(holdings)
    got = {(r.scheme_id, r.report_month) for r in D.comparison_rows(pairs, schemes, stocks, status, bad).collect()}
    assert got == {(1, "2026-02"), (1, "2026-03"), (2, "2026-03")}
    plan = plan_of(spark, lambda: D.comparison_rows(pairs, schemes, stocks, status, bad))
    assert "LeftSemi" not in plan
