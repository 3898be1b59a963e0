"""Classification, publication, gate, normalisation and exact statistics on literal rows."""

import random
import statistics
from collections import Counter

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from folioflux.functions import classify as K
from folioflux.functions import columns as C
from folioflux.operators import actions as X
from folioflux.operators import consensus as S
from folioflux.operators import exact
from folioflux.operators import filings as B
from folioflux.operators import gate as V
from folioflux.operators import normalize as N
from folioflux.operators import research as R
from folioflux.operators.running import last_marker
from folioflux.sources import tables as T


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


def test_classify_isin(spark):
    rows = ["INE002A01018", " ine002a01018 ", "INE002A02018", "INE002A07018", "INE002A14018", "INE002A99018", "INE002A", "IN0020230013",
            "IN9123", "INF025A01015", "US0378331005", "INX", None]
    assert values(spark, K.classify_isin, rows) == ["equity", "equity", "preference", "ncd", "cp_or_cd", "debt_other", "debt_other", "tbill_or_gsec",
                                                    "sgsec", "mf_units", "foreign", "other", "other"]


def test_title_rules(spark):
    titles = {"SBI Arbitrage Fund": 0, "ICICI Prudential Savings Fund": 0, "Axis Regular Savings Fund": 1, "Retirement Savings Fund": 1, "Equity Savings Fund": 0,
              "Long Term Advantage Fund": 1, "HDFC Hybrid Debt Fund": 1, "Flexi Cap (An open ended scheme tracking index)": 1, "Gold ETF": 0, "Fund of Funds": 0}
    assert values(spark, K.active_by_title, list(titles)) == list(titles.values())


def test_display_text(spark):
    df = spark.createDataFrame([(1234.0,), (None,), (-50.0,), (999950.0,), (2500000.0,)], "x double")
    got = df.select(K.crore_text("x"), K.compact_shares("x"), K.rupee_crore("x")).collect()
    assert [r[0] for r in got] == ["12", "–", "−0.5", "10,000", "25,000"]
    assert [r[1] for r in got] == ["+1.2K", "–", "−50", "+1M", "+2.5M"]
    assert got[2][2] == "-₹0.5 Cr"


def test_unobserved_publication_uses_the_deadline(spark):
    df = spark.createDataFrame([("2026-06-30", None), ("2026-06-30", " nan "), ("2026-06-30", "2026-08-01T19:00")], "q string, p string")
    got = df.select(C.filing_published("q", "p").cast("string"), C.filing_basis("p")).collect()
    assert [tuple(r) for r in got] == [("2026-07-21", "regulatory_deadline"), ("2026-07-21", "regulatory_deadline"), ("2026-08-01", "observed")]


def test_strict_sum_and_finite(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", "2"), ("b", "3"), ("c", "inf")], "k string, v string")
    out = {r.k: r.s for r in df.groupBy("k").agg(C.strict_sum(C.finite("v")).alias("s")).collect()}
    assert out == {"a": None, "b": 5.0, "c": None}


def test_history_range_is_bounded():
    assert C.month_list("2025-11", "2026-02") == ["2025-11", "2025-12", "2026-01", "2026-02"]
    with pytest.raises(ValueError):
        C.month_list("2024-01", "2026-02")


@pytest.mark.parametrize("ordered", [3, 100_000])
def test_leave_one_out_median_against_brute_force(spark, ordered):
    rng = random.Random(7)
    sizes = {"one": 1, "two": 2, "odd": 7, "even": 12, "hot": 400}
    rows = [(k, i, float(rng.choice([1, 1, 1, 2, rng.random()]))) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {(r.k, r.i): r.m for r in exact.leave_one_out_median(df, ["k"], "v", "m", ordered).collect()}
    want = {(k, i): statistics.median([v for kk, j, v in rows if kk == k and j != i]) for k, i, _ in rows if sizes[k] > 1}
    assert got == pytest.approx(want)
    medians = {r.k: r.median for r in exact.exact_median(df, ["k"], "v", ordered=ordered).collect()}
    assert medians == pytest.approx({k: statistics.median([v for kk, _, v in rows if kk == k]) for k in sizes})


def test_running_marker_across_blocks(spark):
    rows = [("s", i, "m%d" % i if i % 37 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, row int, mark string")
    got = {r.row: r.state for r in last_marker(df, ["k"], "row", "mark", "state", block_rows=10).collect()}
    assert got == {i: "m%d" % (i // 37 * 37) for i in range(200)}


def test_new_split_candidate_needs_peers_and_price(spark):
    months = ("2026-07", "2026-08")
    rows = [(s, "S", m, q * (5 if m == months[1] else 1), 100.0, 1.0) for s, q in ((1, 100.0), (2, 40.0), (3, 10.0)) for m in months]
    rows += [(s, "T", m, q * (3 if m == months[1] and s == 1 else 1), 100.0, 1.0) for s, q in ((1, 100.0), (2, 40.0), (3, 10.0)) for m in months]
    h = spark.createDataFrame(rows, "scheme_id bigint, isin string, report_month string, quantity double, market_value_lakhs double, pct_nav double")
    none = spark.createDataFrame([], "isin string, effective_month string, confirmed int")
    issues = V.quantity_ratio_issues(h, X.peer_median_ratios(h), none)
    assert {(r.isin, r.code) for r in issues.collect()} == {("S", "qty_ratio_corporate_action_candidate"), ("T", "qty_ratio_out_of_band")}
    found = X.corporate_action_candidates(issues, h, none).collect()
    assert [(r.isin, r.ratio, r.confirmed) for r in found] == [("S", 5.0, 0)]
    stored = spark.createDataFrame([("S", "2026-08", 1)], "isin string, effective_month string, confirmed int")
    assert X.corporate_action_candidates(issues, h, stored).count() == 0


def test_nav_bands(spark):
    sums = spark.createDataFrame([(1, "m", 100.0), (2, "m", 94.0), (3, "m", 111.0), (4, "m", None)], "scheme_id bigint, report_month string, nav_sum double")
    codes = {}
    for r in V.nav_issues(sums).collect():
        codes.setdefault(r.scheme_id, set()).add(r.code)
    assert codes == {2: {"nav_sum_out_of_band"}, 3: {"nav_sum_out_of_band", "nav_sum_quarantine"}, 4: {"nav_sum_missing"}}


def test_shareholding_sum(spark):
    df = spark.createDataFrame([("a", "50", "50", None, None), ("b", "50", "40", "1", None), ("c", None, None, None, None), ("d", "x", "50", None, None)],
                               "isin string, promoter_pct string, public_pct string, fii_pct string, dii_pct string").withColumn("quarter_end", F.lit("q"))
    assert {r.isin: r.code for r in V.shareholding_check(df).collect()} == {
        "a": None, "b": "shareholding_out_of_band", "c": "shareholding_missing", "d": "shareholding_invalid"}


def test_xbrl_example(spark):
    facts = {"ShareholdingOfPromoterAndPromoterGroup_ContextI": 50.11, "PublicShareholding_ContextI": 49.89, "MutualFundsOrUti_ContextI": 9.21,
             "Banks_ContextI": .06, "InsuranceCompanies_ContextI": 8.99, "InstitutionsForeignPortfolioInvestorCategoryOneI": 18.25,
             "InstitutionsForeignPortfolioInvestorCatergoryTwo_ContextI": 0.72, "MutualFundsOrUti_Context15": 3.0}
    df = spark.createDataFrame([(1, k, str(v)) for k, v in facts.items()] + [(2, k, str(v / 100)) for k, v in facts.items()]
                               + [(3, "PublicShareholdingI", "60")], "f int, context string, text string")
    got = {r.f: r for r in B.xbrl_resolve(B.context_values(df, ["f"]), ["f"]).collect()}
    for f in (1, 2):
        assert (got[f].promoter_pct, got[f].fii_pct, got[f].dii_pct, got[f].mf_pct) == pytest.approx((50.11, 18.97, 18.26, 9.21))
    assert got[3].error == "no_aggregate_rows"


def test_combine_lots(spark):
    rows = [("A", 1, 10.0, 5.0, 1.0), ("A", 2, 4.0, 2.0, 0.5), ("A", 3, 0.0, None, None), ("B", 1, 10.0, 5.0, 1.0), ("B", 2, None, 2.0, 0.5),
            ("C", 1, 0.0, 0.0, 0.0), ("C", 2, None, None, None)]
    df = spark.createDataFrame(rows, "isin string, n int, quantity double, market_value_lakhs double, pct_nav double").withColumn(
        "pct_nav_raw", F.col("pct_nav")).withColumn("pct_nav_scale", F.lit("percent"))
    got = {r.isin: (r.quantity, r.market_value_lakhs) for r in N.combine_lots(df, ["isin"], "n").collect()}
    assert got == {"A": (14.0, 7.0), "B": (None, 7.0), "C": (0.0, 0.0)}


def test_equal_bins(spark):
    df = spark.createDataFrame([(i, 7) for i in range(1, 8)], "r int, n int")
    bins = [r[0] for r in df.select(R.equal_bins(F.col("r"), F.col("n"), 5)).collect()]
    assert [bins.count(b) for b in range(5)] == [2, 1, 1, 1, 2]


def test_bhavcopy_rules(spark, tmp_path):
    lines = ["TradDt,ISIN,TckrSymb,SctySrs,ClsPric,TtlTradgVol,TtlTrfVal", "2026-08-31,INE002A01018,R,EQ,100,10,1000", "2026-08-31,INE002A01018,R,BE,101,99,-1",
             "2026-08-31,INE040A01034,H,GB,5,1,1", "2026-08-31,BAD,H,EQ,5,1,1", "2026-08-31,INE009A01021,I,EQ,0,1,1"]
    (tmp_path / "day.csv").write_text("\n".join(lines))
    got = T.read_bhavcopy(spark, str(tmp_path / "day.csv")).collect()
    assert [(r.isin, r.close_price, r.series, r.traded_value) for r in got] == [("INE002A01018", 101.0, "BE", None)]
    with pytest.raises(T.RefusedInput):
        T.normalize_closes(spark.createDataFrame([("x",)], "a string"))
    with pytest.raises(T.RefusedInput):
        bad = spark.createDataFrame([("I", "2026-08", -1.0)], "isin string, report_month string, close_price double")
        T.upsert_prices(bad, bad, ["isin", "report_month"])


def test_parsed_csv_is_refused_whole(spark, tmp_path):
    good = "isin,instrument_name,quantity,market_value_lakhs,pct_nav,scheme_name,amc_name,report_month"
    (tmp_path / "a.csv").write_text(good + "\nINE002A01018,R,10,x,1,S,A,2026-7\n")
    with pytest.raises(T.RefusedInput, match="bad_report_month"):
        T.read_parsed_holdings(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text(good + "\nINE002A01018,R,10,x,1,S,A,2026-07\n")
    row = T.read_parsed_holdings(spark, str(tmp_path / "b.csv")).first()
    assert row.quantity == 10.0 and row.market_value_lakhs is None


def test_month_partitions_are_replaced_and_emptied(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "2026-01"), (2, "2026-02"), (3, "2026-03")], "scheme_id bigint, report_month string")
    T.write_months(spark, path, rows)
    T.write_months(spark, path, spark.createDataFrame([(9, "2026-02")], rows.schema), also=["2026-03"])
    assert {(r.scheme_id, r.report_month) for r in spark.read.parquet(path).collect()} == {(1, "2026-01"), (9, "2026-02")}


def test_notable_lists(spark):
    def row(month, isin, rank, net, opening=0, status="established", fii=1.0):
        return (month, isin, rank, isin, "equity", net, opening, 0, 3, status, fii, "available", False)
    rows = [row("2026-06", "A", 1, 1), row("2026-07", "A", 1, 2), row("2026-07", "B", 2, -1), row("2026-08", "A", 1, 3, 2), row("2026-08", "B", 2, 2, 2, "new_listing", -1.0)]
    ranked = spark.createDataFrame(rows, "report_month string, isin string, rank int, stock_name string, instrument_type string, net_amc_count int, amcs_opening int, "
                                         "amcs_exiting int, net_active_amc_count int, universe_status string, fii_pct_change double, shareholding_status string, shareholding_stale boolean")
    got = {(r.list, r.isin) for r in S.notable_lists(ranked, ranked.select("report_month")).filter("report_month = '2026-08'").collect()}
    assert got == {("turnaround", "B"), ("opened", "A"), ("active", "A"), ("active", "B"), ("streak", "A"), ("fii", "A")}
    needs = {(r.report_month, r.list): r.needs for r in S.notable_needs(ranked, ranked.select("report_month")).collect()}
    assert needs == {("2026-06", "turnaround"): "2026-05", ("2026-06", "streak"): "2026-05", ("2026-07", "streak"): "2026-05"}


def test_parse_stocks(spark):
    df = spark.createDataFrame([(1, "ine002a01018, INE002A01018,"), (2, "nonsense")], "k int, stocks string")
    assert {(r.k, r.valid, r.isin) for r in K.parse_stocks(df, key_cols=("k",)).collect()} == {(1, True, "INE002A01018"), (2, False, None)}


def test_staleness_with_joins_that_are_not_broadcast(spark):
    folder = "/root/testdata/sf0.01"
    want = Counter(r.kept for r in entry.queries()["drop_derived"](spark, folder).collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert Counter(r.kept for r in entry.queries()["drop_derived"](spark, folder).collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_statuses_are_those_of_the_gate_without_its_warnings(spark):
    rows = [(s, m, f"INE00{i}A0101{i}", q, 10.0 * q if q else 1.0, w) for s, m, q, w in
            ((1, "2026-01", 5.0, 50.0), (1, "2026-02", 20.0, 50.0), (2, "2026-01", None, 50.0), (2, "2026-02", 3.0, 60.0), (3, "2026-01", 4.0, 40.0)) for i in (1, 2)]
    holdings = spark.createDataFrame(rows, "scheme_id bigint, report_month string, isin string, quantity double, market_value_lakhs double, pct_nav double")
    stocks = holdings.select("isin", F.lit("equity").alias("instrument_type")).distinct()
    actions = spark.createDataFrame([], "isin string, effective_month string, confirmed int")
    issues = V.gate_issues(holdings, stocks, actions, X.peer_median_ratios(holdings))
    want = {tuple(r) for r in V.run_gate(holdings, issues).select("scheme_id", "report_month", "status").collect()}
    assert {tuple(r) for r in V.statuses(holdings, stocks).collect()} == want
    assert {s for *_, s in want} == {"ok", "quarantined"}
