"""Deliveries, cells that are no numbers, refused filings, search, releases and exits on literal rows."""

import hashlib

from pyspark.sql import functions as F

from folioflux.operators import evidence, filings, gate, intake, releases, summary
from folioflux.sources.tables import write_months

REGISTRY = [(0, "HDFC AMC", ["hdfc"], None), (1, "ICICI AMC", ["icici prudential", "icici"], None), (2, "UTI AMC", ["uti", "hdfc uti"], "^sebi exposure"), (3, "SBI AMC", ["sbi"], None),
            (4, "Prudent", ["icici prudential", "prudent"], None)]
M = "2026-07"


def registry(spark):
    return spark.createDataFrame(REGISTRY, "position int, amc_name string, brands array<string>, holdings_file string")


def test_brands_are_whole_words_and_the_first_house_wins(spark):
    titles = ["HDFC Flexi Cap", "hdfcx Fund", "ICICI Prudential Bluechip", "ICICI", "HDFC-UTI fund", "The SBI Fund", "prudent's", "", None, "SBI2 fund", "sbi"]
    frame = spark.createDataFrame(list(enumerate(titles)), "i int, scheme_title string")
    got = {r.i: r.owner for r in intake.brand_owners(frame, registry(spark), ["i"]).collect()}
    assert got == {0: "HDFC AMC", 2: "ICICI AMC", 3: "ICICI AMC", 4: "HDFC AMC", 6: "Prudent", 9: "SBI AMC", 10: "SBI AMC"}


def deliver(spark, folders, files, sheets, named=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    problems, verdicts = intake.intake(
        frame(folders, "amc_name string, report_month string"), frame(files, "amc_name string, report_month string, file string, archived boolean, error string"),
        frame(sheets, "amc_name string, report_month string, file string, sheet string, scheme_title string, n_rows int"),
        frame(named, "amc_name string, report_month string, file string, named_month string"), registry(spark))
    return {(r.amc_name, r.problem, r.detail) for r in problems.collect()}, {r.amc_name: r for r in verdicts.collect()}


def test_every_problem_of_a_delivery(spark):
    h, i, u, s = "HDFC AMC", "ICICI AMC", "UTI AMC", "SBI AMC"
    files = [(h, M, "a.xlsx", False, None), (h, M, "b.xlsx", False, None), (h, M, "old.xlsx", False, None), (h, M, "bad.xls", False, "BadZipFile"), (i, M, "n.xlsx", True, None),
             (u, M, "SEBI Exposure jul.xlsx", True, None), (u, M, "dividends.xlsx", True, None), (None, M, "x.csv", False, None)]
    sheets = [(h, M, "a.xlsx", "HDFC  Mid", "HDFC Mid Cap", 3), (h, M, "b.xlsx", "hdfc mid", "ICICI Prudential Mid", 4), (h, M, "b.xlsx", "S2", "SBI Small", 2), (h, M, "old.xlsx", "Old", "SBI x", 9),
              (u, M, "SEBI Exposure jul.xlsx", "U1", "UTI Flexi", 5), (u, M, "dividends.xlsx", "U1", "SBI Fund", 5)]
    named = [(h, M, "old.xlsx", "2026-06"), (h, M, "a.xlsx", "2026-06"), (h, M, "a.xlsx", M)]
    problems, verdicts = deliver(spark, [(h, M), (i, M), (u, M), (s, M), ("HDFC", M)], files, sheets, named)
    assert problems == {(h, "scheme_in_two_files", "a.xlsx [HDFC  Mid] and b.xlsx [hdfc mid]"), (h, "belongs_to_another_house", "hdfc mid: ICICI AMC"), (h, "belongs_to_another_house", "S2: SBI AMC"),
                        (h, "dated_another_month", "old.xlsx: 2026-06"), (h, "unreadable_workbook", "bad.xls: BadZipFile"), (i, "no_portfolio", None), (s, "no_workbook", None),
                        ("HDFC", "unknown_house", None), (None, "file_outside_a_folder", "x.csv")}
    assert {k: v.status for k, v in verdicts.items()} == {h: "refused", i: "refused", u: "ok", s: "refused", "HDFC": "unknown", "Prudent": "missing"}
    assert (verdicts[h].n_files, verdicts[h].n_schemes, verdicts[h].n_rows, verdicts[i].n_skipped, verdicts[u].n_files) == (4, 3, 9, 1, 1)
    assert [p.problem for p in verdicts[s].problems] == ["no_workbook"] and verdicts[u].problems == []


def test_an_archive_without_the_holdings_workbook(spark):
    problems, _ = deliver(spark, [("UTI AMC", M)], [("UTI AMC", M, "dividends.xlsx", True, None)], [("UTI AMC", M, "dividends.xlsx", "U", "UTI x", 1)])
    assert problems == {("UTI AMC", "no_holdings_workbook", None)}


def test_poisoned_cells_withhold_their_months_only(spark):
    rows = [(1, "INE001A01011", "2026-01", "10", "5", "50"), (1, "INE001A01011", "2026-02", "1O", "5", "50"), (1, "INE001A01011", "2026-03", "12", "5", "50"), (1, "INE001A01011", "2026-04", "13", "5", "100"),
            (2, "INE001A01011", "2026-01", "10", "n.a.", "100"), (2, "INE001A01011", "2026-02", "1e999", "5", "#REF!"), (3, "", "2026-01", "Total", None, None), (3, "INE001A01011", "2026-01", "4", "4", "100")]
    delivered = spark.createDataFrame(rows, "scheme_id bigint, isin string, report_month string, quantity string, market_value_lakhs string, pct_nav string")
    cells = gate.delivered_cells(delivered)
    crashed = {(r.scheme_id, r.report_month, r.code) for r in gate.crashed_checks(cells).collect()}
    assert crashed == {(1, "2026-02", "qty_ratio_crashed"), (1, "2026-03", "qty_ratio_crashed"), (3, "2026-01", "gate_crashed")}
    stocks = spark.createDataFrame([("INE001A01011", "equity")], "isin string, instrument_type string")
    issues = spark.createDataFrame([(1, "2026-02", "qty_ratio_out_of_band", "warn"), (1, "2026-02", "nav_sum_out_of_band", "warn"), (1, "2026-04", "qty_ratio_out_of_band", "warn")],
                                   "scheme_id bigint, report_month string, code string, severity string")
    whole = gate.unavailable_cells(cells.filter("isin <> ''"), stocks)
    named = {(r.scheme_id, r.report_month, r.code, r.severity) for r in whole.collect()}
    assert (2, "2026-01", "market_value_lakhs_unavailable", "warn") in named and (2, "2026-02", "quantity_unavailable", "error") in named and (2, "2026-02", "pct_nav_unavailable", "warn") in named
    more = [F.lit(None).cast(t).alias(c) for c, t in zip(gate.ISSUE_FIELDS[2:], ("string", "string", "double", "double", "string"), strict=True)]
    kept = {(r.report_month, r.code) for r in gate.isolated(issues.select("*", *more), gate.crashed_checks(cells)).filter("scheme_id = 1").collect()}
    assert kept == {("2026-02", "nav_sum_out_of_band"), ("2026-02", "qty_ratio_crashed"), ("2026-03", "qty_ratio_crashed"), ("2026-04", "qty_ratio_out_of_band")}


def test_no_filing_is_lost_on_the_way(spark):
    e = filings.PERCENT_ELEMENT
    fact = lambda c, v: f'<{e} contextRef="{c}">{v}</{e}>'
    good = fact("ShareholdingOfPromoterAndPromoterGroup_ContextI", 40) + fact("PublicShareholding_ContextI", "60.0") + fact("MutualFundsOrUTI_ContextI", 7)
    docs = [(1, f"﻿ <x>{good}</x>"), (2, f"<x>{good}"), (3, "<x><y/></x>"), (4, None), (5, ""), (6, f"<x>{fact('Named_Context3', 5)}</x>"), (7, f"<x>{good}{fact('Banks_ContextI', 'abc')}</x>"),
            (8, f"<x>{good}{fact('PublicShareholding_ContextI', 61)}</x>")]
    facts = filings.xbrl_facts(spark.createDataFrame(docs, "k int, xml string"), ["k"])
    out = {r.k: r for r in filings.xbrl_resolve(filings.context_values(facts, ["k"]), ["k"]).collect()}
    assert {k: r.error for k, r in out.items()} == {1: None, 2: "not_well_formed", 3: "no_percentages", 4: "no_document", 5: "not_well_formed", 6: "no_aggregate_rows", 7: "invalid_percentage",
                                                   8: "conflicting_percentages"}
    assert (out[1].promoter_pct, out[1].public_pct, out[1].mf_pct, out[1].dii_pct, out[1].fii_pct) == (40.0, 60.0, 7.0, 7.0, 0.0) and out[2].public_pct is None


def test_search_verifies_what_the_pieces_promise(spark):
    stocks = spark.createDataFrame([("INE001A01011", "EQ - Alpha Beta", "equity"), ("INE002A01011", "Alphabet", "equity"), ("INE003A01011", "Beta lphA", "equity"), ("XX", "%a_b", "ncd"),
                                    ("INE004A01011", None, "equity")], "isin string, name string, instrument_type string").withColumn("industry", F.lit("x"))
    holdings = spark.createDataFrame([(s, "INE002A01011", M) for s in (1, 2, 2)] + [(1, "INE001A01011", "2026-06")], "scheme_id int, isin string, report_month string")
    postings, counts = evidence.name_postings(stocks), evidence.holder_counts(holdings)

    def find(text, month=None):
        return [(r.isin[:6], r.schemes_holding) for r in evidence.find_stocks(stocks, postings, counts, text, month).collect()]
    assert find("ALPHA") == [("INE002", 2), ("INE001", 1)] and find("alpha", "2026-06") == [("INE001", 1), ("INE002", 0)]
    assert find("lpha b") == [("INE001", 1)] and find("ine00") and find("001A") == [] and find("a") == [] and find(" _%a ") == [] and find("ab") == [("INE002", 2)]
    assert find("ine004") == [("INE004", 0)]


def test_leaves_tell_which_month_changed(spark, tmp_path):
    rows = [(s, M, float(q)) for s in range(20) for q in (s, s, s + 1)] + [(1, "2026-06", 1.0), (2, "2026-05", None)]
    frame = spark.createDataFrame(rows, "scheme_id int, report_month string, quantity double")
    path = str(tmp_path / "by month")
    write_months(spark, path, frame)
    before = spark.createDataFrame(releases.stored_leaves(spark, path, "t").collect())
    digests = lambda f: {r.month: r.digest for r in releases.month_digests(f, "t").collect()}
    assert digests(frame) == digests(frame.repartition(5)) and len(digests(frame)) == 3
    # A repeated row more, or one value another, changes its month alone.
    for other in (frame.unionByName(frame.filter("scheme_id = 1").limit(1)), frame.withColumn("quantity", F.when(F.col("report_month") == "2026-05", 0.0).otherwise(F.col("quantity")))):
        assert sum(digests(other)[m] != d for m, d in digests(frame).items()) == 1
    write_months(spark, path, frame.filter("report_month = '2026-06'").withColumn("quantity", F.lit(2.0)), ["2026-05"])
    after = releases.stored_leaves(spark, path, "t", before)
    assert {(r.month, r.read_now) for r in after.collect()} == {(M, False), ("2026-06", True)}
    assert {(r.month, r.change) for r in releases.changed_months(before, after).collect()} == {("2026-06", "changed"), ("2026-05", "removed")}


def test_leaves_are_sums_of_row_digests(spark):
    rows = [(s, M, None if s % 5 == 0 else f"I{s}") for s in range(40)]
    row = releases.month_digests(spark.createDataFrame(rows, "scheme_id int, report_month string, isin string"), "t").first()
    cell = lambda x: "-" if x is None else f"{len(str(x))}:{x}"
    hashes = [hashlib.sha256("|".join(cell(x) for x in (isin, month, s)).encode()).hexdigest() for s, month, isin in rows]
    sums = [sum(int(h[15 * i:15 * i + 15], 16) for h in hashes) for i in range(4)]
    assert min(sums) > 2 ** 63 and row.n_rows == 40
    assert row.digest == hashlib.sha256(":".join(map(str, [40, *sums])).encode()).hexdigest()


def test_a_release_reads_its_tables_once_for_the_digests_and_once_for_the_copy(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x
    rows = spark.createDataFrame([(s, M if s % 2 else "2026-06") for s in range(30)], "scheme_id int, report_month string")
    counted = rows.withColumn("scheme_id", F.udf(count, "int")("scheme_id"))
    tables = {"t": counted, "none": rows.limit(0), "plain": rows.select("scheme_id")}
    rid = releases.write_release(spark, str(tmp_path), tables)
    assert seen.value == 60     # was four passes
    want = {tuple(r) for r in releases.content_fingerprint({**tables, "t": rows}).collect()}
    stored = spark.read.parquet(f"{tmp_path}/release={rid}/manifest_rows")
    assert {(r.table_name, r.n_rows, r.digest) for r in stored.collect()} == want and {(n, k) for n, k, _ in want} == {("none", 0), ("plain", 30), ("t", 30)}
    assert {(r.table_name, r.month, r.n_rows) for r in releases.release_leaves(spark, str(tmp_path), rid).collect()} == {("t", M, 15), ("t", "2026-06", 15), ("plain", "", 30)}
    assert releases.write_release(spark, str(tmp_path), tables) == rid and seen.value == 90
    assert {n: t.count() for n, t in releases.read_release(spark, str(tmp_path), rid).items()} == {"t": 30, "none": 0, "plain": 30}


def test_exits_are_ordered_and_counted(spark):
    rows = [(1, M, f"I{i}", "exited", None if i == 3 else -float(i % 7), -100.0 * i) for i in range(12)] + [(2, M, f"I{i}", "exited", None, float(-i)) for i in range(3)] + [(3, M, "I1", "new", 1.0, 1.0)]
    deltas = spark.createDataFrame(rows, "scheme_id int, report_month string, isin string, action string, flow_lakhs double, value_change_lakhs double") \
        .withColumns({c: F.lit(0.0) for c in ("qty_change", "price_effect_lakhs", "pct_nav_change")})
    stocks = spark.createDataFrame([(f"I{i}", f"N{i}", "equity") for i in range(12)], "isin string, name string, instrument_type string")
    out = {r.scheme_id: r for r in summary.summary_facts(deltas, stocks).collect()}
    want = sorted((i for i in range(12) if i != 3), key=lambda i: (-(i % 7), f"I{i}"))
    assert out[1].exit_names == [f"N{i}" for i in want[:5]] and (out[1].n_exited, out[1].exits_more) == (12, 7)
    assert out[2].exit_names == ["N2", "N1", "N0"] and (out[3].exit_names, out[3].n_exited, out[3].exits_more) == ([], 0, 0)
