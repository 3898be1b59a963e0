"""Readers by name, non-finite quantities and the verified bracket of the exact median."""

import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflux.operators.actions import peer_median_ratios
from folioflux.operators.exact import exact_median, leave_one_out_median, ranked_values
from folioflux.operators.gate import quantity_ratio_issues
from folioflux.sources import tables as T

HOLDING = {"isin": "INE001A01011", "instrument_name": "x", "quantity": "20", "market_value_lakhs": "77", "pct_nav": "1.5", "scheme_name": "s",
           "amc_name": "a", "report_month": "2024-01"}


def csv_file(folder, name, row):
    (folder / name).write_text(",".join(row) + "\n" + ",".join(row.values()) + "\n")


def test_holdings_are_read_by_name(spark, tmp_path):
    csv_file(tmp_path, "a.csv", HOLDING)
    csv_file(tmp_path, "b.csv", dict(reversed(HOLDING.items())) | {"industry": "i"})
    rows = T.read_parsed_holdings(spark, str(tmp_path)).collect()
    assert [(r.quantity, r.market_value_lakhs) for r in rows] == [(20.0, 77.0)] * 2
    csv_file(tmp_path, "c.csv", {k: v for k, v in HOLDING.items() if k != "pct_nav"})
    with pytest.raises(T.RefusedInput):
        T.read_parsed_holdings(spark, str(tmp_path))


def test_both_exchange_layouts_in_one_call(spark, tmp_path):
    for k, layout in enumerate(T.LAYOUTS):
        values = dict(zip(layout.values(), (f"INE00{k}A01011", "SYM", "EQ", "10.5", "7", "70"), strict=True)) | {"TradDt": "2024-01-02"}
        csv_file(tmp_path, f"{k}.csv", dict(reversed(values.items())) if k else values)
    rows = T.read_bhavcopy(spark, str(tmp_path)).collect()
    assert sorted((r.isin, r.close_price, r.traded_value) for r in rows) == [("INE000A01011", 10.5, 70.0), ("INE001A01011", 10.5, 70.0)]


def test_files_with_spaces_marks_and_header_words_in_the_data(spark, tmp_path):
    folder = tmp_path / "HDFC AMC"
    folder.mkdir()
    required = list(HOLDING)
    lines = [",".join(required), ",".join(HOLDING.values()), ",".join('"Zed, ""B"""' if k == "instrument_name" else v for k, v in HOLDING.items())]
    (folder / "HDFC AMC 1.csv").write_text("\ufeff" + "\n".join(lines) + "\n", encoding="utf-8")
    # A later line that holds all names is data, not a header: it makes the batch malformed.
    (folder / "b%20c.csv").write_text(",".join(required) + "\n" + ",".join(HOLDING.values()) + "\n")
    rows = T.read_parsed_holdings(spark, str(folder)).collect()
    assert sorted(r.instrument_name for r in rows) == ['Zed, "B"', "x", "x"] and {r.quantity for r in rows} == {20.0} and {r.industry for r in rows} == {None}
    (folder / "c.csv").write_text(",".join(required) + "\n" + ",".join(required) + "\n")
    with pytest.raises(T.RefusedInput, match="bad_report_month"):
        T.read_parsed_holdings(spark, str(folder))


def test_too_wide_a_file_is_refused(spark, tmp_path):
    csv_file(tmp_path, "a.csv", HOLDING | {f"x{i}": "1" for i in range(T.WIDTH)})
    with pytest.raises(T.RefusedInput):
        T.read_parsed_holdings(spark, str(tmp_path))


def prices(spark, rows):
    return spark.createDataFrame(rows, "isin string, trade_date string, close_price double, fetched_at int")


def test_merge_touches_only_the_partitions_of_its_keys(spark, tmp_path):
    table, keys = str(tmp_path / "a table"), ["isin", "trade_date"]
    first = [(f"I{i}", f"2024-0{m}-05", 10.0 + i, 1) for i in range(30) for m in (1, 2, 3)]
    T.merge_prices(spark, table, prices(spark, first), keys)
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(table).rglob("*.parquet")}
    before = files()
    batch = [("I3", "2024-02-05", 5.0, 2), ("I3", "2024-02-05", 7.0, 3), ("I3", "2024-02-05", 6.0, 1), ("N", "2024-02-07", 1.0, 1)]
    for _ in range(2):
        T.merge_prices(spark, table, prices(spark, batch), keys, ["fetched_at"])
        got = {(r.isin, r.trade_date): r.close_price for r in T.read_keyed(spark, table).collect()}
        assert got == {(i, d): x for i, d, x, _ in first} | {("I3", "2024-02-05"): 7.0, ("N", "2024-02-07"): 1.0}
        assert T.read_keyed(spark, table).count() == len(got)
    after = files()
    gone = {p.parent for p in before if p not in after}
    assert 1 <= len(gone) <= 2 and all("period=2024-02" in str(p) for p in gone)
    assert all(after[p] == t for p, t in before.items() if p in after)
    # A refused batch and an empty one leave the table alone.
    with pytest.raises(T.RefusedInput):
        T.merge_prices(spark, table, prices(spark, [("I1", "2024-01-05", float("nan"), 1)]), keys)
    T.merge_prices(spark, table, prices(spark, []), keys)
    assert files() == after


def test_without_an_order_the_last_row_of_a_batch_counts(spark):
    rows = prices(spark, [("I", "d", 1.0, 1), ("I", "d", 3.0, 1), ("I", "d", 2.0, 1), ("J", "d", 4.0, 1)]).coalesce(1)
    assert {r.isin: r.close_price for r in T.upsert_prices(rows.limit(0), rows, ["isin", "trade_date"]).collect()} == {"I": 2.0, "J": 4.0}


def test_non_finite_quantities_do_not_reach_peers(spark):
    rows = [(s, "I", m, q) for s, q0, q1 in ((1, 10.0, 20.0), (2, 10.0, 30.0), (3, 10.0, float("nan")), (4, float("inf"), 5.0)) for m, q in (("2024-01", q0), ("2024-02", q1))]
    out = peer_median_ratios(spark.createDataFrame(rows, "scheme_id long, isin string, report_month string, quantity double")).collect()
    assert {r.scheme_id: r.peer_median_ratio for r in out} == {1: 3.0, 2: 2.0}


def test_no_table_with_a_row_a_holding_or_snapshot_is_broadcast(spark, tmp_path):
    """By the sizes of their files all of these tables are small enough."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    broadcast = lambda df, key: [x for x in plan(df).splitlines() if "BroadcastHashJoin" in x and key in x]
    rows = [(s, i, f"2024-{m:02d}", float((s * m + len(i)) % 7 + 1)) for s in range(30) for i in ("I", "JJ") for m in range(1, 7) if (s + m) % 11]
    spark.createDataFrame(rows, "scheme_id long, isin string, report_month string, quantity double").write.parquet(str(tmp_path / "h"))
    holdings = spark.read.parquet(str(tmp_path / "h"))
    peers = peer_median_ratios(holdings)
    assert not broadcast(peers, "scheme_id")
    peers.write.parquet(str(tmp_path / "p"))
    none = spark.createDataFrame([], "isin string, effective_month string, confirmed int")
    issues = quantity_ratio_issues(holdings, spark.read.parquet(str(tmp_path / "p")), none)
    assert "peer_median_ratio" in plan(issues) and not [x for x in broadcast(issues, "isin") if "scheme_id" in x]
    keys, written = ["isin", "report_month", "prev_month"], spark.read.parquet(str(tmp_path / "p")).drop("peer_median_ratio")
    rounds = leave_one_out_median(written, keys, "ratio", "m", ordered=5)
    assert not [x for x in broadcast(rounds, "isin") if "BuildLeft" in x]
    assert {tuple(r) for r in rounds.collect()} == {tuple(r) for r in leave_one_out_median(written, keys, "ratio", "m").collect()} and rounds.count() > 200


def test_selection_narrows_any_shape_of_values(spark):
    """Runs of equal values, far outliers and even spacing, every rank of the middle, narrowed in many rounds."""
    shapes = {"even": [float(i) for i in range(1001)], "ties": [1.0] * 600 + [2.0] * 500 + [float(i) for i in range(300)], "far": [10.0 ** (i % 300) for i in range(700)], "none": [5.0] * 200,
              "few": [1.0, 2.0], None: [float(i * i) for i in range(400)]}
    frame = spark.createDataFrame([(k, v) for k, vs in shapes.items() for v in vs], "k string, v double")
    got = {r.k: r.median for r in exact_median(frame, ["k"], "v", ordered=10).collect()}
    assert got == {k: statistics.median(v) for k, v in shapes.items()}
    groups = frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    ranks = {f"r{i}": F.ceil(F.col("n") * i / 7) for i in range(8)} | {"beyond": F.col("n") + 1}
    for r in ranked_values(frame, groups, ["k"], "v", ranks, ordered=10).collect():
        values = sorted(shapes[r.k])
        assert r.r0 is None and r.beyond is None
        assert [r[f"r{i}"] for i in range(1, 8)] == [values[-(-len(values) * i // 7) - 1] for i in range(1, 8)]
