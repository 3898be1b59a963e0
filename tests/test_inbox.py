"""Files arriving one after the other replace their snapshots and leave the others alone."""

from folioflux.operators import identity as I
from folioflux.sources.tables import PARSED_OPTIONAL, PARSED_REQUIRED
from folioflux.streaming.inbox import load_inbox

COLUMNS = PARSED_REQUIRED + PARSED_OPTIONAL


def write(path, rows):
    lines = [",".join(COLUMNS)]
    for scheme, month, isin, quantity in rows:
        cells = dict(isin=isin, instrument_name="N", quantity=quantity, market_value_lakhs=50, pct_nav=50, scheme_name=scheme, amc_name="A AMC",
                     report_month=month, pct_nav_scale="percent")
        lines.append(",".join(str(cells.get(c, "")) for c in COLUMNS))
    path.write_text("\n".join(lines))


def test_corrected_file_replaces_its_snapshot(spark, tmp_path):
    inbox, table, progress = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "progress")
    inbox.mkdir()
    schemes = spark.createDataFrame([(1, "A AMC", "A Flexi"), (2, "A AMC", "A Mid")], "scheme_id bigint, amc_name string, scheme_name string")
    schemes, aliases = I.backfill_identity(schemes)
    write(inbox / "1.csv", [("A Flexi", "2026-07", "INE002A01018", 10), ("A Flexi", "2026-07", "INE040A01034", 10), ("A Mid", "2026-07", "INE002A01018", 7)])
    load_inbox(spark, str(inbox), table, progress, schemes, aliases)
    assert spark.read.parquet(table).count() == 3
    write(inbox / "2.csv", [("A  FLEXI", "2026-07", "INE002A01018", 12), ("A Flexi", "2026-08", "INE002A01018", 5), ("A Flexi", "2026-08", "INE002A01018", 6)])
    load_inbox(spark, str(inbox), table, progress, schemes, aliases)
    got = {(r.scheme_id, r.report_month, r.isin): r.quantity for r in spark.read.parquet(table).collect()}
    assert got == {(1, "2026-07", "INE002A01018"): 12.0, (2, "2026-07", "INE002A01018"): 7.0, (1, "2026-08", "INE002A01018"): 11.0}


def test_files_with_few_columns_in_any_order(spark, tmp_path):
    inbox, table, progress = tmp_path / "in box", str(tmp_path / "table"), str(tmp_path / "progress")
    inbox.mkdir()
    schemes, aliases = I.backfill_identity(spark.createDataFrame([(1, "A AMC", "A Flexi")], "scheme_id bigint, amc_name string, scheme_name string"))
    cells = dict(isin="INE002A01018", instrument_name='"N, ""x"""', quantity="3", market_value_lakhs="50", pct_nav="50", scheme_name="A Flexi", amc_name="A AMC", report_month="2026-07")
    (inbox / "a b.csv").write_text(",".join(reversed(cells)) + "\n" + ",".join(reversed(cells.values())) + "\n")
    load_inbox(spark, str(inbox), table, progress, schemes, aliases)
    assert [(r.isin, r.quantity) for r in spark.read.parquet(table).collect()] == [("INE002A01018", 3.0)]
