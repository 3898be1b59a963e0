"""Readers and keyed writers of the stored tables.

Writers replace by key or by month. Pure functions return the new table
contents; ``write_months`` applies them to a month-partitioned Parquet table,
touching only the partitions involved.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflux.functions import columns as C
from folioflux.functions.classify import EXCHANGE_ISIN_PATTERN
from folioflux.sources.staging import cut

# Required columns, exchange layouts and series.
PARSED_REQUIRED = ("isin", "instrument_name", "quantity", "market_value_lakhs", "pct_nav", "scheme_name", "amc_name", "report_month")
PARSED_OPTIONAL = ("industry", "pct_nav_raw", "pct_nav_scale", "scheme_title", "dropped_non_isin_count", "dropped_non_isin_pct_nav",
                   "source_sha256", "source_workbook", "source_sheet", "source_row", "source_url", "source_retrieved_at",
                   "source_published_at", "source_raw_json", "parser_version")
LAYOUTS = (
    {"isin": "ISIN", "symbol": "TckrSymb", "series": "SctySrs", "close_price": "ClsPric", "_volume": "TtlTradgVol", "traded_value": "TtlTrfVal"},
    {"isin": "ISIN", "symbol": "SYMBOL", "series": "SERIES", "close_price": "CLOSE", "_volume": "TOTTRDQTY", "traded_value": "TOTTRDVAL"},
)
QUOTE_REQUIRED = ("isin", "symbol", "series", "close_price")
EQUITY_SERIES = ("EQ", "BE", "BZ", "SM", "ST")
FILING_REQUIRED = ("isin", "quarter_end", "promoter_pct", "fii_pct", "dii_pct", "public_pct", "source")
FILING_OPTIONAL = ("filing_type", "validation_status", "source_url", "source_sha256", "mf_pct", "published_at")


class RefusedInput(ValueError):
    """The whole batch is refused before anything is written."""


def _refuse(df: DataFrame, checks: dict[str, Column], what: str) -> None:
    """One aggregate pass over all checks; raises naming the failed ones."""
    row = df.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in checks.items()]).first()
    failed = {name: row[name] for name in checks if row[name]}
    if failed:
        raise RefusedInput(f"{what}: {failed}")


WIDTH = 96          # columns of the widest file


def wide_schema() -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(WIDTH + 1)])


def wide_rows(rows: DataFrame) -> DataFrame:
    """(file, line, first_block, cells) of CSV rows read with ``wide_schema``: lines of a file ascend in its order."""
    return rows.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first_block"),
                       F.array(*wide_schema().names).alias("cells"))


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("line", F.monotonically_increasing_id())


def by_header(rows: DataFrame, accepted: list[list[str]], wanted: dict[str, list[str]]) -> DataFrame:
    """(file, line, the wanted columns) of numbered wide rows, as text.

    A file's header is its first line. It fits the first of the ``accepted`` lists whose names it all has, whatever their
    order; a file that fits none, or is wider than WIDTH, refuses the batch. ``wanted`` gives each column's name under
    each list. Headers are rows like the others, found by file and joined back: no file name reaches the driver, and a
    column that a file lacks is NULL there.
    """
    rows = cut(rows)        # read once: for the headers and for the lines
    names = F.transform("cells", lambda c: F.trim(F.regexp_replace(c, "^\ufeff", "")))
    heads = rows.filter("first_block").groupBy("file").agg(F.min("line").alias("_head"), F.min_by("cells", "line").alias("cells")).withColumn("_names", names)
    fits = F.lit(None).cast("int")
    for i, need in reversed(list(enumerate(accepted))):
        fits = F.when(reduce(and_, [F.coalesce(F.array_contains("_names", n), F.lit(False)) for n in need]), i).otherwise(fits)
    heads = heads.withColumn("_fits", F.when(F.get("cells", F.lit(WIDTH)).isNull(), fits))
    _refuse(heads, {"files_without_the_columns": F.col("_fits").isNull()}, f"columns of {accepted}")
    at = {c: F.array_position("_names", F.element_at(F.array(*map(F.lit, under)), F.col("_fits") + 1)) for c, under in wanted.items()}
    heads = heads.select("file", "_head", *[F.when(n > 0, n.cast("int") - 1).alias(f"_at_{c}") for c, n in at.items()])
    return rows.join(heads, "file").filter(F.col("line") != F.col("_head")) \
        .select("file", "line", *[F.get("cells", F.col(f"_at_{c}")).alias(c) for c in wanted])


def _csv_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return numbered(wide_rows(spark.read.schema(wide_schema()).option("escape", '"').csv(paths)))


# -- parsed holdings --------------------------------------------------------------------

def parsed_holdings_of(rows: DataFrame) -> DataFrame:
    """Parser output from numbered wide rows: numbers parsed, the whole input refused when malformed."""
    text = by_header(rows, [list(PARSED_REQUIRED)], {c: [c] for c in PARSED_REQUIRED + PARSED_OPTIONAL})
    _refuse(text, {"blank_amc_name": F.coalesce(F.trim("amc_name") == "", F.lit(True)),
                   "blank_scheme_name": F.coalesce(F.trim("scheme_name") == "", F.lit(True)),
                   "bad_report_month": ~C.is_report_month("report_month")}, "parsed holdings")
    return text.withColumns({c: C.finite(c) for c in ("quantity", "market_value_lakhs", "pct_nav", "pct_nav_raw")})


def read_parsed_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Parser output CSV files by name; optional columns that a file lacks are NULL."""
    return parsed_holdings_of(_csv_files(spark, path)).drop("file", "line")


# -- exchange closes ----------------------------------------------------------------------

def _closes(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One quote per (day, security) of text columns, the most traded: a keyed max_by, combined map-side."""
    cleaned = {"isin": F.upper(F.trim("isin")), "symbol": F.trim("symbol"), "series": F.trim("series"), "close_price": C.finite("close_price"),
               "_volume": F.coalesce(C.non_negative("_volume"), F.lit(0.0)), "traded_value": C.non_negative("traded_value")}
    rows = rows.select(*keys, *[c.alias(name) for name, c in cleaned.items()])
    rows = rows.filter(F.col("series").isin(*EQUITY_SERIES) & F.col("isin").rlike(EXCHANGE_ISIN_PATTERN) & (F.col("close_price") > 0))
    quote = F.struct("close_price", "traded_value", "series", "symbol")
    return (rows.groupBy(*keys, "isin").agg(F.max_by(quote, F.struct("_volume", "series", "symbol")).alias("q"))
            .select(*keys, "isin", "q.*", F.lit("nse_bhavcopy").alias("source")))


def normalize_closes(raw: DataFrame, keys: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Equity closes from text columns of either exchange layout."""
    layout = next((x for x in LAYOUTS if all(x[c] in raw.columns for c in QUOTE_REQUIRED)), None)
    if layout is None:
        raise RefusedInput(f"neither exchange layout matches columns {sorted(raw.columns)}")
    column = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    return _closes(raw.select(*keys, *[column(layout[name]).alias(name) for name in layout]), keys)


def read_bhavcopy(spark: SparkSession, paths: list[str] | str, trade_date: Column | None = None) -> DataFrame:
    """Daily exchange files of either layout, mixed as they come; the day comes from a column or from the caller."""
    wanted = {c: [x[c] for x in LAYOUTS] for c in LAYOUTS[0]} | {"TradDt": ["TradDt"] * len(LAYOUTS)}
    rows = by_header(_csv_files(spark, paths), [[x[c] for c in QUOTE_REQUIRED] for x in LAYOUTS], wanted)
    day = trade_date if trade_date is not None else F.col("TradDt").try_cast("date")
    return _closes(rows.withColumn("trade_date", day), ("trade_date",))


# -- keyed replacement ------------------------------------------------------------------------

def latest_per_key(incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Last write wins within one batch: by ``order``, or as the rows come."""
    rest = [c for c in incoming.columns if c not in keys]
    rows = incoming if order else incoming.withColumn("_row", F.monotonically_increasing_id())
    last = F.struct(*(order or ["_row"]), *rest) if order else F.struct("_row")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), last).alias("r")).select(*[c if c in keys else f"r.{c}" for c in incoming.columns])


def keyed_upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Stored rows whose key is not replaced, plus the last incoming row of each key."""
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(latest_per_key(incoming, keys, order), allowMissingColumns=True)


def checked_prices(incoming: DataFrame) -> DataFrame:
    """The batch with numbers; refused when any close is not finite and positive."""
    _refuse(incoming, {"bad_close": ~(C.finite("close_price") > 0)}, "prices")
    clean = incoming.withColumn("close_price", C.finite("close_price"))
    return clean.withColumn("traded_value", C.non_negative("traded_value")) if "traded_value" in incoming.columns else clean


def checked_shareholding(incoming: DataFrame) -> DataFrame:
    """The batch under its stored column names; refused when a required column is missing."""
    missing = set(FILING_REQUIRED) - set(incoming.columns)
    if missing:
        raise RefusedInput(f"shareholding records are missing columns {sorted(missing)}")
    if "ixbrl_sha256" in incoming.columns and "source_sha256" not in incoming.columns:
        incoming = incoming.withColumnRenamed("ixbrl_sha256", "source_sha256")
    return incoming.select(*[c for c in FILING_REQUIRED + FILING_OPTIONAL if c in incoming.columns])


def upsert_prices(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Monthly or daily closes."""
    return keyed_upsert(stored, checked_prices(incoming), keys, order)


def upsert_shareholding(stored: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> DataFrame:
    return keyed_upsert(stored, checked_shareholding(incoming), ["isin", "quarter_end"], order)


PARTS = ["period", "part"]


def merge_keyed(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], period: Column, order: list[str] | None = None, parts: int = 8) -> None:
    """Merge a batch into a Parquet table by key, rewriting only the partitions its keys belong to.

    A row's partition follows from its key: ``period``, an expression of the key, and a digest of the key. The last row of
    a key within the batch counts (see ``latest_per_key``). Untouched partitions keep their files; repeating the merge
    after a failure gives the same table, as every touched partition is made from the old one and the batch and replaced at
    the commit. Only the touched partitions' names reach the driver.
    """
    digest = {"period": period.cast("string"), "part": F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")}
    new = cut(latest_per_key(incoming, keys, order).withColumns(digest))
    touched = new.select(*PARTS).distinct().collect()
    if not touched:
        return
    merged = new
    if _exists(spark, path):
        inside = reduce(or_, [(F.col("period") == r["period"]) & (F.col("part") == r["part"]) for r in touched])
        stored = spark.read.schema(_with_parts(spark, path, new)).parquet(path).filter(inside)
        # Written aside first: a partition cannot be replaced while it is read.
        merged = cut(stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True))
    merged.repartition(*PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A merged table; columns that later batches added are NULL in older partitions."""
    return spark.read.option("mergeSchema", True).parquet(path).drop(*PARTS)


def _with_parts(spark: SparkSession, path: str, new: DataFrame) -> T.StructType:
    """The stored columns and those the batch adds; the partition columns as they are written."""
    stored = spark.read.option("mergeSchema", True).parquet(path).schema
    named = {f.name for f in stored.fields}
    kinds = {"period": T.StringType(), "part": T.IntegerType()}
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in stored.fields] + [f for f in new.schema.fields if f.name not in named])


def merge_prices(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], order: list[str] | None = None, parts: int = 8) -> None:
    """Monthly or daily closes into their table, by month of the key."""
    month = F.col("report_month") if "report_month" in keys else F.date_format("trade_date", "yyyy-MM")
    merge_keyed(spark, path, checked_prices(incoming), keys, month, order, parts)


def merge_shareholding(spark: SparkSession, path: str, incoming: DataFrame, order: list[str] | None = None, parts: int = 8) -> None:
    """Ownership filings into their table, by quarter end."""
    extra = [c for c in order or [] if c not in FILING_REQUIRED + FILING_OPTIONAL]
    last = latest_per_key(incoming, ["isin", "quarter_end"], order) if extra else incoming
    merge_keyed(spark, path, checked_shareholding(last), ["isin", "quarter_end"], F.col("quarter_end").cast("string"), None if extra else order, parts)


def replace_months(stored: DataFrame, incoming: DataFrame, also: list[str] = ()) -> DataFrame:
    """Every month present in ``incoming`` -- and every month in ``also``, even with no rows -- is replaced."""
    numbers = [f.name for f in incoming.schema.fields if f.dataType.simpleString() == "double"]
    clean = incoming.withColumns({c: C.finite(c) for c in numbers})
    kept = stored.join(incoming.select("report_month").distinct(), "report_month", "left_anti").select(*stored.columns)
    if also:
        kept = kept.filter(~F.col("report_month").isin(*also))
    return kept.unionByName(clean)


def write_months(spark: SparkSession, path: str, incoming: DataFrame, also: list[str] = ()) -> None:
    """Overwrite the month partitions of ``incoming``; months of ``also`` without rows are emptied.

    Dynamic partition overwrite leaves partitions without new rows alone, so an
    emptied month's folder is removed through the file system of the table.
    """
    present = {r[0] for r in incoming.select("report_month").distinct().collect()}
    # Adaptive execution merges small months and cuts large ones by size.
    (incoming.hint("rebalance", "report_month")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_month").parquet(path))
    jvm = spark.sparkContext._jvm
    for month in sorted(set(also) - present):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/report_month={month}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# -- evidence -----------------------------------------------------------------------------------

EVIDENCE_KEY = ["scheme_id", "report_month", "source_sha256", "sheet", "row_number", "parser_version"]


def append_evidence(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Original rows are append-only: a key already stored is ignored."""
    return stored.unionByName(incoming.dropDuplicates(EVIDENCE_KEY).join(stored.select(*EVIDENCE_KEY), EVIDENCE_KEY, "left_anti").select(*stored.columns))


def replace_snapshot_sources(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    keys = ["scheme_id", "report_month"]
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").select(*stored.columns).unionByName(incoming.select(*stored.columns))


def merge_disclosure_sources(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New url and publication win when known; the first retrieval time is kept."""
    new = incoming.select("sha256", *[F.col(c).alias(f"_n_{c}") for c in ("workbook_name", "source_url", "retrieved_at", "published_at")])
    joined = stored.join(new, "sha256", "full_outer")
    return joined.select(
        "sha256", F.coalesce("workbook_name", "_n_workbook_name").alias("workbook_name"), F.coalesce("_n_source_url", "source_url").alias("source_url"),
        F.coalesce("retrieved_at", "_n_retrieved_at").alias("retrieved_at"), F.coalesce("_n_published_at", "published_at").alias("published_at"))


# -- official inventories ---------------------------------------------------------------------------

def inventory_problems(documents: DataFrame, schemes: DataFrame) -> DataFrame:
    """(amc_name, report_month, problem) of inventory documents with their funds as an array of structs."""
    keys = ["amc_name", "report_month"]
    sha_ok = F.col("source_sha256").rlike("^[a-f0-9]{64}$")
    head = documents.select(*keys, F.array_compact(F.array(
        F.when(~C.is_report_month("report_month"), "bad_report_month"),
        F.when(~F.coalesce(F.col("source_url").rlike(r"^https://[^/]+"), F.lit(False)), "not_https"),
        F.when(~F.coalesce(sha_ok, F.lit(False)), "bad_sha256"),
        F.when(F.col("exhaustive").isNull() | F.coalesce(F.col("reviewed_at") == "", F.lit(True)), "not_reviewed"),
        F.when(F.coalesce(F.size("funds"), F.lit(0)) <= 0, "no_funds"))).alias("p"))
    funds = documents.select(*keys, F.explode("funds").alias("f")).select(*keys, "f.*")
    counts = funds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("official_key").alias("k"), F.count("scheme_id").alias("m"), F.count_distinct("scheme_id").alias("d"),
        F.count_if(F.col("active_eligible").isNull() | F.col("equity_eligible").isNull()).alias("unclear"),
        F.count_if(~F.col("equity_eligible") & (F.coalesce("exclusion_reason", F.lit("")) == "")).alias("unexplained"))
    owners = funds.filter(F.col("scheme_id").isNotNull()).join(schemes.select("scheme_id", F.col("amc_name").alias("_o")), "scheme_id", "left")
    foreign = owners.filter(~F.coalesce(F.col("_o") == F.col("amc_name"), F.lit(False))).select(*keys, F.lit("scheme_of_another_house").alias("problem")).distinct()
    body = counts.select(*keys, F.array_compact(F.array(
        F.when(F.col("k") != F.col("n"), "duplicate_official_key"), F.when(F.col("d") != F.col("m"), "duplicate_scheme"),
        F.when(F.col("unclear") > 0, "eligibility_not_boolean"), F.when(F.col("unexplained") > 0, "missing_exclusion_reason"))).alias("p"))
    return head.unionByName(body).select(*keys, F.explode("p").alias("problem")).unionByName(foreign)


def import_inventory(inventories: DataFrame, expected: DataFrame, documents: DataFrame, schemes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both inventory tables after replacing the documents' (house, month) entries; any problem refuses the import."""
    problems = inventory_problems(documents, schemes).count()
    if problems:
        raise RefusedInput(f"{problems} problems; inventory_problems lists them all")
    keys = ["amc_name", "report_month"]
    head = documents.select(*keys, "source_url", "source_sha256", F.col("exhaustive").cast("int").alias("exhaustive"))
    funds = documents.select(*keys, F.explode("funds").alias("f")).select(
        *keys, "f.official_key", "f.official_name", "f.scheme_id", F.col("f.active_eligible").cast("int").alias("active_eligible"),
        F.col("f.equity_eligible").cast("int").alias("equity_eligible"), "f.exclusion_reason")
    kept = expected.join(documents.select(*keys), keys, "left_anti").select(*funds.columns)
    return keyed_upsert(inventories.select(*head.columns), head, keys), kept.unionByName(funds)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_documents(df: DataFrame, key: str) -> DataFrame:
    """One JSON document per row, keyed."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("document"))
