"""Load parsed files as they arrive: each file replaces the snapshots it carries.

A trigger-once file stream over the same operators as the batch loader. A
micro-batch may be run again after a failure; replacing whole snapshots makes
that harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.operators.identity import resolve_schemes
from folioflux.operators.normalize import combine_lots, loader_nav_rescale
from folioflux.sources.staging import cut
from folioflux.sources.tables import numbered, parsed_holdings_of, wide_rows, wide_schema, write_months

HOLDING = ["scheme_id", "isin", "report_month"]
STORED = [*HOLDING, "quantity", "market_value_lakhs", "pct_nav", "pct_nav_raw", "pct_nav_scale"]


def snapshots_of(lines: DataFrame, schemes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Parsed lines to holdings under stable scheme ids; unresolved names are left out for review."""
    numbered = lines.withColumn("line_no", F.monotonically_increasing_id())
    scaled = loader_nav_rescale(numbered, ["amc_name", "scheme_name", "report_month"])
    ids = resolve_schemes(lines.select("amc_name", F.col("scheme_name").alias("raw_name")), schemes, aliases).filter(
        F.col("matched_by").isin("exact", "alias", "key"))
    held = (scaled.filter(F.coalesce(F.trim("isin"), F.lit("")) != "")
            .join(ids.withColumnRenamed("raw_name", "scheme_name").select("amc_name", "scheme_name", "scheme_id"), ["amc_name", "scheme_name"]))
    return combine_lots(held, HOLDING, "line_no").select(*STORED)


def replace_snapshots(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Rewrite the months of ``incoming``, keeping the snapshots it does not carry."""
    incoming = cut(incoming)
    try:
        stored = spark.read.parquet(path).select(*STORED)
    except Exception as missing:  # the first load has no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        write_months(spark, path, incoming)
        return
    months = [r[0] for r in incoming.select("report_month").distinct().collect()]
    kept = (stored.filter(F.col("report_month").isin(months))
            .join(incoming.select("scheme_id", "report_month").distinct(), ["scheme_id", "report_month"], "left_anti").select(*STORED))
    write_months(spark, path, cut(kept.unionByName(incoming)))


def load_inbox(spark: SparkSession, inbox: str, table: str, progress: str, schemes: DataFrame, aliases: DataFrame) -> None:
    """Process the files not seen before and stop."""
    files = wide_rows(spark.readStream.schema(wide_schema()).option("escape", '"').csv(inbox))

    def load(batch: DataFrame, _batch_id: int) -> None:
        # A file arrives whole in one micro-batch, so its header does too; columns are found by name.
        replace_snapshots(spark, table, snapshots_of(parsed_holdings_of(numbered(batch)), schemes, aliases))
    files.writeStream.foreachBatch(load).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
