"""Content fingerprints and immutable release snapshots."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.sources.staging import cut

# Supported calculation rules.
RULES_VERSION = "current"
LEGACY_RULES_VERSION = "legacy"
SUPPORTED_RULES = (RULES_VERSION, LEGACY_RULES_VERSION)


# The column that names a row's month, in the order looked for; a table without one is a single leaf.
MONTH_COLUMNS = ("report_month", "effective_month", "quarter_end")


def month_of_row(columns: list[str]) -> Column:
    found = next((c for c in MONTH_COLUMNS if c in columns), None)
    return F.coalesce(F.substring(F.col(found).cast("string"), 1, 7), F.lit("")) if found else F.lit("")


def month_digests(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """(table_name, month, n_rows, digest): the leaves of a table's tree, one for each month.

    A leaf is the SHA-256 of its row count and of four sums over the rows' own SHA-256, cut into four numbers of 60 bits:
    independent of row order and partitioning, and a row more or less or another one changes it. Each number is added up as
    three of 20 bits, which stay exact in a bigint for 2^43 rows, and only a leaf's sums are put together as decimals.
    """
    columns = sorted(columns or df.columns)
    # Each cell leads with its length, so no two rows share a text and a missing cell is no text at all.
    cell = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    rows = df.select(month_of_row(df.columns).alias("month"), F.sha2(F.concat_ws("|", *[cell(F.col(c).cast("string")) for c in columns]), 256).alias("h"))
    numbers = rows.select("month", *[F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("bigint").alias(f"p{i}") for i in range(4)])
    parts = [F.sum(F.shiftright(f"p{i}", 20 * j).bitwiseAND(F.lit(2 ** 20 - 1))).alias(f"s{i}{j}") for i in range(4) for j in range(3)]
    sums = numbers.groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    whole = lambda i: sum(F.col(f"s{i}{j}").cast("decimal(38,0)") * F.lit(2 ** (20 * j)) for j in range(3)).cast("decimal(38,0)").cast("string")
    return sums.select(F.lit(name).alias("table_name"), "month", "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), *map(whole, range(4))), 256).alias("digest"))


def table_digest(leaves: DataFrame, name: str) -> DataFrame:
    """(table_name, n_rows, digest) of a table from its leaves: the SHA-256 of its months with their digests, in order."""
    lines = F.sort_array(F.collect_list(F.concat_ws(":", "month", "digest")))     # a line a month
    return leaves.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"), F.sha2(F.concat_ws("\n", lines), 256).alias("digest")) \
        .select(F.lit(name).alias("table_name"), "n_rows", "digest")


def content_fingerprint(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_digest(month_digests(tables[name], name, (columns or {}).get(name)), name) for name in sorted(tables)])


def folder_months(spark: SparkSession, path: str, column: str = "report_month") -> dict[str, str]:
    """The state of each month of a table stored by month: a digest of its files' names, lengths and times."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for folder in system.listStatus(root):
        key, _, month = folder.getPath().getName().partition("=")
        if key == column:
            files = sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in system.listStatus(folder.getPath()))
            out[month] = hashlib.sha256("\n".join(files).encode()).hexdigest()
    return out


def stored_leaves(spark: SparkSession, path: str, name: str, known: DataFrame | None = None, column: str = "report_month") -> DataFrame:
    """(table_name, month, n_rows, digest, state, read_now) of a table stored by month.

    Months whose files are those of the ``known`` leaves keep their digest and are not read again; the scan is pruned to
    the others. Months that are gone have no leaf.
    """
    states = spark.createDataFrame(sorted(folder_months(spark, path, column).items()) or [], "month string, state string")
    if known is None:
        same = states.limit(0).select("month", "state").withColumns({"n_rows": F.lit(0).cast("bigint"), "digest": F.lit("")})
    else:
        same = states.join(known.select("month", "state", "n_rows", "digest"), ["month", "state"])
    fresh = states.join(same.select("month"), "month", "left_anti")
    months = [r.month for r in fresh.collect()]           # months of the calendar
    rows = spark.read.parquet(path).withColumn(column, F.col(column).cast("string")).filter(F.col(column).isin(*months))
    read = month_digests(rows, name).join(fresh, "month")
    fields = ["table_name", "month", "n_rows", "digest", "state", "read_now"]
    return read.withColumn("read_now", F.lit(True)).select(*fields).unionByName(
        same.withColumn("table_name", F.lit(name)).withColumn("read_now", F.lit(False)).select(*fields))


def changed_months(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, month, change): months added, removed or changed between two sets of leaves."""
    keys = ["table_name", "month"]
    both = before.select(*keys, F.col("digest").alias("b")).join(after.select(*keys, F.col("digest").alias("a")), keys, "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def release_id(fingerprint: DataFrame, rules_version: str = RULES_VERSION) -> str:
    """SHA-256 over the rules version and the per-table fingerprints (one row per table)."""
    if rules_version not in SUPPORTED_RULES:
        raise ValueError(f"unsupported rules version {rules_version!r}")
    lines = F.sort_array(F.collect_list(F.concat_ws(":", "table_name", F.col("n_rows").cast("string"), "digest")))
    return fingerprint.agg(F.sha2(F.concat_ws("\n", F.lit(rules_version), F.concat_ws("\n", lines)), 256)).first()[0]


def write_release(spark: SparkSession, root: str, tables: dict[str, DataFrame], rules_version: str = RULES_VERSION,
                  parent: str | None = None) -> str:
    """Copy all tables below ``release=<id>`` with a manifest; an existing release is left as it is.

    The rows are digested once: the id and both manifests are made from the month digests, a line a month and table.
    """
    leaves = cut(reduce(DataFrame.unionByName, [month_digests(df, name) for name, df in sorted(tables.items())]))
    fingerprint = reduce(DataFrame.unionByName, [table_digest(leaves.filter(F.col("table_name") == name), name) for name in sorted(tables)])
    rid = release_id(fingerprint, rules_version)
    base = f"{root.rstrip('/')}/release={rid}"
    manifest_path = f"{base}/manifest_rows"
    try:
        spark.read.parquet(manifest_path)
        return rid
    except AnalysisException:
        pass  # no manifest: whatever an earlier attempt has left is written anew
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    leaves.coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest_months")
    manifest = (fingerprint.withColumn("release_id", F.lit(rid)).withColumn("rules_version", F.lit(rules_version))
                .withColumn("parent", F.lit(parent).cast("string")))
    # The manifest is written last: a release without one is incomplete and is never read.
    manifest.coalesce(1).write.mode("overwrite").parquet(manifest_path)
    return rid


def release_leaves(spark: SparkSession, root: str, rid: str) -> DataFrame:
    """The month digests kept in a release's manifest; two releases are compared without reading their tables."""
    return spark.read.parquet(f"{root.rstrip('/')}/release={rid}/manifest_months")


def read_release(spark: SparkSession, root: str, rid: str) -> dict[str, DataFrame]:
    """Tables of a release, after recomputing and checking its fingerprint."""
    base = f"{root.rstrip('/')}/release={rid}"
    manifest = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/manifest_rows/")
    rows = manifest.select("table_name", "rules_version").collect()
    tables = {row.table_name: spark.read.parquet(f"{base}/{row.table_name}") for row in rows}
    if release_id(content_fingerprint(tables), rows[0].rules_version) != rid:
        raise ValueError(f"release {rid} does not match its fingerprint")
    return tables
