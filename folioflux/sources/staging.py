"""Session-scoped staging of derived tables, and other run-time settings read from the session.

A staged table is written once as Parquet below the shared folder named by
``spark.checkpoint.dir`` and read back, which cuts lineage and lets several
queries start from the compact table. Every master behaves alike: a cluster
must name the folder, a local session without it uses a fresh temporary one.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}


def required_folder(spark: SparkSession) -> str:
    """The shared folder; only a local session, which is its own executor, may go without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="spark-folioflux-")
    return _local_root[app]


def folder_state(spark: SparkSession, folder: str) -> str:
    """A digest of the names, lengths and times of a folder's entries."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    entries = sorted(f"{x.getPath().getName()} {x.getLen()} {x.getModificationTime()}" for x in listed)
    return hashlib.sha256("\n".join(entries).encode()).hexdigest()[:16]


def stage(spark: SparkSession, source: str, name: str, df: DataFrame) -> DataFrame:
    """Write ``df`` once per application and source folder, then read it back."""
    root = required_folder(spark)
    app = spark.sparkContext.applicationId
    where = hashlib.sha256(source.encode()).hexdigest()[:16]
    path = f"{root}/folioflux/{app}/{where}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Compute a frame once, write it and continue from the written table.

    Used where one result feeds several branches of a plan, so its lineage is
    not planned and run once per branch; each branch reads only its columns.
    The files live in the shared folder, so a lost executor only re-reads them.
    """
    spark = df.sparkSession
    path = f"{required_folder(spark)}/folioflux/cuts/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
