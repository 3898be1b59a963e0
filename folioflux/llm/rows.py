"""Row-wise Arrow passes, ASCII word rules and shared tables used by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from folioflux.sources.staging import required_folder

# Lower-cases A-Z; every ASCII byte that is neither a digit nor a letter becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPACES = b" \t\n\v\f\r"


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, unchanged."""
    return text.split() if text else []


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def attach(df: DataFrame, text: str, fields: list[StructField], make: Callable[[], Callable[[list], Iterable]],
           keep: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Append columns computed from the bytes of ``text``, one Arrow batch at a time.

    ``make()`` runs once per task and returns ``fn(texts, *extra_values) -> one list per field``.
    ``keep`` names the columns carried along (default all); a carried column that clashes with a
    new field is replaced by it. ``extra`` names further columns handed to ``fn`` as Python values.
    """
    taken = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    extra = extra or []
    source = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)], quoted(text).cast("binary").alias("text"),
                       *[quoted(c).alias(f"x{i}") for i, c in enumerate(extra)])
    n, types = len(kept), [to_arrow_type(f.dataType) for f in fields]
    schema = StructType([source.schema[i] for i in range(n)] + [StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)])
    names = schema.names

    def run(batches):
        fn = make()
        for batch in batches:
            columns = fn(*[batch.column(i).to_pylist() for i in range(n, batch.num_columns)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], *[pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]], names=names)

    return source.mapInArrow(run, schema).toDF(*kept, *[f.name for f in fields])


def unfold(df: DataFrame, text: str, keep: list[str], fields: list[StructField], make) -> DataFrame:
    """Like ``attach``, but ``fn`` returns (row numbers, one list per field): any number of rows per input row."""
    source = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text).cast("binary").alias("text"))
    n, types = len(keep), [to_arrow_type(f.dataType) for f in fields]
    schema = StructType([source.schema[i] for i in range(n)] + [StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)])
    names = schema.names

    def run(batches):
        fn = make()
        for batch in batches:
            at, columns = fn(batch.column(n).to_pylist())
            at = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(at) for i in range(n)],
                 *[pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]], names=names)

    return source.mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])


def table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once below the shared folder and go on from the file: cuts lineage, survives lost executors."""
    path = f"{required_folder(df.sparkSession)}/folioflux-llm/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
