"""Running state over long ordered groups, in bounded blocks.

A sheet or source may hold a third of all rows, so a plain running window
over it would run in one task. Rows are cut into blocks by their position;
the state at the end of each block is an ordinary aggregate, the carry over
blocks is a window over block totals only, and rows are finished within their
block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def last_marker(df: DataFrame, keys: list[str], row: str, marker: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The newest non-NULL ``marker`` at or before each row of its group."""
    rows = df.withColumn("_block", F.floor(F.col(row) / block_rows))
    known = F.col(marker).isNotNull()
    ends = rows.filter(known).groupBy(*keys, "_block").agg(F.max_by(marker, row).alias("_end"))
    blocks = rows.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).select(*keys, "_block", "_carry")
    within = W.partitionBy(*keys, "_block").orderBy(row).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.join(carry, [*keys, "_block"], "left")
            .withColumn(out, F.coalesce(F.last(marker, ignorenulls=True).over(within), "_carry")).drop("_block", "_carry"))
