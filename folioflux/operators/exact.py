"""Exact order statistics of many groups of any size, without gathering a group in one task.

Groups of up to ORDERED rows are ordered by a window, all of them in one exchange. A larger one is narrowed first, for each
wanted rank: its values are counted between the steps of an approximate histogram, the rank lies in exactly one of the
intervals, and only that interval's values go on, until few enough are left to order. Counts decide, so the histogram's
errors cost a further round and never a wrong value.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.sources.staging import cut

ORDERED = 50_000    # rows of a group that one task may order
STEPS = 64          # intervals a group is narrowed by in a round
ACCURACY = 2_000


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def large_groups(df: DataFrame, keys: list[str], ordered: int = ORDERED) -> DataFrame | None:
    """(keys, n) of the groups one task should not order, or None; there are at most rows / ``ordered`` of them."""
    large = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ordered))
    return None if large.isEmpty() else large


def ranked_values(df: DataFrame, groups: DataFrame, keys: list[str], value: str, positions: dict[str, Column], ordered: int = ORDERED) -> DataFrame:
    """``groups`` (keys, n) with the exact value at each 1-based position of its group; NULL outside of 1 to n."""
    names = list(positions)
    wanted = F.array(*[F.struct(F.lit(i).alias("_t"), at.cast("bigint").alias("_k")) for i, at in enumerate(positions.values())])
    targets = groups.select(*keys, F.explode(wanted).alias("_w")).select(*keys, "_w.*").filter("_k >= 1")
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # Equal values are one row from here on; each target follows its own values.
    rows = cut(counts.alias("l").join(targets.alias("r"), _same(keys, "l", "r")).select(*[f"l.{k}" for k in keys], "_t", "_k", "_v", "_c"))
    own, done = [*keys, "_t"], None
    while True:
        steps = F.percentile_approx("_v", [i / STEPS for i in range(1, STEPS)], ACCURACY)
        sizes = cut(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_d"), steps.alias("_g")).withColumn("_open", F.col("_d") > ordered).drop("_d"))
        # Written values are far larger than their files: never broadcast, here and below.
        joined = rows.hint("merge").alias("l").join(sizes.alias("r"), _same(own, "l", "r")).select("l.*", "_open", "_g")
        narrow = joined.filter(~F.col("_open")).drop("_open", "_g")
        done = narrow if done is None else done.unionByName(narrow)
        if sizes.filter("_open").isEmpty():
            break
        # The interval of a value is the number of steps at or below it; equal steps leave intervals empty.
        stepped = cut(joined.filter("_open").withColumn("_b", F.size(F.filter("_g", lambda x: x <= F.col("_v")))).drop("_open", "_g"))
        upto = F.sum("_w").over(W.partitionBy(*own).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow))
        intervals = stepped.groupBy(*own, "_k", "_b").agg(F.sum("_c").alias("_w")).withColumn("_upto", upto)
        chosen = intervals.filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_w") < F.col("_k"))) \
            .select(*own, "_b", (F.col("_k") - F.col("_upto") + F.col("_w")).alias("_k"))
        rows = cut(stepped.drop("_k").alias("l").join(chosen.alias("r"), _same([*own, "_b"], "l", "r"))
                   .select(*[f"l.{c}" for c in own], "r._k", "l._v", "l._c"))
    upto = F.sum("_c").over(W.partitionBy(*own).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = done.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_t") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)])
    return groups.alias("l").join(wide.alias("r"), _same(keys, "l", "r"), "left").select(*[f"l.{k}" for k in keys], "l.n", *[f"r.{name}" for name in names])


def _split(df: DataFrame, keys: list[str], large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the other groups and those of the large ones."""
    both = _same(keys, "l", "r")
    return df.alias("l").join(large.alias("r"), both, "left_anti"), df.alias("l").join(large.alias("r"), both, "left_semi")


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median", ordered: int = ORDERED) -> DataFrame:
    """keys, n and the median of each group; NULL values count for nothing."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    large = large_groups(rows, keys, ordered)
    n = F.col("n")
    lower, upper = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    some, rest = (rows, None) if large is None else _split(rows, keys, large)
    own = W.partitionBy(*keys)
    placed = some.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("_r", F.row_number().over(own.orderBy(value)))
    middle = placed.filter((F.col("_r") == lower) | (F.col("_r") == upper))
    out = middle.groupBy(*keys).agg(F.max("n").alias("n"), ((F.min(value) + F.max(value)) / 2).alias(name))
    if rest is None:
        return out
    stats = ranked_values(rest, large, keys, value, {"_lo": lower, "_hi": upper}, ordered)
    return out.unionByName(stats.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name)))


def leave_one_out_median(df: DataFrame, keys: list[str], value: str, name: str, ordered: int = ORDERED) -> DataFrame:
    """Each row with the median of the *other* rows of its group (groups of two or more).

    Leaving one value out of n ordered values moves the middle by at most one place, so three consecutive order statistics
    of the whole group and the row's own value give the answer; no pair of rows is ever formed.
    """
    large = large_groups(df.select(*keys), keys, ordered)
    n, k = F.col("n"), F.floor(F.col("n") / 2)
    some, rest = (df, None) if large is None else _split(df, keys, large)
    own = W.partitionBy(*keys)
    at = lambda place: F.max(F.when(F.col("_r") == place, F.col(value))).over(own)
    rows = some.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("_r", F.row_number().over(own.orderBy(value)))
    rows = rows.withColumns({"_x1": at(k), "_x2": at(k + 1), "_x3": at(k + 2)}).drop("_r")
    if rest is not None:
        stats = ranked_values(rest, large, keys, value, {"_x1": k, "_x2": k + 1, "_x3": k + 2}, ordered)
        more = rest.hint("merge").alias("l").join(stats.alias("r"), _same(keys, "l", "r")).select("l.*", "r.n", "r._x1", "r._x2", "r._x3")
        rows = rows.unionByName(more)
    low = F.when(F.col(value) > F.col("_x1"), F.col("_x1")).otherwise(F.col("_x2"))
    high = F.when(F.col(value) > F.col("_x2"), F.col("_x2")).otherwise(F.col("_x3"))
    median = F.when(n % 2 == 0, low).otherwise((low + high) / 2)
    return rows.filter(n >= 2).withColumn(name, median).drop("n", "_x1", "_x2", "_x3")
