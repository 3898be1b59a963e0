"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflux.llm.rows import table


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b); root is the smallest node of its component.

    Each round links all larger neighbours of a node to its smallest neighbour (large star), then its
    smaller neighbours likewise (small star), until nothing changes: a number of rounds that grows with the
    logarithm of the largest component. Minima are combined before the shuffle and written, so the joins on a
    node are plain equi-joins that adaptive execution splits and a node with very many neighbours is no single
    task. Every round continues from written tables.
    """
    now = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter(F.col("u") != F.col("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter(F.col("v") > F.col("u")).join(least, "u") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        large = table(large, "large")
        low = table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = table(small, "edges")
        before, seen = seen, _digest(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
