"""Importance resampling: the ratio of two hashed n-gram models scores a text, Gumbel top-k draws the sample.

Both models are bags of hashed words, word pairs and marks (runs of ASCII punctuation). The raw model counts every
document; the target model counts good documents and leans to the raw model where it has little to go by. Each task adds up its own counts before anything is shuffled, and only the two vectors
of ``BUCKETS`` numbers reach the driver and the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from folioflux.llm.rows import attach, plain_words, quoted, table

BUCKETS = 1 << 18
TARGET_DOCS = 20_000    # bound on the good documents the target model is fitted on
SMOOTHING = 20.0        # occurrences of each bucket added as the raw model expects them
HELD = 1 << 20          # grams counted at once in a task
SHARE = 0.75            # of the documents drawn
SEED = 7


_MARKS = bytes(b if b < 128 and not chr(b).isalnum() else 32 for b in range(256))


def grams(text: bytes | None, buckets: int) -> np.ndarray:
    """Bucket of every word, every pair of neighbours and every mark."""
    words, marks = plain_words(text), (text or b"").translate(_MARKS).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    m = np.fromiter(map(xxhash.xxh64_intdigest, marks), np.uint64, len(marks))
    return (np.concatenate((h, m, pairs ^ (pairs >> np.uint64(32)))) % np.uint64(buckets)).astype(np.int64)


def gram_counts(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts."""
    def run(batches):
        total, held, size = np.zeros(buckets, np.int64), [np.zeros(0, np.int64)], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(grams(t, buckets))
                size += len(held[-1])
                if size > HELD:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        total += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = docs.select(quoted(text).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()    # at most one row per bucket
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, narrowed down by counts in 4,096 cells at a time; exact at any number of rows."""
    if k < 1:
        return None
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None:
        return None
    parts, inside = 4096, values.select(F.col(column).alias("x"))
    while low < high:
        width = (high - low) / parts
        # Down to neighbouring doubles each value is a cell of its own.
        cell = F.least(F.lit(parts - 1), F.floor((F.col("x") - F.lit(low)) / F.lit(width))) if low + width > low else F.col("x")
        rows = inside.filter(F.col("x").between(low, high)).groupBy(cell.alias("cell")) \
            .agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy(F.desc("cell")).collect()
        for row in rows:
            if row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    return low


def resample(docs: DataFrame, target_ids: DataFrame, id_column: str = "doc_id", text: str = "text", share: float = SHARE,
             buckets: int = BUCKETS, target_docs: int = TARGET_DOCS, seed: int = SEED) -> DataFrame:
    """(id, n_grams, log_ratio, gumbel_key, selected) for every row.

    log_ratio sums log(target / raw) over the grams of a text; gumbel_key adds Gumbel noise drawn from the seed
    and the id. The ``share`` of the rows with the largest keys is selected; rows that tie with the last one are
    selected too. ``target_ids`` (a column ``id_column``) names the good documents; the target model is fitted on
    at most ``target_docs`` of them, taken by the order of a hash. A null or empty text has no grams and a ratio of
    zero. Repeated rows share noise and verdict; rows without id share theirs. Without good documents every ratio
    is zero. An empty table gives an empty result.
    """
    source = docs.select(quoted(id_column).alias("id"), quoted(text).alias("text"))
    good = target_ids.select(quoted(id_column).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(target_docs)
    # The limit proves the size: at most target_docs ids.
    target = gram_counts(source.join(F.broadcast(good), "id", "left_semi"), "text", buckets)
    raw = gram_counts(source, "text", buckets)
    expected = raw * (target.sum() / max(1, raw.sum()))
    ratio = np.log(target + SMOOTHING) - np.log(expected + SMOOTHING)
    model = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        weights = model.value

        def fn(texts):
            all_ = [grams(t, buckets) for t in texts]
            return [[len(g) for g in all_], [round(float(weights[g].sum()), 6) for g in all_]]
        return fn
    scored = attach(source, "text", [StructField("n_grams", LongType()), StructField("log_ratio", DoubleType())], make, keep=["id"])
    even = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) + 0.5) / float(1 << 53)
    scored = table(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(even))), "scores")
    last = kth_largest(scored, "gumbel_key", int(np.ceil(share * scored.count())))
    return scored.withColumn("selected", F.col("gumbel_key") >= F.lit(last) if last is not None else F.lit(False))
