"""Exact substring deduplication: seed on winnowed anchors, extend both ways, keep long maximal repeats.

Seeds: in every window of ``threshold`` words the smallest hash of its 8-word sequences is the anchor, so two
equal windows have the same anchor at the same place. Consecutive windows with one anchor form its context.
Anchors that occur once are dropped by a count.

Extension: occurrences of an anchor that agree on the whole context, to the left and to the right, are maximal
matches over all of it and are represented by one of them. Where an anchor has several contexts, each is
extended step by step: the windows around the anchor, from the one that reaches furthest left to the one that
reaches furthest right, are matched one by one with those of the other contexts. A match is kept from the
threshold on; the union of the matches of a document is the union of its maximal repeats.

Nothing is gathered by anchor: contexts and windows are counted by keys with partial aggregation, so an anchor
that a third of all documents share costs as many rows as it has occurrences, never its pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from folioflux.llm.rows import attach, quoted, spaced_words, table, unfold

THRESHOLD = 35
ANCHOR = 8
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)   # odd multipliers of the two word-sequence hashes
_MASK = (1 << 64) - 1
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


class Spans:
    """64-bit hashes of any run of words of one document, in constant time each."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        power, inverse = self._powers.get(base, (np.ones(1, np.uint64),) * 2)
        if len(power) <= n:
            size = max(1 << 12, 1 << n.bit_length())
            power, inverse = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, x, np.uint64)), dtype=np.uint64)
                              for x in (base, pow(base, -1, 1 << 64)))
            self._powers[base] = power, inverse
        self.inverse = inverse
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, threshold: int):
    """(first window, windows, anchor hash, context hash) of each run of windows with one anchor."""
    n = len(hashes) - threshold + 1
    if n < 1:
        return [np.zeros(0, np.int64)] * 4
    place = np.arange(len(hashes) - ANCHOR + 1)
    seeds = Spans(hashes, _BASES[0]).of(place, place + ANCHOR)
    smallest = np.lib.stride_tricks.sliding_window_view(seeds, threshold - ANCHOR + 1).argmin(axis=1) + np.arange(n)
    start = np.flatnonzero(np.append(True, smallest[1:] != smallest[:-1]))
    count = np.diff(np.append(start, n))
    at = smallest[start]
    whole = Spans(hashes, _BASES[1]).of(start, start + count + threshold - 1)
    # Two contexts are the same only if the anchor stands at the same place in them.
    return start, count, seeds[at].view(np.int64), (whole + (at - start).astype(np.uint64)).view(np.int64)


def repeats(docs: DataFrame, id_column: str, text: str, threshold: int) -> DataFrame:
    """(id, th, found): for each text, starts and bit masks of windows whose words also start elsewhere."""
    source = docs.select(quoted(id_column).alias("id"), quoted(text).alias("text")) \
        .withColumn("th", F.xxhash64("text")).filter(F.col("text").isNotNull())

    def seeds():
        def fn(texts):
            at, rows = [], []
            for k, t in enumerate(texts):
                rows.append(anchors(word_hashes(spaced_words(t)), threshold))
                at.append(np.full(len(rows[-1][0]), k))
            if not rows:
                return [], [[]] * 4
            return np.concatenate(at), [np.concatenate(c) for c in zip(*rows, strict=True)]
        return fn
    fields = [StructField("start", IntegerType()), StructField("m", IntegerType()), StructField("h", LongType()), StructField("c", LongType())]
    found = table(unfold(source, "text", ["id", "th"], fields, seeds), "anchors")

    again = found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")) \
        .filter(F.col("n") > 1).select("h", (F.col("least") == F.col("most")).alias("one"))
    # Sums are written before they are joined back: a join straight behind its aggregate cannot split a hot key.
    found = table(found.join(table(again, "repeated_anchors"), "h"), "shared_anchors")
    one, several = found.filter("one"), found.filter(~F.col("one"))

    # One occurrence stands for each context of an anchor with several; its windows are matched with the others'.
    contexts = several.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "start", "m")).alias("at"))
    wanted = contexts.groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th")) \
        .agg(F.collect_set(F.struct("h", "c", "n", F.col("at.start").alias("start"), F.col("at.m").alias("m"))).alias("contexts"))
    texts = source.withColumnRenamed("id", "rid").withColumnRenamed("th", "rth").join(
        wanted, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rth") == F.col("th"))).select("text", "contexts")

    def extend():
        def fn(texts, wanted):
            out = []
            for t, contexts in zip(texts, wanted, strict=True):
                hashes = Spans(word_hashes(spaced_words(t)), _BASES[1])
                size = np.array([x["m"] for x in contexts])
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = np.repeat([x["start"] for x in contexts], size) + step
                w = hashes.of(start, start + threshold).view(np.int64)
                ends = np.cumsum(size)
                out.append([w[e - s:e] for s, e in zip(size, ends, strict=True)])
            return [out]
        return fn
    windows = attach(texts, "text", [StructField("windows", ArrayType(ArrayType(LongType())))], extend, keep=["contexts"], extra=["contexts"])
    windows = windows.select(F.explode(F.arrays_zip("contexts", "windows")).alias("x")) \
        .select("x.contexts.h", "x.contexts.c", "x.contexts.n", F.posexplode("x.windows").alias("j", "w"))
    windows = table(windows, "windows")
    # The same window of the same context may come twice, from repeated rows; it is told by where it stands.
    own = F.xxhash64("c", "j")
    matched = windows.groupBy("h", "w").agg(F.max("n").alias("n"), F.min(own).alias("least"), F.max(own).alias("most")) \
        .filter((F.col("n") > 1) | (F.col("least") != F.col("most"))).select("h", "w")
    masks = windows.join(table(matched, "matched"), ["h", "w"]).groupBy("h", "c").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    marked = one.select("id", "th", "start", F.expr("shiftleft(1L, m) - 1").alias("mask")) \
        .unionByName(several.join(table(masks, "masks"), ["h", "c"]).select("id", "th", "start", "mask"))
    return marked.groupBy("id", "th").agg(F.collect_set(F.struct("start", "mask")).alias("found"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_words, n_removed, removed_spans, kept_text) for every row.

    Each word inside a run of ``threshold`` (at most 70) words that also starts elsewhere, in the same document
    or another, is removed; all copies lose it. kept_text joins the other words with one space. A null or empty
    text has no words and an empty kept_text. Repeated rows repeat each other's words and lose them; rows with
    one id but other texts, and rows without id, are kept apart. An empty table gives an empty result.
    """
    if not ANCHOR < threshold <= 70:
        raise ValueError("threshold must lie between 9 and 70 words")
    found = repeats(docs, id_column, text, threshold)
    source = docs.select(quoted(id_column).alias("rid"), quoted(text).alias("text")).withColumn("rth", F.xxhash64("text"))
    joined = source.join(found, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rth") == F.col("th")), "left") \
        .select(F.col("rid").alias("id"), "text", "found")

    def cut():
        def fn(texts, marks):
            out = []
            for t, found in zip(texts, marks, strict=True):
                words = spaced_words(t)
                change = np.zeros(len(words) + 1, np.int64)
                for x in found or ():
                    start, mask = x["start"], x["mask"] & _MASK
                    while mask:
                        skip = (mask & -mask).bit_length() - 1
                        mask >>= skip
                        run = (~mask & (mask + 1)).bit_length() - 1   # consecutive windows
                        start += skip
                        change[start] += 1
                        change[start + run + threshold - 1] -= 1
                        mask >>= run
                        start += run
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
                spans, kept, at = list(zip(edges[::2], edges[1::2], strict=True)), [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                out.append((len(words), int(gone.sum()), spans, b" ".join(kept + words[at:])))
            return list(zip(*out, strict=True)) or [[]] * 4
        return fn
    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()),
              StructField("removed_spans", ArrayType(SPAN)), StructField("kept_text", StringType())]
    return attach(joined, "text", fields, cut, keep=["id"], extra=["found"])
