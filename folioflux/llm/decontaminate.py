"""Benchmark decontamination by Wu-Manber multi-pattern search over word numbers.

Every 13-word window of a benchmark item (a shorter item is one window) is a pattern. Patterns of one
length share a shift table over blocks of two words: a block that no pattern contains lets the search
jump by almost a whole pattern. Where the shift is zero, the suffix block selects a bucket, its first
word a list of patterns, and direct comparison of the words confirms an occurrence.

The benchmark reaches the tasks in blocks of bounded size. Each block is one pass over the rows, which
carry what earlier blocks found, so nothing is shuffled and no broadcast grows with the benchmark.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from folioflux.llm.rows import attach, plain_words, quoted

WINDOW = 13
BLOCK_BYTES = 4 << 20
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
FOUND = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()),
         StructField("items", ArrayType(StringType())), StructField("hit_spans", ArrayType(SPAN)),
         StructField("contaminated", BooleanType())]
CARRIED = [StructField("__hits", BinaryType()), StructField("__items", ArrayType(StringType()))]


class Patterns:
    """Shift tables and suffix buckets, one set per pattern length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        named: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in plain_words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                named[tuple(ids[i:i + size])].add(name)
        self.width = len(self.number) + 1
        self.sets: list[tuple[int, int, dict, dict]] = []
        for size in sorted({len(p) for p in named}):
            block = min(2, size)
            shift: dict[int, int] = {}
            buckets: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
            for pattern, names in named.items():
                if len(pattern) != size:
                    continue
                for end in range(block - 1, size):
                    key = self.block(pattern, end, block)
                    shift[key] = min(shift.get(key, size), size - 1 - end)
                buckets[self.block(pattern, size - 1, block)][pattern[0]].append((list(pattern), names))
            self.sets.append((size, block, shift, buckets))

    def block(self, ids, end: int, block: int) -> int:
        return ids[end - 1] * self.width + ids[end] if block == 2 else ids[end]

    def search(self, words: list[bytes], hits: bytearray, found: set[str]) -> None:
        ids = [self.number.get(w, 0) for w in words]
        n, width = len(ids), self.width
        for size, block, shift, buckets in self.sets:
            jump, end = size - block + 1, size - 1
            while end < n:
                key = ids[end - 1] * width + ids[end] if block == 2 else ids[end]
                step = shift.get(key, jump)
                if step:
                    end += step
                    continue
                start = end - size + 1
                for pattern, names in buckets[key].get(ids[start], ()):
                    if ids[start:end + 1] == pattern:
                        hits[start:end + 1] = b"\1" * size
                        found |= names
                end += 1


def runs(hits: bytes) -> list[tuple[int, int]]:
    """Spans of consecutive marked words."""
    spans, at = [], hits.find(b"\1")
    while at >= 0:
        end = hits.find(b"\0", at)
        end = len(hits) if end < 0 else end
        spans.append((at, end))
        at = hits.find(b"\1", end)
    return spans


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """Split the items into blocks of at most about ``block_bytes`` (a longer item is a block of its own)."""
    items = benchmark.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")).alias("item"),
                             F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("text")).distinct()
    size = F.octet_length("text") + F.lit(64)
    count = max(1, math.ceil((items.agg(F.sum(size)).first()[0] or 0) / block_bytes))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
        over = dealt.groupBy("block").agg(F.sum(size).alias("b"), F.count("*").alias("n")) \
            .filter((F.col("b") > 2 * block_bytes) & (F.col("n") > 1)).limit(1).count()
        if count == 1 or not over:
            break
        count *= 2
    for k in range(count):
        yield [(r["item"], bytes(r["text"])) for r in dealt.filter(F.col("block") == k).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, share: int = 20,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every input row with n_words, n_hit, n_items, items, hit_spans and contaminated.

    contaminated: some word is hit and ``share * n_hit >= n_words``. A null or empty text has no words and
    is clean. Rows are judged one by one, so repeated rows and rows without id each get their result.
    Items: repeated ids are one item; a null id is named by the empty string; items without words match
    nothing; an empty benchmark hits nothing. Columns of the input that clash with a result are replaced.
    """
    context = docs.sparkSession.sparkContext
    columns = docs.columns
    blocks = [context.broadcast(b) for b in benchmark_blocks(benchmark, item_id, item_text, block_bytes)]
    frame = docs.withColumns({"__hits": F.lit(None).cast("binary"), "__items": F.lit(None).cast("array<string>")})
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1

        def make(block=block, last=last):
            patterns = Patterns(block.value, window)

            def fn(texts, hits, items):
                out = []
                for t, h, named in zip(texts, hits, items, strict=True):
                    words = plain_words(t)
                    marked, found = bytearray(h or bytes(len(words))), set(named or ())
                    patterns.search(words, marked, found)
                    if last:
                        n, n_hit = len(words), marked.count(1)
                        out.append((n, n_hit, len(found), sorted(found), runs(marked), n_hit > 0 and share * n_hit >= n))
                    else:
                        out.append((bytes(marked), sorted(found)))
                return list(zip(*out, strict=True)) or [[]] * (6 if last else 2)
            return fn
        # The text stays a column of the frame until the last pass; only there is it also a result.
        frame = attach(frame, text, FOUND if last else CARRIED, make, keep=columns, extra=["__hits", "__items"])
    return frame
