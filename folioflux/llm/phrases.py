"""Phrase collocations from depth-truncated suffix trees, built group by group of word prefixes.

The suffixes of every piece of text, cut after the longest phrase, are first added up into distinct suffixes with
counts. Word prefixes share them out: a prefix that begins more suffixes than a quarter of the memory budget is
lengthened by a word, until none does; groups of prefixes are then made by a hash, in as many groups as keep each
within the budget, which is checked. One task builds the subtree of one group by itself: its leaves are the distinct
suffixes, the count of a phrase is the total of the leaves below its node. Only nodes above the prefixes, which several
groups share, are added up again.

Prefixes of one and two words are counted before, in one pass. A phrase of at least ``least`` occurrences has only pairs
of words of at least ``least`` occurrences, so a suffix ends before a pair that is rarer, and one of a single word needs no
tree. Pairs are counted by a hash, in ranges whose number follows the text, and leave a bit table of fixed size; a false
hit there costs rows, never a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from folioflux.llm.rows import quoted, table

DEPTH = 4                   # words of the longest phrase
LEAST = 30                  # occurrences of a candidate
TOP = 2000                  # phrases reported for each language
BUDGET = 500_000            # distinct suffixes a group holds at most
BITS = 27                   # the table of frequent pairs has 2 to the power of this many bits: 16 MB, whatever the input
RANGE_BYTES = 16 << 20      # text for each range of pair hashes, which one task adds up
HELD = 1_500_000            # words a task gathers before it adds them up and sends them
HELD_BYTES = 64 << 20       # bytes of distinct words a task gathers
# A-Z in lower case; what ends a piece becomes a line feed, a tab becomes a space.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))


class Numbers(dict):
    """Numbers of the words a task meets, from 1; the end of a piece is 0, nothing between two spaces -1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})
        self.words, self.size = [b""], 0

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.size += len(word)
        number = self[word] = len(self.words) - 1
        return number

    def stream(self, text: bytes | None) -> np.ndarray:
        """The numbers of a text's words with 0 behind each piece; a null text has none."""
        parts = (text or b"").translate(PIECES).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))
        return np.append(ids[ids >= 0], np.int32(0))


def pair_keys(left: np.ndarray, right: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """32-bit keys of pairs of words of a language, from 64-bit hashes of the three."""
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    mixed = (left * odd[0] ^ (right * odd[1] >> np.uint64(29))) + right * odd[2] + lang
    mixed ^= mixed >> np.uint64(32)
    return (mixed * odd[0] >> np.uint64(32)).astype(np.uint32)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gathered(batches, use):
    """Calls ``use(numbers, stream, langs, lang of each word)`` for every HELD words or HELD_BYTES of distinct ones."""
    numbers, parts, langs, at, count = Numbers(), [], {}, [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            line = numbers.stream(text)
            parts.append(line)
            at.append((langs.setdefault(lang, len(langs)), len(line)))
            count += len(line)
            if count > HELD or numbers.size > HELD_BYTES:
                yield from use(numbers, np.concatenate(parts), [*langs], np.repeat(*np.array(at, np.int64).T))
                numbers, parts, langs, at, count = Numbers(), [], {}, [], 0
    if parts:
        yield from use(numbers, np.concatenate(parts), [*langs], np.repeat(*np.array(at, np.int64).T))


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(quoted(lang), F.lit("und")).alias("lang"), quoted(text).cast("binary").alias("text"))


def prefix_counts(rows: DataFrame, least: int) -> tuple[DataFrame, np.ndarray]:
    """One pass over the text: (lang, word, f) of the words with ``least`` occurrences, where the row of a null word has
    all of its language, and the packed bits of the pairs that may have as many."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << min(20, max(6, (size // RANGE_BYTES).bit_length()))
    shift = 32 - ranges.bit_length() + 1
    names = ["lang", "word", "f", "part", "keys", "counts"]
    types = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def send(columns):
        n = max(map(len, columns.values()))
        for lo in range(0, n, 20_000):
            m = min(20_000, n - lo)
            yield pa.RecordBatch.from_arrays([pa.array(columns[k][lo:lo + m], t) if k in columns else pa.nulls(m, t)
                                              for k, t in zip(names, types, strict=True)], names=names)

    def use(numbers, stream, langs, lang):
        # Words, and all words of each language as the word 0.
        real = stream > 0
        keys, f = np.unique(lang[real] * len(numbers.words) + stream[real], return_counts=True)
        of, word = np.divmod(keys, len(numbers.words))
        named = np.array([None, *numbers.words[1:]], object)
        yield from send({"lang": np.array(langs, object)[of], "word": named[word], "f": f})
        totals = np.bincount(lang[real], minlength=len(langs))
        yield from send({"lang": langs, "f": totals})
        h, hl = _hashes(numbers.words), _hashes([x.encode() for x in langs])
        both = np.flatnonzero(real[:-1] & real[1:])
        keys, f = np.unique(pair_keys(h[stream[both]], h[stream[both + 1]], hl[lang[both]]), return_counts=True)
        part, f = (keys >> np.uint32(shift)).astype(np.int64), np.minimum(f, 255).astype(np.uint8)
        seen, first = np.unique(part, return_index=True)
        ends = [*first[1:].tolist(), len(keys)]
        # Sorted keys are sent as their distances.
        yield from send({"part": seen, "keys": [np.diff(keys[a:b], prepend=np.uint32(0)).tobytes() for a, b in zip(first.tolist(), ends, strict=True)],
                         "counts": [f[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]})

    def add_up(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(np.frombuffer(k, np.uint32), dtype=np.uint32) for k in group.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, np.uint8) for c in group.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        # A task's count above 255 was sent as 255.
        often = keys[first][np.add.reduceat(counts, first) >= min(least, 255)]
        part = group.column("part")[0].as_py()
        bits = np.zeros((1 << BITS) // ranges, np.uint8)
        bits[(often >> np.uint32(32 - BITS)).astype(np.int64) - part * len(bits)] = 1
        return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    sent = table(rows.mapInArrow(lambda batches: gathered(batches, use), "lang string, word binary, f long, part int, keys binary, counts binary"), "prefixes")
    words = sent.filter(F.col("part").isNull()).groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = table(words.filter(F.col("word").isNull() | (F.col("f") >= least)), "words")
    found = sent.filter(F.col("part").isNotNull()).select("part", "keys", "counts").groupBy("part").applyInArrow(add_up, "part int, bits binary")
    bits = np.zeros((ranges, (1 << BITS) // ranges // 8), np.uint8)
    for r in found.collect():           # the table of fixed size, a range a row
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return words, bits.ravel()


def suffixes(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(lang, s, c): how often each run of two to DEPTH words, as long as its piece and its frequent pairs reach, starts
    anywhere; the words of ``s`` are joined by a space. Tasks add up before the shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def use(numbers, stream, langs, lang):
        h, hl = _hashes(numbers.words), _hashes([x.encode() for x in langs])
        good = np.append((stream[:-1] > 0) & (stream[1:] > 0), False)
        at = np.flatnonzero(good)
        key = pair_keys(h[stream[at]], h[stream[at + 1]], hl[lang[at]]) >> np.uint32(32 - BITS)
        good[at] = shared.value[key >> np.uint32(3)] >> (7 - (key & np.uint32(7))).astype(np.uint8) & 1
        at = np.flatnonzero(good)
        padded, goes = np.append(stream, np.zeros(DEPTH, stream.dtype)), np.append(good, np.zeros(DEPTH, bool))
        grams, on = [lang[at], padded[at], padded[at + 1]], np.ones(len(at), bool)
        for i in range(2, DEPTH):
            on = on & goes[at + i - 1]
            grams.append(padded[at + i] * on)
        order = np.lexsort(grams[::-1])
        grams = np.stack(grams, 1)[order]
        first = np.flatnonzero(np.append(len(grams) > 0, (grams[1:] != grams[:-1]).any(1))) if len(grams) else np.zeros(0, np.int64)
        c, words = np.diff(np.append(first, len(grams))), numbers.words
        for lo in range(0, len(first), 20_000):
            some = grams[first[lo:lo + 20_000]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([langs[g[0]] for g in some], pa.string()), pa.array([b" ".join([words[i] for i in g[1:] if i]) for g in some], pa.binary()),
                                              pa.array(c[lo:lo + 20_000])], names=["lang", "s", "c"])

    found = rows.mapInArrow(lambda batches: gathered(batches, use), "lang string, s binary, c long")
    return table(found.groupBy("lang", "s").agg(F.sum("c").alias("c")), "suffixes")


def partition(leaves: DataFrame, budget: int) -> DataFrame:
    """The suffixes with the length of their prefix (``depth``) and its ``group`` of at most ``budget`` suffixes.

    A prefix over a quarter of the budget is lengthened; at full depth it is one suffix. The lengthened ones are at
    most 4 x suffixes / budget at each length, so joining them back is joining a small table.
    """
    most, now = budget // 4, leaves.withColumn("depth", F.lit(1))
    prefix = lambda d: F.substring_index(F.col("s").cast("string"), " ", d)
    for d in range(1, DEPTH):
        hot = table(now.filter(F.col("depth") == d).groupBy("lang", prefix(d).alias("p")).count().filter(F.col("count") > most).select("lang", "p"), f"prefixes{d}")
        n = hot.count()
        if not n:
            break
        hot = hot.withColumn("hot", F.lit(True))
        now = now.withColumn("p", prefix(d)).join(F.broadcast(hot) if n <= 100_000 else hot, ["lang", "p"], "left") \
            .select("lang", "s", "c", F.when(F.col("hot") & (F.col("depth") == d), d + 1).otherwise(F.col("depth")).alias("depth"))
    own = F.when(F.col("depth") == 1, prefix(1))
    for d in range(2, DEPTH + 1):
        own = own.when(F.col("depth") == d, prefix(d))
    now = now.withColumn("key", F.xxhash64("lang", own))
    weights = table(now.groupBy("key").count(), "weights")
    groups = max(1, -(-2 * (weights.agg(F.sum("count")).first()[0] or 0) // budget))
    # No prefix has over a quarter of the budget, so more groups end the search.
    while groups > 1 and weights.groupBy(F.pmod("key", F.lit(groups))).agg(F.sum("count").alias("n")).filter(F.col("n") > budget).limit(1).count():
        groups *= 2
    # A group for each task, however many there are.
    return now.withColumn("group", F.pmod("key", F.lit(groups))).drop("key").repartition(groups, "group")


def subtree(group: pa.Table, least: int) -> pa.Table:
    """(lang, phrase, size, f) of the nodes of one group, from two words on, that have ``least`` occurrences or lie above
    a prefix."""
    words = pc.split_pattern(group.column("s").cast(pa.large_binary()).combine_chunks(), b" ")
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    sizes = pc.list_value_length(words).to_numpy()
    flat = pc.list_flatten(words).dictionary_encode()
    # Only equality matters: nodes are runs of equal prefixes in any fixed order of the words.
    codes = np.full((DEPTH, len(sizes)), -1, np.int64)
    starts = np.cumsum(sizes) - sizes
    numbers = flat.indices.to_numpy().astype(np.int64)
    for i in range(DEPTH):
        has = sizes > i
        codes[i, has] = numbers[starts[has] + i]
    langs = group.column("lang").combine_chunks()
    langs = (langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs).dictionary_encode()
    lang = langs.indices.to_numpy()
    order = np.lexsort([*codes[::-1], lang])
    codes, lang = codes[:, order], lang[order]
    c, depth = (group.column(n).to_numpy()[order] for n in ("c", "depth"))
    new = np.append(True, lang[1:] != lang[:-1])
    out = {k: [] for k in ("lang", "phrase", "size", "f")}
    for d in range(1, DEPTH + 1):
        new = new | np.append(True, codes[d - 1, 1:] != codes[d - 1, :-1])
        first = np.flatnonzero(new)
        totals = np.add.reduceat(c, first)
        keep = (codes[d - 1, first] >= 0) & ((totals >= least) | (depth[first] > d)) & (d > 1)
        first, totals = first[keep], totals[keep]
        if not len(first):
            continue
        node = [flat.dictionary.take(pa.array(codes[i, first])) for i in range(d)]
        out["lang"].append(langs.dictionary.take(pa.array(lang[first])))
        out["phrase"].append(pc.binary_join_element_wise(*node, pa.scalar(b" ", pa.large_binary())).cast(pa.binary()))
        out["size"].append(pa.array(np.full(len(first), d, np.int32)))
        out["f"].append(pa.array(totals))
    types = {"lang": pa.string(), "phrase": pa.binary(), "size": pa.int32(), "f": pa.int64()}
    return pa.table({k: pa.chunked_array(v, types[k]) for k, v in out.items()})


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to DEPTH words with ``least`` occurrences, and (lang, n) of all words.

    The first frame's phrases are binary, their words joined by a space. Null texts have no words; a null language
    counts as ``und``; repeated rows count each; an empty table has no phrases.
    """
    rows = _rows(docs, text, lang)
    words, bits = prefix_counts(rows, least)
    leaves = partition(suffixes(rows, bits), budget)
    nodes = leaves.groupBy("group").applyInArrow(lambda t: subtree(t, least), "lang string, phrase binary, size int, f long")
    # Nodes below a prefix are whole; those above come once from each group that shares them.
    counts = nodes.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    single = words.filter(F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
    return table(counts.unionByName(single), "phrases"), words.filter(F.col("word").isNull()).select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to DEPTH words by cohesion.

    A phrase is cut after each of its words but the last; of floor(2000000 * a / (l + r)) the least counts, with ties
    to the earliest cut, where a, l and r are the occurrences of the phrase and of the two parts. A phrase whose words
    stand in a longer candidate of at least four fifths of its occurrences is left out. Ties of score go to the more
    frequent phrase, then to the one first in byte order. See ``phrase_counts`` for nulls, repeats and empty tables;
    other columns are not read.
    """
    counts, totals = phrase_counts(docs, least, budget, text, lang)
    counts = counts.withColumn("phrase", F.col("phrase").cast("string"))
    words = F.split("phrase", " ")
    candidates = counts.filter("size > 1").withColumnRenamed("f", "a")
    part = lambda frm, size: F.array_join(F.slice(F.col("words"), frm, size), " ")
    cuts = candidates.withColumn("words", words).select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")) \
        .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = counts.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]) \
        .join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + r)")
    scored = cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # The most frequent longer candidate around each phrase.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(F.col("words"), i, n), " "))))
    around = candidates.filter("size > 2").withColumn("words", words).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a") \
        .groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = scored.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.col("around") * 5 < F.col("a") * 4))
    ranked = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score") \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    # A row for each language.
    return ranked.filter(F.col("rank") <= top).join(totals, "lang") \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
