"""SimHash near-duplicates through a Gray-order hierarchical index over the distinct fingerprints.

Upper nodes of the index are masked bit patterns: two fingerprints that differ in at most three bits agree
on one of four blocks of sixteen bits, so each fingerprint enters the four nodes of its blocks. A node with
more than ``NODE`` members is factored again: its free bits are cut into four blocks and its members enter
the four nodes below, by the same argument without losing a pair. After five such levels fifteen bits are
free, which bounds a node by 32,768 fingerprints.

Inside a node the members are sorted by Gray rank and grouped into a tree. A group keeps the bits its
members share; a search adds up the differences to the shared bits on its way down and drops a whole group
as soon as they exceed the limit. A task returns no pairs but a star per connected set, so a large group of
near copies leaves as many rows as it has members.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from folioflux.llm.components import connected_components
from folioflux.llm.rows import attach, quoted, spaced_words, table

SHINGLE, BITS = 3, 3
NODE = 2048             # members above which an upper node is factored again
LEVELS = 5
FAN = 8                 # children of a group in the tree of a node
FRONTIER = 1 << 21      # comparisons held at once in a task
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, as a signed number; zero for a text without words."""
    words = spaced_words(text.translate(ASCII_LOWER)) if text else []
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64, n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def block_masks(free: int, count: int) -> list[int]:
    """Cut the set bits of ``free`` into ``count`` runs of nearly equal length."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [len(bits) * k // count for k in range(count + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def upper_nodes(prints: DataFrame, bits: int, node: int) -> DataFrame:
    """(mask, pattern, fp): the members of every upper node."""
    spark = prints.sparkSession
    full, blocks = (1 << 64) - 1, bits + 1
    masks = block_masks(full, blocks)
    enter = lambda column: F.explode(column).alias("mask")
    nodes = prints.select("fp", enter(F.array(*[F.lit(signed(m)) for m in masks])))
    nodes = nodes.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("pattern"), "fp")
    for _ in range(LEVELS - 1):
        large = table(nodes.groupBy("mask", "pattern").count().filter(F.col("count") > node)
                      .select("mask", "pattern", F.lit(True).alias("large")), "large_nodes")
        if large.isEmpty():
            break
        # At most blocks**level masks, whatever the number of fingerprints.
        below = [(signed(m), [signed(m | x) for x in block_masks(full & ~m, blocks)]) for m in masks]
        paths = F.broadcast(spark.createDataFrame(below, "mask long, below array<long>"))
        marked = nodes.join(large, ["mask", "pattern"], "left").join(paths, "mask", "left")
        split = marked.select("fp", enter(F.when(F.col("large"), F.col("below")).otherwise(F.array("mask"))))
        nodes = table(split.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("pattern"), "fp").distinct(), "nodes")
        masks = sorted({*masks, *[m & full for _, row in below for m in row]})
    return nodes


def gray_rank(fp):
    """The place of a bit pattern in reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each of the given sizes, one after another."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def link(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of each pair; root[x] is the smallest member of x's set, before and after."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(root, np.maximum(a, b), low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def linked(fp: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """For members sorted by node, then Gray rank: the first member of each one's linked set within its node."""
    n = len(fp)
    root = np.arange(n)
    if n < 2:
        return root
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(starts, n))
    # The tree, from single members up to one group per node: first child, children, shared bits, pattern, last member.
    low, top = np.arange(n), np.arange(n) + 1
    ones, any_ = fp, fp
    levels = [(None, None, np.full(n, ~np.uint64(0)), fp, top)]
    while True:
        groups = -(-sizes // FAN)
        inside = ranges(np.zeros(len(sizes), np.int64), groups)
        first = np.repeat(starts, groups) + inside * FAN
        last = np.minimum(first + FAN, np.repeat(starts + sizes, groups))
        ones, any_ = np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(any_, first)
        shared = ~(ones ^ any_)
        top = top[last - 1]
        levels.append((first, last - first, shared, ones & shared, top))
        sizes, starts = groups, np.cumsum(groups) - groups
        if (sizes == 1).all():
            break
    home = np.repeat(np.arange(len(sizes)), np.diff(np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), n)))
    weight = np.cumsum(np.bincount(home)[home])
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + FRONTIER)))
        query = np.arange(at, min(stop, n))
        group, known = home[query], np.zeros(len(query), np.uint64)
        far = np.zeros(len(query), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            first, size, shared, pattern, end = levels[level]
            new = shared[group] & ~known
            far = far + np.bitwise_count((fp[query] ^ pattern[group]) & new)
            near = (far <= bits) & (end[group] > query + 1)
            query, group, far, known = query[near], group[near], far[near], shared[group][near]
            if level:
                size_, first_ = size[group], first[group]
                query, far, known = np.repeat(query, size_), np.repeat(far, size_), np.repeat(known, size_)
                group = ranges(first_, size_)
        link(root, query, group)
        at = stop
    return root


def star_edges(nodes: DataFrame, bits: int) -> DataFrame:
    """(a, b): each linked member of a node with the first of its set."""
    dealt = nodes.repartition("mask", "pattern").select("mask", "pattern", "fp", gray_rank(F.col("fp")).alias("rank")) \
        .sortWithinPartitions("mask", "pattern", "rank").drop("rank")

    def run(batches):
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray):
            fp = rows[:, 2].copy().view(np.uint64)
            change = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            node = np.concatenate(([0], np.cumsum(change)))
            several = np.bincount(node)[node] > 1
            fp, node = fp[several], node[several]
            root = linked(fp, node, bits)
            at = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(fp[root[at]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
            rows = held[-1]
            if not len(rows) or ((held[0][0, :2] == rows[-1, :2]).all()):
                continue
            rows = np.concatenate(held)
            # Up to the last node, which may go on in the next batch.
            cut = len(rows) - int((rows[::-1, :2] != rows[-1, :2]).any(axis=1).argmax())
            held = [rows[cut:]]
            yield solve(rows[:cut])
        if held and sum(map(len, held)):
            yield solve(np.concatenate(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _prints(docs: DataFrame, text: str, shingle: int, keep: list[str]) -> DataFrame:
    return attach(docs, text, [StructField("fp", LongType())], lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], keep=keep)


def _components(docs: DataFrame, id_column: str, text: str, shingle: int, bits: int, node: int) -> DataFrame:
    """(id, fp, root, component_id): each row's fingerprint, the fingerprint that stands for its component, and its least id."""
    source = docs.select(quoted(id_column).alias("id"), quoted(text).alias("text"))
    prints = table(_prints(source, "text", shingle, ["id"]), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    edges = star_edges(upper_nodes(distinct.select("fp"), bits, node), bits)
    roots = connected_components(edges)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "root", "component_id"), "fp").select("id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    bits: int = BITS, node: int = NODE) -> DataFrame:
    """(id, fp, component_id) for every row: fp the signed fingerprint, component_id the smallest id reachable.

    A null or empty text has fingerprint zero, linked like any other. Equal texts, ties and repeated rows share
    their fingerprint and so their component. A row without id has a component like the others but never names
    one; where no row of a component has an id, component_id is null. An empty table gives an empty result.
    Columns other than the two named are not read.
    """
    return _components(docs, id_column, text, shingle, bits, node).drop("root")


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS,
                  node: int = NODE) -> DataFrame:
    """One row of each component: one with its smallest id, or one without id where no row of it has any.

    Where rows of one id have several texts, each component that the id names keeps one of its own rows, so no text is
    lost to another text's id; which of equal ids in a component stays is the least text.
    """
    found = table(_components(docs, id_column, text, shingle, bits, node), "components")
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident, body = (names[docs.columns.index(c)] for c in (id_column, text))
    rows = docs.toDF(*names)
    stay = found.filter(F.col("id") == F.col("component_id")).groupBy("id").agg(F.count("*").alias("n"))
    kept = rows.join(stay, F.col(ident) == F.col("id"))
    # An id that one row has names its component by that row.
    held = table(found.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"), "repeated")
    none = rows.filter(F.col(ident).isNull())
    first = kept.join(held, "id", "left_anti").select(*names) if not held.isEmpty() else kept.select(*names)
    parts = [first]
    if not held.isEmpty():
        parts.append(_first_of(rows.join(held, F.col(ident) == F.col("id"), "left_semi"), found.filter(F.col("id") == F.col("component_id")), ident, body, shingle, names))
    if not none.isEmpty():
        parts.append(_first_of(none, found.filter(F.col("component_id").isNull()), ident, body, shingle, names))
    return reduce(DataFrame.unionByName, parts).toDF(*docs.columns)


def _first_of(rows: DataFrame, found: DataFrame, ident: str, body: str, shingle: int, names: list[str]) -> DataFrame:
    """Of the rows whose id and own fingerprint are among the ``found``, the one with the least text of each id and component."""
    mine = found.select(F.col("id").alias("__id"), F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    same = F.col(ident).eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp"))
    best = F.min_by(F.struct(*names), F.struct(F.coalesce(F.col(body), F.lit("")), *names))
    return _prints(rows, body, shingle, names).join(mine, same).groupBy("__id", "__root").agg(best.alias("r")).select("r.*")
