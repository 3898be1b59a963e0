"""Best-fit packing of token sequences: local best fit, nearly full bins out, the rest merged up a tree.

Texts become token pieces of at most one sequence. Tasks pack blocks of pieces by best-fit decreasing; nearly
full bins are final. Underfull bins are the items of the next round, in fewer tasks, as many as their number
asks for, until they fit one block or a round no longer joins any. A bin carries its members, at most one per
token, so nothing is joined back.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from folioflux.llm.rows import quoted, table, unfold

CAPACITY = 1024
END = 2                 # id put after each document
NEARLY_FULL = 0.99      # filled share from which a bin is final
BLOCK_ITEMS = 50_000    # items packed together
KNOWN_PARTS = 250_000   # encoded parts a worker remembers, and as many older ones
KNOWN_CHARS = 40        # characters of the longest part it remembers
# Fixed value: the pattern by which this byte-level vocabulary cuts texts into words.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Odd(Exception):
    """A part that does not encode alone."""


class Encoder(dict):
    """Token ids of whole texts as little-endian 32-bit numbers, remembering the parts between spaces.

    The byte-level vocabulary cuts a text before each single space, so the part from one space to the next encodes
    alone unless white space meets that space. Texts with such white space or the name of a special token are
    encoded by ``tokenizers`` as a whole. Where the vocabulary numbers its merges in order, as byte-level ones do,
    a new part is encoded by ``tiktoken`` from the same file's vocabulary: the same ids several times faster.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: dict[str, bytes] = {}
        self.part = self.ordered(path) or self.whole

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ordered(self, path: str) -> Callable[[str], list[int]] | None:
        from tiktoken import Encoding

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        words = {w: i for w, i in model["vocab"].items() if w not in self.special}
        if any(words.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(words) != 256 + len(merges):
            return None
        ranks = {bytes(letters[c] for c in w): i for w, i in words.items()}
        return Encoding("words", pat_str=CUT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace():
            raise Odd
        if len(self) >= KNOWN_PARTS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(part) or array("I", self.part(" " + part)).tobytes()
        # Only short parts: in scripts without spaces a part is a whole paragraph.
        if len(part) <= KNOWN_CHARS:
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            first, *parts = text.split(" ")
            try:
                return b"".join([array("I", self.part(first)).tobytes(), *map(self.__getitem__, parts)])
            except Odd:
                pass
        return array("I", self.whole(text)).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path)


def tokenize(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
             end: int = END, keep_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut into pieces.

    Only a text of more than ``capacity`` ids is cut; its first piece takes the remainder. A null text counts
    as empty and gives the end id alone. Rows are taken one by one: repeated rows and rows without id each
    give their pieces.
    """
    last = np.array([end], "<u4").tobytes()

    def make():
        encode = encoder(tokenizer).encode

        def fn(texts):
            at, rows = [], []
            for k, t in enumerate(texts):
                ids = encode((t or b"").decode("utf-8", "replace")) + last
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a:4 * b]
                    at.append(k)
                    rows.append((piece, a, b - a, zlib.crc32(part), part)[:4 + keep_ids])
            return at, list(zip(*rows, strict=True)) or [[]] * (4 + keep_ids)
        return fn
    fields = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
              StructField("ids_crc32", LongType()), StructField("ids", BinaryType())][:4 + keep_ids]
    source = docs.select(quoted(id_column).alias("id"), quoted(text).alias("text"))
    return unfold(source, "text", ["id"], fields, make)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, largest items first, each into the fullest bin that takes it; fill of each bin."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]   # open bins by free places
    open_ = 0                                                   # bit f is set if room[f] has a bin
    filled: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                open_ &= ~(1 << free)
        else:
            b, free = len(filled), capacity
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        left = free - size
        if left:
            room[left].append(b)
            open_ |= 1 << left
    return bins, offsets, filled


def _round(items: DataFrame, number: int, capacity: int, least: int) -> DataFrame:
    """One round: items (size, members) become bins (bin, size, done, members), in blocks within each task."""
    schema = StructType([StructField("bin", LongType()), StructField("size", IntegerType()), *[items.schema["members"]]])

    def run(batches):
        task, given = TaskContext.get().partitionId(), 0
        held, count = [], 0

        def pack():
            nonlocal given
            rows = pa.Table.from_batches(held).combine_chunks()
            sizes = rows.column("size").to_numpy()
            bins, offsets, filled = best_fit(sizes, capacity)
            members = rows.column("members").to_pylist()
            inside: list[list] = [[] for _ in filled]
            for i in np.lexsort((offsets, bins)).tolist():
                shift = int(offsets[i])
                inside[bins[i]].extend([m | {"offset": m["offset"] + shift} for m in members[i]] if shift else members[i])
            numbers = (number << 56) + (task << 32) + given + np.arange(len(filled))
            given += len(filled)
            for lo in range(0, len(filled), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[lo:lo + 5000]), pa.array(filled[lo:lo + 5000], pa.int32()),
                                                  pa.array(inside[lo:lo + 5000], rows.schema.field("members").type)], names=schema.names)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK_ITEMS:
                yield from pack()
                held, count = [], 0
        if count:
            yield from pack()

    packed = items.select("size", "members").mapInArrow(run, schema)
    return table(packed.withColumn("done", F.col("size") >= least), f"round{number}")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """The pieces with sequence_id and offset: gapless sequences of at most ``capacity``.

    ``pieces`` has a column length of 1 to ``capacity``; its other columns come back as they are. Ties and
    repeated rows are packed one by one; an empty table gives an empty result.
    """
    pieces = table(pieces, "pieces")
    columns = pieces.columns
    least = math.ceil(nearly_full * capacity)
    member = F.struct(*[quoted(c).alias(f"m{i}") for i, c in enumerate(columns)], F.lit(0).cast("long").alias("offset"))
    items = pieces.select(F.col("length").cast("int").alias("size"), F.array(member).alias("members"))
    rounds, number, before = [], 0, None
    while True:
        made = _round(items, number, capacity, least)
        rest = made.filter(~F.col("done"))
        left = rest.count()
        tasks = math.ceil(left / BLOCK_ITEMS)
        # Done when one task has seen all that is left, or a round has joined next to nothing.
        if left == 0 or before is not None and (before[1] == 1 or left > 0.98 * before[0]):
            rounds.append(made)
            break
        rounds.append(made.filter("done"))
        before, number = (left, tasks), number + 1
        items = rest.select("size", "members").repartition(tasks)
    bins = rounds[0]
    for r in rounds[1:]:
        bins = bins.unionByName(r)
    return bins.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")) \
        .select(*[F.col(f"m.m{i}").alias(c) for i, c in enumerate(columns)], "sequence_id", "m.offset")
