"""Byte-level BPE encoding and decoding; long unsplit text by tree concatenation.

Text without a long unsplit run, one that the vocabulary's pattern does not cut, is encoded by ``tiktoken`` from the same
file, where all its characters have had their classes since before any of the libraries' tables; other text is cut as
``tokenizers`` cuts it. A long unsplit run is encoded as a tree: its halves encode by themselves, and at each join the last tokens of the one and the first of the
other are encoded again as one window, which grows until its first token is the left half's and its last token the
right half's. Where merges are numbered in order a sequence of tokens is the encoding of its bytes if each two
neighbours are, so all beyond such a window stands.

Texts of over LONG characters go to many tasks: leaves of at most LEAF characters, cut between words or, in an unsplit run,
anywhere, encode in parallel; neighbours are joined level by level, each level from a written table.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from folioflux.llm.rows import attach, quoted, table, unfold

LONG = 100_000          # characters from which a text is dealt to many tasks
LEAF = 32_768           # characters of a dealt leaf
UNSPLIT = 256           # bytes of a run from which it is encoded as a tree, and of the tree's leaves
WINDOW = 8              # tokens first looked at on each side of a join
SETTLED = "\u0500"      # characters below, Latin, Greek and Cyrillic, are classed alike by all tables of characters
# Fixed value: the pattern by which this byte-level vocabulary cuts texts into words.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A place before a single space between two other characters is a cut in any text.
SAFE = re.compile(r"(?<=\S)(?= \S)")
RUN = re.compile(rf"\S{{{UNSPLIT}}}|\s{{{UNSPLIT}}}")


def byte_letters() -> list[str]:
    """The letter of each byte: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Codec:
    """Encodes and decodes as ``tokenizers`` does with the same file; its parts must be a byte-level BPE."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, before = made["model"], made["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        numbers = [model["vocab"].get(a + b, -1) for a, b in merges]
        plain = (made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
                 and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")))
        if not plain or any(a >= b for a, b in zip(numbers, numbers[1:], strict=False)) or -1 in numbers:
            raise ValueError("not a byte-level BPE whose merges are numbered in order")
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take their surroundings along are not supported")
        letters = byte_letters()
        self.special = {t.content: i for i, t in added.items()}
        self.named = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        back = {c: b for b, c in enumerate(letters)}
        self.letters = dict(enumerate(letters))
        size = max([*model["vocab"].values(), *added]) + 1
        self.word = [""] * size
        self.bytes = [b""] * size
        for w, i in model["vocab"].items():
            self.word[i] = w
            # A word with letters that stand for no byte is written as it is.
            self.bytes[i] = bytes(back[c] for c in w) if all(c in back for c in w) else w.encode()
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        ranks = {self.bytes[i]: i for w, i in model["vocab"].items() if w not in self.special}
        # Its own merges follow the ids, so it stands in where every id is that of its merge.
        same = len(ranks) == 256 + len(merges) == 256 + numbers[-1] - 255 and numbers[0] == 256
        self.quick = Encoding("words", pat_str=CUT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if same else None

    # -- runs ---------------------------------------------------------------------------

    def run(self, letters: str) -> list[int]:
        """Ids of an unsplit run, given in byte letters."""
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def tree(self, letters: str) -> list[int]:
        """The same by halves."""
        if len(letters) <= UNSPLIT:
            return self.run(letters)
        half = len(letters) // 2
        return self.join(self.tree(letters[:half]), self.tree(letters[half:]))

    def join(self, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
        """The ids of two neighbouring parts of a run as one: a window at the join grows until both sides agree."""
        a, b = max(0, len(left) - window), min(len(right), window)
        while True:
            ids = self.run("".join([self.word[i] for i in left[a:]] + [self.word[i] for i in right[:b]]))
            before = a == 0 or ids[0] == left[a]
            after = b == len(right) or ids[-1] == right[b - 1]
            if before and after:
                return [*left[:a], *ids, *right[b:]]
            if not before:
                a = max(0, 2 * a - len(left))
            if not after:
                b = min(len(right), 2 * b)

    # -- texts --------------------------------------------------------------------------

    def plain(self, text: str) -> bytes:
        """Ids, as native 32-bit numbers, of a text that begins and ends at cuts and names no special token."""
        if not text:
            return b""
        if self.quick and max(text) < SETTLED and not RUN.search(text):
            return array("I", self.quick(text)).tobytes()
        out: list[int] = []
        for part in SAFE.split(text):
            if self.quick and len(part) < UNSPLIT and max(part) < SETTLED:
                out += self.quick(part)
            else:
                for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    out += self.tree(letters)
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        if self.named is None or not self.named.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.named.finditer(text):
            out += [self.plain(text[at:m.start()]), array("I", [self.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; unknown ids give nothing, bytes that are no UTF-8 the mark for it."""
        table, size = self.bytes, len(self.bytes)
        return b"".join([table[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")

    def leaves(self, text: str, leaf: int) -> list[tuple[int, str]]:
        """(kind, text) of the leaves: 0 for text between cuts, 1 and 2 for the first and further parts of an unsplit
        run, 3 for a special token."""
        out: list[tuple[int, str]] = []
        spans, at = [], 0
        for m in self.named.finditer(text) if self.named else ():
            spans += [(0, text[at:m.start()]), (3, m.group())]
            at = m.end()
        for kind, part in [*spans, (0, text[at:])]:
            if kind:
                out.append((3, part))
                continue
            start = end = 0                 # the open leaf, and the last place behind it that cuts in any text
            for _, (lo, hi) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part) if part else ():
                if lo > start and not part[lo - 1].isspace():
                    end = lo
                if hi - start > leaf and end > start:
                    out.append((0, part[start:end]))
                    start = end
                if hi - lo > leaf and start == lo:
                    out += [(1 + (i > lo), part[i:min(i + leaf, hi)]) for i in range(lo, hi, leaf)]
                    start = end = hi
            if start < len(part):
                out.append((0, part[start:]))
        return out

    def leaf(self, kind: int, text: str) -> tuple[bool, bool, int, int, bytes]:
        """(inside, whole, head, tail, ids): whether the leaf goes on with the run before it and is nothing but a run,
        and how many of its first and last ids belong to a run that neighbours may go on with."""
        if kind == 3:
            return False, False, 0, 0, array("I", [self.special[text]]).tobytes()
        if kind == 0:
            return False, False, 0, 0, self.plain(text)
        ids = self.tree(text.encode().decode("latin-1").translate(self.letters))
        return kind == 2, True, len(ids), len(ids), array("I", ids).tobytes()

    def neighbours(self, x: tuple, y: tuple) -> tuple[bool, bool, int, int, bytes]:
        """Two neighbouring nodes as one; the ids on either side of a join inside a run are joined as a run."""
        inside, whole, head, tail, left = x
        goes_on, whole_y, head_y, tail_y, right = y
        if not goes_on:
            return inside, False, head, tail_y, left + right
        run = array("I", self.join(memoryview(left).cast("I")[len(left) // 4 - tail:].tolist(), memoryview(right).cast("I")[:head_y].tolist()))
        ids = left[:len(left) - 4 * tail] + run.tobytes() + right[4 * head_y:]
        return inside, whole and whole_y, len(run) if whole else head, len(run) if whole_y else tail_y, ids


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each worker process, which serves many tasks."""
    return Codec(path)


FIELDS = [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))]
NODE = [StructField("inside", BooleanType()), StructField("whole", BooleanType()), StructField("head", LongType()),
        StructField("tail", LongType()), StructField("tokens", BinaryType())]


def _listed(tokens: list[bytes]) -> tuple[list[int], list[np.ndarray]]:
    return [len(t) // 4 for t in tokens], [np.frombuffer(t, np.int32) for t in tokens]


def _decoded(text: bytes | None) -> str:
    return (text or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """The kept columns (all but ``text`` by default) with n_tokens and ids of each whole text.

    A null text counts as empty and has no ids. Rows are taken one by one, so repeated rows and rows without id each
    give their result; a kept column named like a result is replaced by it. An empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_tokens", "ids") and (keep is not None or c != text)]
    size = F.length(quoted(text))

    def whole():
        one = codec(tokenizer).encode
        return lambda texts: _listed([one(_decoded(t)) for t in texts])

    short = attach(docs.filter(F.coalesce(size <= long, F.lit(True))), text, FIELDS, whole, keep)
    dealt = docs.filter(size > long).select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], quoted(text).alias("text"))
    dealt = table(dealt.withColumn("key", F.monotonically_increasing_id()), "long")
    if dealt.isEmpty():
        return short

    def cut():
        one = codec(tokenizer).leaves

        def fn(texts):
            rows = [(k, n, kind, part) for k, t in enumerate(texts) for n, (kind, part) in enumerate(one(_decoded(t), leaf))]
            at, *columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            return at, columns
        return fn

    def leaves():
        one = codec(tokenizer).leaf
        return lambda texts, kinds: list(zip(*[one(k, _decoded(t)) for t, k in zip(texts, kinds, strict=True)], strict=True)) or [[]] * 5

    pieces = unfold(dealt, "text", ["key"], [StructField("node", LongType()), StructField("kind", IntegerType()), StructField("piece", StringType())], cut)
    nodes = table(attach(pieces.repartition("key", "node"), "piece", NODE, leaves, ["key", "node"], ["kind"]), "leaves")
    last = nodes.agg(F.max("node")).first()[0]
    while last:
        nodes, last = table(_level(nodes, tokenizer), "level"), last >> 1
    ids = attach(nodes, "tokens", FIELDS, lambda: _listed, ["key"])
    back = dealt.drop("text").join(ids, "key").select(*[f"c{i}" for i in range(len(keep))], "n_tokens", "ids")
    return short.union(back.toDF(*short.columns))


def _level(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Each even node with the odd node behind it as one; a last even node stays as it is."""
    names = [f.name for f in NODE]
    side = lambda bit, of: nodes.filter(F.col("node") % 2 == bit).select(
        "key", F.shiftright("node", 1).alias("node"), *[F.col(n).alias(of + n) for n in names])
    pairs = side(0, "x_").join(side(1, "y_"), ["key", "node"], "left")
    schema = StructType([*[nodes.schema[c] for c in ("key", "node")], *NODE])

    def run(batches):
        one = codec(tokenizer).neighbours
        for batch in batches:
            rows = batch.to_pydict()
            x = zip(*[rows["x_" + n] for n in names], strict=True)
            y = zip(*[rows["y_" + n] for n in names], strict=True)
            made = [one(a, b) if b[0] is not None else a for a, b in zip(x, y, strict=True)]
            columns = zip(*made, strict=True) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"),
                                              *[pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, NODE, strict=True)]], names=schema.names)

    return pairs.mapInArrow(run, schema)


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with the text of ``ids``, special tokens included; null ids give null."""
    keep = [c for c in (tokens.columns if keep is None else keep) if c.lower() != out.lower()]
    source = tokens.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(ids).alias("ids"))
    schema = StructType([*source.schema[:-1], StructField("decoded", StringType())])

    def run(batches):
        one = codec(tokenizer).decode
        for batch in batches:
            column = batch.column("ids")
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            texts = [one(flat[a:b].tolist()) if known else None for a, b, known in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, out)
