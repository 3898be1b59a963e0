"""Quality rules on repetition, from a suffix array over the words of each document.

The suffixes of all documents of a batch are sorted together by prefix doubling; the document number leads
every key, so no comparison leaves its document. The ranks kept at each doubling give the longest common
prefix of neighbours. The innermost LCP interval around a suffix is its longest repeat; the union of those
of at least a given length are the repeated spans.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, ArrayType, StructField, StructType

from folioflux.llm.rows import SPACES, attach, spaced_words

BASE_WINDOW = 5         # words of the base rule's window
LEAST_WORDS = 10        # documents of fewer words fail
LEAST_REPEAT = 8        # words of a repeat that counts against a document
COVERED = 0.30          # largest share of words in such repeats
LONGEST = 400           # words of the longest repeat allowed
CHUNK_WORDS = 200_000   # words sorted together; a longer document is sorted alone

SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
RULES = [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    StructField("base_failed", BooleanType()), StructField("kept", BooleanType()),
    StructField("longest_repeat", LongType()), StructField("covered_words", LongType()),
    StructField("covered_fraction", DoubleType()), StructField("repeat_spans", ArrayType(SPAN))]
_CONTINUED = SPACES + bytes(range(0x80, 0xC0))


def longest_repeats(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the longest word sequence starting there that starts elsewhere in its document too."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    first = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order][1:] != first[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, step = [rank.copy()], 1
    active = order[~(new & np.append(new[1:], True))]
    while len(active):
        # Suffixes that share a rank stand together; order each such group by the rank `step` words on.
        ahead = active + step
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        base = rank[active]
        by = np.lexsort((second, base))
        active, base, second = active[by], base[by], second[by]
        group = np.ones(len(by), bool)
        group[1:] = base[1:] != base[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(by))
        inside = at[new][np.cumsum(new) - 1] - at[group][np.cumsum(group) - 1]
        rank[active] = base + inside
        active = active[~(new & np.append(new[1:], True))]
        levels.append(rank.copy())
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    # Longest common prefix of neighbours: take the largest doubling at which both still share a rank, then go on behind it.
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n + 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    i, j, total = a[live], b[live], np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < end[a[live]]) & (j < end[b[live]])
        same = np.zeros(len(live), bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        # Equal ranks at level k mean 2**k equal words, unless the document ends before.
        grow = np.where(same, np.minimum(1 << k, np.minimum(end[a[live]] - i, end[b[live]] - j)), 0)
        total, i, j = total + grow, i + grow, j + grow
    lcp[live + 1] = total
    found = np.empty(n, np.int64)
    found[order] = np.maximum(lcp[:-1], lcp[1:])
    return found


def covered(found: np.ndarray, least: int) -> np.ndarray:
    """Marks the words inside any repeat of at least ``least`` words."""
    n = len(found)
    at = np.flatnonzero(found >= least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + found[at], -1)
    return np.cumsum(change[:n]) > 0


def spans(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)]


def quality_rules(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, base_percent: int = 20,
                  least_repeat: int = LEAST_REPEAT, fraction: float = COVERED, longest: int = LONGEST,
                  keep: list[str] | None = None) -> DataFrame:
    """Every input row with its counts, repeated spans and verdict.

    base_failed: fewer than ``least_words`` words, or more than ``base_percent`` % of the words in five-word
    windows found twice or more. kept: not base_failed, the words in repeats of ``least_repeat`` words or
    more are at most ``fraction`` of all, and no repeat is longer than ``longest`` words.
    A null or empty text has no words and fails. Rows are judged one by one: ties, repeated rows and rows
    without id each get their result. Input columns that clash with a result are replaced.
    """
    def make():
        def fn(texts):
            out, chunk, held = [], [], 0

            def flush():
                number = defaultdict(count().__next__)
                sizes = [len(w) for _, w in chunk]
                ids = np.fromiter((number[w] for _, words in chunk for w in words), np.int64, sum(sizes))
                ends = np.cumsum(sizes)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                found = longest_repeats(ids, doc, ends[doc] if len(ids) else ids)
                for (t, words), stop in zip(chunk, ends, strict=True):
                    out.append(judge(t or b"", words, found[stop - len(words):stop]))
                chunk.clear()

            def judge(t, words, found):
                n = len(words)
                lines = [x for x in t.split(b"\n") if x.strip(SPACES)]
                repeated = int(covered(np.where(found >= BASE_WINDOW, found, 0), BASE_WINDOW).sum())
                marks = covered(found, least_repeat)
                total, most = int(marks.sum()), int(found.max()) if n else 0
                failed = n < least_words or 100 * repeated > base_percent * n
                return (n, len(t.translate(None, _CONTINUED)), len(t) - len(t.translate(None, b"#*$%&|<>")),
                        len(lines) - len(set(lines)), repeated, failed,
                        not failed and total <= fraction * n and most <= longest,
                        most, total, total / n if n else 0.0, spans(marks))

            for t in texts:
                words = spaced_words(t)
                if chunk and held + len(words) > CHUNK_WORDS:
                    flush()
                    held = 0
                chunk.append((t, words))
                held += len(words)
            if chunk:
                flush()
            return list(zip(*out, strict=True)) or [[]] * len(RULES)
        return fn

    return attach(docs, text, RULES, make, keep=keep)
