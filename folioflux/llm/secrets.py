"""Secret scans in Spark expressions: named patterns, and windows of high entropy in candidate strings.

What the base patterns have found is blanked, and so is each segment of a run (between / _ = and -) that holds a documented
sample word; what is left on both sides is judged. A candidate is a run of 20 or more base-64 characters. Its class sets the
entropy it must reach in some window of 20 characters, from what random windows of that alphabet have: hexadecimal, mixed, or,
for a segment of letters of one case with digits (base 32 and 36), between them. One pass over a candidate keeps the counts of
the window's characters; each step changes the count that enters and the one that leaves and, with them, the sum of
n * log2(n), in whole millionths of a bit, so results do not depend on the order of additions. An allow list takes out what is
known to be harmless: strings without a digit or without a letter, and identifiers of the 8-4-4-4-12 form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from folioflux.llm.rows import quoted

# The base patterns and their kinds, in the order in which spans that start together are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"      # as runs are taken whole, those of 24 or more characters
KINDS = ["assign", "access", "hex", "entropy"]
LEAST_VALUE, LEAST_ACCESS = 6, 20

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
# Random windows of 20 characters have 3.2, 3.8 and 4.0 bits on average, with 16, 32 to 36 and 62 to 64 characters.
HEX_BITS, SINGLE_BITS, MIXED_BITS = 3.0, 3.5, 3.8
SEGMENT = r"[A-Za-z0-9]{20,}"
SINGLE_CASE = r"^([a-z0-9]+|[A-Z0-9]+)$"
SAMPLE = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?i:example|sample|placeholder|xxxx)[A-Za-z0-9+]*"
ALLOWED = [r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"]
MILLION = 1_000_000
N_LOG_N = [round(n * math.log2(n) * MILLION) if n else 0 for n in range(WINDOW + 1)]

FOUND = "array<struct<start:int,kind:int,end:int,text:string>>"


def occurrences(text: Column, pattern: str, kind: int) -> Column:
    """Every leftmost non-overlapping match with its place in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # What stands between the matches; the last piece has no match behind it.
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = lambda at, p: at["end"] + p["gap"]
    walked = F.aggregate(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        F.struct(F.lit(0).alias("end"), F.array().cast(FOUND).alias("found")),
        lambda at, p: F.struct(
            (start(at, p) + F.length(p["hit"])).alias("end"),
            F.concat(at["found"], F.array(F.struct(
                start(at, p).alias("start"), F.lit(kind).alias("kind"), (start(at, p) + F.length(p["hit"])).alias("end"),
                p["hit"].alias("text")))).alias("found")))
    return F.when(text.rlike(pattern), walked["found"]).otherwise(F.array().cast(FOUND))


def window_bits(s: Column) -> Column:
    """The largest entropy of a window of ``WINDOW`` characters, in millionths of a bit."""
    table = F.array(*[F.lit(x) for x in N_LOG_N])
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1)))
    steps = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.struct(
        i.alias("i"), place(i).alias("in"), F.when(i > WINDOW, place(i - WINDOW)).otherwise(F.lit(0)).alias("out")))
    count = lambda at, k: F.get(at["counts"], k - 1)
    entering = lambda at, x: F.get(table, count(at, x["in"]) + 1) - F.get(table, count(at, x["in"]))
    leaving = lambda at, x: F.when(x["out"] > 0, F.get(table, count(at, x["out"]) - 1) - F.get(table, count(at, x["out"]))).otherwise(F.lit(0))
    total = lambda at, x: at["total"] + F.when(x["in"] == x["out"], F.lit(0)).otherwise(entering(at, x) + leaving(at, x))
    seen = F.aggregate(
        steps,
        F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).alias("total"), F.lit(N_LOG_N[WINDOW]).alias("least")),
        lambda at, x: F.struct(
            F.transform(at["counts"], lambda n, k: n + (k + 1 == x["in"]).cast("int") - (k + 1 == x["out"]).cast("int")).alias("counts"),
            total(at, x).alias("total"),
            F.when(x["i"] >= WINDOW, F.least(at["least"], total(at, x))).otherwise(at["least"]).alias("least")))
    return F.lit(round(math.log2(WINDOW) * MILLION)) - F.floor(seen["least"] / WINDOW)


def blanked(text: Column, spans: Column) -> Column:
    """The text with every character of the spans as a space, so that places stay."""
    walked = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit("").alias("out")), lambda at, x: F.struct(
        F.greatest(at["end"], x["end"]).alias("end"),
        F.concat(at["out"], F.substring(text, at["end"] + 1, F.greatest(x["start"] - at["end"], F.lit(0))),
                 F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], at["end"]), F.lit(0)))).alias("out")))
    return F.when(F.size(spans) > 0, F.concat(walked["out"], F.substring(text, walked["end"] + 1, F.length(text)))).otherwise(text)


def high_entropy(text: Column) -> Column:
    """Candidates of a blanked text that reach their class's entropy and no allow-list entry covers; where a run does not,
    its segments of one case."""
    def allowed(s):
        found = F.lit(False)
        for pattern in ALLOWED:
            found = found | s.rlike(pattern)
        return found

    def secret(x):
        s = x["text"]
        limit = F.when(s.rlike("^[0-9a-fA-F]+$"), F.lit(round(HEX_BITS * MILLION))).when(s.rlike(SINGLE_CASE), F.lit(round(SINGLE_BITS * MILLION))) \
            .otherwise(F.lit(round(MIXED_BITS * MILLION)))
        return F.when(allowed(s), F.lit(False)).otherwise(window_bits(s) >= limit)

    # A run that fails as a whole may still hold a key of one case between its separators.
    def inside(x):
        part = lambda y: y.withField("start", y["start"] + x["start"]).withField("end", y["end"] + x["start"])
        single = F.filter(occurrences(x["text"], SEGMENT, 3), lambda y: y["text"].rlike(SINGLE_CASE) & (y["text"] != x["text"]))
        return F.transform(F.filter(single, secret), part)
    runs = occurrences(text, CANDIDATE, 3)
    whole = F.transform(runs, lambda x: F.struct(x.alias("run"), secret(x).alias("hit")))
    return F.flatten(F.transform(whole, lambda e: F.when(e["hit"], F.array(e["run"])).otherwise(inside(e["run"]))))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every input row with ``secrets``, an array of (start, kind, end, text) ordered by start, then kind.

    Kinds are numbers into ``KINDS``; the first three are the base patterns, the fourth the entropy windows.
    A null or empty text has none. Rows are scanned one by one, so repeated rows, ties and rows without id each
    get their result. An input column named secrets is replaced.
    """
    body = F.coalesce(quoted(text), F.lit(""))
    assign = F.filter(occurrences(body, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= LEAST_VALUE)
    access = F.filter(occurrences(body, ACCESS, 1), lambda x: F.length(x["text"]) >= LEAST_ACCESS)
    base = docs.withColumn("__base", F.concat(assign, access, occurrences(body, HEX, 2)))
    # Texts without a candidate, most of them, are not walked.
    rest = blanked(body, F.concat("__base", occurrences(body, SAMPLE, 3)))
    base = base.withColumn("__rest", F.when(body.rlike(CANDIDATE), rest).otherwise(F.lit("")))
    return base.withColumn("secrets", F.array_sort(F.concat("__base", high_entropy(F.col("__rest"))))).drop("__base", "__rest")


def labels(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every found span of ``text`` replaced by ``mark``; spans that touch or overlap become one mark.

    Other columns and rows without secrets are unchanged.
    """
    # Under other names, so that no column of the input clashes with what is found.
    at = [f"c{i}" for i in range(len(docs.columns))]
    body = at[docs.columns.index(text)]
    found = find_secrets(docs.toDF(*at), body)
    body = F.col(body)
    parts = F.aggregate(
        F.col("secrets"),
        F.struct(F.lit(0).alias("end"), F.lit("").alias("out")),
        lambda at, x: F.struct(
            F.greatest(at["end"], x["end"]).alias("end"),
            F.when((x["start"] <= at["end"]) & (at["end"] > 0), at["out"])
            .otherwise(F.concat(at["out"], F.substring(body, at["end"] + 1, x["start"] - at["end"]), F.lit(mark))).alias("out")))
    whole = F.concat(parts["out"], F.substring(body, parts["end"] + 1, F.length(body)))
    new = F.when(F.size("secrets") > 0, whole).otherwise(body)
    return found.select(*[(new if c == text else F.col(a)).alias(c) for a, c in zip(at, docs.columns, strict=True)])
