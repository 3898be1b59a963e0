"""Decontamination, repetition, licenses and secrets: kernels, edge rows, clashing columns, empty tables."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import edge  # noqa: E402

from folioflux.llm import decontaminate, licenses, repetition, secrets  # noqa: E402

BENCH = [(1, " ".join(f"b{i}" for i in range(20))), (2, "quick brown fox"), (3, None), (4, ""), (None, "eleven small birds"), (2, "quick brown fox")]


def bench(spark, data=None):
    return spark.createDataFrame(BENCH if data is None else data, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_decontaminate(spark, block_bytes):
    """One block of the benchmark or several give the same."""
    out = decontaminate.decontaminate(edge.rows(spark), bench(spark), block_bytes=block_bytes).collect()
    assert len(out) == len(edge.ROWS)
    first = next(r for r in out if r["doc_id"] == 0)
    assert (first["n_words"], first["n_hit"], first["items"], first["contaminated"]) == (20, 6, ["", "2"], True)
    assert [tuple(s) for s in first["hit_spans"]] == [(1, 4), (10, 13)]
    assert all(r["n_words"] == 0 and not r["contaminated"] for r in out if r["doc_id"] in (2, 3, 4))
    assert decontaminate.decontaminate(edge.rows(spark), bench(spark, [])).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(edge.empty(spark), bench(spark)).count() == 0
    clash = decontaminate.decontaminate(edge.clashing(spark), bench(spark))
    assert clash.filter("contaminated").count() == 5 and "score" in clash.columns


def test_patterns_find_every_window():
    rng = random.Random(3)
    for _ in range(200):
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))).encode()) for i in range(3)]
        words = [rng.choice("abcd").encode() for _ in range(rng.randrange(0, 30))]
        hits, found = bytearray(len(words)), set()
        decontaminate.Patterns(items, 4).search(words, hits, found)
        want, named = bytearray(len(words)), set()
        for name, text in items:
            w = text.split()
            size = min(4, len(w))
            for i in range(len(w) - size + 1):
                for k in range(len(words) - size + 1):
                    if words[k:k + size] == w[i:i + size]:
                        want[k:k + size] = b"\1" * size
                        named.add(name)
        assert (hits, found) == (want, named)


def test_longest_repeats():
    rng = random.Random(5)
    for turn in range(150):
        docs = [[rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.randrange(0, 60))] for _ in range(rng.randrange(1, 5))]
        if turn % 3 == 0:
            docs = [d + d for d in docs]
        ends = np.cumsum([len(d) for d in docs])
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = repetition.longest_repeats(np.array([x for d in docs for x in d], np.int64), doc, ends[doc])
        want = []
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    k = 0
                    while i != j and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert got.tolist() == want


def test_quality_rules(spark):
    repeated = (edge.PLAIN + "\n") * 3
    data = [*edge.ROWS, (8, repeated, "f"), (9, edge.PLAIN + "\nline one\nline one\n", "f")]
    out = {(r["doc_id"], r["source"]): r for r in repetition.quality_rules(edge.rows(spark, data)).collect()}
    assert out[0, "a"]["kept"] and out[0, "a"]["n_words"] == 20
    assert not any(out[k, "b"]["kept"] for k in (2, 3, 4))
    bad = out[8, "f"]
    assert bad["base_failed"] and not bad["kept"] and bad["n_repeat_words"] == 60 and bad["n_dup_lines"] == 2 and bad["longest_repeat"] == 40
    assert [tuple(s) for s in bad["repeat_spans"]] == [(0, 60)]
    assert out[9, "f"]["n_dup_lines"] == 1 and out[9, "f"]["kept"]
    strict = repetition.quality_rules(edge.rows(spark, data), base_percent=100, longest=30).filter("doc_id = 8").first()
    assert not strict["base_failed"] and not strict["kept"]
    assert repetition.quality_rules(edge.empty(spark)).count() == 0
    assert repetition.quality_rules(edge.clashing(spark)).filter("kept").count() == 5


def test_licenses(spark):
    texts = ["used under the MIT-License only", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the "
             "Software without restriction", "Permission is hereby granted, free of charge, to a person obtaining a copy of this software",
             "cc by nc cc-by-nc Apache License, Version 2.0", "published by: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation; either version 2.1 of the License"]
    data = [*edge.ROWS, *[(100 + i, t, "x") for i, t in enumerate(texts)]]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(edge.rows(spark, data)).collect()}
    assert [tuple(x) for x in out[100]["phrases"]] == [("mit", 1, 5)] and out[100]["score"] == 0.5
    # An opening alone tells nothing of the conditions.
    assert not out[101]["templates"] and [x["label"] for x in out[101]["excerpts"]] == ["mit"] and out[101]["score"] == 0.0
    assert not out[102]["templates"] and out[102]["score"] == 0.0
    assert [x["label"] for x in out[103]["phrases"]] == ["cc-by-nc", "cc-by-nc", "apache-2"]
    assert not out[104]["templates"] and [x["label"] for x in out[104]["excerpts"]] == ["gnu"]
    assert out[2]["n_words"] == 0 and out[5]["score"] == 0.0
    assert licenses.scan_licenses(edge.empty(spark)).count() == 0
    assert licenses.scan_licenses(edge.clashing(spark)).count() == len(edge.ROWS)


def test_automata_agree_with_regular_expressions():
    import re
    rng = random.Random(9)
    for _ in range(150):
        def parts(depth):
            out = []
            for _ in range(rng.randrange(1, 4)):
                r = rng.random()
                out.append(f"<<optional>>{parts(depth - 1)}<<end>>" if depth and r < 0.3 else "<<any 0 2>>" if r < 0.45 else rng.choice("ab"))
            return " ".join(out)
        markup = "a " + parts(2) + " b"
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 12))]
        got = bool(licenses.Automata([("x", markup)]).matches([w.encode() for w in words]))
        assert got == bool(re.search(licenses.pattern(markup), " " + " ".join(words))), (markup, words)


def test_secrets(spark):
    token = "Zk9" + "q7TxLw2Bv8RnYc4HsJd"
    data = [*edge.ROWS, (100, 'é token = "' + "ab12" * 10 + '" AKIA' + "Q" * 16 + " AKIAQ", "x"), (101, f"see {token} and 123e4567-e89b-12d3-a456-426614174000", "x"),
            (102, "secret: token: abcdefgh password=abc", "x"), (103, "TOKEN:x" + " PassWD='123456'", "x")]
    out = {r["doc_id"]: r for r in secrets.find_secrets(edge.rows(spark, data)).withColumn("l", secrets.labels(secrets.F.col("secrets"))).collect()}
    assert out[100]["l"] == "assign:2:51,hex:11:51,access:53:73"
    assert out[101]["l"] == f"entropy:4:{4 + len(token)}"
    assert out[102]["l"] == ""
    assert out[103]["l"] == "assign:8:22"
    assert all(out[k]["l"] == "" for k in (0, 2, 3, 4, 5))
    red = {r["doc_id"]: r["text"] for r in secrets.redact(edge.rows(spark, data)).collect()}
    assert red[100] == 'é [SECRET]" [SECRET] AKIAQ' and red[101].startswith("see [SECRET] and 123e") and red[2] is None and red[0] == edge.PLAIN
    assert secrets.find_secrets(edge.empty(spark)).count() == 0
    assert secrets.find_secrets(edge.clashing(spark)).count() == len(edge.ROWS)


def found_spans(spark, texts):
    frame = edge.rows(spark, [(i, t, "x") for i, t in enumerate(texts)])
    return {r["doc_id"]: r["l"] for r in secrets.find_secrets(frame).withColumn("l", secrets.labels(secrets.F.col("secrets"))).collect()}


def test_random_keys_of_every_class_are_found(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    classes = {"base-36": letters + "0123456789", "base-32": letters.upper() + "234567", "base-62": letters + letters.upper() + "0123456789",
               "base-64": letters + letters.upper() + "0123456789+/", "upper hex": "0123456789ABCDEF"}
    for size in (24, 32, 40):
        keys = [(name, "".join(rng.choice(alphabet) for _ in range(size))) for name, alphabet in classes.items() for _ in range(100)]
        out = found_spans(spark, [f"key {k} end" for _, k in keys])
        for name in classes:
            hits = [bool(out[i]) for i, (n, _) in enumerate(keys) if n == name]
            assert sum(hits) >= 0.9 * len(hits), (name, size, sum(hits))


def test_parts_are_judged_not_runs(spark):
    key = "Zk9q7TxLw2Bv8RnYc4HsJdQ5mPf3GaXe1UoWi6Kt"
    low = "k3j9x7q2w8z4m1v6n5b0c7d3"
    texts = [f"SAMPLE_DB_PASS={key}", f"AKIA{'Q7' * 10}/{key}", f"https://host/samples/{key}/x", f"the_example_{low}", f"my-first-blog-entry-of-2024-with-{low}", "zzzzzzzzzzzzzzzzzzzzzzzz1111", "EXAMPLEKEY1234567890abcd"]
    out = found_spans(spark, texts)
    assert out[0].endswith(f"entropy:6:{len(texts[0])}") and out[1] == f"access:0:24,entropy:24:{len(texts[1])}" and out[2].split(",")[-1].startswith("entropy:")
    assert out[3] == f"entropy:11:{len(texts[3])}" or out[3] == f"entropy:12:{len(texts[3])}"
    assert out[4] and out[5] == "" and out[6] == ""
    assert all(key not in r["text"] and low not in r["text"] for r in secrets.redact(edge.rows(spark, [(i, t, "x") for i, t in enumerate(texts)])).collect())


def test_long_runs_end(spark):
    texts = ["Ab3" * 20_000, "example" * 10_000, "a" * 100_000, "a1_" * 20_000, "/" * 60_000]
    assert len(found_spans(spark, texts)) == len(texts)
