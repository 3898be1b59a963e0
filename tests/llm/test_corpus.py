"""Phrases, clusters and BPE encoding against brute force, with edge rows, clashing columns and empty tables."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import edge  # noqa: E402

from folioflux.llm import bpe, clusters, phrases, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path()


# -- phrases ----------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    import re
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        longer = [b for (other, q), b in candidates.items() if other == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranked, at = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], p.decode(), -a, left, right, n[lang], -score))
    return ranked


@pytest.mark.parametrize(("budget", "held"), [(phrases.BUDGET, phrases.HELD), (24, 50)])
def test_phrases(spark, monkeypatch, budget, held):
    """One group or many, with prefixes lengthened up to full depth, give the same."""
    monkeypatch.setattr(phrases, "HELD", held)
    rng = random.Random(11)
    words = ["A", "b", "bé", "c\x01", "\U0001f600", "d" * 400, *[f"rare{i}" for i in range(40)]]
    data = [(i, rng.choice([" ", "\t", ", ", "\n"]).join("".join([rng.choice(words[:6]) if rng.random() < 0.9 else rng.choice(words), rng.choice(["", "", "", "", "!", " "])])
             for _ in range(rng.randrange(0, 60))), rng.choice(["en", None, "und"])) for i in range(60)]
    data += [(None, "a b c\x01 a b", "en")] * 12 + [(1, None, "en"), (2, "", None), (3, " \n.,", "fr")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    frame = frame.withColumn("phrase", queries.F.lit("x")).withColumn("n", queries.F.lit(1)).repartition(3)
    got = phrases.collocations(frame, least=9, top=25, budget=budget)
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases([r[1:] for r in data], 9, 25))
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_groups_keep_within_the_budget(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = phrases._rows(docs, "text", "lang")
    leaves = phrases.suffixes(rows, phrases.prefix_counts(rows, 5)[1])
    budget = leaves.count() // 6
    placed = phrases.partition(leaves, budget)
    sizes = [r["count"] for r in placed.groupBy("group").count().collect()]
    assert sum(sizes) == leaves.count() and max(sizes) <= budget and len(sizes) > 5
    assert placed.filter("depth > 1").count() > 0


# -- clusters ---------------------------------------------------------------------------


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, v in kept:
            mine[near(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(mine, centroids, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in out:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], inertia.total(), names[c]) for i, d, c in out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def found(frame, **more):
    rows = clusters.cluster(frame, **more).select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return Counter(map(tuple, rows))


def test_clusters(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=64) * 2) / 2]) for i in range(120)]
    rows += [*rows[:9], (None, rows[3][1]), (None, rows[4][1]), (500, None), (501, [1.0] * 63), (502, [None, *[1.0] * 63]), (503, [float("nan")] * 64),
             (504, [float("-inf"), *[0.0] * 63]), (505, []), (506, [-0.0] * 64), (507, [1e5] * 64)]
    frame = vectors(spark, rows)
    assert found(frame, k=7, rounds=3) == brute_clusters(rows, 7, 3)
    clash = frame.withColumn("cluster", queries.F.lit("x")).withColumn("id", queries.F.lit(None))
    assert found(clash, k=300, rounds=2) == brute_clusters(rows, 300, 2)
    # Two places only: all ties, and centroids without vectors stay.
    same = [(i, [float(i % 2)] * 64) for i in range(40)]
    assert found(vectors(spark, same)) == brute_clusters(same, 16, 3)
    assert found(frame.limit(0)) == Counter() and found(frame.filter("vec_id = 500")) == Counter()
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(vectors(spark, [(1, [1e9] * 64)]))


def test_tree_finds_the_nearest_and_prunes():
    rng = np.random.default_rng(8)
    for k in (1, 2, 5, 40, 400):
        centers = rng.integers(-9, 9, (k, 6)) * rng.choice([1, 50])
        centers[k // 2:] = centers[:k - k // 2]                 # each twice: the smaller number wins
        near = rng.integers(0, k, 500)
        x = centers[near] + rng.integers(-2, 3, (500, 6))
        who, best, computed = clusters.VantageTree(centers).nearest(x)
        d = ((x[:, None, :] - centers[None]) ** 2).sum(2)
        assert (who == d.argmin(1)).all() and (best == d.min(1)).all()
        assert k < 400 or computed < 0.7 * 500 * k
    large = np.array([[clusters.LIMIT] * 64, [-clusters.LIMIT] * 64])
    assert clusters.VantageTree(large).nearest(large)[1].tolist() == [0, 0]


# -- encoding ---------------------------------------------------------------------------

HARD = ["a" * 3000, "ab" * 2500, " " * 2000, "\n" * 700 + "x", "  \n\t a" * 300, "don't we'll 'redo ''''s" * 90, "=" * 5000, "0123456789" * 400, "中文" * 900,
        "\U0001f600‍" * 500, "x <|endoftext|>y<|endoftext|><|endoftext|> z" * 40, "<|endoftext|>", " ", "a  b", "　 a \xa0b\x1c c\x85 d", "the" * 1500,
        "�" * 600, "é" * 800, "A\x00B" * 300, "   " * 200, "wordword" * 700 + "  " + "y" * 900]


def test_codec_equals_tokenizers():
    from tokenizers import Tokenizer
    tokenizer, codec = Tokenizer.from_file(PATH), bpe.codec(PATH)
    rng = random.Random(3)
    texts = [*HARD, *["".join(rng.choice(["a", "aa", "th", "he", "in", " ", "  ", "\n", "'s", "'", "1", "é", "!", "<|endoftext|>", "er", "中"])
                              for _ in range(rng.randrange(0, 300))) for _ in range(300)]]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(codec.encode(text), np.uint32).tolist()
        assert got == ids, text[:60]
        assert codec.decode(got) == tokenizer.decode(ids, skip_special_tokens=False) == text
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(0, 30))]
        assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_joined_runs_equal_whole_runs():
    """Halves of every kind of run, cut anywhere."""
    codec = bpe.codec(PATH)
    letters = bpe.byte_letters()
    rng = random.Random(5)
    for turn in range(1500):
        parts = [["a"], ["a", "b"], ["t", "h", "e", "in", "ing"], ["=", "=="], [chr(i) for i in range(97, 123)], ["é", "e", "中"]][turn % 6]
        run = "".join(letters[b] for b in "".join(rng.choice(parts) for _ in range(rng.randrange(2, 200))).encode())
        cut = rng.randrange(1, len(run))
        want = codec.run(run)
        assert codec.join(codec.run(run[:cut]), codec.run(run[cut:]), rng.choice([1, 2, 8])) == want
    run = "".join(rng.choice("etaoins") for _ in range(60_000))
    assert codec.tree(run) == codec.run(run) and codec.tree("a" * 50_001) == codec.run("a" * 50_001)


@pytest.mark.parametrize(("long", "leaf"), [(bpe.LONG, bpe.LEAF), (5, 3), (40, 17)])
def test_encode_and_decode(spark, long, leaf):
    """Texts encoded whole and texts dealt in leaves give the ids of the library."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    texts = [t[:400] for t in HARD] if long < 100 else [*HARD, "go" * 120_000 + " and " * 9_000 + "\n" * 50_000, edge.LONG * 2]
    data = [*[r for r in edge.ROWS if long > 100 or len(r[1] or "") < 1000], *[(100 + i, t, "z") for i, t in enumerate(texts)]]
    frame = edge.rows(spark, data).withColumn("ids", queries.F.lit("x")).withColumn("c0", queries.F.lit("y"))
    out = bpe.decode(bpe.encode(frame, PATH, long=long, leaf=leaf), PATH)
    assert out.columns == ["doc_id", "source", "c0", "n_tokens", "ids", "decoded"]
    want = Counter((i, s, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, s in data)
    rows = out.collect()
    assert Counter((r["doc_id"], r["source"], tuple(r["ids"]), r["decoded"]) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert bpe.decode(bpe.encode(edge.empty(spark), PATH), PATH).count() == 0


def test_query_equals_tokenizers(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    want = set()
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert set(map(tuple, queries.op13_encoding(spark, FOLDER).collect())) == want
