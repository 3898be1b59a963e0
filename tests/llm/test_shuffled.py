"""Substring dedup, near duplicates, packing, resampling, surrogates and tool calls against brute force."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
import edge  # noqa: E402

from folioflux.llm import chat, components, importance, packing, pii, queries, simhash, substring  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_remove_repeats(spark):
    rng = random.Random(1)
    shared = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(n)) for n in (34, 35, 36, 60, 200)]
    data = list(edge.ROWS)
    for k in range(60):
        parts = [" ".join(str(rng.random()) for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        parts.insert(1, rng.choice(shared))
        if k % 5 == 0:
            parts.insert(2, rng.choice(shared))
        if k % 7 == 0:
            parts.append("so " * rng.randrange(30, 90))
        data.append((100 + k, "\n ".join(parts), "z"))
    data += data[-3:]
    words = [(t or "").split() for _, t, _ in data]
    seen = Counter(" ".join(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for (i, _, _), w in zip(data, words, strict=True):
        gone = set()
        for k in range(len(w) - 34):
            if seen[" ".join(w[k:k + 35])] > 1:
                gone.update(range(k, k + 35))
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = substring.remove_repeats(edge.rows(spark, data)).collect()
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == want
    assert all(sum(e - s for s, e in r["removed_spans"]) == r["n_removed"] for r in got)
    assert substring.remove_repeats(edge.empty(spark)).count() == 0
    assert substring.remove_repeats(edge.clashing(spark)).count() == len(edge.ROWS)


def brute_prints(rows):
    out = []
    for i, t in rows:
        words = (t or "").encode().translate(simhash.ASCII_LOWER).split()
        grams = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0))
    return out


def brute_components(prints, bits=3):
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fs = list(root)
    for a in range(len(fs)):
        for b in range(a):
            if (fs[a] ^ fs[b]).bit_count() <= bits:
                root[find(fs[a])] = find(fs[b])
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in prints)


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute_components(brute_prints([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert Counter(map(tuple, queries.op10_simhash(spark, FOLDER).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_near_duplicates_on_edge_rows(spark):
    want = brute_components(brute_prints([r[:2] for r in edge.ROWS]))
    got = simhash.near_duplicates(edge.clashing(spark).drop("source")).collect()
    assert Counter((r["id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0
    kept = simhash.one_per_group(edge.rows(spark)).collect()
    component = {i: c for i, _, c in want}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 2, 5, 6] and all(component[r["doc_id"]] == r["doc_id"] for r in kept if r["doc_id"] is not None)
    # A row without id stays only where its component has no id.
    assert sum(r["doc_id"] is None for r in kept) == sum(n for (i, _, c), n in want.items() if c is None) == 1


def test_one_of_each_component_where_ids_repeat(spark):
    far = [" ".join(f"{w}{i}{k}" for i in range(40)) for k, w in enumerate(("alpha", "beta", "gamma", "delta"))]
    data = [(5, far[0], "a"), (5, far[1], "b"), (5, far[1], "b"), (3, far[1], "c"), (9, far[2], "d"), (None, far[3], "e"), (None, far[3], "f"), (None, far[0], "g"), (9, far[2], "h")]
    got = [(r["doc_id"], r["text"]) for r in simhash.one_per_group(edge.rows(spark, data)).collect()]
    assert Counter(got) == Counter([(5, far[0]), (3, far[1]), (9, far[2]), (None, far[3])])
    assert simhash.one_per_group(edge.clashing(spark)).columns == edge.clashing(spark).columns


def test_index_loses_no_link(spark):
    """Crowded nodes are factored again; the links stay the same."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fp = np.repeat(base, 150)
    for _ in range(6):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)) * (rng.random(len(fp)) < 0.6).astype(np.uint64)
    fp = np.unique(fp)
    frame = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for node in (simhash.NODE, 20):
        edges = simhash.star_edges(simhash.upper_nodes(frame, 3, node), 3)
        roots = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
        label = [roots.get(int(x), int(x)) for x in fp.view(np.int64)]
        want = brute_components([(k, int(f)) for k, f in enumerate(fp)])
        least = {}
        for k, x in enumerate(label):
            least.setdefault(x, k)
        assert Counter((k, f"{int(f):016x}", least[x]) for k, (f, x) in enumerate(zip(fp, label, strict=True))) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + k] == 1000 for k in range(300)) and got[2001] == 2000
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    data = [*edge.ROWS, (50, "a  b\n c <|endoftext|> d", "x"), (51, " lead", "x"), (52, "don't we'll 12 a1!", "x")]
    pieces = packing.tokenize(edge.rows(spark, data), queries.tokenizer_path())
    out = packing.pack(pieces).collect()
    want = Counter()
    for i, t, _ in data:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    gapless(out)
    assert packing.pack(packing.tokenize(edge.empty(spark), queries.tokenizer_path())).count() == 0
    assert packing.pack(packing.tokenize(edge.clashing(spark), queries.tokenizer_path())).filter("piece = 0").count() == len(edge.ROWS)


def gapless(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_documents_is_tight(spark):
    rows = queries.op6_packing(spark, "/root/testdata/sf0.01").collect()
    assert gapless(rows) <= 1.02 * -(-sum(r["length"] for r in rows) // 1024)


def test_encoder_equals_tokenizers(spark):
    encode = packing.Encoder(queries.tokenizer_path())
    for (t,) in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect():
        assert list(memoryview(encode.encode(t or "")).cast("I")) == encode.whole(t or "")


def test_rounds_join_underfull_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 4)
    sizes = [600, 600, 600, 600, 400, 400, 400, 400, 7, 9]
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "id long, length long").coalesce(1)
    rows = packing.pack(frame).collect()
    assert len(rows) == 10 and gapless(rows) <= 5


def test_resample(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    good = labels.filter("quality = 1 and toxic = 0")
    out = importance.resample(docs, good, share=0.5).toPandas().set_index("id")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = {r["doc_id"] for r in good.collect()}
    raw, target = (Counter(), Counter())
    for i, t in texts.items():
        for g in importance.grams((t or "").encode(), importance.BUCKETS).tolist():
            raw[g] += 1
            target[g] += i in names
    share = sum(target.values()) / sum(raw.values())
    for i in list(texts)[:40]:
        want = sum(np.log((target[g] + 20) / (raw[g] * share + 20)) for g in importance.grams((texts[i] or "").encode(), importance.BUCKETS).tolist())
        assert abs(want - out.log_ratio[i]) < 1e-4
    k = int(np.ceil(len(out) / 2))
    assert (out.gumbel_key >= sorted(out.gumbel_key)[-k]).equals(out.selected)
    assert importance.resample(edge.empty(spark), good).count() == 0
    assert importance.resample(edge.clashing(spark).drop("source"), good.filter("false")).count() == len(edge.ROWS)


def test_resampling_prefers_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.filter("doc_id % 2 = 1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = importance.resample(docs, labels.filter("doc_id % 2 = 0 and quality = 1 and toxic = 0")).withColumnRenamed("id", "doc_id").join(held, "doc_id").toPandas()
    assert out[out.quality == 1].log_ratio.median() > out[out.quality == 0].log_ratio.median()
    assert out[(out.quality == 1) & (out.toxic == 0)].selected.mean() > 0.8 > out[out.quality == 0].selected.mean()


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), 3.0, -1e9, 1e-300]) for _ in range(500)]
    frame = spark.createDataFrame([(x,) for x in values], "x double")
    for k in (1, 7, 250, 499, 500):
        assert importance.kth_largest(frame, "x", k) == sorted(values)[-k]


def test_surrogates(spark):
    data = [*edge.ROWS, (100, "Mail Ann.Lee07@mail4.example.com or call +1 (524) 555-7373 from 157.212.123.28.", "x"),
            (101, "Again: ann.lee07@mail4.example.com, +1 524 555 7373; card 4516744854574821, 4516-7448-5457-4821", "x"),
            (102, "Mrs Smith met Herr Müller and Mr John Smith; SSN 123-45-6789", "x"), (103, "Госпожа Иванова", "x")]
    out = {r["doc_id"]: r for r in pii.replace_entities(edge.rows(spark, data), "k").collect()}
    for i in (100, 101, 102, 103):
        for e in out[i]["entities"]:
            assert e["mention"] not in out[i]["text"] and e["surrogate"] in out[i]["text"]
    mail, phone, ip = (e["surrogate"] for e in out[100]["entities"])
    again, spaced, card, dashed = (e["surrogate"] for e in out[101]["entities"])
    assert mail == again and mail.endswith(".com") and "@" in mail
    assert "".join(c for c in phone if c.isdigit()) == "".join(c for c in spaced if c.isdigit()) and phone.startswith("+1 (")
    assert dashed.replace("-", "") == card and len(card) == 16
    names = [e["surrogate"] for e in out[102]["entities"]]
    assert names[0].startswith("Mrs ") and names[1].startswith("Herr ") and names[2].split()[1] in pii.FIRST["m", "latin"].split() and names[3][3] == "-"
    assert out[103]["text"].startswith("Госпожа ") and not any("a" <= c <= "z" for c in out[103]["text"])
    assert out[2]["text"] is None and out[0]["text"] == edge.PLAIN and not out[5]["entities"]
    assert pii.replace_entities(edge.empty(spark), "k").count() == 0
    assert pii.replace_entities(edge.clashing(spark), "k").count() == len(edge.ROWS)


def test_surrogates_stay_distinct(spark):
    """A small space of addresses fills up; no two entities share a surrogate, none is a real one."""
    data = [(i, f"{a}@{b}.io", "x") for i, (a, b) in enumerate((a, b) for a in pii.LOWER for b in pii.LOWER[:12])]
    out = pii.replace_entities(edge.rows(spark, data), "k").collect()
    new = {r["text"] for r in out}
    assert len(new) == len(data) and not new & {t for _, t, _ in data}
    assert {r["doc_id"]: r["text"] for r in out} == {r["doc_id"]: r["text"] for r in pii.replace_entities(edge.rows(spark, data + data[:50]), "k").collect()}


def test_surrogates_of_documents_lose_nothing_else(spark):
    import re
    rows = queries.op5_surrogates(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", queries.F.col("text").alias("old")), "doc_id").collect()
    for r in rows:
        found = re.findall(r"[\w.]+@mail\d\.example\.com|(?<![\w.])\d{16}(?!\w)|\+1 \(\d{3}\) 555-\d{4}", r["old"])
        assert not any(x in r["text"] for x in found)
        if not r["n_entities"]:
            assert r["text"] == r["old"]


def test_tool_links(spark):
    calls = [("v", "a", 5, "search", '{"limit":1, "query":"x"}', ["b"]), ("v", "b", 7, "search", '{"query":2,"limit":1}', []), ("v", "c", 1, "none", "oops", ["c"]),
             ("v", "d", 2, "count", None, ["a", "gone"]), ("v", "a", 9, "count", "{}", []), (None, "z", 1, "count", "{}", []), ("w", "a", 1, "search", "", None)]
    results = [("v", "a", 6, "one"), ("v", "a", 8, "two"), ("v", "q", 3, "lost"), ("w", "a", 2, None)]
    c = spark.createDataFrame(calls, "conv_id string, call_id string, position long, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id string, call_id string, position long, content string")
    out = {(x["conv_id"], x["call_id"]): x for x in chat.link_tool_calls(c, r, queries.SCHEMAS).collect()}
    assert len(out) == 6
    assert {k: v["status"] for k, v in out.items()} == {("v", "a"): "linked", ("v", "b"): "no_result", ("v", "c"): "no_result", ("v", "d"): "no_result", ("v", "q"): "no_call", ("w", "a"): "linked"}
    assert [out["v", k]["level"] for k in "bad"] == [0, 1, 2] and out["v", "c"]["level"] is None
    assert out["v", "a"]["problem"] is None and out["v", "b"]["problem"] == "arguments.query is no string" and out["v", "c"]["problem"] == "unknown tool"
    assert out["v", "a"]["canonical"] == '{"after":["b"],"arguments":{"limit":1,"query":"x"},"id":"a","name":"search","result":"one"}'
    assert out["w", "a"]["problem"] == "not JSON" and out["v", "q"]["problem"] is None
    assert chat.link_tool_calls(c.limit(0), r.limit(0), queries.SCHEMAS).count() == 0
    messages = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "assistant", "plain"), (None, None, None, '{"tool_call_id":"a"}')], "conv_id long, turn long, role string, text string")
    made, answers = chat.parse_messages(messages)
    assert made.count() == 0 and answers.count() == 1


def test_hostile_arguments(spark):
    schemas = {"f": {"type": "object", "properties": {"a": {"minimum": 3}, "b": {"type": ["string", "null"]}, "c": {"enum": [1, None]}}}}
    texts = ['{"a":"\\ud800"}', "[" * 100_000, '{"a":NaN}', '{"a":"x"}', '{"a":2}', '{"b":null}', '{"b":1}', '{"c":true}', '{"\\udfff":1}', "1" * 5000, '{"a":' + "[" * 900 + "]" * 900 + "}", "null"]
    calls = spark.createDataFrame([(1, str(i), i, "f", t, None) for i, t in enumerate(texts)], "conv_id long, call_id string, position long, name string, arguments string, after array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, position long, content string")
    out = {int(r["call_id"]): r for r in chat.link_tool_calls(calls.withColumn("problem", calls.name), none, schemas).collect()}
    assert [out[i]["problem"] for i in range(10)] == [None, "not JSON", "not JSON", None, "arguments.a is too small", None, "arguments.b is no string or null",
                                                      "arguments.c is not allowed", None, "not JSON"]
    assert '"arguments":{"a":"\\ud800"}' in out[0]["canonical"] and "\\udfff" in out[8]["canonical"] and '"arguments":"{\\"a\\":NaN}"' in out[2]["canonical"]
    assert out[11]["problem"] == "arguments is no object"


def test_levels_of_long_chains_and_cycles(spark):
    """One task a conversation, and rounds for conversations above the limit, give the same."""
    chain = [("a", f"c{i}", [f"c{i - 1}", f"c{i // 2}"] if i else []) for i in range(2000)]
    short = [("b", f"c{i}", [f"c{i - 1}"] if i else ["gone"]) for i in range(6)] + [("b", "x", ["y"]), ("b", "y", ["x"]), ("b", "z", ["x", "c1"]), ("b", "w", ["c5", "c1", None]), ("b", "s", ["s"])]
    frame = lambda rows: spark.createDataFrame(rows, "conv_id string, call_id string, after array<string>")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in chat.levels(frame(chain + short)).collect()}
    want = {("b", f"c{i}"): i for i in range(6)} | {("b", "w"): 6}
    assert got == {("a", f"c{i}"): i for i in range(2000)} | want
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in chat.levels(frame(short), together=3).collect()} == want
