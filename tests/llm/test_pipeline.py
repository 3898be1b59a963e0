"""The pipeline's stages on edge rows, and all of it against a brute-force version."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
import edge  # noqa: E402
from test_shuffled import brute_components, brute_prints, gapless  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_bear_edge_rows(spark):
    for frame in (edge.clashing(spark), edge.empty(spark)):
        docs = frame.withColumn("n_chars", frame["doc_id"])
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
            assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count()


def test_pipeline_against_brute_force(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    import oracle
    con = oracle.duck(FOLDER)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql['op8_repetition']}) WHERE kept").fetchall()}
    found = brute_components(brute_prints([(i, t) for i, t in docs.items() if i in kept]))
    kept = {i for i, _, c in found if i == c}
    kept -= {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql['op4_decontaminate']}) WHERE contaminated").fetchall()}
    spans = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, spans FROM ({sql['op2_secrets']})").fetchall()}
    from tokenizers import Tokenizer

    from folioflux.llm.queries import tokenizer_path
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i in kept:
        t, end, out = docs[i], 0, ""
        for s in filter(None, spans[i].split(",")):
            a, b = map(int, s.split(":")[1:])
            if not (end and a <= end):
                out += t[end:a] + "[SECRET]"
            end = max(end, b)
        want[i] = len(tokenizer.encode(out + t[end:], add_special_tokens=False).ids) + 1
    rows = q["pipeline"](spark, FOLDER).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want
    gapless(rows)
