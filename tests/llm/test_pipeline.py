import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import decontaminate, lines, quality  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        before, out = docs, spark.read.parquet(f"{tmp_path}/{i}")
        rows = {r.doc_id: r for r in before.collect()}
        if name == "quality rules":
            verdict = {r.doc_id: r.kept for r in quality.quality(before).collect()}
            assert all(not (brute.base_quality(r.text)[5] and verdict[d]) for d, r in rows.items())
            assert {r.doc_id for r in out.collect()} == {d for d, k in verdict.items() if k}
        elif name == "line dedup":
            want = brute.boilerplate([(d, r.text, r.source) for d, r in rows.items()], lines.LEAST_SITES)
            assert {r.doc_id: r.text for r in out.collect()} == {d: w[2] for d, w in want.items()}
        elif name == "MinHash near-dedup":
            want = brute.components([(d, r.text) for d, r in rows.items()], 5, 80)
            assert {r.doc_id for r in out.collect()} == {d for d, w in want.items() if w[1] == d}
        elif name == "benchmark decontamination":
            hit = {d for d, r in rows.items() if any(t in decontaminate.normal(r.text) for _, t in bench)}
            assert {r.doc_id for r in out.collect()} == set(rows) - hit
        else:
            import public_tokenizers as P
            from tokenizers import Tokenizer

            exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
            size = {r.doc_id: r[1] for r in out.groupBy("doc_id").agg({"length": "sum"}).collect()}
            assert size == {d: len(exact.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in rows.items()}
            assert np.all([r.padding == 0 for r in out.select("padding").collect()])
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_stages_judge_rows_not_ids(spark):
    """Rows without an id, and rows that share one, with equal texts or others."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("text is not null").first().text
    good = sorted((r.text for r in rows if verdict[r.doc_id] and r.lang == "en" and r.n_chars > 400), key=len)[:3]
    bad = min((r.text for r in rows if not verdict[r.doc_id]), key=len)
    make = lambda pairs: spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in pairs], docs.schema)
    got = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    said = lambda pairs: sorted((str(d), t) for d, t in pairs)
    stages = {n: f for n, f in corpus_pipeline.STAGES}
    own = [(None, good[0]), (7, good[1]), (7, bad), (None, bad)]
    passed = [p for p in own if p[1] != bad]
    assert got(stages["quality rules"](spark, docs.unionByName(make(own)), DATA)) == sorted(said((r.doc_id, r.text) for r in rows if verdict[r.doc_id]) + said(passed))
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    own = [(5, a), (5, a), (5, b), (None, b), (None, c), (None, c), (3, a)]
    assert got(stages["MinHash near-dedup"](spark, make(own), DATA)) == said([(3, a), (5, b), (None, c)])
    own = [(1, a), (1, f"{b} {item} {b}"), (None, c), (None, f"{c} {item} {c}")]
    assert got(stages["benchmark decontamination"](spark, make(own), DATA)) == said([(1, a), (None, c)])
