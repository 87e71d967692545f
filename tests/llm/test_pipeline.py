"""The pipeline against brute-force versions of its stages, each on its own input."""

import re

import corpus_pipeline as cp
from helixloom.llm import quality
from test_mixing import plain_targets
from test_packing import _invariants
from test_pii import plain_spans
from test_similar import plain_groups


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
        assert k == 4 or docs.columns == columns
    raw = spark.read.parquet(f"{sf}/documents.parquet").collect()
    verdict = {r.doc_id: r.kept for r in quality.op3_quality(spark, sf).collect()}
    assert {r.doc_id for r in seen[0]} == {d for d, kept in verdict.items() if kept}
    assert len(seen[0]) > 0.7 * len(raw)
    assert {r.doc_id for r in seen[1]} == plain_groups([(r.doc_id, r.text) for r in seen[0]])
    before = {r.doc_id: r.text for r in seen[1]}
    for r in seen[2]:
        secret = bool(re.search('token = "[0-9a-f]{40}"', before[r.doc_id], re.I))
        assert (r.text != before[r.doc_id]) == (bool(plain_spans(before[r.doc_id])) or secret and "[SECRET]" in r.text) and not plain_spans(r.text)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in seen[2]}
    by, took = {}, {}
    for r in seen[2]:
        by[r.source] = by.get(r.source, 0) + size[r.doc_id]
    for r in seen[3]:
        took[r.source] = took.get(r.source, 0) + size[r.doc_id]
    for s, t in plain_targets(by).items():
        assert abs(took.get(s, 0) - t) <= max(size.values())
    want = {}
    for r in seen[3]:
        want[r.doc_id] = want.get(r.doc_id, 0) + size[r.doc_id]
    packed = {}
    for r in seen[4]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == want


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0 and cp.ORACLE_SQL is None
