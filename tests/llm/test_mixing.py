"""The cube method keeps its balances; targets equal a plain water-filling; reruns agree."""

import re

import numpy as np
from helixloom.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = budget - sum(most * sizes[s] for s in capped)
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= over


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 1000):
        p, x = rng.random(n), rng.integers(0, 500, n).astype(float)
        if n > 10:
            x[: n // 2] = 7
        out = mixing.flight(p, x, rng)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * x).sum() - (p * x).sum()) < 1e-3


def test_inclusion_is_fair():
    p, x = np.array([0.2, 0.5, 0.7, 0.4, 0.9]), np.array([5.0, 1.0, 9.0, 4.0, 4.0])
    mean = np.mean([mixing.flight(p, x, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = mixing.op1_mix(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in docs.items()}
    by = {}
    for d, r in docs.items():
        by[r.source] = by.get(r.source, 0) + size[d]
    want, taken = plain_targets(by), {}
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == by[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(size.values())
    assert abs(sum(taken.values()) - sum(want.values())) < 0.02 * sum(want.values())
    again = {(r.doc_id, r.taken) for r in mixing.op1_mix(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_many_levels_nulls_and_ties(spark):
    rows = [(k, "hot" if k % 3 else None, k % 7) for k in range(900)] + [(5, "dup", 4)] * 40 + [(None, "dup", 4), (1, "void", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df, block=16).collect()
    assert len(got) == len(rows)
    total = {}
    for r in got:
        total.setdefault(r.source, [0, r.target])[0] += r.size * r.copies
    assert all(abs(a - t) <= 14 for a, t in total.values())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_keep_columns(spark):
    rows = [(k, "w " * (k % 9), "en", f"s{k % 4}" if k % 5 else None, k, "x") for k in range(200)] + [(7, "a b c", "en", "s1", 3, "y")] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, copies string")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    items = [(r[0], r[3], len(r[1].split())) for r in rows]
    copies = mixing.mix(spark.createDataFrame(items, "doc_id long, source string, size long")).collect()
    assert out.count() == sum(r.copies for r in copies)
    assert mixing.mixed(df.limit(0)).count() == 0
