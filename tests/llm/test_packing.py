"""Best-fit packing against a plain version that scans every bin, and its invariants."""

import random

from helixloom.llm import packing


def plain_pack(sizes, sources, clusters, capacity):
    bins, where, starts = [], [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [b for b in bins if b["room"] >= n and s not in b["s"] and (c is None or c not in b["c"])]
        b = min(fits, key=lambda b: (b["room"], b["seen"]), default=None)
        if b is None:
            b = {"id": len(bins), "room": capacity, "s": set(), "c": set()}
            bins.append(b)
        where.append(b["id"])
        starts.append(capacity - b["room"])
        b["room"] -= n
        b["seen"] = len(where)
        b["s"].add(s)
        b["c"].add(c)
    return where, starts


def test_equals_plain_best_fit():
    rng = random.Random(3)
    for n, kinds in ((0, 1), (1, 1), (300, 3), (300, 100), (500, 9)):
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        sources = [rng.randrange(kinds) for _ in range(n)]
        clusters = [rng.choice([None, rng.randrange(50), rng.randrange(5000)]) for _ in range(n)]
        assert packing.pack(sizes, sources, clusters, 100) == plain_pack(sizes, sources, clusters, 100)


def _invariants(rows, sizes, capacity):
    bins, got = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.doc_start, r.n_tokens))
        if r.bin_id is None:
            assert r.n_tokens == 0
            continue
        bins.setdefault(r.bin_id, []).append(r)
    for d, n in sizes.items():
        at = 0
        for start, m in sorted(got[d]):
            assert start == at
            at += m
        assert at == n
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.n_tokens
        assert at <= capacity
        assert len({r.source for r in members}) == len(members) == len({r.cluster for r in members})
    return bins


def test_query(spark, sf):
    sizes = {r.doc_id: len(r.text.split()) if r.text else 0 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bins = _invariants(packing.op6_pack(spark, sf).collect(), sizes, packing.CAPACITY)
    assert len(bins) <= 2 * sum(sizes.values()) / packing.CAPACITY + 20


def test_edges(spark):
    rows = [(1, None, "x " * 5000), (2, None, "X " * 5000), (3, "a", None), (4, "a", ""), (5, "b", "q"), (5, "b", "q"), (None, "b", "z")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, cluster int")
    out = packing.pack_documents(df, capacity=100, block=3).collect()
    assert sum(r.n_tokens for r in out) == 10003 and sum(r.bin_id is None for r in out) == 2
    assert packing.pack_documents(df.limit(0)).count() == 0
