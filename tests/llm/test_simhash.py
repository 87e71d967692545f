"""SimHash against brute force: fingerprints, components, hot keys, contraction rounds."""

import random

import numpy as np
import xxhash
from helixloom.llm import simhash
from helixloom.llm.components import connected
from pyspark.sql import functions as F


def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(fps))}


def test_fingerprints(spark):
    for t in ["", None, "One", "ONE two", "É a B c d e É é", "a b c a b c a b c", "x\x0by\x0cz w", "a b c\x85d e f"]:
        assert simhash.fingerprint(t and t.encode()) % 2**64 == plain_fingerprint(t)
    own = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert own % 2**64 == xxhash.xxh64(b"one two three", seed=42).intdigest()


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = plain_components(list(fps), list(fps.values()))
    rows = simhash.op4_simhash(spark, sf).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def _cloud(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = [0, 2**64 - 1]
    for _ in range(n):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 7)):
            x ^= 1 << b
        out.append(x)
    return out


def test_links_connect_all_close_pairs_with_hot_keys(spark):
    fps = _cloud(600, 1)
    want = plain_components(list(range(len(fps))), fps)
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    for cap in (5, 1 << 16):
        got = {r.doc_id: r.component_id for r in df.join(simhash.components(df, cap=cap), "fp").collect()}
        assert got == want, cap


def test_large_groups_grow(spark):
    f = np.array(_cloud(300, 2), dtype=np.uint64)
    label = simhash._labels(np.zeros(len(f), int), f, 3)
    want = plain_components(list(range(len(f))), f.tolist())
    assert label.tolist() == [want[i] for i in range(len(f))]


def test_contraction_of_paths_stars_and_empty(spark):
    path = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(50)] + [(5000, 5000)]
    df = spark.createDataFrame(path, "a long, b long")
    for bound in (0, 10, 1000):
        roots = {r.node: r.root for r in connected(df, local_links=bound).collect()}
        assert len({roots[i] for i in range(41)}) == 1 and len({roots[i] for i in range(1000, 1051)}) == 1
        assert roots[0] != roots[1000] and len(roots) == 92
    assert connected(df.limit(0)).count() == 0


def test_one_of_each_and_edge_rows(spark):
    t = "the quick brown fox jumps over the lazy dog again and again until evening comes"
    rows = [(3, t, 1, "x"), (2, t.upper(), 2, "y"), (2, t, 3, "y"), (9, None, 4, None), (8, "", 5, None), (None, "quite other words here now", 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, root string")
    got = sorted((r.doc_id or 0, r.text, r.fp) for r in simhash.one_of_each(df).collect())
    assert [g[0] for g in got] == [0, 2, 8]
    assert simhash.one_of_each(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0
