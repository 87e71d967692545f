"""Near-duplicates by similarity against brute force, with small and large elements."""

import random

import corpus_pipeline as cp
import numpy as np
import pytest
from helixloom.llm import quality, similar, simhash
from pyspark.sql import functions as F


def plain_groups(rows):
    sets = [similar.shingles((r[1] or "").encode()) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


@pytest.mark.parametrize(("small", "block"), [(64, 128), (2, 3)])
def test_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng, texts = random.Random(3), []
    for _ in range(5):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.randint(0, len(words) // 20 + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(900)}"
            texts.append(" ".join(copy))
    texts += [None, "", " ", "One two", "one TWO", "one two three"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.first_rows(df, similar.groups(df.select("doc_id", *simhash.row_name(), "text"), small=small))
    want = plain_groups(rows)
    assert len(want) < 50 and sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert cp.near_dedup(spark, df.limit(0), "").count() == 0


def test_stage_links_pairs_of_many_bits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.doc_id for r in cp.near_dedup(spark, docs, sf).collect()} == plain_groups(rows)
    fps = {d: simhash.fingerprint((t or "").encode()) for d, t in rows}
    assert bin((fps[6] ^ fps[145]) % 2**64).count("1") > simhash.DISTANCE and bin((fps[1] ^ fps[177]) % 2**64).count("1") > simhash.DISTANCE


def test_folded_bits_rule_out_no_similar_pair(spark):
    rng, rows, want = random.Random(11), [], []
    for k in range(300):
        size, same = rng.choice([1, 2, 9, 80, 700, 3000]), rng.random()
        a = {rng.getrandbits(63) for _ in range(size)}
        b = set(rng.sample(sorted(a), round(len(a) * same))) | {rng.getrandbits(63) for _ in range(rng.randint(0, size // 4))} or a
        x, y = (np.array(sorted(v), np.int64) for v in (a, b))
        rows.append((k, *([int(w) for w in similar._fold(similar._odd(v))] for v in (x, y)), len(a) + len(b)))
        want += [k] * similar.similar(a, b)
    df = spark.createDataFrame(rows, "k long, x array<long>, y array<long>, sizes long")
    near = {r.k for r in df.where(similar._near(F.col("x"), F.col("y"), F.col("sizes"))).collect()}
    assert set(want) <= near and len(want) > 20 and len(near) < 290


def test_plans_do_not_carry_their_arrays(spark, sf):
    """Bits and ratios are subqueries: as literals they stood in each plan that the driver prints and keeps."""
    rows = spark.range(1000).select(F.xxhash64("id").alias("_hash"))
    docs = spark.range(3000).select(F.xxhash64("id").alias("_hash"))
    among = docs.where(similar._may_be_among(rows, F.col("_hash")))
    assert 1000 <= among.count() < 1010 and rows.join(among, "_hash").count() == 1000
    kept = quality.quality_filter(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert all(len(df._jdf.queryExecution().toString()) < 100_000 for df in (among, kept))


def test_simhash_links_first_and_the_rest_is_completed(spark, monkeypatch):
    """SimHash proposes pairs, texts decide them; what follows links only sets that it has left apart."""
    rng, rows = random.Random(5), []
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for changes in (0, 1, 8):  # the last at similarity 0.8 or less, far apart in bits
            copy = list(words)
            for at in range(0, 200, 25)[:changes]:
                copy[at + 2] = f"x{rng.randrange(10**6)}"
            rows.append((3 * k + changes // 4 + (changes == 1), " ".join(copy)))
    proposed, decided = [], []
    links, decide = simhash.links, similar._similar_pairs

    def spied(*a, **how):
        proposed.append(links(*a, **how))
        return proposed[-1]

    def decided_on(*a):
        decided.append(decide(*a))
        return decided[-1]

    monkeypatch.setattr(simhash, "links", spied)
    monkeypatch.setattr(similar, "_similar_pairs", decided_on)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.near_dedup(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(plain_groups(rows))
    assert len(proposed) == 1 and proposed[0].count() >= 10
    first = [(r.a, r.b) for r in decided[0].collect()]
    assert len(first) >= 10
    root = {}
    for a, b in first:
        new, old = root.get(a, a), root.get(b, b)
        root |= {x: new for x in [*root, a, b] if root.get(x, x) in (new, old)}
    later = [(r.a, r.b) for d in decided[1:] for r in d.collect()]
    assert later and not any(root.get(a, a) == root.get(b, b) for a, b in later)
