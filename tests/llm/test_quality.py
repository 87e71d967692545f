"""Quality rules against plain counts and plain multinomials."""

import math
import re

import xxhash
from helixloom.llm import quality
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_features(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = {}, set()
    for i, x in enumerate(windows):
        seen.setdefault(x, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 400, "l1 #*$\nl1 #*$\n\n \nl2|<>\nl1 #*$", "a b c d e f a b c d e g", "\U0001f600 é\x0bz\x85y", "w1 " * 3 + " ".join(f"q{k}" for k in range(3000)), "z" * 100000]


def test_base_features(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, kept int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.base_features(df).collect()}
    assert got == {k: plain_features(t) for k, t in enumerate(TEXTS)}


def _h(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p if isinstance(p, bytes) else p.to_bytes(8, "little"), seed=seed).intdigest()
    return seed


def _grams(text, buckets):
    u = [_h(w.encode()) for w in WORD.findall(text or "")]
    signed = lambda x: x - 2**64 if x >> 63 else x
    return [signed(x) % buckets for x in u], [(a, b) for a, b in zip(u, u[1:], strict=False)]


def test_ratio_counts_cover_every_document(spark):
    """Word counts equal plain ones; pair counts have the right total."""
    texts = {1: "alpha beta gamma alpha", 2: "beta beta delta", 3: None, 4: "junk ### junk"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sample = spark.createDataFrame([(1, 0)], "doc_id long, role int")
    ratio = {r.bucket: r.ratio for r in quality.fit_ratio(docs, sample, 64).collect()}
    assert sorted(ratio) == list(range(64))
    raw = [g for t in texts.values() for g in _grams(t, 64)[0]]
    pairs = sum(len(_grams(t, 64)[1]) for t in texts.values())
    total_raw, total_target = len(raw) + pairs, 4 + 3
    untouched = math.log(1 / (total_target + 64)) - math.log(1 / (total_raw + 64))
    assert max(abs(v - untouched) < 1e-12 for v in ratio.values())
    u = docs.select("doc_id", F.explode(quality._hashes(F.col("text"))).alias("h")).select("doc_id", F.pmod("h", F.lit(64)).alias("b")).collect()
    assert sorted(r.b for r in u) == sorted(raw)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op3_quality(spark, sf).collect()
    assert len(rows) == len(docs)
    kept = {r.doc_id: r.kept for r in rows}
    for r in rows:
        n, chars, symbols, lines, repeats = plain_features(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.base_failed and r.kept)
    good = [kept[d] for d, q in labels.items() if q == 1 and d in kept]
    bad = [kept[d] for d, q in labels.items() if q == 0 and d in kept]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.4
    assert {r.doc_id: r.kept for r in quality.op3_quality(spark, sf).collect()} == kept


def test_edges(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(30)), 7), (1, " ".join(f"w{k}" for k in range(30)), 7), (None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge(docs.drop("score"), none).collect()
    assert sorted((r.doc_id or 0, r.kept, r.score) for r in out) == [(0, False, 0.0), (1, True, 0.0), (1, True, 0.0)]
    assert quality.judge(docs.limit(0), none).count() == 0
    kept = quality.quality_filter(docs, none)
    assert kept.columns == docs.columns and kept.count() == 2


def test_threshold_rests_on_all_labels(spark):
    """More labels than the 40,000 that were read before: the threshold is the quantile over every held-out document."""
    n = 90_000
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(400))) for k in range(10)])
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    rows = quality.judge(docs, labels).select("score", "threshold", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("held")).collect()
    held = sorted(r.score for r in rows if r.held)
    at = (1 - quality.KEEP_TRUSTED) * (len(held) - 1)
    want = held[int(at)] + (held[int(at) + 1] - held[int(at)]) * (at - int(at))
    assert len(held) > 40_000 and abs(rows[0].threshold - want) < 1e-12
