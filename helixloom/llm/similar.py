"""Near-duplicates by Jaccard similarity of word shingles: all pairs of ``SIMILAR`` or more are linked, none is left to chance.

SimHash comes first: fingerprints of the shingles meet by the blocks of ``simhash``, those that differ in up to ``NEAR`` bits are
candidates, and their texts decide. It does not find all pairs: at similarity 0.8 fingerprints of 64 bits differ in up to 17 bits
(counted on sf0.1 and sf0.001), for which no blocks are selective. Sets that it has not linked are completed exactly.

Two sets of n and m elements with similarity 0.8 share so much that, in any order that holds for all sets, the first
n - ceil(0.8 n) + 1 of one and the like of the other have an element in common. Sets meet by these elements, pairs whose sizes
allow 0.8 and that SimHash leaves apart are candidates.

The order puts shingles that many documents of a bounded sample have last, the most frequent at the very end, so passages that
many documents carry seldom bring them together. The sample bears on the work alone, never on the result. An element with up to
``SMALL`` sets gives all its pairs. A larger one is linked to a few of its sets first; then only sets outside its largest group
meet the others, so a large group of copies does not give all its pairs, and still every pair is either linked or compared.
Of most candidates, bits that tell elements of odd number show that the sets differ too much; the others are decided on the texts
in blocks of sets, so that a text travels to a block and not to each of its pairs.

Defined results: letters A-Z are lower-cased; a text of fewer than ``SHINGLE`` words is one shingle; null and empty texts are
one group; a group is a connected component of linked pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from helixloom.llm import simhash
from helixloom.llm.common import discard, materialize
from helixloom.llm.components import connected

SHINGLE = 5
#: Least similarity of a linked pair, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Bits in which fingerprints that share three of six blocks may differ and be candidates.
NEAR = 14
#: Sets of one element that give all their pairs at once, and sets that a larger element is linked to first.
SMALL, HUBS = 64, 4
#: How often sets may be marked again, and how often sets outside the largest group are linked to a few of theirs.
REFINE, ROUNDS = 2, 2
#: Sets of a component whose pairs are decided together.
BLOCK = 128
#: The least and the most odd bits of a set, as powers of two, and bits by which texts of candidates are told from others.
LEAST_ODD, MOST_ODD, BITS = 9, 16, 1 << 22
#: 64-bit words of a set's odd bits at their least length, which joins compare.
FOLD = (1 << LEAST_ODD) // 64
#: Documents that are sampled for frequent shingles, how many of them make a shingle frequent, and how many are kept.
SAMPLE, FREQUENT, MOST = 10_000, 3, 50_000


def shingles(text: bytes | None) -> set[bytes]:
    w = (text or b"").lower().split()
    return {b" ".join(w)} if 0 < len(w) < SHINGLE else set(map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)))


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _hashed(text: bytes | None) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x) for x in shingles(text)), np.uint64)).view(np.int64)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and estimated counts of the shingles that are frequent in a sample of at most about ``SAMPLE`` documents."""
    part = max(1, -(-docs.count() // SAMPLE))
    sample = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(part)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()):
                seen.update(_hashed(t.as_py()).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["h", "n"])

    found = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return _ordered({r["h"]: r["n"] * part for r in found.orderBy(F.desc("n"), "h").limit(MOST).collect()})


def _ordered(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and their counts."""
    rows = sorted(counts.items())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _start(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The elements of a set by which it meets others."""
    size = len(h) - -(-SIMILAR[0] * len(h) // SIMILAR[1]) + 1 if len(h) else 0
    if not len(frequent[0]):
        return h[:size]
    at = np.minimum(np.searchsorted(frequent[0], h), len(frequent[0]) - 1)
    return h[np.lexsort((h, np.where(frequent[0][at] == h, frequent[1][at], 0)))[:size]]


def _odd(h: np.ndarray) -> bytes:
    """A bit for each value of the hashes' low bits, 1 where an odd number of elements has it; about a bit an element, ``LEAST_ODD``
    at least.

    Two sets differ in at least as many elements as their odd bits differ in places."""
    bits = 1 << min(MOST_ODD, max(LEAST_ODD, (len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h & (bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _fold(odd: bytes) -> np.ndarray:
    """Odd bits at their least length, as ``FOLD`` words."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.int64).reshape(-1, FOLD))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose odd bits allow the similarity; the longer bits are folded to the shorter ones' length."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            differ = int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())
            keep.append(differ * (SIMILAR[1] + SIMILAR[0]) <= (n + m) * (SIMILAR[1] - SIMILAR[0]))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _marker(frequent: tuple[np.ndarray, np.ndarray]):
    """mapInArrow that puts (s, n, start, odd, fold, fp) in place of the text: the set's hash, size, start, odd bits, whole and folded,
    and fingerprint.

    A task gives start, bits and fingerprint of its first copy of a set alone, so copies meet no more often than there are tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of one task, whose input is bounded
        for batch in batches:
            h = [_hashed(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            # a set is named by its sorted hashes
            s, start = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in h], []
            odd, fold, fp = [], [], []
            for name, x in zip(s, h, strict=True):
                start.append(None if name in seen else _start(x, frequent))
                odd.append(None if name in seen else _odd(x))
                fold.append(None if name in seen else _fold(odd[-1]))
                fp.append(None if name in seen else simhash.majority(x.view(np.uint64)) if len(x) else 0)
                seen.add(name)
            names = [x for x in batch.schema.names if x != "text"]
            own = [pa.array(s, pa.int64()), pa.array([len(x) for x in h], pa.int64()), pa.array(start, pa.list_(pa.int64())), pa.array(odd, pa.binary()), pa.array(fold, pa.list_(pa.int64())), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *own], [*names, "s", "n", "start", "odd", "fold", "fp"])

    return run


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SIMILAR[1] * np.minimum(n, m) >= SIMILAR[0] * np.maximum(n, m)


def _pairer(small: int):
    """mapInArrow over (key, n, s) sorted by key: pairs (a, b) of small keys with key null, or rows (s, n) of the others.

    A key with more sets than ``small`` is passed on as it comes; no more than that and one batch are held."""

    def out(a, b, key=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()) if key is None else pa.array(key, pa.int64())], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot, last = np.empty((0, 3), np.int64), None, None
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in ("key", "n", "s")], axis=1)
            if not len(x):
                continue
            # copies that several tasks gave are neighbours
            x = x[np.r_[last is None or (x[0] != last).any(), (x[1:] != x[:-1]).any(axis=1)]]
            last = x[-1] if len(x) else last
            if hot is not None and len(x):
                more = int(np.searchsorted(x[:, 0], hot, "right"))
                yield out(x[:more, 2], x[:more, 1], x[:more, 0])
                x, hot = x[more:], hot if more == len(x) else None
            x = np.concatenate([held, x])
            first = int(np.searchsorted(x[:, 0], x[-1, 0])) if len(x) else 0
            if first:
                yield from closed(x[:first])
            held = x[first:]
            if len(held) > small:
                hot = held[0, 0]
                yield out(held[:, 2], held[:, 1], held[:, 0])
                held = held[:0]
        if len(held):
            yield from closed(held)

    def closed(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, n, s = x.T
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        few = np.repeat(sizes <= small, sizes)
        found = [np.empty((0, 2), np.int64)]
        for k in range(1, int(sizes[sizes <= small].max(initial=1))):
            i = np.flatnonzero((key[k:] == key[:-k]) & few[k:])
            i = i[_fits(n[i], n[i + k])]
            found.append(np.sort(np.stack([s[i], s[i + k]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            yield out(pairs[:, 0], pairs[:, 1])
        if not few.all():
            yield out(s[~few], n[~few], key[~few])

    return run


def _to_hubs(large: DataFrame, among: DataFrame) -> DataFrame:
    """Pairs of a few sets of ``among``, the least, the largest and others by hash, with all others of their key in ``large``; both
    (key, s, n, fold). Pairs that sizes or folded odd bits rule out leave no row."""
    of = [F.min(F.struct("n", "s", "fold")), F.max(F.struct("n", "s", "fold")), *[F.min(F.struct(F.xxhash64("s", F.lit(k)).alias("h"), "n", "s", "fold")) for k in range(HUBS - 2)]]
    hubs = among.groupBy("key").agg(*[f.alias(f"h{k}") for k, f in enumerate(of)])
    each = [F.struct(F.col(f"h{k}.s").alias("a"), F.col(f"h{k}.n").alias("m"), F.col(f"h{k}.fold").alias("hub_fold")) for k in range(HUBS)]
    hubs = hubs.select("key", F.explode(F.array_distinct(F.array(*each))).alias("h")).select("key", "h.*")
    near = (F.col("s") != F.col("a")) & _fit(F.col("n"), F.col("m")) & _near(F.col("fold"), F.col("hub_fold"), F.col("n") + F.col("m"))
    return large.join(hubs, "key").where(near).select("a", F.col("s").alias("b"))


def _fit(n: Column, m: Column) -> Column:
    return SIMILAR[1] * F.least(n, m) >= SIMILAR[0] * F.greatest(n, m)


def _near(x: Column, y: Column, sizes: Column) -> Column:
    """Whether folded odd bits of two sets, of ``sizes`` elements together, allow the similarity."""
    differ = sum(F.bit_count(F.get(x, k).bitwiseXOR(F.get(y, k))) for k in range(FOLD))
    return differ * (SIMILAR[1] + SIMILAR[0]) <= sizes * (SIMILAR[1] - SIMILAR[0])


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of odd bits, as 64-bit words, at a smaller length."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _meet(keys: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of ``others`` have one of ``keys``."""
    if not len(keys) or not others:
        return np.zeros(len(others), bool)
    owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
    return np.bincount(owner, np.isin(np.concatenate(others), keys), len(others)) > 0


def _apart(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different roots whose sizes and odd bits allow the similarity; those within the most frequent root are linked
    already, so each pair has a set outside it. What cannot be similar is compared here and leaves no row.

    ``before`` has the lesser large keys of a set. Sets that share several large keys become a row at the least of them alone, where
    they meet as well as anywhere, and with the lesser set first if both are outside."""
    s, n, root, before = (group[c].to_numpy() for c in ("s", "n", "root", "before"))
    roots, count = np.unique(root, return_counts=True)
    words = np.array([len(x) // 8 for x in group["odd"]])
    of = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    bits = {w: np.frombuffer(b"".join(group["odd"].iloc[i]), np.uint64).reshape(-1, w) for w, i in of.items()}
    place = np.empty(len(s), np.int64)
    for i in of.values():
        place[i] = np.arange(len(i))
    found = [np.empty((0, 2), np.int64)]
    outside = root != roots[np.argmax(count)]
    for k in np.flatnonzero(outside):
        own = bits[words[k]][place[k] : place[k] + 1]
        for w, i in of.items():
            near = _fits(n[i], n[k]) & (root[i] != root[k]) & (~outside[i] | (s[k] < s[i]))
            if near.any():
                least = min(w, words[k])
                differ = np.bitwise_count(_folded(bits[w][near], least) ^ _folded(own, least)).sum(axis=1, dtype=np.int64)
                other = i[near][differ * (SIMILAR[1] + SIMILAR[0]) <= (n[i][near] + n[k]) * (SIMILAR[1] - SIMILAR[0])]
                other = other[~_meet(before[k], [before[j] for j in other])]
                found.append(np.stack([np.full(len(other), s[k]), s[other]], axis=1))
    pairs = np.concatenate(found)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _decide(block: pa.Table) -> pa.Table:
    """The similar ones of a block's pairs; rows (s, text, partners), each text once."""
    names = block.column("s").to_pylist()
    sets = {s: shingles(t.as_py()) for s, t in zip(names, block.column("text").cast(pa.binary()), strict=True)}
    pairs = [(s, p) for s, partners in zip(names, block.column("partners").to_pylist(), strict=True) for p in partners or () if similar(sets[s], sets[p])]
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _may_be_among(rows: DataFrame, value: Column) -> Column:
    """Whether a hash is one of ``rows``' (_hash): never false if it is, and seldom true if it is not, as far as ``BITS`` bits go.

    The bits, whose number is fixed, come as at most ``BITS`` / 64 longs from a subquery."""
    place = lambda h: F.pmod(F.xxhash64(h, F.lit(23)), F.lit(BITS))
    at = lambda h: F.floor(place(h) / 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(F.col("_hash")), F.lit(64)).cast("int"))
    zero = rows.sparkSession.range(0, BITS // 64, 1, 1).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    found = rows.select(at(F.col("_hash")).alias("word"), one.alias("bits")).unionByName(zero).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x.bits).alias("words")).scalar()
    return F.call_function("shiftright", F.get(words, at(value)), F.pmod(place(value), F.lit(64)).cast("int")).bitwiseAND(1) == 1


def _similar_pairs(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar, written. ``sets``: (s, n, _hash, odd, linked); ``docs``: (_hash, text).

    Pairs with one value of ``linked`` are linked already and left out. What is left after the odd bits are compared is dealt to blocks of at most 2 x ``BLOCK`` sets: the sets of one component of candidate pairs by a hash of theirs, a
    block for every two hashes that a pair has. A text goes to each of its blocks once, instead of to each of its pairs."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = sets.select(F.col("s").alias("a"), "n", F.col("odd").alias("x"), F.col("linked").alias("i"))
    right = sets.select(F.col("s").alias("b"), F.col("n").alias("m"), F.col("odd").alias("y"), F.col("linked").alias("j"))
    pairs, _ = materialize(pairs.join(left, "a").join(right, "b").where("i <> j").select("a", "b", "n", "m", "x", "y").mapInArrow(_possible, "a long, b long"), "similar-pairs")
    member = connected(pairs)
    parts = member.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    slot = member.join(parts, "root").select("node", "root", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).alias("slot"))
    slot, _ = materialize(slot, "similar-slots")
    one, other = slot.select(F.col("node").alias("a"), "root", F.col("slot").alias("i")), slot.select(F.col("node").alias("b"), F.col("slot").alias("j"))
    dealt = pairs.join(one, "a").join(other, "b").select("a", "b", F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("block"))
    ends = dealt.select(F.col("a").alias("s"), "block", F.col("b").alias("p")).unionByName(dealt.select(F.col("b").alias("s"), "block", F.lit(None).cast("long").alias("p")))
    wanted, _ = materialize(ends.groupBy("s", "block").agg(F.collect_list("p").alias("partners")).join(sets.select("s", "_hash"), "s"), "similar-wanted")
    # copies of a text fall together before the shuffle, and most texts that no pair has stay out of it
    texts = docs.where(_may_be_among(wanted, F.col("_hash"))).groupBy("_hash").agg(F.min("text").alias("text")).join(wanted, "_hash").select("block", "s", "text", "partners")
    return materialize(texts.groupBy("block").applyInArrow(_decide, "a long, b long"), "similar-links")[0]


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (s, ...) with the root of their component."""
    roots = connected(links).select(F.col("node").alias("s"), "root")
    return rows.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))


def _outside(rooted: DataFrame) -> DataFrame:
    """The rows (key, s, n, fold) of keys that are not in their key's most frequent root."""
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    most = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"))
    return rooted.join(most, "key").where("root <> most").select("key", "s", "n", "fold")


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that SimHash proposes: of equal fingerprints, and of those that blocks bring together with at most ``NEAR``
    bits between them. ``sets``: (s, fp), written. As many as connect what it finds, not all."""
    first = sets.groupBy("fp").agg(F.min("s").alias("first"))
    first, _ = materialize(first, "similar-fp")
    same = sets.join(first, "fp").where("s <> first").select(F.col("first").alias("a"), F.col("s").alias("b"))
    one, other = first.select(F.col("fp").alias("a"), F.col("first").alias("x")), first.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    near = simhash.links(first.select("fp"), distance=NEAR).distinct().join(one, "a").join(other, "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def simhash_linked(marked: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets (s, n, _hash, odd, fold, linked), ``linked`` being equal where SimHash and then the texts connect them, and those links."""
    columns = [F.min(c).alias(c) for c in ("_hash", "odd", "fold", "fp")]
    sets, _ = materialize(marked.groupBy("s", "n").agg(*columns), "similar-sets")
    links = _similar_pairs(simhash_pairs(sets.select("s", "fp")), sets.withColumn("linked", F.col("s")), docs)
    return materialize(_rooted(sets.drop("fp"), links).withColumnRenamed("root", "linked"), "similar-linked")[0], links


def roots(marked: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(s, root) of every distinct set. ``marked``: (_hash, s, n, odd, fold, fp) and ``found``: what ``_pairer`` gives, written; ``docs``:
    (_hash, text).

    SimHash links sets first. Then those of a large key meet a few of them, then a few of those outside its largest group, and at
    last those outside meet all."""
    sets, links = simhash_linked(marked, docs)
    large = found.where("key IS NOT NULL").select("key", F.col("a").alias("s"), F.col("b").alias("n"))
    large, _ = materialize(large.join(sets.select("s", "fold"), "s"), "similar-large")
    first = _similar_pairs(found.where("key IS NULL").select("a", "b").unionByName(_to_hubs(large, large)), sets, docs)
    links, _ = materialize(links.unionByName(first), "similar-links")
    for _ in range(ROUNDS):
        rest, _ = materialize(_outside(_rooted(large, links)), "similar-outside")
        if rest.isEmpty():
            return _rooted(sets.select("s"), links)
        links, _ = materialize(links.unionByName(_similar_pairs(_to_hubs(large, rest), sets, docs)), "similar-more-links")
    keys = large.groupBy("s").agg(F.collect_list("key").alias("keys"))
    left = _rooted(large.drop("fold"), links).join(sets.select("s", "odd"), "s").join(keys, "s").withColumn("before", F.filter("keys", lambda k: k < F.col("key"))).drop("keys")
    left = left.groupBy("key").applyInPandas(_apart, "a long, b long")
    return _rooted(sets.select("s"), links.unionByName(_similar_pairs(left, sets, docs)))


def groups(docs: DataFrame, *, small: int = SMALL) -> DataFrame:
    """The columns of ``docs`` without its text, and ``root``, equal for documents of one group. ``docs``: (_hash, text, ...).

    Elements that turn out to have many sets go to the end of the order, and the sets are marked again."""
    spark, own, frequent = docs.sparkSession, [c for c in docs.columns if c != "text"], _frequent(docs)
    schema = docs.drop("text").schema.add("s", "long").add("n", "long").add("start", ArrayType(LongType())).add("odd", "binary").add("fold", ArrayType(LongType())).add("fp", "long")
    for left in range(REFINE, -1, -1):
        marked, marked_path = materialize(docs.mapInArrow(_marker(frequent), schema), "similar-marked")
        keyed = marked.select(F.explode("start").alias("key"), "n", "s").repartition("key").sortWithinPartitions("key", "n", "s")
        found, found_path = materialize(keyed.mapInArrow(_pairer(small), "a long, b long, key long"), "similar-candidates")
        if not left:
            break
        known = dict(zip(*(x.tolist() for x in frequent), strict=True))
        many = found.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(MOST)
        new = {r["key"]: r["n"] for r in many.collect() if r["key"] not in known}
        if not new:
            break
        frequent = _ordered(known | new)
        discard(spark, marked_path, found_path)
    return marked.select(*own, "s").join(roots(marked.select("_hash", "s", "n", "odd", "fold", "fp"), found, docs.select("_hash", "text")), "s").select(*own, "root")
