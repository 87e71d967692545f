"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, components.

64 bits in six blocks: fingerprints that differ in at most three bits agree in at least three blocks, so they share at least
one of the 20 keys of three blocks (31 to 33 bits each). Equal fingerprints are one row from the start; links are sought among
distinct fingerprints that share a key and verified by Hamming distance. A task streams its sorted keys and emits, for each
key, links to the least fingerprint of each connected group, never all pairs. A key with more than ``CAP`` fingerprints is
dealt out again: its free bits fall into eight parts, a close pair agrees in five of them, and at most three parts, 15 bits,
stay free, so no second key can hold more than 32,768 fingerprints.

Defined results: null or empty text has fingerprint zero and links like any other; repeated rows share all results; a component
whose ids are all null has a null id; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, table
from helixloom.llm.components import connected, settle

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of one key that a task holds at once (8 bytes each).
CAP = 65_536
#: Groups up to this size are compared neighbour by neighbour for all groups of a batch at once.
SMALL = 64


def _bits(low: int, n: int) -> int:
    return ((1 << n) - 1) << low


def _parts(bits: list[int], n: int) -> list[int]:
    """Bit positions dealt into n runs of nearly equal size, as masks."""
    return [sum(1 << b for b in run) for run in np.array_split(bits, n) for run in [[int(x) for x in run]]]


def _choose(parts: list[int], n: int) -> list[int]:
    return [sum(c) for c in combinations(parts, n)]


FIRST = _choose(_parts(list(range(64)), 6), 3)


def _second(mask: int) -> list[int]:
    """Masks that refine a first-level key: five of eight parts of its free bits added."""
    return [mask | extra for extra in _choose(_parts([b for b in range(64) if not mask >> b & 1], 8), 5)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- fingerprints ------------------------------------------------------------------------------------------------------


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text, as a signed long."""
    w = (text or b"").lower().split()  # bytes: A-Z alone change, and white space is 20 and 09 to 0D
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed long."""
    ones = sum(np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(h), 65536))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text").cast(pa.binary())
        fp = pa.array((fingerprint(t.as_py()) for t in texts), pa.int64())
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], fp], [*names, "fp"])


def with_fingerprint(df: DataFrame, text: str | Column = "text") -> DataFrame:
    """The columns of ``df`` without its text, and ``fp``."""
    rest = [c for c in df.columns if c != text]
    given = df.select(*rest, F.col(text).alias("_text"))
    schema = given.drop("_text").schema.add("fp", "long")
    return given.mapInArrow(_fingerprints, schema)


# ---- links -------------------------------------------------------------------------------------------------------------


def _grow(f: np.ndarray, distance: int) -> np.ndarray:
    """Least-index labels of one large group. What is reached leaves the rest, so dense groups need few passes."""
    label, rest = np.arange(len(f)), np.arange(1, len(f))
    front, at = [0], 0
    while True:
        while front and len(rest):
            near = np.bitwise_count(f[rest] ^ f[front.pop()]) <= distance
            hits = rest[near]
            label[hits] = at
            front.extend(hits.tolist())
            rest = rest[~near]
        if not len(rest):
            return label
        at, rest = int(rest[0]), rest[1:]
        front = [at]


def _labels(group: np.ndarray, f: np.ndarray, distance: int) -> np.ndarray:
    """For rows sorted by group, the index of the least row of the same group that links reach."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    label = np.arange(len(group))
    small = np.repeat(sizes <= SMALL, sizes)
    a, b = [], []
    for s in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        i = np.flatnonzero((group[s:] == group[:-s]) & small[s:])
        i = i[np.bitwise_count(f[i] ^ f[i + s]) <= distance]
        a.append(i)
        b.append(i + s)
    if a:
        label = settle(np.concatenate(a), np.concatenate(b), len(group))
    for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        label[at : at + n] = at + _grow(f[at : at + n], distance)
    return label


def _linker(cap: int, distance: int):
    """mapInArrow over rows (mask, key, fp) sorted by key: rows (a, b, mask), links with mask null, or members of keys over cap."""

    def out(a, b, mask=None):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(a) if mask is None else mask, pa.int64())], ["a", "b", "mask"])

    def linked(key, f):
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(axis=1)])
        label = _labels(group, f, distance)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return out(f[moved].view(np.int64), f[label[moved]].view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f, hot = np.empty((0, 2), np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            k = np.stack([batch.column("mask").to_numpy(), batch.column("key").to_numpy()], axis=1)
            x = batch.column("fp").to_numpy().view(np.uint64)
            if hot is not None:
                n = int((k == hot).all(axis=1).sum())
                yield out(x[:n].view(np.int64), k[:n, 1], k[:n, 0])
                k, x, hot = k[n:], x[n:], hot if n == len(k) else None
            key, f = np.concatenate([key, k]), np.concatenate([f, x])
            if not len(key):
                continue
            last = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])[-1])
            if last:
                # a complete group can exceed the cap only if it came within one batch
                yield from closed(key[:last], f[:last])
                key, f = key[last:], f[last:]
            if len(key) > cap:
                hot = key[0].copy()
                yield out(f.view(np.int64), key[:, 1], key[:, 0])
                key, f = key[:0], f[:0]
        if len(key):
            yield from closed(key, f)

    def closed(key, f):
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(key)])
        over = np.repeat(sizes > cap, sizes)
        if over.any():
            yield out(f[over].view(np.int64), key[over, 1], key[over, 0])
            key, f = key[~over], f[~over]
        if len(key):
            yield linked(key, f)

    return run


def _dealt(df: DataFrame, masks: Column) -> DataFrame:
    """(mask, key, fp) sorted by key in each partition; every fingerprint once for each mask."""
    keyed = df.select(F.explode(masks).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")


def links(distinct: DataFrame, *, distance: int = DISTANCE, cap: int = CAP) -> DataFrame:
    """(a, b): fingerprints at most ``distance`` <= 3 bits apart, enough of them to connect all that such links connect."""
    schema = "a long, b long, mask long"
    first = _dealt(distinct.select("fp"), F.array(*[F.lit(_signed(m)) for m in FIRST])).mapInArrow(_linker(cap, distance), schema)
    found, _ = materialize(first, "simhash-links")
    pairs = found.where("mask IS NULL").select("a", "b")
    hot = found.where("mask IS NOT NULL")
    if hot.isEmpty():
        return pairs
    finer = F.lit(None).cast("array<bigint>")
    for m in FIRST:
        finer = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)) for x in _second(m)])).otherwise(finer)
    again = _dealt(hot.select(F.col("a").alias("fp"), finer.alias("_m")), F.col("_m"))
    return pairs.unionByName(again.mapInArrow(_linker(max(cap, 1 << 15), distance), schema).select("a", "b"))


def components(marked: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """(fp, component_id): for every distinct fingerprint the least id that links reach. ``marked``: (id, fp), written."""
    distinct = marked.groupBy("fp").agg(F.min(id_col).alias("_id"))
    roots = connected(links(distinct, **how))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted, _ = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    marked, _ = materialize(with_fingerprint(docs.select("doc_id", "text")), "simhash-fp")
    return marked.join(components(marked, **how), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that come first in their group of near-duplicates (least id, null last), with their columns.

    Rows are named by id and hash of the text; the texts are shuffled once, by that name, to meet the names that stay."""
    marked, _ = materialize(with_fingerprint(docs.select("doc_id", *row_name(), "text")), "simhash-fp")
    return first_rows(docs, marked.join(_group_roots(marked.select("fp"), **how), "fp"))


def row_name() -> list[Column]:
    """(_null, _id, _hash) of rows with doc_id and text."""
    return [F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64("text").alias("_hash")]


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The first row of ``docs`` for each root of ``grouped`` (doc_id, _null, _id, _hash, root)."""
    first = grouped.groupBy("root").agg(F.min(F.struct("_null", "doc_id", "_id", "_hash")).alias("m")).select("m._null", "m._id", "m._hash")
    own = ["_null", "_id", "_hash"]
    number = F.row_number().over(W.partitionBy(*own).orderBy(F.lit(0)))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *row_name()).join(first, own).withColumn("_n", number)
    return rows.where("_n = 1").select("_row.*")


def _group_roots(marked: DataFrame, **how) -> DataFrame:
    """(fp, root) of every distinct fingerprint."""
    distinct = marked.select("fp").distinct()
    roots = connected(links(distinct, **how))
    return distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
