"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is four segments of 16 bits, each with a table from value to codes. A query probes one segment after the other with
growing radius; once segments 0..j have been probed to radius a and the others to a-1, every code at distance 4a+j or less has been
seen, by the pigeonhole principle. The search ends when the k-th verified distance is not above that bound. A radius with more
values than the table has codes is probed by comparing the codes' own segments.

Equal codes are one entry that counts its rows up to k, so a vector with very many copies costs one. Entries are dealt into shards
of bounded size and query codes into blocks of bounded size; every block meets every shard, a shard answers with the codes up to
its own k-th distance, and the answers are merged and expanded to rows. Every block brings a copy of the entries and an index of
its own, so blocks are no smaller than it takes to keep the session's shuffle tasks busy, up to a bound.

Defined results: bit i is 1 if element i is above zero; null vectors, elements and missing elements give 0 bits, elements after the
64th are not used; neighbours go by distance, then id, and a query finds itself; a null id is no query and, as a neighbour, comes
last among its equals; repeated rows are separate neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, spread, table

K, EVERY, SHARD = 10, 20, 65_536
#: Queries of a block: as few as the first while that gives tasks to run side by side, then up to the second.
BLOCK, MOST_BLOCK = 512, 16_384
SEGMENTS, WIDTH = 4, 16
_masks: dict[int, np.ndarray] = {}


def masks(radius: int) -> np.ndarray:
    """All segment values with so many bits."""
    if radius not in _masks:
        _masks[radius] = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], np.int64)
    return _masks[radius]


def binary_code(vector: Column) -> Column:
    """The signs of the first 64 elements as a long, the first element in the lowest bit."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = bit(0)
    for i in range(1, 64):
        code = code.bitwiseOR(bit(i))
    return code


class MultiIndex:
    """Segment tables over distinct codes, each standing for ``weights`` rows."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.codes, self.weights = codes.view(np.uint64), weights
        self.parts = [((self.codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) for s in range(SEGMENTS)]
        self.order = [np.argsort(p, kind="stable") for p in self.parts]
        self.starts = [np.r_[0, np.cumsum(np.bincount(p, minlength=1 << WIDTH))] for p in self.parts]

    def probe(self, segment: int, value: int, radius: int) -> np.ndarray:
        """Entries whose segment differs from a value in exactly ``radius`` bits."""
        if len(m := masks(radius)) > len(self.codes):
            return np.flatnonzero(np.bitwise_count(self.parts[segment] ^ value) == radius)
        v = value ^ m
        low, n = self.starts[segment][v], self.starts[segment][v + 1] - self.starts[segment][v]
        low, n = low[n > 0], n[n > 0]
        return self.order[segment][np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(n) else np.empty(0, np.int64)

    def search(self, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, distances) of all codes up to the distance of the k-th row."""
        seen, found, distances, histogram, n = np.zeros(len(self.codes), bool), [], [], np.zeros(65, np.int64), 0
        for radius in range(WIDTH + 1):
            for s in range(SEGMENTS):
                hits = self.probe(s, int(code >> np.uint64(WIDTH * s)) & ((1 << WIDTH) - 1), radius)
                hits = hits[~seen[hits]]
                seen[hits] = True
                d = np.bitwise_count(self.codes[hits] ^ code)
                histogram += np.bincount(d, self.weights[hits], 65).astype(np.int64)
                found.append(hits)
                distances.append(d)
                n += len(hits)
                kth = int(np.searchsorted(np.cumsum(histogram), k))
                if kth <= SEGMENTS * radius + s or n == len(self.codes):
                    hits, d = np.concatenate(found), np.concatenate(distances)
                    return hits[d <= kth], d[d <= kth]
        raise AssertionError("the last radius covers all codes")


def _search_block(k: int):
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        codes = entries["code"].to_numpy(np.int64)
        index = MultiIndex(codes, entries["weight"].to_numpy(np.int64)) if len(codes) else None
        out = []
        for q in queries["query"].to_numpy(np.int64) if index else ():
            hits, d = index.search(q.astype(np.uint64), k)
            out.append(pd.DataFrame({"query": q, "code": codes[hits], "distance": d.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query", "code", "distance")})

    return run


def nearest(items: DataFrame, queries: DataFrame, *, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) for ``queries`` (id, code) against ``items`` (id, code)."""
    rank = lambda *by: F.row_number().over(W.partitionBy("code").orderBy(*by))
    first = items.withColumn("_n", rank(F.col("id").asc_nulls_last())).where(F.col("_n") <= k)
    first, _ = materialize(first.select("id", "code"), "search-members")
    entries, _ = materialize(first.groupBy("code").agg(F.count("*").alias("weight")), "search-entries")
    asked, _ = materialize(queries.select(F.col("code").alias("query")).distinct(), "search-queries")
    shards, n_asked = max(1, -(-entries.count() // shard)), asked.count()
    side_by_side = -(-2 * spread(items.sparkSession) // shards)
    blocks = max(1, -(-n_asked // max(block, MOST_BLOCK)), min(-(-n_asked // block), side_by_side))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select("code", "weight", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    right = asked.select("query", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    answers = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search_block(k), "query long, code long, distance long")
    # codes first: a query needs at most the k nearest rows, and each code brings at most k
    rows = answers.join(first, "code")
    best = W.partitionBy("query").orderBy("distance", F.col("id").asc_nulls_last())
    top = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return named.join(top, "query").select("query_id", F.col("id").alias("neighbor_id"), "distance", F.col("rank").cast("long").alias("rank"))


def op10_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    coded, _ = materialize(vectors.select(F.col("vec_id").alias("id"), binary_code(F.col("embedding")).alias("code")), "search-codes")
    return nearest(coded, coded.where(F.col("id") % EVERY == 0))


OP10_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
    CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (coalesce(q.embedding[i], 0) > 0) <> (coalesce(e.embedding[i], 0) > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id NULLS LAST) AS rank FROM pairs)
SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= 10
"""
