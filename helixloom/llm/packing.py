"""Best-fit packing of documents into sequences of fixed length under conflicts.

A document of more than ``capacity`` words fills bins of its own and leaves a rest; rests and shorter documents are items. In a
block, items go largest first. Open bins stand in order of what is left in them, each with a bitmap of its sources and one of its
duplicate clusters. The search starts at the tightest bin that has room and goes on to its successors until one has neither the
item's source nor its cluster; if none has, a bin opens. Bins that are full leave the order.

Blocks are dealt by a hash of the document, their number follows the number of items, so a task holds ``block`` items on
average whatever the corpus. Copies in different blocks cannot meet. Bitmaps are exact: every source and every repeated cluster
of a block has a bit of its own.

Defined results: a null source is a source, a null cluster conflicts with nothing; a document without words is a row without bin;
repeated rows are packed one by one; ties go by hashed id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, table, word_count

CAPACITY, BLOCK = 2048, 4096


class Bins:
    """Open bins in order of room, then age, with bitmaps of what they hold."""

    def __init__(self, lanes: int):
        self.n = 0
        self.room = np.empty(256, np.int64)
        self.ids = np.empty(256, np.int64)
        self.bits = np.empty((lanes, 256), np.uint64)

    def _insert(self, room: int, bin_id: int, bits: np.ndarray) -> None:
        if self.n == len(self.room):
            self.room, self.ids = (np.concatenate([a, np.empty_like(a)]) for a in (self.room, self.ids))
            self.bits = np.concatenate([self.bits, np.empty_like(self.bits)], axis=1)
        at, n = int(np.searchsorted(self.room[: self.n], room, "right")), self.n
        for a, v in ((self.room, room), (self.ids, bin_id)):
            a[at + 1 : n + 1] = a[at:n]
            a[at] = v
        self.bits[:, at + 1 : n + 1] = self.bits[:, at:n]
        self.bits[:, at] = bits
        self.n += 1

    def _remove(self, at: int) -> None:
        n = self.n
        self.room[at : n - 1], self.ids[at : n - 1] = self.room[at + 1 : n], self.ids[at + 1 : n]
        self.bits[:, at : n - 1] = self.bits[:, at + 1 : n]
        self.n -= 1

    def put(self, size: int, lanes: list[tuple[int, np.uint64]], new_id: int, capacity: int) -> tuple[int, int]:
        """(bin, start): the tightest compatible bin, or a new one."""
        at, step = int(np.searchsorted(self.room[: self.n], size, "left")), 64
        while at < self.n:  # successors, a stretch at a time
            clash = np.zeros(min(step, self.n - at), bool)
            for lane, bit in lanes:
                clash |= (self.bits[lane, at : at + step][: self.n - at] & bit) != 0
            free = np.flatnonzero(~clash)
            if len(free):
                at += int(free[0])
                break
            at, step = at + len(clash), step * 4
        if at < self.n:
            room, bin_id, bits = int(self.room[at]), int(self.ids[at]), self.bits[:, at].copy()
            self._remove(at)
        else:
            room, bin_id, bits = capacity, new_id, np.zeros(len(self.bits), np.uint64)
        for lane, bit in lanes:
            bits[lane] |= bit
        if room > size:
            self._insert(room - size, bin_id, bits)
        return bin_id, capacity - room


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """(bin, start) of every item in the given order; all sizes from 1 to capacity."""
    source_no = {s: k for k, s in enumerate(dict.fromkeys(sources))}
    seen = pd.Series(clusters, dtype=object).value_counts()
    cluster_no = {c: k for k, c in enumerate(seen.index[seen > 1])}
    source_lanes = len(source_no) // 64 + 1
    bins, where, starts, opened = Bins(source_lanes + len(cluster_no) // 64 + 1), [], [], 0
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        k = source_no[s]
        lanes = [(k // 64, np.uint64(1 << k % 64))]
        if c in cluster_no:
            k = cluster_no[c]
            lanes.append((source_lanes + k // 64, np.uint64(1 << k % 64)))
        bin_id, start = bins.put(size, lanes, opened, capacity)
        opened += bin_id == opened
        where.append(bin_id)
        starts.append(start)
    return where, starts


def _pack_block(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "key", "doc_start"], ascending=[False, True, True], kind="stable")
        absent = object()
        sources = [absent if pd.isna(s) else s for s in group["source"]]
        clusters = [None if pd.isna(c) else c for c in group["cluster"]]
        group["bin"], group["bin_start"] = pack(group["n_tokens"].tolist(), sources, clusters, capacity)
        return group

    return run


def packed(items: DataFrame, *, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pieces (doc_id, source, cluster, piece, doc_start, n_tokens, bin_id, bin_start) of ``items`` (doc_id, source, cluster, size).

    A piece is the words doc_start .. doc_start + n_tokens of its document, at bin_start of its bin."""
    own_items = [F.col("doc_id"), F.col("source"), F.col("cluster").cast("long").alias("cluster"), F.col("size").cast("long").alias("size")]
    # repeated rows are counted, then numbered, so that they are dealt to different blocks and have names of their own in any run
    counted = items.select(*own_items).groupBy("doc_id", "source", "cluster", "size").agg(F.count("*").alias("_rows"))
    items, _ = materialize(counted.select("doc_id", "source", "cluster", "size", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_no")), "pack-items")
    blocks = max(1, -(-items.where("size > 0").count() // block))
    keyed = items.withColumn("key", F.xxhash64("doc_id", "source", "cluster", "_no"))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1)
    pieces = keyed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.withColumn("doc_start", F.col("piece") * capacity).withColumn("n_tokens", F.least(F.lit(capacity), F.col("size") - F.col("doc_start")))
    own = ["doc_id", "source", "cluster", "piece", "doc_start", "n_tokens"]
    alone = pieces.where((F.col("n_tokens") == capacity) | (F.col("n_tokens") == 0))
    # a full bin is named by all that tells its piece from others; a null id, source or cluster by an empty field
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "cluster", "size", "_no", "piece", "source")]
    alone = alone.select(*own, F.when(F.col("n_tokens") > 0, F.concat(F.lit("full-"), F.concat_ws("-", *told), F.when(F.col("source").isNull(), "?").otherwise("-"))).alias("bin_id"), F.lit(0).cast("long").alias("bin_start"))
    open_ = pieces.where((F.col("n_tokens") < capacity) & (F.col("n_tokens") > 0)).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)))
    given = open_.select(*own, "key", "block", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("bin_start"))
    placed = given.groupBy("block").applyInPandas(_pack_block(capacity), given.schema)
    placed = placed.select(*own, F.concat(F.col("block").cast("string"), F.lit("-"), F.col("bin").cast("string")).alias("bin_id"), "bin_start")
    return placed.unionByName(alone)


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """Pieces of all documents; exact copies, letter case aside, are a duplicate cluster."""
    cluster = F.xxhash64(F.lower(F.coalesce(F.col("text"), F.lit(""))))
    return packed(docs.select("doc_id", "source", cluster.alias("cluster"), word_count(F.col("text")).alias("size")), **how)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
