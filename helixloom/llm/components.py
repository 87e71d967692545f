"""Connected components of a link table too large for one machine.

Randomised contraction: in every round each node moves to the neighbour (or itself) with the least hash, links follow, and
loops vanish, so that the number of nodes falls by a constant factor. The maps of the rounds are composed backwards. Hubs only
enter minima, which combine before the shuffle. What is left below ``local_links`` links, a fixed bound, is settled in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import discard, materialize

LOCAL_LINKS = 500_000


def settle(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index reachable from each of n nodes over links a-b, by minimum and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _settle_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        ends = np.concatenate([p[0] for p in parts] + [p[1] for p in parts])
        nodes, at = np.unique(ends, return_inverse=True)
        half = len(ends) // 2
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[settle(at[:half], at[half:], len(nodes))])], ["node", "root"])


def connected(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b: long); nodes share a root if and only if links connect them."""
    spark = links.sparkSession
    edges, path = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps, round_no = [], 0
    while (n := edges.count()) > local_links:
        round_no += 1
        order = lambda v: F.struct(F.xxhash64(F.col(v), F.lit(round_no)).alias("h"), F.col(v).alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a")).getField("v").alias("root"))
        moved, moved_path = materialize(moved, "moves")
        maps.append(moved)
        to_a, to_b = moved.select(F.col("node").alias("a"), F.col("root").alias("ra")), moved.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        shifted = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges, new_path = materialize(shifted, "links")
        discard(spark, path)
        path = new_path
    roots = edges.coalesce(1).mapInArrow(_settle_all, "node long, root long") if n else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for moved in reversed(maps):
        last = roots.select(F.col("node").alias("root"), F.col("root").alias("_end"))
        roots = moved.join(last, "root", "left").select("node", F.coalesce("_end", "root").alias("root"))
    return roots
