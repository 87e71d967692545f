"""Mixing sources to target weights by the cube method.

A source of weight w gets a target share of words; a document of a source that is to be taken m times on average is taken
floor(m) times for sure and once more with probability m - floor(m). The cube method draws these: probabilities move along the
null-space of the balancing constraints (number of documents, number of words) until they hit 0 or 1. With two constraints
three undecided documents span one direction, (x3-x2, x1-x3, x2-x1) for sizes x, so a flight keeps three at a time. Flights run
in blocks of bounded size within a source, so a hot source is many blocks; the two documents at most that a block leaves go on
to blocks of the next level, until one block of a source remains. Its landing tries all outcomes and takes the one nearest to
the target in words, then in documents.

Draws depend on ids, sizes and the seed alone: reruns agree on any partitioning. Defined results: null text has size 0; the
null source is a source of its own, last in order; rows of size 0 are drawn like others and change no words; repeated rows are
drawn one by one; sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.llm.common import discard, materialize, table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST, SEED, BLOCK = 1.5, 2.0, 7, 2000
EDGE = 1e-9


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all 0 or 1 but for two at most, sums of p and of p*x kept."""
    p, x = p.tolist(), x.tolist()
    draws = rng.random(len(p) + 1).tolist()
    active: list[int] = []
    todo = iter([i for i, v in enumerate(p) if EDGE < v < 1 - EDGE])
    while True:
        while len(active) < 3 and (i := next(todo, None)) is not None:
            active.append(i)
        if len(active) < 3:
            break
        a, b, c = active
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        scale = max(map(abs, u))
        u = tuple(v / scale for v in u) if scale else (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(active, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(active, u, strict=True) if v)
        step = up if draws.pop() * (up + down) < down else -down
        for i, v in zip(active, u, strict=True):
            p[i] += step * v
        active = [i for i in active if EDGE < p[i] < 1 - EDGE]
    return np.array([0.0 if v <= EDGE else 1.0 if v >= 1 - EDGE else v for v in p])


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Settles the few open probabilities: the outcome nearest in words, then in documents, then the fewest taken."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    words, docs = float((p * x)[open_].sum()), float(p[open_].sum())
    outcomes = [[m >> k & 1 for k in range(len(open_))] for m in range(1 << len(open_))]
    best = min(outcomes, key=lambda o: (round(abs(float(np.dot(o, x[open_])) - words), 6), round(abs(sum(o) - docs), 6), sum(o), o))
    p = p.copy()
    p[open_] = best
    return p


def _block_flight(group: pd.DataFrame) -> pd.DataFrame:
    """One block of one source: large documents first, so that small ones are left over."""
    group = group.sort_values(["size", "key"], ascending=[False, True], kind="stable")
    first = group.iloc[0]
    rng = np.random.default_rng([abs(int(first["draw_seed"])), int(first["block"]), int(first["level"])])
    x = group["size"].to_numpy(float)
    p = flight(group["p"].to_numpy(float), x, rng)
    group["p"] = landing(p, x) if first["blocks"] <= 1 else p
    return group


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes dealt by weight, none above ``most`` times its source, excess dealt again.

    Each round is one aggregate over the sources, which gives two numbers to the driver."""
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, capped = 0.0, F.lit(False)
    while True:
        open_ = sources.agg(F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("weight"))).alias("w"), F.sum(F.when(capped, most * F.col("source_size")).otherwise(F.lit(0.0))).alias("s"), F.sum(capped.cast("long")).alias("n")).first()
        if not open_["w"]:
            break
        level = max(0.0, share * total - open_["s"]) / open_["w"]
        now = F.col("weight") * level > most * F.col("source_size")
        if sources.where(now | capped).count() == (open_["n"] or 0):
            break
        capped = now
    return sources.withColumn("target", F.when(capped, most * F.col("source_size")).otherwise(F.col("weight") * level).cast("double"))


def source_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight``: the weights repeat over the sources in code-point order, null last. One row a source."""
    order = W.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn))


def targets(items: DataFrame, *, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, n, target) of every source of ``items`` (source, size); written."""
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    known, path = materialize(source_weights(sizes, weights), "mix-weights")
    out, _ = materialize(water_fill(known, share, most).drop("weight"), "mix-targets")
    discard(items.sparkSession, path)
    return out


def mix(items: DataFrame, *, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED, block=BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of ``items`` (doc_id, source, size).

    ``copies`` is how often the mix takes the row. Narrow rows alone are shuffled, once for each level of blocks."""
    spark = items.sparkSession
    items, items_path = materialize(items.select("doc_id", "source", F.col("size").cast("long").alias("size")), "mix-items")
    by_source = targets(items, weights=weights, share=share, most=most)
    joined = items.join(by_source, items["source"].eqNullSafe(by_source["source"])).drop(by_source["source"])
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    start = (
        joined.withColumn("ratio", ratio)
        .withColumn("sure", F.floor("ratio"))
        .withColumns({"p": F.col("ratio") - F.col("sure"), "key": F.xxhash64("doc_id", "size", F.lit(seed)), "draw_seed": F.xxhash64("source", F.lit(seed)), "blocks": F.ceil(F.col("n") / block), "level": F.lit(0)})
        .drop("ratio", "n")
    )
    done, paths, level = [], [items_path], 0
    while True:
        dealt = start.withColumns({"block": F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")), "level": F.lit(level)})
        flown = dealt.groupBy("source", "block").applyInPandas(_block_flight, dealt.schema)
        flown, path = materialize(flown, f"mix-level{level}")
        done.append(flown.where((F.col("p") == 0) | (F.col("p") == 1)))
        left = flown.where((F.col("p") > 0) & (F.col("p") < 1))
        if left.isEmpty():
            break
        level += 1
        start = left.drop("block").withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    discard(spark, *paths)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("sure") + F.col("p")).cast("long").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Decisions return to the texts by (id, source, size), in one shuffle; rows that share all three share out what they got together."""
    key = F.xxhash64(F.coalesce(F.col("_doc").cast("string"), F.lit("")), F.col("_doc").isNull(), F.coalesce("_source", F.lit("")), F.col("_source").isNull()).alias("_k")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"))
    taken = mix(packed.select(F.col("_doc").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size")), **how)
    plan = taken.select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies").select(key, "_size", "copies")
    plan = plan.groupBy("_k", "_size").agg(F.count("*").alias("_rows"), F.sum("copies").alias("_copies"))
    # rows that share all three are told apart by their text, so that a task computed again gives the same rows
    wide = packed.select("_row", key, "_size", F.xxhash64("_row.text").alias("_h")).withColumn("_n", F.row_number().over(W.partitionBy("_k", "_size").orderBy("_h", "_row.text"))).drop("_h")
    copies = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_n") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    each = wide.join(plan, ["_k", "_size"]).select("_row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_copy"))
    return each.select("_row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    out = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
