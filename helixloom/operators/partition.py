"""Venn partitions of reads over several alignment sets, by pluggable criteria."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import scoring
from helixloom.functions.variants import membership_label
from helixloom.operators.reads import primary, with_truth

MOST_SETS = 8
#: Criterion name to a function (threshold) -> Column over a read with d_err, d_err_strict, mq, flag.
CRITERIA: dict[str, Callable[[float], Column]] = {
    "d_err": lambda x: F.abs("d_err") < x,
    "d_err_strict": lambda x: F.abs("d_err_strict") < x,
    "MQ": lambda x: F.col("mq") < x,
    "mapped": lambda x: ~scoring.is_unmapped(F.col("flag")),
}


def criterion(name: str):
    """Registers a criterion: a function of a threshold to a Column."""

    def register(f: Callable[[float], Column]):
        CRITERIA[name] = f
        return f

    return register


def stack(sets: list[DataFrame]) -> DataFrame:
    """All sets in one table, ``src`` the number of the set."""
    if not 1 <= len(sets) <= MOST_SETS:
        raise ValueError(f"1 to {MOST_SETS} sets, not {len(sets)}")
    out = sets[0].withColumn("src", F.lit(0))
    for k, df in enumerate(sets[1:], 1):
        out = out.unionByName(df.withColumn("src", F.lit(k)))
    return out


def venn(members: DataFrame, n: int, inside: Column) -> DataFrame:
    """(key, code) of keys that all n sets have; the first set is the highest bit. ``members``: (key, src, ...), one shuffle."""
    bit = F.when(inside, F.shiftleft(F.lit(1), 0)).otherwise(0) * F.pow(F.lit(2), n - 1 - F.col("src")).cast("int")
    one = members.groupBy("key").agg(F.sum(bit).cast("int").alias("code"), F.count_distinct("src").alias("_n") if n > 1 else F.lit(1).alias("_n"))
    return one.where(F.col("_n") == n).drop("_n")


def cells(coded: DataFrame, n: int) -> DataFrame:
    """(code, label, count) of all 2^n cells."""
    counts = coded.groupBy("code").agg(F.count("*").alias("count"))
    every = coded.sparkSession.range(1 << n).select(F.col("id").cast("int").alias("code"))
    return every.join(counts, "code", "left").select("code", membership_label(F.col("code"), n).alias("label"), F.coalesce("count", F.lit(0)).alias("count"))


def partition_sets(sets: list[DataFrame], name: str, threshold: float = 0, sidecar: DataFrame | None = None, legacy: bool = False) -> DataFrame:
    """(key, code) of reads present in all sets, by a criterion; p_diff measures the distance to the first set's alignment.

    ``legacy`` takes the first set's 0-based position for a 1-based one, which shifts every distance by one."""
    reads = stack([primary(df) for df in sets])
    key = F.concat(scoring.mate_no(F.col("flag")).cast("string"), F.col("qname"))
    reads = reads.withColumn("key", key)
    if name == "p_diff":
        gold = reads.where("src = 0").where(~scoring.is_unmapped(F.col("flag")))
        gold = gold.select("key", F.struct("chrom", (F.col("pos") + (0 if legacy else 1)).alias("pos"), "cigar", F.lit(None).cast("string").alias("special_cigar")).alias("truth"))
        return venn(scoring.score(reads.join(gold, "key")), len(sets), F.abs("d_err") < threshold)
    if name in ("d_err", "d_err_strict"):
        reads = scoring.score(with_truth(reads, sidecar), strict=name == "d_err_strict")
        reads = reads.withColumnRenamed("d_err", name)
    return venn(reads, len(sets), CRITERIA[name](threshold))
