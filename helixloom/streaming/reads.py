"""Reads as streams: mates paired under a watermark, histograms kept while reads pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixloom.functions import scoring
from helixloom.operators import histograms


def pair_stream(reads: DataFrame, time: str, within: str = "10 minutes", key: str = "qname") -> DataFrame:
    """Templates (key, m1, m2) of a stream of reads, by a join of its two mates.

    Mates that lie further apart in time than ``within`` are not paired, which bounds the state that waits for them."""
    row = F.struct(*reads.columns)
    side = lambda n: reads.where(scoring.mate_no(F.col("flag")) == n).select(F.col(key).alias(f"k{n}"), F.col(time).alias(f"t{n}"), row.alias(f"m{n}")).withWatermark(f"t{n}", within)
    gap = F.expr(f"t2 BETWEEN t1 - INTERVAL {within} AND t1 + INTERVAL {within}")
    return side(1).join(side(2), (F.col("k1") == F.col("k2")) & gap).select(F.col("k1").alias("key"), "m1", "m2")


def running_histogram(reads: DataFrame, **how) -> DataFrame:
    """The 3-D histogram over all reads so far; state is one row a cell. For output mode complete or update."""
    return histograms.hist3d(reads, **how)


def windowed_counts(reads: DataFrame, time: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, fate, count) in event time; rows later than ``late`` are left out once their window is closed."""
    fate = F.when(F.col("d_err") == 202, "unmapped").when(F.col("d_err") == 201, "wrong_chrom").when(F.col("d_err") == 0, "correct").otherwise("shifted")
    return reads.withWatermark(time, late).groupBy(F.window(time, width), fate.alias("fate")).agg(F.count("*").alias("count"))


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what its source has now, into an in-memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
