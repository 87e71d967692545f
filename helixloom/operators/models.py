"""Empirical models: base qualities, template lengths, GC and coverage, and synthetic sequencers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.functions import cigar as cg
from helixloom.functions import scoring, seq
from helixloom.operators.intervals import overlapping
from helixloom.operators.reads import plain_flags
from helixloom.sources.text import qualities

MOST_BQ = 94


def bq_counts(reads: DataFrame, *by: str) -> DataFrame:
    """(by..., base, bq, count) of ``bq`` arrays in sequencing order; one explode, summed before the shuffle."""
    return reads.select(*by, F.posexplode("bq").alias("base", "bq")).groupBy(*by, "base", "bq").agg(F.count("*").alias("count"))


def in_sequencing_order(reads: DataFrame) -> DataFrame:
    """Adds ``mate`` and ``bq``: qualities as sequenced, reversed where the read lies reversed."""
    q = qualities(F.col("qual"))
    return reads.withColumns({"mate": scoring.mate_no(F.col("flag")), "bq": F.when(F.col("flag").bitwiseAND(16) != 0, F.reverse(q)).otherwise(q)})


def sampled(reads: DataFrame, every: int, min_mq: int) -> DataFrame:
    """Every n-th plain read of a contig by position, of known quality and good mapping."""
    w = W.partitionBy("chrom").orderBy("pos", "qname", "flag")
    nth = plain_flags(reads).withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % every == 0).drop("_n")
    return nth.where((F.col("mq") >= min_mq) & (F.col("mq") != 255))


def template_lengths(reads: DataFrame, most: int) -> DataFrame:
    """(tlen, count) by second mates whose template is at least 0.95 read lengths and below ``most``."""
    t = F.abs("tlen")
    second = reads.where((F.col("flag").bitwiseAND(128) != 0) & (t >= 0.95 * F.length("seq")) & (t < most))
    return second.groupBy(t.alias("tlen")).agg(F.count("*").alias("count"))


def length_stats(reads: DataFrame) -> DataFrame:
    n = F.length("seq")
    return reads.agg(F.min(n).alias("min_rlen"), F.max(n).alias("max_rlen"), F.avg(n).alias("mean_rlen"), F.count("*").alias("r_cnt"))


def first_contigs(reads: DataFrame, contigs: DataFrame, n: int = 24) -> DataFrame:
    """Reads of the first contigs in header order."""
    return reads.join(contigs.where((F.col("idx") >= 0) & (F.col("idx") < n)).select("chrom"), "chrom", "left_semi")


def cumulative(counts: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds ``cdf``: the running share of counts by value."""
    w = W.partitionBy(*by).orderBy(value)
    total = F.greatest(F.lit(1), F.sum("count").over(W.partitionBy(*by)))
    return counts.withColumn("cdf", F.sum("count").over(w.rowsBetween(W.unboundedPreceding, 0)) / total)


def mean_bq(counts: DataFrame, *by: str) -> DataFrame:
    """(by..., base, mean_bq): mean quality by base, over the reads that have a first base."""
    sums = counts.groupBy(*by, "base").agg(F.sum(F.col("bq") * F.col("count")).alias("_s"), F.sum("count").alias("_c"))
    first = F.max(F.when(F.col("base") == 0, F.col("_c"))).over(W.partitionBy(*by))  # one row a base
    return sums.select(*by, "base", (F.col("_s") / F.greatest(F.lit(1), first)).alias("mean_bq"))


def name_lengths(names: DataFrame, most: int) -> DataFrame:
    """(length, count) of ``name_length``, longer ones at ``most``."""
    return names.groupBy(F.least("name_length", F.lit(most)).alias("length")).agg(F.count("*").alias("count"))


def gc_and_coverage(reads: DataFrame, lines: DataFrame, block: int) -> DataFrame:
    """(chrom, block_start, gc, coverage) by blocks r .. r+block inclusive; coverage over positions that reads cover.

    ``lines``: reference lines (chrom, start, seq). Match blocks of reads meet reference blocks by bins; a block's covered positions are
    a running sum over block starts and ends, so bases are not expanded."""
    from helixloom.sources.text import contig_lengths, region_sequences

    n = contig_lengths(lines)
    starts = n.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(block).cast("long"))).alias("start"), "length")
    blocks = starts.select((F.xxhash64("chrom", "start")).alias("region_idx"), "chrom", "start", F.least(F.col("start") + block + 1, F.col("length")).alias("stop"))
    gc = region_sequences(lines, blocks).select("region_idx", "chrom", F.col("start").alias("block_start"), "stop", seq.gc_fraction(F.col("seq")).alias("gc"))
    good = scoring.is_primary(F.col("flag")) & ~scoring.is_unmapped(F.col("flag"))
    spans = reads.where(good).select("chrom", F.explode(cg.match_blocks(F.col("pos"), F.col("cigar"))).alias("b")).select("chrom", F.col("b.r").alias("start"), (F.col("b.r") + F.col("b.e") - F.col("b.q")).alias("stop"))
    hits = overlapping(spans, blocks).join(blocks.select("region_idx", F.col("start").alias("_lo"), F.col("stop").alias("_hi")), "region_idx")
    cut = hits.select("region_idx", F.greatest("start", "_lo").alias("a"), F.least("stop", "_hi").alias("b"))
    steps = cut.select("region_idx", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("s"))
    change = steps.groupBy("region_idx", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    w = W.partitionBy("region_idx").orderBy("at")
    depth = change.withColumns({"depth": F.sum("d").over(w), "next": F.lead("at").over(w)}).where("depth > 0")
    cover = depth.groupBy("region_idx").agg((F.sum(F.col("depth") * (F.col("next") - F.col("at"))) / F.sum(F.col("next") - F.col("at"))).alias("coverage"))
    return gc.join(cover, "region_idx", "left").select("chrom", "block_start", "gc", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


# ---- models --------------------------------------------------------------------------------------------------------------


@dataclass
class ReadModel:
    """A sequencer: cumulative qualities by mate and base, cumulative template lengths, read length."""

    cum_bq: list[list[list[float]]]
    cum_tlen: list[float]
    rlen: int
    name: str = "model"
    kind: str = "illumina"
    extra: dict = field(default_factory=dict)


def synthetic_rows(spark: SparkSession, rlen: int, bq0: float, k: float, sigma: float) -> DataFrame:
    """(mate, base, bq, p): normalised gaussian rows around bq0 * (1 - exp(-k x^2)), x from 1 at the first base to 0."""
    x = 1 - F.col("id") / F.lit(float(max(1, rlen - 1)))
    mean = bq0 * (1 - F.exp(-k * x * x))
    rows = spark.range(rlen).select(F.col("id").cast("int").alias("base"), mean.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(MOST_BQ - 1))).alias("bq"))
    weight = F.exp(-0.5 * F.pow((F.col("bq") - F.col("m")) / sigma, 2))
    w = W.partitionBy("base")
    return rows.withColumn("w", weight).select("base", "bq", (F.col("w") / F.sum("w").over(w)).alias("p"))


def create_model(rlen: int = 100, tlen: float = 500, tlen_std: float = 100, max_tlen: int = 1000, bq0: float = 30, k: float = 200, sigma: float = 10, name: str = "synthetic") -> ReadModel:
    """The same on the driver, for simulation: a model has fixed size whatever the data."""

    def cdf(weights: list[float]) -> list[float]:
        total, run, out = sum(weights) or 1.0, 0.0, []
        for v in weights:
            run += v
            out.append(run / total)
        return out

    gauss = lambda n, m, s: [math.exp(-0.5 * ((v - m) / s) ** 2) for v in range(n)]
    rows = [cdf(gauss(MOST_BQ, bq0 * (1 - math.exp(-k * (1 - i / max(1, rlen - 1)) ** 2)), sigma)) for i in range(rlen)]
    return ReadModel([rows, rows], cdf(gauss(max_tlen, tlen, tlen_std)), rlen, name)


def model_from_reads(reads: DataFrame, name: str, every: int = 1, min_mq: int = 0, most_tlen: int = 1000) -> ReadModel:
    """A model of reads: counts in Spark, cumulative rows of fixed size on the driver."""
    used = in_sequencing_order(sampled(reads, every, min_mq)).persist()
    try:
        stats = length_stats(used).first()
        n = int(stats["max_rlen"] or 0)
        rows = [[[0.0] * MOST_BQ for _ in range(n)] for _ in range(2)]
        for r in cumulative(bq_counts(used, "mate"), "bq", "mate", "base").collect():
            if r["bq"] < MOST_BQ:
                rows[r["mate"] - 1][r["base"]][r["bq"]] = r["cdf"]
        lengths = {r["tlen"]: r["cdf"] for r in cumulative(template_lengths(used, most_tlen), "tlen").collect()}
    finally:
        used.unpersist()

    def filled(values: list[float]) -> list[float]:
        top, out = 0.0, []
        for v in values:
            top = max(top, v)
            out.append(top)
        return out

    bq = [[filled(row) for row in mate] for mate in rows]
    return ReadModel(bq, filled([lengths.get(t, 0.0) for t in range(most_tlen)]), n, name, extra={"min_rlen": stats["min_rlen"], "r_cnt": stats["r_cnt"], "mean_rlen": stats["mean_rlen"], "min_mq": min_mq})


def save_model(model: ReadModel, path: str) -> None:
    import json

    with open(path, "w") as f:
        json.dump({"model_class": model.kind, "name": model.name, "rlen": model.rlen, "cum_bq": model.cum_bq, "cum_tlen": model.cum_tlen, "extra": model.extra}, f)


def load_model(path: str, unpaired: bool = False) -> ReadModel:
    """A model by path. JSON alone: files that can run code when opened are not read."""
    import json

    with open(path) as f:
        m = json.load(f)
    return ReadModel(m["cum_bq"], m["cum_tlen"], m["rlen"], m["name"], m["model_class"], m["extra"] | {"unpaired": unpaired})


def list_models(folder: str) -> list[tuple[str, str]]:
    """(file, name) of the models in a folder; other files are passed over."""
    import os

    out = []
    for name in sorted(os.listdir(folder)):
        try:
            out.append((name, load_model(os.path.join(folder, name)).name))
        except (ValueError, KeyError, OSError):
            continue
    return out


def describe(spark: SparkSession, model: ReadModel) -> DataFrame:
    """(what, mate, base, bq, p): the model's cumulative rows as a table for plots."""
    rows = [("bq", m, b, q, float(p)) for m, mate in enumerate(model.cum_bq) for b, row in enumerate(mate) for q, p in enumerate(row)]
    return spark.createDataFrame(rows + [("tlen", None, None, t, float(p)) for t, p in enumerate(model.cum_tlen)], "what string, mate int, base int, bq int, p double")


#: Sequencers by name: a function (model, coverage) to (p, passes). ``sequencer`` registers more.
SEQUENCERS: dict[str, Callable[[ReadModel, float], tuple[float, int]]] = {}


def sequencer(name: str):
    def register(f):
        SEQUENCERS[name] = f
        return f

    return register


def _passes(rate: float) -> tuple[float, int]:
    n = 1
    while rate / n > 0.1:
        n *= 2
    return rate / n, n


@sequencer("illumina")
def illumina(model: ReadModel, coverage: float) -> tuple[float, int]:
    """Chance of a template at a base, for one copy and pass, and passes: doubled until the chance is at most 0.1."""
    return _passes(0.5 * coverage / (2 * model.rlen))


@sequencer("flat")
def flat(model: ReadModel, coverage: float) -> tuple[float, int]:
    """Reads a base, for one copy and pass, and passes."""
    return _passes(0.5 * coverage / model.rlen)


def phred(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)
