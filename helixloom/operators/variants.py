"""Variant tables: regions, usable variants, copies, genotypes, complexity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.functions import seq
from helixloom.functions import variants as va
from helixloom.operators.intervals import next_stop, overlapping

VARIANT = ["chrom", "pos", "ref", "alts", "gt"]


def in_regions(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Each variant once for every region (region_idx, chrom, start, stop) that it overlaps, with region_idx."""
    spans = variants.withColumns({"start": F.col("pos") - 1, "stop": F.col("pos") - 1 + F.length("ref")})
    return overlapping(spans, regions).drop("start", "stop")


def present(variants: DataFrame) -> DataFrame:
    """Variants that the sample carries."""
    return variants.where(F.exists("gt", lambda g: F.coalesce(g > 0, F.lit(False))))


def statically_usable(variants: DataFrame) -> Column:
    """Neither complex, symbolic nor a breakend."""
    complex_ = (F.length("ref") > 1) & F.exists("alts", lambda a: F.length(a) > 1)
    symbolic = F.exists("alts", lambda a: a.startswith("<"))
    breakend = F.coalesce(F.col("info")["SVTYPE"] == "BND", F.lit(False)) if "info" in variants.columns else F.lit(False)
    return ~(complex_ | symbolic | breakend)


def drop_overlaps(variants: DataFrame, *groups: str, order: str = "ordinal") -> DataFrame:
    """Greedy choice in position order within each group: a variant goes if, on any copy that carries it, it starts no later than
    the last accepted one ends or repeats it; what goes leaves no trace.

    Whether variants can touch at all is a running maximum, which parts a group into islands; only islands, a few variants each,
    are folded in order. A substitution starts at its base, others at the base after. ``order`` breaks ties of position."""
    start, last = F.col("pos") - 1, F.col("pos") + F.length("ref") - 2
    w = W.partitionBy(*groups).orderBy("pos", order)
    before = F.max(last).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(start > F.coalesce(before, F.lit(0)), 1).otherwise(0)
    marked = variants.withColumns({"_start": start, "_last": last}).withColumn("_island", F.sum(opens).over(w))
    # the first island of a group also holds what starts at the very first base, which is never accepted
    row = F.struct(F.col("pos").alias("_pos"), F.col(order).alias("_order"), *[F.col(c) for c in dict.fromkeys(["ref", "alts", "gt", "_start", "_last", *variants.columns])])
    islands = marked.groupBy(*groups, "_island").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when((a["_pos"] < b["_pos"]) | ((a["_pos"] == b["_pos"]) & (a["_order"] < b["_order"])), -1).when((a["_pos"] == b["_pos"]) & (a["_order"] == b["_order"]), 0).otherwise(1)).alias("_v"))
    ploidy = F.array_max(F.transform("_v", lambda v: F.size(v["gt"])))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), ploidy).alias("end"), F.array_repeat(F.lit(""), ploidy).alias("said"), F.array().cast("array<boolean>").alias("keep"))

    def step(s: Column, v: Column) -> Column:
        carried = F.transform(v["gt"], lambda g: F.coalesce(g > 0, F.lit(False)))
        # the allele that stands at the copy's place
        alt = lambda n: F.when(F.get(v["gt"], n) > 0, F.get(v["alts"], F.get(v["gt"], n) - 1))
        begin = lambda n: v["_start"] + F.when((F.length(v["ref"]) == 1) & (F.length(alt(n)) == 1), 0).otherwise(1)
        name = lambda n: F.concat_ws(".", v["_pos"].cast("string"), v["ref"], alt(n))
        bad = F.exists(F.transform(carried, lambda c, n: c & ((begin(n) <= F.get(s["end"], n)) | (name(n) == F.get(s["said"], n)))), lambda x: F.coalesce(x, F.lit(False)))
        takes = lambda n: ~bad & F.coalesce(F.get(carried, n), F.lit(False))
        return F.struct(
            F.transform(s["end"], lambda e, n: F.when(takes(n), v["_last"]).otherwise(e)).alias("end"),
            F.transform(s["said"], lambda e, n: F.when(takes(n), name(n)).otherwise(e)).alias("said"),
            F.array_append(s["keep"], ~bad).alias("keep"),
        )

    kept = F.zip_with("_v", F.aggregate("_v", zero, step, lambda s: s["keep"]), lambda v, k: F.when(k, v))
    out = islands.select(F.explode(F.filter(kept, lambda v: v.isNotNull())).alias("_r"))
    return out.select(*[F.col(f"_r.{c}").alias(c) for c in variants.columns])


def usable(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Variants of a sample in regions that a simulation can use; overlap starts afresh in every region."""
    found = present(in_regions(variants, regions))
    return drop_overlaps(found.where(statically_usable(found)), "region_idx")


def contig_placeholders(variants: DataFrame, kept: DataFrame) -> DataFrame:
    """The first variant of each contig that kept none, with genotype 0/0, so that its ploidy stays known."""
    first = variants.groupBy("chrom").agg(F.min_by(F.struct(*variants.columns), "pos").alias("_r")).select("_r.*")
    return first.join(kept.select("chrom").distinct(), "chrom", "left_anti").withColumn("gt", F.transform("gt", lambda g: F.lit(0)))


def ploidy(variants: DataFrame, default: int = 2) -> DataFrame:
    """(chrom, ploidy) by the first variant of the contig."""
    return variants.groupBy("chrom").agg(F.coalesce(F.min_by(F.size("gt"), "pos"), F.lit(default)).alias("ploidy"))


def split_copies(variants: DataFrame) -> DataFrame:
    """(region_idx, cpy, chrom, pos, ordinal, ref, alt, op, n) of what each copy carries; complex variants are errors."""
    each = variants.select("region_idx", "chrom", "pos", "ordinal", "ref", "alts", F.posexplode("gt").alias("cpy", "g")).where("g > 0")
    alt = F.get(F.col("alts"), F.col("g") - 1)
    return each.withColumn("alt", alt).withColumn("c", va.classify(F.col("ref"), F.col("alt"))).select("region_idx", "cpy", "chrom", "pos", "ordinal", "ref", "alt", "c.op", "c.n")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of keys, the same on any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def assign_genotypes(variants: DataFrame, seed: int, default_af: float = 0.1) -> DataFrame:
    """Variants without genotype, each with one drawn by its allele frequency (``af``, the first value); the second at a position has 0|0."""
    open_ = variants.where("gt IS NULL") if "gt" in variants.columns else variants
    af = F.coalesce("af", F.lit(default_af)) if "af" in variants.columns else F.lit(default_af)
    p = va.genotype_shares(af)
    u = uniform(seed, F.col("chrom"), F.col("pos"), F.col("ordinal"))
    c1, c2, c3 = F.get(p, F.lit(0)), F.get(p, F.lit(0)) + F.get(p, F.lit(1)), F.get(p, F.lit(0)) + F.get(p, F.lit(1)) + F.get(p, F.lit(2))
    drawn = F.when(u < c1, F.array(F.lit(0), F.lit(0))).when(u < c2, F.array(F.lit(0), F.lit(1))).when(u < c3, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(1)))
    w = W.partitionBy("chrom").orderBy("ordinal")
    again = F.coalesce(F.lag("pos").over(w) == F.col("pos"), F.lit(False))
    return open_.withColumn("gt", F.when(again, F.array(F.lit(0), F.lit(0))).otherwise(drawn))


#: Complexity measures: name to a function of the window's sequence. ``measure`` registers more.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "SE1": lambda s: seq.shannon_entropy(s, 1),
    "SE2": lambda s: seq.shannon_entropy(s, 2),
    "SE4": lambda s: seq.shannon_entropy_folded(s, 4),
    "LC": seq.linguistic_complexity,
}


def measure(name: str):
    """Registers a complexity measure."""

    def register(f: Callable[[Column], Column]):
        MEASURES[name] = f
        return f

    return register


def window_sequence(variants: DataFrame, reference: DataFrame, width: int = 100) -> DataFrame:
    """Adds ``window``: the reference from half a width before to half a width after the variant, in capitals.

    ``reference``: chunks (chrom, chunk, start, seq) that overlap their successor by at least the width plus the longest ref, so one
    equi-join on the chunk number finds the whole window."""
    low = F.greatest(F.lit(0), F.col("pos") - 1 - width // 2)
    chunk = reference.select("chrom", F.col("chunk").alias("_chunk"), F.col("start").alias("_s"), F.col("seq").alias("_seq"), "step")
    step = reference.select("step").first()
    size = step["step"] if step else 1
    joined = variants.withColumn("_low", low).withColumn("_chunk", F.floor(F.col("_low") / size)).join(chunk, ["chrom", "_chunk"], "left")
    stop = F.col("pos") - 1 + F.length("ref") + width // 2
    return joined.withColumn("window", F.upper(F.substring("_seq", F.col("_low") - F.col("_s") + 1, (stop - F.col("_low")).cast("int")))).drop("_low", "_chunk", "_s", "_seq", "step")


def annotate_complexity(variants: DataFrame, reference: DataFrame, width: int = 100, measures: tuple[str, ...] = ("SE1", "SE2", "SE4", "LC"), mappability: DataFrame | None = None) -> DataFrame:
    """Adds a column for each measure, and MAP where a mappability track is given."""
    out = window_sequence(variants, reference, width).withColumns({m: MEASURES[m](F.col("window")) for m in measures}).drop("window")
    return out if mappability is None else next_stop(out, mappability, "MAP")
