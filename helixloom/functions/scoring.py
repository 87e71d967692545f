"""Alignment scores against the truth. ``d_err`` runs from -max_d to max_d; max_d+1 means wrong contig, max_d+2 unmapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import cigar as cg

MAX_D = 200


def is_unmapped(flag: Column) -> Column:
    return flag.bitwiseAND(4) != 0


def is_primary(flag: Column) -> Column:
    return flag.bitwiseAND(0x900) == 0


def mate_no(flag: Column) -> Column:
    """1 or 2; single reads are 1."""
    return F.when(flag.bitwiseAND(128) != 0, 2).otherwise(1)


def d_err(truth: Column, flag: Column, chrom: Column, pos: Column, cigar: Column, max_d: int = MAX_D, strict: bool = False) -> Column:
    """``truth.pos`` is 1-based, ``pos`` 0-based. Only where a first operation is no match are CIGARs expanded."""
    plain = pos - (truth.pos - 1)
    if strict:
        shift = plain
    else:
        common = cg.common_base(cg.match_blocks(truth.pos - 1, truth.cigar), cg.match_blocks(pos, cigar))
        shift = F.when(truth.special_cigar.isNotNull() | cg.is_simple(truth.cigar, cigar), plain).otherwise(F.coalesce(common.b - common.a, plain))
    held = F.greatest(F.lit(-max_d), F.least(F.lit(max_d), shift))
    return F.when(is_unmapped(flag), max_d + 2).when(~chrom.eqNullSafe(truth.chrom), max_d + 1).otherwise(held).cast("int")


def correct_tlen(a: Column, b: Column) -> Column:
    """Template length that two truths imply; 0 if either has no base on the reference."""
    x, y = cg.match_blocks(a.pos, a.cigar), cg.match_blocks(b.pos, b.cigar)
    first = lambda blocks: F.get(blocks, F.lit(0)).r
    length = F.when(first(x) < first(y), cg.reference_end(y) - first(x) + 1).otherwise(first(y) - cg.reference_end(x) - 1)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), length).otherwise(0).cast("long")


def score(reads: DataFrame, max_d: int = MAX_D, strict: bool = False) -> DataFrame:
    """Adds ``d_err`` to reads with ``truth``."""
    return reads.withColumn("d_err", d_err(F.col("truth"), F.col("flag"), F.col("chrom"), F.col("pos"), F.col("cigar"), max_d, strict))


def tag(reads: DataFrame, max_d: int = MAX_D, strict: bool = False) -> DataFrame:
    """Adds Xd, XR, XP, XM and, for reads with variants, XV to ``tags``."""
    t = F.col("truth")
    values = {"Xd": F.col("d_err").cast("string"), "XR": t.chrom, "XP": t.pos.cast("string"), "XM": t.cigar, "XV": F.when(F.size(t.v_list) > 0, F.array_join(t.v_list.cast("array<string>"), ","))}
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])
    new = F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))
    kept = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return score(reads, max_d, strict).withColumn("tags", F.map_concat(kept, new))
