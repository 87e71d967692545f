"""Nodes, reads and variant choice against hand-computed values and plain folds."""

import random

import pytest
from helixloom.operators import haplotypes as hp
from helixloom.operators import intervals, variants
from pyspark.sql import functions as F

REF = "ATGACGTATCCAAGGAGGCGTTACC"
TINY = [(5, "C", ["T"], [0, 1]), (8, "A", ["ATTT"], [0, 1]), (11, "CAA", ["C"], [0, 1]), (14, "G", ["T"], [1, 0]), (20, "GTTAC", ["G"], [1, 1])]


def variant_table(spark, rows):
    return spark.createDataFrame([(k, "1", *r) for k, r in enumerate(rows)], "ordinal long, chrom string, pos long, ref string, alts array<string>, gt array<int>")


def tiny_nodes(spark, rows, cpy):
    region = spark.createDataFrame([(0, "1", 1, REF, 2)], "region_idx int, chrom string, start long, seq string, ploidy int")
    v = variant_table(spark, rows).withColumn("region_idx", F.lit(0))
    return hp.haplotypes(region, variants.split_copies(v)).where(F.col("cpy") == cpy)


def test_nodes(spark):
    got = [(n.ps, n.pr, n.op, n.n, n.seq, n.v) for n in tiny_nodes(spark, TINY, 1).first().nodes]
    assert got == [(1, 1, "=", 4, "ATGA", None), (5, 5, "X", 1, "T", 0), (6, 6, "=", 3, "GTA", None), (9, 9, "I", 3, "TTT", 3), (12, 9, "=", 3, "TCC", None), (14, 14, "D", 2, "", -2), (15, 14, "=", 7, "GGAGGCG", None), (21, 25, "D", 4, "", -4), (22, 25, "=", 1, "C", None)]


def test_asof_nodes(spark):
    df = tiny_nodes(spark, TINY, 1).select(hp.node_starts(F.col("nodes")).alias("s"))
    at = lambda off: [df.select(intervals.last_at_or_before(F.col("s"), F.lit(p + off))).first()[0] for p in range(1, 16)]
    assert at(0) == [0, 0, 0, 0, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 6]
    assert at(9) == [3, 3, 4, 4, 4, 6, 6, 6, 6, 6, 6, 6, 8, 8, 8]


@pytest.mark.parametrize(
    ("rows", "cpy", "p", "n", "want"),
    [
        (TINY, 1, 1, 10, (1, "4=1X3=2I", [0, 3], "ATGATGTATT")), (TINY, 1, 9, 10, (9, "3I3=2D4=", [3, -2], "TTTTCCGGAG")), (TINY, 1, 15, 8, (14, "7=4D1=", [-4], "GGAGGCGC")),
        (TINY, 0, 5, 10, (5, "9=1X", [0], "CGTATCCAAT")), (TINY, 1, 9, 2, (9, ">0+2I", [3], "TT")),
        ([(5, "CGT", ["C"], [0, 1]), (8, "A", ["T"], [0, 1])], 1, 1, 10, (1, "5=2D1X4=", [-2, 0], "ATGACTTCCA")),
        ([(5, "C", ["T"], [0, 1]), (5, "C", ["CTTT"], [0, 1])], 1, 1, 10, (1, "4=1X3I2=", [0, 3], "ATGATTTTGT")),
    ],
)
def test_reads(spark, rows, cpy, p, n, want):
    got = tiny_nodes(spark, rows, cpy).select(hp.read_from(F.col("nodes"), F.lit(p).cast("long"), F.lit(n)).alias("r")).first().r
    assert (got.pos, got.cigar, got.v_list, got.seq) == want


def test_regions(spark):
    regions = spark.createDataFrame([(0, "1", 8, 14), (1, "1", 0, 23), (2, "2", 0, 9)], "region_idx int, chrom string, start long, stop long")
    got = sorted((r.region_idx, r.pos) for r in variants.in_regions(variant_table(spark, TINY), regions).collect())
    assert got == [(0, 11), (0, 14), (1, 5), (1, 8), (1, 11), (1, 14), (1, 20)]


def plain_choice(rows):
    end, said, keep = [0, 0], [None, None], []
    for k, (pos, ref, alts, gt) in enumerate(rows):
        own = [(n, alts[g - 1]) for n, g in enumerate(gt) if g]
        if any((pos - 1 + (0 if len(ref) == len(a) == 1 else 1)) <= end[n] or said[n] == (pos, ref, a) for n, a in own):
            continue
        keep.append(k)
        for n, a in own:
            end[n], said[n] = pos + len(ref) - 2, (pos, ref, a)
    return keep


def test_greedy_choice(spark):
    rng = random.Random(6)
    for size in (1, 5, 300):
        rows = []
        for pos in sorted(rng.randint(1, size * 3) for _ in range(size)):
            ref, alt = rng.choice([("A", "C"), ("A", "ACC"), ("AGGT", "A"), ("A", "ACC")])
            rows.append((pos, ref, [alt], rng.choice([[0, 1], [1, 0], [1, 1]])))
        df = variant_table(spark, rows).withColumn("region_idx", F.lit(0))
        assert sorted(r.ordinal for r in variants.drop_overlaps(df, "region_idx").collect()) == plain_choice(rows)


def test_usable_placeholder_genotypes(spark):
    rows = [(5, "CGT", ["CTT"], [0, 1]), (9, "A", ["<DEL>"], [0, 1]), (12, "A", ["T"], [0, 0]), (15, "A", ["T"], [1, 0])]
    df = variant_table(spark, rows)
    regions = spark.createDataFrame([(0, "1", 0, 13)], "region_idx int, chrom string, start long, stop long")
    kept = variants.usable(df, regions)
    assert kept.count() == 0
    assert [(r.pos, r.gt) for r in variants.contig_placeholders(df, kept).collect()] == [(5, [0, 0])]
    assert variants.ploidy(df).first().ploidy == 2
    many = spark.range(4000).select(F.lit("1").alias("chrom"), (F.col("id") + 1).alias("pos"), F.col("id").alias("ordinal"), F.lit(0.3).alias("af"))
    shares = {tuple(r.gt): r["count"] / 4000 for r in variants.assign_genotypes(many, 5).groupBy("gt").count().collect()}
    assert abs(shares[(1, 1)] - 0.09) < 0.02 and abs(shares[(0, 1)] - 0.15) < 0.02 and abs(shares[(0, 0)] - 0.61) < 0.03
    twice = spark.createDataFrame([("1", 7, 0, 1.0), ("1", 7, 1, 1.0)], "chrom string, pos long, ordinal long, af double")
    assert [r.gt for r in variants.assign_genotypes(twice, 5).orderBy("ordinal").collect()][1] == [0, 0]


def test_asof(spark):
    track = spark.createDataFrame([("1", 10, 0.1), ("1", 20, 0.2)], "chrom string, stop long, value double")
    df = spark.createDataFrame([("1", 5), ("1", 10), ("1", 11), ("1", 21), ("2", 5)], "chrom string, pos long")
    got = sorted((r.chrom, r.pos, r.MAP) for r in intervals.next_stop(df, track, "MAP").collect())
    assert got == [("1", 5, 0.1), ("1", 10, 0.1), ("1", 11, 0.2), ("1", 21, None), ("2", 5, None)]
