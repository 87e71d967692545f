"""Column builders against hand-computed values and plain Python versions."""

import itertools
import math
import random
import re

import pytest
from helixloom.functions import bins, cigar, qname, scoring, seq, variants
from pyspark.sql import functions as F


def one(spark, expression, **values):
    return spark.range(1).select(expression.alias("x")).first()[0]


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(("v2", "v1"), [("33=1X79=1X26=1X109=", "250M"), ("1X26=1X123=1X82=1X15=", "250M"), ("89=10D161=", "89M10D161M"), ("99M1X", "100M"), ("10M10D1X9M", "10M10D10M")])
def test_cigar_v1(spark, v2, v1):
    assert one(spark, cigar.v1(F.lit(v2))) == v1


def plain_positions(pos, c):
    out = []
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", c):
        for _ in range(int(n)):
            if op in "M=X":
                out.append(pos)
                pos += 1
            elif op in "IS":
                out.append(None)
            elif op in "DN":
                pos += 1
    return out


PAIRS = [((100, "100M"), (130, "30S70M")), ((100, "10I90M"), (100, "10S90M")), ((100, "10I10M10I70M"), (110, "30S70M")), ((100, "10M1000D90M"), (1110, "10S90M")),
         ((100, "10M1000D90M"), (1120, "20S90M")), ((100, "10M1000D80M10I"), (1120, "20S80M10S")), ((1000686, "96S154M"), (1000590, "250M"))]


def test_common_base(spark):
    for (p, c), (q, d) in PAIRS:
        got = one(spark, cigar.common_base(cigar.match_blocks(F.lit(p), F.lit(c)), cigar.match_blocks(F.lit(q), F.lit(d))))
        assert got is not None and got.a == got.b
    rng = random.Random(1)
    rand = lambda: "".join(f"{rng.randint(1, 9)}{rng.choice('M=XIDSN')}" for _ in range(rng.randint(1, 6)))
    rows = [(rng.randint(0, 50), rand(), rng.randint(0, 50), rand()) for _ in range(400)]
    df = spark.createDataFrame(rows, "p int, c string, q int, d string")
    x = cigar.common_base(cigar.match_blocks(F.col("p"), F.col("c")), cigar.match_blocks(F.col("q"), F.col("d")))
    for r in df.select("*", x.alias("x")).collect():
        want = next(((a, b) for a, b in zip(plain_positions(r.p, r.c), plain_positions(r.q, r.d)) if a is not None and b is not None), None)
        assert (r.x and tuple(r.x)) == want


def test_d_err(spark):
    truth = "named_struct('chrom', tc, 'pos', tp, 'cigar', tcig, 'special_cigar', special)"
    rows = [
        ("1", 101, "100=", None, 0, "1", 100, "100M", 0), ("1", 101, "100=", None, 4, None, -1, None, 202), ("1", 101, "100=", None, 0, "2", 100, "100M", 201),
        ("1", 101, "100=", None, 0, "1", 130, "30S70M", 0), ("1", 101, "10=5I85=", None, 0, "1", 100, "10M5I85M", 0), ("1", 101, "100=", None, 0, "1", 5000, "100M", 200),
        ("1", 101, "10I", ">3+10I", 0, "1", 90, "5S5M", -10), ("1", 101, "100I", None, 0, "1", 95, "100M", -5), ("1", 101, "100=", None, 0, "1", 40, "100M", -60),
    ]
    df = spark.createDataFrame(rows, "tc string, tp long, tcig string, special string, flag int, chrom string, pos long, cigar string, want int")
    got = df.withColumn("truth", F.expr(truth)).transform(scoring.score).collect()
    assert [r.d_err for r in got] == [r.want for r in got]
    strict = df.withColumn("truth", F.expr(truth)).transform(lambda d: scoring.score(d, strict=True)).collect()
    assert strict[3].d_err == 30
    t = lambda p, c: F.struct(F.lit(p).alias("pos"), F.lit(c).alias("cigar"))
    assert one(spark, scoring.correct_tlen(t(100, "50="), t(300, "50="))) == 250
    assert one(spark, scoring.correct_tlen(t(300, "50="), t(100, "50="))) == -250
    assert one(spark, scoring.correct_tlen(t(300, "50I"), t(100, "50="))) == 0


def test_tags(spark):
    df = spark.sql("SELECT map('NM','1','Xd','9') tags, 0 flag, '1' chrom, 99L pos, '10M' cigar, named_struct('chrom','1','pos',95L,'cigar','10=','special_cigar',cast(null as string),'v_list',array(3,-2)) truth")
    assert scoring.tag(df).first().tags == {"NM": "1", "Xd": "5", "XR": "1", "XP": "95", "XM": "10=", "XV": "3,-2"}


NAME = "@8|INTEGRATION|1:1|1:1930067:27=1X63=1I158=:0,1:|0:1929910:184=1X63=1I1=:0,1:*"


def test_qname(spark):
    t = one(spark, qname.parse(F.lit(NAME)))
    assert [(x.strand, x.pos, x.v_list, x.md) for x in t] == [(1, 1930067, [0, 1], ""), (0, 1929910, [0, 1], "")]
    assert t[0]["index"] == "8" and t[0].sample == "INTEGRATION" and t[0].chrom == "1" and t[0].cpy == 1 and t[0].special_cigar is None
    inside = one(spark, qname.parse(F.lit("A|s|2:0|0:9:>3+10I:10:4A*")))[0]
    assert (inside.cigar, inside.special_cigar, inside.md) == ("10I", ">3+10I", "4A")
    back = qname.assemble(F.lit("8"), F.lit("INTEGRATION"), F.lit("1"), F.lit(1), qname.parse(F.lit(NAME)))
    assert one(spark, back) == NAME[1:]
    assert one(spark, qname.serial(F.lit(46655))) == "ZZZ"
    df = spark.createDataFrame([(NAME[1:],), ("9|cut",)], "qname string")
    side = qname.sidecar(spark.createDataFrame([("@9|cut and more*",)], "value string"))
    assert {r.full_qname for r in qname.resolve(df, side).collect()} == {NAME[1:], "9|cut and more*"}
    with pytest.raises(Exception, match="not in the sidecar"):
        qname.resolve(spark.createDataFrame([("7|cut",)], "qname string"), side).collect()
    kept, rest = qname.retruncate(F.lit("abcdefg*"), 5)
    assert (one(spark, kept), one(spark, rest)) == ("abcde", "abcdefg*")


def test_sequences(spark):
    assert one(spark, seq.sanitize(F.lit("ARYSWKMBDHVN"))) == "A" + "N" * 11
    assert one(spark, seq.reverse_complement(F.lit("ATTGCN"))) == "NGCAAT"
    for k in (1, 2, 3, 4):
        s = seq.de_bruijn("ACTG", k)
        s += s[: k - 1]
        assert len({s[i : i + k] for i in range(len(s) - k + 1)}) == 4**k
        if k < 4:
            assert abs(one(spark, seq.linguistic_complexity(F.lit(s))) - 1) < 1e-9
        assert abs(one(spark, seq.shannon_entropy_folded(F.lit(s), k)) - 2 * k) < 1e-6
    s = "ACGTTTTTGGCAN"
    for k in (1, 2):
        want = sum(-p * math.log2(max(p, 1e-6)) for p in (s.count("".join(m)) / (len(s) - k + 1) for m in itertools.product("ACGT", repeat=k)))
        assert abs(one(spark, seq.shannon_entropy(F.lit(s), k)) - want) < 1e-9 and abs(one(spark, seq.shannon_entropy_folded(F.lit(s), k)) - want) < 1e-9
    num = den = 1
    for k in range(1, len(s)):
        num += min(len({s[i : i + k] for i in range(len(s) - k + 1)}), 4**k)
        den += min(len(s) - k + 1, 4**k)
    assert abs(one(spark, seq.linguistic_complexity(F.lit(s))) - num / den) < 1e-9
    assert column(spark, ["GGCCAATT", "NNAA", "", "gcGC"], "string", seq.gc_fraction) == [0.5, None, None, 0.5]


def test_variants(spark):
    assert [tuple(one(spark, variants.classify(F.lit(r), F.lit(a)))) for r, a in (("C", "T"), ("A", "ATTT"), ("CAA", "C"))] == [("X", 0), ("I", 3), ("D", 2)]
    with pytest.raises(Exception, match="complex"):
        one(spark, variants.classify(F.lit("CGT"), F.lit("CTT")))
    assert one(spark, variants.decision(F.lit("TP"), F.lit(None))) == "TP" and one(spark, variants.decision(F.lit("X"), F.lit("Y"))) is None
    got = column(spark, [[], [1, 2], [0], [-10], [-11], [-51], [10], [11], [51]], "array<int>", variants.variant_class)
    assert got == ["Ref", "Multi", "SNP", "DEL<=10", "DEL 11-50", "DEL>50", "INS<=10", "INS 11-50", "INS>50"]
    assert column(spark, [0, -50, 51, 200, 201, 202], "int", variants.displacement_class) == ["0", "<=50", "50<200", "50<200", "WC", "UM"]
    assert column(spark, [5, 0], "int", lambda c: variants.membership_label(c, 3)) == ["A(B)C", "(A)(B)(C)"]
    assert one(spark, variants.genotype_text(F.array(F.lit(0), F.lit(None).cast("int")), F.lit(True))) == "0|."
    assert one(spark, variants.genotype_shares(F.lit(0.5))) == [0.25, 0.25, 0.25, 0.25]


def test_bins(spark):
    assert column(spark, [-9, -2, 0, 2, 9], "int", lambda c: bins.size_index(c, 2)) == [0, 1, 3, 5, 6]
    edges = [-math.inf, 0, 10, math.inf]
    assert column(spark, [-5.0, 0.0, 9.9, 10.0, 1e9], "double", lambda c: bins.digitize(c, edges)) == [0, 1, 1, 2, 2]
    assert column(spark, [[], [7], [-9], [1, 2]], "array<int>", lambda c: bins.v_scalar(c, 5)) == [6, 5, -5, 7]
    assert column(spark, [-6, -5, 0, 1, 5, 6], "int", lambda c: bins.signed_bin(c, 5)) == [-2, -1, 0, 1, 1, 2]
    assert [r.label for r in bins.bin_table(spark, {"mq": edges}).collect()] == ["-inf <= mq < 0", "0 <= mq < 10", "10 <= mq < inf"]
