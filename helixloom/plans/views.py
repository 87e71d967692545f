"""Views of the driver's tables that look like reads, calls, variants, sequences and names; the SQL twins use the same arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d_err, mq, v_list) from lineitem: none, one or two variants by line number."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    size = F.col("l_partkey") % 121 - 60
    other = F.col("l_suppkey") % 61 - 30
    v = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<bigint>")).when(F.col("l_linenumber") % 3 == 1, F.array(size)).otherwise(F.array(size, other))
    return li.select(
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29) % 403 - 200).cast("int").alias("d_err"),
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 71).cast("int").alias("mq"),
        v.cast("array<int>").alias("v_list"),
    )


READS = """reads AS (SELECT CAST((l_partkey*7 + l_suppkey*13 + l_linenumber*29) % 403 - 200 AS INT) AS d_err,
  CAST((l_orderkey*31 + l_linenumber) % 71 AS INT) AS mq,
  CASE l_linenumber % 3 WHEN 0 THEN CAST([] AS INT[]) WHEN 1 THEN [CAST(l_partkey % 121 - 60 AS INT)]
    ELSE [CAST(l_partkey % 121 - 60 AS INT), CAST(l_suppkey % 61 - 30 AS INT)] END AS v_list FROM lineitem)"""


def order_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mates of a template from every order: (key, mate, src-free d_err, mq, v_list, flag)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumn("mate", F.explode(F.array(F.lit(1), F.lit(2))))
    k, c, m = F.col("o_orderkey"), F.col("o_custkey"), F.col("mate")
    v = F.when((k + m) % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array((k * m + c) % 101 - 50))
    return o.select(k.alias("key"), "mate", ((k * (17 + m) + c * 7) % 403 - 200).cast("int").alias("d_err"), ((k * 31 + c * m) % 71).cast("int").alias("mq"), v.cast("array<int>").alias("v_list"))


ORDER_READS = """oreads AS (SELECT o_orderkey AS key, mate, CAST((o_orderkey*(17+mate) + o_custkey*7) % 403 - 200 AS INT) AS d_err,
  CAST((o_orderkey*31 + o_custkey*mate) % 71 AS INT) AS mq,
  CASE WHEN (o_orderkey + mate) % 4 = 0 THEN CAST([] AS INT[]) ELSE [CAST((o_orderkey*mate + o_custkey) % 101 - 50 AS INT)] END AS v_list
  FROM orders, (SELECT unnest([1, 2]) AS mate))"""


def template_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as templates (key, m1, m2) in the operators' shape; truth holds v_list alone."""
    r = order_reads(spark, sf_dir)
    row = F.struct("d_err", "mq", F.struct("v_list").alias("truth"))
    of = lambda n: F.max(F.when(F.col("mate") == n, row)).alias(f"m{n}")
    return r.groupBy("key").agg(of(1), of(2))


def calls(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Evaluated calls (key, cat, vtype, size) of one of two pipelines from orders; a tenth of each side are variants of its own."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cats = F.array(F.lit("TP"), F.lit("FN"), F.lit("GT"))
    turn = (k if side == "a" else k + c) % 3
    size = (c % 41 - 20).cast("int")
    own = k % 10 == (9 if side == "a" else 8)
    return o.select(
        F.when(own, -k).otherwise(k).alias("key"), F.when(k % 10 > 6, "FP").otherwise(F.get(cats, turn.cast("int"))).alias("cat"), F.when(size == 0, "SNP").otherwise("INDEL").alias("vtype"), size.alias("size")
    )


CALLS = """ca AS (SELECT CASE WHEN o_orderkey % 10 = 9 THEN -o_orderkey ELSE o_orderkey END AS key, CASE WHEN o_orderkey % 10 > 6 THEN 'FP' ELSE ['TP','FN','GT'][CAST(o_orderkey % 3 AS INT) + 1] END AS cat,
  CASE WHEN o_custkey % 41 = 20 THEN 'SNP' ELSE 'INDEL' END AS vtype, CAST(o_custkey % 41 - 20 AS INT) AS size FROM orders),
cb AS (SELECT CASE WHEN o_orderkey % 10 = 8 THEN -o_orderkey ELSE o_orderkey END AS key, CASE WHEN o_orderkey % 10 > 6 THEN 'FP' ELSE ['TP','FN','GT'][CAST((o_orderkey + o_custkey) % 3 AS INT) + 1] END AS cat,
  CASE WHEN o_custkey % 41 = 20 THEN 'SNP' ELSE 'INDEL' END AS vtype, CAST(o_custkey % 41 - 20 AS INT) AS size FROM orders)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, chrom, pos, ref, alts, gt) from orders: contigs by customer, lengths by key."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rlen, alen = F.when(k % 3 == 1, 1 + k % 7).otherwise(1).cast("int"), F.when(k % 3 == 2, 1 + k % 5).otherwise(1).cast("int")
    gt = F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).when(k % 3 == 1, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(1)))
    return o.select(k.alias("ordinal"), F.concat(F.lit("chr"), (c % 5).cast("string")).alias("chrom"), (k * 3 + c % 4 + 1).alias("pos"), F.rpad(F.lit("A"), rlen, "C").alias("ref"), F.array(F.when(alen == 1, "G").otherwise(F.rpad(F.lit("A"), alen, "T"))).alias("alts"), gt.alias("gt"))


VARIANTS = """vars AS (SELECT o_orderkey AS ordinal, 'chr' || (o_custkey % 5) AS chrom, o_orderkey*3 + o_custkey % 4 + 1 AS pos,
  rpad('A', CAST(CASE WHEN o_orderkey % 3 = 1 THEN 1 + o_orderkey % 7 ELSE 1 END AS INT), 'C') AS ref,
  CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 > 0 THEN rpad('A', CAST(1 + o_orderkey % 5 AS INT), 'T') ELSE 'G' END AS alt,
  CASE o_orderkey % 3 WHEN 0 THEN [0,1] WHEN 1 THEN [1,0] ELSE [1,1] END AS gt FROM orders)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq): the A, C, G and T of whole documents, in capitals."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.regexp_replace(F.upper(F.translate(F.coalesce("text", F.lit("")), "bdefhijklmnopqrsuvwxyzBDEFHIJKLMNOPQRSUVWXYZ", "")), "[^ACGT]", "").alias("seq"))


SEQUENCES = "seqs AS (SELECT doc_id, regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^acgtACGT]', '', 'g')), '[^ACGT]', '', 'g') AS seq FROM documents)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, chrom, cpy, mates, qname): whole read names built from orders."""
    from helixloom.functions import qname as qn

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def mate(s: int) -> Column:
        v = F.when(k % 2 == s, F.array((c % 9 - 4).cast("int"), F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.struct(F.lit(s).alias("strand"), (k * 5 + s * 300).alias("pos"), F.concat((50 + c % 50).cast("string"), F.lit("=1X20=")).alias("cigar"), v.alias("v_list"), F.lit("").alias("md"))

    df = o.select(k, c, (c % 22 + 1).cast("string").alias("chrom"), (k % 2).cast("int").alias("cpy"), F.array(mate(0), mate(1)).alias("mates"))
    return df.withColumn("qname", qn.assemble(qn.serial(k), F.lit("S1"), F.col("chrom"), F.col("cpy"), F.col("mates")))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads (flag, chrom, pos, cigar, truth) from orders, with simple and clipped alignments."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    truth = F.struct((c % 3).cast("string").alias("chrom"), (k * 2 + 1).alias("pos"), F.lit("100=").alias("cigar"), F.lit(None).cast("string").alias("special_cigar"))
    clip = (k % 30 + 1).cast("int")
    clipped = k % 4 == 0
    return o.select(
        k.alias("key"), F.when(k % 17 == 0, 4).otherwise(0).alias("flag"), F.when(k % 13 == 0, F.lit("9")).otherwise((c % 3).cast("string")).alias("chrom"),
        (k * 2 + F.when(clipped, clip).otherwise(0) + F.when(k % 5 == 0, c % 500 - 250).otherwise(0)).alias("pos"),
        F.when(clipped, F.concat(clip.cast("string"), F.lit("S"), (100 - clip).cast("string"), F.lit("M"))).otherwise("100M").alias("cigar"), truth.alias("truth"),
    )
