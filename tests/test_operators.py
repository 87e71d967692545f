"""Queries against DuckDB, partitions, models, simulation in a closed loop, streams and the command line."""

import duckdb
import numpy as np
import pytest
from helixloom import cli
from helixloom.operators import calls, haplotypes, histograms, models, partition, reads, simulate
from helixloom.plans import operator_queries, registry, sim_queries, views
from helixloom.sources import text
from helixloom.streaming import reads as streams
from pyspark.sql import functions as F

TABLES = "lineitem orders events documents part customer supplier nation region".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.registered().items() if sql])
def test_query_equals_sql(spark, sf, duck, name):
    f, sql = registry.registered()[name]
    df = f(spark, sf)
    r = duck.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda x: [(v is None, str(v)) for v in x]
    assert sorted(map(tuple, df.select(*[f"`{c}`" for c in cols]).collect()), key=key) == sorted(r.fetchall(), key=key)


def test_quirks_have_both_forms(spark):
    df = spark.createDataFrame([(0, 10, [5]), (201, 80, [])], "d_err int, mq int, v_list array<int>")
    slots = lambda **k: sorted(r.v for r in histograms.dmv(df, max_v=10, **k).collect())
    assert slots() == [15, 21, 22, 22] and slots(legacy=True) == [10, 21, 22, 22]
    sized = spark.createDataFrame([(k, 1, 1) for k in range(23)], "size_idx int, num int, den int")
    assert {r.bin: r.num for r in calls.rebin_sizes(sized, 10, 4).collect()} == {-4: 1, -3: 2, -2: 4, -1: 4, 0: 1, 1: 4, 2: 4, 3: 2, 4: 1}
    assert {r.bin for r in calls.rebin_sizes(sized, 10, 4, legacy=True).collect()} == {-4, -2, -1, 0, 1, 2, 4}
    fates = {r.fate: r["count"] for r in histograms.read_fate(df.select("d_err", F.lit(1).alias("count")), 200).collect()}
    assert fates == {"correct": 1, "wrong_chrom": 1}
    with pytest.raises(Exception, match="no such transition"):
        a = spark.createDataFrame([(1, "TP", "SNP")], "key int, cat string, vtype string")
        calls.call_fate(a, a.withColumn("cat", F.lit("FP"))).collect()


def test_binomial_interval(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (50, 100)], "num long, den long")
    got = [(r.low, r.high) for r in calls.confidence(df, 0.05).orderBy("den", "num").collect()]
    assert got[0] == (0, 0) and got[1] == (0.2, 0.8) and got[2] == (1, 1) and got[3] == (0.4, 0.6)


def test_partition_sets(spark):
    one = "q string, flag int, mq int, chrom string, pos long, cigar string"
    rows = [("8|s|1:0|0:101:50=::|0:301:50=::*", 65, 60, "1", 100, "50M"), ("8|s|1:0|0:101:50=::|0:301:50=::*", 129, 5, "1", 300, "50M"), ("9|s|1:0|0:11:50=::*", 0, 9, "1", 10, "50M")]
    a = spark.createDataFrame(rows, one).withColumnRenamed("q", "qname")
    b = a.withColumn("pos", F.col("pos") + F.when(F.col("mq") > 50, 90).otherwise(0)).where("mq <> 9")
    code = lambda *x, **k: {r.key[0]: r.code for r in partition.partition_sets([a, b], *x, **k).collect()}
    assert code("d_err", 50) == {"1": 2, "2": 3} and code("d_err_strict", 50) == {"1": 2, "2": 3}
    assert code("MQ", 10) == {"1": 0, "2": 3} and code("mapped") == {"1": 3, "2": 3}
    assert code("p_diff", 1) == {"1": 2, "2": 3} and code("p_diff", 1, legacy=True) == {"1": 0, "2": 0}
    assert [(r.label, r["count"]) for r in partition.cells(partition.partition_sets([a, b], "MQ", 10), 2).orderBy("code").collect()] == [("(A)(B)", 1), ("(A)B", 0), ("A(B)", 0), ("AB", 1)]
    with pytest.raises(ValueError, match="sets"):
        partition.stack([a] * 9)


def test_models(spark, tmp_path):
    m = models.create_model(20, 50, 5, 100)
    assert all(abs(row[-1] - 1) < 1e-9 for row in m.cum_bq[0]) and len(m.cum_tlen) == 100
    models.save_model(m, str(tmp_path / "m.json"))
    (tmp_path / "junk.json").write_text("x")
    assert models.list_models(str(tmp_path)) == [("m.json", "synthetic")] and models.load_model(str(tmp_path / "m.json")).rlen == 20
    assert models.describe(spark, m).count() == 2 * 20 * 94 + 100
    assert models.SEQUENCERS["illumina"](m, 30)[1] == 4 and models.SEQUENCERS["flat"](m, 30)[1] == 8
    q = "!" + "I" * 19
    rows = [("a", 65, "1", 5, 60, "20M", "1", 30, 45, "A" * 20, q), ("a", 145, "1", 30, 60, "20M", "1", 5, -45, "A" * 20, q), ("b", 1024, "1", 9, 60, "20M", None, None, 0, "A" * 20, q)]
    df = spark.createDataFrame(rows, "qname string, flag int, chrom string, pos long, mq int, cigar string, next_chrom string, next_pos long, tlen int, seq string, qual string")
    got = models.model_from_reads(df, "x")
    assert got.rlen == 20 and got.extra["r_cnt"] == 2 and got.cum_bq[0][0][0] == 1 and got.cum_bq[1][0][39] == 0 and got.cum_bq[1][19][0] == 1 and got.cum_tlen[44] == 0 and got.cum_tlen[45] == 1
    lines = spark.createDataFrame([("1", 0, "GGCCA" * 10), ("1", 50, "ATTTT" * 10)], "chrom string, start long, seq string")
    gc = {r.block_start: (round(r.gc, 3), r.coverage) for r in models.gc_and_coverage(df.where("flag < 1000"), lines, 40).collect()}
    # both reads cover 20 bases; the first block holds 0..40 inclusive: 20 of the first and 11 of the second
    assert gc[0] == (round(33 / 41, 3), 1.0) and gc[40][1] == 1.0 and gc[80][1] == 0.0


def test_free_slots_match_a_scan():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 40))
        used, slots = [False] * n, simulate.FreeSlots(n)
        for _ in range(n):
            i0 = int(rng.integers(0, n))
            down, up, want = i0, i0, None
            while want is None and (down > 0 or up < n):
                if down > 0:
                    if not used[down]:
                        want = down
                        break
                    down -= 1
                if up < n:
                    if not used[up]:
                        want = up
                        break
                    up += 1
            if want is None:
                break
            got = slots.nearest(i0)
            assert got == want, (n, i0, used)
            used[got] = True
            slots.take(got)


def test_closed_loop(spark, sf):
    """Simulated reads, perfectly aligned, lie where their names say."""
    a = sim_queries.perfect_align(spark, sf).collect()
    assert len(a) > 500 and {r.d_err for r in a} == {0}
    assert {abs(r.tlen) >= 30 for r in a} == {True}
    again = {(r.qname, r.flag) for r in sim_queries.perfect_align(spark, sf).collect()}
    assert again == {(r.qname, r.flag) for r in a}
    v = sim_queries.sim_variants(spark, sf)
    assert v.where("length(ref) = 1 and length(alt) = 1 and ref = alt").count() == 0 and v.count() > 100
    flat = sim_queries.flat_templates(spark, sf).toPandas()
    assert len(flat) and flat.groupby(["region_idx", "cpy", "pass"]).p0.nunique().min() >= 1
    c = sim_queries.corrupt_reads(spark, sf).limit(400).collect()
    assert all(len(r.seq) == len(r.qual) == 30 for r in c) and any(r.md for r in c)


def test_short_templates_over_insertions_hold(spark, sf, monkeypatch):
    """Bases inserted in a read take no room on the reference; without any, a template shorter there than a read is told."""
    with monkeypatch.context() as m:
        m.setattr(sim_queries, "MODEL", models.create_model(rlen=30, tlen=34, tlen_std=3, max_tlen=200))
        a = sim_queries.perfect_align(spark, sf).cache()
    short = [r.cigar for r in a.where("abs(tlen) < 30").collect()]
    assert short and all("I" in c for c in short)
    monkeypatch.setattr(sim_queries, "perfect_align", lambda *_: a)
    got = operator_queries.perfect_align_holds(spark, sf).collect()
    a.unpersist()
    assert len(got) > 100 and all(r.no_displacement and r.mates_apart for r in got)
    names = [r.chrom for r in got[:5]]
    rows = spark.createDataFrame(list(zip(names, ["30M", "29M1I", "10M5D20M", "12M2I16M", "30I"], [29, 29, 29, 27, 1])), "chrom string, cigar string, tlen int").withColumn("d_err", F.lit(0))
    monkeypatch.setattr(sim_queries, "perfect_align", lambda *_: rows)
    told = {r.chrom: r.mates_apart for r in operator_queries.perfect_align_holds(spark, sf).collect()}
    assert [told[n] for n in names] == [False, True, False, False, True]


def test_haplotype_keeps_reference_without_variants(spark):
    df = spark.createDataFrame([(0, "1", 1, "ACGTACGT", 1)], "region_idx int, chrom string, start long, seq string, ploidy int")
    none = spark.createDataFrame([], "region_idx int, cpy int, chrom string, pos long, ordinal long, ref string, alt string, op string, n int")
    n = haplotypes.haplotypes(df, none).first().nodes
    assert [(x.op, x.n, x["seq"]) for x in n] == [("=", 8, "ACGTACGT")]


def test_work_list_and_truth(spark):
    tasks = simulate.work_list(spark, 3, 2, 4, 1).collect()
    assert len(tasks) == 24 and [t.seed for t in tasks] == sorted(t.seed for t in tasks)
    rows = [("q", 99, "1", 10, 60, "5M1I4M", "1", 40, "ACGTACGTAC", "I" * 10), ("q", 147, "1", 40, 60, "10M", "1", 10, "ACGTACGTAC", "I" * 10), ("r", 99, "1", 10, 5, "10M", "1", 40, "A", "I")]
    df = spark.createDataFrame(rows, "qname string, flag int, chrom string, pos long, mq int, cigar string, next_chrom string, next_pos long, seq string, qual string")
    t = reads.truth_from_alignments(df, 20, "s").collect()
    assert len(t) == 1 and [(m.pos, m.v_list, m.strand) for m in t[0].mates] == [(11, [1], 0), (41, [], 0)]


def test_streams(spark, sf, tmp_path):
    r = views.order_reads(spark, sf).select(F.col("key").cast("string").alias("qname"), F.when(F.col("mate") == 1, 65).otherwise(129).alias("flag"), "d_err", "mq", "v_list", F.timestamp_seconds(F.col("key") % 100 + 1_000_000).alias("ts"))
    r.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
    streams.drain(streams.pair_stream(source, "ts"), "pairs", "append", str(tmp_path / "c1"))
    assert spark.table("pairs").count() == r.count() // 2
    streams.drain(streams.running_histogram(source), "cells", "complete", str(tmp_path / "c2"))
    batch = {tuple(x) for x in histograms.hist3d(r).collect()}
    assert {tuple(x) for x in spark.table("cells").collect()} == batch
    streams.drain(streams.windowed_counts(source, "ts"), "windows", "complete", str(tmp_path / "c3"))
    assert spark.table("windows").agg(F.sum("count")).first()[0] == r.count()


def test_command_line(spark, tmp_path, capsys):
    t = lambda n: str(tmp_path / n)
    (tmp_path / "r.fa").write_text(">1\n" + "ATGACGTATCCAAGGAGGCGTTACC" * 40 + "\n")
    (tmp_path / "v.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n1\t5\t.\tC\tT\t.\tPASS\t.\tGT\t0|1\n1\t5\t.\tC\tCA\t.\tPASS\t.\tGT\t0|1\n")
    (tmp_path / "r.bed").write_text("1\t0\t900\n")
    run = lambda *a: cli.main(list(a), spark)
    run("filter-variants", t("v.vcf"), t("r.bed"), t("kept"), "--sample", "s")
    assert spark.read.parquet(t("kept")).count() == 2
    run("synth-illumina", t("m.json"), "--read-length", "20", "--mean-template-length", "60", "--std-template-length", "5")
    run("generate-reads", t("r.fa"), t("v.vcf"), "s", t("m.json"), t("fq"), "--bed", t("r.bed"), "--coverage", "5")
    n = text.fastq(spark, t("fq") + "/file=0").count()
    assert n > 20 and text.fastq(spark, t("fq") + "/file=1").count() == n
    run("qname-stats", t("fq") + "/file=0", t("lengths"))
    run("simulate-variants", t("r.fa"), t("sim"), "--model", "SNP:0.01:0.5:1:2")
    run("vcf-complexity", t("v.vcf"), t("r.fa"), t("cx"))
    assert "SE4" in spark.read.parquet(t("cx")).columns
    run("variant-by-size", t("v.vcf"), t("sizes"))
    run("qname")
    assert "index|sample" in capsys.readouterr().out
    for command in cli.COMMANDS:
        with pytest.raises(SystemExit):
            cli.parser().parse_args([command, "--help"])
