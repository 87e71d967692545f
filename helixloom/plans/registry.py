"""The queries: name to (query, SQL). Integer results are bigint and doubles rounded on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.functions import cigar as cg
from helixloom.functions import qname as qn
from helixloom.functions import scoring
from helixloom.functions import seq as sq
from helixloom.functions import variants as va
from helixloom.operators import calls as C
from helixloom.operators import histograms as H
from helixloom.operators import intervals, models, partition, reads
from helixloom.operators import variants as V
from helixloom.plans import operator_queries, sim_queries, views
from helixloom.plans.views import CALLS, ORDER_READS, READS, SEQUENCES, VARIANTS, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def registered() -> dict:
    return QUERIES | sim_queries.QUERIES | operator_queries.QUERIES


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns or [c for c, t in df.dtypes if t == "int"]})


def _dv(spark, d) -> DataFrame:
    """(d_err, mq, v, count) with v null for reads without variants."""
    r = views.reads(spark, d)
    return r.select("d_err", "mq", F.explode_outer("v_list").alias("v")).groupBy("d_err", "mq", "v").agg(F.count("*").alias("count"))


DV = f"{READS}, dv AS (SELECT d_err, mq, v, count(*) AS count FROM (SELECT d_err, mq, unnest(CASE WHEN len(v_list) = 0 THEN CAST([NULL] AS INT[]) ELSE v_list END) AS v FROM reads) GROUP BY ALL)"


# ---- histograms ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {READS} SELECT CAST(d_err + 200 AS BIGINT) AS xd, CAST(least(mq, 70) AS BIGINT) AS mq, CAST(v AS BIGINT) AS v, count(*) AS count
FROM (SELECT d_err, mq, unnest(CASE WHEN len(v_list) = 0 THEN [0] ELSE list_transform(v_list, lambda x: least(123, greatest(1, x + 62))) END) AS v FROM reads) GROUP BY ALL""")
def alignment_hist3d(spark, d):
    return longs(H.hist3d(views.reads(spark, d)))


@query(f"""WITH {READS} SELECT CAST(d_err + 200 AS BIGINT) AS xd, CAST(least(mq, 70) AS BIGINT) AS mq, CAST(v AS BIGINT) AS v, count(*) AS count
FROM (SELECT d_err, mq, unnest(list_append(CASE WHEN len(v_list) = 0 THEN [121] ELSE list_transform(v_list, lambda x: least(120, greatest(0, x + 60))) END, 122)) AS v FROM reads) GROUP BY ALL""")
def dmv_hist_margin(spark, d):
    return longs(H.dmv(views.reads(spark, d)))


_EDGES = {"xd1": (-H.INF, -100, -20, 0, 1, 21, 101, 201, 202, H.INF), "mq1": (0, 11, 41, H.INF), "xd2": (-H.INF, -100, -20, 0, 1, 21, 101, 201, 202, H.INF), "mq2": (0, 11, 41, H.INF), "v1": (-H.INF, -20, 0, 1, 21, 51, H.INF), "v2": (-H.INF, -20, 0, 1, 21, 51, H.INF), "xt": (-H.INF, -50, 0, 50, H.INF), "t": (-H.INF, 200, 300, 400, H.INF)}


def _measures(spark, d) -> DataFrame:
    from helixloom.functions import bins

    t = views.template_reads(spark, d)
    each = {f"{n}{k}": e for k in (1, 2) for n, e in (("xd", F.col(f"m{k}.d_err")), ("mq", F.col(f"m{k}.mq")), ("v", bins.v_scalar(F.col(f"m{k}.truth.v_list"), 50)))}
    return t.select(*[e.alias(n) for n, e in each.items()], (F.col("key") % 201 - 100).alias("xt"), (F.col("key") % 500 + 50).alias("t"))


def _bin_sql(x: str, edges) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {x} >= {e} THEN 1 ELSE 0 END" for e in edges[1:-1]) + " AS BIGINT)"


_M_SQL = f"""{ORDER_READS}, m AS (SELECT a.d_err AS xd1, b.d_err AS xd2, a.mq AS mq1, b.mq AS mq2,
  CASE len(a.v_list) WHEN 0 THEN 51 ELSE least(50, greatest(-50, a.v_list[1])) END AS v1, CASE len(b.v_list) WHEN 0 THEN 51 ELSE least(50, greatest(-50, b.v_list[1])) END AS v2,
  a.key % 201 - 100 AS xt, a.key % 500 + 50 AS t FROM oreads a JOIN oreads b ON a.key = b.key AND a.mate = 1 AND b.mate = 2),
h AS (SELECT {", ".join(f"{_bin_sql(k, e)} AS {k}" for k, e in _EDGES.items())}, count(*) AS count FROM m GROUP BY ALL)"""


@query(f"WITH {_M_SQL} SELECT * FROM h")
def hist8d(spark, d):
    return longs(H.hist_nd(_measures(spark, d), _EDGES))


@query(f"WITH {_M_SQL} SELECT xd1, mq1, CAST(sum(count) AS BIGINT) AS count FROM h GROUP BY xd1, mq1")
def collapse_xd1_mq1(spark, d):
    return longs(H.collapse(H.hist_nd(_measures(spark, d), _EDGES), xd1=None, mq1=None))


@query(f"WITH {_M_SQL} SELECT xd1, CAST(sum(count) AS BIGINT) AS count FROM h WHERE v1 >= 1 AND v1 < 4 GROUP BY xd1")
def collapse_slice(spark, d):
    return longs(H.collapse(H.hist_nd(_measures(spark, d), _EDGES), xd1=None, v1=(1, 4)))


@query(f"WITH {_M_SQL} SELECT xd1, mq1, v1, CAST(sum(count) AS BIGINT) AS count, CAST(grouping(xd1, mq1, v1) AS BIGINT) AS gid FROM h GROUP BY CUBE (xd1, mq1, v1)")
def hist_all_marginals(spark, d):
    return longs(H.all_marginals(H.hist_nd(_measures(spark, d), _EDGES), "xd1", "mq1", "v1"))


@query(f"WITH {_M_SQL} SELECT mq1, CAST(2 * sum(count) AS BIGINT) AS count FROM h GROUP BY mq1")
def hist_force_sum(spark, d):
    one = H.collapse(H.hist_nd(_measures(spark, d), _EDGES), mq1=None)
    return longs(H.add_up(one, one))


@query(f"WITH {DV} SELECT CAST(mq AS BIGINT) AS mq, round((sum(count) - sum(CASE WHEN abs(d_err) <= 20 THEN count ELSE 0 END)) / greatest(1, sum(count)), 9) AS p_err FROM dv GROUP BY mq")
def perr_by_mq(spark, d):
    return longs(H.p_err(_dv(spark, d), 20).withColumn("p_err", F.round("p_err", 9)))


@query(f"WITH {DV} SELECT CAST(d_err AS BIGINT) AS d_err, round(sum(mq * count) / greatest(1, sum(count)), 9) AS mean_mq FROM dv GROUP BY d_err")
def mean_mq_by_derr(spark, d):
    return longs(H.mean_mq(_dv(spark, d)).withColumn("mean_mq", F.round("mean_mq", 9)))


@query(f"""WITH {DV} SELECT CAST(sign(d_err) * ceil(abs(d_err) / 10.0) AS BIGINT) AS d_bin, CAST(sign(v) * ceil(abs(v) / 5.0) AS BIGINT) AS v_bin,
  round(sum(mq * count) / greatest(1, sum(count)), 9) AS mean_mq, CAST(sum(count) AS BIGINT) AS count FROM dv WHERE v IS NOT NULL GROUP BY ALL""")
def mq_rebin2d(spark, d):
    return longs(H.rebin_mq(_dv(spark, d).where("v IS NOT NULL"), 10, 5).withColumn("mean_mq", F.round("mean_mq", 9)))


@query(f"""WITH {DV} SELECT CASE WHEN d_err = 202 THEN 'unmapped' WHEN d_err = 201 THEN 'wrong_chrom' WHEN d_err = 0 THEN 'correct' WHEN abs(d_err) <= 50 THEN 'near' ELSE 'far' END AS fate,
  CAST(sum(count) AS BIGINT) AS count FROM dv GROUP BY 1""")
def read_fate(spark, d):
    return H.read_fate(_dv(spark, d))


@query(f"WITH {DV} SELECT CAST(v AS BIGINT) AS v, CAST(sum(CASE WHEN abs(d_err) <= 50 THEN count ELSE 0 END) AS BIGINT) AS num, CAST(sum(count) AS BIGINT) AS den FROM dv WHERE v IS NOT NULL GROUP BY v")
def acc_by_vsize(spark, d):
    return longs(H.accuracy_by_size(_dv(spark, d), 50))


@query(f"WITH {DV} SELECT CAST(mq AS BIGINT) AS mq, CAST(sum(count) AS BIGINT) AS count FROM dv GROUP BY mq")
def read_count_by_mq(spark, d):
    return longs(H.counts_by(_dv(spark, d), "mq"))


_CAT = """CASE WHEN len(v_list) = 0 THEN 'Ref' WHEN len(v_list) > 1 THEN 'Multi' WHEN v_list[1] = 0 THEN 'SNP' WHEN v_list[1] < -50 THEN 'DEL>50' WHEN v_list[1] < -10 THEN 'DEL 11-50'
  WHEN v_list[1] < 0 THEN 'DEL<=10' WHEN v_list[1] <= 10 THEN 'INS<=10' WHEN v_list[1] <= 50 THEN 'INS 11-50' ELSE 'INS>50' END"""
_DC = "CASE WHEN d_err = 0 THEN '0' WHEN abs(d_err) <= 50 THEN '<=50' WHEN abs(d_err) < 201 THEN '50<200' WHEN d_err = 201 THEN 'WC' ELSE 'UM' END"
_CELLS = f"""{READS}, f AS (SELECT {_CAT} AS category, least(mq, 60) AS mq, {_DC} AS derr, count(*) AS n FROM reads GROUP BY ALL),
cats AS (SELECT c AS category, CAST(q AS BIGINT) AS mq, e AS derr FROM (SELECT unnest(['{"','".join(va.VARIANT_CLASSES)}']) AS c), range(61) r(q), (SELECT unnest(['{"','".join(va.DISPLACEMENT_CLASSES)}']) AS e)),
cells AS (SELECT category, mq, derr, coalesce(n, 0) AS count FROM cats LEFT JOIN f USING (category, mq, derr))"""


@query(f"WITH {_CELLS} SELECT * FROM cells")
def category_mq_derr_dense(spark, d):
    return longs(H.category_table(views.reads(spark, d)), "mq", "count")


@query(f"""WITH {_CELLS}, s AS (SELECT mq, CAST(sum(CASE WHEN derr = '0' THEN count ELSE 0 END) AS BIGINT) AS correct_0, CAST(sum(CASE WHEN derr IN ('0', '<=50') THEN count ELSE 0 END) AS BIGINT) AS correct_50,
  CAST(sum(count) AS BIGINT) AS total FROM cells GROUP BY mq) SELECT *, CASE WHEN total > 0 THEN round(1 - correct_0 / total, 9) END AS perr_0, CASE WHEN total > 0 THEN round(1 - correct_50 / total, 9) END AS perr_50,
  round(pow(10.0, -mq / 10), 9) AS perr_ideal FROM s""")
def report_aa_mq(spark, d):
    out = H.report_by_mq(H.category_table(views.reads(spark, d)))
    return longs(out, "mq").withColumns({c: F.round(c, 9) for c in ("perr_0", "perr_50", "perr_ideal")})


@query(f"WITH {_CELLS} SELECT category, derr, CAST(sum(count) AS BIGINT) AS count FROM cells GROUP BY ALL")
def report_fate(spark, d):
    return H.report_fate(H.category_table(views.reads(spark, d)))


@query(f"""WITH {DV}, s AS (SELECT mq, sum(CASE WHEN d_err <> 202 AND (d_err < -20 OR d_err >= 20) THEN count ELSE 0 END) AS w, sum(CASE WHEN d_err <> 202 THEN count ELSE 0 END) AS m, sum(count) AS t FROM dv GROUP BY mq)
SELECT CAST(mq AS BIGINT) AS mq, CAST(sum(w) OVER up AS BIGINT) AS wrong, CAST(sum(m) OVER up AS BIGINT) AS mapped, CAST(sum(t) OVER () AS BIGINT) AS total FROM s
WINDOW up AS (ORDER BY mq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def roc_suffix(spark, d):
    return longs(H.roc(_dv(spark, d), 20))


# ---- reads ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {READS} SELECT category, count(*) AS count FROM (SELECT unnest(CASE WHEN len(c) = 0 THEN ['nocat'] ELSE c END) AS category FROM (SELECT list_filter([
  CASE WHEN d_err = 0 THEN 'exact' END, CASE WHEN d_err > 0 AND d_err <= 50 THEN 'near' END, CASE WHEN d_err > 200 THEN 'lost' END, CASE WHEN len(v_list) = 0 THEN 'ref' END], lambda x: x IS NOT NULL) AS c FROM reads)) GROUP BY category""")
def categorize_count(spark, d):
    e = F.col("d_err")
    return reads.count_categories(reads.categorize(views.reads(spark, d), {"exact": e == 0, "near": (e > 0) & (e <= 50), "lost": e > 200, "ref": F.size("v_list") == 0}))


_PAIRS = f"{ORDER_READS}, p AS (SELECT a.key, a.d_err AS d1, b.d_err AS d2, a.v_list AS v1, b.v_list AS v2, a.mq AS q1, b.mq AS q2 FROM oreads a JOIN oreads b ON a.key = b.key AND a.mate = 1 AND b.mate = 2)"


@query(f"WITH {_PAIRS} SELECT key, CAST(d1 AS BIGINT) AS d1, CAST(d2 AS BIGINT) AS d2 FROM p WHERE d1 BETWEEN -50 AND 50 AND d2 BETWEEN -50 AND 50")
def filter_pairs_all(spark, d):
    t = reads.filter_templates(views.template_reads(spark, d), reads.derr(-50, 50))
    return longs(t.select("key", F.col("m1.d_err").alias("d1"), F.col("m2.d_err").alias("d2")))


@query(f"WITH {_PAIRS} SELECT key, len(v1) AS n1, len(v2) AS n2 FROM p WHERE len(list_filter(v1, lambda v: v BETWEEN -5 AND 5)) > 0 OR len(list_filter(v2, lambda v: v BETWEEN -5 AND 5)) > 0")
def filter_pairs_any(spark, d):
    t = reads.filter_templates(views.template_reads(spark, d), reads.vsize(-5, 5), "any")
    return longs(t.select("key", F.size("m1.truth.v_list").alias("n1"), F.size("m2.truth.v_list").alias("n2")))


@query(f"WITH {_PAIRS} SELECT key FROM p WHERE len(v1) > 0 AND len(v2) > 0")
def filter_non_ref(spark, d):
    return reads.filter_templates(views.template_reads(spark, d), reads.non_ref).select("key")


def _pass_sql(k: int) -> str:
    return f"(d{k} BETWEEN -100 AND 100 AND (len(v{k}) = 0 OR len(list_filter(v{k}, lambda v: NOT (v BETWEEN -10 AND 10))) > 0))"


@query(f"""WITH {_PAIRS} SELECT key, {_pass_sql(1)} AS pass_m1, {_pass_sql(2)} AS pass_m2, CAST(CASE WHEN {_pass_sql(1)} THEN d1 ELSE 0 END AS BIGINT) AS xd_m1, CAST(CASE WHEN {_pass_sql(2)} THEN d2 ELSE 0 END AS BIGINT) AS xd_m2
FROM p WHERE {_pass_sql(1)} OR {_pass_sql(2)}""")
def subset_reads(spark, d):
    return longs(reads.subset(views.template_reads(spark, d), d_range=(-100, 100), v_range=(-10, 10), reject_v_range=True).drop("m1", "m2"))


@query(f"WITH {_PAIRS} SELECT key, CAST(d1 AS BIGINT) AS m1_d_err, CAST(d2 AS BIGINT) AS m2_d_err, CAST(q1 AS BIGINT) AS m1_mq, CAST(q2 AS BIGINT) AS m2_mq FROM p")
def pair_mates(spark, d):
    r = views.order_reads(spark, d).select(F.concat(F.col("key").cast("string"), F.lit("|x")).alias("qname"), F.when(F.col("mate") == 1, 65).otherwise(129).alias("flag"), F.lit("1").alias("chrom"), F.lit(0).cast("long").alias("pos"), "d_err", "mq", "key")
    p = reads.pair(r)
    return longs(p.select(F.col("m1.key").alias("key"), F.col("m1.d_err").alias("m1_d_err"), F.col("m2.d_err").alias("m2_d_err"), F.col("m1.mq").alias("m1_mq"), F.col("m2.mq").alias("m2_mq")))


def _three_sets(spark, d) -> DataFrame:
    every = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("mate", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("src", every)
    k, c, m, b = F.col("o_orderkey"), F.col("o_custkey"), F.col("mate"), F.col("src")
    # a read that a set has under another name is not in all three
    return o.select(F.struct("o_orderkey", "mate", (k % 97 == b).alias("other")).alias("key"), "src", ((k * (17 + m) + c * 7 + b * (k % 5)) % 403 - 200).alias("d_err"), ((k * 31 + c * (b + 1)) % 71).alias("mq"), F.when((k + b * c) % 11 == 0, 4).otherwise(0).alias("flag"))


_SETS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, m, b, o_orderkey % 97 = b AS x FROM orders, (SELECT unnest([1, 2]) AS m), (SELECT unnest([0, 1, 2]) AS b)),
s AS (SELECT k, m, x, b, (k*(17+m) + c*7 + b*(k % 5)) % 403 - 200 AS d_err, (k*31 + c*(b+1)) % 71 AS mq, (k + b*c) % 11 = 0 AS unmapped FROM o)"""


def _venn_sql(inside: str, source: str = "s") -> str:
    labels = ", ".join("'" + "".join(chr(65 + i) if code >> (2 - i) & 1 else f"({chr(65 + i)})" for i in range(3)) + "'" for code in range(8))
    return f"""WITH {_SETS}, g AS (SELECT k, m, sum(CASE WHEN {inside} THEN [4, 2, 1][b + 1] ELSE 0 END) AS code FROM {source} GROUP BY k, m, x HAVING count(*) = 3),
n AS (SELECT code, count(*) AS n FROM g GROUP BY code) SELECT CAST(i AS BIGINT) AS code, [{labels}][i + 1] AS label, coalesce(n, 0) AS count FROM range(8) r(i) LEFT JOIN n ON i = code"""


@query(_venn_sql("abs(d_err) < 60"))
def partition_venn3_d_err(spark, d):
    return longs(partition.cells(partition.venn(_three_sets(spark, d), 3, partition.CRITERIA["d_err"](60)), 3))


@query(_venn_sql("mq < 30"))
def partition_venn3_mq(spark, d):
    return longs(partition.cells(partition.venn(_three_sets(spark, d), 3, partition.CRITERIA["MQ"](30)), 3))


@query(_venn_sql("NOT unmapped"))
def partition_venn3_mapped(spark, d):
    return longs(partition.cells(partition.venn(_three_sets(spark, d), 3, partition.CRITERIA["mapped"](0)), 3))


@query(_venn_sql("abs(s.d_err - a.d0) < 5", "s JOIN (SELECT k, m, x, d_err AS d0 FROM s WHERE b = 0 AND NOT unmapped) a USING (k, m, x)"))
def partition_venn3_p_diff(spark, d):
    s = _three_sets(spark, d)
    gold = s.where("src = 0 AND flag = 0").select("key", F.col("d_err").alias("d0"))
    return longs(partition.cells(partition.venn(s.join(gold, "key"), 3, F.abs(F.col("d_err") - F.col("d0")) < 5), 3))


_ALIGN = """a AS (SELECT o_orderkey AS key, o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN '9' ELSE CAST(o_custkey % 3 AS VARCHAR) END AS chrom, CAST(o_custkey % 3 AS VARCHAR) AS tc, o_orderkey % 17 = 0 AS um,
  o_orderkey*2 + CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 30 + 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 500 - 250 ELSE 0 END AS pos,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 30 + 1 ELSE 0 END AS clip FROM orders)"""


@query(f"WITH {_ALIGN} SELECT key, CAST(CASE WHEN um THEN 202 WHEN chrom <> tc THEN 201 ELSE greatest(-200, least(200, pos - clip - k*2)) END AS BIGINT) AS d_err FROM a")
def d_err_score(spark, d):
    return longs(scoring.score(views.alignments(spark, d)).select("key", "d_err"))


@query(f"WITH {_ALIGN} SELECT key, CAST(CASE WHEN um THEN 202 WHEN chrom <> tc THEN 201 ELSE greatest(-200, least(200, pos - k*2)) END AS BIGINT) AS d_err FROM a")
def d_err_strict_score(spark, d):
    return longs(scoring.score(views.alignments(spark, d), strict=True).select("key", "d_err"))


@query(f"WITH {_ALIGN} SELECT key, k*2 + clip AS a, pos AS b FROM a")
def common_base(spark, d):
    r = views.alignments(spark, d)
    x = cg.common_base(cg.match_blocks(F.col("truth.pos") - 1, F.col("truth.cigar")), cg.match_blocks(F.col("pos"), F.col("cigar")))
    return r.withColumn("x", x).select("key", "x.a", "x.b")


@query("""WITH t AS (SELECT o_orderkey AS key, o_orderkey*5 AS p1, o_orderkey*5 + CASE WHEN o_orderkey % 2 = 0 THEN 300 ELSE -300 END AS p2, 70 + o_custkey % 50 + 1 AS n FROM orders)
SELECT key, CASE WHEN p1 < p2 THEN p2 + n - 1 - p1 + 1 ELSE p2 - (p1 + n - 1) - 1 END AS tlen FROM t""")
def correct_tlen(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    cigar = F.concat((50 + F.col("o_custkey") % 50).cast("string"), F.lit("=1X20="))
    p = F.col("o_orderkey") * 5
    one = F.struct(p.alias("pos"), cigar.alias("cigar"))
    two = F.struct((p + F.when(F.col("o_orderkey") % 2 == 0, 300).otherwise(-300)).alias("pos"), cigar.alias("cigar"))
    return o.select(F.col("o_orderkey").alias("key"), scoring.correct_tlen(one, two).alias("tlen"))


@query("SELECT o_orderkey AS key, CAST(71 + o_custkey % 50 + o_orderkey % 7 AS VARCHAR) || 'M' || CASE WHEN o_orderkey % 3 = 0 THEN '2D' || CAST(o_custkey % 9 + 1 AS VARCHAR) || 'M' ELSE '' END AS v1 FROM orders")
def cigar_v1(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = F.concat((50 + c % 50).cast("string"), F.lit("=1X"), (20 + k % 7).cast("string"), F.lit("="), F.when(k % 3 == 0, F.concat(F.lit("2D"), (c % 9 + 1).cast("string"), F.lit("="))).otherwise(""))
    return o.select(k.alias("key"), cg.v1(s).alias("v1"))


# ---- names ---------------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT o_orderkey, CAST(s AS BIGINT) AS s FROM orders, range(2) r(s))
SELECT o_orderkey, CAST(o_custkey % 22 + 1 AS VARCHAR) AS chrom, o_orderkey % 2 AS cpy, s AS strand, o_orderkey*5 + s*300 AS pos, CAST(50 + o_custkey % 50 AS VARCHAR) || '=1X20=' AS cigar,
  CASE WHEN o_orderkey % 2 = s THEN CAST(o_custkey % 9 - 4 AS VARCHAR) || ',0' ELSE '' END AS v_list FROM orders JOIN m USING (o_orderkey)""")
def qname_parse(spark, d):
    t = views.names(spark, d).select("o_orderkey", F.explode(qn.parse(F.col("qname"))).alias("t"))
    return longs(t.select("o_orderkey", "t.chrom", "t.cpy", "t.strand", "t.pos", "t.cigar", F.array_join(F.col("t.v_list").cast("array<string>"), ",").alias("v_list")))


_NAME = """nm AS (SELECT o_orderkey, 'S1|' || CAST(o_custkey % 22 + 1 AS VARCHAR) || ':' || CAST(o_orderkey % 2 AS VARCHAR) || '|0:' || CAST(o_orderkey*5 AS VARCHAR) || ':' || CAST(50 + o_custkey % 50 AS VARCHAR) || '=1X20=:' ||
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 9 - 4 AS VARCHAR) || ',0' ELSE '' END || ':|1:' || CAST(o_orderkey*5 + 300 AS VARCHAR) || ':' || CAST(50 + o_custkey % 50 AS VARCHAR) || '=1X20=:' ||
  CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_custkey % 9 - 4 AS VARCHAR) || ',0' ELSE '' END || ':*' AS rest,
  CASE WHEN o_orderkey = 0 THEN 1 ELSE CAST(floor(log2(o_orderkey) / log2(36) + 1e-9) AS BIGINT) + 1 END AS digits FROM orders)"""


@query(f"WITH {_NAME} SELECT least(length(rest) + 1 + digits, 80) AS length, count(*) AS count FROM nm GROUP BY 1")
def qname_lengths(spark, d):
    n = views.names(spark, d).select(qn.name_length(F.col("qname"), F.lit(None).cast("string")).alias("name_length"))
    return longs(models.name_lengths(n, 80), "length")


@query(f"WITH {_NAME} SELECT o_orderkey, least(60, length(rest) + 1 + digits) AS kept, CASE WHEN length(rest) + 1 + digits > 60 THEN length(rest) + 1 + digits END AS moved FROM nm")
def qname_retruncate(spark, d):
    n = views.names(spark, d)
    short, whole = qn.retruncate(F.col("qname"), 60)
    return longs(n.select("o_orderkey", F.length(short).alias("kept"), F.length(whole).alias("moved")))


@query(f"WITH {_NAME} SELECT o_orderkey, length(rest) + 1 + digits AS n FROM nm")
def sidecar_lookup(spark, d):
    n = views.names(spark, d)
    short, whole = qn.retruncate(F.col("qname"), 70)
    side = qn.sidecar(n.select(F.concat(F.lit("@"), whole).alias("value")).where("value IS NOT NULL"))
    cut = n.select("o_orderkey", short.alias("qname"))
    return longs(qn.resolve(cut, side).select("o_orderkey", F.length("full_qname").alias("n")))


# ---- calls ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {CALLS}, j AS (SELECT coalesce(ca.cat, 'N') || '->' || coalesce(cb.cat, 'N') AS transition, coalesce(ca.vtype, cb.vtype) AS vtype FROM ca FULL JOIN cb USING (key)),
t AS (SELECT CAST(i - 1 AS BIGINT) AS ord, ['{"','".join(C.TRANSITIONS)}'][i] AS transition FROM range(1, 13) r(i))
SELECT ord, transition, count(vtype) FILTER (vtype = 'SNP') AS "SNP", count(vtype) FILTER (vtype = 'INDEL') AS "INDEL" FROM t LEFT JOIN j USING (transition) GROUP BY ALL""")
def call_fate(spark, d):
    return longs(C.fate_counts(C.call_fate(views.calls(spark, d, "a"), views.calls(spark, d, "b"))))


_SIZED = f"""{CALLS}, z AS (SELECT CAST(least(22, greatest(0, size + 11)) AS BIGINT) AS size_idx, cat FROM ca),
bs AS (SELECT CAST(i AS BIGINT) AS size_idx, count(cat) FILTER (cat = 'TP') AS "TP", count(cat) FILTER (cat = 'FN') AS "FN", count(cat) FILTER (cat = 'GT') AS "GT", count(cat) FILTER (cat = 'FP') AS "FP"
  FROM range(23) r(i) LEFT JOIN z ON i = size_idx GROUP BY i)"""


@query(f"WITH {_SIZED} SELECT * FROM bs")
def eval_by_size(spark, d):
    return longs(C.by_size(views.calls(spark, d, "a"), 10))


@query(f"""WITH {_SIZED} SELECT size_idx, CASE WHEN "TP"+"FN"+"GT" > 0 THEN round(("TP"+"GT") / ("TP"+"FN"+"GT"), 9) END AS recall, CASE WHEN "TP"+"FP"+"GT" > 0 THEN round(("TP"+"GT") / ("TP"+"FP"+"GT"), 9) END AS "precision",
  CASE WHEN "TP"+"GT" > 0 THEN round("GT" / ("TP"+"GT"), 9) END AS gt_error FROM bs""")
def precision_recall(spark, d):
    r = C.rates(C.by_size(views.calls(spark, d, "a"), 10))
    return longs(r.select("size_idx", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "gt_error")]))


@query(f"""WITH {_SIZED} SELECT CAST(least(12, greatest(0, size_idx - 11 + 6)) AS BIGINT) AS size_idx, CAST(sum("TP") AS BIGINT) AS "TP", CAST(sum("FN") AS BIGINT) AS "FN", CAST(sum("GT") AS BIGINT) AS "GT", CAST(sum("FP") AS BIGINT) AS "FP" FROM bs GROUP BY 1""")
def eval_fold_tails(spark, d):
    return longs(C.fold_tails(C.by_size(views.calls(spark, d, "a"), 10), 10, 5))


@query(f"WITH {CALLS} SELECT key, 'FN' AS side, size FROM (SELECT key, CAST(size AS BIGINT) AS size FROM ca WHERE cat IN ('FN')) UNION ALL SELECT key, 'FP', CAST(size AS BIGINT) FROM ca WHERE cat = 'FP'")
def split_fp_fn(spark, d):
    a = views.calls(spark, d, "a")
    bd = lambda t, q: F.create_map(F.lit("TRUTH"), F.struct(t.alias("bd")), F.lit("QUERY"), F.struct(q.alias("bd")))
    vcf = a.withColumn("samples", bd(F.when(F.col("cat") == "FN", "FN").otherwise("TP"), F.when(F.col("cat") == "FP", "FP").otherwise("TP")))
    return longs(C.false_negatives(vcf).select("key", F.lit("FN").alias("side"), "size").unionByName(C.false_positives(vcf).select("key", F.lit("FP").alias("side"), "size")))


@query(f"""WITH {VARIANTS}, z AS (SELECT CAST(least(12, greatest(0, length(alt) - length(ref) + 6)) AS BIGINT) AS size_idx FROM vars)
SELECT CAST(i AS BIGINT) AS size_idx, count(size_idx) AS count FROM range(13) r(i) LEFT JOIN z ON i = size_idx GROUP BY i""")
def variant_size_dist(spark, d):
    return longs(C.size_distribution(views.variants(spark, d), 5))


@query(f"""WITH {_SIZED} SELECT CAST(CASE WHEN abs(size_idx - 11) > 10 THEN sign(size_idx - 11) * 5 ELSE sign(size_idx - 11) * ceil(abs(size_idx - 11) / 3.0) END AS BIGINT) AS bin, CAST(sum("TP") AS BIGINT) AS num, CAST(sum("TP" + "FN") AS BIGINT) AS den FROM bs GROUP BY 1""")
def rebin_vsize(spark, d):
    s = C.by_size(views.calls(spark, d, "a"), 10).select("size_idx", F.col("TP").alias("num"), (F.col("TP") + F.col("FN")).alias("den"))
    return longs(C.rebin_sizes(s, 10, 3))


@query()
def binom_ci(spark, d):
    s = C.by_size(views.calls(spark, d, "a"), 10).select("size_idx", F.col("TP").alias("num"), (F.col("TP") + F.col("FN")).alias("den"))
    return C.confidence(s)


# ---- variants ------------------------------------------------------------------------------------------------------------


@query(f"WITH {VARIANTS} SELECT chrom, pos, ref, alt FROM vars WHERE NOT (length(ref) > 1 AND length(alt) > 1)")
def variant_filter_static(spark, d):
    v = views.variants(spark, d)
    return v.where(V.statically_usable(v)).select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))


@query(f"""WITH RECURSIVE {VARIANTS}, o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, ordinal) AS rn FROM vars),
f AS (SELECT chrom, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS e0, CAST(0 AS BIGINT) AS e1, '' AS s0, '' AS s1, false AS keep, CAST(NULL AS BIGINT) AS ordinal FROM (SELECT DISTINCT chrom FROM vars)
UNION ALL SELECT chrom, rn, CASE WHEN keep AND g0 THEN last ELSE e0 END, CASE WHEN keep AND g1 THEN last ELSE e1 END, CASE WHEN keep AND g0 THEN said ELSE s0 END, CASE WHEN keep AND g1 THEN said ELSE s1 END, keep, ordinal FROM (
  SELECT o.chrom, o.rn, o.ordinal, f.e0, f.e1, f.s0, f.s1, o.gt[1] > 0 AS g0, o.gt[2] > 0 AS g1, o.pos + length(o.ref) - 2 AS last, o.pos || '.' || o.ref || '.' || o.alt AS said,
    NOT ((o.gt[1] > 0 AND (o.pos - 1 + CASE WHEN length(o.ref) = 1 AND length(o.alt) = 1 THEN 0 ELSE 1 END <= f.e0 OR f.s0 = o.pos || '.' || o.ref || '.' || o.alt))
      OR (o.gt[2] > 0 AND (o.pos - 1 + CASE WHEN length(o.ref) = 1 AND length(o.alt) = 1 THEN 0 ELSE 1 END <= f.e1 OR f.s1 = o.pos || '.' || o.ref || '.' || o.alt))) AS keep
  FROM f JOIN o ON o.chrom = f.chrom AND o.rn = f.rn + 1))
SELECT chrom, ordinal FROM f WHERE keep""")
def variant_dedupe_greedy(spark, d):
    return V.drop_overlaps(views.variants(spark, d), "chrom").select("chrom", "ordinal")


@query(f"""WITH {VARIANTS}, rg AS (SELECT CAST(c*20 + i AS BIGINT) AS region_idx, 'chr' || c AS chrom, i*700 AS start, i*700 + 900 AS stop FROM range(5) a(c), range(20) b(i))
SELECT ordinal, region_idx FROM vars JOIN rg ON vars.chrom = rg.chrom AND pos - 1 < stop AND pos - 1 + length(ref) > start""")
def region_overlap(spark, d):
    rg = spark.range(5).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    rg = rg.select((F.col("c") * 20 + F.col("i")).alias("region_idx"), F.concat(F.lit("chr"), F.col("c").cast("string")).alias("chrom"), (F.col("i") * 700).cast("long").alias("start"), (F.col("i") * 700 + 900).cast("long").alias("stop"))
    return V.in_regions(views.variants(spark, d), rg).select("ordinal", "region_idx")


# ---- sequences -----------------------------------------------------------------------------------------------------------


@query(f"WITH {SEQUENCES} SELECT doc_id, md5(reverse(translate(seq, 'ATCGN', 'TAGCN'))) AS md5 FROM seqs")
def revcomp(spark, d):
    return views.sequences(spark, d).select("doc_id", F.md5(sq.reverse_complement(F.col("seq"))).alias("md5"))


@query("SELECT doc_id, md5(translate(upper(coalesce(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '')), 'RYSWKMBDHV', 'NNNNNNNNNN')) AS md5 FROM documents")
def sanitize(spark, d):
    t = table(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.md5(sq.sanitize(F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]", "")))).alias("md5"))


@query(f"WITH {SEQUENCES} SELECT doc_id, CASE WHEN length(seq) > 0 THEN round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 9) END AS gc FROM seqs")
def gc_fraction(spark, d):
    return views.sequences(spark, d).select("doc_id", F.round(sq.gc_fraction(F.col("seq")), 9).alias("gc"))


def _entropy_sql(k: int) -> str:
    p = f"((length(seq) - length(replace(seq, m, ''))) // {k}) / (length(seq) - {k} + 1)"
    kmers = "['" + "','".join(sq.kmers(k)) + "']"
    return f"WITH {SEQUENCES}, e AS (SELECT doc_id, seq, list_sum(list_transform({kmers}, lambda m: -({p}) * log2(greatest({p}, 1e-6)))) AS x FROM seqs WHERE length(seq) >= {k}) SELECT doc_id, round(x, 6) AS entropy FROM e"


def _entropy(spark, d, k, f=sq.shannon_entropy):
    return views.sequences(spark, d).where(F.length("seq") >= k).select("doc_id", F.round(f(F.col("seq"), k), 6).alias("entropy"))


@query(_entropy_sql(1))
def entropy_k1(spark, d):
    return _entropy(spark, d, 1)


@query(_entropy_sql(2))
def entropy_k2(spark, d):
    return _entropy(spark, d, 2)


@query(_entropy_sql(4))
def entropy_k4(spark, d):
    return _entropy(spark, d, 4, sq.shannon_entropy_folded)


@query("""WITH s AS (SELECT o_orderkey AS key, translate(CAST(o_orderkey * 7919 AS VARCHAR) || CAST(o_custkey * 104729 AS VARCHAR), '0123456789', 'ACGTACGTAC') AS seq FROM orders)
SELECT key, round((1 + list_sum(list_transform(range(1, length(seq)), lambda k: least(list_unique(list_transform(range(1, length(seq) - k + 2), lambda i: substr(seq, i, k))), pow(4, k))))) /
  (1 + list_sum(list_transform(range(1, length(seq)), lambda k: least(length(seq) - k + 1, pow(4, k))))), 9) AS lc FROM s""")
def linguistic_complexity(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    s = F.translate(F.concat((F.col("o_orderkey") * 7919).cast("string"), (F.col("o_custkey") * 104729).cast("string")), "0123456789", "ACGTACGTAC")
    named = o.select(F.col("o_orderkey").alias("key"), s.alias("seq")).withColumn("_once", F.monotonically_increasing_id())
    return named.select("key", F.round(sq.linguistic_complexity(F.col("seq")), 9).alias("lc"))


# ---- as-of ---------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT user_id, ts, min(event_id) AS next_purchase FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, p.next_purchase FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts""")
def asof_mappability(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    marks = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.min("event_id").alias("value"))
    # at one instant the mark itself counts, so it sorts after its points
    return intervals.asof(e.select("event_id", "user_id", "ts"), marks, "user_id", "ts", "value", "next_purchase", forward=True).select("event_id", "next_purchase")


@query("""WITH p AS (SELECT user_id, ts, min(event_id) AS last_click FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT e.event_id, p.last_click FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_nodes(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    marks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.min("event_id").alias("value"))
    return intervals.asof(e.select("event_id", "user_id", "ts"), marks, "user_id", "ts", "value", "last_click", forward=False).select("event_id", "last_click")


# ---- models --------------------------------------------------------------------------------------------------------------


def _quality_reads(spark, d) -> DataFrame:
    """Qualities that read lengths and keys of lineitem imply: 20 bases, two mates."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return li.select(
        F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(1).alias("mate"), F.concat(F.lit("c"), (F.col("l_partkey") % 3).cast("string")).alias("chrom"),
        F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: ((F.col("l_partkey") + F.col("l_orderkey") * i) % 42).cast("int")).alias("bq"), (F.col("l_quantity").cast("long") * 10 + F.col("l_linenumber")).cast("int").alias("tlen"),
    )


_BQ = """q AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS mate, 'c' || (l_partkey % 3) AS chrom, CAST(i AS BIGINT) AS base, (l_partkey + l_orderkey*i) % 42 AS bq, CAST(CAST(l_quantity AS BIGINT)*10 + l_linenumber AS BIGINT) AS tlen
  FROM lineitem, range(20) r(i)), bc AS (SELECT CAST(mate AS BIGINT) AS mate, base, bq, count(*) AS count FROM q GROUP BY ALL)"""


@query(f"WITH {_BQ} SELECT * FROM bc")
def bq_matrix(spark, d):
    return longs(models.bq_counts(_quality_reads(spark, d), "mate"))


@query(f"WITH {_BQ} SELECT chrom, base, bq, count(*) AS count FROM q GROUP BY ALL")
def bq_by_contig(spark, d):
    return longs(models.bq_counts(_quality_reads(spark, d), "chrom"))


@query(f"WITH {_BQ} SELECT mate, base, bq, round(sum(count) OVER (PARTITION BY mate, base ORDER BY bq ROWS UNBOUNDED PRECEDING) / sum(count) OVER (PARTITION BY mate, base), 9) AS cdf FROM bc")
def cdf_model(spark, d):
    return longs(models.cumulative(models.bq_counts(_quality_reads(spark, d), "mate"), "bq", "mate", "base").select("mate", "base", "bq", F.round("cdf", 9).alias("cdf")))


@query(f"WITH {_BQ} SELECT mate, base, round(sum(bq * count) / (SELECT sum(count) FROM bc b WHERE b.mate = bc.mate AND b.base = 0), 9) AS mean_bq FROM bc GROUP BY mate, base")
def bq_mean_curve(spark, d):
    return longs(models.mean_bq(models.bq_counts(_quality_reads(spark, d), "mate"), "mate").withColumn("mean_bq", F.round("mean_bq", 9)))


@query(f"WITH {_BQ} SELECT tlen, count(*) // 20 AS count FROM q GROUP BY tlen")
def tlen_hist(spark, d):
    return longs(_quality_reads(spark, d).groupBy("tlen").agg(F.count("*").alias("count")))


@query("""WITH r AS (SELECT i AS base, 30 * (1 - exp(-200 * pow(1 - i / 99.0, 2))) AS m FROM range(100) t(i)), w AS (SELECT base, q AS bq, exp(-0.5 * pow((q - m) / 10, 2)) AS w FROM r, range(94) s(q))
SELECT base, bq, round(w / sum(w) OVER (PARTITION BY base), 9) AS p FROM w""")
def synth_model(spark, d):
    return longs(models.synthetic_rows(spark, 100, 30, 200, 10).withColumn("p", F.round("p", 9)))


@query("""WITH s AS (SELECT l_partkey % 4 AS c, (l_orderkey*17 + l_linenumber*3) % 100000 AS a, 50 + l_partkey % 30 AS n FROM lineitem), e AS (SELECT c, a AS p, 1 AS d FROM s UNION ALL SELECT c, a + n, -1 FROM s),
g AS (SELECT c, p, sum(d) AS d FROM e GROUP BY c, p), x AS (SELECT c, p, sum(d) OVER w AS depth, lead(p) OVER w AS nx FROM g WINDOW w AS (PARTITION BY c ORDER BY p))
SELECT CAST(c AS BIGINT) AS c, CAST(sum(depth * (nx - p)) AS BIGINT) AS bases, CAST(sum(CASE WHEN depth > 0 THEN nx - p ELSE 0 END) AS BIGINT) AS covered FROM x WHERE nx IS NOT NULL GROUP BY c""")
def coverage_depth(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    a = (F.col("l_orderkey") * 17 + F.col("l_linenumber") * 3) % 100000
    ends = F.array(F.struct(a.alias("at"), F.lit(1).alias("d")), F.struct((a + 50 + F.col("l_partkey") % 30).alias("at"), F.lit(-1).alias("d")))
    g = li.select((F.col("l_partkey") % 4).alias("c"), F.explode(ends).alias("e")).groupBy("c", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = W.partitionBy("c").orderBy("at")
    x = g.select("c", "at", F.sum("d").over(w).alias("depth"), F.lead("at").over(w).alias("nx")).where("nx IS NOT NULL")
    return x.groupBy("c").agg(F.sum(F.col("depth") * (F.col("nx") - F.col("at"))).alias("bases"), F.sum(F.when(F.col("depth") > 0, F.col("nx") - F.col("at")).otherwise(0)).alias("covered"))
