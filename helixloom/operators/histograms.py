"""Histograms of displacement, mapping quality and variant size, and what reports read off them.

All histograms are sparse long tables; marginals and rebins are group-bys over them. Dense tables join a scaffold."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.functions import bins
from helixloom.functions.scoring import correct_tlen
from helixloom.functions.variants import DISPLACEMENT_CLASSES, VARIANT_CLASSES, displacement_class, variant_class

INF = math.inf


def _count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("count"))


def hist3d(reads: DataFrame, *, max_d: int = 200, max_mq: int = 70, max_v: int = 60) -> DataFrame:
    """(xd, mq, v, count): a read with n variants counts n times, one without in slot 0."""
    sizes = F.when(F.size("v_list") == 0, F.array(F.lit(0))).otherwise(F.transform("v_list", lambda v: bins.histogram_v_index(v, max_v)))
    return _count(reads.select((F.col("d_err") + max_d).alias("xd"), F.least(F.col("mq"), F.lit(max_mq)).alias("mq"), F.explode(sizes).alias("v")), "xd", "mq", "v")


def dmv(reads: DataFrame, *, max_d: int = 200, max_mq: int = 70, max_v: int = 60, legacy: bool = False) -> DataFrame:
    """(xd, mq, v, count) with slots -max_v .. max_v at 0 .. 2*max_v, reference reads at 2*max_v+1 and, at 2*max_v+2, each read once.

    ``legacy`` puts every insertion into the slot of substitutions."""
    slot = (lambda v: F.least(F.lit(max_v), F.greatest(F.lit(0), v + max_v))) if legacy else (lambda v: bins.clamp(v + max_v, 0, 2 * max_v))
    ref, margin = F.lit(2 * max_v + 1), F.lit(2 * max_v + 2)
    slots = F.array_append(F.when(F.size("v_list") == 0, F.array(ref)).otherwise(F.transform("v_list", slot)), margin)
    return _count(reads.select((F.col("d_err") + max_d).alias("xd"), F.least(F.col("mq"), F.lit(max_mq)).alias("mq"), F.explode(slots).alias("v")), "xd", "mq", "v")


D_EDGES = (-INF, -100, -40, -20, -10, -5, 0, 1, 6, 11, 21, 41, 101, 200, 201, 202, INF)
#: Default edges of the eight dimensions of a template: displacement, quality and size of both mates, template length and its error.
EDGES: dict[str, Sequence[float]] = {
    "xd1": D_EDGES, "xd2": D_EDGES, "mq1": (0, 1, 11, 21, 31, 41, 51, INF), "mq2": (0, 1, 11, 21, 31, 41, 51, INF),
    "v1": (-INF, -20, 0, 1, 21, 51, INF), "v2": (-INF, -20, 0, 1, 21, 51, INF),
    "xt": (-INF, -100, -40, -20, -10, -5, 0, 1, 6, 11, 21, 41, 101, INF), "t": (-INF, 200, 301, 401, 601, INF),
}


def template_measures(templates: DataFrame, max_v: int = 50) -> DataFrame:
    """The eight measures of paired templates (m1, m2 with truth and d_err)."""
    t = correct_tlen(F.col("m1.truth"), F.col("m2.truth"))
    each = {f"{n}{k}": e for k in (1, 2) for n, e in (("xd", F.col(f"m{k}.d_err")), ("mq", F.col(f"m{k}.mq")), ("v", bins.v_scalar(F.col(f"m{k}.truth.v_list"), max_v)))}
    return templates.select(*[e.alias(n) for n, e in each.items()], (F.abs("m1.tlen") - t).alias("xt"), t.alias("t"))


def hist_nd(measures: DataFrame, edges: dict[str, Sequence[float]] = EDGES) -> DataFrame:
    """Counts by bin index of every dimension in ``edges``; measures beyond the edges go to the end bins."""
    return _count(measures.select(*[bins.digitize(F.col(d), e).alias(d) for d, e in edges.items()]), *edges)


def collapse(hist: DataFrame, **dims) -> DataFrame:
    """Marginal: a dimension given as None stays, one given as (i, j) is cut to i <= index < j and summed, others are summed."""
    for d, cut in dims.items():
        if cut is not None:
            hist = hist.where((F.col(d) >= cut[0]) & (F.col(d) < cut[1]))
    return hist.groupBy(*[d for d, cut in dims.items() if cut is None]).agg(F.sum("count").alias("count"))


def all_marginals(hist: DataFrame, *dims: str) -> DataFrame:
    """Every marginal of the named dimensions in one pass; summed ones are null and told by ``gid``."""
    return hist.cube(*dims).agg(F.sum("count").alias("count"), F.grouping_id().alias("gid"))


def add_up(*hists: DataFrame) -> DataFrame:
    """Sum of histograms, cell by cell."""
    out = hists[0]
    for h in hists[1:]:
        out = out.unionByName(h)
    return out.groupBy(*[c for c in hists[0].columns if c != "count"]).agg(F.sum("count").alias("count"))


# ---- read off (d_err, mq, v, count) --------------------------------------------------------------------------------------


def _sum_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("count")).otherwise(0))


def p_err(hist: DataFrame, margin: int = 0) -> DataFrame:
    """(mq, p_err): share of reads not within the margin."""
    total = F.greatest(F.lit(1), F.sum("count"))
    return hist.groupBy("mq").agg(((F.sum("count") - _sum_if(F.abs("d_err") <= margin)) / total).alias("p_err"))


def mean_mq(hist: DataFrame) -> DataFrame:
    """(d_err, mean_mq)."""
    return hist.groupBy("d_err").agg((F.sum(F.col("mq") * F.col("count")) / F.greatest(F.lit(1), F.sum("count"))).alias("mean_mq"))


def rebin_mq(hist: DataFrame, d_width: int, v_width: int) -> DataFrame:
    """(d_bin, v_bin, mean_mq, count) over bins that keep zero apart."""
    b = hist.select(bins.signed_bin(F.col("d_err"), d_width).alias("d_bin"), bins.signed_bin(F.col("v"), v_width).alias("v_bin"), "mq", "count")
    return b.groupBy("d_bin", "v_bin").agg((F.sum(F.col("mq") * F.col("count")) / F.greatest(F.lit(1), F.sum("count"))).alias("mean_mq"), F.sum("count").alias("count"))


def read_fate(hist: DataFrame, max_d: int = 200, margin: int = 50) -> DataFrame:
    """(fate, count) of the five fates; the margin is held to max_d."""
    m, a = min(margin, max_d), F.abs("d_err")
    fate = F.when(F.col("d_err") == max_d + 2, "unmapped").when(F.col("d_err") == max_d + 1, "wrong_chrom").when(F.col("d_err") == 0, "correct").when(a <= m, "near").otherwise("far")
    return hist.groupBy(fate.alias("fate")).agg(F.sum("count").alias("count"))


def accuracy_by_size(hist: DataFrame, threshold: int) -> DataFrame:
    """(v, num, den) over reads with variants (v not null)."""
    return hist.where("v IS NOT NULL").groupBy("v").agg(_sum_if(F.abs("d_err") <= threshold).alias("num"), F.sum("count").alias("den"))


def counts_by(hist: DataFrame, column: str) -> DataFrame:
    return hist.groupBy(column).agg(F.sum("count").alias("count"))


def roc(hist: DataFrame, margin: int, max_d: int = 200) -> DataFrame:
    """(mq, wrong, mapped, total) over reads of that quality or better; a displacement of +margin counts as wrong, -margin does not.

    The window runs over one row a quality."""
    wrong = (F.col("d_err") != max_d + 2) & ((F.col("d_err") < -margin) | (F.col("d_err") >= margin))
    by_mq = hist.groupBy("mq").agg(_sum_if(wrong).alias("w"), _sum_if(F.col("d_err") != max_d + 2).alias("m"), F.sum("count").alias("t"))
    up = W.orderBy("mq").rowsBetween(W.currentRow, W.unboundedFollowing)
    return by_mq.select("mq", F.sum("w").over(up).alias("wrong"), F.sum("m").over(up).alias("mapped"), F.sum("t").over(W.partitionBy()).alias("total"))


# ---- category tables -----------------------------------------------------------------------------------------------------


def category_table(reads: DataFrame, max_mq: int = 60, max_d: int = 200) -> DataFrame:
    """(category, mq, derr, count) of all 9 x (max_mq + 1) x 5 cells, empty ones too."""
    spark = reads.sparkSession
    found = _count(reads.select(variant_class(F.col("v_list")).alias("category"), F.least(F.col("mq"), F.lit(max_mq)).alias("mq"), displacement_class(F.col("d_err"), max_d).alias("derr")), "category", "mq", "derr")
    each = lambda labels: F.explode(F.array(*map(F.lit, labels)))
    cells = spark.range(max_mq + 1).select(F.col("id").cast("int").alias("mq"), each(VARIANT_CLASSES).alias("category")).select("*", each(DISPLACEMENT_CLASSES).alias("derr"))
    return cells.join(found, ["category", "mq", "derr"], "left").select("category", "mq", "derr", F.coalesce("count", F.lit(0)).alias("count"))


def report_by_mq(categories: DataFrame) -> DataFrame:
    """(mq, correct_0, correct_50, total, perr_0, perr_50, perr_ideal)."""
    by = categories.groupBy("mq").agg(_sum_if(F.col("derr") == "0").alias("correct_0"), _sum_if(F.col("derr").isin("0", "<=50")).alias("correct_50"), F.sum("count").alias("total"))
    share = lambda c: F.when(F.col("total") > 0, 1 - F.col(c) / F.col("total"))
    return by.withColumns({"perr_0": share("correct_0"), "perr_50": share("correct_50"), "perr_ideal": F.pow(F.lit(10.0), -F.col("mq") / 10)})


def report_fate(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category", "derr").agg(F.sum("count").alias("count"))


def scaffold(spark: SparkSession, found: DataFrame, key: str, n: int, *counts: str) -> DataFrame:
    """All of 0 .. n-1 for an index column, counts 0 where nothing was found."""
    return spark.range(n).select(F.col("id").cast("int").alias(key)).join(found, key, "left").select(key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
