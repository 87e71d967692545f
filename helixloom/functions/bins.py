"""Bins of displacements, mapping qualities and variant sizes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def size_index(size: Column, most: int) -> Column:
    """0 for below -most, 1 .. 2*most+1 for -most .. most, 2*most+2 above."""
    return clamp(size + most + 1, 0, 2 * most + 2)


def histogram_v_index(v: Column, most: int) -> Column:
    """Slot of a variant size in the 3-D histogram, where slot 0 is kept for reference reads."""
    return clamp(v + most + 2, 1, 2 * most + 3)


def v_scalar(v_list: Column, most: int) -> Column:
    """One number for a read's variants: none is most+1, one is itself held to +-most, more are most+2."""
    return F.when(F.size(v_list) == 0, most + 1).when(F.size(v_list) > 1, most + 2).otherwise(clamp(F.get(v_list, F.lit(0)), -most, most))


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """Index of the left-closed bin that holds x; values beyond the edges go to the end bins."""
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    return F.size(F.filter(inner, lambda e: e <= x.cast("double")))


def signed_bin(x: Column, width: int) -> Column:
    """Bins of a width on either side, zero alone: 1..width is 1, -width..-1 is -1."""
    return F.when(x > 0, F.ceil(x / width)).when(x < 0, F.floor(x / width)).otherwise(0).cast("int")


def bin_table(spark: SparkSession, dims: dict[str, Sequence[float]]) -> DataFrame:
    """(dim, idx, label, lo, hi, center) of every bin."""
    text = lambda v: f"{round(v, 2):g}" if math.isfinite(v) else str(v)
    rows = [(d, k, f"{text(lo)} <= {d} < {text(hi)}", float(lo), float(hi), (lo + hi) / 2 if math.isfinite(lo + hi) else float("nan")) for d, e in dims.items() for k, (lo, hi) in enumerate(zip(e, e[1:], strict=False))]
    return spark.createDataFrame(rows, "dim string, idx int, label string, lo double, hi double, center double")
