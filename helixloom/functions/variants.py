"""Variant expressions: classes, sizes, categories and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of a pair of benchmark decisions (truth sample, query sample); TP, FN, FP, GT, or skip.
DECISIONS = {
    "TPTP": "TP", "TP.": "TP", "TPFP": "TP", ".FP": "FP", "FN.": "FN", "FNFP": "GT",
    ".TP": "skip", "FNTP": "skip", "N.": "skip", ".N": "skip", "NN": "skip",
}
#: Labels of variant and displacement classes, in report order.
VARIANT_CLASSES = ("Ref", "Multi", "SNP", "DEL<=10", "DEL 11-50", "INS<=10", "INS 11-50", "DEL>50", "INS>50")
DISPLACEMENT_CLASSES = ("0", "<=50", "50<200", "WC", "UM")


def classify(ref: Column, alt: Column) -> Column:
    """struct(op, n): X for a substitution, I or D with the inserted or deleted length; others are an error."""
    r, a = F.length(ref), F.length(alt)
    bad = F.raise_error(F.concat_ws(" ", F.lit("complex variant"), ref, alt))
    op = F.when((r == 1) & (a == 1), "X").when(r == 1, "I").when(a == 1, "D").otherwise(bad.cast("string"))
    return F.struct(op.alias("op"), F.when((r == 1) & (a == 1), 0).when(r == 1, a - 1).otherwise(r - 1).alias("n"))


def signed_size(ref: Column, alt: Column) -> Column:
    return F.length(alt) - F.length(ref)


def decision(truth_bd: Column, query_bd: Column) -> Column:
    """TP, FN, FP, GT or skip; null for unknown pairs."""
    table = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    return F.element_at(table, F.concat(F.coalesce(truth_bd, F.lit(".")), F.coalesce(query_bd, F.lit("."))))


def called_alt(category: Column, alts: Column, truth_gt: Column, query_gt: Column) -> Column:
    """The first allele carried by the sample that decides: the query for FP, else the truth."""
    first = lambda gt: F.get(F.filter(gt, lambda g: g > 0), F.lit(0))
    return F.get(alts, F.when(category == "FP", first(query_gt)).otherwise(first(truth_gt)) - 1)


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(".", chrom, pos.cast("string"), ref, alt)


def in_region(regions: Column, name: str | None) -> Column:
    return F.lit(True) if name is None else F.coalesce(F.array_contains(F.split(regions, ","), name), F.lit(False))


def variant_class(v_list: Column) -> Column:
    """One of the nine classes of the variants of a read."""
    v = F.get(v_list, F.lit(0))
    return (
        F.when(F.size(v_list) == 0, "Ref").when(F.size(v_list) > 1, "Multi").when(v == 0, "SNP").when(v < -50, "DEL>50").when(v < -10, "DEL 11-50").when(v < 0, "DEL<=10")
        .when(v <= 10, "INS<=10").when(v <= 50, "INS 11-50").otherwise("INS>50")
    )


def displacement_class(d: Column, max_d: int = 200) -> Column:
    a = F.abs(d)
    return F.when(d == 0, "0").when(a <= 50, "<=50").when(a < max_d + 1, "50<200").when(d == max_d + 1, "WC").otherwise("UM")


def genotype_shares(af: Column) -> Column:
    """Shares of 0|0, 0|1, 1|0 and 1|1 at an allele frequency."""
    return F.array(1 - af * (1 + af), af / 2, af / 2, af * af)


def genotype_text(gt: Column, phased: Column) -> Column:
    """Alleles joined by | or /, a dot for a missing one."""
    alleles = F.transform(gt, lambda g: F.coalesce(g.cast("string"), F.lit(".")))
    return F.when(phased, F.array_join(alleles, "|")).otherwise(F.array_join(alleles, "/"))


def info_text(vtype: Column, regions: Column) -> Column:
    return F.concat(F.lit("Vtype="), vtype, F.lit(";Regions="), F.coalesce(regions, F.lit("")))


def membership_label(code: Column, n: int) -> Column:
    """The cell of a Venn diagram: A is the highest bit, ``(X)`` the complement of X."""
    return F.concat(*[F.when(F.shiftright(code.cast("int"), n - 1 - k).bitwiseAND(1) == 1, chr(65 + k)).otherwise(f"({chr(65 + k)})") for k in range(n)])
