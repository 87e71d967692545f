"""Writers of the text formats and of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import qname as qn


def lines(df: DataFrame, line: Column, path: str, order: tuple[str, ...] = (), header: list[str] | None = None) -> None:
    """One text line a row, sorted over the whole table where ``order`` is given; a header is a file of its own that sorts first."""
    if order:
        df = df.orderBy(*order)
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    if header:
        spark = df.sparkSession
        head = spark.createDataFrame([(h,) for h in header], "value string")
        head.coalesce(1).write.mode("append").text(f"{path}/_header")


def fastq_rows(templates: DataFrame, longest: int = qn.LONGEST) -> tuple[DataFrame, DataFrame]:
    """(records, sidecar lines) of templates (ordinal, sample, chrom, cpy, mates with strand, pos, cigar, v_list, md, seq, qual).

    Records are (ordinal, file, name, seq, qual). The name with its @ is cut beyond ``longest``, and then the sidecar has it whole."""
    name = F.concat(F.lit("@"), qn.assemble(qn.serial(F.col("ordinal")), F.col("sample"), F.col("chrom"), F.col("cpy"), F.col("mates")))
    named = templates.withColumn("whole", name).withColumn("name", F.substring("whole", 1, longest))
    records = named.select("ordinal", "name", F.posexplode("mates").alias("file", "m")).select("ordinal", "file", "name", F.col("m.seq").alias("seq"), F.col("m.qual").alias("qual"))
    return records, named.where(F.length("whole") > longest).select(F.col("whole").alias("value"))


def write_fastq(records: DataFrame, path: str) -> None:
    """One directory, ``file=0`` and ``file=1`` below it, records in order."""
    text = F.concat_ws("\n", "name", "seq", F.lit("+"), "qual")
    records.orderBy("file", "ordinal").select("file", text.alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def write_aaf(reads: DataFrame, path: str) -> None:
    """Contig, 0-based position, displacement, quality, sizes; sorted by place."""
    row = reads.select(F.coalesce("chrom", F.lit("*")).alias("chrom"), "pos", "d_err", "mq", F.array_join(F.col("v_list").cast("array<string>"), ";").alias("v"))
    row.orderBy("chrom", "pos").write.mode("overwrite").csv(path, sep="\t", emptyValue="")


def sam_line() -> Column:
    """The SAM line of a read."""
    tags = F.array_join(F.transform(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws(":", e.key, F.when(e.value.rlike(r"^-?\d+$"), "i").otherwise("Z"), e.value)), "\t")
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    head = F.concat_ws("\t", "qname", F.col("flag").cast("string"), star("chrom"), (F.col("pos") + 1).cast("string"), F.col("mq").cast("string"), star("cigar"), star("next_chrom"), (F.coalesce("next_pos", F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), star("seq"), star("qual"))
    return F.when(tags == "", head).otherwise(F.concat_ws("\t", head, tags))


def write_sam(reads: DataFrame, contigs: DataFrame, path: str) -> None:
    """Reads in header order of contigs, then by position, unmapped last."""
    order = reads.join(contigs.select("chrom", "idx"), "chrom", "left").withColumn("idx", F.coalesce("idx", F.lit(1 << 30)))
    header = ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{r['chrom']}\tLN:{r['length']}" for r in contigs.where("idx >= 0").orderBy("idx").collect()]]
    lines(order, sam_line(), path, ("idx", "pos", "qname"), header)


def write_partitions(reads: DataFrame, path: str) -> None:
    """Parquet, one directory for each partition and source, sorted by place within files."""
    reads.sortWithinPartitions("chrom", "pos").write.mode("overwrite").partitionBy("partition", "src").parquet(path)


def vcf_line(samples: list[str]) -> Column:
    """The VCF line of a variant with genotypes as text in columns named by sample."""
    dot = lambda c: F.coalesce(c, F.lit("."))
    return F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot(F.col("id")), "ref", dot(F.array_join("alts", ",")), F.lit("."), F.lit("PASS"), dot(F.col("info_text")), F.lit("GT"), *samples)


def vcf_header(contigs: list[tuple[str, int]], samples: list[str], info: dict[str, str] | None = None) -> list[str]:
    out = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    out += [f'##INFO=<ID={k},Number=1,Type=Float,Description="{v}">' for k, v in (info or {}).items()]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def write_vcf(variants: DataFrame, path: str, samples: list[str], header: list[str]) -> None:
    lines(variants, vcf_line(samples), path, ("chrom", "pos", "ordinal"), header)


def write_bed(regions: DataFrame, path: str) -> None:
    regions.select("chrom", "start", "stop").orderBy("chrom", "start").write.mode("overwrite").csv(path, sep="\t")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def discard_rows(df: DataFrame) -> None:
    """Runs a plan for its side effects and counts."""
    df.write.format("noop").mode("overwrite").save()


def html_report(title: str, images: dict[str, bytes], text: str = "") -> str:
    """A page with images as data URIs."""
    import base64
    import html

    figures = "".join(f'<h2>{html.escape(n)}</h2><img src="data:image/png;base64,{base64.b64encode(b).decode()}">' for n, b in images.items())
    return f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title></head><body><pre>{html.escape(text)}</pre>{figures}</body></html>"
