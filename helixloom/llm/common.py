"""What the training-data operators share: words, tables, and the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; a word is a longest run of anything else.
GAP = r"[\x20\x09-\x0D]+"

_local_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, with the named columns alone (all if none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.size(words(text)).cast("long")


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed columns.

    A plain filter would take over the columns' expressions and evaluate them again, inside lambdas even for each element; Spark
    leaves a filter above a projection that is not deterministic."""
    return df.withColumn("_once", F.monotonically_increasing_id()).where(condition & (F.col("_once") >= 0)).drop("_once")


#: Elements that a running fold copies at most once for each element.
SLICE = 512


def running(a: Column, step, kind: str = "int") -> Column:
    """The running fold of an array by ``step``, from 0: element i holds what elements 0..i give.

    A fold that appends to its own result copies it for each element; here only slices of ``SLICE`` elements grow. ``a`` is a
    column of the input, so that Spark does not evaluate it again in the lambdas."""
    zero, empty = F.lit(0).cast(kind), F.array().cast(f"array<{kind}>")
    slices = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / SLICE).cast("int")), lambda k: F.slice(a, k * SLICE + 1, SLICE))

    def grown(start: Column, part: Column) -> Column:
        more = lambda acc, x: F.struct(step(acc.at, x).cast(kind).alias("at"), F.array_append(acc.out, step(acc.at, x).cast(kind)).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("out")), more).out

    ends = grown(zero, F.transform(slices, lambda s: F.aggregate(s, zero, lambda acc, x: step(acc, x).cast(kind))))
    return F.flatten(F.zip_with(slices, F.concat(F.array(zero), ends), lambda s, start: grown(start, F.coalesce(s, empty))))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set, as in local tests."""
    global _local_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder, and a temporary one would not be seen by all executors")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="helixloom-")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage there.

    A lost executor costs at most a re-read. Returns the table and its path, for ``discard``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no returned DataFrame reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(spark: SparkSession) -> int:
    """Partitions to deal rows out to: the session's own number for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
