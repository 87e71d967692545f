"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Words and word pairs hash to ``buckets`` counters. Two multinomials are counted over them: the raw corpus (every document) and
the trusted target (documents labelled good). A document's score is the mean over its n-grams of log p_target - log p_raw, so
length cancels out. The threshold is calibrated once on labelled documents that the target model has not seen, and the verdict
is score >= threshold for every document, without randomness. DataFrame functions only.

All labels count: by a hash of their ids one half of the good documents makes the target model, the other half and all bad ones
place the threshold. Raw counts cover all documents. Labels meet texts once, for the target model; the threshold comes from a
narrow table of all scores.

Defined results: null or empty text has no words and fails the base rules; repeated rows and ties get equal verdicts; without
labels the ratio is zero everywhere and only the base rules decide; an empty table gives an empty result; only the id and text
columns are read, others pass through ``quality_filter`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import discard, materialize, table, where_once, words

BUCKETS = 1 << 15
#: Share of trusted calibration documents that the threshold must keep.
KEEP_TRUSTED = 0.995
#: Weight of one unseen event in both multinomials.
PRIOR = 1.0
WINDOW = 5


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def _windows(h: Column, n: int) -> Column:
    """Hashes of the windows of n neighbours of an array of hashes; empty if it is shorter."""
    index = F.sequence(F.lit(0), F.size(h) - n)
    return F.when(F.size(h) >= n, F.transform(index, lambda i: F.xxhash64(*[_at(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _order(w: Column) -> Column:
    """(hash, position) of the windows, equal hashes side by side."""
    return F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated(order: str) -> Column:
    """Positions, ascending, of the windows whose hash occurs twice or more."""
    near = lambda x, k: F.coalesce(_at(F.col(order), k).h == x.h, F.lit(False))
    places = F.transform(order, lambda x, k: F.when(near(x, k - 1) | near(x, k + 1), x.i))
    return F.array_sort(F.filter(places, lambda i: i.isNotNull()))


def base_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and ``_h``, the word hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    h5 = _windows(F.col("_h"), WINDOW)
    repeats = F.size("_w") > F.size(F.array_distinct("_w"))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    last = F.size("_p") - 1
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.when(k == last, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), _at(F.col("_p"), k + 1) - p))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return (
        df.withColumns({
            "_h": _hashes(F.col(text_col)),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "_lines": lines,
        })
        .withColumns({"_w": h5, "n_words": F.size("_h").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
        .withColumn("_order", F.when(repeats, _order(F.col("_w"))).otherwise(empty))
        .withColumn("_p", _repeated("_order"))
        .withColumn("n_repeat_words", covered)
        .drop("_lines", "_w", "_order", "_p")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _grams(h: Column, buckets: int) -> Column:
    """Buckets of all words and word pairs."""
    return F.transform(F.concat(h, _windows(h, 2)), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def label_roles(labels: DataFrame) -> DataFrame:
    """(doc_id, role) of every labelled id: role 0 for the target model, 1 trusted and 2 bad for the threshold."""
    kinds = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    return kinds.where("quality IN (0, 1)").select("doc_id", F.when(F.col("quality") == 1, good).otherwise(2).alias("role"))


def fit_ratio(docs: DataFrame, roles: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio) for every bucket: log p_target - log p_raw. Each task shuffles at most ``buckets`` counts.

    Texts go once to where their labels are, whatever the number of labels; labels are the side that is held."""
    spark = docs.sparkSession

    def counts(texts: DataFrame) -> DataFrame:
        return texts.select(_hashes(F.col("text")).alias("_h")).select(F.explode(_grams(F.col("_h"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))

    zero_long = F.lit(0).cast("long")
    raw = counts(docs).select("bucket", F.col("n").alias("raw"), zero_long.alias("target"))
    target = counts(docs.join(roles.where("role = 0").select("doc_id").hint("shuffle_hash"), "doc_id")).select("bucket", zero_long.alias("raw"), F.col("n").alias("target"))
    zero = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    full = raw.unionByName(target).unionByName(zero).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    kept, path = materialize(full, "ngram-counts")
    total = kept.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()  # one row
    total_raw, total_target = total["raw"] or 0, total["target"] or 0
    share = lambda c, n: (F.col(c) + PRIOR) / F.lit(float(n + PRIOR * buckets))
    ratio = F.log(share("target", total_target)) - F.log(share("raw", total_raw)) if total_target else F.lit(0.0)
    out, _ = materialize(kept.select("bucket", ratio.alias("ratio")), "ngram-ratio")
    discard(spark, path)
    return out


def dense_ratio(ratio: DataFrame) -> Column:
    """The ratios by bucket as one array; ``ratio`` has ``buckets`` rows, a parameter, whatever the corpus.

    A subquery: as a literal the array would stand in every plan that the driver prints."""
    return ratio.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x.ratio).alias("dense")).scalar()


def with_score(df: DataFrame, dense: Column, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``score`` to rows with word hashes ``_h``: the mean log ratio over words and pairs, 0 without words."""
    total = F.aggregate("_g", F.lit(0.0), lambda a, b: a + F.get("_dense", b))
    given = df.withColumn("_g", _grams(F.col("_h"), buckets)).withColumn("_dense", dense)
    return given.withColumn("score", F.round(total / F.greatest(F.lit(1), F.size("_g")), 9)).drop("_g", "_dense")


def threshold(scored: DataFrame, keep: float = KEEP_TRUSTED) -> float:
    """The quantile of trusted scores that keeps ``keep`` of them, or, where a bad document lies below it, the middle between both.

    ``scored``: (score, role) of all held-out documents. No threshold without trusted documents."""
    lows = scored.where("role = 1").agg(F.percentile("score", F.lit(1 - keep)).alias("low"), F.min("score").alias("least")).first()
    if lows is None or lows["low"] is None:
        return float("-inf")
    at = float(lows["low"])
    # the best bad score below the quantile
    bad = scored.where((F.col("role") == 2) & (F.col("score") < at)).agg(F.max("score").alias("top")).first()["top"]
    return at if bad is None else (at + float(bad)) / 2


def _fit(docs: DataFrame, labels: DataFrame, buckets: int) -> tuple[Column, DataFrame]:
    """The ratios, and the roles of labelled ids, written."""
    roles, _ = materialize(label_roles(labels.select("doc_id", "quality")), "label-roles")
    return dense_ratio(fit_ratio(docs.select("doc_id", "text"), roles, buckets)), roles


def _place(scored: DataFrame, roles: DataFrame) -> float:
    """The threshold of all documents with a role and ten words; ``scored``: (doc_id, score, n_words), written."""
    return threshold(scored.where("n_words >= 10").join(roles.where("role > 0"), "doc_id").select("score", "role"))


def _verdict(scored: DataFrame, at: float) -> DataFrame:
    return scored.withColumn("base_failed", base_failed()).withColumn("threshold", F.lit(at)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(at)))


def judge(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its base features, base_failed, score, threshold and kept; all columns of ``docs`` stay."""
    ratio, roles = _fit(docs, labels, buckets)
    narrow = docs.select("doc_id", _hashes(F.col("text")).alias("_h"))
    scored, path = materialize(with_score(narrow, ratio, buckets).select("doc_id", "score", F.size("_h").alias("n_words")), "scores")
    at = _place(scored, roles)
    discard(docs.sparkSession, path)
    return _verdict(with_score(base_features(docs), ratio, buckets).drop("_h"), at)


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents, with their columns."""
    return where_once(judge(docs, labels), F.col("kept")).select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``judge``, with the scores that the threshold is placed on written once for the result too: no text goes into it."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ratio, roles = _fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), BUCKETS)
    scored, _ = materialize(with_score(base_features(docs), ratio).drop("_h", "text"), "scores")
    out = _verdict(scored, _place(scored, roles))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
