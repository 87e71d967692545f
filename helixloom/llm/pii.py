"""Personal data: base patterns, and spans that bootstrapped contexts add. DataFrame functions only.

Candidates are runs of neighbouring words with a digit or ``@``; a word that opens with a quotation mark is a run of its own. The
seeds are candidates that hold a valid base span, and, for the learned kind ``secret``, quoted runs of hexadecimal digits that a
credential's name and ``=`` or ``:`` introduce. The word to the left, the two words to the left, the word to the right, a ``name=``
or ``name:`` prefix and the shape of the value are a candidate's lexical patterns.

Every round, Spark scores the graph of patterns and candidates: a pattern's confidence in a kind is the share of its candidates in
the whole corpus that are seeds of the kind, drawn towards the share of all candidates that are (as if ``PULL`` more had been
seen), so that a few chance hits make no pattern. A candidate's score is one minus the product of its patterns' doubts. Values
that reach ``ACCEPT`` are identifiers wherever they stand and seeds of the next round; rounds end when none is new. A value that
has the form of a base kind and fails its test (a card number by Luhn, an address by its parts) is never accepted for that kind.

Only texts with a digit or ``@`` are searched, each distinct one once. Defined results: null text counts as empty; base spans of
different kinds may overlap and all stay; added spans never overlap base spans; repeated rows each get the same spans; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.llm.common import discard, materialize, running, table, where_once

KINDS = ("email", "ip", "card", "phone")
#: Kinds that are found by contexts alone.
LEARNED = ("secret",)
NAMES = (*KINDS, *LEARNED)
SECRET = len(KINDS)
#: Distinct seed values that a pattern needs in a kind, the least confidence of a pattern and of a value, and the weight of the prior.
SUPPORT, CONFIDENT, ACCEPT, PULL = 5, 0.8, 0.8, 5.0
#: The most that a shape says of a learned kind, which has no test of its own: another pattern must agree.
SHAPE = 0.7
#: Characters that an added value has at least.
SHORTEST = 4

#: The base expressions. Possessive repeats and the look-behinds only keep long runs linear: a run of local-part characters (or
#: of digits) matches from its first character or, after a match that ended inside it, from there; no other start can match.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a whole value looks like that only a base kind's test can decide.
FORMS = {"ip": r"^[0-9]+(?:\.[0-9]+){3}$", "card": r"^[0-9](?:[\x20-]?[0-9])+$", "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$"}
_TOKEN = r"(?!\")[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
#: Runs of neighbouring words that hold a digit or @, or one such word after a quotation mark.
RUN = rf"(?<![^\x20\x09-\x0D])(?:\"[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+|{_TOKEN}(?:[\x20\x09-\x0D]++{_TOKEN})*+)"
#: Seeds of the kind secret: the words before, and the value.
CREDENTIAL = r"(?:^|[^a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key) ?[=:]$"
HEXADECIMAL = "^[0-9a-f]{16,}$"
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def may_hold(text: Column) -> Column:
    """Whether a text has a digit or ``@``, by its bytes alone: null for null."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "@0123456789"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i + 1, F.lit(1)).cast("int")
    part = lambda i: F.when((n - i) % 2 == 1, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return s.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(s)).between(14, 19) & luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _located(df: DataFrame, name: str, text: Column, expression: str, possible: Column) -> DataFrame:
    """Adds ``name``_m, _g and _e: matches, the text before, between and after them, and the code points that end the matches."""
    empty = F.array().cast("array<string>")
    matches, gaps = (F.when(possible, f(text)).otherwise(empty) for f in (lambda t: F.regexp_extract_all(t, F.lit(expression), F.lit(0)), lambda t: F.split(t, expression)))
    df = df.withColumns({f"{name}_m": matches, f"{name}_g": gaps})
    sizes = F.transform(f"{name}_m", lambda m, i: F.length(m) + F.length(F.get(F.col(f"{name}_g"), i)))
    return df.withColumn(f"{name}_n", sizes).withColumn(f"{name}_e", running(F.col(f"{name}_n"), lambda at, n: at + n)).drop(f"{name}_n")


def base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base``: the valid base spans by start, then kind; ``kind`` counts from 0 in the order of KINDS."""
    df = df.withColumn("_t", F.when(may_hold(F.col(text_col)), F.col(text_col)).otherwise(""))
    text, any_ = F.col("_t"), F.col("_t") != ""
    possible = {"email": F.contains(text, F.lit("@")), "ip": any_ & text.rlike(r"[0-9]\.[0-9]"), "card": any_ & text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}
    for kind in KINDS:
        df = _located(df, f"_{kind}", text, EXPRESSIONS[kind], possible[kind])

    def spans(k: int, kind: str) -> Column:
        found = F.zip_with(f"_{kind}_m", f"_{kind}_e", lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(k).alias("kind"), e.alias("stop"), m.alias("m")))
        valid = F.filter(found, lambda x: _valid(kind, x.m))
        return F.transform(valid, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.stop.alias("stop")))

    each = [spans(k, kind) for k, kind in enumerate(KINDS)]
    return df.withColumn("base", F.array_sort(F.concat(*each)).cast(SPAN)).drop("_t", *[f"_{kind}_{x}" for kind in KINDS for x in "mge"])


# ---- candidates and their patterns ---------------------------------------------------------------------------------------


def _spaced(gap: Column) -> Column:
    return F.lower(F.translate(gap, "\t\n\x0b\x0c\r", "     "))


def _last_words(gap: Column, n: int) -> Column:
    """The last n words of a gap, one space between them; fewer if it has no more."""
    end = F.rtrim(F.substring_index(F.rtrim(_spaced(gap)), " ", -8))
    return F.array_join(F.slice(F.concat(F.array_repeat(F.lit(""), F.lit(n)), F.array_remove(F.split(end, " "), "")), -n, n), " ")


def _first_word(gap: Column) -> Column:
    return F.substring_index(F.ltrim(_spaced(gap)), " ", 1)


def shape(value: Column) -> Column:
    """The form of a value: long runs of letters and digits mixed, long, middling and short runs of digits, and words."""
    out = F.regexp_replace(value, "(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[0-9A-Za-z]{16,}", "X")
    for expression, sign in (("[0-9]{13,}", "§"), ("[0-9]{4,12}", "¤"), ("[0-9]{1,3}", "9"), ("[a-z]+", "a"), ("(?<![A-Z])[A-Z](?![A-Z])|[A-Z]{2,}", "A")):
        out = F.regexp_replace(out, expression, sign)
    return out


def candidate_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``runs``: candidates with their own end points (at, end), the span (start, stop) and text of their value, their
    patterns, and whether their form alone makes them a seed of the kind secret.

    The value leaves out a ``name=`` prefix and punctuation at either end."""
    df = df.withColumn("_t", F.when(may_hold(F.col(text_col)), F.col(text_col)).otherwise(""))
    df = _located(df, "_r", F.col("_t"), RUN, F.col("_t") != "")
    prefix, edge = r"^([A-Za-z_-]{2,30}[=:])", r"^[\"'(\[{<]+"

    def run(m: Column, i: Column) -> Column:
        end = F.get(F.col("_r_e"), i)
        named = F.regexp_extract(m, prefix, 1)
        bare = F.substring(m, F.length(named) + 1, F.length(m))
        opened = F.length(F.regexp_extract(bare, edge, 0))
        value = F.regexp_replace(F.substring(bare, opened + 1, F.length(bare)), r"[\"')\]}>,.;:!?#$%&*|]{1,20}$", "")
        start = end - F.length(m) + F.length(named) + opened
        left, two, right = _last_words(F.get(F.col("_r_g"), i), 1), F.ltrim(_last_words(F.get(F.col("_r_g"), i), 2)), _first_word(F.get(F.col("_r_g"), i + 1))
        pattern = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x))
        patterns = F.array(pattern("L:", left), F.when(F.contains(two, F.lit(" ")), F.concat(F.lit("L:"), two)), pattern("R:", right), pattern("P:", F.lower(named)), pattern("S:", shape(value)))
        credential = F.when(named != "", F.lower(named)).otherwise(two).rlike(CREDENTIAL) & value.rlike(HEXADECIMAL)
        return F.struct(
            (end - F.length(m)).alias("at"), end.alias("end"), start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"),
            F.array_distinct(F.filter(patterns, lambda p: p.isNotNull())).alias("patterns"), credential.alias("credential"),
        )

    return df.withColumn("runs", F.transform("_r_m", run)).drop("_t", "_r_m", "_r_g", "_r_e")


def candidates(docs: DataFrame) -> tuple[DataFrame, str]:
    """(k1, k2, start, stop, value, patterns, kind, credential) of the candidates of every distinct text, and the table's path.

    ``kind`` is that of the first base span that starts inside. A base span starts in exactly one run; runs that one reaches over
    from an earlier run are no candidates. Texts meet their spans in a window, not in a fold over the text."""
    held = docs.where(may_hold(F.col("text"))).select("text", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"))
    seen = where_once(candidate_runs(base_spans(held)).select("k1", "k2", "base", "runs"), F.size("runs") > 0).dropDuplicates(["k1", "k2"])
    seen, path = materialize(seen, "pii-runs")
    runs = seen.select("k1", "k2", F.explode("runs").alias("r")).select("k1", "k2", "r.*", F.lit(None).cast("int").alias("kind"), F.lit(0).alias("t"))
    none = {"start": "int", "stop": "int", "value": "string", "patterns": "array<string>", "credential": "boolean"}
    spans = seen.select("k1", "k2", F.explode("base").alias("b")).select("k1", "k2", F.col("b.start").alias("at"), F.col("b.stop").alias("end"), F.col("b.kind").alias("kind"), F.lit(1).alias("t"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    text = W.partitionBy("k1", "k2")
    so_far = text.orderBy("at", "t", "end", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = runs.unionByName(spans).withColumns({"no": F.sum(1 - F.col("t")).over(so_far), "reach": F.max(F.when(F.col("t") == 1, F.col("end"))).over(so_far)})
    run = W.partitionBy("k1", "k2", "no").orderBy("at", "t", "end", "kind").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    marked = both.withColumn("kind", F.first("kind", ignorenulls=True).over(run)).where((F.col("t") == 0) & (F.col("kind").isNotNull() | F.col("reach").isNull() | (F.col("reach") <= F.col("at"))))
    out, own = materialize(marked.select("k1", "k2", "start", "stop", "value", "patterns", "kind", "credential"), "pii-candidates")
    discard(docs.sparkSession, path)
    return out, own


def _refuted(value: Column, kind: Column) -> Column:
    """Whether a value has the form of its base kind and fails that kind's test."""
    return reduce(lambda a, b: a | b, [(kind == KINDS.index(k)) & value.rlike(f) & ~_valid(k, value) for k, f in FORMS.items()])


def discover(found: DataFrame, *, support: int = SUPPORT, confident: float = CONFIDENT, accept: float = ACCEPT) -> DataFrame:
    """(value, akind) of all accepted values. ``found``: candidates, written.

    A round is three aggregations over the candidates, which are a small part of all words; patterns and values stay tables."""
    spark = found.sparkSession
    fresh = found.where(F.col("kind").isNull() & (F.length("value") >= SHORTEST)).select("k1", "k2", "start", "value", "patterns")
    accepted, paths = spark.createDataFrame([], "value string, akind int"), []
    while True:
        own = F.when(F.col("credential"), F.lit(SECRET))
        seeds = found.join(accepted, "value", "left").select("value", "patterns", F.coalesce("kind", "akind", own).alias("seed"))
        seeds, seeds_path = materialize(seeds, "pii-seeds")
        counts = {r["seed"]: r["count"] for r in seeds.groupBy("seed").count().collect()}  # one row a kind
        total = sum(counts.values())
        prior = F.create_map(*[x for k in range(len(NAMES)) for x in (F.lit(k), F.lit(counts.get(k, 0) / max(1, total)))])
        edges = seeds.select("value", "seed", F.explode("patterns").alias("pattern"))
        by_kind = edges.groupBy("pattern", "seed").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))
        sums = by_kind.groupBy("pattern").agg(F.sum("n").alias("total"))
        confidence = (F.col("n") + PULL * F.element_at(prior, F.col("akind"))) / (F.col("total") + PULL)
        confidence = F.when(F.col("pattern").startswith("S:") & (F.col("akind") >= SECRET), F.least(F.lit(SHAPE), confidence)).otherwise(confidence)
        strong = by_kind.where(F.col("seed").isNotNull() & (F.col("values") >= support)).join(sums, "pattern").withColumnRenamed("seed", "akind")
        strong = strong.select("pattern", "akind", confidence.alias("confidence")).where((F.col("confidence") >= confident) | F.col("pattern").startswith("S:") & (F.col("confidence") >= SHAPE))
        strong, strong_path = materialize(strong, "pii-patterns")
        # one minus the product of doubts; a doubt is above 0 by the prior, held there so that the logarithm exists
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        edge = fresh.select("k1", "k2", "start", "value", F.explode("patterns").alias("pattern")).join(strong, "pattern").where(~_refuted(F.col("value"), F.col("akind")))
        rated = edge.groupBy("k1", "k2", "start", "value", "akind").agg((1 - F.exp(doubt)).alias("score")).where(F.col("score") >= accept)
        best = rated.groupBy("value").agg(F.max_by("akind", F.struct("score", -F.col("akind"))).alias("akind"))
        new, path = materialize(best.join(accepted, "value", "left_anti"), "pii-accepted")
        discard(spark, seeds_path, strong_path)
        paths.append(path)
        if new.isEmpty():
            return accepted
        accepted = accepted.unionByName(new)


def added_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, _more) of the texts that contexts add spans to, written; texts are named by two hashes."""
    found, path = candidates(docs)
    spans = found.where("kind IS NULL").join(discover(found), "value").select("k1", "k2", "start", F.col("akind").alias("kind"), "stop")
    more, _ = materialize(spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).cast(SPAN).alias("_more")), "pii-added")
    discard(docs.sparkSession, path)
    return more


def held_out(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """(kind, hidden, found, wrong): of one in so many seed values by hash, kept from seeding, how many distinct ones the contexts
    find again with their kind, and how many with another one."""
    found, _ = candidates(docs)
    hide = F.pmod(F.xxhash64("value", F.lit(3)), F.lit(one_in)) == 0
    kind = F.coalesce("kind", F.when(F.col("credential"), F.lit(SECRET)))
    blind, _ = materialize(found.withColumns({"kind": F.when(~hide, F.col("kind")), "credential": F.col("credential") & ~hide}), "pii-blind")
    truth = found.where(kind.isNotNull() & hide).select("value", kind.alias("k")).distinct()
    match = truth.join(discover(blind), "value", "left")
    named = F.get(F.array(*map(F.lit, NAMES)), F.col("k")).alias("kind")
    return match.groupBy(named).agg(F.count("*").alias("hidden"), F.count_if(F.col("akind") == F.col("k")).alias("found"), F.count_if(F.col("akind") != F.col("k")).alias("wrong"))


# ---- results -------------------------------------------------------------------------------------------------------------


def detect(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(_row, base, spans): the named columns as a struct, base spans and all spans, of every row of ``docs`` (with ``text``).

    Spans depend on the text alone, so what contexts add meets the rows by two hashes of the text. Rows that can hold no span take
    no part in that join."""
    none = F.array().cast(SPAN)
    more = added_spans(docs.select("text"))
    held = F.coalesce(may_hold(F.col("text")), F.lit(False))
    rest = docs.where(~held).select(F.struct(*columns).alias("_row"), none.alias("base"), none.alias("spans"))
    based = base_spans(docs.where(held).select(F.struct(*columns).alias("_row"), "text", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"))).drop("text")
    both = F.array_sort(F.concat("base", F.coalesce("_more", none)))
    return based.join(more, ["k1", "k2"], "left").select("_row", "base", both.alias("spans")).unionByName(rest)


def written(spans: Column | str) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")


def redact(df: DataFrame, text: Column, spans: str, out: str) -> DataFrame:
    """Adds ``out``: the text with each span, or stretch of overlapping spans, replaced by its first kind in brackets.

    A stretch begins where no earlier span reaches; the text is put together from the pieces between stretches at once."""
    names, last = F.array(*map(F.lit, NAMES)), F.length(text)
    df = df.withColumn("_stops", F.transform(spans, lambda s: s.stop)).withColumn("_reach", running(F.col("_stops"), lambda a, b: F.greatest(a, b)))
    # (start, kind, where the text goes on after what came before) of the first span of each stretch
    heads = F.filter(F.transform(spans, lambda s, i: F.struct(s.start.alias("start"), s.kind.alias("kind"), F.when(i == 0, 0).otherwise(F.get(F.col("_reach"), i - 1)).alias("from"))), lambda h: h.start >= h["from"])
    pieces = F.transform(heads, lambda h: F.concat(F.substring(text, h["from"] + 1, h.start - h["from"]), F.lit("["), F.upper(F.get(names, h.kind)), F.lit("]")))
    whole = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at("_reach", -1) + 1, last))
    return df.withColumn(out, F.when(F.size(spans) == 0, text).otherwise(whole)).drop("_stops", "_reach")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all spans of personal data replaced; the columns stay as they are."""
    out = redact(detect(docs, tuple(docs.columns)), F.col("_row.text"), "spans", "_clean")
    return out.select(*[F.col("_clean").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents", "doc_id", "text"))

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [number(k) for k in range(len(KINDS))]
    return out.select("_row.doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
