"""Quality rules with thresholds that adapt to each language and source.

Every measure of a document is a whole number (a ratio in ten-thousandths). Its distribution in a
language and source is held as a mergeable quantile sketch: counts of buckets that keep a number's
leading ``KEPT_BITS`` bits, so a bucket's bounds are within 1/32 of each other at any magnitude. Sketches of parts
add up bucket by bucket, which is a pre-aggregated grouped sum, and a group's sketch has at most some hundreds of
buckets, whatever its rows. Quantiles come from running sums over a group's buckets; thresholds go
back to the documents by a join on language and source.

Everything on this path is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facility_insights.session import cut_lineage

#: White space of the contracts' words: blank and \t \n \x0b \f \r.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
KEPT_BITS = 6
#: Measures, in hundredths (word_length) or ten-thousandths; the first has a lower threshold too.
MEASURES = ("word_length", "symbols", "dup_lines", "repeats")
#: Below so many documents, a language's and source's quantiles come from its language.
GROUP_ROWS = 100
#: A group's tails begin at these hundredths; a fence stands beyond its tail's begin by the tail's distance from the median.
LOW, MIDDLE, HIGH = 1, 50, 99
#: Where values hardly spread, a fence stands so far beyond: some marks in a long text are no outlier.
MARGIN = {"word_length": 25, "symbols": 50, "dup_lines": 500, "repeats": 100}


QUANTILES = ("low_q", "mid_q", "high_q")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def word_array(text: Column) -> Column:
    """Words between white space; none for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words under a window of ``window`` words that the text has twice or more.

    Windows are compared by 64-bit hashes. Only a text that has an equal pair sorts its windows;
    covered words are then counted from the sorted starts, so the cost is n log n for n words.
    """

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(window)]))
        return _let(hashes, twice)

    def twice(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    def covered(s: Column) -> Column:
        def same(k: Column) -> Column:
            return F.get(s, k)["h"]

        equal = F.transform(s, lambda x, k: F.when(x["h"].eqNullSafe(same(k - 1)) | x["h"].eqNullSafe(same(k + 1)), x["i"]))
        return _let(F.array_sort(F.filter(equal, lambda x: x.isNotNull())), lambda p: F.aggregate(p, start(p), step, lambda a: a["n"] + window))

    def start(p: Column) -> Column:
        return F.struct(F.lit(0).alias("n"), F.get(p, F.lit(0)).alias("last"))

    def step(a: Column, x: Column) -> Column:
        # A start adds what lies between it and the start before it, a window at most.
        return F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last"))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(_let(words, of))


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words), a row for each input row.

    Null, empty and blank texts have zeros; null languages and sources count as empty ones.
    """
    of = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(lang_col, F.lit("")).alias("lang"),
        F.coalesce(source_col, F.lit("")).alias("source"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")
        )

    def of_lines(x: Column) -> Column:
        return F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"))

    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    measured = of.select(
        "doc_id",
        "lang",
        "source",
        _let(word_array(F.col("text")), of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    return measured.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words")


def _ratio(part: str, whole: str, unit: int) -> Column:
    return F.expr(f"{unit} * {part} div greatest(1, {whole})")


def ratios(measured: DataFrame) -> DataFrame:
    return measured.withColumns(
        {
            "word_length": _ratio("word_chars", "n_words", 100),
            "symbols": _ratio("n_symbols", "n_words", 10000),
            "dup_lines": _ratio("n_dup_lines", "n_lines", 10000),
            "repeats": _ratio("n_repeat_words", "n_words", 10000),
        }
    )


def sketch(rated: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, low, n): how many values each bucket holds, by its least value."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURES])
    values = rated.select(*keys, F.inline(cells))
    shift = f"greatest(0, length(bin(x)) - {KEPT_BITS})"
    return values.withColumn("low", F.expr(f"shiftleft(shiftright(x, {shift}), {shift})")).groupBy(*keys, "measure", "low").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: the bucket counts' sums."""
    return sketches.groupBy(*keys, "measure", "low").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, rows, low_q, mid_q, high_q): the least bucket at which these hundredths of the rows are reached."""
    group = Window.partitionBy(*keys, "measure")
    so_far = F.sum("n").over(group.orderBy("low"))
    run = sketches.withColumns({"upto": so_far, "rows": F.sum("n").over(group)})
    return run.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"),
        *[F.min(F.when(F.col("upto") * 100 >= F.col("rows") * share, F.col("low"))).alias(q) for q, share in zip(QUANTILES, (LOW, MIDDLE, HIGH), strict=True)],
    )


def thresholds(rated: DataFrame, least_rows: int = GROUP_ROWS) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>): the fences of each language and source.

    A group of fewer than ``least_rows`` documents takes its language's quantiles, and a language of
    fewer takes the corpus's; both come from the merged sketches.
    """
    fine = sketch(rated, ["lang", "source"])
    by_source = quantiles(fine, ["lang", "source"])
    by_lang = quantiles(merge(fine, ["lang"]), ["lang"]).select("lang", "measure", *[F.col(c).alias(f"l_{c}") for c in ("rows", *QUANTILES)])
    corpus = quantiles(merge(fine, []), []).select("measure", *[F.col(q).alias(f"c_{q}") for q in QUANTILES])
    chosen = by_source.join(by_lang, ["lang", "measure"]).join(corpus, "measure")

    def pick(q: str) -> Column:
        return F.when(F.col("rows") >= least_rows, F.col(q)).when(F.col("l_rows") >= least_rows, F.col(f"l_{q}")).otherwise(F.col(f"c_{q}"))

    margin = F.element_at(F.create_map(*[F.lit(x) for pair in MARGIN.items() for x in pair]), F.col("measure"))
    picked = chosen.select("lang", "source", "measure", margin.alias("margin"), *[pick(q).alias(q) for q in QUANTILES])
    below = F.greatest(F.col("margin"), F.col("mid_q") - F.col("low_q"))
    beyond = F.greatest(F.col("margin"), F.col("high_q") - F.col("mid_q"))
    top = F.col("high_q") + F.shiftright("high_q", KEPT_BITS - 1)  # the bucket's upper bound
    fenced = picked.select("lang", "source", "measure", (F.col("low_q") - below).alias("low"), (top + beyond).alias("high"))
    return fenced.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high")]
    )


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each input row.

    A document is kept if it passes the base rules and lies within its group's fences. Quantiles are
    those of all documents that pass the base rules; a group without such a document keeps none.
    Null texts have zeros and fail; repeated rows count and stay; an empty table gives no row; other
    columns of the input are not looked at.
    """
    measured = cut_lineage(measures(docs, **columns))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rated = ratios(measured).withColumn("base_failed", failed)
    fences = thresholds(rated.where(~F.col("base_failed")))
    inside = F.col("word_length") >= F.col("low_word_length")
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"high_{m}"))
    verdict = F.coalesce(~F.col("base_failed") & inside, F.lit(False))
    return rated.join(fences, ["lang", "source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept")
    )
