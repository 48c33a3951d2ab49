"""Extraction quality: metrics of sections, verdicts, the judgement of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T

# The thresholds of the verdicts.
MIN_CHARS, SHORT_RATIO = 80, 0.25
MIN_ALNUM_RATIO, MAX_AVG_WORD, MAX_LONG_TOKENS, MAX_REPLACEMENT, LONG_TOKEN = 0.55, 12.0, 0.04, 0.002, 25
THIN_RATIO, DEGRADED_RATE, UNUSABLE_RATE, SMALL_BOOK = 0.4, 0.10, 0.35, 20


def metrics(sections: DataFrame, body: str = "body") -> DataFrame:
    """sections with chars, tokens and the four ratios, rounded before any test. Row-local."""
    flat = F.col("_flat")
    dense = F.regexp_replace(flat, T.WS, "")
    n_dense, n_alnum = F.length(dense), F.length(F.regexp_replace(dense, r"[^\p{L}\p{N}]", ""))
    size = F.transform("_words", lambda t: F.length(t))
    total = F.aggregate(size, F.lit(0), lambda a, n: a + n)
    long_ = F.size(F.filter(size, lambda n: n > LONG_TOKEN))
    lost = F.length(body) - F.length(F.replace(F.col(body), F.lit("�"), F.lit("")))
    ratio = lambda a, b, digits: F.when(b > 0, F.round(a / b * 10**digits, 0) / 10**digits).otherwise(F.lit(0.0))
    words = sections.withColumn("_flat", T.leader_collapse(F.col(body))).withColumn("_words", F.filter(T.words(F.col("_flat")), T.is_wordlike))
    return words.withColumns({
        "chars": F.length(body).cast("long"),
        "tokens": F.size("_words").cast("long"),
        "alnum_ratio": ratio(n_alnum, n_dense, 3),
        "avg_word_len": ratio(total, F.size("_words"), 2),
        "long_token_ratio": ratio(long_, F.size("_words"), 3),
        "replacement_ratio": ratio(lost, F.length(body), 4),
    }).drop("_flat", "_words")


def verdicts(scored: DataFrame, book: str, has_figure: str | None = None) -> DataFrame:
    """scored with median_chars of its book and verdict. The order of the rules counts."""
    figure = F.col(has_figure) if has_figure else F.lit(False)
    # a window, not a join of medians: scores are not made twice
    both = scored.where(F.col(book).isNotNull()).withColumn("median_chars", F.median("chars").over(Window.partitionBy(book)))
    garbled = (F.col("alnum_ratio") < MIN_ALNUM_RATIO) | (F.col("avg_word_len") > MAX_AVG_WORD) | (F.col("long_token_ratio") > MAX_LONG_TOKENS) | (F.col("replacement_ratio") > MAX_REPLACEMENT)
    rule = (
        F.when((F.col("chars") < MIN_CHARS) & figure, "IMAGE_ONLY")
        .when(F.col("chars") < MIN_CHARS, "EMPTY")
        .when(garbled, "GARBLED")
        .when((F.col("median_chars") > 0) & (F.col("chars") < F.col("median_chars") * SHORT_RATIO), "SHORT")
        .otherwise("OK")
    )
    return both.withColumn("verdict", rule)


def percent(ratio: str):
    """A ratio as a whole percentage, halves up, of its decimal digits."""
    return F.concat(F.round(F.col(ratio).cast("decimal(12,4)") * 100, 0).cast("long").cast("string"), F.lit("%"))


def reasons():
    """The reasons of a GARBLED verdict, in order. The sentences, as they are printed."""
    return F.array_compact(F.array(
        F.when(F.col("alnum_ratio") < MIN_ALNUM_RATIO, F.format_string("only %s letters and digits", percent("alnum_ratio"))),
        F.when(F.col("avg_word_len") > MAX_AVG_WORD, F.format_string("average word length %.1f, spaces likely lost", F.col("avg_word_len"))),
        F.when(F.col("long_token_ratio") > MAX_LONG_TOKENS, F.format_string("%s of tokens over 25 characters", percent("long_token_ratio"))),
        F.when(F.col("replacement_ratio") > MAX_REPLACEMENT, F.lit("unreadable characters present")),
    ))


def books(judged: DataFrame, book: str, *more: Column) -> DataFrame:
    """One row a book: sections, counts by verdict, more aggregates, fail_rate (rounded; tested as it is) and overall."""
    n = {v: F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("OK", "SHORT", "EMPTY", "GARBLED", "IMAGE_ONLY")}
    g = judged.groupBy(book).agg(F.count("*").alias("sections"), *n.values(), *more)
    out = F.col("empty") + F.col("garbled")
    rate = out / F.col("sections")
    material = out >= F.when(F.col("sections") < SMALL_BOOK, 2).otherwise(1)
    bad = (F.col("garbled") > 0) | ((rate > DEGRADED_RATE) & material)
    return g.withColumn("fail_rate", F.round(rate * 1000, 0) / 1000).withColumn("overall", F.when(bad & (rate > UNUSABLE_RATE), "UNUSABLE").when(bad, "DEGRADED").otherwise("OK"))


def excluded(judged: DataFrame, book: str, order: str) -> DataFrame:
    """Sections that no notes are taken from, garbled ones first: (book, rank from 1, label, verdict)."""
    some = judged.where(F.col("verdict").isin("GARBLED", "EMPTY"))
    w = Window.partitionBy(book).orderBy(F.when(F.col("verdict") == "GARBLED", 0).otherwise(1), order)
    return some.select(book, F.row_number().over(w).cast("long").alias("rank"), "label", "verdict")


def visual(judged: DataFrame, has_figure: str, provenance: str) -> DataFrame:
    """Sections for a visual pass: those with a figure, on scans only where the text is thin."""
    return judged.where(F.col(has_figure) & ((F.col(provenance) == "native") | (F.col("chars") < F.col("median_chars") * THIN_RATIO)))
