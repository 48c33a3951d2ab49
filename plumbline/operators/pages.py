"""Page maps: image inventory, provenance, page selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes of a figure and of a full page, and the marks of scanning software.
FIGURE, FULL_PAGE = (200, 200), (700, 900)
SCAN_RATIO, SCAN_DENSITY = 0.8, 2500
SCANNER_MARKERS = ("internet archive", "scribe", "abbyy", "finereader", "tesseract", "ocrmypdf", "scansnap", "kofax", "readiris")


def image_rows(listing: DataFrame, line: str = "line", number: str = "line_no") -> DataFrame:
    """Rows (page, width, height) of an image listing's lines: two header lines, short lines, non-numbers and masks are left out."""
    p = listing.where(F.col(number) > 2).withColumn("_p", F.split(F.trim(line), r"\s+")).where((F.size("_p") >= 5) & (F.get("_p", F.lit(2)) != "smask"))
    n = lambda i: F.expr(f"try_cast(get(_p, {i}) as int)")
    return p.withColumns({"page": n(0), "width": n(3), "height": n(4)}).where("page is not null and width is not null and height is not null").drop("_p")


def inventory(images: DataFrame, *keys: str) -> DataFrame:
    """One row a page: count, greatest width and height (of whichever images), figure, full_page."""
    g = images.groupBy(*keys, "page").agg(F.count("*").alias("count"), F.max("width").alias("max_w"), F.max("height").alias("max_h"))
    big = lambda size: (F.col("max_w") >= size[0]) & (F.col("max_h") >= size[1])
    return g.withColumn("figure", big(FIGURE)).withColumn("full_page", big(FULL_PAGE))


def provenance(metadata: Column, full_pages: Column, pages: Column, chars: Column) -> Column:
    """ocr where the metadata names a scanner, ocr-suspected by shape, else native."""
    n = F.greatest(pages, F.lit(1))
    return F.when(F.lower(F.coalesce(metadata, F.lit(""))).rlike("|".join(SCANNER_MARKERS)), "ocr").when((full_pages / n >= SCAN_RATIO) & (chars / n < SCAN_DENSITY), "ocr-suspected").otherwise("native")


def parse_pages(spec: Column) -> Column:
    """4,12,40-44 as a sorted array of distinct pages."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = lambda p: F.split(p, "-", 2)
    low, high = lambda p: F.trim(F.get(ends(p), F.lit(0))).cast("long"), lambda p: F.trim(F.coalesce(F.get(ends(p), F.lit(1)), p)).cast("long")
    pages = F.transform(parts, lambda p: F.when(low(p) <= high(p), F.sequence(low(p), F.greatest(low(p), high(p)))).otherwise(F.array().cast("array<bigint>")))
    return F.array_sort(F.array_distinct(F.flatten(pages)))


def evenly_spaced(total: Column, count: Column) -> Column:
    """``count`` pages spread over ``total``; all of them where there are no more."""
    step = total / count
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)).cast("long") - 1), lambda i: F.greatest(F.lit(1).cast("long"), F.least(total.cast("long"), F.floor(i * step) + 1)))
    all_ = F.sequence(F.lit(1).cast("long"), F.greatest(total, F.lit(1)).cast("long"))
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(count >= total, all_).otherwise(F.array_sort(F.array_distinct(spread)))


def page_spans(pages: DataFrame, book: str, pos: str, body: str) -> DataFrame:
    """Pages cut at form feeds as spans: each one's length plus the feed, ends within the text."""
    n = F.length(body) + 1
    w = Window.partitionBy(book).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(n).over(Window.partitionBy(book)) - 1
    s = pages.withColumn("start", F.coalesce(F.sum(n).over(w), F.lit(0)))
    return s.withColumn("end", F.least(F.col("start") + n, total)).withColumn("label", F.concat(F.lit("p."), F.col(pos).cast("string")))


def outline_spans(outline: DataFrame, spans: DataFrame, book: str = "slug") -> DataFrame:
    """Chapters from a top-level outline (book, page from 0, title, ord): to the next one's start, the last to the end; empty ones go, the rest are numbered."""
    o = outline.where(F.trim("title") != "")
    s = spans.select(book, (F.col("pos") - 1).alias("page"), "start")
    ends = spans.groupBy(book).agg(F.max("end").alias("total"))
    w = Window.partitionBy(book).orderBy("page", "ord")
    j = o.join(s, [book, "page"]).join(ends, book).withColumn("end", F.coalesce(F.lead("start").over(w), F.col("total"))).where(F.col("end") > F.col("start"))
    return j.withColumn("label", F.concat(F.lit("ch"), F.row_number().over(w).cast("string"))).select(book, "label", F.trim("title").alias("title"), "start", "end")


def chapter_spans(chapters: DataFrame, book: str, pos: str, body: str) -> DataFrame:
    """Kept bodies (20 characters or more) as chapters: each one's length plus two, numbered over the kept ones."""
    kept = chapters.where(F.length(body) >= 20)
    n = F.length(body) + 2
    w = Window.partitionBy(book).orderBy(pos)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = kept.withColumn("start", F.coalesce(F.sum(n).over(before), F.lit(0)))
    return s.withColumn("end", F.col("start") + n).withColumn("label", F.concat(F.lit("ch"), F.row_number().over(w).cast("string")))
