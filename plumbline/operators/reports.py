"""Reports and bookkeeping tables: extraction reports, rendered notes, topic status, given verdicts, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import notes as N
from plumbline.operators import quality as Q
from plumbline.operators import status as ST

# What a report shows of the pages for the visual pass, checkers' batches, arguments a chapter, chapters sampled.
SHOWN_PAGES, BATCH, ARGUMENTS, SAMPLED_SHARE = 60, 20, 12, 5


def in_order(value: Column, *order: Column) -> Column:
    """An aggregate: the values as an array in an order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))), lambda x: x["v"])


def with_figures(sections: DataFrame, images: DataFrame, book: str) -> DataFrame:
    """sections with has_figure: whether the inventory has a figure under the section's label."""
    some = images.where("figure").select(F.col(book).alias("_b"), F.col("label").alias("_l")).distinct()
    met = sections.join(some, (F.col(book) == F.col("_b")) & (F.col("label") == F.col("_l")), "left")
    return met.withColumn("has_figure", F.col("_b").isNotNull()).drop("_b", "_l")


def extraction(scored: DataFrame, books: DataFrame, book: str = "slug") -> DataFrame:
    """A row a book: the extraction report. scored are sections (book, pos, label, has_figure, metrics), books (book, provenance, total_chars).

    passes is true where the book's verdict is OK; excluded lists garbled sections before empty ones, visual the sections for a visual pass.
    """
    judged = Q.verdicts(scored, book, "has_figure").join(books, book)
    is_ = lambda v: F.col("verdict") == v
    seen = F.col("has_figure") & ((F.col("provenance") == "native") | (F.col("chars") < F.col("median_chars") * Q.THIN_RATIO))
    listed = lambda rule, *order: in_order(F.when(rule, F.col("label")), *order)
    lists = (
        F.array_compact(listed(seen, F.col("pos"))).alias("visual"),
        F.array_compact(listed(is_("IMAGE_ONLY"), F.col("pos"))).alias("image_only_labels"),
        F.array_compact(listed(is_("GARBLED") | is_("EMPTY"), F.when(is_("GARBLED"), 0).otherwise(1), F.col("pos"))).alias("excluded"),
    )
    out = Q.books(judged, book, *lists).join(books, book)
    return out.withColumn("passes", F.col("overall") == "OK")


def shown(labels: str) -> Column:
    """The labels that a report prints: the first ones, with dots where there are more."""
    first = F.array_join(F.transform(F.slice(labels, 1, SHOWN_PAGES), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    return F.concat(first, F.when(F.size(labels) > SHOWN_PAGES, " ...").otherwise(""))


# The sentences of an extraction report.
VERDICTS = {
    "UNUSABLE": "**%s of sections are unreadable. Do not study this book.**",
    "DEGRADED": "**%s of %s sections failed the gate and are excluded from study.**",
    "OK": "The book is readable and study can proceed.",
}
TABLE_HEAD = "| Section | Chars | Alnum | Avg word | Fig | Verdict | Why |\n|---|---|---|---|---|---|---|"


def extraction_markdown(scored: DataFrame, books: DataFrame, book: str = "slug") -> DataFrame:
    """(book, md): the report as Markdown: the head, a line a section, the verdict, what is excluded, the pages for a visual pass."""
    judged = Q.verdicts(scored, book, "has_figure").withColumn("why", F.array_join(F.when(F.col("verdict") == "GARBLED", Q.reasons()).otherwise(F.array()), "; "))
    line = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("label")), F.format_number("chars", 0), Q.percent("alnum_ratio"), F.format_string("%.1f", "avg_word_len"), F.when(F.col("has_figure"), "yes").otherwise(""), "verdict", F.concat("why", F.lit(" |")))
    lines = judged.groupBy(book).agg(F.array_join(in_order(line, F.col("pos")), "\n").alias("lines"))
    r = extraction(scored, books, book).join(lines, book)
    bad = F.size("excluded")
    said = F.when(F.col("overall") == "UNUSABLE", F.format_string(VERDICTS["UNUSABLE"], Q.percent("fail_rate"))).when(F.col("overall") == "DEGRADED", F.format_string(VERDICTS["DEGRADED"], bad.cast("string"), F.col("sections").cast("string"))).otherwise(VERDICTS["OK"])
    ticked = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n")
    md = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Extraction report: "), F.col(book).cast("string")),
        F.concat(F.lit("Extracted "), F.format_number("total_chars", 0), F.lit(" characters across "), F.col("sections").cast("string"), F.lit(" pages.")),
        F.concat(F.lit("Text provenance: **"), F.col("provenance"), F.lit("**.")),
        F.concat(F.lit(TABLE_HEAD + "\n"), F.col("lines")),
        F.concat(F.lit("## Verdict: "), F.col("overall")),
        said,
        F.when(bad > 0, F.concat(F.lit("Excluded sections:\n\n"), ticked("excluded"))),
        F.when(F.size("visual") > 0, F.concat(F.lit("## Visual pass\n\nPages: "), shown("visual"))),
    )
    return r.select(book, md.alias("md"))


# The sentences of a rendered document.
HEAD = "# Notes\n\nGenerated from `notes.jsonl`. Do not edit by hand.\n\n"
UNVERIFIED = "**%s of these carry no verification record.** Run the verification and the checks of stages 2 and 3 before relying on them.\n\n"
DROPPED = "## Dropped\n\n%s claim(s) failed verification and were removed. See `REJECTED.jsonl` for the reasons. A cluster of drops in one chapter usually means an extraction problem, not an author problem.\n"


def notes_document(notes: DataFrame, rejected: DataFrame, book: str) -> DataFrame:
    """(book, notes, unverified, dropped, md): the whole rendered file of each book; rejected are rows (book, rejected)."""
    blank = F.coalesce("verified", F.lit("")) == ""
    each = N.render(notes, book).groupBy(book).agg(F.count("*").alias("notes"), F.count_if(blank).alias("unverified"), F.array_join(in_order(F.col("md"), F.col("place")), "\n").alias("blocks"))
    r = each.join(rejected.select(book, F.col("rejected").alias("dropped")), book, "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))
    count = F.concat(F.col("notes").cast("string"), F.lit(" notes.\n\n"))
    warn = F.when(F.col("unverified") > 0, F.format_string(UNVERIFIED, F.col("unverified").cast("string"))).otherwise("")
    gone = F.when(F.col("dropped") > 0, F.concat(F.lit("\n"), F.format_string(DROPPED, F.col("dropped").cast("string")))).otherwise("")
    return r.select(book, "notes", "unverified", "dropped", F.concat(F.lit(HEAD), count, warn, F.col("blocks"), gone).alias("md"))


def topic_books(books: DataFrame, notes: DataFrame, rejected: DataFrame, maps: DataFrame, briefs: DataFrame, now: Column, book: str = "slug") -> DataFrame:
    """A status row for each book, with what other tables know of it: notes (book, kind, mtime), rejected (book), maps (book, provenance), briefs (book)."""
    n = notes.groupBy(book).agg(F.count("*").alias("notes"), F.count_if(F.col("kind") == "figure").alias("figure_notes"), F.max("mtime").alias("notes_mtime"))
    x = rejected.groupBy(book).agg(F.count("*").alias("rejected"))
    m = maps.groupBy(book).agg(F.min("provenance").alias("provenance"))
    b = briefs.select(book).distinct().withColumn("brief", F.lit(True))
    out = books.select(book)
    for side in (n, x, m, b):
        out = out.join(side, book, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("notes", "figure_notes", "rejected", "notes_mtime")}
    return ST.states(out.withColumns({**zero, "provenance": F.coalesce("provenance", F.lit("unknown")), "brief": F.coalesce("brief", F.lit(False))}), now)


def newest(books: DataFrame) -> DataFrame:
    """One row: the time of the newest notes, 0 where there are none."""
    return books.agg(F.coalesce(F.max("notes_mtime"), F.lit(0)).alias("newest"))


def topics_ready(reports: DataFrame, topic: str) -> DataFrame:
    """(topic, books, ready): a topic is ready when no book of it has a failing verification."""
    return reports.groupBy(topic).agg(F.count("*").alias("books"), F.bool_and("ok").alias("ready"))


# What follows from a checker's verdict, by stage.
ACTIONS = {
    ("entailment", "SUPPORTS"): "pass", ("entailment", "OVERREACHES"): "narrow and rerun", ("entailment", "UNRELATED"): "drop",
    ("context", "SOUND"): "pass", ("context", "WRONG-SPEAKER"): "fix speaker", ("context", "MISSING-QUALIFIER"): "amend or add caveat", ("context", "REVERSED"): "drop",
    ("figure", "ACCURATE"): "pass", ("figure", "WRONG"): "drop", ("figure", "OVERREACHES"): "narrow and rerun",
    ("coverage", "IN-INTENT"): "write note", ("coverage", "OUTSIDE"): "one line in the brief",
}


def actions(notes: DataFrame, verdicts: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(note_id, stage, verdict, action) for each note and stage: the last attempt counts, two checkers that disagree drop the note, no verdict is pending."""
    last = verdicts.groupBy("note_id", "stage").agg(F.max("attempt").alias("last"))
    given = verdicts.join(last, ["note_id", "stage"]).where("attempt = last").groupBy("note_id", "stage").agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("_other"))
    every = notes.select("note_id").distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    known = F.lit(None).cast("string")
    for (stage, verdict), action in ACTIONS.items():
        known = F.when((F.col("stage") == stage) & (F.col("verdict") == verdict), action).otherwise(known)
    action = F.when(F.col("verdict").isNull(), "pending").when(F.col("verdict") != F.col("_other"), "drop").otherwise(F.coalesce(known, F.lit("unknown verdict")))
    return every.join(given, ["note_id", "stage"], "left").select("note_id", "stage", "verdict", action.alias("action"))


def run_report(acted: DataFrame, records: DataFrame) -> DataFrame:
    """(part, kind, n): notes written, kept and dropped by stage, and matches by level. acted from actions(), records (note_id, level)."""
    dropped = acted.where("action = 'drop'")
    first = dropped.groupBy("note_id").agg(F.min("stage").alias("stage"))
    part = lambda df, name, kind: df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "kind", "n")
    ids = acted.select("note_id").distinct()
    return (
        part(ids, "written", F.lit("all"))
        .unionByName(part(ids.join(first, "note_id", "left_anti"), "kept", F.lit("all")))
        .unionByName(part(first, "dropped", F.col("stage")))
        .unionByName(part(records, "level", F.coalesce("level", F.lit("none"))))
    )


def audit(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages of a scan read against their images (verdict CLEAN, WORD-ERROR or NUMBER-ERROR): the three counts, kept apart, and whether numbers can be relied on."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return pages.groupBy(*keys).agg(F.count("*").alias("pages"), n("CLEAN").alias("clean"), n("WORD-ERROR").alias("word_errors"), n("NUMBER-ERROR").alias("number_errors"), (n("NUMBER-ERROR") == 0).alias("numbers_ok"))


def gate(sentences: DataFrame, notes: DataFrame) -> DataFrame:
    """(draft, round, supported, flagged, unsupported, outcome) of draft sentences (draft, round, note_id, verdict) checked against notes (note_id).

    A sentence whose note does not exist is unsupported, whatever its verdict. A round without unsupported sentences passes; after
    two failed rounds the draft is given up.
    """
    met = sentences.join(notes.select("note_id").distinct().withColumn("_there", F.lit(True)), "note_id", "left")
    v = F.when(F.col("_there").isNull(), "UNSUPPORTED").otherwise(F.col("verdict"))
    counts = met.withColumn("v", v).groupBy("draft", "round").agg(*[F.count_if(F.col("v") == x).alias(x.lower()) for x in ("SUPPORTED", "FLAGGED", "UNSUPPORTED")])
    w = Window.partitionBy("draft").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.sum(F.when(F.col("unsupported") > 0, 1).otherwise(0)).over(w)
    return counts.withColumn("outcome", F.when(F.col("unsupported") == 0, "pass").when(failed >= 2, "give up").otherwise("rewrite"))


def clusters(notes: DataFrame) -> DataFrame:
    """(tag, books, notes, category) of notes (book, note_id, tag, stance): tags that two books or more share, classed by the given stances.

    One stance in all books is agreement, opposed ones disagreement, stances to different questions talking past; a tag of one
    book is left to only_one().
    """
    g = notes.groupBy("tag").agg(F.count_distinct("book").alias("books"), F.count_distinct("note_id").alias("notes"), F.array_sort(F.collect_set("stance")).alias("s"))
    both = F.array_contains("s", "for") & F.array_contains("s", "against")
    return g.where("books >= 2").select("tag", "books", "notes", F.when(F.size("s") == 1, "agreement").when(both, "disagreement").otherwise("talking past").alias("category"))


def only_one(notes: DataFrame) -> DataFrame:
    """(tag, book, notes): tags that one book alone covers."""
    return notes.groupBy("tag").agg(F.count_distinct("book").alias("books"), F.min("book").alias("book"), F.count_distinct("note_id").alias("notes")).where("books = 1").drop("books")


def subject_index(notes: DataFrame) -> DataFrame:
    """(tag, books, locators, vocabulary): for each subject where it is found and the words used for it; distinct, in order, as text."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return notes.groupBy("tag").agg(joined(F.col("book").cast("string")).alias("books"), joined("locator").alias("locators"), joined("word").alias("vocabulary"))


def batches(notes: DataFrame, book: str, order: str, size: int = BATCH) -> DataFrame:
    """notes with the number, from 0, of the batch that a checker gets."""
    w = Window.partitionBy(book).orderBy(order)
    return notes.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def major_arguments(arguments: DataFrame, chapter: str, *order: str, n: int = ARGUMENTS) -> DataFrame:
    """At most n arguments a chapter, in order."""
    w = Window.partitionBy(chapter).orderBy(*order)
    return arguments.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def sampled_chapters(chapters: DataFrame, *keys: str, share: int = SAMPLED_SHARE) -> DataFrame:
    """One chapter in ``share``, by a hash of its keys: the same ones each time."""
    h = F.conv(F.substring(F.md5(F.concat_ws("/", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")
    return chapters.where(h % share == 0)


def selected_pages(books: DataFrame, images: DataFrame, listed: DataFrame, book: str = "slug") -> DataFrame:
    """(book, page, file): the pages to render of each book (book, total, spec, from_report, with_images, sample).

    The first of these that is given decides: a page list, the labels of the book's extraction report (book, label) met with its
    images (book, page, label, figure), all pages with a figure, an even sample. Pages beyond the book are left out.
    """
    from plumbline.operators import pages as P

    given = F.col("spec").isNotNull()
    report = ~given & F.coalesce("from_report", F.lit(False))
    figures = ~given & ~report & F.coalesce("with_images", F.lit(False))
    sampled = ~given & ~report & ~figures & F.col("sample").isNotNull()
    by_label = images.join(listed.select(book, "label").distinct(), [book, "label"], "left_semi").select(book, "page")
    rows = (
        books.where(given).select(book, "total", F.explode(P.parse_pages(F.col("spec"))).alias("page"))
        .unionByName(books.where(report).select(book, "total").join(by_label, book))
        .unionByName(books.where(figures).select(book, "total").join(images.where("figure").select(book, "page"), book))
        .unionByName(books.where(sampled).select(book, "total", F.explode(P.evenly_spaced(F.col("total"), F.col("sample"))).alias("page")))
    )
    inside = rows.where(F.col("page").between(1, F.col("total"))).select(book, F.col("page").cast("long").alias("page")).distinct()
    return inside.withColumn("file", F.concat(F.lit("p"), F.when(F.col("page") < 10_000, F.lpad(F.col("page").cast("string"), 4, "0")).otherwise(F.col("page").cast("string")), F.lit(".png")))


def to_render(selected: DataFrame, existing: DataFrame, book: str = "slug") -> DataFrame:
    """Selected pages whose file (book, file) does not exist yet."""
    return selected.join(existing.select(book, "file"), [book, "file"], "left_anti")
