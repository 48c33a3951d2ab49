"""Quotes looked up in texts: a ladder from strict to lenient, offsets, locators, verification records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T

#: So many quotes are broadcast, after a count; more meet the texts in a shuffle of sampled windows.
BROADCAST_ROWS = 20_000
#: Code points of the windows by which quotes meet texts; one window in SAMPLED, by its hash, goes into a shuffle.
WINDOW, SAMPLED = 16, 16
#: Characters of the stretches in which offsets meet segments.
STRETCH = 1024
LEVELS = ("EXACT", "NORMALIZED", "PUNCT")


def with_windows(rows: DataFrame, text: str, k: int = WINDOW) -> DataFrame:
    """rows once for each k code points of a text, with their hash _g. Four bytes a code point, so that any place is found at once."""
    code = rows.withColumn("_u", T.once(F.encode(F.col(text), "UTF-32"))).where(F.octet_length("_u") >= 4 * k)
    each = code.withColumn("_at", F.explode(F.sequence(F.lit(1), (F.octet_length("_u") - (4 * k - 1)).cast("int"), F.lit(4))))
    return each.withColumn("_g", F.xxhash64(F.substring(F.col("_u"), F.col("_at"), F.lit(4 * k)))).drop("_u", "_at")


def contained(quotes: DataFrame, books: DataFrame, quote: str, body: str, item: str, book: str, k: int = WINDOW) -> DataFrame:
    """Pairs (quote row, book row) with the ``body`` containing the ``quote``, which is not empty.

    A quote of k code points or more meets texts by the hash of a window in its middle, which any text that holds it has. Up to
    BROADCAST_ROWS such quotes are broadcast and the texts stay where they are. More are met by those windows alone whose
    hash falls in a sample, keys and hashes only, and the texts join in for the candidates. Shorter quotes, and of many
    quotes those without a sampled window, are broadcast in blocks and looked up one by one.
    """
    long_, rest = quotes.where(F.length(quote) >= k), quotes.where(F.length(quote) < k)
    holds = F.contains(body, F.col(quote))
    if long_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        middle = F.substring(F.col(quote), (F.floor((F.length(quote) - k) / 2) + 1).cast("int"), F.lit(k))
        keyed = long_.withColumn("_g", F.xxhash64(F.encode(middle, "UTF-32")))
        # a text may hold the window more than once
        met = with_windows(books, body, k).join(F.broadcast(keyed), "_g").drop("_g").where(holds).dropDuplicates([item, book])
    else:
        sample = F.pmod(F.col("_g"), F.lit(SAMPLED)) == 0
        keyed = with_windows(long_.select(item, quote), quote, k).where(sample).groupBy(item).agg(F.min("_g").alias("_g"))
        places = with_windows(books.select(book, body), body, k).where(sample).select(book, "_g").distinct()
        pairs = places.join(keyed, "_g").select(item, book).distinct()
        met = books.join(pairs, book).join(long_, item).where(holds)
        rest = rest.unionByName(long_.join(keyed.select(item), item, "left_anti"))
    for block in _blocks(rest):
        met = met.unionByName(books.join(F.broadcast(block), holds).select(*met.columns))
    return met


def _blocks(rows: DataFrame) -> list[DataFrame]:
    """rows in blocks of about half of BROADCAST_ROWS, dealt by hash; in one where they are few, in none where there are none."""
    n = rows.count()
    if n <= BROADCAST_ROWS:
        return [rows] if n else []
    k = -(-2 * n // BROADCAST_ROWS)
    dealt = F.pmod(F.xxhash64(*rows.columns), F.lit(k))
    return [rows.where(dealt == i) for i in range(k)]


def _parts(quote: Column, form) -> Column:
    return F.transform(T.split_elisions(quote), lambda p: T.strip(form(p)))


def ladder(quotes: DataFrame, books: DataFrame, item: str = "item_id", quote: str = "quote", book: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (item, book, level, found_at in the level's text, ends): the strictest level at which each pair matches.

    EXACT: the normalised quote, or its parts between ellipses in order, stand in the raw text. NORMALIZED: in the normalised
    text. PUNCT: by letters and digits alone. A match in the raw text is one in the normalised text too, so one join serves
    both; only quotes without any match get to the last rung.
    """
    q = quotes.select(item, F.col(quote).alias("_raw")).withColumn("parts", T.once(_parts(F.col("_raw"), T.norm)))
    b = books.select(book, F.col(text).alias("_text")).where("_text is not null").withColumn("body", T.once(T.norm(F.col("_text"))))
    some = q.withColumn("q", F.get("parts", F.lit(0))).where("q <> ''").drop("_raw")
    hit = contained(some, b, "q", "body", item, book, T.MIN_FRAGMENT)
    levels = [F.struct(F.lit(n).alias("level"), T.search_parts(F.col(t), F.col("parts")).alias("s")) for n, t in (("EXACT", "_text"), ("NORMALIZED", "body"))]
    hit = hit.withColumn("m", T.once(F.when(levels[0]["s"]["ok"], levels[0]).otherwise(levels[1]))).where("m.s.ok")
    hit = hit.select(item, book, "m.level", F.col("m.s.first").alias("found_at"), F.col("m.s.cursor").alias("ends"))
    last = q.join(hit.select(item).distinct(), item, "left_anti").select(item, T.once(_parts(F.col("_raw"), T.alnum)).alias("parts")).withColumn("q", F.get("parts", F.lit(0))).where("q <> ''")
    bare = b.select(book, T.once(T.alnum(F.col("_text"))).alias("body"))
    low = contained(last, bare, "q", "body", item, book, T.MIN_FRAGMENT).withColumn("s", T.once(T.search_parts(F.col("body"), F.col("parts")))).where("s.ok")
    return hit.unionByName(low.select(item, book, F.lit("PUNCT").alias("level"), F.col("s.first").alias("found_at"), F.col("s.cursor").alias("ends")))


def outcome(quotes: DataFrame, pairs: DataFrame, item: str = "item_id", book: str = "doc_id") -> DataFrame:
    """One row an item, failed ones too: status, best level, books at that level, the first book."""
    on = {v: F.col("level") == v for v in LEVELS}
    g = pairs.groupBy(item).agg(*[F.count_if(c).alias(f"n_{v}") for v, c in on.items()], *[F.min(F.when(c, F.col(book))).alias(f"b_{v}") for v, c in on.items()])
    best = F.coalesce(*[F.when(F.col(f"n_{v}") > 0, F.struct(F.lit(v).alias("level"), F.col(f"n_{v}").alias("n"), F.col(f"b_{v}").alias("b"))) for v in LEVELS])
    at = quotes.select(item).join(g.select(item, best.alias("_x")), item, "left")
    return at.select(item, F.when(F.col("_x").isNull(), "FAIL").otherwise("PASS").alias("status"), F.col("_x.level").alias("level"), F.coalesce("_x.n", F.lit(0)).cast("long").alias("n_books"), F.col("_x.b").alias(book))


def line_segments(books: DataFrame, book: str = "doc_id", text: str = "text", mark: str = "p.") -> DataFrame:
    """Segments of a text by its line ends, as pages are by form feeds: (book, pos from 1, label, start, end, body). Row-local: no window."""
    parts = F.split(text, "\n", -1)
    # every span is made before the lines are parted: the whole text must not be measured for each of them
    ends = T.running(F.transform(parts, lambda p: F.length(p) + 1))
    spans = T.bound(ends, lambda e: F.transform(e, lambda x, i: F.struct(F.coalesce(F.get(e, i - 1), F.lit(0)).alias("start"), F.least(x, F.element_at(e, -1) - 1).alias("end"))))
    z = F.arrays_zip(parts.alias("body"), spans.alias("span"))
    s = books.where(F.col(text).isNotNull()).select(book, F.posexplode(z).alias("i", "z"))
    pos = (F.col("i") + 1).cast("long")
    return s.select(book, pos.alias("pos"), F.concat(F.lit(mark), pos.cast("string")).alias("label"), F.col("z.span.start").cast("long").alias("start"), F.col("z.span.end").cast("long").alias("end"), F.col("z.body").alias("body"))


def locate(offsets: DataFrame, segments: DataFrame, book: str = "doc_id", offset: str = "found_at", *keep: str, label: str = "label") -> DataFrame:
    """offsets with the label, and the columns to keep, of the first segment that holds each, null where none does.

    Offsets meet the segments of equal books that reach into their stretch of STRETCH characters, not all of the book's.
    """
    stretch = lambda c: F.floor(c / STRETCH)
    s = segments.select(F.col(book).alias("_b"), F.struct("pos", "label", *[k for k in keep if k != "pos"]).alias("_s"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    s = s.where("_start < _end").withColumn("_at", F.explode(F.sequence(stretch(F.col("_start")), stretch(F.col("_end") - 1))))
    met = offsets.join(s, (F.col(book) == F.col("_b")) & (stretch(F.col(offset)) == F.col("_at")) & (F.col("_start") <= F.col(offset)) & (F.col(offset) < F.col("_end")), "left")
    first = met.groupBy(*offsets.columns).agg(F.min("_s").alias("_s"))
    return first.select(*offsets.columns, F.col("_s.label").alias(label), *[F.col(f"_s.{k}").alias(k) for k in keep])


def locator(offsets: DataFrame, pages: DataFrame | None, chapters: DataFrame | None, book: str = "doc_id", offset: str = "found_at", name: str = "locator") -> DataFrame:
    """offsets with a locator such as ch3 / p.87, the chapter first; unknown where neither holds the offset."""
    out, labels = offsets, []
    for kind, segments in (("_chapter", chapters), ("_page", pages)):
        if segments is not None:
            out = locate(out, segments, book, offset, label=kind)
            labels.append(kind)
    text = F.concat_ws(" / ", *labels)
    return out.withColumn(name, F.when(F.col(offset).isNull(), None).when(text == "", "unknown").otherwise(text)).drop(*labels)


def mismatch(claimed: str, actual: str) -> Column:
    """True where both locators have tokens and share none."""
    a, b = T.locator_tokens(F.col(claimed)), T.locator_tokens(F.col(actual))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


# The issues of a verification record, as they are printed.
NO_QUOTE = "quote not found in the extracted text"
NO_IMAGE = "evidence image not found: %s"
WRONG_PLACE = "locator says '%s' but the quote is at '%s'"
BY_LETTERS = "matched only after stripping punctuation, so the quote's punctuation does not match the book verbatim"
FROM_IMAGE = "evidence is a page image, not a quote. Weaker than a text note, and the brief must say so."


def verify_notes(notes: DataFrame, books: DataFrame, pages: DataFrame | None, chapters: DataFrame | None, files: DataFrame, book: str = "slug", text: str = "text") -> DataFrame:
    """A record for each note (book, id, quote, locator, kind, evidence) of a book: status, level, found_at, found_locator, issues, evidence_path.

    A note is looked up in its own book, so books meet notes by key and each level is tried in the row, the strictest first.
    ``files`` lists the paths that exist (book, path), from which a figure note's evidence is taken.
    """
    there = files.select(F.col(book).alias("_fb"), F.col("path").alias("evidence_path")).distinct()
    figures = notes.where("kind = 'figure'").join(there, (F.col(book) == F.col("_fb")) & (F.col("evidence") == F.col("evidence_path")), "left").drop("_fb")
    found = F.col("evidence_path").isNotNull()
    figures = figures.select(
        book, "id", F.when(found, "FIGURE").otherwise("FAIL").alias("status"), F.lit("IMAGE").alias("level"), F.lit(None).cast("long").alias("found_at"), F.col("locator").alias("found_locator"),
        F.array(F.when(found, F.lit(FROM_IMAGE)).otherwise(F.format_string(NO_IMAGE, F.coalesce("evidence", F.lit(""))))).alias("issues"), "evidence_path",
    )

    q = notes.where("kind is null or kind <> 'figure'").join(books.select(book, F.col(text).alias("_text")), book, "left")
    q = q.withColumn("_text", F.coalesce("_text", F.lit("")))
    tries = [("EXACT", F.col("_text"), T.norm), ("NORMALIZED", T.norm(F.col("_text")), T.norm), ("PUNCT", T.alnum(F.col("_text")), T.alnum)]
    def tried(name, body, form):
        # the text and the outcome go through lambdas by name, so that neither is computed anew for each of its uses
        s = F.aggregate(F.array(body), F.struct(F.lit(False).alias("ok"), F.lit(-1).alias("first"), F.lit(0).alias("cursor")), lambda _, b: T.search_parts(b, _parts(F.col("quote"), form)))
        return F.get(F.transform(F.array(s), lambda x: F.when(x["ok"], F.struct(F.lit(name).alias("level"), x["first"].alias("first")))), F.lit(0))

    levels = [tried(*t) for t in tries]
    match = F.coalesce(*levels)
    q = q.withColumn("m", T.once(match))
    mode = F.when(F.col("m.level") == "NORMALIZED", "norm").when(F.col("m.level") == "PUNCT", "alnum")
    rows = q.select(book, "id", "locator", F.col("m.level").alias("level"), F.get(T.raw_offsets(F.col("_text"), F.when(F.col("m").isNotNull(), F.array("m.first")), mode), F.lit(0)).cast("long").alias("found_at"))
    rows = locator(rows, pages, chapters, book, "found_at", "found_locator")
    off = F.coalesce(mismatch("locator", "found_locator"), F.lit(False))
    status = F.when(F.col("level").isNull(), "FAIL").when(off, "LOCATOR_MISMATCH").otherwise("PASS")
    issues = F.array_compact(F.array(
        F.when(F.col("level").isNull(), NO_QUOTE), F.when(off, F.format_string(WRONG_PLACE, "locator", "found_locator")), F.when(F.col("level") == "PUNCT", BY_LETTERS),
    ))
    rows = rows.select(book, "id", status.alias("status"), "level", "found_at", "found_locator", issues.alias("issues"), F.lit(None).cast("string").alias("evidence_path"))
    return rows.unionByName(figures)


def fails(strict: bool = False) -> Column:
    """Whether a record must be dropped; with ``strict`` wrong locators and matches by letters alone too."""
    rule = F.col("status") == "FAIL"
    if strict:
        rule = rule | (F.col("status") == "LOCATOR_MISMATCH") | ((F.col("level") == "PUNCT") & (F.col("status") == "PASS"))
    return rule


def failing(records: DataFrame, strict: bool = False) -> DataFrame:
    """The records that must be dropped."""
    return records.where(fails(strict))


def report(records: DataFrame, book: str = "slug", strict: bool = False) -> DataFrame:
    """A row a book: counts by status, counts of the three levels, must_drop (ids in order) and ok."""
    each = records.withColumn("_fails", F.coalesce(fails(strict), F.lit(False))).groupBy(book, "status").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("level") == v).alias(f"n_{v}") for v in LEVELS],
        F.collect_set(F.when(F.col("_fails"), F.col("id"))).alias("ids"), F.count_if("_fails").alias("n_fails"),
    )
    levels = F.create_map(*[x for v in LEVELS for x in (F.lit(v), F.sum(f"n_{v}"))])
    return each.groupBy(book).agg(
        F.sum("n").alias("notes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"), levels.alias("levels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("must_drop"), (F.sum("n_fails") == 0).alias("ok"),
    )
