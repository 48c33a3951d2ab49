"""Where each book stands, and what to do next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds after which notes without a brief count as left behind.
ACTIVE_WINDOW = 15 * 60


def states(books: DataFrame, now) -> DataFrame:
    """books (slug, notes, brief, notes_mtime) with state."""
    some = F.col("notes") > 0
    return books.withColumn("state", F.when(~some, "extracted").when(F.col("brief"), "studied").when(now - F.col("notes_mtime") < ACTIVE_WINDOW, "in-progress").otherwise("notes-only"))


def synthesis_state(mtime, newest):
    """missing, stale or current; equal times are current."""
    return F.when(mtime.isNull(), "missing").when(mtime < newest, "stale").otherwise("current")


def unextracted(sources: DataFrame, books: DataFrame, stem: str = "stem", slug: str = "slug") -> DataFrame:
    """Sources whose stem holds no book's slug: a source meets the slugs that are one of its stem's substrings, so both sides join by key, however many they are."""
    n = F.length(stem)
    # the lengths that slugs have are few; a null or empty stem has no substring
    sizes = books.select(F.length(slug).alias("k")).distinct()
    cut = F.transform(F.sequence(F.lit(1), F.col("_n") - F.col("k") + 1), lambda i: F.substring(F.col(stem), i, F.col("k")))
    pieces = sources.select(stem).distinct().withColumn("_n", n).join(F.broadcast(sizes), F.col("k") <= F.col("_n")).select(stem, F.explode(F.array_distinct(cut)).alias("_s"))
    held = pieces.join(books.select(F.col(slug).alias("_s")).distinct(), "_s", "left_semi").select(F.col(stem).alias("_held")).distinct()
    return sources.join(held, F.col(stem) == F.col("_held"), "left_anti")


# The sentences of the actions.
EXTRACT = "study the %d book(s) not yet extracted: %s"
WAIT = "wait: %s looks like a study run still in progress (%d notes so far). Do not restart it."
STUDY, INTERRUPTED, NEVER = "run study on %s (%s)", "notes exist but no brief, so the run was interrupted", "extracted but never studied"
SYNTHESIZE, AGAIN, READY = "run synthesis, every book is studied", "rerun synthesis, the notes changed after it last ran", "the topic is ready"


def next_actions(books: DataFrame, missing: DataFrame | None = None, synthesis: str | DataFrame = "missing") -> DataFrame:
    """Rows (ord, slug, action) in the order of the pipeline.

    books are (slug, state, notes), missing the sources (stem) not yet extracted, synthesis its state or a row (synthesis) with it.
    Only where nothing is left to extract, to wait for or to study does the last step come.
    """
    spark = books.sparkSession
    left = missing.select("stem") if missing is not None else spark.createDataFrame([], "stem string")
    state = synthesis if isinstance(synthesis, DataFrame) else spark.createDataFrame([(synthesis,)], "synthesis string")
    names = left.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("stem")), ", ").alias("names"))
    extract = names.where("n > 0").select(F.lit(0).alias("ord"), F.lit("").alias("slug"), F.format_string(EXTRACT, "n", "names").alias("action"))
    wait = books.where("state = 'in-progress'").select(F.lit(1).alias("ord"), "slug", F.format_string(WAIT, "slug", F.col("notes")).alias("action"))
    why = F.when(F.col("state") == "notes-only", INTERRUPTED).otherwise(NEVER)
    study = books.where("state not in ('studied', 'in-progress')").select(F.lit(2).alias("ord"), "slug", F.format_string(STUDY, "slug", why).alias("action"))
    # one row each: how many books are open and studied, what is left to extract, the synthesis
    done = books.agg(F.count_if(F.col("state") != "studied").alias("open"), F.count_if(F.col("state") == "studied").alias("studied")).crossJoin(F.broadcast(names)).crossJoin(F.broadcast(state)).where("open = 0 and n = 0")
    last = F.when((F.col("studied") > 1) & (F.col("synthesis") == "missing"), SYNTHESIZE).when(F.col("synthesis") == "stale", AGAIN).otherwise(READY)
    return extract.unionByName(wait).unionByName(study).unionByName(done.select(F.lit(3).alias("ord"), F.lit("").alias("slug"), last.alias("action")))
