"""Notes as JSON lines: reading, validation, order, rendering; verdict tables of the judged stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T

# The fields and their domains.
REQUIRED = ("id", "claim", "locator", "kind", "scope", "speaker")
KINDS = ("claim", "definition", "technique", "example", "caveat", "figure")
SCOPES = ("core", "adjacent")
SPEAKERS = ("author", "cited", "rejected", "hypothetical", "conversation")
SPEAKER_WARNING = {
    "cited": "someone the author is quoting, not the author",
    "rejected": "a position the author sets up in order to reject",
    "hypothetical": "stated hypothetically, not asserted",
    "conversation": "came out of a conversation, not from the book",
}
SCHEMA = "id string, claim string, quote string, evidence string, locator string, kind string, scope string, speaker string, verified string, topic_tags array<string>, _bad string"


def parse(lines: DataFrame, line: str = "line", number: str = "line_no") -> DataFrame:
    """lines with the note's fields and errors (array). Blank lines and lines that begin with // are left out."""
    t = T.strip(F.col(line))
    some = lines.withColumn("_t", t).where((F.col("_t") != "") & ~F.startswith("_t", F.lit("//")))
    p = some.withColumn("n", F.from_json("_t", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    f = lambda name: F.coalesce(F.col(f"n.{name}"), F.lit("")) == ""
    missing = F.array_compact(F.array(*[F.when(f(c), F.lit(c)) for c in REQUIRED], F.when((F.col("n.kind") == "figure") & f("evidence"), "evidence").when(~(F.col("n.kind").eqNullSafe("figure")) & f("quote"), "quote")))
    no = F.col(number).cast("string")
    broken = F.col("n._bad").isNotNull() | F.col("n").isNull()
    at = F.concat(F.lit("line "), no, F.lit(": "))
    bad = lambda name, ok: F.when(~F.col(f"n.{name}").isin(*ok), F.concat(at, F.lit(f"bad {name} '"), F.col(f"n.{name}"), F.lit("'")))
    errors = (
        F.when(broken, F.array(F.concat(at, F.lit("invalid JSON"))))
        .when(F.size("_m") > 0, F.array(F.concat(at, F.lit("missing fields "), F.array_join("_m", ", "))))
        .otherwise(F.array_compact(F.array(bad("kind", KINDS), bad("scope", SCOPES), bad("speaker", SPEAKERS))))
    )
    return p.withColumn("_m", missing).withColumn("errors", errors).withColumn("kept", ~broken & (F.size("_m") == 0)).drop("_t", "_m")


def notes_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kept").select("n.*", *[c for c in parsed.columns if c not in ("n", "errors", "kept", "line")]).drop("_bad")


def chapter(locator: str):
    """The least chapter token in string order (ch10 before ch3), or null."""
    return F.array_min(F.filter(T.locator_tokens(F.col(locator)), lambda t: F.startswith(t, F.lit("ch"))))


def render_order(notes: DataFrame, *keys: str) -> DataFrame:
    """notes with chapter, chapter number (999 without digits) and place from 1 within ``keys``, and whether a heading precedes."""
    n = notes.withColumn("chapter", F.coalesce(chapter("locator"), F.lit("unplaced")))
    digits = F.regexp_replace("chapter", "[^0-9]", "")
    n = n.withColumn("chapter_no", F.when(digits == "", 999).otherwise(F.expr("try_cast(regexp_replace(chapter, '[^0-9]', '') as long)")))
    w = Window.partitionBy(*keys).orderBy("chapter_no", "id")
    return n.withColumn("place", F.row_number().over(w).cast("long")).withColumn("heading", ~F.lag("chapter").over(w).eqNullSafe(F.col("chapter")))


def render(notes: DataFrame, *keys: str) -> DataFrame:
    """notes in order with ``md``, each note's block of the Markdown file."""
    n = render_order(notes, *keys)
    warn = F.lit(None).cast("string")
    for s, w in SPEAKER_WARNING.items():
        warn = F.when(F.col("speaker") == s, w).otherwise(warn)
    nl = F.lit("\n")
    head = F.when(F.col("heading"), F.concat(F.lit("## "), F.col("chapter"), nl, nl)).otherwise("")
    note = F.coalesce(F.concat(F.lit("**Attribution: "), warn, F.lit(".**\n\n")), F.lit(""))
    figure = F.concat(F.lit("**From a page image, not from text.** Evidence: `"), F.col("evidence"), F.lit("`\n\n!["), F.col("id"), F.lit("]("), F.col("evidence"), F.lit(")"))
    quote = F.concat(F.lit("> "), F.replace(T.strip(F.coalesce("quote", F.lit(""))), nl, F.lit(" ")))
    meta = F.concat(F.lit("`"), F.col("locator"), F.lit("` · "), F.col("kind"), F.lit(" · "), F.col("scope"), F.when(F.coalesce("verified", F.lit("")) != "", F.concat(F.lit(" · verified: "), F.col("verified"))).otherwise(""))
    return n.withColumn("md", F.concat(head, F.lit("### "), F.col("id"), nl, nl, F.col("claim"), nl, nl, note, F.when(F.col("kind") == "figure", figure).otherwise(quote), nl, nl, meta, nl))


def stage_funnel(verdicts: DataFrame, passes: dict[str, str]) -> DataFrame:
    """Rows (stage, notes, passed, dropped) of a given verdict table (note_id, stage, attempt, verdict); the last attempt counts."""
    w = Window.partitionBy("note_id", "stage").orderBy(F.desc("attempt"))
    last = verdicts.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    good = F.lit(False)
    for stage, v in passes.items():
        good = good | ((F.col("stage") == stage) & (F.col("verdict") == v))
    return last.groupBy("stage").agg(F.count("*").alias("notes"), F.count_if(good).alias("passed"), F.count_if(~good).alias("dropped"))


def disagreements(verdicts: DataFrame) -> DataFrame:
    """Notes that two checkers of a stage judge differently: they are dropped."""
    return verdicts.groupBy("note_id", "stage").agg(F.count_distinct("verdict").alias("verdicts"), F.count("*").alias("checkers")).where("verdicts > 1")


def context_window(passages: DataFrame, notes: DataFrame, book: str, pos: str, reach: int = 2) -> DataFrame:
    """notes with the passages at most ``reach`` places from theirs: equal books and an exploded place, so it is an equi-join."""
    near = notes.withColumn("_p", F.explode(F.sequence(F.col(pos) - reach, F.col(pos) + reach)))
    p = passages.select(F.col(book).alias("_b"), F.col(pos).alias("_q"), F.col("body"))
    return near.join(p, (F.col(book) == F.col("_b")) & (F.col("_p") == F.col("_q"))).drop("_b", "_q")
