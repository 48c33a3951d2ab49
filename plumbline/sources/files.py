"""Topic folders: texts, maps, notes, configuration; and what is written to them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import notes as N

# The names of the settings that are read, and a map's schema.
SETTINGS = ("title", "profile", "grounding", "citations", "depth", "coverage", "extrapolation", "panel")
SPAN = "label string, title string, source string, start bigint, end bigint"
MAP = f"kind string, slug string, source string, total_chars bigint, provenance string, provenance_evidence array<string>, pages array<struct<label:string,start:bigint,end:bigint>>, chapters array<struct<{SPAN.replace(' bigint', ':bigint').replace(' string', ':string').replace(', ', ',')}>>, images array<struct<page:int,label:string,count:int,largest:array<int>,figure:boolean,full_page:boolean>>"


def _stem(suffix: str):
    return F.regexp_extract("_metadata.file_path", rf"([^/]+){suffix}$", 1)


def maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAP).option("multiLine", True).json(path)


def texts(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """(slug, text) of text files; ``only`` prunes files by name before they are read."""
    df = spark.read.text(path, wholetext=True).select(_stem(r"\.txt").alias("slug"), F.col("value").alias("text"))
    return df.where(F.col("slug").isin(only)) if only else df


def load_books(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """(slug, text, map's columns) of a topic's texts that have a map; a text without one is left out."""
    m = maps(spark, f"{folder}/*.map.json").drop("slug").withColumn("slug", _stem(r"\.map\.json"))
    return texts(spark, f"{folder}/*.txt", only).join(m, "slug")


def note_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) with physical line numbers from 1: a file is read whole, since splits lose their order."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n", -1)).alias("i", "line"))
    return t.select("path", (F.col("i") + 1).alias("line_no"), "line")


def read_notes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, errors) of JSON lines."""
    p = N.parse(note_lines(spark, path))
    return N.notes_of(p), p.where(F.size("errors") > 0).select("path", "line_no", F.explode("errors").alias("error"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines without columns that begin with an underscore."""
    df.select(*[c for c in df.columns if not c.startswith("_")]).write.json(path)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(path, rejected): lines that aren't blank, unparsed."""
    return note_lines(spark, path).where(F.trim("line") != "").groupBy("path").agg(F.count("*").alias("rejected"))


def config(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the flat scalar settings, without quotes and comments."""
    line = F.regexp_extract_all("value", F.lit(r"(?m)^([a-z_]+:[ \t]*[^\n#]+?)[ \t]*(?:#.*)?$"), F.lit(1))
    kv = spark.read.text(path, wholetext=True).select(F.explode(line).alias("kv"))
    key, value = F.regexp_extract("kv", r"^([a-z_]+):", 1), F.regexp_replace(F.trim(F.regexp_replace("kv", r"^[a-z_]+:[ \t]*", "")), "^[\"']+|[\"']+$", "")
    return kv.select(key.alias("key"), value.alias("value")).where(F.col("key").isin(*SETTINGS))


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem) of source files by extension, their contents unread."""
    f = spark.read.format("binaryFile").load(path).select("path")
    return f.where(F.lower("path").rlike(r"\.(pdf|epub|azw3|azw|mobi|prc)$")).select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"))


def find_topic(start: str, name: str = "topic.config.yaml", hidden: str = ".topic") -> str | None:
    """The nearest folder, from ``start`` upwards, that holds the configuration itself or in its hidden folder."""
    here = os.path.abspath(start)
    while True:
        for d in (here, os.path.join(here, hidden)):
            if os.path.exists(os.path.join(d, name)):
                return d
        if os.path.dirname(here) == here:
            return None
        here = os.path.dirname(here)


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows as JSON, one a line, characters unescaped."""
    report.write.json(path)


def write_books(books: DataFrame, segments: DataFrame, path: str) -> None:
    """Books and segments as Parquet tables below ``path``."""
    books.write.parquet(f"{path}/books")
    segments.write.parquet(f"{path}/segments")
