"""Exact dedup by a log-structured merge index, in DataFrame operations only.

The index is a folder of runs. A memtable, dealt over ranges of the digest, is flushed as one run of level 0: a
row (digest, id, n) for each digest, sorted in each range, with a filter of the run's digests beside it. When a
level has FANOUT runs, compaction merges them into one run of the next level and keeps the smallest identifier
(or the largest, if asked for) and the number of rows. Before a memtable is flushed, it is probed: each run's
filter picks the digests that the run may hold, and only those meet the run's own.

Digests that a probe finds, or that repeat within a memtable, are hits. A hit's texts are compared byte by byte:
of the texts of one digest the least and the greatest must be the same. The identifier that stays and the
group's size are the compacted index's.

Defined results: a null text counts as empty; rows that are alike in id and text are counted each, and
all of them have kept = true where their id is the one that stays; a null id never stays while its group
has another; an empty table gives an empty result; the input's other columns play no part. Two texts of one
digest end the run with an error: it must not guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, key_filter, pass_filter, remove, scratch_dir, table

MEMTABLES, FANOUT = 4, 2


class MergeIndex:
    """Levels of sorted runs with rows (digest binary, id, n); self.levels[i] are level i's run folders, oldest first."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest", fanout: int = FANOUT):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be smallest or largest, not {keep}")
        self.spark, self.path, self.keep, self.fanout = spark, path, keep, fanout
        self.levels: list[list[str]] = [[]]
        self.made = self.compactions = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        run = f"{self.path}/level{level}-{self.made}"
        self.made += 1
        ranged = rows.repartition(F.substring("digest", 1, 2)).sortWithinPartitions("digest")
        ranged.write.parquet(f"{run}/rows")
        key_filter(self._read([run]).select(F.xxhash64("digest").alias("h")), "h").write.parquet(f"{run}/filter")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema("digest binary, id long, n long").parquet(*[f"{r}/rows" for r in runs])

    def _merge(self, rows: DataFrame) -> DataFrame:
        pick = F.min("id") if self.keep == "smallest" else F.max("id")
        return rows.groupBy("digest").agg(pick.alias("id"), F.sum("n").alias("n"))

    @property
    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def probe(self, digests: DataFrame) -> list[DataFrame]:
        """For each run the rows of digests (digest, ...) that it holds; its filter goes before its digests."""
        out = []
        for run in self.runs:
            flt = self.spark.read.schema("_f long, _bits long").parquet(f"{run}/filter")
            maybe = pass_filter(digests.withColumn("_h", F.xxhash64("digest")), flt, "_h").drop("_h")
            out.append(maybe.join(self._read([run]).select("digest"), "digest", "left_semi"))
        return out

    def flush(self, rows: DataFrame) -> None:
        """Writes a memtable of rows (digest, id) as a run and compacts the levels that are full."""
        self._write(self._merge(rows.select("digest", "id", F.lit(1).cast("long").alias("n"))), 0)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges a level's runs into one run of the next level; the old runs go after the new one is whole."""
        old, self.levels[level] = self.levels[level], []
        self._write(self._merge(self._read(old)), level + 1)
        self.compactions += 1
        for run in old:
            remove(self.spark, run)

    def read(self) -> DataFrame:
        """A row a digest; what lies in more than one run is merged."""
        if not self.runs:
            return self.spark.createDataFrame([], "digest binary, id long, n long")
        return self._merge(self._read(self.runs)) if len(self.runs) > 1 else self._read(self.runs)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", memtables: int = MEMTABLES) -> DataFrame:
    """One row a document: key, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch, index = Scratch(spark), MergeIndex(spark, scratch_dir(spark), keep)
    body = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    digest = F.unhex(F.sha2("body", 256))
    rows = scratch.cut(body.select("id", digest.alias("digest")))
    hits = None
    for m in range(memtables):
        memtable = rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(memtables)) == m)
        found = [memtable.groupBy("digest").count().where("count > 1").select("digest"), *[p.select("digest") for p in index.probe(memtable)]]
        for f in found:
            hits = f if hits is None else hits.unionByName(f)
        hits = scratch.cut(hits.distinct())
        index.flush(memtable)
    hits = hits.withColumn("h", F.xxhash64("digest"))

    # byte verification: the texts of a hit are read again and compared; copies are combined before the shuffle
    again = pass_filter(body.select(digest.alias("digest"), "body").withColumn("h", F.xxhash64("digest")), key_filter(hits, "h"), "h")
    seen = again.join(hits.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b"))
    if not seen.where("a <> b").limit(1).isEmpty():
        raise ValueError("two different texts share a SHA-256 digest")
    # a table of its own, so that adaptive execution can split the rows of a hot digest in the join
    groups = scratch.cut(index.read().join(hits.select("digest"), "digest", "left_semi").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size")))
    out = rows.join(groups, "digest", "left")
    keep_id = F.coalesce("keep_id", "id")
    return out.select(F.col("id").alias(key), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, coalesce(g.keep_id, d.doc_id) AS keep_id, g.group_size,
  (d.doc_id IS NOT DISTINCT FROM coalesce(g.keep_id, d.doc_id)) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
