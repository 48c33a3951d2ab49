"""From raw documents to sampled token sequences: filter, deduplicate, mix, encode.

Each stage is written as Parquet and read again before the next one. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, mixing, simhash, sp_sampling, toxicity
from plumbline.llm.common import Scratch, table

#: The near-dedup stage: shingles of five words; six bits of 64 differ where about one shingle in twenty does.
#: Pairs that differ in more bits are met by MinHash keys and linked where the exact Jaccard similarity is SIMILARITY or more.
SHINGLE, DISTANCE, SIMILARITY = 5, 6, 0.8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the severity model, fitted on the labelled ones, holds for toxic.

    Null and empty texts stay; equal texts get one answer; without toxic labels, and of an empty table, nothing goes.
    """
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays, and n_chars follows where there is one.

    A null text stays null, one that loses all lines becomes empty; of lines that repeat, the first by (doc_id, text hash, line) stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    out = line_dedup.dedup_lines(docs.toDF(*names), at["doc_id"], at["text"])
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.when(F.size("_removed") > 0, F.length(at["text"])).otherwise(F.col(at["n_chars"])))
    return out.select(*names).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null and empty texts have one fingerprint and are one group; rows that share a doc_id go or stay together; a null id stays if its
    group has no other.
    """
    groups = simhash.groups(docs, shingle=SHINGLE, distance=DISTANCE, similarity=SIMILARITY)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = docs.toDF(*names).join(gone, F.col(names[docs.columns.index("doc_id")]).eqNullSafe(F.col("gone")), "left_anti")
    return kept.toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes near its target of words.

    A null source is a source of its own; a source without words gives nothing; rows that share a doc_id draw alike.
    """
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each text, as piece ids: rows (doc_id, sample, ids, logp, inclusion).

    A null text gives no rows, an empty one a sample without pieces; a document that the mix repeats gives the same samples each time.
    """
    return sp_sampling.encode_samples(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The fingerprints, the regression and the sampling can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
