"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster set partitions near twice the cores."""
    b = SparkSession.builder.master(master).appName("plumbline").config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df dealt over the cores where its scan has fewer splits than there are cores, as a table of one file has; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as views, so that plain SQL can be used on them."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
