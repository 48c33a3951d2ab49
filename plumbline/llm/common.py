"""What several operators share: scratch tables, components, lookups, a fixed-size filter."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A lookup table of at most this many rows is broadcast; a larger one is joined with salt.
BROADCAST_ROWS = 100_000
SALTS = 32


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Sends the functions of a module to Python workers by value, so that executors need no copy of it."""
    from pyspark import cloudpickle

    for name in (module, __name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def remembered() -> dict:
    """What a Python worker keeps from task to task, by operator. It is the interpreter's, since functions come by value."""
    return sys.__dict__.setdefault("_plumbline_kept", {})


def forget() -> None:
    """Frees what other operators' tasks have left in a worker that is used again, so that it does not add to this one's memory."""
    remembered().clear()


_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset (one machine, tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended, and with it the files' use
            pass


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def cut(self, df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
        """Writes df and reads it back. ``arrow_rows`` bounds the rows that a Python worker gets at once, for this write."""
        path, name = scratch_dir(self.spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        if arrow_rows:
            self.spark.conf.set(name, str(arrow_rows))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(name, before)
        _made.append((self.spark, path))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._plumbline_path = path
        return out

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a table made by cut() which nothing reads any more."""
        if path := getattr(df, "_plumbline_path", None):
            remove(self.spark, path)


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on one key (nulls meet nulls) of a lookup that has each key once.

    A lookup counted at no more than ``limit`` rows is broadcast. A larger one is copied once for each
    salt, and the rows of a hot key are dealt over the salts, so that no task gets a whole hot key.
    """
    right = lookup.withColumnRenamed(key, "_k")
    if lookup.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(right), rows[key].eqNullSafe(F.col("_k")), "left").drop("_k")
    salted = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("_t", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return left.join(salted, left[key].eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_s")), "left").drop("_k", "_s", "_t")


def global_rank(df: DataFrame, order: Sequence[Column], scratch: Scratch) -> DataFrame:
    """Adds _rank, from 0, in a total order, without one task that holds all rows: ranges, then a rank in each range plus the rows before it."""
    dealt = scratch.cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before, at = [], 0
    for p, n in sorted(dealt.groupBy("_p").count().collect()):  # a row for each partition
        before.append((p, at))
        at += n
    offsets = dealt.sparkSession.createDataFrame(before or [(0, 0)], "_p int, _before long")
    w = Window.partitionBy("_p").orderBy(*order)
    return dealt.withColumn("_n", F.row_number().over(w)).join(F.broadcast(offsets), "_p").withColumn("_rank", F.col("_before") + F.col("_n") - 1).drop("_p", "_n", "_before")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds; each is two grouped minima and two joins of edges with
    one row a node, which adaptive execution splits where a node is hot. A round's edges go to a shared
    table, so a lost executor costs one round's tasks. Ends when a round changes nothing.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.c).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
        joined = large.join(low, large.a == low.c)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.cut(small)
        now = mark(new)
        scratch.drop(e)
        e, done = new, now == seen
        seen = now
        if done:
            break
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: log2 of a filter's bits: 2**24 bits are 2 MB, whatever the input; a fuller filter lets more rows pass, never fewer.
FILTER_BITS = 24


def _place(key: str):
    """The number of a key's 64-bit word in a filter, and its bit there."""
    bit = F.col(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    return F.shiftright(bit, 6), bit.bitwiseAND(F.lit(63)).cast("int")


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A one-hash Bloom filter of 64-bit keys as at most 2**18 words (_f, _bits): size-bounded, so it may be broadcast."""
    word, bit = _place(key)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return keys.select(word.alias("_f"), one.alias("_b")).groupBy("_f").agg(F.bit_or("_b").alias("_bits"))


def with_maybe(rows: DataFrame, flt: DataFrame, key: str, name: str = "_maybe") -> DataFrame:
    """rows with a boolean: whether the row's 64-bit key may be among the filter's keys (true for all that are, and few others)."""
    word, bit = _place(key)
    hit = F.coalesce(F.call_function("bit_get", F.col("_bits"), bit) == 1, F.lit(False))
    return rows.withColumn("_f2", word).join(F.broadcast(flt), F.col("_f2") == F.col("_f"), "left").withColumn(name, hit).drop("_f", "_f2", "_bits")


def pass_filter(rows: DataFrame, flt: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among the filter's keys."""
    return with_maybe(rows, flt, key).where("_maybe").drop("_maybe")


#: Items of one key that a task compares with as many others, and rounds in which a key's items meet two of them first.
KEY_BLOCK, PEELS = 512, 2


def as_edges(linked_: DataFrame) -> DataFrame:
    return linked_.select(F.col("node").alias("a"), F.col("component").alias("b"))


def link_by_keys(keyed: DataFrame | list[DataFrame], near: Callable[[str, str], Column], scratch: Scratch, payload: Callable[[DataFrame], DataFrame] | None = None, block: int = KEY_BLOCK, peels: int = PEELS, may: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Components (node, component) of items, of those that share a key and are ``near``; rows of keyed are (key long, item long), distinct.

    Keys may come in several tables, none of which shares a key with another: each is shuffled by itself, and its files go before
    the next one's come. ``near`` compares two items' payloads: rows (item, v) that ``payload`` makes of the wanted items, or the
    items themselves. ``may`` is a cheaper test that all near pairs pass; it goes first. A key's items meet its least and greatest item, unless one component holds both; then these two have met
    all others and are done with. After ``peels`` such rounds the items of a key that are still in different components meet
    each other, in blocks dealt over tasks and each pair in the least key that it shares, inside a join that returns links
    alone; so no link between components is lost, and no list of pairs is made.
    """
    met = []
    for part in keyed if isinstance(keyed, list) else [keyed]:
        ends = scratch.cut(part.groupBy("key").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo < hi"))
        scratch.tidy()
        met.append(scratch.cut(pass_filter(part, key_filter(ends, "key"), "key").join(ends.select("key"), "key", "left_semi").withColumn("c", F.col("item"))))
        scratch.drop(ends)
    held = scratch.cut(reduce(DataFrame.unionByName, met))
    for used in met:
        scratch.drop(used)
    body = payload(scratch.cut(held.select("item").distinct())) if payload else None

    def with_value(rows: DataFrame, item: str, value: str) -> DataFrame:
        if body is None:
            return rows.withColumn(value, F.col(item))
        return rows.join(body.select(F.col("item").alias("_item"), F.col("v").alias(value)), F.col(item) == F.col("_item")).drop("_item")

    def joined(edges: DataFrame, known: DataFrame | None) -> DataFrame:
        return scratch.cut(components(edges if known is None else as_edges(known).unionByName(edges), scratch))

    may = may or (lambda a, b: F.lit(True))
    known = None
    for _ in range(peels):
        # tables of their own, so that adaptive execution can split a hot key's rows in the joins
        one = F.struct("item", "c")
        ends = scratch.cut(held.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("c0 < c1").drop("c0", "c1"))
        members = scratch.cut(held.join(ends, "key"))
        scratch.drop(held)
        pairs = members.select("item", "c", F.explode(F.array("lo", "hi")).alias("end")).where("c <> end.c").select(F.greatest("item", "end.item").alias("a"), F.least("item", "end.item").alias("b")).distinct()
        found = scratch.cut(with_value(with_value(pairs, "a", "va"), "b", "vb").where(may("va", "vb") & near("va", "vb")).select("a", "b"))
        scratch.tidy()
        known = joined(found, known)
        inner = members.where("n > 3 and item <> lo.item and item <> hi.item").select("key", "item")
        held = scratch.cut(inner.join(known, F.col("item") == F.col("node"), "left").select("key", "item", F.coalesce("component", "item").alias("c")))
        for used in (ends, members, found):
            scratch.drop(used)
        if held.isEmpty():
            return known
    n = F.ceil(F.count("*") / block).cast("int")
    mixed = scratch.cut(held.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), n.alias("nb")).where("c0 < c1").select("key", "nb"))
    if mixed.isEmpty():
        return known
    dealt = scratch.cut(held.join(mixed, "key").withColumn("at", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int")))
    # an item has few keys: as many as its bands or choices of blocks
    values = with_value(dealt.groupBy("item").agg(F.collect_set("key").alias("ks")), "item", "v").withColumnRenamed("item", "_item2")
    open_ = scratch.cut(dealt.join(values, F.col("item") == F.col("_item2")).select("key", "item", "c", "at", "nb", "ks", "v"))
    # blocks i and j of a key are a task: rows of block i meet those of block j
    sides = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", "c", "at", "ks", "v", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    left = sides.select("key", "i", "j", F.col("c").alias("a"), F.col("v").alias("va"), F.col("at").alias("ia"), F.col("ks").alias("ka"))
    right = sides.select(F.col("key").alias("key2"), F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("c").alias("b"), F.col("v").alias("vb"), F.col("at").alias("ib"), F.col("ks").alias("kb"))
    same = (F.col("key") == F.col("key2")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2"))
    once = (F.col("a") < F.col("b")) & ((F.col("i") == F.col("j")) | (F.col("ia") != F.col("ib"))) & may("va", "vb") & (F.array_min(F.array_intersect("ka", "kb")) == F.col("key"))
    more = scratch.cut(left.join(right, same & once & near("va", "vb")).select("a", "b").distinct())
    for used in (dealt, open_):
        scratch.drop(used)
    return known if more.isEmpty() else joined(more, known)


class Sealed:
    """A frame's columns under private names of their own, so that no column of the input can clash with an operator's."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"__{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        return f"__{self.names.index(name)}"

    def open(self, rows: DataFrame, **added: Column) -> DataFrame:
        """The input's columns under their names, then the added ones; an added name that the input has gets underscores in front."""
        out, names = [f"__{i}" for i in range(len(self.names))], list(self.names)
        for name, c in added.items():
            while name.lower() in {n.lower() for n in names}:
                name = "_" + name
            out.append(c.alias(name))
            names.append(name)
        return rows.select(*out).toDF(*names)
